"""Results as comparable rows."""


def rows_of(pdf):
    """Rows as sorted tuples of text, columns by name, numbers to six places."""
    import pandas as pd

    def plain(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return "null"
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return str(list(v))
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            f = float(v) if not isinstance(v, str) else None
        except TypeError:
            f = None
        return str(v) if f is None else str(int(f)) if f == int(f) else f"{f:.6f}"

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False))
