"""Semantic models in three text formats, read into tables: models, datasets, fields, metrics, relationships and diagnostics.

Each format is a list of what its objects hold; one walker turns them into rows. What a format knows and this package does not
is kept in the source snapshot and named in a diagnostic, so that nothing is lost without a word. Files are bounded and read
on the driver; the rows are DataFrames from there on.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from .catalogs import strict_json

#: Fixed bounds of a source bundle.
MOST_FILES, MOST_BYTES = 256, 8 << 20
SUFFIXES = (".json", ".yaml", ".yml")
SCHEMAS = {
    "models": "id string, name string, description string, source_reference string",
    "datasets": "id string, model string, name string, source string, description string, primary_key array<string>, source_reference string",
    "fields": "id string, dataset string, name string, data_type string, description string, expression string, dialect string, source_reference string",
    "metrics": "id string, model string, name string, description string, expression string, dialect string, source_reference string",
    "relationships": "id string, model string, name string, from_dataset string, to_dataset string, from_fields array<string>, to_fields array<string>, source_reference string",
    "diagnostics": "level string, code string, source_reference string",
}
#: Fixed pattern: a join that is one field equality.
_EQUALITY = r"\s*\{CUBE\}\.(NAME)\s*=\s*\{(NAME)\.(NAME)\}\s*".replace("NAME", r"[A-Za-z_][A-Za-z0-9_$]*")


def structured(text: str) -> dict:
    """A JSON or YAML mapping; repeated keys are refused."""
    if text.lstrip().startswith(("{", "[")):
        out = strict_json(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML sources need the yaml package") from e

        class Unique(yaml.SafeLoader):
            pass

        def mapping(loader, node):
            pairs = loader.construct_pairs(node, deep=True)
            if len(dict(pairs)) != len(pairs):
                raise ValueError("a key is repeated")
            return dict(pairs)

        Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
        out = yaml.load(text, Unique)  # a safe loader
    if not isinstance(out, dict):
        raise ValueError("a semantic source is a mapping")
    return out


def read_bundle(path: str, suffixes: Iterable[str] = SUFFIXES) -> dict[str, str]:
    """The texts of a file or of a folder's files by relative path, in order."""
    if os.path.isfile(path):
        found = {os.path.basename(path): path}
    else:
        every = (os.path.join(d, f) for d, _, files in os.walk(path) for f in files)
        found = {os.path.relpath(p, path): p for p in every if p.lower().endswith(tuple(suffixes))}
    if not found or len(found) > MOST_FILES or sum(os.path.getsize(p) for p in found.values()) > MOST_BYTES:
        raise ValueError(f"a bundle has 1 to {MOST_FILES} files of {MOST_BYTES} bytes together at most")
    out = {}
    for name in sorted(found):
        with open(found[name], encoding="utf-8") as f:
            out[name] = f.read()
    return out


def snapshot(files: dict[str, str]) -> str:
    """The digest of a bundle's paths and texts in order."""
    return hashlib.sha256(json.dumps([[p, files[p]] for p in sorted(files)], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def part_id(kind: str, name: str) -> str:
    return f"{kind}:{quote(name, safe='')}"


@dataclass
class Import:
    """Rows of one import, by table, with its format and the digest of its source."""

    name: str
    format_name: str
    version: str
    sha256: str
    rows: dict[str, list[tuple]] = field(default_factory=lambda: {t: [] for t in SCHEMAS})

    def add(self, table: str, *row) -> str:
        self.rows[table].append(row)
        return row[0]

    def note(self, level: str, code: str, reference: str) -> None:
        self.add("diagnostics", level, code, reference)

    def unread(self, data: dict, known: str, reference: str, preserved: str = "") -> None:
        """Keys that are kept in the snapshot only."""
        for key in sorted(set(data) - set(known.split())):
            self.note("warning", f"preserved_{key}" if key in preserved.split() else "unknown_key", f"{reference}/{key}")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {t: spark.createDataFrame(self.rows[t], s) for t, s in SCHEMAS.items()}


def _text(data: dict, key: str, reference: str) -> str:
    value = data.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{reference}/{key} must be a text")
    return value


def _list(data: dict, key: str, reference: str) -> list[dict]:
    value = data.get(key) or []
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise ValueError(f"{reference}/{key} must be a list of mappings")
    return value


def _once(names: list[str], reference: str) -> None:
    if len(set(names)) != len(names):
        raise ValueError(f"names repeat at {reference}")


def _dialects(out: Import, data: dict, reference: str) -> list[tuple[str, str]]:
    """(dialect, expression) of a field or metric, the first one being the one that binds."""
    if data.get("expression") is None:
        out.note("error", "missing_expression", f"{reference}/expression")
        return []
    own = f"{reference}/expression/dialects"
    return [(_text(d, "dialect", own), _text(d, "expression", own)) for d in _list(data["expression"], "dialects", reference)]


def read_ossie(out: Import, files: dict[str, str]) -> None:
    """One document with semantic_model: models of datasets, fields, metrics and relationships."""
    root = structured(next(iter(files.values())))
    out.version = _text(root, "version", "")
    if root.get("semantic_model") is None:
        if "ontology" not in root:
            raise ValueError("a semantic_model is needed")
        out.note("error", "unsupported_ontology", "/ontology")
    out.unread(root, "$schema description name ontology requires semantic_model version", "")
    models = _list(root, "semantic_model", "")
    _once([_text(m, "name", "/semantic_model") for m in models], "/semantic_model")
    common, extra = "ai_context description name", "custom_extensions unique_keys"
    for i, m in enumerate(models):
        at = f"/semantic_model/{i}"
        model = out.add("models", part_id("model", m["name"]), m["name"], m.get("description"), at)
        out.unread(m, f"{common} datasets metrics relationships", at, extra)
        names = [_text(d, "name", f"{at}/datasets") for d in _list(m, "datasets", at)]
        _once(names, f"{at}/datasets")
        for j, d in enumerate(_list(m, "datasets", at)):
            here = f"{at}/datasets/{j}"
            dataset = out.add("datasets", f"{model}/{part_id('dataset', d['name'])}", model, d["name"], _text(d, "source", here), d.get("description"), d.get("primary_key") or [], here)
            out.unread(d, f"{common} fields primary_key source", here, extra)
            _once([_text(f, "name", here) for f in _list(d, "fields", here)], f"{here}/fields")
            for k, f in enumerate(_list(d, "fields", here)):
                spot = f"{here}/fields/{k}"
                dialect, expression = (_dialects(out, f, spot) or [(None, None)])[0]
                out.unread(f, f"{common} datatype dimension expression", spot, extra)
                out.add("fields", f"{dataset}/{part_id('field', f['name'])}", dataset, f["name"], f.get("datatype"), f.get("description"), expression, dialect, spot)
        for j, x in enumerate(_list(m, "metrics", at)):
            here = f"{at}/metrics/{j}"
            dialect, expression = (_dialects(out, x, here) or [(None, None)])[0]
            out.unread(x, f"{common} datatype expression", here, extra)
            out.add("metrics", f"{model}/{part_id('metric', _text(x, 'name', here))}", model, x["name"], x.get("description"), expression, dialect, here)
        for j, r in enumerate(_list(m, "relationships", at)):
            here = f"{at}/relationships/{j}"
            out.unread(r, f"{common} from from_columns to to_columns", here, extra)
            ends = [_text(r, "from", here), _text(r, "to", here)]
            if set(ends) - set(names):
                out.note("error", "unknown_relationship_dataset", here)
            out.add("relationships", f"{model}/{part_id('relationship', _text(r, 'name', here))}", model, r["name"], *ends, r.get("from_columns") or [], r.get("to_columns") or [], here)


def read_sml(out: Import, files: dict[str, str]) -> None:
    """One object a file: a catalog, datasets, metrics and models, told apart by object_type."""
    parsed = {p: structured(t) for p, t in files.items()}
    by = {}
    for p, x in parsed.items():
        by.setdefault(_text(x, "object_type", p), []).append((p, x))
    for p, x in by.get("catalog", [])[:1]:
        out.version = str(x.get("version") or "unspecified")
        out.unread(x, "description object_type unique_name version", p)
    for kind in sorted(set(by) - {"catalog", "dataset", "metric", "metric_calc", "model"}):
        for p, _ in by[kind]:
            out.note("warning", "preserved_object", p)
    datasets, metrics = by.get("dataset", []), [*by.get("metric", []), *by.get("metric_calc", [])]
    models = by.get("model", [])
    if not models:
        first = next(iter(parsed))
        models = [(first, {"object_type": "model", "unique_name": out.name})]
        out.note("warning", "model_synthesized", first)
    names = {_text(x, "unique_name", p) for p, x in datasets}
    defined = {_text(x, "unique_name", p) for p, x in metrics}
    for n, (p, m) in enumerate(models):
        model = out.add("models", part_id("model", _text(m, "unique_name", p)), m["unique_name"], m.get("description"), p)
        out.unread(m, "description metrics object_type relationships unique_name visible", p, "dimensions")
        if {x.get("unique_name") for x in _list(m, "metrics", p)} - defined:
            out.note("warning", "metric_definition_missing", f"{p}#/metrics")
        for q, d in datasets:
            dataset = out.add("datasets", f"{model}/{part_id('dataset', d['unique_name'])}", model, d["unique_name"], _text(d, "table", q), d.get("description"), [], q)
            for i, c in enumerate(_list(d, "columns", q)):
                spot = f"{q}#/columns/{i}"
                out.add("fields", f"{dataset}/{part_id('field', _text(c, 'name', spot))}", dataset, c["name"], c.get("data_type"), c.get("description"), c.get("sql") or c["name"], "sml", spot)
                if not n:
                    out.unread(c, "data_type description dialects name sql", spot)
            if not n:
                out.unread(d, "columns connection_id description object_type table unique_name", q)
        for q, x in metrics:
            given = x.get("expression") or f"{str(x.get('calculation_method') or 'value').upper()}({_text(x, 'dataset', q)}.{_text(x, 'column', q)})"
            out.add("metrics", f"{model}/{part_id('metric', x['unique_name'])}", model, x["unique_name"], x.get("description"), given, "sml", q)
            if not n:
                out.unread(x, "calculation_method column dataset description expression object_type unique_name", q, "format")
        for i, r in enumerate(_list(m, "relationships", p)):
            here = f"{p}#/relationships/{i}"
            a, b = r.get("from") or {}, r.get("to") or {}
            if b.get("dataset") not in names or len(a.get("join_columns") or []) != len(b.get("join_columns") or []):
                out.note("warning", "preserved_relationship", here)
                continue
            out.add("relationships", f"{model}/{part_id('relationship', _text(r, 'unique_name', here))}", model, r["unique_name"], _text(a, "dataset", here), b["dataset"], a["join_columns"], b["join_columns"], here)


def read_cube(out: Import, files: dict[str, str]) -> None:
    """Cubes with dimensions, measures and joins, over any number of files; views stay in the snapshot."""
    out.version, cubes = "yaml", []
    for p, text in files.items():
        root = structured(text)
        cubes += [(f"{p}#/cubes/{i}", c) for i, c in enumerate(_list(root, "cubes", p))]
        if root.get("views"):
            out.note("warning", "preserved_views", f"{p}#/views")
        out.unread(root, "cubes views", p)
    names = [_text(c, "name", at) for at, c in cubes]
    _once(names, "/cubes")
    if not cubes:
        out.note("error", "models_missing", "/")
    model = out.add("models", part_id("model", out.name), out.name, None, "/")
    for at, c in cubes:
        keys = [d["name"] for d in _list(c, "dimensions", at) if d.get("primary_key") is True]
        source = c.get("sql_table") or c.get("sql")
        if not source:
            raise ValueError(f"{at} needs sql_table or sql")
        dataset = out.add("datasets", f"{model}/{part_id('dataset', c['name'])}", model, c["name"], source, c.get("description"), keys, at)
        out.unread(c, "description dimensions joins measures name sql sql_table", at)
        for i, d in enumerate(_list(c, "dimensions", at)):
            spot = f"{at}/dimensions/{i}"
            out.add("fields", f"{dataset}/{part_id('field', _text(d, 'name', spot))}", dataset, d["name"], d.get("type"), d.get("description"), _text(d, "sql", spot), "cube-sql", spot)
            out.unread(d, "description name primary_key sql type", spot)
        for i, x in enumerate(_list(c, "measures", at)):
            spot = f"{at}/measures/{i}"
            kind, name = _text(x, "type", spot), f"{c['name']}.{_text(x, 'name', spot)}"
            given = x.get("sql") or ("COUNT(*)" if kind == "count" else f"CUBE_MEASURE({kind})")
            if not x.get("sql") and kind != "count":
                out.note("warning", "measure_expression_opaque", spot)
            out.add("metrics", f"{model}/{part_id('metric', name)}", model, name, x.get("description"), given, "cube-sql", spot)
            out.unread(x, "description name sql type", spot)
        for i, j in enumerate(_list(c, "joins", at)):
            spot = f"{at}/joins/{i}"
            target = _text(j, "name", spot)
            same = re.fullmatch(_EQUALITY, _text(j, "sql", spot))
            if same is None or same[2] != target:
                out.note("warning", "join_preserved", spot)
            elif target not in names:
                out.note("error", "join_target_missing", spot)
            else:
                name = f"{c['name']}_to_{target}"
                out.add("relationships", f"{model}/{part_id('relationship', name)}", model, name, c["name"], target, [same[1]], [same[3]], spot)
                out.unread(j, "description name sql", spot, "relationship")


READERS = {"ossie": read_ossie, "sml": read_sml, "cube": read_cube}


def read_import(name: str, format_name: str, files: dict[str, str]) -> Import:
    """One import of a bundle {path: text} in a format."""
    if format_name not in READERS:
        raise ValueError(f"unknown semantic format: {format_name}")
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
        raise ValueError("an import's name has letters, digits, dots, underscores and hyphens")
    out = Import(name, format_name, "unspecified", snapshot(files))
    READERS[format_name](out, dict(sorted(files.items())))
    return out
