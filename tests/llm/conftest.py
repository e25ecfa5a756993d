"""Documents with every odd case the operators define."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, component_id long, row int, `a.b` int, __sha string, `q``t` int, gone long, c0 string"


def invented(rng, n):
    return " ".join("".join(rng.choice(["ba", "ne", "to", "ri", "sul", "Qua"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def odd_rows():
    rng = random.Random(11)
    base = invented(rng, 60)
    near = base.split()
    near[30] = "CHANGED"
    texts = [base, base, base.replace(" ", "\n\t"), " ".join(near), base.upper(), "", None, "  \n ", "one", "one two", "one two three", "é ß 日本   x", invented(rng, 300), invented(rng, 5) * 2000, "a " * 3000, "tie tie tie tie", "tie tie tie tie", "<|endoftext|> x<|endoftext|>", "▁ mark", "\x00nul \x1f x"]
    rows = [(i, t, "en", [None, "s1", "s2", "s0", ""][i % 5], None if t is None else len(t), i, f"k{i}", -i, i, i, f"x{i}", i, i, f"c{i}") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id", *[None] * 12), (None,) * 14, (5, "another text of five", "en", "s1", 1, 1, "x", 1, 1, 1, "y", 1, 1, "z")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
