"""Fingerprints against a plain version, and their error."""

import random

import xxhash
from pyspark.sql import functions as F
from test_odd_cases import WORD, shingles

from estatelens.llm import fingerprints as P

RANKS = P._ranks()


def plain(text):
    """The hexadecimal digits, from sets and loops."""
    words = WORD.findall(text.lower())
    if not words:
        return ""
    bins = {}
    for i in range(max(1, len(words) - P.WORDS + 1)):
        h = 42
        for w in words[i : i + P.WORDS]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        signed = h - (1 << 64) if h >> 63 else h
        at = (signed >> (64 - P.LOG_BINS)) + P.BINS // 2
        bins[at] = min(signed, bins.get(at, signed))
    filled = {b: v & 255 for b, v in bins.items()}
    out = []
    for j in range(P.BINS):
        donor = j if j in filled else min(filled, key=lambda b: RANKS[j * P.BINS + b])
        out.append(f"{filled[donor]:02x}")
    return "".join(out)


def test_fingerprints_equal_loops(spark, odd, sf_dir):
    for docs in (odd.select("text"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")):
        got = P.fingerprint(docs.where("text is not null"), "text", "f").collect()
        assert all(r.f == plain(r.text) for r in got)
        by = {}
        assert all(by.setdefault(r.text, r.f) == r.f for r in got)


def test_likeness_estimates_the_similarity(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 500))]
        cut = rng.randrange(len(a))
        b = a[:cut] + [f"w{rng.randrange(10**6)}" for _ in range(len(a) - cut)]
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = P.fingerprint(P.fingerprint(df, "a", "fa"), "b", "fb").select("a", "b", P.likeness("fa", "fb").alias("x")).collect()
    errors = []
    for r in got:
        x, y = shingles(r.a, 5), shingles(r.b, 5)
        errors.append(r.x - len(x & y) / len(x | y))
    # 128 bins: a deviation of 0.044 at most, and no bias
    assert abs(sum(errors) / len(errors)) < 0.012 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


def test_empty_bins_borrow_alike(spark):
    df = spark.createDataFrame([("one two three four five six", "one two three four five six"), ("a b c d e f g", "a b c d e f h")], "a string, b string")
    got = P.fingerprint(P.fingerprint(df, "a", "fa"), "b", "fb").select(P.likeness("fa", "fb").alias("x")).collect()
    assert got[0].x == 1 and 0.2 < got[1].x < 0.8


def test_windows_of_uneven_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "WINDOW_ROWS", 3)
    monkeypatch.setattr(P, "QUANTILES", 4)
    rng = random.Random(9)
    ids = sorted({rng.choice([rng.randrange(50), 10**6 + rng.randrange(10**4), -rng.randrange(10**15), 2**62 + rng.randrange(99)]) for _ in range(120)})
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "n")], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next_text for r in P.with_next(df, "text").collect()}
    order = [None, *ids]
    assert got == {d: "n" if order[i - 1] is None else f"t{order[i - 1]}" for i, d in enumerate(order)}


def test_one_row_follows_itself(spark):
    df = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    r = P.fingerprints(df).first()
    assert (r.near_edited, r.near_next, r.n_chars) == (P.fingerprints(df).select(F.col("near_edited")).first()[0], 1.0, 3)
