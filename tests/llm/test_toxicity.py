"""Toxicity against a plain version of fit and score, and on held-out rows."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_odd_cases import words

from estatelens.llm import toxicity as T


def brute_segments(scores):
    """All maximal scoring segments by their recursive definition."""
    if not scores:
        return []
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-12 or (at and abs(s - best) <= 1e-12 and j - i < at[1] - at[0]):
                best, at = s, (i, j)
    return [] if at is None else [*brute_segments(scores[: at[0]]), best, *brute_segments(scores[at[1] :])]


def test_segments_equal_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-1.0, -0.05, -0.3, 0.01, 0.04, 0.3, 1.0]) for _ in range(rng.randrange(0, 25))]
        got = T.segments(np.array(scores))
        want = brute_segments(scores)
        assert sum(got) == pytest.approx(sum(want)) and len(got) == len(want)


def tokens(text):
    out = [w.strip(T._EDGE) for w in words(text)]
    return [xxhash.xxh3_64_intdigest(w) if w else 0 for w in out]


def identity(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - 2**64 if h >= 2**63 else h


class Plain:
    """The model of {text's hash: (text, toxic)}, by loops."""

    def __init__(self, docs):
        first = {}
        for d in sorted(docs):
            t = [1, 1, *tokens(docs[d][0]), 1, 1]
            for i in range(2, len(t) - 2):
                if t[i]:
                    first.setdefault((t[i], t[i - 1], t[i + 1]), []).append((docs[d][1], d))
        held, uses = defaultdict(set), defaultdict(int)
        for (b, _, _), seen in first.items():
            if len({y for y, _ in seen}) == 1:
                held[b].add((min(d for _, d in seen), seen[0][0]))
                uses[b] += 1 - seen[0][0]
        a = {b: sum(y for _, y in x) for b, x in held.items()}
        c = {b: sum(1 - y for _, y in x) for b, x in held.items()}
        na, nc, n = sum(a.values()), sum(c.values()), sum(uses.values())
        self.table = {}
        for b in held:
            prior = T.EVEN + T.BY_FREQUENCY * (a[b] + c[b]) / (na + nc)
            odds = math.log((a[b] + prior) / (na + T.BY_FREQUENCY - a[b])) - math.log((c[b] + prior) / (nc + T.BY_FREQUENCY - c[b]))
            error = math.sqrt(1 / (a[b] + prior) + 1 / (c[b] + prior))
            self.table[b] = math.copysign(max(abs(odds) - T.ERRORS * error, 0), odds)
        self.drift = max(T.DRIFT, sum(uses[b] / n * s for b, s in self.table.items()) + T.MARGIN)
        lo, hi = 1e-6, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            high = sum(uses[b] / n * math.exp(min(mid * (s - self.drift), 500)) for b, s in self.table.items()) > 1
            lo, hi = (lo, mid) if high else (mid, hi)
        self.decay = hi
        least = math.log(10) / hi
        clean = [t for t, y in docs.values() if not y]
        above = sum(s >= least for t in clean for s in self.found(t))
        self.k = max(above, 0.5) / sum(len(tokens(t)) for t in clean) * 10

    def found(self, text):
        return T.segments(np.array([self.table.get(h, 0.0) - self.drift for h in tokens(text)]))

    def over(self, text):
        n = len(tokens(text))
        random_ = max(math.log(max(self.k * n, 1e-9)), 0) if n else 0
        return [x for x in (self.decay * s - random_ for s in self.found(text)) if x > 0]


def test_fit_and_score_equal_loops(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    marked = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({(identity(texts[d]), y) for d, y in marked.items()}) == len({identity(texts[d]) for d in marked})
    plain = Plain({identity(texts[d]): (texts[d], y) for d, y in marked.items()})
    model = T.fit(docs, labels, T.remainder("doc_id", 3) != 1)
    known = np.array(sorted(plain.table), np.uint64)
    assert (model.tokens == known).all() and model.drift == pytest.approx(plain.drift)
    assert model.scores == pytest.approx([plain.table[int(h)] - plain.drift for h in known])
    unseen = np.array([known[0] - 1, known[-1] + 1, 0], np.uint64)
    assert (T.scores_of(unseen, model) == -model.drift).all()
    assert (model.decay, model.k) == (pytest.approx(plain.decay, rel=1e-4), pytest.approx(plain.k, rel=1e-3))
    # the curve is the maximum of the likelihood with a slight ridge
    one = {identity(texts[d]): (texts[d], y) for d, y in marked.items()}
    x = np.array([math.log1p(sum(plain.over(t))) for t, _ in one.values()])
    y = np.array([y for _, y in one.values()])

    def loss(bias, slope):
        z = bias + slope * x
        return np.sum(np.logaddexp(0, z) - y * z) + 5e-3 * (bias**2 + slope**2)

    best = loss(model.bias, model.slope)
    assert all(best <= loss(model.bias + i, model.slope + j) + 1e-6 for i in (-0.05, 0, 0.05) for j in (-0.05, 0, 0.05))
    for r in T.score(docs, model).collect():
        over = plain.over(texts[r.doc_id])
        z = model.bias + model.slope * math.log1p(sum(over))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3) and r.n_segments == len(over)


def test_clean_evidence_counts(spark):
    rng = random.Random(1)
    fill = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*rng.choices(fill, k=20), "vile" if i % 2 else "kind", *rng.choices(fill, k=20)]), i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), F.lit(True))
    vile, kind, unseen = T.scores_of(np.array([xxhash.xxh3_64_intdigest(w) for w in ("vile", "kind", "unheard")], np.uint64), model)
    assert vile > 0 > unseen > kind


def test_a_mean_above_zero_is_lowered():
    n = np.ones(40)
    table, _, decay = T.token_scores(5000 * n, n, n)
    assert table.mean() < 0 and 1e-6 < decay < 1e4


def test_numbering_changes_no_score(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = T.fit(docs, labels, F.lit(True))
    turned = lambda df: df.withColumn("doc_id", 10**6 - 7 * F.col("doc_id"))
    other = T.fit(turned(docs).repartition(5, "source"), turned(labels), F.lit(True))
    assert (plain.tokens == other.tokens).all() and (plain.scores == other.scores).all()
    assert (plain.bias, plain.slope, plain.k, plain.decay) == (other.bias, other.slope, other.k, other.decay)


def test_tokens_beyond_the_bound_cost_the_drift(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(T, "TOKENS", 500)
    model = T.fit(docs, labels, F.lit(True))
    assert len(model.tokens) == 500 == len(model.scores)


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = T.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    kept = T.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < T.THRESHOLD for r in got)


def test_recall_and_precision_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    both = sum(r.toxic == r.predicted == 1 for r in held)
    assert both / sum(r.toxic for r in held) > 0.85 and both / sum(r.predicted for r in held) > 0.97
