"""Toxicity by maximum-scoring segments.

Fitting: a token's score is its log-odds between toxic and clean training documents under a Dirichlet prior (an even part
plus one in proportion to the token's frequency), brought ERRORS standard errors nearer to zero, less a drift. Clean
evidence is negative and counts as much as toxic evidence; tokens never seen cost the drift. Tokens are counted
once a document, and a three-word context only in one document that has it, so that copies do not vote twice. A document's
identity is the hash of its text: how documents are numbered changes nothing. Scores are looked up by a token's whole 64-bit hash.
Scoring: one linear scan finds all maximal scoring segments of a document. With random clean tokens the segments
above a score s would number K * n * exp(-decay * s); decay comes from the clean tokens' scores, K from clean training
documents, and a segment is significant as far as its score goes beyond that. The summed significance of a document is mapped to
0..1 by a logistic curve.

The classifier is fitted on SAMPLE labelled texts at most (those whose hash is least) and keeps the TOKENS tokens of the most of them;
every row is scored over its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_mapped, mix64, named, positional, slices, word_hashes, words

#: Documented bounds of the fit: labelled texts, and tokens that have a score of their own.
SAMPLE, TOKENS = 8000, 1 << 20
EVEN, BY_FREQUENCY = 0.5, 100.0
ERRORS, DRIFT, MARGIN = 1.5, 1.0, 0.05
THRESHOLD = 0.7
_EDGE = ".,;:!?\"'()[]{}<>*#%&$@^~|/\\-_+=`«»¿¡…“”‘’"


@dataclass
class Model:
    #: Hashes of the fitted tokens in ascending order and their scores; empty if nothing is learnt.
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: What every other token costs.
    drift: float = DRIFT
    decay: float = 1.0
    k: float = 1.0
    bias: float = math.log(0.1 / 0.9)
    slope: float = 0.0


def segments(score: np.ndarray) -> list[float]:
    """Scores of all maximal scoring segments of a run of scores, in one scan over the positive ones."""
    at = np.flatnonzero(score > 0)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    found: list[list[float]] = []  # [sum before, sum after] of candidate segments
    links: list[int] = []  # the candidate before with a smaller sum before
    for left, right in zip(sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = links[j]
            if j < 0 or found[j][1] >= right:
                found.append([left, right])
                links.append(j)
                break
            left = found[j][0]
            del found[j:], links[j:]
    return [b - a for a, b in found]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token number at each place, the hash of each token (0 if it has no letter or digit), the tokens of each text."""
    codes, distinct, counts = words(texts)
    names = pc.utf8_trim(distinct, _EDGE)
    return codes, np.where(pc.equal(names, "").to_numpy(zero_copy_only=False), np.uint64(0), word_hashes(names)), counts


def scores_of(hashes: np.ndarray, model: Model) -> np.ndarray:
    """The score of each token."""
    at = np.minimum(np.searchsorted(model.tokens, hashes), len(model.tokens) - 1)
    return np.where(model.tokens[at] == hashes, model.scores[at], -model.drift)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            codes, hashes, counts = _tokens(part.column("text"))
            if not len(codes):
                continue
            h, ends = hashes[codes], np.cumsum(counts)[counts > 0]
            left, right = np.roll(h, 1), np.roll(h, -1)
            left[ends - counts[counts > 0]], right[ends - 1] = np.uint64(1), np.uint64(1)
            around = (mix64(left + np.uint64(7)) ^ right).view(np.int64)
            toxic = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int8), counts)
            doc = np.repeat(part.column("h").to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(around), pa.array(toxic), pa.array(doc)], ["token", "around", "toxic", "h"])


def evidence(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[float]]]:
    """Number of tokens and the maximal segments of each text."""
    codes, hashes, counts = _tokens(texts)
    if not len(model.scores):
        return counts, [[] for _ in counts]
    scored = scores_of(hashes, model)[codes]
    ends = np.cumsum(counts)
    return counts, [segments(scored[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def beyond(n: int, found: list[float], model: Model) -> list[float]:
    """How far each significant segment goes beyond what n random tokens would have."""
    random = max(math.log(max(model.k * n, 1e-9)), 0.0) if n else 0.0
    return [x for x in (model.decay * s - random for s in found) if x > 0]


def significance(n: int, found: list[float], model: Model) -> float:
    return math.log1p(sum(beyond(n, found, model)))


def _above(model: Model, least: float):
    """Tokens of each text, and its segments of the score `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, found = evidence(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array([sum(x >= least for x in f) for f in found], pa.int64())], ["n", "above"])

    return run


def _training(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, found = evidence(part.column("text"), model)
                x = [significance(int(c), f, model) for c, f in zip(n, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x, pa.float64())], ["toxic", "x"])

    return run


def token_scores(a: np.ndarray, b: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Scores of tokens seen in a toxic and b clean texts and at `uses` clean places, the drift in them, and their decay."""
    prior = EVEN + BY_FREQUENCY * (a + b) / (a.sum() + b.sum())
    odds = np.log((a + prior) / (a.sum() + BY_FREQUENCY - a)) - np.log((b + prior) / (b.sum() + BY_FREQUENCY - b))
    error = np.sqrt(1 / (a + prior) + 1 / (b + prior))
    nearer = np.sign(odds) * np.maximum(np.abs(odds) - ERRORS * error, 0.0)
    p = uses / max(uses.sum(), 1.0)
    # the mean of clean tokens must be negative, or segments would grow with the text
    drift = max(DRIFT, float((p * nearer).sum()) + MARGIN)
    return nearer - drift, drift, _decay(p, nearer - drift)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from labels(doc_id, toxic) where `usable` holds for the doc_id. Nothing but texts and labels is used.

    Null labels and unlabelled texts are left out, an id labelled both ways is toxic, a text that is both under different ids
    teaches nothing; without both classes every score is the base rate.
    """
    space = Workspace(docs.sparkSession)
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"))
    # hashes alone travel; SAMPLE rows of two numbers at most are left
    least = space.keep(rows.join(marks, "doc_id").select("h", "toxic").distinct().orderBy("h", "toxic").limit(SAMPLE))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(least.select("h").distinct()), "h")
    train = space.keep(texts.groupBy("h").agg(F.min("text").alias("text")).join(F.broadcast(least), "h"))
    seen = arrow_mapped(train, _contexts, "token long, around long, toxic byte, h long").where(F.col("token") != 0)
    first = seen.groupBy("token", "around").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"), F.min("h").alias("h")).where("toxic = most")
    held = first.groupBy("token", "h", "toxic").agg(F.count("*").alias("n"))
    toxic = F.col("toxic").cast("long")
    counts = held.groupBy("token").agg(F.sum(toxic).alias("a"), F.sum(1 - toxic).alias("b"), F.sum((1 - toxic) * F.col("n")).alias("uses"))
    # TOKENS rows of four numbers at most
    table = counts.orderBy(F.desc(F.col("a") + F.col("b")), "token").limit(TOKENS).toArrow()
    a, b, uses = (table[c].to_numpy().astype(np.float64) for c in ("a", "b", "uses"))
    model = Model()
    if not a.sum() or not b.sum():
        return model
    scores, drift, decay = token_scores(a, b, uses)
    if not (scores > 0).any():
        return model
    tokens = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    model.tokens, model.scores, model.drift, model.decay = tokens[order], scores[order], drift, decay
    least = math.log(10) / model.decay
    clean = arrow_mapped(train.where("toxic = 0").select("text"), _above(model, least), "n long, above long").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).first()
    model.k = max(clean.above or 0, 0.5) / max(clean.n or 0, 1) * math.exp(model.decay * least)
    got = arrow_mapped(train.select("toxic", "text"), _training(model), "toxic int, x double").toArrow()  # SAMPLE rows at most
    order = np.lexsort([got["x"].to_numpy(), got["toxic"].to_numpy()])
    model.bias, model.slope = _logistic(got["x"].to_numpy()[order], got["toxic"].to_numpy()[order])
    return model


def _decay(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1, for scores of a negative mean; large if none of positive p is positive."""

    def f(x: float) -> float:
        return float((p * np.exp(np.minimum(x * s, 500))).sum()) - 1

    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope, by Newton's method with a slight ridge; the slope is not negative."""
    w, a = np.zeros(2), np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, found = evidence(part.column("text"), model)
                over = [beyond(int(c), f, model) for c, f in zip(n, found, strict=True)]
                z = np.array([model.bias + model.slope * math.log1p(sum(x)) for x in over])
                score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(np.array([len(x) for x in over], np.int32))], ["doc_id", "score", "n_segments"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_segments) of every row of docs(doc_id, text); null and empty texts get the base score.

    n_segments counts the significant segments only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_mapped(rows, _scored(model), "doc_id long, score double, n_segments int")


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_segments) of every row of docs(doc_id, text).

    Labels are learnt only from rows whose remainder by 3 is not 1; predicted is 1 from a score of 0.7 on. Repeated
    rows are returned as they come, a null id is not held out, null and empty texts get the base score, very long texts are read
    whole, other columns are ignored, an empty table gives no rows.
    """
    model = fit(docs, labels, remainder("doc_id", 3) != 1)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_segments")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those scored THRESHOLD or more; each row is judged by its own whole text.

    Columns are kept with their values whatever their names. Null and empty texts get the base score and stay, null ids and
    repeated rows are judged as all others, an empty table gives no rows.
    """
    model = fit(docs, labels, remainder("doc_id", 3) != 1)
    plain, names = positional(docs)
    return named(arrow_mapped(plain, _filtered(model, names["text"]), plain.schema), names)


def _filtered(model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                n, found = evidence(part.column(text), model)
                z = [model.bias + model.slope * significance(int(c), f, model) for c, f in zip(n, found, strict=True)]
                yield part.filter(pa.array([x < math.log(THRESHOLD / (1 - THRESHOLD)) for x in z], pa.bool_()))

    return run
