"""Language identification by hyperdimensional profiles.

Every letter, and the blank between words, has a random vector of DIMENSIONS signs that follows from its code point alone. A
run of three is bound into one vector: the product of the first letter's vector turned by two places, the second's by one and
the third's. A text is the bundle (sum) of the vectors of all its runs, a language's prototype that of its training texts, each
counted once in proportion to the root of its length. A text has the language whose prototype has the largest cosine with it,
after the languages' common mean is taken from both.

Letters are those of Unicode, lower-cased by one character; everything else is a blank, several are one, and a text begins and
ends with one. Runs are counted first: a block of texts is a dense matrix of counts times the runs' vectors, whose entries
are whole numbers below 2^24, so that single precision is exact and results don't depend on how rows are dealt to tasks.

Prototypes are fitted on SAMPLE training texts of each language at most (distinct ones, least in the order of the text's
hash); every row is scored over its whole text. Tasks get one prototype of DIMENSIONS numbers for each language,
LANGUAGES of them at most; more are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_mapped, mix64, slices

DIMENSIONS, GRAM = 2048, 3
#: Documented bounds of the fit: training texts of a language, and languages.
SAMPLE, LANGUAGES = 4000, 4096
#: Texts of a block, entries of its dense matrix of counts, runs bound at once, and characters read at once.
BLOCK, CELLS, BOUND, PIECE = 256, 1 << 22, 4096, 1 << 20
#: Entries of a table of all runs of a block's letters.
DENSE = 1 << 22
UNKNOWN = "und"
_BLANK = 0x20


@dataclass
class Profiles:
    languages: list[str]
    #: Unit vectors, one row a language, and the mean that was taken from them before.
    rows: np.ndarray
    mean: np.ndarray


class Letters:
    """What a code point counts as: its letter's lower case, or a blank."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            table = np.full(0x110000, _BLANK, np.uint32)
            for c in range(0x110000):
                if chr(c).isalpha():
                    low = chr(c).lower()
                    table[c] = ord(low) if len(low) == 1 else c
            cls.table = table
        return cls.table


def folded(text: str) -> np.ndarray:
    """The letters and blanks of a piece of text, one for each character."""
    return Letters.get()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def squeezed(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes and their owners with several blanks in a row of one owner as one."""
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK) | (owner[1:] != owner[:-1])
    return codes[first], owner[first]


def runs(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of GRAM letters in ascending order as one number each, the place of every run among them, and its owner."""
    whole = owner[2:] == owner[:-2]
    here = np.zeros(0x110000, bool)
    here[codes] = True
    letters = np.flatnonzero(here)
    n = len(letters)
    if n**3 > DENSE:
        wide = codes.astype(np.int64)
        grams, place = np.unique(((wide[:-2] << 42) | (wide[1:-1] << 21) | wide[2:])[whole], return_inverse=True)
        return grams, place, owner[2:][whole]
    # few letters: a table of all their runs instead of a sort
    small = np.zeros(0x110000, np.int32)
    small[letters] = np.arange(n)
    c = small[codes]
    key = ((c[:-2] * n + c[1:-1]) * n + c[2:])[whole]
    found = np.zeros(n**3, bool)
    found[key] = True
    at = np.flatnonzero(found)
    grams = (letters[at // (n * n)] << 42) | (letters[at // n % n] << 21) | letters[at % n]
    return grams, (np.cumsum(found) - 1)[key], owner[2:][whole]


def vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of distinct runs."""
    letters = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF])
    distinct, place = np.unique(letters, return_inverse=True)
    seeds = mix64(distinct.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(DIMENSIONS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    signs = 1 - 2 * np.unpackbits(mix64(mix64(seeds)).view(np.uint8), axis=1).astype(np.int8)
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for i, p in enumerate(place.reshape(GRAM, -1)):
        out *= np.roll(signs, GRAM - 1 - i, axis=1)[p]
    return out


def _summed(owner: np.ndarray, n: int, grams: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
    """Add the runs grams[place] of n owners to the rows of out."""
    for a in range(0, len(grams), BOUND):
        some = (place >= a) & (place < a + BOUND) if len(grams) > BOUND else slice(None)
        here = grams[a : a + BOUND]
        counts = np.bincount(owner[some] * len(here) + place[some] - a, minlength=n * len(here)).reshape(n, len(here))
        out += counts.astype(np.float32) @ vectors(here).astype(np.float32)


def _block(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bundles of n texts of squeezed codes; halves of them where their runs have too little in common."""
    grams, place, owners = runs(codes, owner)
    out = np.zeros((n, DIMENSIONS), np.float32)
    if n == 1 or n * len(grams) <= CELLS:
        _summed(owners, n, grams, place, out)
        return out
    half = n // 2
    low = owner < half
    return np.concatenate([_block(codes[low], owner[low], half), _block(codes[~low], owner[~low] - half, n - half)])


def _long(text: str) -> np.ndarray:
    """The bundle of a long text, read PIECE characters at a time."""
    total, carry = np.zeros((1, DIMENSIONS)), np.array([_BLANK], np.uint32)
    for a in range(0, len(text), PIECE):
        codes = np.concatenate([carry, folded(text[a : a + PIECE]), np.array([_BLANK] * (a + PIECE >= len(text)), np.uint32)])
        codes, owner = squeezed(codes, np.zeros(len(codes), np.int64))
        total += _block(codes, owner, 1)
        carry = codes[1 - GRAM :]
    return total


def bundles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, vectors) of blocks of texts. A text without letters is all zeros."""
    at = 0
    while at < len(texts):
        if len(texts[at] or "") > PIECE:
            yield at, _long(texts[at])
            at += 1
            continue
        n, size = 0, 0
        while at + n < len(texts) and n < BLOCK and size + len(texts[at + n] or "") <= PIECE:
            size += len(texts[at + n] or "")
            n += 1
        parts = [np.concatenate([[_BLANK], folded(t or ""), [_BLANK]]).astype(np.uint32) for t in texts[at : at + n]]
        owner = np.repeat(np.arange(n), [len(p) for p in parts])
        yield at, _block(*squeezed(np.concatenate(parts), owner), n)
        at += n


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, sum): prototypes of each batch's languages in whole numbers, a text's vector brought to the root of its length."""
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").dictionary_encode()
            code, sums = langs.indices.to_numpy(), np.zeros((len(langs.dictionary), DIMENSIONS), np.int64)
            texts = part.column("text").to_pylist()
            for at, x in bundles(texts):
                root = np.sqrt([len(t) + 1.0 for t in texts[at : at + len(x)]])[:, None]
                np.add.at(sums, code[at : at + len(x)], np.rint(1000 * _units(x.astype(np.float64)) * root).astype(np.int64))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(np.repeat(np.arange(len(sums)), DIMENSIONS))), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(sums))), pa.array(sums.reshape(-1))], ["lang", "place", "sum"])


def fit(docs: DataFrame, usable: Column) -> Profiles:
    """Prototypes from docs(text, lang) where `usable` holds; nothing but texts and languages is used.

    Null languages, null texts and texts without letters teach nothing; a text repeated within a language teaches once.
    """
    space = Workspace(docs.sparkSession)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # hashes first, so that only the sample's texts travel
    least = space.keep(rows.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= SAMPLE).select("lang", "h"))
    if least.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: their prototypes are too large to send to every task")
    train = rows.join(least, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    summed = arrow_mapped(train, _bundled, "lang string, place int, sum long").groupBy("lang", "place").agg(F.sum("sum").alias("sum"))
    # LANGUAGES * DIMENSIONS numbers at most
    got = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "sum")))["sum"].alias("sums")).orderBy("lang").toArrow()
    sums = np.array(got["sums"].to_pylist(), np.float64).reshape(-1, DIMENSIONS)
    taught = sums.any(1)
    units = _units(sums[taught])
    mean = units.mean(0) if taught.sum() > 1 else np.zeros(DIMENSIONS)
    return Profiles([x for x, t in zip(got["lang"].to_pylist(), taught, strict=True) if t], _units(units - mean), mean)


def judged(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the first of equally near languages in the order of their names."""
    languages, scores = [], np.zeros(len(texts))
    for at, x in bundles(texts):
        if not profiles.languages:
            languages += [UNKNOWN] * len(x)
            continue
        unit = _units(x.astype(np.float64))
        known = unit.any(1)
        near = np.round(_units(unit - profiles.mean) @ profiles.rows.T, 9)
        best = near.argmax(1)
        languages += [profiles.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        scores[at : at + len(x)] = np.where(known, (1 + near[np.arange(len(x)), best]) / 2, 0.0)
    return languages, np.clip(scores, 0.0, 1.0)


def _judged(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                languages, scores = judged(part.column("text").to_pylist(), profiles)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs(doc_id, text)."""
    return arrow_mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _judged(profiles), "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, usable: Column, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang), learnt from the rows that are usable.

    lang_pred is `und` with score 0 for null texts, texts without a letter, and where nothing can be learnt; score is the cosine
    brought to 0..1. Repeated rows are judged each and equally, null ids as all others, very long texts are read whole, other
    columns are ignored, an empty table gives no rows.
    """
    return predict(docs, fit(docs, usable)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
