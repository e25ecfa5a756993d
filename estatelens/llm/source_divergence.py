"""Source divergence audit over integer dictionaries.

How far the sources of a language lie apart, and which terms set a source off from its language. Terms are runs of
letters (A-Z, a-z and all that is not ASCII), only A-Z lower-cased; a language keeps the terms of MIN_DOCS of its documents.
A kept term's share in a group (a language's source, or the whole language) is 1 + floor(SCALE * (count + SMOOTH) /
(total + SMOOTH * kept terms)), all in whole numbers.

Texts are cut once: every task sums (language, source, term) over its slices before the shuffle, with the documents that hold
the term. The kept terms of a language are dealt by hash into chunks of about CHUNK. A chunk is an integer dictionary: its sorted terms,
whose places are their ids (searchsorted), so that ids follow the order of UTF-8 and settle ties; one bincount gives a dense
matrix of counts, a row for each source. A chunk yields part of each pair's distance and the TOP terms of each source that it
can have among the TOP of all; partial distances are summed and tops ranked afterwards. So neither a language's vocabulary nor
a source's terms meet in one task; memory follows CHUNK times the number of a language's sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_mapped, slices, words

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 10**9, 50
#: Kept terms of a chunk, about: they are dealt by hash.
CHUNK = 1024

#: Letters stay (capitals as small ones), bytes above ASCII stay, all else is a blank.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def terms(texts: pa.Array) -> pa.Array:
    """The texts with everything that is no part of a term as blanks; null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    _, offsets, data = texts.buffers()
    mapped = _BYTES[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(mapped))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df): occurrences and documents, summed within each slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            codes, distinct, counts = words(terms(part.column("text")))
            if not len(codes):
                continue
            langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            held, n = np.unique(np.repeat(np.arange(len(counts)), counts) * len(distinct) + codes, return_counts=True)
            key, place, df = np.unique(group[held // len(distinct)] * len(distinct) + held % len(distinct), return_inverse=True, return_counts=True)
            lang, source = np.divmod(key // len(distinct), len(sources.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(lang)),
                    sources.dictionary.take(pa.array(source)),
                    distinct.take(pa.array(key % len(distinct))).cast(pa.string()),
                    pa.array(np.bincount(place, n, len(key)).astype(np.int64)),
                    pa.array(df),
                ],
                ["lang", "source", "term", "n", "df"],
            )


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total), by long division in thousands so that nothing exceeds 64 bits (totals below 9e15)."""
    whole, rest = np.divmod(counts, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _compared(key: tuple, groups: pa.Table, held: pa.Table) -> pa.Table:
    """(lang, part, source, item, value) of a chunk from its language's groups(source, total, kept) and its held(source, term, n)."""
    order = np.argsort(names := np.array(groups["source"].to_pylist(), object))
    names, total, kept = names[order], groups["total"].to_numpy()[order], groups["kept"].to_numpy()[0]
    term = np.array(held["term"].to_pylist(), object)
    dictionary = np.unique(term)
    ids = np.searchsorted(dictionary, term)
    rows = np.searchsorted(names, np.array(held["source"].to_pylist(), object))
    size = len(dictionary)
    # each (source, term) is one row, so that no sum is rounded
    counts = np.bincount(rows * size + ids, held["n"].to_numpy(), len(names) * size).astype(np.int64).reshape(len(names), size)
    p = shares(counts + SMOOTH, (total + SMOOTH * kept)[:, None])
    q = shares(counts.sum(0) + SMOOTH, total.sum() + SMOOTH * kept)
    part, source, item, value = [], [], [], []
    for i in range(len(names)):
        apart = np.abs(p[i + 1 :] - p[i]).sum(1)
        above = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        top = above[np.lexsort([above, (q - p[i])[above]])[:TOP]]
        part += ["pair"] * len(apart) + ["term"] * len(top)
        source += [names[i]] * (len(apart) + len(top))
        item += [*names[i + 1 :], *dictionary[top]]
        value += [*apart.tolist(), *(p[i] - q)[top].tolist()]
    lang = pa.array([key[0].as_py()] * len(part), pa.string())
    return pa.table([lang, pa.array(part, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "part", "source", "item", "value"])


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source).

    Part `pair`: each other source of the language by the summed distance of all kept terms' shares, 0 if none is kept; part
    `term`: the TOP kept terms that the group has and whose share is above the language's, by the difference. Ranks go by
    falling value and rising item (UTF-8).
    Null texts, languages and sources are read as empty; every row is a document, repeated ones too; very long texts are read
    whole and a document without terms still makes its group occur; other columns are ignored; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = arrow_mapped(rows, _counted, "lang string, source string, term string, n long, df long")
    counted = space.keep(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    often = counted.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= MIN_DOCS)
    held = space.keep(counted.join(often.select("lang", "term"), ["lang", "term"]).drop("df"))
    kept = held.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    kept = kept.withColumn("chunks", F.expr(f"(kept + {CHUNK - 1}) div {CHUNK}"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("docs")).join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = space.keep(groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "kept", "chunks"))
    heads = groups.where("chunks > 0").select("lang", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), "source", "total", "kept")
    dealt = held.join(kept.select("lang", "chunks"), "lang").select("lang", F.expr("pmod(xxhash64(term), chunks)").alias("chunk"), "source", "term", "n")
    compared = heads.groupBy("lang", "chunk").cogroup(dealt.groupBy("lang", "chunk")).applyInArrow(_compared, "lang string, part string, source string, item string, value long")
    compared = space.keep(compared)
    apart = compared.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    own = compared.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(own.withColumn("rank", rank).where(F.col("rank") <= TOP))
