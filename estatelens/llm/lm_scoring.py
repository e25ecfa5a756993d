"""Language-model scoring by prediction by partial matching.

A document is read as one running text: its words, each followed by a blank, and the end. Every byte is predicted from up
to ORDER bytes before it, across blanks, whatever words they belong to. A context that has not seen the byte
escapes to the next shorter one with probability d / 2n (estimation D), d and n being the distinct and all bytes it has seen,
without those the longer context has ruled out already (symbol exclusion); a byte seen c times has (2c - 1) / 2n. Below the empty context all other bytes are
alike. The trie is pretrained on the training documents and grows with them; it is a table of (context, byte) counts for
each order, and a node of it, a context with its 256 bytes at most, is the largest group there is.

Each distinct (context, byte) of the corpus is coded once: at the highest order if training has it, else order by order
with the nodes that it escapes to. Frequent ones (FREQUENT_KEYS at most) and frequent words (FREQUENT_WORDS at most, for
the base score) go to every task; all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_mapped, slices, words

ORDER = 5
#: The end of a document, as a token; no word can be a line feed.
END = "\n"
#: Words and keys that go to every task; distinct keys that a task gathers before it hands them on.
FREQUENT_WORDS, FREQUENT_KEYS, GATHERED = 60_000, 500_000, 2_000_000
_BYTES = 256
#: A-Z lower-cased and white space as blanks.
_PLAIN = np.array([32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(_BYTES)], np.uint8)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            codes, distinct, counts = words(part.column("text"))
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            own = np.repeat(train, counts)
            names = pa.concat_arrays([distinct.cast(pa.string()), pa.array([END])])
            seen = np.append(np.bincount(codes[own], minlength=len(distinct)), train.sum())
            full = np.append(np.bincount(codes, minlength=len(distinct)), len(counts))
            yield pa.RecordBatch.from_arrays([names, pa.array(seen.astype(np.int64)), pa.array(full.astype(np.int64))], ["word", "c", "uses"])


def running_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of every byte of the texts as running text, and each text's first and last place.

    A text is a blank, its words with a blank after each, and END; its first blank is context only. A key's low byte
    is the byte itself, the next ones are those before it in the text, nearest first, and zero before its start.
    """
    data = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    flat = _PLAIN[np.frombuffer(b" " + b"   ".join(data) + b"  ", np.uint8)]
    last = np.cumsum(np.fromiter((len(x) for x in data), np.int64, len(data)) + 3) - 1
    flat[last] = ord(END)
    blank = flat == 32
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    gone = np.cumsum(~keep)
    last = last - gone[last]
    first = np.concatenate([[0], last[:-1] + 1])
    flat = flat[keep].astype(np.uint64)
    key = flat.copy()
    for o in range(1, ORDER + 1):
        key[o:] |= flat[: max(len(flat) - o, 0)] << np.uint64(8 * o)
    for i in range(ORDER):
        at = (first + i)[first + i <= last]
        key[at] &= np.uint64((1 << (8 * (i + 1))) - 1)
    return key.view(np.int64), first, last


def _gathered(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [(keys, *(np.bincount(inverse, weights=np.concatenate([p[i] for p in parts]), minlength=len(keys)).astype(np.int64) for i in (1, 2)))]


def _text_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of running text, how often training rows hold them and how often all do; a key can come more than once."""

    def out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(parts[0][0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in parts[0]], ["key", "n", "uses"])

    parts, held = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            train = part.column("train")
            for own in (train, pc.invert(train)):
                texts = part.column("text").filter(own)
                if len(texts):
                    key, first, _ = running_text(texts)
                    key[first] = -1
                    keys, uses = np.unique(key, return_counts=True)
                    keys, uses = keys[1:], uses[1:]
                    parts.append((keys, uses if own is train else np.zeros(len(keys), np.int64), uses))
                    held += len(keys)
            if held > 2 * GATHERED:
                parts = _gathered(parts)
                held = len(parts[0][0])
                if held > GATHERED:
                    yield from out(parts)
                    parts, held = [], 0
    if parts:
        yield from out(_gathered(parts))


def _low(column: str, size: int) -> Column:
    """The `size` lowest bytes of a key."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


def _coded(n: Column, total: Column, kinds: Column) -> Column:
    """log10 of the probability of a byte seen n times, or of the escape if n is 0, where `kinds` bytes were seen `total` times."""
    return F.when(n > 0, F.log10((2 * n - 1) / (2 * total))).when(kinds > 0, F.log10(kinds / (2 * total))).otherwise(0.0)


def code_lengths(counts: DataFrame, space: Workspace) -> DataFrame:
    """(key, uses, lp) of every row of counts(key, n, uses): log10 of the probability of the key's byte after its context.

    n is how often training has the key, and may be 0. No group here is larger than the 256 bytes of a node.
    """
    node = counts.groupBy(F.shiftright("key", 8).alias("context")).agg(F.collect_list(F.struct("key", "n", "uses")).alias("all"))
    node = node.select("all", F.expr("aggregate(all, 0L, (s, x) -> s + x.n)").alias("total"), F.expr("transform(filter(all, x -> x.n > 0), x -> cast(x.key & 255 as int))").alias("seen"))
    first = node.select("total", "seen", F.inline("all"))
    lp = _coded(F.col("n"), F.col("total"), F.size("seen"))
    coded = space.keep(first.select("key", "uses", "n", lp.alias("lp"), F.when(F.col("n") == 0, F.col("seen")).alias("seen")))
    done, level = [coded.where("n > 0")], counts.where("n > 0").select("key", "n")
    for order in range(ORDER - 1, -1, -1):
        level = space.keep(level.groupBy(_low("key", order + 1).alias("key")).agg(F.sum("n").alias("n")))
        nodes = level.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("all"), F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int").alias("byte"), "n")).alias("of"))
        # nodes of one byte of context or none: 65,536 counts at most
        nodes = F.broadcast(nodes) if order < 2 else nodes.hint("merge")
        left = coded.where("n = 0").select("key", "uses", "lp", "seen", F.shiftright(_low("key", order + 1), 8).alias("context"))
        met = left.join(nodes, "context", "left").withColumn("of", F.expr("coalesce(of, cast(array() as array<struct<byte:int,n:bigint>>))"))
        met = met.withColumn("n", F.expr("coalesce(get(filter(of, x -> x.byte = key & 255), 0).n, 0L)"))
        total = F.expr("coalesce(all, 0L) - aggregate(filter(of, x -> array_contains(seen, x.byte)), 0L, (s, x) -> s + x.n)")
        more = _coded(F.col("n"), total, F.size("of") - F.size("seen"))
        coded = space.keep(met.select("key", "uses", "n", (F.col("lp") + more).alias("lp"), F.expr("if(n = 0, transform(of, x -> x.byte), null)").alias("seen")))
        done.append(coded.where("n > 0"))
    out = coded.where("n = 0").select("key", "uses", (F.col("lp") - F.log10(F.greatest(_BYTES - F.size("seen"), F.lit(1)))).alias("lp"))
    for d in done:
        out = out.unionByName(d.select("key", "uses", "lp"))
    return out


def _texted(texts: pa.Array, keys: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sum of the code lengths of the frequent keys of each text, and its other keys."""
    key, first, last = running_text(texts)
    coded = pa.array(key).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
    i = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    known = keys[i] == distinct
    each, rare = np.where(known, lp[i], 0.0)[codes], ~known[codes]
    each[first], rare[first] = 0.0, False
    edges = np.concatenate([[0], np.cumsum(rare)])[np.append(first, last[-1] + 1)]
    return np.add.reduceat(each, first), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(key[rare]))


def _scored(frequent: pa.Array, c: np.ndarray, keys: np.ndarray, lp: np.ndarray):
    """Sums over each row's frequent words and keys, and its other words and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        logs = np.log10(c + 1.0)
        for batch in batches:
            for part in slices(batch, "text"):
                codes, distinct, counts = words(part.column("text"))
                i = pc.fill_null(pc.index_in(distinct.cast(pa.string()), value_set=frequent), -1).to_numpy(zero_copy_only=False)
                own = i[codes] if len(codes) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(counts)), counts)
                hot = own >= 0
                known, base = (np.bincount(doc[hot], weights=x[own[hot]], minlength=len(counts)).astype(np.float64) for x in (c > 0, logs))
                edges = np.concatenate([[0], np.cumsum(np.bincount(doc[~hot], minlength=len(counts)))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(edges), distinct.cast(pa.string()).take(pa.array(codes[~hot])))
                score, rare_keys = _texted(part.column("text"), keys, lp)
                rows = np.arange(row, row + len(counts))
                row += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column("doc_id"), pa.array(counts + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), rare, rare_keys],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "rare_keys"],
                )

    return run


def score_texts(docs: DataFrame, by: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs(doc_id, text).

    Rows whose crc32 of doc_id as text leaves `held` modulo `by` are held out; the others train. A-Z are lower-cased,
    tokens are words `[^\x20\x09-\x0D]+` and one end; score codes each whole row as one running text. Null and empty texts are one
    end; rows with a null id neither train nor are held out; repeated rows count and are returned as they come; very
    long texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % by
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(left != held, F.lit(False)).alias("train"))
    vocabulary = arrow_mapped(rows, _vocabulary, "word string, c long, uses long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))
    vocabulary = space.keep(vocabulary)
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    counts = arrow_mapped(rows, _text_contexts, "key long, n long, uses long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))
    counts = space.keep(counts)
    coded = space.keep(code_lengths(counts, space))
    # FREQUENT_KEYS rows of two numbers and FREQUENT_WORDS rows at most
    often = coded.orderBy(F.desc("uses"), "key").limit(FREQUENT_KEYS).select("key", "lp").toArrow().sort_by("key")
    keys, lp = often["key"].to_numpy(), often["lp"].to_numpy()
    if not len(keys):
        keys, lp = np.array([-1], np.int64), np.zeros(1)
    top = vocabulary.where(F.col("word") != END).orderBy(F.desc("uses"), "word").limit(FREQUENT_WORDS).toArrow()
    frequent, c = pa.array(top["word"].to_pylist(), pa.string()), top["c"].to_numpy()
    scored = arrow_mapped(rows.select("doc_id", "text"), _scored(frequent, c, keys, lp), "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<string>, rare_keys array<long>")
    scored = space.keep(scored)
    zero = F.lit(0.0)
    words_left = scored.select("row", F.explode("rare").alias("word")).join(vocabulary.select("word", "c"), "word")
    words_left = words_left.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum(F.log10(F.col("c") + 1.0)).alias("b"), F.sum(zero).alias("s"))
    keys_left = scored.select("row", F.explode("rare_keys").alias("key")).join(coded.select("key", "lp"), "key")
    keys_left = keys_left.groupBy("row").agg(F.sum(F.lit(0).cast("long")).alias("k"), F.sum(zero).alias("b"), F.sum("lp").alias("s"))
    others = words_left.unionByName(keys_left).groupBy("row").agg(*[F.sum(x).alias(x) for x in ("k", "b", "s")])
    out = scored.drop("rare", "rare_keys").join(others, "row", "left")
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % by == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0)) + (1 if size.ends else 0)).alias("n_known"),
        F.lit(int(size.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) + F.lit(math.log10(size.ends + 1)) - F.col("n_tokens") * F.lit(math.log10(size.n + size.v + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
