"""What the operators share: written intermediate tables, Arrow batches, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text an Arrow mapper handles at once, so that memory follows this and not the batch.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch at most; texts of some KB each make the usual 10,000 take tens of MB in each task and worker.
BATCH_ROWS = 2000
#: ASCII white space of the word definition used across the operators.
SPACE = r"[\x20\x09-\x0D]+"

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class Workspace:
    """Tables written below the shared checkpoint folder; executors may be lost without losing them.

    The folder goes when the session's JVM ends, or table by table with drop().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="checkpoints-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        files, path = self._files(self.root)
        files.deleteOnExit(path)
        self._n = 0

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back: lineage is cut and statistics are exact."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        out._workspace = self
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of keep() that no later step reads."""
        for t in tables:
            files, path = self._files(t._kept_at)
            files.delete(path, True)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed c0, c1, ... by place, and the new name of each old one; names then clash with nothing."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of positional() under their old names again; others go."""
    return df.select(*names.values()).toDF(*names)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def arrow_mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema) over batches of BATCH_ROWS rows at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df.mapInArrow(function, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the distinct words, and the number of words of each text.

    A-Z are lower-cased and words are runs outside [\\x20\\x09-\\x0D]; null has no words.
    """
    # a copy that starts at its buffer's start: ascii_lower reads slices of large strings wrongly
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        counts, flat = np.bincount(owner, minlength=len(counts)), flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts.astype(np.int64)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; fewer words make one shingle, none make none."""
    codes, distinct, counts = words(texts)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(h) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        rolled = mix64(rolled * _GOLD + h[i : i + len(rolled)] + np.uint64(i + 1))
    out, at = [], 0
    for c in counts:
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            whole = np.array([c], np.uint64)
            for i in range(at, at + int(c)):
                whole = mix64(whole * _GOLD + h[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += int(c)
    return out


def components(links: DataFrame, space: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph: the smallest node reachable. Empty links give no rows.

    Alternating large and small stars: every round points a node's larger neighbours, then its
    smaller ones, at the least of them, until the edges no longer change. No node's neighbours meet in one task.
    """
    e = space.keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        mark = e.agg(F.count("*"), F.expr("coalesce(sum(cast(pmod(xxhash64(u, v), 1000000007) as decimal(38,0))), 0)")).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = space.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = space.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least2 = space.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = space.keep(moved.unionByName(least2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        space.drop(e, least, large, least2)
        e = nxt
    leaves = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return space.keep(leaves.unionByName(roots))
