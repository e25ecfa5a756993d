"""Sharding by jump consistent hashing.

The key of a row is its doc_id. The jump sequence of a key depends on the key alone, so that its shard for n + 1
shards is its shard for n or the new one, and about 1 in n + 1 keys move. No ring table is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Multiplier of the jump generator; a fixed value.
STEP = np.uint64(2862933555777941757)
#: Parts a shard is numbered in, or more where one would have over PART_ROWS rows; slots need no task that holds a whole shard.
PARTS, PART_ROWS = 64, 200_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    key, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    nxt = np.zeros(len(keys), np.int64)
    while (live := nxt < shards).any():
        at = np.where(live, nxt, at)
        key = key * STEP + np.uint64(1)
        to = ((at + 1) * ((1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        nxt = np.where(live, to, nxt)
    return at


def _placed(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(jump(keys, shards).astype(np.int32)), pa.array(jump(keys, shards + 1).astype(np.int32))], [*b.schema.names, "shard", "grown_shard"])

    return run


def shards(docs: DataFrame, n: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs(doc_id, text).

    size is the text's UTF-8 bytes plus 1 and text_crc32 its unsigned CRC-32; null counts as an empty text.
    law is always "key": doc_id and n decide the shard, equal ids (repeated rows) share it, a null id has
    key 0. slot numbers each shard's rows from 0 without gaps, in the order of (part, doc_id, text_crc32, size),
    the part being a hash of those; equal rows take their slots in any order. Other columns are ignored; an empty
    table gives no rows.
    """
    space = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sized.mapInArrow(_placed(n), "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    placed = space.keep(placed)
    parts = max(PARTS, placed.count() // (n * PART_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    # n * PARTS rows, or one for PART_ROWS rows of the table
    filled = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = filled.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    out = placed.withColumn("own", F.row_number().over(order)).join(F.broadcast(start), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("own") - 1).alias("slot"), "grown_shard")
