"""Exact deduplication by deterministic block naming.

Texts are normalised and cut into blocks of BLOCK characters. The distinct blocks are sorted and numbered; the numbers of
adjacent blocks are paired, distinct pairs are sorted and numbered again, and so on until every document has
one number. Numbers come from sorting the blocks and pairs themselves, so that two documents end on the same level
with the same number exactly if their texts are equal. An odd last number is paired with a mark of its own.

Blocks travel once, as the keys of an aggregation that drops repeats before the shuffle. Documents meet their blocks'
numbers by two 64-bit hashes, once it is sure that no two distinct blocks share both; if two did, other seeds are taken.
Only DataFrame operations are used, and no group of equal blocks, pairs or texts meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, named, positional

BLOCK = 512
#: Stands for the missing right neighbour of an odd last number.
NONE = -1


def normalised(text: str | Column) -> Column:
    """Each run of white space as one blank; null as empty."""
    return F.coalesce(F.regexp_replace(text, SPACE, " "), F.lit(""))


def _blocks(norm: str) -> Column:
    """The blocks of a text, in time linear in its length; an empty text is one empty block."""
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(cut)


def _hashes(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias("h"), F.xxhash64(F.lit(seed + 1), block).alias("i")]


def _sorted_names(distinct: DataFrame, *by: str) -> DataFrame:
    """distinct with `name`: its part of the distinct rows, then its place in the sorted part."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(norm: DataFrame, space: Workspace) -> tuple[DataFrame, int]:
    """(h, i, name) of each distinct block, and the seed whose hashes tell all of them apart."""
    distinct = norm.select(F.explode(_blocks("norm")).alias("block")).distinct()
    seed = 0
    while True:
        names = space.keep(_sorted_names(distinct, "block").select(*_hashes(F.col("block"), seed), "name"))
        if names.groupBy("h", "i").agg(F.count("*").alias("blocks")).where("blocks > 1").isEmpty():
            return names, seed
        space.drop(names)
        seed += 2


def identities(docs: DataFrame, space: Workspace) -> DataFrame:
    """The rows of docs(norm, ...) with (level, name) in place of norm: equal for equal texts and for no others."""
    names, seed = _block_names(docs, space)
    hashes = F.transform(_blocks("norm"), lambda b: F.struct(*_hashes(b, seed)))
    rows = space.keep(docs.select("*", F.monotonically_increasing_id().alias("row"), hashes.alias("hashes")).drop("norm"))
    now = rows.select("row", F.size("hashes").alias("left"), F.posexplode("hashes").alias("pos", "at"))
    # what joins here grows with the corpus: it is never broadcast, and plain exchanges let a hot block be split
    now = now.join(names.hint("merge"), [now["at.h"] == names["h"], now["at.i"] == names["i"]]).select("row", "left", "pos", "name")
    most = rows.agg(F.max(F.size("hashes"))).first()[0] or 1
    level, done = 0, []
    while True:
        now = space.keep(now)
        done.append(now.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
        if most == 1:
            break
        even = F.col("pos") % 2 == 0
        right = F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("r")
        pairs = now.where("left > 1").groupBy("row", F.expr("(left + 1) div 2").alias("left"), F.expr("pos div 2").alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("l"), right)
        pairs = space.keep(pairs)
        names = space.keep(_sorted_names(pairs.select("l", "r").distinct(), "l", "r"))
        now = pairs.join(names.hint("merge"), ["l", "r"]).select("row", "left", "pos", "name")
        most, level = (most + 1) // 2, level + 1
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return rows.drop("hashes").join(found.hint("merge"), "row").drop("row")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs(doc_id, text).

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] has become one blank; null counts as empty.
    keep_id is the least doc_id of the group (null ids last, so that it is null only if all are), group_size its
    rows; kept tells whether doc_id is keep_id. Rows repeated with the same doc_id and text get the same
    answer and each counts in group_size; one doc_id with several texts is judged text by text. Very long texts have more
    blocks and take more levels. An empty table gives no rows and other columns are ignored.
    """
    space = Workspace(docs.sparkSession)
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("norm"))
    rows = space.keep(identities(norm.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)), space))
    groups = space.keep(rows.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    out = rows.join(groups.hint("merge"), ["level", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the least doc_id; texts stay as they are.

    Columns are kept with their values whatever their names. Null ids come last and null texts count as empty; of rows
    repeated with one doc_id and text one stays; an empty table gives no rows.
    """
    gone = exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone"), F.col("text_sha256").alias("gone_sha")).distinct()
    gone = Workspace(docs.sparkSession).keep(gone)
    plain, names = positional(docs)
    doc_id = names["doc_id"]
    marked = plain.withColumn("sha", F.sha2(normalised(names["text"]).cast("binary"), 256))
    rest = marked.join(gone, F.col(doc_id).eqNullSafe(F.col("gone")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    if not rest.groupBy(doc_id, "sha").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rest = rest.dropDuplicates([doc_id, "sha"])
    return named(rest, names)
