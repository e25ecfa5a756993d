"""MinHash near-duplicate detection with fast similarity sketches.

A document's set holds the hashes of its distinct word shingles. Its sketch has BINS coordinates
filled in rounds: in round i < BINS every element falls into one hashed bin, from round BINS on every
element goes to bin i - BINS, so no coordinate stays empty; an earlier round always wins a bin, and rounds
stop once all bins are full. Coordinates agree with probability equal to the Jaccard similarity and
concentrate as independent ones do. Bands of ROWS coordinates propose candidates, and every candidate is
confirmed on full shingle sets (64-bit shingle hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_mapped, components, mix64, named, positional, shingle_sets, slices

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 56) - 1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches, one row of BINS unsigned integers per non-empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * BINS, _FULL, np.uint64)
    open_ = sizes > 0
    for i in range(2 * BINS):
        g = mix64(h ^ mix64(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        b = (g >> np.uint64(57)).astype(np.int64) if i < BINS else np.full(len(h), i - BINS)
        np.minimum.at(out, owner * BINS + b, (np.uint64(i) << np.uint64(56)) | (g & _LOW))
        still = (out.reshape(-1, BINS) == _FULL).any(axis=1) & open_
        if not still.any():
            break
        if i < 8 or i % 16 == 0:
            keep = still[owner]
            h, owner = h[keep], owner[keep]
    return out.reshape(-1, BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sketch), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, r::ROWS][:, :BANDS])
    return key.view(np.int64)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                keys = band_keys(sketches(sets))
                name = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(name, pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_name", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "s"])

    return run


def _sharing_a_rare_shingle(reps: DataFrame, sets: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """(a, b) of reps(rep, c) in different components c that can reach the similarity, by their rarest shingles."""
    shingles = sets.join(reps, F.col("doc_id") == F.col("rep")).select("rep", "c", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = space.keep(shingles.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"))
    # shingles of one document alone are the rarest; the others follow by frequency
    shared = shingles.join(often, "x")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "x"))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("rep"))
    prefix = F.col("n") - F.expr(f"(n * {int(percent)} + 99) div 100") + 1
    heads = space.keep(shared.withColumn("place", place + alone).withColumn("prefix", prefix).where("place <= prefix").select("rep", "c", "x", "n", "place"))
    l, r = heads.alias("l"), heads.alias("r")
    # from the first shingle they share on, both must have enough left
    left = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place")) + 1
    enough = left * (100 + int(percent)) >= int(percent) * (F.col("l.n") + F.col("r.n"))
    pairs = l.join(r, (F.col("l.x") == F.col("r.x")) & (F.col("l.c") < F.col("r.c")) & enough)
    return pairs.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of k-word shingles.
    component_id is the smallest doc_id reachable over links. Null or blank texts have an empty set and no
    links; fewer than k words make one shingle; rows with one doc_id are one node (each row is returned);
    a null doc_id takes no part in links and has a null component; very long texts are read whole; an empty table gives an
    empty result.
    Columns besides doc_id and text are ignored.

    Documents with equal sets form classes whose least doc_id stands for them. In each bucket of a band
    one representative is the hub and all others are checked against it. Members of buckets that are then still in
    several components are checked against those of other components with which they share one of their rarest
    shingles: sets as similar as asked have one in common among the rarest n - ceil(percent * n / 100) + 1 of each, and
    enough shingles after the first of them.
    """
    space = Workspace(docs.sparkSession)
    base = docs.select("doc_id", "text")
    sig = space.keep(arrow_mapped(base, _signatures(k), "doc_id long, n_shingles long, set_name binary, bands array<long>"))
    live = sig.where("n_shingles > 0 and doc_id is not null")
    classes = space.keep(live.groupBy("set_name").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))
    banded = classes.select("rep", F.explode("bands").alias("key"))
    several = space.keep(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    member = space.keep(banded.join(several, "key"))
    # the hub of a bucket is the member that meets most others over all bands: copies are likest to the least changed one
    met = space.keep(member.groupBy("rep").agg(F.sum("n").alias("met")))
    hubs = member.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("rep"))).alias("hub"))
    hubs = space.keep(hubs.select("key", (-F.col("hub.rep")).alias("hub")))
    member = space.keep(member.select("key", "rep").join(hubs, "key"))
    first = space.keep(member.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct())
    ids = space.keep(first.select(F.col("a").alias("doc_id")).union(first.select("b")).distinct())
    needed = arrow_mapped(base.join(ids, "doc_id", "left_semi"), _sets(k), "doc_id long, s array<long>")
    sets = space.keep(needed)

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
        both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.where(f"100L * common >= {int(percent)}L * (size(sa) + size(sb) - common)").select("a", "b")

    links = space.keep(confirmed(first))
    comp = components(links, space)
    placed = member.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = space.keep(placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
    rest = space.keep(placed.join(mixed, "key", "left_semi").select("rep", "c").distinct())
    more = space.keep(_sharing_a_rare_shingle(rest, sets, percent, space))
    links2 = space.keep(confirmed(more))
    if not links2.isEmpty():
        comp = components(links.unionByName(links2), space)
    space.drop(sets, member, rest, mixed, first, more, hubs)
    named = classes.select("set_name", "rep").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = space.keep(named.select("set_name", F.coalesce("component", "rep").alias("component_id")))
    # a doc_id on several rows may sit in several classes; their classes then are one component
    repeated = space.keep(live.groupBy("doc_id").agg(F.min("set_name").alias("one"), F.max("set_name").alias("other")).where("one <> other").select("doc_id"))
    if not repeated.isEmpty():
        rows = live.join(repeated, "doc_id", "left_semi").select("doc_id", "set_name").distinct().join(named, "set_name")
        bridge = rows.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        merged = components(bridge, space).select(F.col("node").alias("component_id"), "component")
        named = space.keep(named.join(merged, "component_id", "left").select("set_name", F.coalesce("component", "component_id").alias("component_id")))
    out = sig.select("doc_id", "n_shingles", "set_name").join(named, "set_name", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows with a null doc_id stay.

    Columns are kept with their values whatever their names. Texts without words are linked with nothing and stay, rows
    repeated with one doc_id stay or go together, an empty table gives no rows.
    """
    found = near_duplicates(docs, k, percent)
    plain, names = positional(docs)
    gone = Workspace(docs.sparkSession).keep(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    return named(plain.join(gone, F.col(names["doc_id"]) == F.col("gone"), "left_anti"), names)
