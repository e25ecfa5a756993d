"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once; the high bits choose one of BINS bins, whose least hash stays. An
empty bin takes the value of the first filled bin in its own fixed random order of all bins (optimal densification,
so that two documents borrow alike whenever they can). Of each value the low eight bits are kept, two
hexadecimal digits a bin. The share of equal bins, less what eight bits agree by chance, estimates the
similarity of the shingle sets. Only DataFrame operations are used: sorting a document's hashes brings each bin's
least to the front of its run.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

BINS, LOG_BINS, BITS, WORDS = 128, 7, 8, 5
#: Rows that one window of neighbours is to hold, and the most windows; beyond their product, half a billion rows, windows grow.
WINDOW_ROWS, WINDOWS = 2000, 1 << 18
#: Windows whose bounds are quantiles of the ids; each is cut evenly into as many as are wanted.
QUANTILES = 1024


def _ranks() -> list[int]:
    """For each bin, the places of all bins in its order; its own comes first. A fixed rule."""
    out = []
    for j in range(BINS):
        others = [b for b in range(BINS) if b != j]
        random.Random(j).shuffle(others)
        place = {b: i + 1 for i, b in enumerate(others)} | {j: 0}
        out += [place[b] for b in range(BINS)]
    return out


def _sql_array(values: list) -> Column:
    return F.expr("array(" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")")


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: BINS * 2 hexadecimal digits, or an empty string for a text without words.

    Words are runs outside [\\x20\\x09-\\x0D] in lower case; fewer than five make one shingle.
    """
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE)
    df = df.withColumn("__w", F.filter(split, lambda x: x != ""))
    df = df.withColumn("__n", F.size("__w"))
    shingle = f"transform(sequence(1, greatest(__n - {WORDS - 1}, 1)), i -> xxhash64(slice(__w, i, {WORDS})))"
    df = df.withColumn("__h", F.expr(f"if(__n = 0, cast(array() as array<bigint>), sort_array({shingle}))"))
    # in the order of signed integers each bin's hashes lie together and the first of a run is the bin's least
    df = df.withColumn("__f", F.expr(f"filter(__h, (h, i) -> i = 0 or shiftright(h, {64 - LOG_BINS}) <> shiftright(__h[i - 1], {64 - LOG_BINS}))"))
    df = df.withColumn("__k", F.expr(f"transform(__f, h -> named_struct('b', cast(shiftright(h, {64 - LOG_BINS}) + {BINS // 2} as int), 'v', cast(h & 255 as int)))"))
    ranks, digits = "__ranks", "__digits"
    df = df.withColumn(ranks, _sql_array(_ranks())).withColumn(digits, _sql_array([f"{i:02x}" for i in range(256)]))
    # which bins are filled, as bits of two integers; bins below a filled one tell its place among the filled
    df = df.withColumn("__m", F.expr("""aggregate(__k, named_struct('a', 0L, 'b', 0L), (m, x) -> named_struct(
        'a', if(x.b < 64, m.a | shiftleft(1L, x.b), m.a), 'b', if(x.b < 64, m.b, m.b | shiftleft(1L, x.b - 64))))"""))
    df = df.withColumn("__ma", F.col("__m.a")).withColumn("__mb", F.col("__m.b"))
    borrowed = f"array_min(transform(__k, x -> shiftleft({ranks}[j * {BINS} + x.b], {BITS}) | x.v)) & 255"
    own = """if(j < 64, if(shiftright(__ma, j) & 1 = 1, bit_count(__ma & ~shiftleft(-1L, j)), -1),
        if(shiftright(__mb, j - 64) & 1 = 1, bit_count(__ma) + bit_count(__mb & ~shiftleft(-1L, j - 64)), -1))"""
    packed = f"""case when size(__k) = 0 then ''
        when size(__k) = {BINS} then array_join(transform(__k, x -> {digits}[x.v]), '')
        else array_join(transform(transform(sequence(0, {BINS - 1}), j -> named_struct('j', j, 'i', {own})),
            y -> {digits}[if(y.i >= 0, __k[y.i].v, {borrowed.replace("[j *", "[y.j *")})]), '') end"""
    return df.withColumn(name, F.expr(packed)).drop("__w", "__n", "__h", "__f", "__k", "__m", "__ma", "__mb", ranks, digits)


def likeness(a: str, b: str) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1; two empty ones are alike, an empty and another are not."""
    same = F.expr(f"size(filter(sequence(0, {BINS - 1}), i -> substring({a}, i * 2 + 1, 2) = substring({b}, i * 2 + 1, 2)))")
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).otherwise(estimate)


def _window(bounds: list[int], parts: int) -> Column:
    """The number of a row's window: the quantiles up to its doc_id by binary search, then even parts; never falls as doc_id grows."""

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(doc_id >= {bounds[mid]}L, {search(mid + 1, hi)}, {search(lo, mid)})"

    if len(bounds) < 2:
        return F.lit(0)
    wide = F.expr(search(1, len(bounds) - 1)) - 1
    low, high = (F.element_at(_sql_array([float(b) for b in x]).cast("array<double>"), wide + 1) for x in (bounds[:-1], bounds[1:]))
    part = F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * parts)
    return F.when(F.col("doc_id").isNull(), 0).otherwise(wide * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))).cast("int")


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """docs with next_<c> of the row that follows in descending doc_id; after the last comes the first.

    Rows are cut by doc_id into windows of some WINDOW_ROWS rows; each window also gets a copy of the row before
    its least, so that no window needs all rows. Nulls count as the least doc_id; rows with one doc_id follow by text.
    """
    n = docs.count()
    windows = max(1, min(WINDOWS, n // WINDOW_ROWS))
    wide = min(windows, QUANTILES)
    shares = [i / wide for i in range(wide + 1)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 20 * wide).alias("p")).first().p or [])) if windows > 1 else []
    placed = docs.withColumn("__b", _window(bounds, -(-windows // wide)))
    # one row of three numbers for each window that is not empty: WINDOWS and a few at most
    tops = placed.groupBy("__b").agg(F.max("doc_id").alias("__top"))
    along = Window.orderBy("__b")
    after = F.coalesce(F.lead("__b").over(along), F.min("__b").over(Window.partitionBy()))
    placed = placed.join(F.broadcast(tops.withColumn("__after", after)), "__b")
    home = F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("__after").alias("b"), F.lit(True).alias("ghost"))
    is_top = F.col("doc_id").eqNullSafe(F.col("__top"))
    spread = placed.withColumn("__to", F.explode(F.when(is_top, F.array(home, ghost)).otherwise(F.array(home))))
    order = Window.partitionBy("__to.b").orderBy(F.col("__to.ghost").desc(), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    out = spread.select("*", *[F.lag(F.col(c)).over(order).alias(f"next_{c}") for c in carried])
    return out.where("not __to.ghost").drop("__b", "__to", "__top", "__after")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs(doc_id, text).

    Null texts count as empty. In the edited text the last floor(n_chars / 2) code points give way to as many first
    ones of the next document in descending doc_id. A single document follows itself; other columns are ignored; an empty table
    gives no rows; equal texts have equal fingerprints; very long texts are read whole.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = fingerprint(base, "text", "fingerprint")
    both = with_next(own, "text", "fingerprint").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.withColumn("edited", edited).drop("text", "next_text")
    both = fingerprint(both, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
