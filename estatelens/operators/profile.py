"""Samples, column profiles, small-domain histograms and value overlap of tables.

All profiles describe a prefix of at most `limit` rows in a given order, as bounded probes do; without a limit
they describe the whole table in one pass with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .graph import cut

#: Fixed bounds of bounded probes.
SAMPLE_ROWS, SAMPLE_FIELDS, VALUE_CHARS, SAMPLE_CHARS, PROFILE_ROWS, PAIRS = 10, 32, 256, 20_000, 100_000, 50


#: Inputs below this size are dealt to all cores where work on rows is heavy; larger ones have row groups enough.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small: a small file often is one row group and so one task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def textual(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def supported(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def sample_rows(df: DataFrame, keys: Sequence[str] = (), limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most 10 rows by key (else by the first column), 32 supported columns, texts cut at 256 characters.

    Rows stop where the texts of all rows so far exceed 20,000 characters.
    """
    if not 1 <= limit <= SAMPLE_ROWS:
        raise ValueError(f"a sample has 1 to {SAMPLE_ROWS} rows")
    fields = [f for f in df.schema.fields if supported(f.dataType)][:SAMPLE_FIELDS]
    order = list(keys) or [fields[0].name]
    cut = df.orderBy(*order).limit(limit).select(*[F.substring(f.name, 1, VALUE_CHARS).alias(f.name) if textual(f.dataType) else F.col(f.name) for f in fields])
    texts = [F.coalesce(F.length(f.name), F.lit(0)) for f in fields if textual(f.dataType)]
    if not texts:
        return cut
    so_far = F.sum(sum(texts[1:], texts[0])).over(Window.orderBy(*[o for o in order]).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__chars", so_far).where(F.col("__chars") <= SAMPLE_CHARS).drop("__chars")


def prefix(df: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    if limit is None:
        return df
    if not 1 <= limit <= PROFILE_ROWS:
        raise ValueError(f"a profile reads 1 to {PROFILE_ROWS} rows")
    return df.orderBy(*order).limit(limit)


def profile_columns(df: DataFrame, columns: Sequence[str], order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """One row per column: non_null, null_count, distinct_count, min_value, max_value, min_length, max_length.

    min and max are text: whole numbers are compared and shown as such (2^53 + 1 too), other numbers as doubles, dates as ISO text;
    `complete` tells whether all rows were read. Rows become (column, value) once, repeated values meet before the shuffle.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = prefix(df.select(*dict.fromkeys([*columns, *order])), order, limit)
    whole = [isinstance(kinds[c], (T.IntegralType, T.BooleanType)) for c in columns]
    part = [isinstance(kinds[c], T.NumericType) and not w for c, w in zip(columns, whole, strict=True)]
    only = lambda here, c: F.col(c) if here else F.lit(None)
    cells = [
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"), only(whole[i], c).cast("long").alias("whole"), only(part[i], c).cast("double").alias("number"), (F.length(c) if textual(kinds[c]) else F.lit(None)).cast("int").alias("size"))
        for i, c in enumerate(columns)
    ]
    values = rows.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").groupBy("i", "v", "whole", "number", "size").agg(F.count("*").alias("n"))
    one = values.groupBy("i").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("v").alias("distinct_count"),
        *[f(c).alias(f"{t}_{c}") for c in ("v", "whole", "number", "size") for t, f in (("min", F.min), ("max", F.max))],
    )
    named = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column_name string")
    found = named.join(one, "i", "left")
    shown = lambda t: F.coalesce(F.col(f"{t}_whole").cast("string"), F.col(f"{t}_number").cast("string"), f"{t}_v")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = found.select(
        "column_name", zero("all").alias("rows_profiled"), zero("non_null").alias("non_null"), (zero("all") - zero("non_null")).alias("null_count"), zero("distinct_count").alias("distinct_count"),
        shown("min").alias("min_value"), shown("max").alias("max_value"), F.col("min_size").alias("min_length"), F.col("max_size").alias("max_length"),
    )
    if limit is None:
        return out.withColumn("complete", F.lit(True))
    seen = df.limit(limit + 1).agg(F.count("*").alias("seen"))
    return out.crossJoin(seen).withColumn("complete", F.col("seen") <= limit).drop("seen")


def histogram(df: DataFrame, column: str, domain: int = 20) -> DataFrame:
    """(column_name, value, count) by falling count, only if the column has at most `domain` values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    # the gate looks at no more rows than it needs
    few = counts.limit(domain + 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return few.where(F.col("n") <= domain).select(F.lit(column).alias("column_name"), "value", "count").orderBy(F.desc("count"), "value")


def cell(kind: T.DataType, value: Column) -> Column:
    """A value as struct(l, d, s): a whole number, another number, or text."""
    whole, part = isinstance(kind, T.IntegralType), isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
    none = F.lit(None)
    return F.struct((value if whole else none).cast("long").alias("l"), (value if part else none).cast("double").alias("d"), (none if whole or part else value).cast("string").alias("s"))


def cell_text() -> Column:
    """How the cells l, d and s are compared between columns: whole numbers alike whatever their type."""
    even = F.when((F.col("d") == F.floor("d")) & (F.abs("d") < 1e15), F.col("d").cast("long").cast("string")).otherwise(F.col("d").cast("string"))
    return F.coalesce(F.col("l").cast("string"), even, F.col("s"))


def probe_all(tables: dict[str, DataFrame], pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """The evidence of probe_pair for many pairs (table, field, table, field), with their position, in one pass over each table.

    Each table is reduced to its distinct values per field; fields that hold a value meet at that value, so that all
    overlaps come from one shuffle. A value is held by as many fields as are probed at most.
    """
    wanted = sorted({(a, x) for a, x, _, _ in pairs} | {(b, y) for _, _, b, y in pairs})
    number = {f: i for i, f in enumerate(wanted)}
    spark, parts = next(iter(tables.values())).sparkSession, []
    for table in dict.fromkeys(t for t, _ in wanted):
        df, own = tables[table], [f for t, f in wanted if t == table]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        cells = F.explode(F.array(*[F.struct(F.lit(number[table, c]).alias("f"), cell(kinds[c], F.col(c)).alias("c")) for c in own])).alias("x")
        counted = spread(df.select(*own)).select(cells).select("x.f", "x.c.*").where("l is not null or d is not null or s is not null").groupBy("f", "l", "d", "s").agg(F.count("*").alias("n"))
        parts.append(counted.select("f", cell_text().alias("v"), "n"))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    fields = values.groupBy("f").agg(F.count("*").alias("values"), F.sum("n").alias("rows"))
    shared = values.groupBy("v").agg(F.collect_list("f").alias("fs")).where(F.size("fs") > 1)
    both = shared.select("fs", F.explode("fs").alias("a")).select("a", F.explode("fs").alias("b")).where("a <> b")
    # (f, f) has the field's own counts, (f, g) the overlap; a row for each two fields at most, read three times
    met = fields.select(F.col("f").alias("a"), F.col("f").alias("b"), "values", "rows").union(both.groupBy("a", "b").agg(F.count("*").alias("values"), F.lit(None).cast("long").alias("rows")))
    met = cut(met)
    known = spark.createDataFrame([(i, *p, number[p[0], p[1]], number[p[2], p[3]]) for i, p in enumerate(pairs)], "position int, from_object string, source_field string, to_object string, target_field string, s int, t int")
    own = met.where("a = b")
    out = known.join(own.select(F.col("a").alias("s"), F.col("rows").alias("source_non_null"), F.col("values").alias("source_distinct")), "s", "left")
    out = out.join(own.select(F.col("a").alias("t"), F.col("rows").alias("target_non_null"), F.col("values").alias("target_distinct")), "t", "left")
    out = out.join(met.select(F.col("a").alias("s"), F.col("b").alias("t"), F.col("values").alias("overlap")), ["s", "t"], "left")
    counts = ["source_non_null", "source_distinct", "target_non_null", "target_distinct", "overlap"]
    out = out.select("position", "from_object", "to_object", "source_field", "target_field", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.select("*", *_ratios())


def _ratios() -> list[Column]:
    over = lambda a, b: (F.col(a) / F.greatest(F.lit(1), b))
    return [over("overlap", "source_distinct").alias("source_coverage"), over("overlap", "target_distinct").alias("target_coverage"), over("target_distinct", "target_non_null").alias("target_uniqueness")]


def probe_pair(source: DataFrame, source_field: str, target: DataFrame, target_field: str, limit: int | None = None) -> DataFrame:
    """Non-null and distinct counts of two columns, the overlap of their values, coverage and uniqueness; one row.

    A limit takes the least values of each side, so that a bounded probe gives the same answer each time.
    """

    def side(df: DataFrame, c: str) -> DataFrame:
        values = df.select(F.col(c).alias("v")).where("v is not null")
        return values.orderBy("v").limit(limit) if limit else values

    def counted(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("v").agg(F.count("*").alias(f"{tag}_n"))

    a, b = counted(side(source, source_field), "s"), counted(side(target, target_field), "t")
    both = a.join(b, "v", "full")
    out = both.agg(
        F.coalesce(F.sum("s_n"), F.lit(0)).alias("source_non_null"),
        F.count("s_n").alias("source_distinct"),
        F.coalesce(F.sum("t_n"), F.lit(0)).alias("target_non_null"),
        F.count("t_n").alias("target_distinct"),
        F.count(F.when(F.col("s_n").isNotNull() & F.col("t_n").isNotNull(), 1)).alias("overlap"),
    )
    return out.select(F.lit(source_field).alias("source_field"), F.lit(target_field).alias("target_field"), "*", *_ratios())
