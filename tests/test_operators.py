"""Rules that the registered queries do not reach."""

import math
import random
import re
import unicodedata
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from estatelens import fixtures as fx
from estatelens import queries as core
from estatelens.functions import text as X
from estatelens.operators import graph, lineage, profile, relationships, retrieval, scopes


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def folded(v):
    v = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", v).replace("ß", "ss")
    return unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()


def test_tokens_follow_the_order_of_folding(spark):
    values = ["éA SalesOrderID", "a–b", "Straße für die Öl", "Łódź ñandú", "x1Y2", "", None, "THE Cats", "Tiếng Việt ﬁle Ａbc ĳs", "№5 ½ ㎏ ™", "a\u00a0b 𝐀𝟗 Ǆungla", "日本 Ελλάδα x"]
    want = [[t for t in re.split("[^a-z0-9]+", folded(v or "")) if t and t not in X.BM25_STOP] for v in values]
    assert column(spark, values, X.bm25_tokens) == want


def test_singular(spark):
    values = ["categories", "cats", "class", "status", "basis", "ties", "is", "bus", "s"]
    assert column(spark, values, X.singular) == ["category", "cat", "class", "status", "basis", "tie", "is", "bus", "s"]


def test_key_shapes_equal_a_scan(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("AB12-_ ") for _ in range(rng.randrange(12))) for _ in range(300)]

    def shape(v):
        runs, parts, shown = re.findall(X.RUNS, v), [], ""
        for r in runs:
            if r[0].isdigit():
                parts.append(r)
                shown += f"{{digits_{len(parts)}:{len(r)}}}"
            else:
                shown += r
        return (shown, parts) if parts and re.search("[A-Za-z]", v) else None

    got = column(spark, values, X.key_shape)
    assert [(g.pattern, [p.text for p in g.parts]) if g else None for g in got] == [shape(v) for v in values]


def test_normalized_values(spark):
    values = [" 000123 ", "12.0", "1.5", "x", "", None, "-7"]
    assert column(spark, values, lambda v: X.normalized_value(v, True)) == ["123", "12", None, None, None, None, "-7"]
    assert column(spark, values[:1], lambda v: X.normalized_value(v, False)) == [str(Decimal(123)).rjust(6, "0")]


def test_references(spark):
    assert column(spark, ['[DW] . "Sales"', "`a`.b"], X.normalized_reference) == ["dw.sales", "a.b"]
    assert column(spark, ["x.dw.Sales", "sales", "w.sales"], lambda v: X.same_reference(v, F.lit("dw.sales"))) == [True, True, False]


def test_type_families(spark):
    assert column(spark, ["VARCHAR(10)", "timestamp", "double", "datetime2(3)", "bit", "int"], X.type_family) == ["text", "binary", "unknown", "date", "bool", "number"]
    assert column(spark, ["DECIMAL(9,2)", "varchar(3)", " int identity"], X.is_numeric_type) == [True, False, True]


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([("a", "red red fish"), ("b", "blue fish"), ("c", "red"), ("d", None)], "id string, text string")
    got = {r.id: r.score for r in retrieval.bm25(docs, "red red fish").collect()}
    texts = {"a": ["red", "red", "fish"], "b": ["blue", "fish"], "c": ["red"], "d": []}
    mean, df = sum(map(len, texts.values())) / 4, Counter(t for x in texts.values() for t in set(x))
    for k, ts in texts.items():
        s = sum(math.log(1 + (4 - df[q] + 0.5) / (df[q] + 0.5)) * ts.count(q) * 2.5 / (ts.count(q) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for q in ["red", "red", "fish"] if q in ts)
        assert got.get(k, 0) == pytest.approx(s, abs=1e-8)
    assert retrieval.bm25(docs, "the of").count() == 0


def test_vectors_that_cannot_be_normalized(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([],)], "v array<double>")
    assert [r.n for r in df.select(retrieval.normalized_vector(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], None, None, None]


def test_sample_bounds(spark):
    df = spark.createDataFrame([(i, "x" * 300, bytearray(b"1")) for i in range(20)], "k int, t string, b binary")
    got = profile.sample_rows(df, ["k"], 10)
    assert got.columns == ["k", "t"] and got.count() == 10 and got.agg(F.max(F.length("t"))).first()[0] == 256
    with pytest.raises(ValueError):
        profile.sample_rows(df, ["k"], 11)


def test_profile_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "a string")
    r = profile.profile_columns(df, ["a"]).first()
    assert (r.non_null, r.null_count, r.distinct_count, r.min_value) == (0, 2, 0, None)
    e = profile.probe_pair(df, "a", df, "a").first()
    assert (e.overlap, e.source_coverage, e.target_uniqueness) == (0, 0.0, 0.0)


def test_key_patterns_and_segments(spark):
    keys = [f"KST{i:06d}KTO{i * 7:06d}" for i in range(1, 5)] + ["legacy-key"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    r = relationships.dominant_pattern(df, "k").first()
    assert (r.pattern, r.match_count, r.coverage, r.components) == ("KST{digits_1:6}KTO{digits_2:6}", 4, 0.8, 2)
    target = spark.createDataFrame([(i * 7,) for i in range(1, 5)], "id int")
    s = relationships.segment_overlap(df, "k", r.pattern, 2, target, "id", True).first()
    assert (s.overlap, s.source_coverage, s.target_uniqueness) == (4, 1.0, 1.0)
    assert relationships.segment_overlap(df, "k", r.pattern, 1, target, "id", True).count() == 0


def test_best_candidate_keeps_the_first_of_equals(spark):
    rows = [(i, "a", "x", t, "k", 5, 1.0, 1.0, 1.0) for i, t in enumerate(["b", "c"])] + [(9, "a", "y", "b", "k", 2, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "position int, from_object string, from_field string, to_object string, to_field string, overlap int, source_coverage double, target_coverage double, target_uniqueness double")
    got = relationships.best_candidates(df).collect()
    assert [(r.from_field, r.to_object, r.confidence) for r in got] == [("x", "b", 0.95)]


def test_cycles_are_refused(spark):
    steps = spark.createDataFrame([("a", 1, ["b"]), ("b", 2, ["a"])], "step string, position int, depends_on array<string>")
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_layers(steps)


def test_failed_calls_are_not_traced(spark):
    with pytest.raises(ValueError):
        graph.closure(fx.RUNTIME.df(spark), "q3")


def test_reference_search(spark):
    nodes = fx.DEFINITIONS.df(spark).select(F.col("definition").alias("id"), F.substring_index("name", ".", -1).alias("name"), "kind", F.col("name").alias("reference"))
    assert [r.id for r in lineage.find_references(nodes, "[ETL] . build_sales").collect()] == ["d2", "d1"]


def test_unknown_rules_and_modes_are_refused(spark):
    with pytest.raises(ValueError):
        scopes.apply_rule(F.lit("x"), ["soundex"])
    with pytest.raises(ValueError):
        scopes.find_candidates(fx.CANDIDATES.df(spark), "r2", "all")


def test_profiles_of_mixed_columns(spark):
    df = spark.sql("select * from values (1, 'abc', timestamp'2024-01-02', 2.5d), (10, 'b', null, -1d), (9, null, timestamp'2024-01-01', 2.5d) as t(i, s, t, d)")
    got = {r.column_name: r for r in profile.profile_columns(df, ["i", "s", "t", "d"]).collect()}
    assert [(got[c].min_value, got[c].max_value, got[c].distinct_count, got[c].min_length) for c in "istd"] == [("1", "10", 3, None), ("abc", "b", 2, 1), ("2024-01-01 00:00:00", "2024-01-02 00:00:00", 2, None), ("-1.0", "2.5", 2, None)]


def test_whole_numbers_are_shown_as_they_are(spark):
    df = spark.sql("select * from values (9007199254740993L, cast(7 as tinyint), 1e3d), (9007199254740992L, cast(10 as tinyint), 12345678.5d), (-1L, null, null) as t(a, b, c)")
    got = {r.column_name: (r.min_value, r.max_value, r.distinct_count) for r in profile.profile_columns(df, ["a", "b", "c"]).collect()}
    assert got == {"a": ("-1", "9007199254740993", 3), "b": ("7", "10", 2), "c": ("1000.0", "1.23456785E7", 2)}


def test_all_pairs_equal_single_probes(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}
    pairs = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_totalprice", "customer", "c_custkey"), ("customer", "c_custkey", "orders", "o_custkey")]
    got = {r.position: r for r in profile.probe_all(tables, pairs).collect()}
    for i, (a, x, b, y) in enumerate(pairs):
        want = profile.probe_pair(tables[a], x, tables[b], y).first().asDict()
        assert {k: got[i][k] for k in want} == want


def test_names_that_two_definitions_share_are_refused(spark):
    d, c, w, m = (t.df(spark) for t in (fx.DEFINITIONS, fx.CLAIMS, fx.WRITES, fx.MATERIALIZATIONS))
    twin = d.where("definition = 'd3'").withColumn("definition", F.lit("d9")).withColumn("name", F.lit("[RAW] . orders"))
    with pytest.raises(ValueError, match="several"):
        lineage.network(d.union(twin).union(twin.withColumn("definition", F.lit("d10"))), c, w, m)


def test_rules_of_compatibility(spark):
    assert column(spark, [" ﬁle Ａ", None], lambda v: scopes.apply_rule(v, ["unicode_nfkc", "trim", "casefold"])) == ["file a", None]
