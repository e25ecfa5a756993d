"""Every stage of the pipeline on odd rows, on an empty table and on many equal rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from estatelens.llm import exact_dedup, mixing, near_dedup, sharding

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (4, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(name, spark, odd, labelled):
    out = STAGES[name](spark, odd, labelled)
    rows = out.collect()
    assert 0 < len(rows) <= 3 * odd.count()
    if name != "sentencepiece":
        assert out.columns == odd.columns and out.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    if name in ("toxicity", "exact dedup", "near dedup"):
        kept = odd.collect()
        assert all(r in kept for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_no_rows(name, spark, none, labelled):
    assert STAGES[name](spark, none, labelled).count() == 0


def test_stages_in_a_row(spark, odd, labelled, tmp_path):
    docs = odd
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, labelled).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() > 0 and docs.where("not round_trip and n_tokens = 0").count() == 0


def test_thousands_of_equal_rows(spark):
    df = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same five words here again").alias("text"), F.lit("s").alias("source"))
    assert [tuple(r) for r in exact_dedup.exact_duplicates(df).select("keep_id", "group_size", "kept").distinct().collect()] == [(7, 6000, True)]
    assert exact_dedup.drop_exact_duplicates(df).count() == 1
    near = near_dedup.near_duplicates(df)
    assert near.count() == 6000 and near.select("component_id").distinct().count() == 1
    got = mixing.mix(df).agg(F.sum("taken").alias("t"), F.max("taken").alias("m")).first()
    assert got.t == 36_000 and got.m <= 18
    many = spark.range(3000).select("id", F.lit("a b c d e f").alias("text")).selectExpr("id as doc_id", "text")
    assert exact_dedup.exact_duplicates(many).where("keep_id = 0 and group_size = 3000").count() == 3000
    assert near_dedup.near_duplicates(many).where("component_id = 0").count() == 3000


def test_texts_with_the_same_hashes_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as G

    plain = exact_dedup._hashes
    # under the first seed all blocks of one length collide
    monkeypatch.setattr(exact_dedup, "_hashes", lambda b, seed: [G.length(b).cast("long").alias("h"), G.lit(0).cast("long").alias("i")] if seed == 0 else plain(b, seed))
    df = spark.createDataFrame([(i, "abc"[i % 3] * 700) for i in range(9)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df).collect()} == {(i, i % 3, 3) for i in range(9)}


def test_long_texts_end_on_one_name(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "."), (4, "." + long), (5, long[: exact_dedup.BLOCK * 3]), (6, long[: exact_dedup.BLOCK * 3])], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)}


def test_shards_are_even_and_few_rows_move():
    import numpy as np

    keys = np.arange(100_000, dtype=np.uint64)
    before, after = sharding.jump(keys, 16), sharding.jump(keys, 17)
    counts = np.bincount(before, minlength=16)
    assert counts.min() > 6000 and counts.max() < 6500
    moved = before != after
    assert (after[moved] == 16).all() and abs(moved.mean() - 1 / 17) < 0.003
