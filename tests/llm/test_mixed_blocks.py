"""The shards of a mix, slot by slot."""

from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_pipeline import permuted

from estatelens.llm import mixing, queries
from estatelens.llm.common import Workspace


@pytest.fixture
def three(spark, monkeypatch, tmp_path):
    """Three sources in shards of 50 slots."""
    monkeypatch.setattr(mixing, "SHARD", 50)
    docs = [(i, " ".join(["w"] * (40 + i * 37 % 300)), f"s{i % 3}") for i in range(240)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_shards_hold_the_mix(spark, three):
    rows = queries.op5_mixing_blocks(spark, three).collect()
    held, taken = defaultdict(int), Counter()
    for r in rows:
        held[r.shard, r.slot, r.source, r.block] += r.n
        taken[r.doc_id] += r.n
    # each slot has one block, and no slot is missing
    assert sorted(s * 50 + t for s, t, _, _ in held) == list(range(len(held))) and len({k[:2] for k in held}) == len(held)
    assert taken == Counter({r.doc_id: r.taken for r in queries.op5_mixing(spark, three).collect() if r.taken})
    # the draw: tickets of a source lie together before they are dealt to all places
    slots = Counter(s for _, _, s, _ in held)
    tickets = [s for s in sorted(slots) for _ in range(slots[s])]
    drawn = Counter((permuted(g, len(tickets), 0) // 50, x) for g, x in enumerate(tickets))
    shards = Counter((s, x) for s, _, x, _ in held)
    assert shards == drawn and len({tuple(sorted((x, n) for (t, x), n in shards.items() if t == s)) for s, _ in shards}) > 2
    # a source's blocks follow the shards
    for number, x in enumerate(sorted(slots)):
        blocks = max(b for _, _, y, b in held if y == x) + 1
        want, q = defaultdict(Counter), 0
        for s in sorted({k[0] for k in held}):
            for _ in range(shards[s, x]):
                want[s][permuted(q % blocks, blocks, number + 1)] += 1
                q += 1
        got = defaultdict(Counter)
        for s, _, y, b in held:
            if y == x:
                got[s][b] += 1
        assert got == {k: v for k, v in want.items() if v}


def test_sql_says_the_same(spark, three):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{three}/documents.parquet/*.parquet'")
    for name in ("op5_mixing", "op5_mixing_blocks"):
        got = queries.queries()[name](spark, three)
        want = con.execute(queries.oracle_sql()[name]).fetchall()
        names = [x[0] for x in con.description]
        assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)


def test_takes_follow_the_draw(spark, three):
    space = Workspace(spark)
    docs = spark.read.parquet(f"{three}/documents.parquet")
    laid, sources, slots = mixing.plan(space.keep(mixing._sized(docs)), space)
    total = slots.count()
    counts = mixing.shard_counts(sources, total)
    assert {r.number: r.n for r in counts.groupBy("number").agg(F.sum("n").alias("n")).collect()} == {r.number: r.slots for r in sources.collect()}
    assert {r.n for r in counts.where(f"shard < {total // 50}").groupBy("shard").agg(F.sum("n").alias("n")).collect()} == {50}
    held = [mixing.slots_of(c, sources, total, space) for c in (counts, _swapped(counts))]
    shards = [Counter((r.shard, r.number, r.block) for r in h.collect()) for h in held]
    assert shards[0] != shards[1]
    # which shard holds a block follows the draw, how often a document is taken doesn't
    taken = [Counter({r.row: r.n for r in mixing._packed(laid, h).groupBy("row").agg(F.sum("n").alias("n")).collect()}) for h in held]
    assert taken[0] == taken[1]


def _swapped(counts):
    """Another draw of the same totals: two slots of source 0 and of source 1 change shards 0 and 1."""
    move = F.expr("case when shard > 1 or number > 1 then 0 when (shard = 0) = (number = 0) then -2 else 2 end")
    return counts.withColumn("n", F.col("n") + move)


def test_parts_are_even_for_ids_of_a_stride(spark):
    for step in (1, 64, 4096, -640, 2**31, 12345678):
        parts = spark.range(6400).groupBy(mixing.part_of(F.col("id") * step, 64)).count()
        assert parts.agg(F.max("count")).first()[0] < 200


def test_odd_rows_are_packed_whole(odd):
    held, taken = Counter(), Counter()
    for r in mixing.mixed_blocks(odd).collect():
        held[r.doc_id] += r.n
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] += r.taken
    assert held == Counter({k: v for k, v in taken.items() if v})


def test_sources_meet_their_targets_to_a_word(spark):
    for sizes in ([1, 1, 5, 31, 40], [63, 64, 65, 200, 1], [1000, 3, 20, 0, 130]):
        docs = [(i * 7 + s, " ".join(["w"] * (n // 3 + (n % 3 if i == 2 else 0))), f"s{s}") for s, n in enumerate(sizes) for i in range(3)]
        got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
        by = defaultdict(int)
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"]
            by[r.target, r.source_size] += r.taken
        same = Counter((r.target, r.source_size) for r in got)
        assert all(abs(n - t * same[t, z] / 3) <= 1 + same[t, z] / 3 for (t, z), n in by.items())


def test_places_are_undone(spark):
    for n in (1, 2, 63, 64, 1000, 2**31 + 11, 2**60 + 7):
        keys = mixing.round_keys(F.lit(n).cast("long"), F.lit(5).cast("long"))
        there = spark.range(min(n, 500)).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys).alias("y"))
        back = there.select("id", "y", mixing.place_of(F.col("y"), F.lit(n).cast("long"), keys).alias("x")).collect()
        assert all(r.x == r.id and 0 <= r.y < n and r.y == permuted(r.id, n, 5) for r in back) and len({r.y for r in back}) == len(back)


def test_repeated_rows_are_mixed_apart(spark):
    docs = [(i % 40, f"a{i % 40} " * (30 + i % 40), ["x", None, "y"][i % 40 % 3], i) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, turn int")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.agg(F.sum(mixing.word_count("text"))).first()[0] == mixing.mix(df).agg(F.sum("taken")).first()[0]


def test_one_text_under_two_sources(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (None, "d e f g", None)], "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in mixing.mixed_documents(df).select("text", "source").collect())
    assert sum(len(t.split()) * n for (t, _), n in got.items()) == mixing.mix(df).agg(F.sum("taken")).first()[0]


def test_no_blocks(none):
    assert mixing.mixed_blocks(none).count() == 0
