"""Sources, the event stream, context packets and the engine."""

import json
import sqlite3

import pytest

from estatelens import fixtures as fx
from estatelens.engine import Engine
from estatelens.plans import context
from estatelens.sources import catalogs, sqlite
from estatelens.streaming import event_log


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "a.db")
    con = sqlite3.connect(path)
    con.executescript('create table d (id integer primary key, "na""me" text); create table f (k int, d_id int references d(id), x real, b blob); create view v as select id from d;')
    con.executemany("insert into d values (?, ?)", [(i, f"n{i}" if i % 3 else None) for i in range(50)])
    con.executemany("insert into f values (?, ?, ?, ?)", [(i, i % 50, i / 2, b"z") for i in range(20)])
    con.commit()
    con.close()
    return path


def test_sqlite_is_read_in_ranges(spark, database):
    spark.dataSource.register(sqlite.SQLiteSource)
    read = lambda t: spark.read.format("sqlite_ro").option("path", database).option("table", t).load()
    d = read("d")
    assert d.count() == 50 and d.rdd.getNumPartitions() > 1
    assert sorted((r[0], r[1]) for r in d.collect())[3] == (3, None)
    assert read("v").count() == 50 and dict(read("f").dtypes) == {"k": "bigint", "d_id": "bigint", "x": "double", "b": "binary"}
    with pytest.raises(sqlite3.OperationalError):
        sqlite.connect(database).execute("delete from d")


def test_sqlite_catalog(spark, database):
    objects, fields, rels = sqlite.harvest(spark, database)
    assert {(r.object, r.kind, r.primary_key) for r in objects.collect()} == {("d", "table", "id"), ("f", "table", ""), ("v", "view", "")}
    assert [r.field for r in fields.where("object = 'f'").orderBy("position").collect()] == ["k", "d_id", "x", "b"]
    assert [(r.object, r.to_object, r.from_fields, r.to_fields) for r in rels.collect()] == [("f", "d", ["d_id"], ["id"])]


def test_repeated_json_keys_are_refused():
    assert catalogs.strict_json('{"a": {"b": 1}}') == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        catalogs.strict_json('{"a": {"b": 1, "b": 2}}')


def test_catalog_of_files(spark, sf_dir):
    o, f = catalogs.from_files(spark, {"region": spark.read.parquet(f"{sf_dir}/region.parquet")}, {"region": ["r_regionkey"]})
    assert o.first().primary_key == "r_regionkey" and [r.is_primary_key for r in f.orderBy("position").collect()] == [True, False]


def test_events_go_in_once_and_bad_ones_aside(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    event = {"sequence": 1, "call_id": "a", "kind": "sql", "status": "succeeded", "inputs": ["t"], "consumes": [], "at": "2024-01-01T00:00:00Z"}
    (src / "1.json").write_text("\n".join(json.dumps(e) for e in [event, event, event | {"call_id": "b", "inputs": []}, event | {"call_id": "c", "kind": "x"}]))
    ok, bad, cp = (str(tmp_path / x) for x in ("ok", "bad", "cp"))
    for _ in range(2):
        event_log.ingest(event_log.read_events(spark, str(src)), ok, bad, cp).awaitTermination()
    assert [r.call_id for r in spark.read.parquet(ok).collect()] == ["a"]
    assert {(r.call_id, r.rule) for r in spark.read.parquet(bad).collect()} == {("b", "inputs_given"), ("c", "kind_known")}


def test_windowed_counts(spark, sf_dir):
    df = event_log.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert df.agg({"events": "sum"}).first()[0] == 1000


def test_expansion_respects_budgets_and_order():
    joins = [{"id": f"j{i}", "source": "f", "target": t, "kind": k} for i, (t, k) in enumerate([("a", "candidate"), ("b", "foreign_key"), ("c", "foreign_key")])]
    p = context.expand({"f": 9.0, "c": 1.0}, joins, seeds=1, objects=3, max_joins=5, hops=1)
    assert [o["object"] for o in p.objects] == ["f", "c", "b"] and p.paths == [["f", "c"], ["f", "b"]] and p.omitted["objects"] == 1
    with pytest.raises(ValueError):
        context.expand({}, [], seeds=0)


def test_packets_shrink_in_order_and_hash_the_same():
    p = context.Packet(objects=[{"fields": ["x" * 300] * 3, "object": o} for o in "ab"], joins=[{"id": "j"}], paths=[["a", "b"]])
    assert p.identity() == context.digest(json.loads(context.canonical(p.body())))
    context.fit(p, 1000)
    assert len(context.canonical(p.body())) <= 1000 and p.objects[1]["fields"] == [] and p.joins


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "state"))
    e.build_graph("one", *(t.df(spark) for t in fx.RETAIL_1))
    e.build_graph("two", *(t.df(spark) for t in fx.RETAIL_2))
    assert e.changes("one", "two").count() == 13 and e.nodes("one").count() == 70
    packet = e.context("one", "sls", objects=4, hops=1)
    assert 1 <= len(packet.objects) <= 4 and all(o["fields"] for o in packet.objects)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        e.save("graphs/one", "objects", fx.OBJECTS.df(spark), create_only=True)
    with pytest.raises(ValueError):
        o, f, r = (t.df(spark) for t in fx.RETAIL_1)
        e.build_graph("bad", o.union(o), f, r)
