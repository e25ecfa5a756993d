"""Sources, imports, index, traces, reviews and the engine's groups, beyond what the registered queries show."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from estatelens import fixtures as fx
from estatelens.engine import Engine
from estatelens.operators import constraints, network, relationships, retrieval, review, search, workspaces
from estatelens.plans import context
from estatelens.sources import demo, semantic, sqlserver

# the demo estate


def test_the_demo_estate(spark):
    one = demo.retail(spark)
    assert {k: v.count() for k, v in one.items()} == {"D_DATE": 48, "D_PRD": 8, "D_CUST": 20, "D_GEO": 5, "D_RSLR": 8, "D_CURR": 3, "D_CHNL": 3, "MAP_TERR_CH": 10, "F_SLS_01": 120, "F_SLS_02": 96, "F_RET_01": 30, "V_SLS_ALL": 216}
    keys = [r[0] for r in one["D_DATE"].orderBy("DATE_KEY").collect()]
    assert (keys[0], keys[-1], len(set(keys))) == (20220101, 20251201, 48)
    first = one["F_SLS_01"].orderBy("DOC_ID").first()
    assert (first.DOC_ID, first.DOC_DT_KEY, first.PRD_KEY, first.CUST_KEY, first.CURR_CD, first.QTY, first.NET_AMT) == (100001, keys[3], 2, 2, "EUR", 2, 165.0)
    assert one["F_SLS_02"].join(one["D_RSLR"], "RSLR_KEY", "left_anti").count() == 0 and one["F_SLS_02"].select("RSLR_KEY").distinct().count() == 8
    two = demo.retail(spark, 2)
    assert "TERRITORY_ID" in two["D_RSLR"].columns and "DISC_AMT" in two["F_SLS_01"].columns and "RETURN_AMT" not in two["F_RET_01"].columns
    assert dict(two["F_SLS_02"].dtypes)["NET_AMT"] == "decimal(18,2)"
    for name, (_, fields) in {"v1": (1, fx.RETAIL_1[1]), "v2": (2, fx.RETAIL_2[1])}.items():
        tables = one if name == "v1" else two
        assert {(t, c) for t, df in tables.items() for c in df.columns} == {(r[1], r[2]) for r in fields.rows}


# SQL Server


def _server(spark):
    """A reader that answers catalog queries from tables, and others with DuckDB."""
    con = duckdb.connect()
    con.execute("create schema dbo; create table dbo.\"we]ird\" as select i as id, case when i % 3 > 0 then 'n' || i end as name, i % 2 = 0 as flag, repeat('x', 300) as long from range(50) t(i)")
    con.execute("create table dbo.child as select i as id, i % 60 as weird_id from range(100) t(i)")
    schema = "namespace string, object string, object_type string, field string, position int, type_name string, max_length int, precision int, scale int, nullable boolean, object_description string, field_description string"
    rows = [("dbo", "we]ird", "U ", "id", 1, "int", 4, 10, 0, False, "odd", None), ("dbo", "we]ird", "U ", "name", 2, "nvarchar", 40, 0, 0, True, "odd", "a name"), ("dbo", "we]ird", "U ", "flag", 3, "bit", 1, 1, 0, True, "odd", None), ("dbo", "we]ird", "U ", "long", 4, "varchar", 300, 0, 0, True, "odd", None), ("dbo", "we]ird", "U ", "doc", 5, "xml", -1, 0, 0, True, "odd", None), ("dbo", "child", "V ", "id", 1, "int", 4, 10, 0, False, None, None), ("dbo", "child", "V ", "weird_id", 2, "decimal", 9, 9, 2, True, None, None), ("aux", "t", "U ", "a", 1, "datetime2", 8, 0, 3, True, None, None)]
    asked = []

    def read(query):
        asked.append(query)
        if query == sqlserver.COLUMNS:
            return spark.createDataFrame(rows, schema)
        if query == sqlserver.PRIMARY_KEYS:
            return spark.createDataFrame([("dbo", "we]ird", "id", 1)], "namespace string, object string, field string, place int")
        if query == sqlserver.FOREIGN_KEYS:
            return spark.createDataFrame([("fk", "dbo", "child", "weird_id", "dbo", "we]ird", "id", 1)], "name string, namespace string, object string, from_field string, to_namespace string, to_object string, to_field string, place int")
        q = re.sub(r"\[((?:[^\]]|\]\])+)\]", lambda m: '"' + m[1].replace("]]", "]") + '"', query)
        q = q.replace("count_big", "count").replace("len(v)", "length(v)").replace("nvarchar(256)", "varchar").replace("convert(int, ", "(").replace("1 x from", "1 as x from")
        q = re.sub(r"select top \((\d+)\) ([^()]*(?:\([^()]*\)[^()]*)?)(?=\)|$)", r"select \2 limit \1", q)
        found, names = con.execute(q).fetchall(), [d[0] for d in con.description]
        kinds = {"BIGINT": "long", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}
        return spark.createDataFrame(found, ", ".join(f"{n} {kinds[str(d[1])]}" for n, d in zip(names, con.description, strict=True)))

    return read, asked


def test_server_catalog(spark):
    read, _ = _server(spark)
    objects, fields, rels = sqlserver.catalog(read)
    assert {(r.namespace, r.object, r.kind, r.primary_key) for r in objects.collect()} == {("dbo", "we]ird", "table", "id"), ("dbo", "child", "view", ""), ("aux", "t", "table", "")}
    got = {(r.object, r.field): (r.data_type, r.is_primary_key) for r in fields.collect()}
    assert got["we]ird", "name"] == ("nvarchar(20)", False) and got["we]ird", "id"] == ("int", True) and got["child", "weird_id"] == ("decimal(9,2)", False) and got["t", "a"] == ("datetime2(3)", False)
    assert [(r["name"], r.from_fields, r.to_fields) for r in rels.collect()] == [("fk", ["weird_id"], ["id"])]
    assert sqlserver.catalog(read, "aux")[0].count() == 1
    assert constraints.repeated(fields, "x", "namespace", "object", "field").count() == 0


def test_server_samples_and_profiles(spark):
    read, asked = _server(spark)
    chosen, left_out, keys, _ = sqlserver.sample_fields(read, "dbo", "we]ird")
    assert (chosen, left_out, keys) == (["id", "name", "flag", "long"], ["doc"], ["id"])
    sample = sqlserver.sample_rows(read, "dbo", "we]ird", 5).collect()
    assert len(sample) == 5 and sample[0].long == "x" * 256 + "…" and "[we]]ird]" in asked[-1]
    got = {r.column_name: r for r in sqlserver.profile_object(read, "dbo", "we]ird", 40).collect()}
    assert (got["name"].non_null, got["name"].null_count, got["id"].distinct_count, got["doc"].status, got["id"].complete, got["id"].rows_profiled) == (26, 14, 40, "omitted", False, 40)
    r = sqlserver.probe_relationships(read, [(("dbo", "child", "weird_id"), ("dbo", "we]ird", "id"))], 1000).first()
    assert (r.source_distinct, r.target_distinct, r.overlap, r.target_uniqueness) == (60, 50, 50, 1.0)
    with pytest.raises(ValueError):
        sqlserver.sample_fields(read, "dbo", "nothing")
    with pytest.raises(ValueError):
        sqlserver.profile_object(read, "dbo", "child", 100_001)


def test_server_targets():
    got = sqlserver.parse_target("mssql+pymssql://us%40er:p%3Aw@host/db")
    assert got["user"] == "us@er" and got["password"] == "p:w" and "host:1433;databaseName=db" in got["url"]
    assert "databaseName=other" in sqlserver.parse_target("mssql+pymssql://u:p@host:99/db", "other")["url"]
    for bad in ("postgres://u:p@h/d", "mssql+pymssql://h/d", "mssql+pymssql://u:p@h"):
        with pytest.raises(ValueError):
            sqlserver.parse_target(bad)
    assert sqlserver.quoted("a]b") == "[a]]b]"


# semantic imports


def _ossie():
    field = lambda n, e: {"name": n, "expression": {"dialects": [{"dialect": "ANSI_SQL", "expression": e}]}}
    return {"version": "0.2.0", "semantic_model": [{"name": "sales", "datasets": [{"name": "fact", "source": "hive.main.orders", "primary_key": ["key"], "fields": [field("key", "o_orderkey"), field("buyer", "o_custkey"), {"name": "none"}]}, {"name": "client", "source": "customer", "fields": [field("id", "c_custkey")]}], "relationships": [{"name": "r", "from": "fact", "to": "client", "from_columns": ["o_custkey"], "to_columns": ["c_custkey"]}, {"name": "lost", "from": "fact", "to": "ghost", "from_columns": ["a"], "to_columns": ["b"]}], "metrics": [field("total", "SUM(x)")], "future": 1, "custom_extensions": [1]}]}


def test_ossie(spark):
    got = semantic.read_import("shop", "ossie", {"m.json": json.dumps(_ossie())})
    assert {k: len(v) for k, v in got.rows.items()} == {"models": 1, "datasets": 2, "fields": 4, "metrics": 1, "relationships": 2, "diagnostics": 4} and got.version == "0.2.0"
    assert {r[1] for r in got.rows["diagnostics"]} == {"missing_expression", "unknown_relationship_dataset", "unknown_key", "preserved_custom_extensions"}
    keys = spark.createDataFrame([("main", "orders", "fk", ["o_custkey"], "main", "customer", ["c_custkey"])], fx.RELATIONSHIPS.df(spark).schema)
    from estatelens.operators import semantics

    bound, notes = semantics.bind(got.tables(spark), fx.OBJECTS.df(spark), fx.FIELDS.df(spark), keys, "hive")
    assert {(r.kind, r.target) for r in bound.collect()} == {("dataset", "main.orders"), ("dataset", "main.customer"), ("field", "o_orderkey"), ("field", "o_custkey"), ("field", "c_custkey"), ("relationship", "fk")}
    assert notes.where("code like '%_not_bound'").count() == 2
    with pytest.raises(ValueError):
        semantic.read_import("x", "ossie", {"a": json.dumps({"version": "1"})})


def test_sml_and_bundles(tmp_path):
    files = {"catalog.yml": {"unique_name": "c", "object_type": "catalog", "version": 1.6}, "d/fact.yml": {"unique_name": "fact", "object_type": "dataset", "table": "orders", "columns": [{"name": "key", "data_type": "long"}, {"name": "v", "sql": "a + b"}]}, "m.yml": {"unique_name": "Sum", "object_type": "metric", "calculation_method": "sum", "dataset": "fact", "column": "v"}, "x.yml": {"object_type": "dimension", "unique_name": "q"}}
    for name, x in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(x))
    bundle = semantic.read_bundle(str(tmp_path))
    assert list(bundle) == sorted(files)
    got = semantic.read_import("shop", "sml", bundle)
    assert got.version == "1.6" and [r[4] for r in got.rows["metrics"]] == ["SUM(fact.v)"] and [r[5] for r in got.rows["fields"]] == ["key", "a + b"]
    assert {r[1] for r in got.rows["diagnostics"]} == {"preserved_object", "model_synthesized"}
    assert got.sha256 == semantic.read_import("shop", "sml", dict(reversed(bundle.items()))).sha256
    with pytest.raises(ValueError):
        semantic.read_bundle(str(tmp_path), (".none",))


def test_structured_texts():
    pytest.importorskip("yaml")
    assert semantic.structured("a: 1\nb: [x]\n") == {"a": 1, "b": ["x"]}
    for bad in ("a: 1\na: 2\n", '{"a": 1, "a": 2}', "- 1\n"):
        with pytest.raises(ValueError):
            semantic.structured(bad)


# search and index


def test_index_is_resumed_and_goes_stale(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"object:{i % 5}", None, "ns", f"l{i}", f"word{i} common {'rare' if i == 7 else 'plain'}") for i in range(40)], "id string, object_id string, field_id string, namespace string, label string, text string")
    index = search.Index(spark, str(tmp_path / "i"))
    assert index.status()["identity"] is None
    index.build(docs, batches=4, stop_after=2)
    missing = index.status()["missing"]
    assert 0 < missing < 40
    with pytest.raises(ValueError, match="not built"):
        index.load()
    with pytest.raises(ValueError, match="another identity"):
        index.build(docs.limit(3))
    made = []

    def embed(df):
        made.append(df.count())
        return search.hashed_embedding(df)

    index.build(docs, embed, batches=4)
    assert sum(made) == missing and index.status()["missing"] == 0 and index.load(docs).count() == 40
    with pytest.raises(ValueError, match="stale"):
        index.load(docs.limit(39))
    loaded = index.load()
    best = search.ranked(loaded, "rare", "vector", 5).orderBy(F.desc("score"), "id").first()
    assert best.id == "d7"
    hits = search.search(loaded, "rare common", "hybrid", 3, "NS").collect()
    assert hits[0].object_id == "object:2" and hits[0].sources == "bm25+vector" and hits[0].matched == "common,rare"
    only = spark.createDataFrame([("object:1",)], "object_id string")
    assert [r.object_id for r in search.search(loaded, "common", "bm25", 10, None, only).collect()] == ["object:1"]
    with pytest.raises(ValueError):
        search.search(docs, "x", "vector")
    with pytest.raises(ValueError):
        search.search(docs, "x", "bm25", 101)


def test_revisions_do_not_depend_on_the_order(spark):
    a = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i int, t string")
    assert search.revision(a) == search.revision(a.repartition(7).select("t", "i")) != search.revision(a.where("i < 49"))


# traces


def _tiny(spark):
    definitions = spark.createDataFrame([("n", "d1", "x1", "load", "etl.load", "procedure", None), ("n", "d2", "x2", "report", "rep.report", "query", None)], "document string, definition string, external_id string, name string, qualified_name string, kind string, summary string")
    claims = spark.createDataFrame([("n", "c1", "d2", "read", "[DW] . sales", "draft"), ("n", "c2", "d1", "read", "raw.orders", "validated"), ("n", "c3", "d2", "read", "old.thing", "rejected")], "document string, claim string, definition string, operation string, target string, state string")
    made = spark.createDataFrame([("n", "m1", "d1", "dw.sales", "table", "validated")], "document string, materialization string, definition string, target string, mode string, state string")
    writes = spark.createDataFrame([("n", "u1", "d1", "raw.orders", "validated", "dw.sales", "lookup", 1)], "document string, unit string, definition string, target string, state string, source string, role string, line int")
    return network.definition_nodes(definitions), claims, made, writes


def test_traces(spark):
    nodes, edges = network.network(*_tiny(spark))
    t = network.trace_upstream(nodes, edges, "REP.report")
    hops = {(r.depth, r.source, r.target, r.relation, r.cycle) for r in t.hops.collect()}
    assert hops == {(1, "external:dw.sales", "lineage:n:d2", "reads_from", False), (2, "lineage:n:d1", "external:dw.sales", "materializes_as", False), (3, "external:raw.orders", "lineage:n:d1", "reads_from", False), (4, "external:dw.sales", "external:raw.orders", "derived_from", True)}
    warnings = {r.warning for r in t.warnings.collect()}
    assert network.UNVALIDATED in warnings and any("cycle" in w for w in warnings) and any("Unresolved upstream reference: raw.orders" in w for w in warnings) and t.origins.count() == 0
    short = network.trace_upstream(nodes, edges, "rep.report", 2)
    assert short.truncated and any("max_hops=2" in r.warning for r in short.warnings.collect())
    only = network.network(*_tiny(spark), states=("validated",))
    assert network.trace_upstream(*only, "rep.report").warnings.first().warning == network.NOTHING
    for bad in ("nothing", " "):
        with pytest.raises(ValueError):
            network.trace_upstream(nodes, edges, bad)
    with pytest.raises(ValueError, match="states"):
        network.network(*_tiny(spark), states=("known",))


def test_ambiguity_is_refused(spark):
    nodes, *items = _tiny(spark)
    twin = nodes.limit(1).select(F.lit("lineage:m:d9").alias("id"), F.lit("x").alias("reference"), "name", "kind", "source", "description", F.array(F.lit("raw.orders")).alias("aliases"))
    both = nodes.unionByName(twin).unionByName(twin.withColumn("id", F.lit("lineage:k:d9")))
    with pytest.raises(ValueError, match="ambiguous"):
        network.network(both, *items)
    with pytest.raises(ValueError, match="several"):
        network.start_of(both, "RAW . orders")


# reviews, workspaces, knowledge


def test_texts_that_name_a_reference(spark):
    rows = [("dw.sales", "from [DW] . [Sales] x", True), ("dw.sales", "from dw.sales2", False), ("my table", 'from "my  table"', True), ("a.b", "select xa.b", False), ("#tmp", "into #tmp", True), ("", "x", False), ("we+ird", "from we+ird", True)]
    df = spark.createDataFrame(rows, "r string, t string, want boolean")
    assert [(r.r, r.got) for r in df.select("r", review.present(F.col("r"), F.col("t")).alias("got")).collect()] == [(r, w) for r, _, w in rows]


def test_states_of_annotations():
    assert review.selected_states(validated_only=True) == ("validated",) and review.selected_states() == review.VISIBLE
    for bad in ({"states": ("x",)}, {"states": ()}, {"states": ("draft",), "validated_only": True}):
        with pytest.raises(ValueError):
            review.selected_states(**bad)


def test_tied_decisions_on_relationships(spark):
    edges = spark.createDataFrame([(i, "relationship_candidate", "draft", None) for i in "abc"], "id string, type string, state string, reason string")
    rows = [("a", 1, "reject", "a claim"), ("a", 1, "reject", "unknown"), ("a", 0, "validate", "A"), ("b", 2, "reject", "x"), ("b", 2, "validate", "a"), ("b", None, "validate", "a"), ("c", -1, "reject", "x"), ("c", 3, "validate", "z")]
    want = {("a", "rejected", "a claim"), ("b", "rejected", "x"), ("c", "validated", "z")}
    for order in (rows, rows[::-1]):
        decisions = spark.createDataFrame(order, "id string, seq int, decision string, reason string").coalesce(1)
        assert {(r.id, r.state, r.reason) for r in review.decide_relationships(edges, decisions).collect()} == want


def test_tied_decisions_take_the_shortest_reason(spark):
    edges = spark.createDataFrame([(i, "relationship_candidate", "draft", None) for i in "ab"], "id string, type string, state string, reason string")
    rows = [("a", 1, "reject", "because of c1499983"), ("a", 1, "reject", " unknown "), ("b", 1, "reject", "unknown"), ("b", 13, "reject", "because of c3")]
    for order in (rows, rows[::-1]):
        decisions = spark.createDataFrame(order, "id string, seq int, decision string, reason string").coalesce(1)
        assert {tuple(r) for r in review.decide_relationships(edges, decisions).select("id", "reason").collect()} == {("a", "unknown"), ("b", "because of c3")}


def test_knowledge_evidence(spark):
    docs = spark.createDataFrame([("k1", "r1")], "id string, revision string")
    cites = spark.createDataFrame([("a", "knowledge_document", "k1@r1"), ("b", "knowledge_document", "k1@old"), ("c", "comment", "k1@r1"), ("d", "comment", "see knowledge_document k1"), ("e", "comment", "line 4")], "id string, source string, reference string")
    assert {(r.rule, r.key) for r in review.knowledge_evidence_violations(cites, docs).collect()} == {("exact_reference", "b"), ("cited_as_knowledge", "c"), ("cited_as_knowledge", "d")}


def test_scopes_of_knowledge(spark):
    values = ["global", " system:ERP", "graph:g", "schema:g:ns", "object:g:ns.t:x", "schema:g", "galaxy:g", "system:", "object::x"]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", workspaces.parse_scope(F.col("v")).alias("s")).orderBy("i").collect()]
    assert [tuple(s) if s else None for s in got] == [("global", None, "*"), ("system", None, "ERP"), ("graph", None, "g"), ("schema", "g", "ns"), ("object", "g", "ns.t:x"), None, None, None, None]


def test_knowledge_applies_once_without_a_shuffle_of_pairs(spark):
    nodes = [("g", "o1", "ns.t1", "t1", "NS"), ("g", "o1", "other.t1", "t1", "other"), ("g", "o2", "o2", "o2", "ns"), ("H", "o1", "x", "t1", None), ("H", "o1", "x", "t1", None), (None, "o3", "y", "y", "ns")]
    docs = [
        ("a", "global", "*", None, None), ("a", "graph", "g", None, None), ("a", "schema", "ns", "g", None), ("b", "graph", "G", None, None), ("b", "object", "t1", "G", None), ("b", "object", "t1", "h", None), ("b", "system", "erp", None, "Home"),
        ("c", "schema", "NS", "g", None), ("c", "schema", "other", "g", None), ("c", "object", "O1", "G", None), ("c", "object", "o1", "g", None), ("d", "object", "T1", "h", None), ("e", "system", "ERP", None, "away"), ("f", "schema", None, "g", None),
        (None, "global", "*", None, None), (None, "graph", "g", None, None), (None, "schema", "ns", "g", None), ("b", "graph", "G", None, None),
    ]
    n = spark.createDataFrame(nodes, "graph string, id string, label string, name string, namespace string")
    d = spark.createDataFrame(docs, "id string, kind string, reference string, graph string, workspace string")
    out = workspaces.applies(d, n, spark.createDataFrame([("ERP", "h")], "system string, graph string"), "home")
    places = {x[:2] for x in nodes}
    want = {(i, *p) for i in ("a", None) for p in places} | {("b", "g", "o1"), ("b", "g", "o2"), ("b", "H", "o1"), ("c", "g", "o1"), ("c", "g", "o2"), ("d", "H", "o1")}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    one = [tuple(r) for r in out.where("graph = 'g' and node = 'o2'").collect()]
    assert sorted(one, key=str) == sorted((x for x in want if x[1:] == ("g", "o2")), key=str)
    # what is shuffled above the pairs of everything: nothing
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate") and plan.startswith("Union")


def test_knowledge_applies_in_blocks(spark, monkeypatch):
    for k, v in (("DOCUMENTS", 5), ("NODES", 4), ("RUN", 2)):
        monkeypatch.setattr(workspaces, k, v)
    nodes = [(g, f"o{i}" if i else None, f"ns{i % 2}.t{i}", f"T{i}", f"ns{i % 2}" if i % 5 else None) for g in ("g", "H", None) for i in range(11)]
    docs = [(f"d{i}", *[("global", "*", None, None), ("graph", "G", None, None), ("graph", "h", None, None), ("schema", "NS1", "g", None), ("object", f"t{i % 11}", "H", None), ("system", "erp", None, "home"), ("schema", "ns0", "h", None)][i % 7]) for i in range(30)]
    docs += [(None, "global", "*", None, None), ("d3", "schema", "ns0", "G", None), ("d4", "object", "o2", "h", None)]

    def speaks(d, n):
        low = lambda x: x and x.lower()
        kind, ref, graph = d[1], low(d[2]), low(d[3])
        return kind == "global" or (n[0] is not None and ((kind == "system" and low(n[0]) == "h") or (kind == "graph" and ref == low(n[0])) or (graph == low(n[0]) and ((kind == "schema" and ref == n[4]) or (kind == "object" and ref in map(low, n[1:4]))))))

    want = {(d[0], *n[:2]) for d in docs for n in nodes if speaks(d, n)}
    n = spark.createDataFrame(nodes, "graph string, id string, label string, name string, namespace string")
    d = spark.createDataFrame(docs, "id string, kind string, reference string, graph string, workspace string")
    systems = spark.createDataFrame([("ERP", "h")], "system string, graph string")
    got = [tuple(r) for r in workspaces.applies(d, n, systems, "home").collect()]
    assert len(got) == len(want) and set(got) == want
    assert workspaces.applies(d, n.where("id = 'none'"), systems, "home").count() == 0 and workspaces.applies(d.where("id = 'none'"), n, systems, "home").count() == 0


def test_knowledge_applies_leaves_small_files(spark, tmp_path):
    # more nodes than are sent to every task, and names too long for one dictionary of a file: 1.3 MB
    nodes = spark.range(10_000).selectExpr("'g' graph", "md5('a' || id) || md5('b' || id) || md5('c' || id) || md5('d' || id) id", "'ns.t' || id label", "'t' || id name", "'ns' namespace")
    docs = spark.range(60).selectExpr("'k' || id id", "'graph' kind", "'g' reference", "cast(null as string) graph", "cast(null as string) workspace")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = workspaces.applies(docs, nodes, spark.createDataFrame([], "system string, graph string"), "home")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out.write.parquet(path := str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.read.parquet(path).count() == 600_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 8_000_000


def test_cues_of_key_segments(spark):
    rows = [("KST{digits_1:6}KTO{digits_2:6}", 2, "D_KTO", "KTO_ID", True), ("KST{digits_1:6}KTO{digits_2:6}", 1, "D_KTO", "KTO_ID", False), ("PRT{digits_1:5}", 1, "Product_Ref_Table", "ID", True), ("{digits_1:5}", 1, "X", "X", False), ("A{digits_1:5}", 1, "A", "A", False), ("KEY{digits_1:3}", 1, "D_KEY", "KEY", False)]
    df = spark.createDataFrame(rows, "p string, i int, o string, f string, want boolean")
    assert [r.got for r in df.select(relationships.matches_target(F.col("p"), F.col("i"), F.col("o"), F.col("f")).alias("got")).collect()] == [w for *_, w in rows]


def test_cycles_of_steps(spark):
    assert constraints.acyclic(spark.createDataFrame([("a", 1, None), ("b", 2, "a")], "step string, position int, dependency string"))
    assert not constraints.acyclic(spark.createDataFrame([("a", 1, "b"), ("b", 2, "a")], "step string, position int, dependency string"))


# context


def test_prefixes_and_parts():
    objects = [{"object": o, "fields": ["k"]} for o in ("b", "A", "c")]
    joins = [context.joined({"id": f"j{i}", "type": t, "state": s, "source": a, "target": b, "from_fields": ["k"], "to_fields": ["k"]}) for i, (t, s, a, b) in enumerate([("relationship_candidate", "validated", "A", "b"), ("foreign_key", None, "b", "c"), ("relationship_candidate", "draft", "A", "c")])]
    assert joins[2] is None
    p = context.prefix(objects, joins[:2], 2, 5)
    assert [o["object"] for o in p.objects] == ["A", "b"] and [j["id"] for j in p.joins] == ["j0"] and p.omitted["objects"] == 1
    one, two = context.split(p, "g", "r", "first"), context.split(p, "g", "r", "second")
    assert one.stable == two.stable and one.dynamic_hash != two.dynamic_hash and one.packet_hash != two.packet_hash
    stable = context.verified(one.stable)
    assert "A(k) -> b(k)" in context.stable_prompt(stable, [{"graph": "g"}]) and "Question: first" in context.dynamic_prompt(context.verified(one.dynamic))
    with pytest.raises(ValueError, match="hash"):
        context.verified(one.stable.replace('"k"', '"q"', 1))
    with pytest.raises(ValueError):
        context.prefix([], [])


# the engine's groups


def test_engine_groups(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "state"))
    before, after = ([t.df(spark) for t in v] for v in (fx.RETAIL_1, fx.RETAIL_2))
    e.graphs.import_catalog("shop", *before)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        e.graphs.import_catalog("shop", *before)
    assert e.graphs.list() == ["shop"] and e.search("shop", "sls").count() > 0
    candidates = spark.createDataFrame([("c1", "main.F_SLS_01", "NET_AMT", "main.F_SLS_02", "NET_AMT", "validated"), ("c2", "main.D_RSLR", "TERR_CD", "main.D_GEO", "TERR_CD", "draft")], "id string, from_object string, from_field string, to_object string, to_field string, state string")
    revision = e.graphs.revision("shop")
    r = e.graphs.refresh("shop", *after, fx.ANNOTATIONS.df(spark), candidates)
    assert {x.id: x.state for x in r.carried["candidates"].collect()} == {"c1": "review_required"} and e.graphs.revision("shop") != revision
    assert {(x.name, x.n) for x in r.counts.collect()} >= {("removed_relationships", 2), ("review_required_relationships", 1)} and len(e.list("changes/shop")) == 1
    e.sources.configure("db", "sqlite", "env:NO_SUCH_VARIABLE", "shop", ("aggregates", "raw_samples"))
    assert e.sources.check("db") == {"available": True, "configured": False} and e.sources.for_graph("shop")["name"] == "db"
    for bad in (("x y", "sqlite", "env:A"), ("x", "oracle", "env:A"), ("x", "sqlite", "sqlite:///secret")):
        with pytest.raises(ValueError):
            e.sources.configure(*bad, "shop")
    tables = demo.retail(spark)
    found = e.sources.enrich("db", {"D_PRD": tables["D_PRD"]}, {})
    assert found["profiles"].count() == 5 and found["failed"].count() == 0
    stable, dynamic = e.grounding("shop", "sls amounts")
    assert "source=db" in stable and "Question: sls amounts" in dynamic and "not requested" in dynamic
    assert len(e.contexts.prefix("shop").objects) == 12


def test_engine_lineage_focus_and_knowledge(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "state"))
    definitions = spark.createDataFrame([("n", "d1", "x1", "load", "etl.load", "procedure", None), ("n", "d2", "x2", "report", "rep.report", "query", None)], "document string, definition string, external_id string, name string, qualified_name string, kind string, summary string")
    _, claims, made, writes = _tiny(spark)
    steps = spark.createDataFrame([("s1", "d1", 2, None), ("s2", "d2", 1, "s1")], "step string, definition string, position int, dependency string")
    e.lineages.save("n", definitions=definitions, steps=steps, claims=claims, units=writes, materializations=made)
    assert e.lineages.list() == ["n"] and [r.step for r in e.lineages.process("n").orderBy("place").collect()] == ["s1", "s2"]
    assert {r.id for r in e.lineages.reviews("n", ("draft",)).collect()} == {"c1"}
    e.lineages.decide("n", "claims", "claim", spark.createDataFrame([("c1", 1, "validate", "checked")], "id string, seq int, decision string, reason string"))
    assert e.lineages.reviews("n", ("draft",)).count() == 0
    with pytest.raises(ValueError, match="reason_given"):
        e.lineages.decide("n", "claims", "claim", spark.createDataFrame([("c1", 1, "reject", "")], "id string, seq int, decision string, reason string"))
    assert e.lineages.find("n", "report").first().id == "lineage:n:d2"
    trace = e.lineages.upstream("n", "rep.report")
    sources = spark.createDataFrame([("lineage", "n", "r1")], "kind string, name string, revision string")
    assert e.focuses.build("f", trace, sources).count() == 4 and e.focuses.list() == ["f"]
    with pytest.raises(ValueError, match="stale"):
        e.focuses.load("f", sources.withColumn("revision", F.lit("r2")))
    (tmp_path / "a.md").write_text("orders are counted daily")
    e.knowledge.add("k1", "graph:shop", str(tmp_path / "a.md"))
    nodes = spark.createDataFrame([("shop", "o1", "main.orders", "orders", "main")], "graph string, id string, label string, name string, namespace string")
    none = spark.createDataFrame([], "system string, graph string")
    taken, left = e.knowledge.resolve(nodes, none, "w", "shop", "o1", 11)
    assert [(r.id, r.content, r.truncated) for r in taken.collect()] == [("k1", "orders are ", True)] and left.count() == 0
    for bad in (("k 2", "global"), ("k2", "galaxy:x")):
        with pytest.raises(ValueError):
            e.knowledge.add(*bad, str(tmp_path / "a.md"))
    with pytest.raises(ValueError, match="knowledge_not_found"):
        e.knowledge.resolve(nodes, none, "w", "shop", "o1", asked=("zz",))
    e.lineages.import_runtime("log", fx.RUNTIME.df(spark))
    assert e.lineages.trace_runtime("log", "p1")[0].count() == 4
    with pytest.raises(ValueError, match="the log breaks"):
        e.lineages.import_runtime("bad", fx.BROKEN.df(spark))


def test_engine_workspaces_and_semantics(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "state"))
    e.workspaces.create("w")
    objects = spark.createDataFrame([("g", "o1", "table", "main.orders", "main", "orders"), ("g", "o2", "table", "aux.x", "aux", "x")], "graph string, id string, type string, label string, namespace string, name string")
    e.workspaces.define("w", "systems", spark.createDataFrame([("erp", "g")], "system string, graph string"), objects)
    e.workspaces.define("w", "areas", spark.createDataFrame([("erp", "sales", "g", "main")], "system string, area string, graph string, namespace string"), objects)
    with pytest.raises(ValueError, match="zone_schema_assigned"):
        e.workspaces.define("w", "zones", spark.createDataFrame([("erp", "z", "g", "o2")], "system string, zone string, graph string, object_id string"), objects)
    e.workspaces.define("w", "zones", spark.createDataFrame([("erp", "z", "g", "o1")], "system string, zone string, graph string, object_id string"), objects)
    assert [r.object_id for r in e.workspaces.scope("w", objects, [("zone", "z"), ("system", "erp")]).collect()] == ["o1"]
    assert e.workspaces.zone("w", objects, "erp", "z").first().area == "sales"
    with pytest.raises(ValueError, match="zone_not_found"):
        e.workspaces.scope("w", objects, [("zone", "none")])
    e.graphs.build("g", fx.OBJECTS.df(spark), fx.FIELDS.df(spark), fx.RELATIONSHIPS.df(spark))
    found = e.searches.workspace(spark.createDataFrame([("g", "orders")], "graph string, object_id string"), "orders")
    assert [r.label for r in found.collect()] == ["g:orders"]
    # a hit in scope behind 150 better ones out of it, in every mode
    many = fx.OBJECTS.df(spark).limit(0).unionByName(spark.createDataFrame([("main", f"sales_{i:03}", "table", "", "sales orders net") for i in range(150)] + [("main", "zz", "table", "", "net")], fx.OBJECTS.df(spark).schema))
    e.graphs.build("big", many, fx.FIELDS.df(spark).limit(0), fx.RELATIONSHIPS.df(spark).limit(0))
    wide = spark.createDataFrame([("big", "zz"), ("g", "orders")], "graph string, object_id string")
    assert [r.label for r in e.searches.workspace(wide, "sales orders net").collect()] == ["g:orders", "big:zz"]
    docs = many.select(F.lit("big").alias("graph"), F.concat(F.lit("object:"), "object").alias("id"), F.col("object").alias("object_id"), F.lit(None).cast("string").alias("field_id"), F.col("object").alias("label"), F.col("description").alias("text"))
    for mode in ("bm25", "vector", "hybrid"):
        found = search.workspace_search(search.hashed_embedding(docs), wide, "sales orders net", 20, mode).collect()
        assert [(r.graph, r.object_id) for r in found] == [("big", "zz")] and found[0].sources == ("bm25+vector" if mode == "hybrid" else mode)
    with pytest.raises(ValueError, match="mode"):
        search.workspace_search(docs, wide, "net", mode="exact")
    # contexts: validated candidates are joins, others are not, and what is left out is counted
    made = [("c1", "orders", "part", ["o_orderkey"], ["p_partkey"], "validated", "profile"), ("c2", "orders", "region", ["o_orderkey"], ["r_regionkey"], "draft", "profile")]
    candidates = spark.createDataFrame(made, "id string, source string, target string, from_fields array<string>, to_fields array<string>, state string, origin string")
    plain, packet = e.contexts.graph("g", "orders"), e.contexts.graph("g", "orders", candidates=candidates)
    fresh = {j["id"] for j in packet.joins} - {j["id"] for j in plain.joins}
    assert "c1" in fresh and "c2" not in fresh and {j["kind"] for j in packet.joins} == {"foreign_key", "candidate"}
    e.contexts.JOINS = 1
    assert e.contexts.graph("g", "orders", candidates=candidates).omitted["joins"] > packet.omitted["joins"]
    (tmp_path / "m.json").write_text(json.dumps(_ossie()))
    counts = e.semantics.import_files("shop", "ossie", str(tmp_path / "m.json"), "g")
    assert counts["bindings"] == 2 and e.semantics.list("g") == ["shop"] and e.semantics.list("other") == []
    for text in ("first", "second"):
        e.semantics.edit("shop", "model:sales", text, "known better")
    assert e.semantics.targets("shop").where("id = 'model:sales'").first().description == "second"
    with pytest.raises(ValueError):
        e.semantics.edit("shop", "model:nothing", "x", "y")


def test_sources_of_usable_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("nan"), 0.0]), (4, [1.0])], "vec_id int, embedding array<double>")
    assert [r.vec_id for r in retrieval.vector_topk(v, [1.0, 0.5]).collect()] == [1, 2]


def test_relationships_bind_to_the_one_key_spelt_alike(spark):
    from estatelens.operators import semantics

    objects = spark.createDataFrame([("main", "a"), ("main", "b")], "namespace string, object string")
    fields = spark.createDataFrame([("main", t, c) for t in "ab" for c in ("k", "K2")], "namespace string, object string, field string")
    rels = spark.createDataFrame([("main", "a", "fk", ["k"], "main", "b", ["k"]), ("main", "b", "f1", ["K2"], "main", "a", ["k"]), ("main", "b", "f2", ["K2"], "main", "a", ["k"])], "namespace string, object string, name string, from_fields array<string>, to_namespace string, to_object string, to_fields array<string>")
    tables = {
        "datasets": spark.createDataFrame([("da", "a", "m", "A", "ra"), ("db", "b", "m", "B", "rb"), ("dc", "c", "m", "C", "rc")], "id string, source string, model string, name string, source_reference string"),
        "fields": spark.createDataFrame([("fa", "da", "k", "rf")], "id string, dataset string, expression string, source_reference string"),
        "relationships": spark.createDataFrame([("one", "m", "A", "B", ["k"], ["k"], "r1"), ("case", "m", "A", "B", ["K"], ["k"], "r2"), ("two", "m", "B", "A", ["K2"], ["k"], "r3"), ("lost", "m", "A", "C", ["k"], ["k"], "r4")], "id string, model string, from_dataset string, to_dataset string, from_fields array<string>, to_fields array<string>, source_reference string"),
        "diagnostics": spark.createDataFrame([], "level string, code string, source_reference string"),
    }
    bound, notes = semantics.bind(tables, objects, fields, rels, "cat")
    assert {(r.id, r.target) for r in bound.where("kind = 'relationship'").collect()} == {("one", "fk")}
    assert {(r.code, r.source_reference) for r in notes.collect()} == {("dataset_not_bound", "rc"), ("relationship_not_bound", "r2"), ("relationship_binding_ambiguous", "r3"), ("relationship_not_bound", "r4")}
