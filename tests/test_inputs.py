"""Lineage inputs, manual overlays, runtime logs, providers, manifests and commands."""

import json

import pytest
from pyspark.sql import functions as F

from estatelens import __main__ as commands
from estatelens import fixtures as fx
from estatelens.engine import Engine
from estatelens.functions import text as X
from estatelens.operators import network, views
from estatelens.plans import providers
from estatelens.sources import lineage_input, manifests


def _input(**changes):
    define = lambda n: {"content": f"insert into dw.{n} select * from raw.{n}", "external_id": f"x{n}", "kind": "procedure", "language": "tsql", "name": n, "qualified_name": f"etl.{n}", "source_reference": f"{n}.sql"}
    data = {
        "format_version": "2", "source": {"kind": "files", "name": "nightly", "reference": "repo"}, "definitions": [define("a"), define("b")],
        "workflow": {"external_id": "w", "name": "nightly", "steps": [{"definition_id": "xa", "depends_on": [], "external_id": "s1", "name": "a"}, {"definition_id": "xb", "depends_on": ["s1"], "external_id": "s2", "name": "b"}]},
        "materializations": [{"definition_id": "xb", "mode": "table", "source_reference": "b.sql", "target": "dw.b"}],
        "observations": [{"definition_id": "xb", "line_end": 1, "line_start": 1, "operation": "read", "reason": "seen", "source_reference": "b.sql", "target": "raw.b"}],
    }
    return json.dumps(data | changes)


def test_lineage_inputs(spark):
    t = lineage_input.build(spark, "n", _input())
    assert {k: v.count() for k, v in t.items()} == {"definitions": 2, "steps": 2, "claims": 1, "materializations": 1, "workflow": 1}
    again = lineage_input.build(spark, "n", _input())
    assert t["claims"].collect() == again["claims"].collect() and t["workflow"].first().revision == again["workflow"].first().revision
    row = spark.range(1).select(X.stable_id(F.lit("step"), "workflow", F.lit("s1")).alias("x")).first().x
    assert row.rpartition(":")[2] != "" and t["steps"].orderBy("position").first().step == lineage_input.stable_id("step", "workflow", "s1")
    w = json.loads(_input())["workflow"]
    bad = [
        ({"more": 1}, "unknown parts"), ({"definitions": []}, "list"), ({"materializations": json.loads(_input())["materializations"] * 2}, "one_materialization"),
        ({"workflow": w | {"steps": [w["steps"][0] | {"depends_on": ["s2"]}, w["steps"][1]]}}, "cycle"), ({"workflow": w | {"steps": [w["steps"][0] | {"definition_id": "zz"}]}}, "step_definition_known"),
        ({"observations": [json.loads(_input())["observations"][0] | {"line_end": 0}]}, "lines_ordered"), ({"observations": [json.loads(_input())["observations"][0] | {"operation": "write"}]}, "operation_known"),
    ]
    for change, what in bad:
        with pytest.raises(ValueError, match=what):
            lineage_input.build(spark, "n", _input(**change))
    nodes, edges = network.network(network.definition_nodes(t["definitions"]), t["claims"], t["materializations"], spark.createDataFrame([], "document string, unit string, definition string, target string, state string, source string, role string, line int"))
    assert network.trace_upstream(nodes, edges, "dw.b").hops.count() == 2


def test_manual_overlays(spark):
    jobs = spark.createDataFrame([("script", "load", "Ops.Load", "python", "wiki", "loads it")], "kind string, name string, qualified_name string, language string, source_reference string, description string")
    definitions, steps = lineage_input.manual_jobs("manual:ops", jobs)
    assert definitions.first().external_id == "manual:Ops.Load" and steps.count() == 1
    with pytest.raises(ValueError):
        lineage_input.manual_jobs("n", jobs)
    hops = spark.createDataFrame([("ops.load", "insert", "dw.t", "raw.s", "told"), ("OPS.LOAD", "read", None, "raw.q", "told"), ("none", "read", None, "x", "told"), ("ops.load", "insert", "DW.T", "RAW.S", "told"), ("ops.load", "insert", "dw.u", "raw.s", " ")], "job string, operation string, target string, source string, reason string")
    claims, writes, bad = lineage_input.manual_hops("manual:ops", definitions, hops)
    assert [r.target for r in claims.collect()] == ["raw.q"] and {r.state for r in writes.collect()} == {"draft"}
    assert {r.rule for r in bad.collect()} == {"hop_job_known", "reason_given", "hop_unique"}


def test_analysis_failures_take_the_place(spark):
    analyses = spark.createDataFrame([("d1", "r"), ("d2", "r")], "definition string, revision string")
    failed = spark.createDataFrame([("d3", "r", "old"), ("d2", "r", "old")], "definition string, revision string, code string")
    new = spark.createDataFrame([("d2", "r", "timeout")], "definition string, revision string, code string")
    a, f = lineage_input.failures(analyses, failed, new)
    assert [r.definition for r in a.collect()] == ["d1"] and {(r.definition, r.code) for r in f.collect()} == {("d3", "old"), ("d2", "timeout")}


def test_runtime_logs(spark):
    nodes = spark.createDataFrame([("n1",), ("n2",)], "id string")
    sql = {"sequence": 1, "call_id": "q1", "kind": "sql_query", "operation": "select", "dialect": "duckdb", "status": "succeeded", "inputs": ["n1", "n2"], "result": {"columns": ["a"], "row_count": 3}}
    py = {"sequence": 2, "call_id": "p1", "kind": "python_analysis", "operation": "analyze", "status": "succeeded", "consumes": ["q1"], "executor": {"name": "pandas"}, "result": {"columns": ["a"], "row_count": 1}, "analysis": {"grain": ["day"], "join_coverage": 1.0, "reconciliation_status": "matched"}}
    events, inputs = lineage_input.read_log(spark, json.dumps({"events": [sql, py]}), nodes)
    assert events.count() == 2 and inputs.count() == 2
    for change, rule in (({"inputs": ["n1", "n9"]}, "input_known"), ({"dialect": "oracle"}, "dialect_known"), ({"status": "failed"}, "result_or_error"), ({"result": {"columns": ["a", "A"], "row_count": 1}}, "columns_unique"), ({"sequence": 3}, "sequence_contiguous")):
        with pytest.raises(ValueError, match=rule):
            lineage_input.read_log(spark, json.dumps({"events": [sql | change]}), nodes)
    for bad in (json.dumps({"events": []}), '{"events": [], "events": []}'):
        with pytest.raises(ValueError):
            lineage_input.read_log(spark, bad, nodes)


class Fake:
    name = "fake"

    def __init__(self):
        self.asked = []

    def generate(self, request):
        self.asked.append(request)
        if request["q"] == "down":
            raise OSError
        return {"text": "secret value" if request["q"] == "leak" and "correction" not in request else f"about {request['q']}"}


def test_batches_of_proposals():
    check = lambda a: None if "about" in a["text"] else "no text"
    tasks = [{"id": q, "request": {"q": q}, "protected": ["Secret Value"]} for q in ("one", "leak", "down")]
    fake, cache = Fake(), {"one": {"text": "about the cache"}}
    out = providers.run_batch(tasks, fake, check, retries=1, most_errors=2, cache=cache)
    assert out.answers == {"one": {"text": "about the cache"}, "leak": {"text": "about leak"}} and list(out.failures) == ["down"] and "leak" in cache
    assert [r.get("correction") for r in fake.asked if r["q"] == "leak"] == [None, "a protected value is repeated"]
    with pytest.raises(ValueError, match="down"):
        providers.run_batch(tasks[2:], fake, check)
    with pytest.raises(ValueError):
        providers.run_batch([], fake, check, workers=0)
    assert providers.leaked({"a": ["x", {"b": "the secret VALUE"}]}, ["secret value", "x"]) == "secret value"


def test_manifests():
    text = '[connector]\ncontract_version = 1\nname = "lake"\nversion = "2"\nsource_type = "files"\ncapabilities = ["probe", "discover_catalog"]\ndependencies = ["pyspark", "no_such_package"]\n'
    assert manifests.read_manifest(text).check() == {"pyspark": True, "no_such_package": False}
    assert manifests.manifest("sqlite").dialect == "sqlite"
    for bad in (text.replace("= 1", "= 2"), text.replace('"probe", ', ""), text + 'permissions = ["write"]\n', text + 'more = "x"\n', "a = 1"):
        with pytest.raises(ValueError):
            manifests.read_manifest(bad)
    with pytest.raises(ValueError):
        manifests.manifest("oracle")


def test_commands(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.build_graph("one", *(t.df(spark) for t in fx.RETAIL_1))
    e.build_graph("two", *(t.df(spark) for t in fx.RETAIL_2))
    run = lambda *a: commands.run(e, commands.parser().parse_args(["--root", "x", *a]))
    assert json.loads(run("graphs")) == ["one", "two"] and len(run("changes", "one", "two").splitlines()) == 13
    assert json.loads(run("search", "one", "sls", "--limit", "2").splitlines()[0])["object"]
    assert set(json.loads(run("context", "one", "sls"))) == {"joins", "objects", "paths"} and "# Request" in run("ground", "one", "sls") and len(json.loads(run("prefix", "one"))["objects"]) == 12


def test_payloads_and_assets(spark):
    nodes = spark.createDataFrame([("g", "o", "table", "main.t", None, None, None, "told"), ("g", "f2", "field", "b", "o", 2, "int", None), ("g", "f1", "field", "a", "o", 1, "text", None)], "graph string, id string, type string, label string, parent_id string, position int, data_type string, description string")
    assert json.loads(views.payload(nodes).first().json)["fields"] == [{"label": "a", "data_type": "text"}, {"label": "b", "data_type": "int"}]
    edges = spark.createDataFrame([("e1", "o", "p"), ("e2", "q", "q")], "id string, source_id string, target_id string")
    assert views.asset(nodes, edges, "o").first().fields == "a,b" and views.most_connected(edges).first().degree == 1
    with pytest.raises(ValueError):
        views.asset(nodes, edges, "f1")
