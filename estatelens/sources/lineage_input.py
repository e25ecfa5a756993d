"""Lineage documents: strict inputs of definitions, steps and declared items; manual overlays; logs of runtime calls bound to a graph."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import text as X
from estatelens.operators import constraints
from estatelens.plans.context import canonical

from .catalogs import strict_json

#: What a lineage input holds: its parts, and the keys of their rows.
_PARTS = {"source": "kind name reference", "workflow": "external_id name steps", "definitions": "content external_id kind language name qualified_name source_reference", "materializations": "definition_id mode source_reference target", "observations": "definition_id line_end line_start operation reason source_reference target", "steps": "definition_id depends_on external_id name"}
#: Fixed bounds of a log.
EVENTS, INPUTS, COLUMNS = 1000, 512, 256


def stable_id(namespace: str, kind: str, value: str) -> str:
    """As functions.text.stable_id, for one value."""
    return f"lineage:{namespace}:{hashlib.sha256(f'{kind}{chr(10)}{value}'.encode()).hexdigest()[:24]}"


def _rows(data: dict, part: str, needed: bool = False) -> list[dict]:
    rows = data.get(part, [])
    if not isinstance(rows, list) or (needed and not rows):
        raise ValueError(f"{part} must be a list{' with rows' if needed else ''}")
    for r in rows:
        if not isinstance(r, dict) or set(r) != set(_PARTS[part].split()):
            raise ValueError(f"a row of {part} has the keys {_PARTS[part]}")
    return rows


def read_input(text: str) -> dict:
    """A parsed input; unknown keys, repeated keys and missing parts are refused."""
    data = strict_json(text)
    if not isinstance(data, dict) or set(data) - {"format_version", "definitions", "materializations", "observations", "source", "workflow"}:
        raise ValueError("the input has unknown parts")
    for part in ("source", "workflow"):
        if not isinstance(data.get(part), dict) or set(data[part]) != set(_PARTS[part].split()):
            raise ValueError(f"{part} has the keys {_PARTS[part]}")
    _rows(data, "definitions", True), _rows(data["workflow"], "steps", True), _rows(data, "materializations"), _rows(data, "observations")
    return data


def build(spark: SparkSession, name: str, text: str) -> dict[str, DataFrame]:
    """The tables of a document: definitions, steps, and what the input declares as draft items with evidence.

    Ids follow from external ids, so that the next input of the same workflow meets them. Broken rules raise.
    """
    data = read_input(text)
    ids = {d["external_id"]: stable_id("definition", d["kind"], d["external_id"]) for d in data["definitions"]}
    known = lambda x: ids.get(x, f"unknown:{x}")
    step = lambda x: stable_id("step", "workflow", x)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    definitions = [(name, ids[d["external_id"]], d["external_id"], d["name"], d["qualified_name"], d["kind"], d["language"], d["content"], digest(canonical({**d, "content": digest(d["content"])})), None, d["source_reference"]) for d in data["definitions"]]
    steps = [(step(s["external_id"]), known(s["definition_id"]), i, step(x) if x else None) for i, s in enumerate(data["workflow"]["steps"]) for x in (s["depends_on"] or [None])]
    claims = [(name, stable_id("claim", o["operation"], "\n".join([known(o["definition_id"]), o["target"], o["source_reference"], str(o["line_start"]), str(o["line_end"])])), known(o["definition_id"]), o["operation"], o["target"], "draft", "declared_reference", f"{o['source_reference']}:{o['line_start']}-{o['line_end']}", o["reason"], o["line_start"], o["line_end"]) for o in data.get("observations", [])]
    made = [(name, stable_id("materialization", m["mode"], "\n".join([known(m["definition_id"]), m["target"], m["source_reference"]])), known(m["definition_id"]), m["target"], m["mode"], "draft", m["source_reference"]) for m in data.get("materializations", [])]
    out = {
        "definitions": spark.createDataFrame(definitions, "document string, definition string, external_id string, name string, qualified_name string, kind string, language string, content string, revision string, summary string, source_reference string"),
        "steps": spark.createDataFrame(steps, "step string, definition string, position int, dependency string"),
        "claims": spark.createDataFrame(claims, "document string, claim string, definition string, operation string, target string, state string, source string, reference string, reason string, line_start int, line_end int"),
        "materializations": spark.createDataFrame(made, "document string, materialization string, definition string, target string, mode string, state string, source_reference string"),
        "workflow": spark.createDataFrame([(name, data["source"]["kind"], data["source"]["name"], data["source"]["reference"], data["workflow"]["name"], [s["external_id"] for s in data["workflow"]["steps"]], digest(json.dumps(data, sort_keys=True)))], "document string, source_kind string, source_name string, source_reference string, workflow_name string, steps array<string>, revision string"),
    }
    known_items = out["definitions"].select("definition")
    bad = constraints.definition_violations(out["definitions"], out["steps"]).union(constraints.broken(out["claims"], "claim", "claim")).union(constraints.broken(out["claims"], "evidence", "claim"))
    bad = bad.union(constraints.broken(out["materializations"], "materialization", "materialization")).union(constraints.repeated(out["materializations"], "one_materialization", "definition"))
    for t, key in (("claims", "claim"), ("materializations", "materialization")):
        bad = bad.union(constraints.missing(out[t], f"{key}_definition_known", ["definition"], known_items, key))
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"the input breaks {first[0].rule}: {first[0].key}")
    if not constraints.acyclic(out["steps"]):
        raise ValueError("the input's steps have a cycle")
    return out


def manual_jobs(document: str, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and steps of a person's jobs(kind, name, qualified_name, language, source_reference, description); a manual document's."""
    if not document.startswith("manual"):
        raise ValueError("manual jobs belong to a manual document")
    identity = F.concat_ws("\n", F.lit(document), F.lower("qualified_name"))
    revision = F.sha2(F.to_json(F.struct(*sorted(jobs.columns))), 256)
    definitions = jobs.select(F.lit(document).alias("document"), X.stable_id(F.lit("manual"), "definition", identity).alias("definition"), F.concat(F.lit("manual:"), "qualified_name").alias("external_id"), "name", "qualified_name", "kind", "language", F.lit("").alias("content"), revision.alias("revision"), F.col("description").alias("summary"), "source_reference")
    steps = jobs.select(X.stable_id(F.lit("manual"), "step", identity).alias("step"), X.stable_id(F.lit("manual"), "definition", identity).alias("definition"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("dependency"))
    return definitions, steps


def manual_hops(document: str, definitions: DataFrame, hops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims, materializations and write sources of a person's hops(job, operation, target, source, reason), as drafts, and (rule, key) of those refused.

    A hop without a target is read by its job; one without a source is materialized; with both it is derived.
    """
    met = hops.join(definitions.select("definition", F.lower("qualified_name").alias("q")), F.lower("job") == F.col("q"), "left")
    twice = hops.groupBy(F.lower("job").alias("j"), "operation", F.lower(F.coalesce("target", F.lit(""))).alias("t"), F.lower(F.coalesce("source", F.lit(""))).alias("s")).agg(F.count("*").alias("n")).where("n > 1")
    key = F.concat_ws("|", "job", "operation", "target", "source")
    bad = met.where(F.col("definition").isNull()).select(F.lit("hop_job_known").alias("rule"), key.alias("key")).union(met.where("trim(coalesce(reason, '')) = ''").select(F.lit("reason_given"), key)).union(met.where("target is null and source is null").select(F.lit("hop_ends_given"), key))
    bad = bad.union(twice.select(F.lit("hop_unique"), F.concat_ws("|", "j", "operation", "t", "s")))
    good = met.where("definition is not null and trim(coalesce(reason, '')) <> ''").withColumn("item", F.substring(F.sha2(F.concat_ws("\n", "definition", "operation", "target", "source"), 256), 1, 24))
    claims = good.where("target is null and source is not null").select(F.lit(document).alias("document"), F.concat(F.lit("claim:"), "item").alias("claim"), "definition", F.lit("read").alias("operation"), F.col("source").alias("target"), F.lit("draft").alias("state"))
    writes = good.where("target is not null and source is not null").select(F.lit(document).alias("document"), F.concat(F.lit("write:"), "item").alias("unit"), "definition", "target", F.lit("draft").alias("state"), "source", F.lit("business_data").alias("role"), F.lit(1).alias("line"), "operation")
    return claims, writes, bad


def failures(analyses: DataFrame, failed: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """analyses and failures(definition, revision, code) after new failures, which take the place of what a definition had."""
    return analyses.join(new.select("definition"), "definition", "left_anti"), failed.join(new.select("definition"), "definition", "left_anti").unionByName(new)


def read_log(spark: SparkSession, text: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, inputs) of a runtime log {graph_revision, events: [...]}: events as constraints.event_violations takes them, inputs bound to nodes.

    At most 1,000 events; broken rules and inputs that no node has raise.
    """
    data = strict_json(text)
    events = data.get("events") if isinstance(data, dict) else None
    if not isinstance(events, list) or not 1 <= len(events) <= EVENTS:
        raise ValueError(f"a log has 1 to {EVENTS} events")
    rows, used = [], []
    for e in events:
        result, analysis = e.get("result") or {}, e.get("analysis") or {}
        ids = [x for x in e.get("inputs") or [] if isinstance(x, str)]
        used += [(e.get("call_id"), x) for x in ids]
        rows.append((
            "log", e.get("sequence"), e.get("call_id"), e.get("kind"), e.get("operation"), e.get("dialect") or e.get("engine"), e.get("status"), e.get("error_code"), result.get("row_count"), ",".join(result.get("columns") or []) or None, ",".join(ids), ",".join(e.get("consumes") or []),
            (e.get("executor") or {}).get("name") if isinstance(e.get("executor"), dict) else e.get("executor"), analysis.get("reconciliation_status"), analysis.get("join_coverage"), ",".join(analysis.get("grain") or []),
        ))
    out = spark.createDataFrame(rows, "log string, sequence int, call_id string, kind string, operation string, dialect string, status string, error_code string, row_count long, columns string, inputs string, consumes string, executor string, reconciliation string, join_coverage double, grain string")
    bound = spark.createDataFrame(used, "call_id string, node string")
    bad = constraints.event_violations(out).union(constraints.missing(bound, "input_known", ["node"], nodes.select(F.col("id").alias("node")), "call_id", "node")).limit(1).collect()
    if bad:
        raise ValueError(f"the log breaks {bad[0].rule}: {bad[0].key}")
    return out, bound
