"""Constraint sets as violation queries: (rule, key) of every row that breaks a rule; no rows mean a valid table.

A rule about one row is a condition that broken rows meet, written in SQL that Spark and other engines share; a subject's
row rules are checked in one pass over its table. Rules across rows are aggregations and anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import topological_layers

_STATES = "('draft', 'rejected', 'review_required', 'validated')"
#: What the columns of each subject may hold, as conditions that broken rows meet.
ROW_RULES: dict[str, dict[str, str]] = {
    "definition": {"kind_known": "kind not in ('procedure', 'query', 'script')", "text_given": "trim(name) = '' or trim(qualified_name) = '' or trim(language) = '' or trim(source_reference) = ''"},
    "claim": {"operation_known": "operation not in ('call', 'read')", "state_known": f"state not in {_STATES}"},
    "unit": {"operation_known": "operation not in ('delete', 'insert', 'merge', 'select_into', 'truncate', 'update')", "state_known": f"state not in {_STATES}", "role_known": "role not in ('audit', 'business_data', 'control', 'deduplication', 'filter', 'lookup', 'unknown')"},
    "materialization": {"mode_known": "mode not in ('incremental', 'table', 'view')", "state_known": f"state not in {_STATES}"},
    "excluded": {"operation_known": "operation not in ('delete', 'insert', 'merge', 'select_into', 'truncate', 'update')", "disposition_known": "disposition not in ('dynamic_sql', 'local_intermediate', 'unresolved')"},
    "evidence": {"evidence_given": "trim(coalesce(source, '')) = '' or trim(coalesce(reference, '')) = '' or trim(coalesce(reason, '')) = ''", "lines_ordered": "line_start is null or line_end is null or line_start < 1 or line_end < line_start"},
    "reviewed": {"draft_unreviewed": "state = 'draft' and decision is not null", "review_agrees": "(state = 'validated' and coalesce(decision, '') <> 'validate') or (state = 'rejected' and coalesce(decision, '') <> 'reject')"},
    "annotation": {"state_known": "state not in ('deferred', 'draft', 'rejected', 'review_required', 'validated')"},
    "proposal": {"description_given": "trim(coalesce(description, '')) = ''", "confidence_reason_given": "trim(coalesce(confidence_reason, '')) = ''", "confidence_a_rate": "confidence is null or confidence < 0 or confidence > 1", "evidence_given": "coalesce(evidence, 0) = 0"},
    "event": {
        "kind_known": "kind not in ('federated_query', 'mongo_query', 'python_analysis', 'sql_query')",
        "operation_fits": "(kind in ('sql_query', 'federated_query') and operation <> 'select') or (kind = 'mongo_query' and operation not in ('aggregate', 'find')) or (kind = 'python_analysis' and operation <> 'analyze')",
        "dialect_known": "(kind = 'sql_query' and coalesce(dialect, '') not in ('duckdb', 'postgresql', 'sqlite', 'sqlserver')) or (kind = 'federated_query' and coalesce(dialect, '') <> 'duckdb')",
        "status_known": "status not in ('failed', 'succeeded') and not (status = 'accepted' and kind in ('federated_query', 'python_analysis'))",
        "result_or_error": "(status in ('accepted', 'succeeded') and (row_count is null or error_code is not null)) or (status = 'failed' and (row_count is not null or error_code is null))",
        "rows_counted": "row_count < 0",
        "executor_given": "kind = 'python_analysis' and executor is null",
        "reconciliation_known": "reconciliation is not null and reconciliation not in ('matched', 'mismatch', 'not_run', 'partial')",
        "join_coverage_a_rate": "join_coverage < 0 or join_coverage > 1",
        "grain_declared": "kind = 'python_analysis' and status in ('accepted', 'succeeded') and coalesce(grain, '') = ''",
    },
    "knowledge": {
        "scope_known": "kind not in ('global', 'graph', 'object', 'schema', 'system')",
        "state_known": "state not in ('draft', 'validated')",
        "global_unbound": "kind = 'global' and (reference <> '*' or graph is not null or workspace is not null)",
        "system_bound": "kind = 'system' and (graph is not null or workspace is null)",
        "workspace_for_systems": "kind not in ('global', 'system') and workspace is not null",
        "graph_given": "kind in ('object', 'schema') and graph is null",
        "graph_for_parts": "kind = 'graph' and graph is not null",
        "content_given": "trim(content) = ''",
        "content_bounded": "{octets}(content) > 262144",
    },
    "entity": {
        "matched_within_evaluated": "matched > evaluated",
        "collisions_within_matched": "collisions > matched",
        "counterexamples_within_evaluated": "counterexamples > evaluated",
        "proposed_uncounted": "level = 'proposed' and (evaluated <> 0 or matched <> 0 or collisions <> 0 or counterexamples <> 0)",
        "tested_evaluated": "level <> 'proposed' and evaluated = 0",
        "coverage_counted": "level <> 'proposed' and evaluated > 0 and abs(coverage - matched / cast(evaluated as double)) > 0.000001",
        "endpoints_differ": "left_field = right_field",
        "review_agrees": "(state = 'candidate' and review is not null) or (state = 'reviewed' and coalesce(review, '') <> 'approve') or (state = 'rejected' and coalesce(review, '') <> 'reject')",
    },
    "edit": {"reason_given": "trim(coalesce(reason, '')) = ''"},
    "semantic_relationship": {"fields_aligned": "size(from_fields) = 0 or size(from_fields) <> size(to_fields)"},
}
_NONE = "rule string, key string"


def rules_sql(subject: str, table: str, key: str, **names: str) -> str:
    """The row rules of a subject as SQL over a table."""
    return " union all ".join(f"select '{r}' as rule, {key} as key from {table} where {c.format(**{'octets': 'strlen', **names})}" for r, c in ROW_RULES[subject].items())


def broken(df: DataFrame, subject: str, *key: str) -> DataFrame:
    """Rows of df that break the subject's row rules, in one pass."""
    found = [F.when(F.expr(c.format(octets="octet_length")), F.lit(r)) for r, c in ROW_RULES[subject].items()]
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("rule"), name.alias("key"))


def repeated(df: DataFrame, rule: str, *by: str) -> DataFrame:
    """Keys that come more than once."""
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in by])
    return df.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").select(F.lit(rule).alias("rule"), name.alias("key"))


def missing(df: DataFrame, rule: str, by: list[str], known: DataFrame, *key: str) -> DataFrame:
    """Rows of df whose `by` is not in known."""
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in key or by])
    return df.join(known.select(*by).distinct(), by, "left_anti").select(F.lit(rule).alias("rule"), name.alias("key"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def definition_violations(definitions: DataFrame, steps: DataFrame) -> DataFrame:
    """Of definitions(document, definition, external_id, ...) and steps(step, definition, dependency), a row for each dependency.

    Cycles are found by `acyclic`.
    """
    depends = steps.where("dependency is not null")
    return _all(
        broken(definitions, "definition", "definition"),
        repeated(definitions, "definition_unique", "document", "definition"),
        repeated(definitions, "external_id_unique", "document", "external_id"),
        missing(steps, "step_definition_known", ["definition"], definitions, "step"),
        missing(depends.select("step", F.col("dependency").alias("step2")), "dependency_known", ["step2"], steps.select(F.col("step").alias("step2")), "step", "step2"),
        depends.where("step = dependency").select(F.lit("dependency_on_itself"), F.col("step")),
        repeated(depends, "dependency_unique", "step", "dependency"),
    )


def acyclic(steps: DataFrame) -> bool:
    """Whether the dependencies of steps(step, position, dependency) have no cycle."""
    each = steps.groupBy("step").agg(F.min("position").alias("position"), F.collect_set("dependency").alias("depends_on"))
    try:
        topological_layers(each)
    except ValueError:
        return False
    return True


def analysis_violations(definitions: DataFrame, analyses: DataFrame, failures: DataFrame) -> DataFrame:
    """Of analyses and failures(definition, revision): one a definition, of its revision, and never both."""
    known = definitions.select("definition", F.col("revision").alias("current"))

    def of(df: DataFrame, what: str) -> DataFrame:
        stale = df.join(known, "definition").where("revision <> current").select(F.lit(f"{what}_revision_current"), F.col("definition"))
        return repeated(df, f"{what}_unique", "definition").union(missing(df, f"{what}_definition_known", ["definition"], known)).union(stale)

    both = analyses.select("definition").distinct().join(failures.select("definition"), "definition", "left_semi")
    return _all(of(analyses, "analysis"), of(failures, "failure"), both.select(F.lit("analyzed_or_failed"), F.col("definition")))


def item_violations(definitions: DataFrame, claims: DataFrame, units: DataFrame, materializations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Of lineage items: known operations, modes and states, known definitions, one materialization a definition, sources once a
    unit, and reviews(id, seq, decision) that agree with the state.
    """
    last = reviews.groupBy("id").agg(F.max_by("decision", "seq").alias("decision"))
    items = claims.select(F.col("claim").alias("id"), "state").union(materializations.select("materialization", "state")).union(units.select("unit", "state").distinct())
    known = definitions.select("definition")
    return _all(
        broken(claims, "claim", "claim"),
        broken(units, "unit", "unit"),
        broken(materializations, "materialization", "materialization"),
        broken(items.join(last, "id", "left"), "reviewed", "id"),
        repeated(claims, "claim_unique", "claim"),
        repeated(materializations, "one_materialization", "definition"),
        repeated(units.withColumn("source", F.lower("source")), "unit_source_unique", "unit", "source", "line"),
        missing(claims, "claim_definition_known", ["definition"], known, "claim"),
        missing(units.select("unit", "definition").distinct(), "unit_definition_known", ["definition"], known, "unit"),
        missing(materializations, "materialization_definition_known", ["definition"], known, "materialization"),
    )


def event_violations(events: DataFrame) -> DataFrame:
    """Of a log's events(log, sequence, call_id, kind, ..., columns, inputs, consumes as comma lists).

    Row rules of all kinds of events; sequences 1..n, unique calls, unique inputs and result columns; only earlier calls that did
    not fail are consumed. A list is as long as its row; logs are checked apart.
    """
    size = events.groupBy("log").agg(F.count("*").alias("n"))
    twice = events.groupBy("log", "sequence").agg(F.count("*").alias("m")).where("m > 1")
    outside = events.join(size, "log").where("sequence not between 1 and n").select("log", "sequence", "call_id")
    wrong = outside.union(events.join(twice, ["log", "sequence"], "left_semi").select("log", "sequence", "call_id")).distinct()

    def listed(c: str):
        return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")

    asked = F.col("kind").isin("sql_query", "mongo_query")
    lists = events.select("call_id", asked.alias("asked"), listed("inputs").alias("i"), listed("consumes").alias("c"), listed("columns").alias("r"), F.col("row_count").isNotNull().alias("result"))
    rules = [
        F.when(F.col("asked") & (F.size("i") == 0), "inputs_given"), F.when(F.size("i") > 512, "inputs_bounded"), F.when(F.size(F.array_distinct("i")) < F.size("i"), "inputs_unique"),
        F.when(~F.col("asked") & (F.size("c") == 0), "consumes_given"), F.when(F.size(F.array_distinct("c")) < F.size("c"), "consumes_unique"),
        F.when(F.col("result") & ~F.size("r").between(1, 256), "columns_counted"), F.when(F.size(F.array_distinct(F.transform("r", F.lower))) < F.size("r"), "columns_unique"),
    ]
    own = lists.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("call_id").alias("key"))
    used = events.select("log", "call_id", "sequence", F.explode(listed("consumes")).alias("used"))
    given = events.select("log", F.col("call_id").alias("used"), F.col("sequence").alias("at"), "status")
    met = used.join(given, ["log", "used"], "left")
    bad = F.when(F.col("at").isNull() | (F.col("at") >= F.col("sequence")), "consumes_earlier").when(~F.col("status").isin("accepted", "succeeded"), "consumes_successful")
    consumed = met.select(bad.alias("rule"), F.concat_ws("|", "call_id", "used").alias("key")).where("rule is not null")
    return _all(broken(events, "event", "call_id"), wrong.select(F.lit("sequence_contiguous"), F.col("call_id")), repeated(events, "call_unique", "log", "call_id"), own, consumed)


def workspace_violations(systems: DataFrame, areas: DataFrame, zones: DataFrame, relationships: DataFrame) -> DataFrame:
    """Of systems(system, graph), areas(system, area, graph, namespace), zones(system, zone, graph, object_id) and
    relationships(id, state, reason, source_graph, source_object, source_field, target_graph, target_object, target_field).
    """
    owners = systems.distinct().groupBy("graph").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("graph_in_one_system").alias("rule"), F.col("graph").alias("key"))
    schemas = areas.select("system", "area", "graph", "namespace").distinct().groupBy("system", "graph", "namespace").agg(F.count("*").alias("n")).where("n > 1")
    ends = relationships.select("id", F.explode(F.array("source_graph", "target_graph")).alias("graph"))
    same = relationships.where("source_graph = target_graph and source_object = target_object and lower(source_field) = lower(target_field)")
    return _all(
        owners,
        schemas.select(F.lit("schema_in_one_area"), F.concat_ws("|", "system", "graph", "namespace")),
        missing(areas, "area_graph_in_system", ["system", "graph"], systems, "system", "area", "graph"),
        missing(zones, "zone_graph_in_system", ["system", "graph"], systems, "system", "zone", "graph"),
        repeated(zones, "zone_member_unique", "system", "zone", "graph", "object_id"),
        repeated(relationships, "relationship_unique", "id"),
        missing(ends, "relationship_graph_known", ["graph"], systems, "id", "graph"),
        same.select(F.lit("relationship_ends_differ"), F.col("id")),
        relationships.where("trim(coalesce(reason, '')) = ''").select(F.lit("relationship_reason_given"), F.col("id")),
        relationships.where("state not in ('draft', 'rejected', 'validated')").select(F.lit("relationship_state_known"), F.col("id")),
    )


def workspace_reference_violations(areas: DataFrame, zones: DataFrame, relationships: DataFrame, objects: DataFrame, fields: DataFrame) -> DataFrame:
    """Graphs, schemas, members and fields that a workspace names and its graphs lack, and members of schemas without an area."""
    known = objects.select("graph", F.col("id").alias("object_id"), "namespace")
    placed = zones.join(known, ["graph", "object_id"])
    ends = relationships.select("id", F.explode(F.array(*[F.struct(F.col(f"{s}_graph").alias("graph"), F.col(f"{s}_object").alias("object_id"), F.lower(f"{s}_field").alias("field")) for s in ("source", "target")])).alias("e")).select("id", "e.*")
    owned = fields.select("graph", F.col("parent_id").alias("object_id"), F.lower("label").alias("field"))
    return _all(
        missing(areas, "schema_known", ["graph", "namespace"], known, "graph", "namespace").distinct(),
        missing(zones, "zone_member_known", ["graph", "object_id"], known, "zone", "graph", "object_id"),
        missing(placed, "zone_schema_assigned", ["system", "graph", "namespace"], areas, "zone", "graph", "object_id"),
        missing(ends, "relationship_object_known", ["graph", "object_id"], known, "id", "graph", "object_id"),
        missing(ends.join(known, ["graph", "object_id"], "left_semi"), "relationship_field_known", ["graph", "object_id", "field"], owned, "id", "graph", "object_id", "field"),
    )


def entity_violations(entities: DataFrame) -> DataFrame:
    return broken(entities, "entity", "candidate").union(repeated(entities, "candidate_unique", "candidate"))


def knowledge_violations(documents: DataFrame) -> DataFrame:
    return broken(documents, "knowledge", "id").union(repeated(documents, "knowledge_unique", "id"))


def manual_violations(jobs: DataFrame, hops: DataFrame) -> DataFrame:
    """Of manual jobs(document, job, qualified_name) and hops(document, job, operation, target, source, state)."""
    return _all(
        repeated(jobs.withColumn("qualified_name", F.lower("qualified_name")), "job_unique", "document", "qualified_name"),
        repeated(hops.select("document", "job", "operation", F.lower("target").alias("target"), F.lower("source").alias("source")), "hop_unique", "document", "job", "operation", "target", "source"),
        hops.where("state <> 'draft'").select(F.lit("hop_starts_as_draft"), F.concat_ws("|", "document", "job", "target")),
        missing(hops, "hop_job_known", ["document", "job"], jobs, "document", "job", "target"),
        jobs.union(hops.select("document", "job", F.lit(None).cast("string"))).select("document").distinct().where("document not like 'manual%'").select(F.lit("manual_overlay"), F.col("document")),
    )


def checkpoint_violations(parts: DataFrame, identity: str) -> DataFrame:
    """Of an index build's finished parts(identity, position): one identity, positions 0..n-1."""
    n = parts.agg(F.count("*").alias("n"))
    other = parts.where(F.col("identity") != identity).select(F.lit("identity_equal").alias("rule"), F.col("position").cast("string").alias("key"))
    gaps = parts.crossJoin(F.broadcast(n)).where("position not between 0 and n - 1").select(F.lit("prefix_contiguous"), F.col("position").cast("string"))
    return _all(other, gaps, repeated(parts, "position_unique", "position"))


def semantic_violations(targets: DataFrame, relationships: DataFrame, edits: DataFrame) -> DataFrame:
    """Of a semantic import's targets(id), relationships(id, from_fields, to_fields) and edits(edit, id, reason)."""
    return _all(
        repeated(targets, "target_unique", "id"),
        broken(relationships, "semantic_relationship", "id"),
        broken(edits, "edit", "edit"),
        missing(edits, "edit_target_known", ["id"], targets, "edit", "id"),
    )
