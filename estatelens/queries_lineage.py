"""Queries of write statements, of proposals for them, and of runtime closures, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generated as g
from .operators import graph, proposals, scripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    """Register a query under its own name."""

    def register(run):
        QUERIES[run.__name__] = run
        SQL[run.__name__] = sql
        return run

    return register


_LEX = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|''[^'']*(?:''|\z)|[^-/'']+|[\s\S]"
_MASK = f"array_to_string(list_transform(regexp_extract_all(content, '{_LEX}'), lambda x: case when starts_with(x, '--') or starts_with(x, '/*') or starts_with(x, '''') then regexp_replace(x, '[^\\n]', ' ', 'g') else x end), '')"
_MARKS = f"""ln as (select definition, unnest(string_split({_MASK}, chr(10))) as m, unnest(string_split(content, chr(10))) as s, unnest(range(1, len(string_split(content, chr(10))) + 1))::int as line from scripts),
mk as (select definition, line, case when regexp_matches(m, '(?i)^[ \\t]*(insert|update|delete|merge|truncate)\\b') then lower(regexp_extract(m, '(?i)(insert|update|delete|merge|truncate)')) when regexp_matches(m, '(?i)^[ \\t]*into[ \\t]+[#@]|^[ \\t]*select\\b[^;]*\\binto\\b') then 'select_into' end as operation, trim(s) as text from ln)"""


@_query(f"with {g.sql('scripts')}, {_MARKS} select * from mk where operation is not null")
def write_markers(spark, sf_dir):
    return scripts.write_markers(g.table(spark, sf_dir, "scripts"))


def _proposal(spark, sf_dir):
    """proposals, units, sources, exclusions, definitions, reviewed."""
    sources = g.table(spark, sf_dir, "proposed_sources")
    sources = sources.withColumn("via", F.when(F.col("way").isNotNull(), F.array("way")).otherwise(F.array().cast("array<string>"))).drop("way")
    return tuple(g.table(spark, sf_dir, n) for n in ("write_proposals", "proposed_units")) + (sources,) + tuple(g.table(spark, sf_dir, n) for n in ("proposed_exclusions", "scripts", "standing_units"))


_ALL = f"""{g.sql('scripts', 'write_proposals', 'proposed_units', 'proposed_sources', 'proposed_exclusions', 'standing_units')}, {_MARKS},
en as (select distinct definition, operation, line_start as line from (select definition, operation, line_start, line_end from proposed_units union all select definition, operation, line_start, line_end from proposed_exclusions) where line_end >= line_start),
uk as (select *, definition || '|' || operation || '|' || target || '|' || line_start as key from proposed_units), sk as (select *, definition || '|' || source || '|' || role || '|' || source_start as key from proposed_sources),
xk as (select *, definition || '|' || operation || '|' || target || '|' || line_start as key from proposed_exclusions),
vi as (select definition, 'revision_current' as rule, 'old' as key from scripts where k % 43 = 9 union all select definition, 'operation_known', key from uk where operation = 'upsert' union all select definition, 'target_in_lines', key from uk where target = 'dw.z' or (operation = 'delete' and line_start = 9)
  union all select definition, 'lines_in_source', key from uk where line_end > 10 union all select definition, 'reason_given', key from uk where reason = ' ' union all select definition, 'role_known', key from sk where role = 'guess' union all select definition, 'disposition_known', key from xk where disposition = 'whatever'
  union all select definition, 'unit_once', 'insert|dw.w' || (k % 300) || '|2' from scripts where k % 41 = 7 and k % 17 <> 3 union all select definition, 'unit_known', key from sk where k % 17 = 3
  union all select definition, 'write_unclassified', operation || '@' || line from mk anti join en using (definition, operation, line) where operation is not null
  union all select definition, 'write_not_found', operation || '@' || line from en anti join mk using (definition, operation, line) union all select definition, 'reviewed_item', definition from scripts where k % 53 = 8),
vv as (select distinct vi.* from vi semi join write_proposals using (definition)), ac as (select * from write_proposals anti join vv using (definition))"""
_ID = """'write:' || substr(sha256('write' || chr(10) || operation || chr(10) || definition || chr(10) || regexp_replace(lower(translate(target, '[]"', '')), '\\s*\\.\\s*', '.', 'g') || chr(10) || line_start || chr(10) || revision), 1, 24)"""


@_query(f"with {_ALL} select * from vv")
def write_proposals_refused(spark, sf_dir):
    return proposals.violations(*_proposal(spark, sf_dir))


@_query(f"""with {_ALL} select definition, operation || '@' || line as key, 'write_unclassified' as rule from mk anti join en using (definition, operation, line) where operation is not null
union all select definition, operation || '@' || line, 'write_not_found' from en anti join mk using (definition, operation, line)""")
def uncovered_writes(spark, sf_dir):
    _, units, _, exclusions, definitions, _ = _proposal(spark, sf_dir)
    return proposals.coverage_violations(scripts.write_markers(definitions), units, exclusions)


def _taken(spark, sf_dir):
    tables = _proposal(spark, sf_dir)
    return tables, proposals.accepted(tables[0], proposals.violations(*tables))


@_query(f"with {_ALL} select {_ID} as unit, definition, operation, target, line_start, line_end, reason, 'draft' as state from proposed_units join ac using (definition)")
def write_units_proposed(spark, sf_dir):
    tables, taken = _taken(spark, sf_dir)
    return proposals.write_units(tables[1], taken)


@_query(f"with {_ALL} select {_ID} as unit, source, role, coalesce(way, '') as via, source_start as line_start, source_end as line_end, reason from proposed_sources join ac using (definition)")
def write_sources_proposed(spark, sf_dir):
    tables, taken = _taken(spark, sf_dir)
    return proposals.write_sources(tables[2], taken).withColumn("via", F.array_join("via", ","))


@_query(f"with {_ALL} select definition, operation, target, disposition, line_start, line_end, reason from proposed_exclusions semi join ac using (definition)")
def write_exclusions_proposed(spark, sf_dir):
    tables, taken = _taken(spark, sf_dir)
    return proposals.excluded_writes(tables[3], taken)


# closures of all calls of all logs


def _calls(spark, sf_dir):
    cut = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    events = g.table(spark, sf_dir, "events_log")
    return events.select("log", "call_id", "status", F.split("kind", "_")[0].alias("kind"), cut(F.col("inputs")).alias("inputs"), cut(F.col("consumes")).alias("consumes"))


_CLOSED = f"""{g.sql('events_log')}, us as (select distinct log, call_id, unnest(string_split(consumes, ',')) as used from events_log where consumes <> ''), ok as (select * from us semi join (select log, call_id as used from events_log) using (log, used)),
cl as (select distinct log, call_id, call_id as used from events_log where status = 'succeeded' union select cl.log, cl.call_id, ok.used from cl join ok on ok.log = cl.log and ok.call_id = cl.used)"""


@_query(f"with recursive {_CLOSED} select * from cl")
def closure_calls(spark, sf_dir):
    return graph.closures(_calls(spark, sf_dir))


@_query(f"""with recursive {_CLOSED}, ip as (select log, call_id as used, unnest(string_split(inputs, ',')) as node from events_log where inputs <> '' and kind in ('sql_query', 'mongo_query'))
select distinct log, call_id, node from cl join ip using (log, used)""")
def closure_inputs(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return graph.closure_inputs(calls, graph.closures(calls))
