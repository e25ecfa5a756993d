"""Metadata tables made from the star schema by one SQL text for Spark and DuckDB; they grow with the scale factor."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_STATE = "case {0} % 5 when 0 then 'draft' when 1 then 'validated' when 2 then 'review_required' when 3 then 'rejected' else 'validated' end"

#: name: the SQL of a table; {x} is a table of the star schema or another one of these.
TABLES = {
    # static lineage of three documents
    "definitions": """select 'doc' || (p_partkey % 3) as document, 'd' || p_partkey as definition, 'x' || p_partkey as external_id, 'load_' || p_partkey as name, 'etl.load_' || p_partkey as qualified_name,
      case p_size % 3 when 0 then 'procedure' when 1 then 'query' else 'script' end as kind, 'sql' as language, p_name as content, 'rev' || p_partkey as revision, case when p_partkey % 4 = 0 then 'loads ' || p_name end as summary, p_brand as source_reference from {part}""",
    "steps": "select 's' || p_partkey as step, 'd' || p_partkey as definition, cast(p_partkey as int) as position, case when p_partkey % 50 = 0 then cast(null as varchar(9)) else 's' || (p_partkey - 1) end as dependency from {part}",
    "claims": f"""select 'doc' || (o_custkey % 3) as document, 'c' || o_orderkey as claim, 'd' || o_custkey as definition, case when o_orderkey % 10 = 0 then 'call' else 'read' end as operation,
      case when o_orderkey % 7 = 3 then 'ETL . [load_' || (o_orderkey % 50) || ']' else 'raw.t' || (o_orderkey % 500) end as target, {_STATE.format('o_orderkey')} as state, cast(o_orderkey % 11 as int) as line from {{orders}}""",
    "units": f"""select 'doc' || (l_partkey % 3) as document, 'u' || l_partkey || '_' || l_linenumber as unit, 'd' || l_partkey as definition, 'dw.w' || (l_partkey % 300) as target, {_STATE.format('(l_partkey + l_linenumber)')} as state,
      'raw.t' || l_suppkey as source, case when l_linenumber = 5 then 'upsert' else 'insert' end as operation, case when l_linenumber % 2 = 0 then 'lookup' else 'business_data' end as role, cast(max(l_orderkey) as int) as line from {{lineitem}} group by l_partkey, l_linenumber, l_suppkey""",
    "materializations": f"""select 'doc' || (p_partkey % 3) as document, 'm' || p_partkey as materialization, 'd' || p_partkey as definition, case when p_partkey % 10 = 0 then 'dw.w' || (p_partkey % 300) else 'mart.m' || p_partkey end as target,
      case p_partkey % 3 when 0 then 'table' when 1 then 'view' else 'incremental' end as mode, {_STATE.format('p_partkey')} as state from {{part}} where p_partkey % 5 = 0""",
    # a script for each definition, and what an analysis proposes for its writes
    "scripts": """select 'd' || p_partkey as definition, 'rev' || p_partkey as revision, p_partkey as k, '-- INSERT INTO nothing; load ' || p_name || chr(10) || 'INSERT INTO dw.w' || (p_partkey % 300) || chr(10) || 'SELECT a, ' || chr(39) || 'DELETE FROM x' || chr(39) || ' FROM [raw].[t' || (p_partkey % 500) || '] t' || chr(10)
      || 'JOIN raw.u' || (p_partkey % 70) || ' u ON t.id = u.id /* UPDATE dw.none' || chr(10) || ' MERGE still a comment */ WHERE t.b > 1;' || chr(10) || case when p_partkey % 3 = 0 then 'update dw.w' || (p_partkey % 7) || ' SET a = 1;' else 'print 1;' end || chr(10)
      || case when p_partkey % 4 = 0 then 'SELECT b INTO #tmp' || p_partkey || ' FROM raw.u' || (p_partkey % 70) || ';' else '  -- merge' end || chr(10) || case when p_partkey % 5 = 0 then '  DELETE FROM "stage"."s' || (p_partkey % 9) || '"' else 'SET @m = ' || chr(39) || 'it' || chr(39) || chr(39) || 's' end || chr(10)
      || case when p_partkey % 5 = 0 then 'WHERE a = 2;' else 'TRUNCATE TABLE no' || chr(39) || ';' end || chr(10) || case when p_partkey % 6 = 0 then 'TRUNCATE TABLE dw.w' || (p_partkey % 11) else 'GO /* open' end as content from {part}""",
    "write_proposals": "select definition, case when k % 43 = 9 then 'old' else revision end as revision from {scripts} where k % 8 <> 7",
    "proposed_units": """select definition, k, 'insert' as operation, 'dw.w' || (k % 300) as target, 2 as line_start, 5 as line_end, 'loads' as reason from {scripts} where k % 17 <> 3
      union all select definition, k, 'insert', '[DW] . "w' || (k % 300) || '"', 2, 2, 'again' from {scripts} where k % 41 = 7
      union all select definition, k, case when k % 59 = 12 then 'upsert' else 'update' end, case when k % 19 = 4 then 'dw.z' else 'dw.w' || (k % 7) end, 6, 6, 'sets' from {scripts} where k % 3 = 0
      union all select definition, k, 'delete', 'stage.s' || (k % 9), case when k % 29 = 5 then 9 else 8 end, 9, 'clears' from {scripts} where k % 5 = 0
      union all select definition, k, 'truncate', 'dw.w' || (k % 11), 10, case when k % 61 = 18 then 11 else 10 end, case when k % 31 = 1 then ' ' else 'empties' end from {scripts} where k % 6 = 0
      union all select definition, k, 'merge', 'still', 5, 5, 'guess' from {scripts} where k % 37 = 2""",
    "proposed_sources": """select definition, k, 'insert' as operation, 'dw.w' || (k % 300) as target, 2 as line_start, 'RAW.t' || (k % 500) as source, case when k % 47 = 6 then 'guess' else 'business_data' end as role, cast(null as varchar(9)) as way, 3 as source_start, 3 as source_end, 'read' as reason from {scripts} where k % 17 <> 3
      union all select definition, k, 'insert', 'dw.w' || (k % 300), 2, 'raw.u' || (k % 70), 'lookup', 'join', 4, 5, 'joined' from {scripts} where k % 17 <> 3 or k % 34 = 3""",
    "proposed_exclusions": "select definition, k, 'select_into' as operation, '#tmp' || k as target, case when k % 23 = 5 then 'whatever' else 'local_intermediate' end as disposition, 7 as line_start, 7 as line_end, 'local' as reason from {scripts} where k % 4 = 0",
    "standing_units": "select definition, 'validated' as state, case when k % 53 = 8 then 1 else 0 end as n_reviews from {scripts} union all select definition, 'review_required', 2 from {scripts} where k % 5 = 1",
    # a technical graph: an object for each supplier, its fields from its parts
    "objects": "select 'g' || (s_suppkey % 2) as graph, 'cat' as catalog, 'object:' || s_suppkey as id, case when s_suppkey % 5 = 0 then 'view' else 'table' end as type, 'ns' || (s_nationkey % 4) || '.sup_' || s_suppkey as label, cast(null as varchar(40)) as parent_id, 'ns' || (s_nationkey % 4) as namespace, 'sup_' || s_suppkey as name, s_name as description from {supplier}",
    "fields": """select 'g' || (s_suppkey % 2) as graph, 'cat' as catalog, 'field:' || s_suppkey || '/' || p_partkey as id, 'field' as type, 'f_' || p_partkey as label, 'object:' || s_suppkey as parent_id, 'ns' || (s_nationkey % 4) as namespace, 'f_' || p_partkey as name, p_type as description,
      cast(p_partkey % 12 + 1 as int) as position, case p_size % 3 when 0 then 'int' when 1 then 'varchar(20)' else 'decimal(9,2)' end as data_type, p_partkey % 3 = 0 as nullable, p_partkey % 12 = 0 as is_primary_key from {supplier} join {part} on p_partkey % (select count(*) from {supplier}) = s_suppkey""",
    "nodes": "select graph, catalog, id, type, label, parent_id, description from {objects} union all select graph, catalog, id, type, label, parent_id, description from {fields}",
    # the next version of the graph
    "fields_after": """select graph, id, case when id like '%5' then label || 'x' else label end as label, parent_id, namespace, position, case when id like '%71' then 'text' else data_type end as data_type, nullable, case when id like '%24' then not is_primary_key else is_primary_key end as is_primary_key from {fields} where id not like '%13'""",
    # reviews
    "annotated": f"""select id, graph, type, label, parent_id, description, {_STATE.format('length(id)')} as state from {{nodes}} where id not like '%7'""",
    "decisions": """select claim as id, cast(line as int) as seq, case line % 4 when 0 then 'validate' when 1 then 'reject' when 2 then 'approve' else 'validate' end as decision, case when line = 5 then ' ' else 'because of ' || claim end as reason from {claims} where line < 8
      union all select 'c' || (o_orderkey * 1000 + 999983) , 1, 'reject', 'unknown' from {orders} where o_orderkey % 100 = 0 union all select claim, cast(line as int) + 10, 'reject', 'second look' from {claims} where line = 3""",
    # a log of runtime events, 1,000 calls each
    "events_log": """select 'log' || cast(floor(event_id / 1000) as int) as log, cast(event_id % 1000 + case when event_id % 333 = 5 then 1 else 0 end as int) as sequence, 'q' || event_id as call_id,
      case event_type when 'click' then 'sql_query' when 'view' then 'mongo_query' when 'purchase' then 'federated_query' when 'signup' then 'python_analysis' else 'sql_query' end as kind,
      case event_type when 'click' then 'select' when 'view' then 'find' when 'purchase' then 'select' when 'signup' then 'analyze' else 'delete' end as operation,
      case when event_type in ('click', 'error') then case event_id % 4 when 0 then 'duckdb' when 1 then 'sqlite' when 2 then 'postgresql' else 'oracle' end when event_type = 'purchase' then 'duckdb' end as dialect,
      case when event_id % 9 = 4 then 'failed' else 'succeeded' end as status, case when event_id % 9 = 4 and event_id % 2 = 0 then 'timeout' end as error_code,
      case when event_id % 9 <> 4 or event_id % 27 = 4 then cast(event_id % 100 as int) - 1 end as row_count, case when event_id % 9 <> 4 then 'a,b,' || (event_id % 5) when event_id % 27 = 4 then 'A,a' end as columns,
      case when event_type in ('click', 'view', 'error') then 'n' || (event_id % 50) || case when event_id % 11 = 0 then ',n' || (event_id % 50) else ',n' || (event_id % 50 + 60) end else '' end as inputs,
      case when event_type in ('purchase', 'signup') then 'q' || (event_id - event_id % 7 - 1) || case when event_id % 13 = 0 then ',q' || (event_id + 1) else '' end else '' end as consumes,
      case when event_type = 'signup' and event_id % 6 <> 0 then 'pandas' end as executor, case when event_type = 'signup' then case event_id % 5 when 0 then 'matched' when 1 then 'partial' when 2 then 'guessed' else 'not_run' end end as reconciliation,
      case when event_type = 'signup' then value / 100 end as join_coverage, case when event_type = 'signup' and event_id % 8 <> 0 then 'day,user' when event_type = 'signup' then '' end as grain from {events}""",
    # workspaces
    "members": "select 'sys' || (c_nationkey % 4) as system, 'g' || (c_nationkey % 5) as graph, case when c_custkey % 9 = 0 then cast(null as varchar(20)) else 'area' || (c_nationkey % 7) end as area, 'ns' || (c_custkey % 30) as namespace, 'object:' || c_custkey as object_id, 'zone' || (c_custkey % 11) as zone from {customer}",
    "knowledge": "select 'k' || doc_id as id, case doc_id % 5 when 0 then 'global' when 1 then 'system' when 2 then 'graph' when 3 then 'schema' else 'object' end as kind, case doc_id % 5 when 0 then '*' when 1 then 'ERP' when 2 then 'g' || (doc_id % 3) when 3 then 'NS' || (doc_id % 4) else 'sup_' || (doc_id % 20) end as reference, case when doc_id % 5 > 2 then 'G' || (doc_id % 2) end as graph, case when doc_id % 5 = 1 then 'home' end as workspace, case when doc_id % 10 = 9 then 'retired' when doc_id % 2 = 0 then 'draft' else 'validated' end as state, text as content from {documents}",
    "entities": """select 'e' || p_partkey as candidate, 'field:' || (p_partkey % 40) as left_field, 'field:' || (p_partkey % 37) as right_field, case p_size % 3 when 0 then 'reviewed' when 1 then 'candidate' else 'rejected' end as state, case p_size % 4 when 0 then 'approve' when 1 then 'reject' end as review,
      case when p_partkey % 6 = 0 then 'proposed' else 'tested' end as level, p_partkey % 100 as evaluated, p_partkey % 70 as matched, p_partkey % 30 as collisions, p_partkey % 90 as counterexamples, case when p_partkey % 100 = 0 then 0.0 else (p_partkey % 70) / cast(p_partkey % 100 as double) end as coverage from {part}""",
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", TABLES[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One generated table."""
    parts = {n: table(spark, sf_dir, n) if n in TABLES else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _needs(name)}
    return spark.sql(TABLES[name], **parts)


def sql(*names: str) -> str:
    """Generated tables, and those they are made from, as common table expressions for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES and name not in order:
            for n in _needs(name):
                visit(n)
            order.append(name)

    for n in names:
        visit(n)
    return ", ".join(f"{n} as ({re.sub(r'[{}]', '', TABLES[n])})" for n in order)
