"""Catalogs, lineage, logs, workspaces and packets made from the given tables by one SQL text for Spark and DuckDB; they grow with them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: What both engines write differently: a list without entries.
_EMPTY = {"spark": "cast(array() as array<string>)", "duckdb": "cast([] as varchar[])"}


@dataclass(frozen=True)
class Made:
    """A table by its SQL; {x} is a given table, {empty} a list without entries, and list(x) the list of x's parts between commas."""

    text: str

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", self.text)) - {"empty"}
        text = self.text.replace("{empty}", _EMPTY["spark"])
        return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})

    def sql(self, name: str) -> str:
        """name as a common table expression."""
        # a table that shares its name with the expression is meant, not the expression itself
        return f"{name} as ({re.sub(r'{(\w+)}', r'main.\1', self.text.replace('{empty}', _EMPTY['duckdb']))})"


def _fields(changed: bool) -> str:
    """Six fields of each supplier's object; in the changed version some have other types, names, flags, or are gone."""
    of = [("order_key", "bigint"), ("customer_id", "bigint"), ("name", "string"), ("retail_price", "double"), ("nation_key", "int"), ("ref_id", "bigint")]
    parts = []
    for i, (field, kind) in enumerate(of):
        name = f"case when s_suppkey % 19 = {i} then '{field}_new' else '{field}' end" if changed else f"'{field}'"
        data_type = f"case when s_suppkey % 23 = {i} then 'decimal(9,2)' else '{kind}' end" if changed else f"'{kind}'"
        key = f"{'true' if i == 0 else 'false'}" if not changed else f"case when s_suppkey % 29 = 3 then {'false' if i == 0 else 'true'} else {'true' if i == 0 else 'false'} end"
        text = f"case when s_suppkey % 31 = {i} then 'known as {field}' end" if changed else "cast(null as varchar(20))"
        where = f" where s_suppkey % 37 <> {i} and s_suppkey % 11 <> 3" if changed else ""
        parts.append(f"select 'main' as namespace, 'sup_' || s_suppkey as object, {name} as field, cast({i + 1} as int) as position, {data_type} as data_type, {'s_suppkey % 41 = 5' if changed else 'false'} as nullable, {key} as is_primary_key, {text} as description from {{supplier}}{where}")
    return " union all ".join(parts)


OBJECTS = Made("""select 'main' as namespace, 'sup_' || s_suppkey as object, case when s_suppkey % 5 = 0 then 'view' else 'table' end as kind, case when s_suppkey % 7 = 1 then 'order_key,ref_id' else 'order_key' end as primary_key,
  case s_suppkey % 3 when 0 then 'orders of customers' when 1 then 'nation ' || s_nationkey || ' keys' else s_name end as description from {supplier}""")
FIELDS = Made(_fields(False))
RELATIONSHIPS = Made("""select 'main' as namespace, 'sup_' || s_suppkey as object, 'fk_' || s_suppkey as name, case when s_suppkey % 13 = 4 then split('ref_id,name', ',') else split('ref_id', ',') end as from_fields, 'main' as to_namespace,
  case when s_suppkey % 17 = 5 then 'gone_' || s_suppkey else 'sup_' || cast(floor((s_suppkey + 1) / 2) as bigint) end as to_object, split('order_key', ',') as to_fields from {supplier} where s_suppkey % 4 <> 2""")
OBJECTS_AFTER = Made("""select 'main' as namespace, 'sup_' || s_suppkey as object, case when s_suppkey % 5 = 0 and s_suppkey % 3 = 0 then 'table' when s_suppkey % 5 = 0 then 'view' else 'table' end as kind, case when s_suppkey % 7 = 1 or s_suppkey % 7 = 2 then 'order_key,ref_id' else 'order_key' end as primary_key,
  case when s_suppkey % 9 = 1 then 'told anew' when s_suppkey % 3 = 0 then 'orders of customers' when s_suppkey % 3 = 1 then 'nation ' || s_nationkey || ' keys' else s_name end as description from {supplier} where s_suppkey % 11 <> 3
  union all select 'main', 'new_' || s_suppkey, 'table', '', 'fresh' from {supplier} where s_suppkey % 20 = 7""")
FIELDS_AFTER = Made(_fields(True))
RELATIONSHIPS_AFTER = Made("""select 'main' as namespace, 'sup_' || s_suppkey as object, 'fk_' || s_suppkey as name, split('ref_id', ',') as from_fields, 'main' as to_namespace,
  case when s_suppkey % 10 = 1 then 'sup_1' else 'sup_' || cast(floor((s_suppkey + 1) / 2) as bigint) end as to_object, split('order_key', ',') as to_fields from {supplier} where s_suppkey % 4 <> 3 and s_suppkey % 11 <> 3""")
ANNOTATIONS = Made("""select 'main.sup_' || s_suppkey || case s_suppkey % 4 when 0 then '' when 1 then '.name' when 2 then '.retail_price' else '.order_key' end as reference, case s_suppkey % 3 when 0 then 'draft' else 'validated' end as state from {supplier}""")

_STATE = "case {0} % 5 when 0 then 'draft' when 1 then 'validated' when 2 then 'review_required' when 3 then 'rejected' else 'validated' end"
DEFINITIONS = Made("select 'd' || p_partkey as definition, 'etl.load_' || p_partkey as name, case p_size % 3 when 0 then 'procedure' when 1 then 'query' else 'script' end as kind, case p_partkey % 4 when 0 then 'missing' when 1 then 'failed' else 'complete' end as analysis from {part}")
STEPS = Made("select 's' || p_partkey as step, 'd' || p_partkey as definition, cast(p_size as int) as position, case when p_partkey <= 1 then {empty} when p_partkey % 3 = 0 and p_partkey > 3 then split('s' || cast(floor(p_partkey / 2) as bigint) || ',s' || cast(floor(p_partkey / 3) as bigint), ',') else split('s' || cast(floor(p_partkey / 2) as bigint), ',') end as depends_on from {part}")
CLAIMS = Made(f"select 'c' || o_orderkey as claim, 'd' || o_custkey as definition, case when o_orderkey % 10 = 0 then 'call' else 'read' end as operation, case when o_orderkey % 7 = 3 then 'ETL . [load_' || (o_orderkey % 50 + 1) || ']' else 'raw.t' || (o_orderkey % 500) end as target, {_STATE.format('o_orderkey')} as state from {{orders}}")
WRITES = Made(f"select distinct 'u' || l_partkey || '_' || l_linenumber as unit, 'd' || l_partkey as definition, 'dw.w' || (l_partkey % 300) as target, {_STATE.format('(l_partkey + l_linenumber)')} as state, 'raw.t' || l_suppkey as source, case when l_linenumber % 2 = 0 then 'lookup' else 'business_data' end as role from {{lineitem}}")
MATERIALIZATIONS = Made(f"select 'm' || p_partkey as materialization, 'd' || p_partkey as definition, case when p_partkey % 10 = 0 then 'dw.w' || (p_partkey % 300) else 'mart.m' || p_partkey end as target, case p_partkey % 2 when 0 then 'table' else 'view' end as mode, {_STATE.format('p_partkey')} as state from {{part}} where p_partkey % 5 = 0")
#: A network in which each node is made from two of greater number, with loops; twenty nodes feed the report.
EDGES = Made(f"""select 'n' || (p_partkey * 3) as source, 'n' || p_partkey as target, 'derived_from' as relation, {_STATE.format('p_partkey')} as state from {{part}} where p_partkey > 0 union all select 'n' || (p_partkey * 2 + 1), 'n' || p_partkey, 'reads_from', 'validated' from {{part}}
  union all select 'n' || p_partkey, 'n' || p_partkey, 'derived_from', 'draft' from {{part}} where p_partkey % 97 = 0 union all select 'n' || p_partkey, 'rep.best', 'derived_from', 'draft' from {{part}} where p_partkey <= 20""")

_CALLS = """select cast(event_id + {0} as int) as sequence, case when event_id % 500 = 498 then 'p' || cast(floor(event_id / 500) as bigint) else 'q' || {1} end as call_id, case event_type when 'click' then 'sql' when 'view' then 'mongo' when 'purchase' then 'federated' else 'python' end as kind,
  case when event_id % 9 = 4 then 'failed' else 'succeeded' end as status, split('n' || (event_id % 50) || ',n' || (event_id % 50 + 60), ',') as inputs, case when event_id < 8 then {{empty}} when event_id % 13 = 0 then split('q' || cast(floor(event_id / 3) as bigint) || ',q' || (event_id + 2), ',') else split('q' || cast(floor(event_id / 2) as bigint), ',') end as consumes from {{events}}"""
RUNTIME = Made(_CALLS.format(1, "event_id").replace("{{", "{").replace("}}", "}"))
BROKEN = Made(_CALLS.format("case when event_id % 333 = 5 then 2 else 1 end", "(event_id - case when event_id % 250 = 6 then 1 else 0 end)").replace("{{", "{").replace("}}", "}"))

SCOPE_OBJECTS = Made("select case c_nationkey % 3 when 0 then 'erp' when 1 then 'crm' else 'web' end as system, 'g' || (c_nationkey % 5) as graph, case when c_custkey % 9 > 0 then 'area' || (c_nationkey % 7) end as area, case c_custkey % 4 when 0 then 'dbo' when 1 then 'crm' else 'ns' || (c_custkey % 30) end as schema_name, 'o' || c_custkey as object from {customer}")
ZONES = Made("select case when c_custkey % 6 = 0 then 'private' else 'revenue' end as zone, 'g' || (c_nationkey % 5) as graph, 'o' || c_custkey as object from {customer} where c_custkey % 5 <> 1 union all select 'private', 'g' || (c_nationkey % 5), 'o' || c_custkey from {customer} where c_custkey % 15 = 2")
CHANGED = Made("select 'g' || (c_nationkey % 5) as graph, case c_custkey % 4 when 0 then 'dbo' when 1 then 'crm' else 'ns' || (c_custkey % 30) end as schema_name, 'o' || c_custkey as object, 'field_removed' as kind from {customer} where c_custkey % 3 = 0")
CANDIDATES = Made("""select 'e' || p_partkey as candidate, 'f' || (p_partkey % 40) as left_field, 'f' || (p_partkey % 37) as right_field, case p_size % 3 when 0 then 'reviewed' when 1 then 'candidate' else 'rejected' end as status, case when p_partkey % 4 = 0 then 'r1' else 'r2' end as revision,
  cast(p_partkey % 100 + 1 as bigint) as evaluated, cast(p_partkey % 70 + 1 as bigint) as matched, cast(p_partkey % 30 as bigint) as collisions, cast(p_partkey % 90 as bigint) as counterexamples from {part}""")
PACKETS = Made("""select 'left' as side, case p_partkey % 3 when 0 then 'join' else 'object' end as section, case p_partkey % 3 when 0 then 'j' else 'o' end || p_partkey as id, p_name as payload from {part} where p_partkey % 7 <> 3
  union all select 'right', case p_partkey % 3 when 0 then 'join' else 'object' end, case p_partkey % 3 when 0 then 'j' else 'o' end || p_partkey, case when p_partkey % 5 = 1 then p_brand else p_name end from {part} where p_partkey % 11 <> 4""")
DATASETS = Made("select 'D' || s_suppkey as dataset, case s_suppkey % 4 when 0 then 'hive.main.sup_' || s_suppkey when 1 then 'MAIN.sup_' || s_suppkey when 2 then 'sup_' || s_suppkey else 'nowhere.thing' end as source from {supplier}")
MODEL_FIELDS = Made("""select 'D' || s_suppkey as dataset, 'key' as field, 'order_key' as expression from {supplier} union all select 'D' || s_suppkey, 'price', 'retail_price * 2' from {supplier} union all select 'D' || s_suppkey, 'name', 'NAME' from {supplier} union all select 'D' || s_suppkey, 'ref', '"ref_id"' from {supplier} where s_suppkey % 3 = 0""")
