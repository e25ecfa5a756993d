"""Queries of refreshes, retrieval documents, workspaces, knowledge, semantic imports and inferred joins, each beside its SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generated as g
from . import made
from .operators import refresh, relationships, search, semantics, views, workspaces
from .queries_estate import _ANN, _annotated
from .sources import semantic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its own name."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


# refreshes of a generated catalog: an object for each supplier, a field for each of its parts

_O = "select namespace, name as object, type as kind, '' as primary_key, description from {objects}"
_F1 = "select namespace, 'sup_' || substr(parent_id, 8) as object, label as field, position, data_type, nullable, is_primary_key, cast(null as varchar(9)) as description from {fields}"
_F2 = "select namespace, 'sup_' || substr(parent_id, 8) as object, label as field, position, data_type, nullable, is_primary_key, cast(null as varchar(9)) as description from {fields_after} where parent_id <> 'object:7'"
_R1 = "select namespace, name as object, 'fk_' || name as name, array('f_0') as from_fields, namespace as to_namespace, name as to_object, array('f_1') as to_fields from {objects} where id like '%1' or id like '%2'"
_R2 = "select namespace, name as object, 'fk_' || name as name, array('f_' || substr(id, 8)) as from_fields, namespace as to_namespace, name as to_object, array(case when id like '%3' then 'f_' || (cast(substr(id, 8) as int) + 50) else 'f_1' end) as to_fields from {objects} where id like '%2' or id like '%3'"
_A = "select namespace || '.' || object || '.' || field as reference, case when position % 3 = 0 then 'draft' else 'validated' end as state from {f1} where position % 4 <> 1 union all select namespace || '.' || object, 'validated' from {o1}"
_C = "select 'r' || object || field as id, namespace || '.' || object as from_object, field as from_field, namespace || '.' || object as to_object, coalesce(lead(field) over (partition by namespace, object order by cast(substr(field, 3) as int)), field || 'x') as to_field, case when position % 2 = 0 then 'validated' else 'draft' end as state from {f1}"


def _versions(spark, sf_dir):
    objects, fields, after = (g.table(spark, sf_dir, n) for n in ("objects", "fields", "fields_after"))
    o1, f1 = spark.sql(_O, objects=objects), spark.sql(_F1, fields=fields)
    o2, f2 = o1.where("object <> 'sup_7'"), spark.sql(_F2, fields_after=after)
    before, now = (o1, f1, spark.sql(_R1, objects=objects)), (o2, f2, spark.sql(_R2, objects=objects).where("object <> 'sup_7'"))
    return before, now, spark.sql(_A, f1=f1, o1=o1), spark.sql(_C, f1=f1)


def _refreshed(spark, sf_dir):
    return refresh.refresh_graph(*_versions(spark, sf_dir))


def _plain(sql: str) -> str:
    """The same text for DuckDB."""
    return sql.replace("array(", "list_value(").format(**{n: n for n in ("objects", "fields", "fields_after", "f1", "o1")})


def _cat_sql(changes: str) -> str:
    return f"""{g.sql('objects', 'fields', 'fields_after')}, o1 as ({_plain(_O)}), f1 as ({_plain(_F1)}), r1 as ({_plain(_R1)}), o2 as (select * from o1 where object <> 'sup_7'), f2 as ({_plain(_F2)}), r2 as (select * from ({_plain(_R2)}) where object <> 'sup_7'),
 {changes.replace("'main.' || g1.ob", "g1.ns || '.' || g1.ob").replace("select ob, b_p, b_t, b_n, b_k, max(bf) as bf", "select ns, ob, b_p, b_t, b_n, b_k, max(bf) as bf")}, an as ({_plain(_A)}), cd as ({_plain(_C)}),
 nw as (select namespace || '.' || object as reference from o2 union all select namespace || '.' || object || '.' || field from f2), od as (select namespace || '.' || object as reference from o1 union all select namespace || '.' || object || '.' || field from f1),
 ra as (select an.reference, an.state, nw.reference is not null as here, reasons from an left join nw using (reference) left join (select reference, string_agg(distinct kind, ',' order by kind) as reasons from ch where kind in ('field_key_status_changed', 'field_nullability_changed', 'field_removed', 'field_type_changed', 'object_kind_changed', 'object_removed', 'possible_field_rename', 'primary_key_changed') group by 1) using (reference)),
 rc as (select cd.*, case when not exists (select 1 from f2 where f2.namespace || '.' || f2.object = from_object and f2.field = from_field) or not exists (select 1 from f2 where f2.namespace || '.' || f2.object = to_object and f2.field = to_field) then 'endpoint_removed'
   when exists (select 1 from r2 where namespace || '.' || object = from_object and from_fields = [from_field] and to_namespace || '.' || r2.to_object = cd.to_object and to_fields = [to_field]) then 'superseded_by_declared_relationship'
   when state = 'validated' and exists (select 1 from ch where kind in ('field_key_status_changed', 'field_nullability_changed', 'field_removed', 'field_type_changed') and reference in (from_object || '.' || from_field, cd.to_object || '.' || to_field)) then 'relationship_endpoint_changed' end as fate from cd)"""


def refresh_sql(changes: str) -> dict[str, str]:
    """SQL of the refresh queries; changes is the SQL of the catalog's changes."""
    c = _cat_sql(changes)
    return {
        "refreshed_catalog_changes": f"with {c} select * from ch",
        "refreshed_annotations": f"with {c} select reference, case when reasons is not null and state = 'validated' then 'review_required' else state end as state from ra where here",
        "refreshed_relationships": f"with {c} select id, case when fate is not null then 'review_required' else state end as state from rc where fate is null or fate = 'relationship_endpoint_changed'",
        "refreshed_stale_claims": f"with {c} select 'annotation' as claim_type, reference, state as previous_state, here as present, coalesce(reasons, 'node_removed') as reasons from ra where not here or (reasons is not null and state = 'validated') union all select 'relationship', id, state, fate = 'relationship_endpoint_changed', fate from rc where fate is not null",
        "refreshed_counts": f"""with {c} select 'carried_annotations' as name, count(*) as n from ra where here union all select 'review_required_annotations', count(*) from ra where here and reasons is not null and state = 'validated' union all select 'removed_annotated_nodes', count(*) from ra where not here
 union all select 'carried_relationships', count(*) from rc where fate is null or fate = 'relationship_endpoint_changed' union all select 'removed_relationships', (select count(*) from rc where fate = 'endpoint_removed') + (select count(*) from ch where kind = 'relationship_removed')
 union all select 'superseded_relationships', count(*) from rc where fate = 'superseded_by_declared_relationship' union all select 'review_required_relationships', count(*) from rc where fate = 'relationship_endpoint_changed'
 union all select 'added_nodes', count(*) from nw where reference not in (select reference from od) union all select 'removed_nodes', count(*) from od where reference not in (select reference from nw)""",
    }


@_query()
def refreshed_catalog_changes(spark, sf_dir):
    return _refreshed(spark, sf_dir).changes


@_query()
def refreshed_annotations(spark, sf_dir):
    return _refreshed(spark, sf_dir).carried["annotations"]


@_query()
def refreshed_relationships(spark, sf_dir):
    return _refreshed(spark, sf_dir).carried["candidates"].select("id", "state")


@_query()
def refreshed_stale_claims(spark, sf_dir):
    return _refreshed(spark, sf_dir).stale


@_query()
def refreshed_counts(spark, sf_dir):
    return _refreshed(spark, sf_dir).counts


# refreshes of generated lineage

_ITEMS = """select definition, 'claim' as item_type, claim as id, operation || '|' || target as key, state, line % 2 = 0 as declared, 'l' || line as evidence, target, cast(null as varchar(9)) as mode from {claims}
 union all select definition, 'write_unit', unit, unit, state, false, 'l' || line, target, cast(null as varchar(9)) from {units} where role = 'lookup'
 union all select definition, 'materialization', materialization, materialization, state, true, 'l', target, mode from {materializations} union all select definition, 'analysis', 'a' || definition, '', 'complete', false, '', '', cast(null as varchar(9)) from {definitions} where definition like '%2'
 union all select definition, 'analysis_failure', 'f' || definition, '', 'failed', false, '', '', cast(null as varchar(9)) from {definitions} where definition like '%3'"""
_AFTER = "select definition, case when definition like '%4' then 'script' else kind end as kind, language, case when definition like '%6' then content || '!' else content end as content, name, qualified_name, source_reference from {definitions} where definition not like '%8' union all select definition || 'n', kind, language, content, name, qualified_name, source_reference from {definitions} where definition like '%33'"
_NEW = """select definition, item_type, id, key, 'draft' as state, declared, case when id like '%1' then 'moved' else evidence end as evidence, case when id like 'm%0' then target || 'x' else target end as target, mode from {items} where declared and definition not like '%8' and id not like '%5'
 union all select definition || 'n', 'claim', 'new' || definition, 'read|x', 'draft', true, 'l', 'x', cast(null as varchar(9)) from {definitions} where definition like '%33'"""
_LIN = f"""{g.sql('definitions', 'claims', 'units', 'materializations')}, items as ({_ITEMS.format(claims='claims', units='units', materializations='materializations', definitions='definitions')}), aft as ({_AFTER.format(definitions='definitions')}), nit as ({_NEW.format(items='items', definitions='definitions')}),
fa as (select coalesce(b.definition, a.definition) as definition, case when a.definition is null then 'definition_removed' when b.definition is null then 'new' else array_to_string(list_filter([case when a.kind <> b.kind then 'definition_kind_changed' end, case when a.content <> b.content then 'definition_content_changed' end], lambda x: x is not null), ',') end as fate from definitions b full join aft a on a.definition = b.definition),
nc as (select * from nit where item_type = 'claim'),
st as (select i.*, fate, nc.evidence as now, case when fate = 'definition_removed' then 'removed' when i.declared and nc.id is null then 'undeclared' when i.item_type = 'claim' and not i.declared and exists (select 1 from nc x where x.definition = i.definition and x.key = i.key) then 'hidden'
  when fate <> '' and i.item_type like 'analysis%' then 'dropped' when fate <> '' then 'again' when i.declared and nc.evidence <> i.evidence then 'moved' else 'same' end as step from items i join fa using (definition) left join nc on nc.definition = i.definition and nc.id = i.id where i.item_type <> 'materialization'),
kp as (select definition, item_type, id, case when step = 'again' or (step = 'moved' and state = 'validated') then 'review_required' else state end as state from st where step in ('again', 'moved', 'same')),
om as (select * from items where item_type = 'materialization'), nm as (select * from nit where item_type = 'materialization'),
ms as (select coalesce(om.definition, nm.definition) as definition, om.id as oi, nm.id as ni, om.state as os, nm.state as ns, om.target <> nm.target or om.mode <> nm.mode as other from om full join nm on om.definition = nm.definition),
ca as (select * from kp union all select definition, item_type, id, state from nc where id not in (select id from kp) union all select definition, 'materialization', ni, case when oi is null then ns when other then 'review_required' else os end from ms where ni is not null),
sl as (select item_type as claim_type, definition as reference, state as previous_state, step <> 'removed' as present, case when step in ('again', 'dropped') then fate when step = 'removed' then 'definition_removed' when step = 'undeclared' then 'declared_reference_removed' else 'declared_reference_evidence_changed' end as reasons from st where step in ('again', 'dropped', 'removed', 'undeclared', 'moved')
  union all select 'materialization', ms.definition, os, fate <> 'definition_removed', case when fate = 'definition_removed' then fate when ni is null then 'materialization_removed' else 'materialization_changed' end from ms join fa using (definition) where oi is not null and (fate = 'definition_removed' or ni is null or other))"""


def _lineage(spark, sf_dir):
    t = {n: g.table(spark, sf_dir, n) for n in ("definitions", "claims", "units", "materializations")}
    items = spark.sql(_ITEMS, **t)
    after = (spark.sql(_AFTER, definitions=t["definitions"]), spark.sql(_NEW, items=items, definitions=t["definitions"]))
    before = t["definitions"].select("definition", "kind", "language", "content", "name", "qualified_name", "source_reference")
    return (before, items), after


@_query(f"with {_LIN} select * from ca")
def refreshed_lineage_items(spark, sf_dir):
    return refresh.refresh_lineage(*_lineage(spark, sf_dir)).carried["items"].select("definition", "item_type", "id", "state")


@_query(f"with {_LIN} select * from sl")
def refreshed_lineage_stale(spark, sf_dir):
    return refresh.refresh_lineage(*_lineage(spark, sf_dir)).stale


@_query(f"""with {_LIN}, ty as (select 'carried_analyses' as name, 'analysis' as t union all select 'carried_failures', 'analysis_failure' union all select 'carried_claims', 'claim' union all select 'carried_write_units', 'write_unit')
select name, count(ca.id) as n from ty left join ca on ca.item_type = t group by 1 union all select 'review_required_claims', count(*) from st where item_type = 'claim' and (step = 'again' or (step = 'moved' and state = 'validated')) union all select 'review_required_write_units', count(*) from st where item_type = 'write_unit' and step = 'again'
union all select 'added_definitions', count(*) from fa where fate = 'new' union all select 'removed_definitions', count(*) from fa where fate = 'definition_removed'""")
def refreshed_lineage_counts(spark, sf_dir):
    return refresh.refresh_lineage(*_lineage(spark, sf_dir)).counts


@_query(f"""with {_LIN}, b as (select definition, key, arg_max(evidence, id) as e from items where declared and item_type = 'claim' group by 1, 2), a as (select definition, key, arg_max(evidence, id) as e from nc group by 1, 2)
select definition as reference, 'definition_removed' as kind, 'breaking' as severity from fa where fate = 'definition_removed' union all select definition, 'definition_added', 'info' from fa where fate = 'new' union all select definition, 'definition_kind_changed', 'review_required' from fa where fate like '%kind%' union all select definition, 'definition_content_changed', 'review_required' from fa where fate like '%content%'
union all select coalesce(a.definition, b.definition), case when a.e is null then 'declared_reference_removed' when b.e is null then 'declared_reference_added' else 'declared_reference_evidence_changed' end, case when b.e is null then 'info' else 'review_required' end from b full join a on a.definition = b.definition and a.key = b.key where a.e is distinct from b.e
union all select definition, case when ni is null then 'materialization_removed' when oi is null then 'materialization_added' else 'materialization_changed' end, case when oi is null then 'info' else 'review_required' end from ms where ni is null or oi is null or other""")
def lineage_changes(spark, sf_dir):
    return refresh.lineage_changes(*_lineage(spark, sf_dir))


_FLOW = "select 'doc' || s_suppkey as document, 'job' as source_kind, case when s_suppkey % {m} = 1 then 'b' else 'a' end as source_name, 'ref' as source_reference, 'w' || (s_suppkey % {m}) as workflow_name, case when s_suppkey % {m} = 2 then array('s2', 's1') when s_suppkey % {m} = 3 then array('s1', 's3') else array('s1', 's2') end as steps from {supplier}"


@_query("""select 'doc' || s_suppkey as reference, 'source_name_changed' as kind, 'info' as severity from supplier where (s_suppkey % 4 = 1) <> (s_suppkey % 6 = 1) union all select 'doc' || s_suppkey, 'workflow_name_changed', 'info' from supplier where s_suppkey % 4 <> s_suppkey % 6
union all select 'doc' || s_suppkey, 'step_order_changed', 'info' from supplier where s_suppkey % 4 <> 3 and s_suppkey % 6 <> 3 and (s_suppkey % 4 = 2) <> (s_suppkey % 6 = 2)""")
def workflow_changes(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return refresh.workflow_changes(*[spark.sql(_FLOW.replace("{m}", m), supplier=s) for m in ("4", "6")])


@_query("select 'g' || n_nationkey as reference, 'graph_dialect_changed' as kind, 'review_required' as severity, 'd' || (n_nationkey % 3) as before, 'd' || (n_nationkey % 4) as after from nation where n_nationkey % 3 <> n_nationkey % 4")
def graph_changes(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    side = lambda m: n.select(F.concat(F.lit("g"), "n_nationkey").alias("graph"), F.concat(F.lit("d"), F.col("n_nationkey") % m).alias("dialect"), F.lit("db").alias("source_type"))
    return refresh.graph_changes(side(3), side(4))


# retrieval documents and search


def _documented(spark, sf_dir):
    n = _annotated(spark, sf_dir)
    kept = n.withColumn("technical_description", F.col("description")).withColumn("description", F.concat(F.lit("about "), "label")).withColumn("role", F.when(F.col("type") == "field", "key")).withColumn("synonyms", F.array(F.lit("alias"), F.col("type")))
    return kept.withColumn("grain", F.when(F.col("type") != "field", "a row")).withColumn("semantic_type", F.when(F.col("id").like("%3"), "money")).withColumn("is_foreign_key", F.col("id").like("%1"))


_STATES = ("draft", "validated")
_DOCS = f"""{_ANN}, dn as (select nn.graph, nn.catalog, nn.id, nn.type, nn.label, nn.parent_id, nn.state, coalesce(nn.state in ('draft', 'validated'), false) as seen, nn.description as tech, f.position, f.data_type, f.is_primary_key as pk, coalesce(f.namespace, o.namespace) as namespace from nn left join fields f on f.id = nn.id left join objects o on o.id = nn.id),
dt as (select *, case when seen then 'about ' || label else trim(coalesce(tech, '')) end as told, case when seen and type = 'field' then 'key' end as rl, case when seen then 'alias, ' || type end as said, case when (state is null or seen) and type <> 'field' then 'a row' end as gr, case when (state is null or seen) and id like '%3' then 'money' end as sem from dn),
df as (select *, list_filter([case when data_type <> '' then 'data type=' || data_type end, case when sem is not null then 'semantic type=' || sem end, case when pk then 'primary key' end, case when id like '%1' then 'foreign key' end, case when rl is not null then 'role=' || rl end], lambda x: x is not null) as flags from dt where type = 'field'),
fl as (select graph, parent_id, 'Fields:' || chr(10) || string_agg('- ' || label || case when len(flags) > 0 then ' (' || array_to_string(flags, '; ') || ')' else '' end || case when told <> '' then chr(10) || '  Description: ' || told else '' end || case when said <> '' then chr(10) || '  Synonyms: ' || said else '' end, chr(10) order by position, id) as txt from df group by 1, 2),
dd as (select 'object:' || d.id as id, d.id as object_id, null as field_id, namespace, label, concat_ws(chr(10), 'Database object: ' || label, 'Object type: ' || type, 'Catalog: ' || catalog, 'Namespace: ' || namespace, case when told <> '' then 'Description: ' || told end, case when said <> '' then 'Synonyms: ' || said end, case when gr is not null then 'Grain: ' || gr end, fl.txt) as text from dt d left join fl on fl.graph = d.graph and fl.parent_id = d.id where type <> 'field'
 union all select 'field:' || f.id, f.parent_id, f.id, o.namespace, o.label || '.' || f.label, concat_ws(chr(10), 'Database field: ' || o.label || '.' || f.label, 'Parent object: ' || o.label, 'Namespace: ' || o.namespace, case when len(flags) > 0 then 'Properties: ' || array_to_string(flags, ', ') end, case when told <> '' then 'Description: ' || told end, case when rl is not null then 'Role: ' || rl end, case when said <> '' then 'Synonyms: ' || said end) from df f join objects o on o.graph = f.graph and o.id = f.parent_id)"""


@_query(f"with {_DOCS} select id, object_id, field_id, namespace, label, md5(text) as digest from dd")
def retrieval_documents(spark, sf_dir):
    return search.documents(_documented(spark, sf_dir), _STATES).select("id", "object_id", "field_id", "namespace", "label", F.md5(F.col("text").cast("binary")).alias("digest"))


ASKED = "money alias about sup steel"


def _toks(x: str) -> str:
    """The SQL of a text's tokens."""
    return "list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '' and not list_contains(['a', 'an', 'and', 'are', 'as', 'at', 'bei', 'by', 'das', 'der', 'die', 'ein', 'eine', 'for', 'from', 'für', 'in', 'is', 'mit', 'of', 'on', 'or', 'the', 'to', 'und', 'von', 'with'], t))".replace("(text,", f"({x},")


def _vector_sql() -> str:
    toks = _toks("text")
    return f"""tk as (select id, unnest({toks}) as t from dd union all select '?', unnest(['money', 'alias', 'about', 'sup', 'steel'])), pl as (select id, ('0x' || substr(md5(t), 1, 8))::bigint % {search.WIDTH} as p, count(*) as c from tk group by 1, 2),
ln as (select id, sqrt(sum(c * c)) as l from pl group by 1), sc as (select a.id, round(sum(a.c / la.l * (b.c / lb.l)), 6) as score from pl a join ln la on la.id = a.id join pl b on b.id = '?' and b.p = a.p join ln lb on lb.id = '?' where a.id <> '?' group by 1)"""


@_query(f"with {_DOCS}, {_vector_sql()}, al as (select d.id, coalesce(score, 0) as score from dd d left join sc using (id)) select id, score, row_number() over (order by score desc, id)::int as rank from al order by score desc, id limit 25")
def retrieval_vectors(spark, sf_dir):
    from .operators import retrieval

    docs = search.hashed_embedding(search.documents(_documented(spark, sf_dir), _STATES).select("id", "text"))
    asked = list(search.hashed_embedding(spark.createDataFrame([(ASKED,)], "text string")).first().vector)
    return retrieval.vector_topk(docs, asked, 25, "id", "vector")


def _searched(mode: str):
    def run(spark, sf_dir):
        docs = search.documents(_documented(spark, sf_dir), _STATES)
        return search.search(search.hashed_embedding(docs) if mode != "bm25" else docs, ASKED, mode, 10)

    run.__name__ = f"search_{mode}"
    return run


_TERMS = ", ".join(f"'{t}'" for t in ASKED.split())
_LISTS = f"""{_DOCS}, {_vector_sql()}, tb as (select id, label, {_toks("label || ' ' || text")} as ts from dd), qb as (select unnest([{_TERMS}]) as term), sb as (select count(*) as docs, avg(len(ts)) as mean from tb),
pb as (select id, term, count(*) as tf from (select id, unnest(ts) as term from tb) group by 1, 2), fb as (select term, count(*) as df from pb group by 1),
bs as (select id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(ts) / greatest(mean, 1.0)))), 9) as score from qb join pb using (term) join fb using (term) join tb using (id), sb group by 1),
l_bm25 as (select id, score, rank from (select id, score, row_number() over (order by score desc, lower(label), id) as rank from bs join tb using (id)) where rank <= 50),
l_vector as (select id, score, rank from (select d.id, coalesce(score, 0) as score, row_number() over (order by coalesce(score, 0) desc, d.id) as rank from dd d left join sc using (id)) where rank <= 50),
l_hybrid as (select id, round(sum(1 / (60 + rank)), 9) as score, list(distinct source) as sources from (select id, rank, 'bm25' as source from l_bm25 union all select id, rank, 'vector' from l_vector) group by 1 order by score desc, id limit 50)"""


def _searched_sql(mode: str) -> str:
    own = "sources" if mode == "hybrid" else f"['{mode}']"
    return f"""with {_LISTS}, h as (select l.id, l.score, {own} as sources, object_id, field_id, list_filter({_toks('text')}, lambda t: list_contains([{_TERMS}], t)) as met from l_{mode} l join dd using (id)),
r as (select *, row_number() over (partition by object_id order by score desc, field_id nulls first) as r from h)
select object_id, greatest(1, round(max(score) * 1000000))::bigint as score, coalesce(string_agg(field_id, ',' order by r) filter (where r <= 8 and field_id is not null), '') as fields, array_to_string(list_sort(list_distinct(flatten(list(sources)))), '+') as sources,
array_to_string(list_sort(list_distinct(flatten(list(met)))), ',') as matched from r group by object_id order by score desc, object_id limit 10"""


for _mode in ("bm25", "vector", "hybrid"):
    _query(_searched_sql(_mode))(_searched(_mode))


# workspaces


def _clean_workspace(spark, sf_dir):
    """Systems, areas and zones in which every graph, schema and member has one place."""
    objects = g.table(spark, sf_dir, "objects")
    systems = objects.select(F.when(F.col("graph") == "g0", "erp").otherwise("crm").alias("system"), "graph").distinct()
    areas = objects.where("namespace <> 'ns3'").select(F.when(F.col("graph") == "g0", "erp").otherwise("crm").alias("system"), F.concat(F.lit("area_"), "namespace").alias("area"), "graph", "namespace").distinct()
    zones = objects.where("namespace <> 'ns3'").select(F.when(F.col("graph") == "g0", "erp").otherwise("crm").alias("system"), F.concat(F.lit("zone"), F.length("id") + F.substring("id", -1, 1).cast("int") % 3).alias("zone"), "graph", F.col("id").alias("object_id"))
    return {"systems": systems, "areas": areas, "zones": zones}, objects


_SCOPE = f"""{g.sql('objects', 'fields')}, mb as (select case graph when 'g0' then 'erp' else 'crm' end as system, graph, case when namespace <> 'ns3' then 'area_' || namespace end as area, namespace, id as object_id, label, type, case when namespace <> 'ns3' then 'zone' || (length(id) + right(id, 1)::int % 3) end as zone from objects)"""
_SELECT = "zone in (select 'zone' || (8 + x) from (values (0), (1)) v(x)) or zone in (select 'zone' || (9 + x) from (values (0), (1)) v(x))"


@_query(f"with {_SCOPE} select system, graph, area, namespace, object_id, label, type, case when zone is null then '' else system || ':' || zone end as zones from mb where area in ('area_ns0', 'area_ns1') and zone = (select min(zone) from mb) and system = 'erp'")
def workspace_scope_resolved(spark, sf_dir):
    tables, objects = _clean_workspace(spark, sf_dir)
    first = tables["zones"].agg(F.min("zone")).first()[0]
    wanted = spark.createDataFrame([("system", "erp"), ("area", "erp:area_ns0"), ("area", "erp:area_ns1"), ("zone", f"erp:{first}")], "kind string, name string")
    known = tables["areas"].where("system = 'erp' and area in ('area_ns0', 'area_ns1')").select(F.concat_ws(":", "system", "area").alias("name")).distinct()
    wanted = wanted.where("kind <> 'area'").union(known.select(F.lit("area"), "name"))
    return workspaces.resolve_scope(tables, objects, wanted).withColumn("zones", F.array_join("zones", ","))


_SEL = "select 'system' as kind, 'erp' as name union all select 'system', 'hr' union all select 'area', 'area_ns0' union all select 'area', 'erp:area_ns0' union all select 'zone', 'zone99' union all select 'schema', 'g1:ns1' union all select 'schema', 'g1:ns9' union all select 'graph', 'g0'"


@_query(f"""with {_SCOPE}, s as ({_SEL}), k as (select distinct 'system' as kind, system as name, system as thing from mb union select 'graph', graph, graph from mb union select 'area', area, system || ':' || area from mb where area is not null union select 'area', system || ':' || area, system || ':' || area from mb where area is not null
 union select 'zone', zone, system || ':' || zone from mb where zone is not null union select 'schema', graph || ':' || namespace, graph || ':' || namespace from mb)
select case when count(thing) = 0 then kind || '_not_found' else 'ambiguous_scope_selector' end as rule, kind || ':' || name as key from s left join k using (kind, name) group by kind, name having count(thing) <> 1""")
def workspace_selectors(spark, sf_dir):
    return workspaces.selector_violations(*_clean_workspace(spark, sf_dir), spark.sql(_SEL))


@_query(f"with {_SCOPE} select graph, area, namespace, label, type, object_id from mb where system = 'crm' and zone = (select min(zone) from mb where system = 'crm')")
def workspace_zone(spark, sf_dir):
    tables, objects = _clean_workspace(spark, sf_dir)
    first = tables["zones"].where("system = 'crm'").agg(F.min("zone")).first()[0]
    return workspaces.resolve_zone(tables, objects, "crm", first)


@_query(f"""with {_SCOPE}, sc as (select * from mb where area = 'area_ns0') select 'scope::' || graph || '::' || object_id as id, type, graph || ':' || label as label, null as parent_id, graph from sc
union all select 'scope::' || f.graph || '::' || f.id, 'field', f.label, 'scope::' || f.graph || '::' || f.parent_id, f.graph from fields f join sc on sc.graph = f.graph and sc.object_id = f.parent_id""")
def workspace_projection_nodes(spark, sf_dir):
    return _projected(spark, sf_dir)[0]


def _projected(spark, sf_dir):
    tables, objects = _clean_workspace(spark, sf_dir)
    scope = workspaces.members(tables, objects).where("area = 'area_ns0'")
    fields = g.table(spark, sf_dir, "fields")
    edges = fields.select("graph", F.concat(F.lit("contains:"), "id").alias("id"), F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("type"))
    rels = objects.alias("a").join(objects.alias("b"), F.expr("a.namespace = b.namespace and a.graph < b.graph")).select(F.expr("concat('rel-', a.id, b.id)").alias("id"), F.col("a.graph").alias("source_graph"), F.col("a.id").alias("source_object"), F.col("b.graph").alias("target_graph"), F.col("b.id").alias("target_object"))
    return workspaces.project(scope, g.table(spark, sf_dir, "nodes"), edges, rels)


@_query(f"""with {_SCOPE}, sc as (select * from mb where area = 'area_ns0') select 'scope::' || f.graph || '::edge::contains:' || f.id as id, 'scope::' || f.graph || '::' || f.parent_id as source_id, 'scope::' || f.graph || '::' || f.id as target_id, 'contains' as type from fields f join sc on sc.graph = f.graph and sc.object_id = f.parent_id
union all select 'workspace::rel-' || a.object_id || b.object_id, 'scope::' || a.graph || '::' || a.object_id, 'scope::' || b.graph || '::' || b.object_id, 'relationship_candidate' from sc a join sc b on a.graph < b.graph""")
def workspace_projection_edges(spark, sf_dir):
    return _projected(spark, sf_dir)[1]


_CROSS = "select 'g' || (s_suppkey % 2) || ':ns' || (s_nationkey % 4) || '.sup_' || s_suppkey || '.f_' || s_suppkey as source, 'g' || (s_suppkey % 2) || ':NS' || (s_nationkey % 4) || '.sup_' || s_suppkey || case when s_suppkey % 3 = 0 then '.f_' || s_suppkey when s_suppkey % 3 = 1 then '.f_x' else '.F_' || (s_suppkey + {n}) end as target, case when s_suppkey % 8 = 2 then '' else 'known' end as reason, s_suppkey % 2 = 0 as validated from {supplier}"


def _crossed(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    fields = g.table(spark, sf_dir, "fields").alias("f").join(g.table(spark, sf_dir, "objects").alias("o"), F.expr("o.graph = f.graph and o.id = f.parent_id")).select("f.graph", F.concat_ws(".", "o.label", "f.label").alias("reference"), F.col("o.id").alias("object_id"), "f.label")
    return workspaces.cross_relationships(spark.sql(_CROSS.replace("{n}", str(supplier.count())), supplier=supplier), fields, spark.createDataFrame([], "id string"))


_CR = f"{g.sql('objects', 'fields')}, p as ({_CROSS.replace('{n}', '(select count(*) from supplier)').format(supplier='supplier')})"


@_query(f"with {_CR} select case when target like '%f_x' then 'field_resolved' when lower(source) = lower(target) then 'fields_differ' else 'reason_given' end as rule, source || '->' || target as key from p where target like '%f_x' or lower(source) = lower(target) or reason = ''")
def workspace_relationships_refused(spark, sf_dir):
    return _crossed(spark, sf_dir)[1]


@_query(f"""with {_CR}, e as (select split_part(source, ':', 1) as gr, 'object:' || regexp_extract(source, 'sup_([0-9]+)', 1) as ob, regexp_extract(source, '\\.(f_[0-9]+)$', 1) as sf, lower(regexp_extract(target, '\\.([fF]_[0-9]+)$', 1)) as tf, validated from p where target not like '%f_x' and lower(source) <> lower(target) and reason <> '')
select 'rel-' || substr(sha256(array_to_string(list_sort([gr || chr(31) || ob || chr(31) || sf, gr || chr(31) || ob || chr(31) || tf]), chr(10))), 1, 20) as id, case when validated then 'validated' else 'draft' end as state, gr as source_graph, ob as source_object, sf as source_field, tf as target_field from e""")
def workspace_relationships(spark, sf_dir):
    return _crossed(spark, sf_dir)[0].select("id", "state", "source_graph", "source_object", "source_field", "target_field")


# focus


@_query("""with h as (select 'n' || l_suppkey as source, 'n' || (l_partkey % 7) as target, l_linenumber as depth, case when l_linenumber % 2 = 0 then 'reads_from' else 'derived_from' end as relation from lineitem),
u as (select source as node, depth, 'upstream:' || relation as r from h union all select target, greatest(depth - 1, 0), 'downstream:' || relation from h union all select 'n0', 0, 'seed')
select node, min(depth)::int as depth, string_agg(distinct r, ',' order by r) as reasons, node = 'n5' as origin from u group by 1""")
def focus_snapshot(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hops = l.select(F.concat(F.lit("n"), "l_suppkey").alias("source"), F.concat(F.lit("n"), F.col("l_partkey") % 7).alias("target"), F.col("l_linenumber").alias("depth"), F.when(F.col("l_linenumber") % 2 == 0, "reads_from").otherwise("derived_from").alias("relation"))
    return workspaces.focus(hops, spark.createDataFrame([("n5",)], "node string"), "n0")


@_query("select 'graph' as kind, n_name as name, case when n_nationkey % 5 = 0 then 'missing' else 'changed' end as problem from nation where n_nationkey % 5 = 0 or n_nationkey % 4 = 1")
def focus_stale(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    recorded = n.select(F.lit("graph").alias("kind"), F.col("n_name").alias("name"), F.lit("r1").alias("revision"))
    current = n.where("n_nationkey % 5 <> 0").select(F.lit("graph").alias("kind"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 1, "r2").otherwise("r1").alias("revision"))
    return workspaces.stale_sources(recorded, current)


# knowledge


def _applies(spark, docs, nodes):
    return workspaces.applies(docs, nodes, spark.createDataFrame([("erp", "g0")], "system string, graph string"), "home")


@_query(f"""with {g.sql('knowledge', 'objects')} select distinct k.id, o.graph, o.id as node from knowledge k join objects o on kind = 'global' or (kind = 'system' and lower(k.workspace) = 'home' and lower(reference) = 'erp' and o.graph = 'g0') or (kind = 'graph' and lower(reference) = lower(o.graph))
 or (kind = 'schema' and lower(k.graph) = lower(o.graph) and lower(reference) = lower(o.namespace)) or (kind = 'object' and lower(k.graph) = lower(o.graph) and lower(reference) in (lower(o.id), lower(o.label), lower(o.name)))""")
def knowledge_applies(spark, sf_dir):
    return _applies(spark, g.table(spark, sf_dir, "knowledge"), g.table(spark, sf_dir, "objects"))


@_query(f"""with {g.sql('knowledge', 'objects')}, c as (select id, content, kind, id in ('k4', 'k11') as ex, case kind when 'global' then 0 when 'system' then 1 when 'graph' then 2 when 'schema' then 3 else 4 end as rk from knowledge k where id in ('k4', 'k11') or kind = 'global' or (kind = 'graph' and reference = 'g1') or (kind = 'schema' and k.graph = 'G1' and lower(reference) = (select namespace from objects where id = 'object:1')) or (kind = 'object' and k.graph = 'G1' and reference = 'sup_1')),
b as (select *, coalesce(sum(length(content)) over (order by ex desc, rk desc, lower(id), id rows between unbounded preceding and 1 preceding), 0) as bf from c where length(content) > 0)
select id, row_number() over (order by rk, lower(id), id)::int as place, least(length(content), 5000 - bf)::bigint as characters, 5000 - bf < length(content) as truncated, md5(substr(content, 1, least(length(content), 5000 - bf)::int)) as digest from b where bf < 5000""")
def knowledge_resolved(spark, sf_dir):
    docs = g.table(spark, sf_dir, "knowledge")
    here = g.table(spark, sf_dir, "objects").where("graph = 'g1' and id = 'object:1'")
    taken, _ = workspaces.resolve_knowledge(docs, _applies(spark, docs, here), "g1", "object:1", 5000, asked=("k4", "k11"))
    return taken.select("id", "place", "characters", "truncated", F.md5(F.col("content").cast("binary")).alias("digest"))


# semantic imports

_KEYED = "s_suppkey % 4 <> 2 and s_suppkey % 13 <> 4 and s_suppkey % 17 <> 5"


def _cube(spark, sf_dir):
    """A cube for each object, in a file of its own, joined to another one; its parts bound to the objects and their keys."""
    files = {}
    for (k,) in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect():  # files of a repository of models
        dimensions = [{"name": "order_key", "sql": "order_key", "primary_key": True}, {"name": "title", "sql": "NAME"}, {"name": "double_price", "sql": "retail_price * 2"}, {"name": "ref_id", "sql": '"ref_id"', **({"meta": 1} if k % 5 == 0 else {})}]
        joins = [{"name": f"c{(k + 1) // 2}", "sql": f"{{CUBE}}.ref_id = {{c{(k + 1) // 2}.order_key}}"}] if k > 1 else []
        cube = {"name": f"c{k}", "sql_table": ["main.sup_", "hive.main.sup_", "SUP_"][k % 3] + str(k), "dimensions": dimensions, "measures": [{"name": "count", "type": "count"}], "joins": joins}
        files[f"cubes/c{k}.json"] = json.dumps({"cubes": [cube]})
    tables = semantic.read_import("shop", "cube", files).tables(spark)
    return tables, semantics.bind(tables, *[t.df(spark, sf_dir) for t in (made.OBJECTS, made.FIELDS, made.RELATIONSHIPS)], "hive")


@_query(f"""with f(n, t) as (values ('order_key', 'order_key'), ('title', 'name'), ('ref_id', 'ref_id')) select 'model:shop/dataset:c' || s_suppkey as id, 'dataset' as kind, 'main.sup_' || s_suppkey as target from supplier
union all select 'model:shop/dataset:c' || s_suppkey || '/field:' || n, 'field', t from supplier, f
union all select 'model:shop/relationship:c' || s_suppkey || '_to_c' || (s_suppkey + 1) // 2, 'relationship', 'fk_' || s_suppkey from supplier where s_suppkey > 1 and {_KEYED}""")
def semantic_cube_bindings(spark, sf_dir):
    return _cube(spark, sf_dir)[1][0]


@_query(f"""select 'warning' as level, 'field_not_bound' as code, 'cubes/c' || s_suppkey || '.json#/cubes/0/dimensions/2' as source_reference from supplier
union all select 'warning', 'unknown_key', 'cubes/c' || s_suppkey || '.json#/cubes/0/dimensions/3/meta' from supplier where s_suppkey % 5 = 0
union all select 'warning', 'relationship_not_bound', 'cubes/c' || s_suppkey || '.json#/cubes/0/joins/0' from supplier where s_suppkey > 1 and not ({_KEYED})""")
def semantic_cube_diagnostics(spark, sf_dir):
    return _cube(spark, sf_dir)[1][1]


@_query(f"""select 'dataset' as kind, count(*) as parts, count(*) as bound from supplier union all select 'field', 4 * count(*), 3 * count(*) from supplier union all select 'metric', count(*), 0 from supplier union all select 'model', 1, 0
union all select 'relationship', count(*), count(*) filter (where {_KEYED}) from supplier where s_suppkey > 1""")
def semantic_cube_summary(spark, sf_dir):
    tables, (bound, _) = _cube(spark, sf_dir)
    return semantics.summary(semantics.targets(tables), bound)


_EDITED = "select l_orderkey * 10 + l_linenumber as edit, 'p' || l_partkey as id, 'text ' || l_orderkey || '-' || l_linenumber as description, case when l_suppkey % 5 = 0 then ' ' else 'seen' end as reason from {lineitem} where l_orderkey % 2 = 0"


@_query(f"""with e as ({_EDITED.format(lineitem='lineitem')}), l as (select id, arg_max(description, edit) as d, count(*) as n from e where trim(reason) <> '' group by 1) select 'p' || p_partkey as id, 'field' as kind, coalesce(d, p_name) as description, p_name as original, coalesce(n, 0) as edits from part left join l on l.id = 'p' || p_partkey""")
def semantic_edits(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("field").alias("kind"), F.col("p_name").alias("description"))
    edits = spark.sql(_EDITED, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return semantics.effective(parts, edits)


# joins through segments of keys

_KEYS = "select 'F_SALES' as object, 'SALE_KEY' as field, case when o_orderkey % 9 = 1 then 'legacy' else 'CUST' || lpad(cast(o_custkey as varchar(9)), 9, '0') || 'PRT' || lpad(cast(o_orderkey % 100 as varchar(9)), 5, '0') end as value from {orders} union all select 'F_SALES', 'NOTE', o_orderpriority from {orders} union all select 'D_X', 'CODE', 'A' || lpad(cast(c_custkey as varchar(9)), 6, '0') from {customer}"


def _keys(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    values = spark.sql(_KEYS, orders=read("orders"), customer=read("customer"))
    fields = spark.createDataFrame([("F_SALES", "SALE_KEY", "varchar(30)", True), ("F_SALES", "NOTE", "varchar(30)", False), ("D_X", "CODE", "varchar(9)", False)], "object string, field string, data_type string, is_key boolean")
    ids = lambda t, c, o, f: read(t).select(F.lit(o).alias("object"), F.lit(f).alias("field"), F.lit(True).alias("numeric"), F.col(c).cast("string").alias("value"))
    targets = ids("customer", "c_custkey", "D_CUST", "CUST_ID").union(ids("customer", "c_custkey", "D_CUST_ALT", "CUST_ID")).union(ids("part", "p_partkey", "Product_Ref_Table", "ID")).union(ids("supplier", "s_suppkey", "D_ACCT", "ACCT_KY"))
    return values, fields, targets


_KP = f"""k as ({_KEYS.format(orders='orders', customer='customer')}), fr as (select object, field, regexp_replace(regexp_replace(value, '[0-9]+', '{{digits_1:' || length(regexp_extract(value, '[0-9]+')) || '}}'), '([A-Z])([0-9]+)$', '\\1{{digits_2:' || length(regexp_extract(value, '[0-9]+$')) || '}}') as p, value from k)"""


@_query("""with n as (select count(*) as n, count(*) filter (o_orderkey % 9 <> 1) as m from orders), c as (select count(*) as n from customer) select 'F_SALES' as object, 'SALE_KEY' as field, 'CUST{digits_1:9}PRT{digits_2:5}' as pattern, n as sample_count, m as match_count, m / n as pattern_coverage, 2 as components from n
union all select 'D_X', 'CODE', 'A{digits_1:6}', n, n, 1.0, 1 from c""")
def key_patterns(spark, sf_dir):
    return relationships.dominant_patterns(_keys(spark, sf_dir)[0]).where("field <> 'NOTE'")


@_query("""with a as (select distinct o_custkey as v from orders where o_orderkey % 9 <> 1), b as (select distinct o_orderkey % 100 as v from orders where o_orderkey % 9 <> 1), pc as (select count(*) filter (o_orderkey % 9 <> 1) / count(*) as c from orders),
x as (select 1 as component, 'D_CUST' as t, 'CUST_ID' as f, (select count(*) from a) as sd, (select count(*) from a join customer on c_custkey = v) as ov union all select 2, 'Product_Ref_Table', 'ID', (select count(*) from b), (select count(*) from b join part on p_partkey = v))
select 'F_SALES' as from_object, 'SALE_KEY' as from_field, component, 'CUST{digits_1:9}PRT{digits_2:5}' as pattern, t as to_object, f as to_field, ov as overlap, round(ov / sd, 6) as source_coverage, round(least(0.95, 0.15 + 0.25 * c + 0.3 * ov / sd + 0.2 + least(0.1, ov / 100)), 4) as confidence from x, pc""")
def transformed_candidates(spark, sf_dir):
    return relationships.transformed_candidates(*_keys(spark, sf_dir))


_OLD = "select 'c' || p_partkey as id, 'a' as from_object, 'x' || p_partkey as from_field, 'b' as to_object, 'y' as to_field, 'validated' as state, 'human' as origin from {part} where p_partkey % 3 = 0"


@_query(f"""with o as ({_OLD.format(part='part')}) select id, from_field, state, origin from o union all select 'relationship_candidate:' || substr(sha256('a/x' || p_partkey || chr(10) || 'b/y'), 1, 20), 'x' || p_partkey, 'draft', 'profile' from part where p_partkey % 3 <> 0 and p_partkey % 2 = 0""")
def relationships_discovered(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = part.where("p_partkey % 2 = 0").select(F.lit("a").alias("from_object"), F.concat(F.lit("x"), "p_partkey").alias("from_field"), F.lit("b").alias("to_object"), F.lit("y").alias("to_field"))
    return relationships.add_candidates(spark.sql(_OLD, part=part), found).select("id", "from_field", "state", "origin")


# views

_TL = "select distinct 'raw.t' || l_suppkey as source, case when l_partkey % 3 = 0 then 'ns0 . [sup_0]' else 'dw.w' || (l_partkey % 20) end as target, 'job' || (l_partkey % 7) as via from {lineitem}"
_ST = "select 's' || n_nationkey as step, 'job' || (n_nationkey % 7) as via, case when n_nationkey > 0 then 's' || (n_nationkey - 1) end as dependency from {nation}"
_FLOWS = f"""{g.sql('objects')}, tl as ({_TL.format(lineitem='lineitem')}), st as ({_ST.format(nation='nation')}), rf as (select distinct reference, lower(trim(regexp_replace(translate(reference, '[]\"`', ''), '\\s*\\.\\s*', '.', 'g'))) as n from (select unnest([source, target]) as reference from tl)),
nm as (select reference, coalesce(o.id, 'lineage-ref::' || substr(sha256(n), 1, 20)) as node, o.id is null as new from rf left join (select lower(label) as l, max(id) as id from objects group by 1 having count(*) = 1) o on l = n)"""


def _flows(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return views.lineage_flows(spark.sql(_TL, lineitem=read("lineitem")), spark.sql(_ST, nation=read("nation")), g.table(spark, sf_dir, "objects").select("id", F.col("label").alias("reference")))


@_query(f"with {_FLOWS} select node as id, 'asset' as kind, min(reference) as label from nm where new group by 1 union all select distinct 'job::' || via, 'job', via from (select via from tl union all select via from st)")
def lineage_flow_nodes(spark, sf_dir):
    return _flows(spark, sf_dir)[0]


@_query(f"""with {_FLOWS} select distinct * from (select a.node as source, 'job::' || via as target, 'reads' as relation from tl join nm a on a.reference = source union all select 'job::' || via, b.node, 'writes' from tl join nm b on b.reference = target
union all select 'job::' || p.via, 'job::' || st.via, 'precedes' from st join st p on p.step = st.dependency)""")
def lineage_flow_edges(spark, sf_dir):
    return _flows(spark, sf_dir)[1]


@_query(f"with {_ANN} select case coalesce(state, 'missing') when 'draft' then 0 when 'review_required' then 1 when 'deferred' then 2 when 'missing' then 3 when 'validated' then 4 else 5 end as place, id, label, coalesce(state, 'missing') as state from nn where type <> 'field'")
def annotation_queue(spark, sf_dir):
    return views.review_queue(_annotated(spark, sf_dir).where("type <> 'field'"))


@_query("with e as (select 'p' || l_partkey as a, 's' || l_suppkey as b from lineitem), d as (select unnest([a, b]) as id from e) select id, count(*) as degree from d group by 1")
def graph_degrees(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return views.degrees(l.select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id")))


@_query("with e as (select 'p' || l_partkey as a, 's' || l_suppkey as b from lineitem), d as (select unnest([a, b]) as id from e) select id, count(*) as degree from d group by 1 order by 2 desc, 1 limit 1")
def most_connected(spark, sf_dir):
    return graph_degrees(spark, sf_dir).orderBy(F.desc("degree"), "id").limit(1)


@_query(f"with {g.sql('objects', 'fields')} select o.id, o.label, o.type, (select string_agg(label, ',' order by position, label) from fields where parent_id = 'object:1') as fields, coalesce((select string_agg(distinct 'e' || id, ',' order by 'e' || id) from fields where parent_id = 'object:1' and is_primary_key), '') as joins from objects o where id = 'object:1'")
def asset_described(spark, sf_dir):
    fields = g.table(spark, sf_dir, "fields")
    nodes = fields.select("id", "type", "label", "parent_id", "position").unionByName(g.table(spark, sf_dir, "objects").select("id", "type", "label", "parent_id"), allowMissingColumns=True)
    edges = fields.where("is_primary_key").select(F.concat(F.lit("e"), "id").alias("id"), F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"))
    return views.asset(nodes, edges, "object:1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql(changes: str) -> dict[str, str]:
    return SQL | refresh_sql(changes)
