"""Queries of the network, reviews, refreshes and constraints over generated tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generated as g
from .operators import constraints as con
from .operators import network as net
from .operators import refresh, retrieval, review

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


def _norm(c: str) -> str:
    return f"lower(trim(regexp_replace(translate({c}, '[]\"`', ''), '\\s*\\.\\s*', '.', 'g')))"


# the network


def _nodes(spark, sf_dir):
    return net.definition_nodes(g.table(spark, sf_dir, "definitions")).unionByName(net.technical_nodes(g.table(spark, sf_dir, "nodes")))


def _network(spark, sf_dir, states=net.DEFAULT_STATES):
    t = [g.table(spark, sf_dir, n) for n in ("claims", "materializations", "units", "fields")]
    return net.network(_nodes(spark, sf_dir), *t[:3], states, t[3])


_NET = f"""{g.sql('definitions', 'claims', 'units', 'materializations', 'nodes')},
an as (select 'lineage:' || document || ':' || definition as node, unnest([definition, external_id, name, qualified_name]) as a from definitions
  union all select 'graph:' || n.graph || ':' || n.id, unnest([n.id, case when p.label is null then n.label else p.label || '.' || n.label end, n.catalog || '.' || case when p.label is null then n.label else p.label || '.' || n.label end]) from nodes n left join nodes p on n.type = 'field' and p.graph = n.graph and p.id = n.parent_id),
al as (select {_norm('a')} as alias, list_sort(list(distinct node)) as ids from an group by 1),
rf as (select distinct reference from (select target as reference from claims where operation = 'read' and state <> 'rejected' union all select target from materializations where state <> 'rejected' union all select unnest([target, source]) from units where state <> 'rejected')),
rs as (select reference, coalesce(ids[1], 'external:' || {_norm('reference')}) as node, ids is null as outside from rf left join al on alias = {_norm('reference')}),
ed as (select 'lineage:' || document || ':claim:' || claim as id, a.node as source, 'lineage:' || document || ':' || definition as target, 'reads_from' as relation, state, document, null as role from claims join rs a on a.reference = target where operation = 'read' and state <> 'rejected'
  union all select 'lineage:' || document || ':materialization:' || materialization, 'lineage:' || document || ':' || definition, a.node, 'materializes_as', state, document, null from materializations join rs a on a.reference = target where state <> 'rejected'
  union all select 'lineage:' || document || ':write:' || unit || ':source:' || substr(sha256({_norm('source')} || chr(31) || role || chr(31) || line), 1, 16), b.node, a.node, 'derived_from', state, document, role from units join rs a on a.reference = target join rs b on b.reference = source where state <> 'rejected'
  union all select 'graph:' || graph || ':field-scope:' || id, 'graph:' || graph || ':' || parent_id, 'graph:' || graph || ':' || id, 'field_of', 'observed', null, null from nodes where type = 'field')"""


@_query(f"with {_NET} select * from ed")
def network_edges(spark, sf_dir):
    return _network(spark, sf_dir)[1]


@_query(f"""with {_NET} select id, reference, kind from (select 'lineage:' || document || ':' || definition as id, qualified_name as reference, kind from definitions
 union all select 'graph:' || n.graph || ':' || n.id, n.catalog || '.' || case when p.label is null then n.label else p.label || '.' || n.label end, n.type from nodes n left join nodes p on n.type = 'field' and p.graph = n.graph and p.id = n.parent_id
 union all select node, min(reference), 'unresolved' from rs where outside group by node)""")
def network_nodes(spark, sf_dir):
    return _network(spark, sf_dir)[0].select("id", "reference", "kind")


@_query(f"""with {_NET}, tw as (select node, alias from (select node, {_norm('a')} as alias from an) union select 'lineage:copy:' || definition, lower(qualified_name) from definitions where definition like '%5')
select 'ambiguous_lineage_reference' as rule, reference as key from rf join tw on tw.alias = {_norm('reference')} group by reference having count(distinct node) > 1""")
def network_ambiguous(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    copies = net.definition_nodes(g.table(spark, sf_dir, "definitions").where("definition like '%5'").withColumn("document", F.lit("copy"))).withColumn("aliases", F.array("reference"))
    refs = net.references(*[g.table(spark, sf_dir, n) for n in ("claims", "materializations", "units")])
    return net.ambiguous(refs, nodes.unionByName(copies))


START, HOPS = "MART . [m5]", 6
_WALK = f"""pa as (select id as node, [id] as path, 0 as depth from (select ids[1] as id from al where alias = 'mart.m5' union all select node from rs where outside and {_norm('reference')} = 'mart.m5' limit 1)
  union all select e.source, min(list_append(p.path, e.source)), max(p.depth) + 1 from pa p join ed e on e.target = p.node where p.depth < {HOPS} and not list_contains(p.path, e.source) and p.depth = p.depth group by e.source, p.depth),
fs as (select node, min(depth) as depth from pa group by 1), fp as (select pa.node, pa.depth, min(pa.path) as path from pa join fs on fs.node = pa.node and fs.depth = pa.depth group by 1, 2),
hp as (select e.id, fp.depth + 1 as depth, e.source, e.target, e.relation, e.state, list_contains(fp.path, e.source) as cycle from fp join ed e on e.target = fp.node where fp.depth < {HOPS})"""


def _trace(spark, sf_dir, hops=HOPS):
    return net.trace_upstream(*_network(spark, sf_dir), START, hops)


@_query(f"with recursive {_NET}, {_WALK} select * from hp")
def trace_hops(spark, sf_dir):
    return _trace(spark, sf_dir).hops


@_query(f"with recursive {_NET}, {_WALK} select node from (select source as node from hp union select target from hp) where node not in (select target from ed)")
def trace_origins(spark, sf_dir):
    return _trace(spark, sf_dir).origins


@_query(f"""with recursive {_NET}, {_WALK}, rr as (select 'lineage:' || document || ':' || definition as node, qualified_name as r, kind from definitions union all select node, min(reference), 'unresolved' from rs where outside group by node), hr as (select hp.*, r, kind from hp left join rr on rr.node = hp.source)
select distinct warning from (select '{net.WIDENS}' as warning from hp where relation = 'field_of' union all select '{net.UNVALIDATED}' from hp where state in ('draft', 'review_required') union all select 'Unresolved upstream reference: ' || r from hr where kind = 'unresolved' union all select 'Lineage cycle detected at: ' || r from hr where cycle
 union all select '{net.NOTHING}' where not exists (select 1 from hp) union all select 'Trace stopped at the configured max_hops={HOPS} boundary.' from fs join ed on ed.target = fs.node where fs.depth = {HOPS})""")
def trace_warnings(spark, sf_dir):
    return _trace(spark, sf_dir).warnings


FIND = "[ETL] . load_7"


@_query(f"""with {_NET}, nn as (select node as id, a from an union all select node, reference from rs where outside), q as (select 'etl.load_7' as needle),
nm as (select 'lineage:' || document || ':' || definition as id, name, qualified_name as reference, kind, summary as description, 0 as outside from definitions
  union all select 'graph:' || n.graph || ':' || n.id, n.label, n.catalog || '.' || case when p.label is null then n.label else p.label || '.' || n.label end, n.type, n.description, 1 from nodes n left join nodes p on n.type = 'field' and p.graph = n.graph and p.id = n.parent_id
  union all select node, min(reference), min(reference), 'unresolved', null, 1 from rs where outside group by node),
ar as (select id, list({_norm('a')}) as als, string_agg(a, ' ') as txt from nn group by 1),
sc as (select nm.id, case when {_norm('name')} = needle or list_contains(als, needle) then 0 when len(list_filter(als, lambda x: ends_with(x, '.' || needle))) > 0 then 1 when contains({_norm('name')}, needle) then 2 when len(list_filter(als, lambda x: contains(x, needle))) > 0 then 3 else 4 end as rank_class,
  (select count(*) from (select distinct unnest(['etl', 'load', '7']) as t) where list_contains(string_split_regex(lower(reference || ' ' || name || ' ' || kind || ' ' || coalesce(description, '') || ' ' || txt), '[^a-z0-9]+'), t)) as matched, outside, length({_norm('name')}) as size, lower(reference) as ref from nm join ar on ar.id = nm.id, q)
select id, rank_class::int as rank_class, matched::int as matched from sc where rank_class < 4 or matched > 0 order by rank_class, matched desc, outside, size, ref, id limit 20""")
def network_find(spark, sf_dir):
    return net.lexical(_network(spark, sf_dir)[0], FIND).orderBy(*net.lexical_order()).limit(20).select("id", "rank_class", "matched")


@_query()
def network_find_hybrid(spark, sf_dir):
    nodes = _network(spark, sf_dir)[0]
    words = retrieval.bm25(net.retrieval_documents(nodes), FIND, 50, "id", label=F.col("label"))
    exact = net.lexical(nodes, FIND).orderBy(*net.lexical_order()).limit(50).coalesce(1)
    place = exact.withColumn("rank", (F.monotonically_increasing_id() + 1).cast("int")).select("id", "rank")
    return retrieval.rank_fusion({"bm25": words, "lexical": place}, 20)


# reviews


def _claims(spark, sf_dir):
    claims = g.table(spark, sf_dir, "claims").select(F.col("claim").alias("id"), "state")
    return claims.withColumn("reviews", F.array().cast(review.REVIEWS))


@_query(f"""with {g.sql('claims', 'decisions')}, s as (select * from decisions where decision in ('validate', 'reject') and trim(reason) <> ''),
l as (select id, arg_max(decision, seq) as d, count(*) as n from s group by 1)
select claim as id, case d when 'validate' then 'validated' when 'reject' then 'rejected' else state end as state, coalesce(n, 0)::int as reviews from claims left join l on l.id = claim""")
def review_lineage(spark, sf_dir):
    return review.decide(_claims(spark, sf_dir), g.table(spark, sf_dir, "decisions"), review.LINEAGE).withColumn("reviews", F.size("reviews"))


@_query(f"""with {g.sql('claims', 'decisions')} select 'item_known' as rule, id || '|' || seq as key from decisions where id not in (select claim from claims)
union all select 'decision_known', id || '|' || seq from decisions where decision not in ('validate', 'reject') union all select 'reason_given', id || '|' || seq from decisions where trim(reason) = ''""")
def review_refused(spark, sf_dir):
    return review.decision_violations(_claims(spark, sf_dir), g.table(spark, sf_dir, "decisions"), review.LINEAGE)


@_query(f"""with {g.sql('claims', 'units', 'materializations')} select claim as id, 'claim' as item_type, definition, state from claims where state in ('draft', 'review_required')
union all select materialization, 'materialization', definition, state from materializations where state in ('draft', 'review_required') union all select distinct unit, 'write_unit', definition, state from units where state in ('draft', 'review_required')""")
def review_queue(spark, sf_dir):
    return review.lineage_items(*[g.table(spark, sf_dir, n) for n in ("claims", "materializations", "units")], ("draft", "review_required"))


def _annotated(spark, sf_dir):
    a = g.table(spark, sf_dir, "annotated")
    own = g.table(spark, sf_dir, "fields").select("id", "position", "data_type", "is_primary_key", "namespace", "name").unionByName(g.table(spark, sf_dir, "objects").select("id", "namespace", "name"), allowMissingColumns=True)
    every = g.table(spark, sf_dir, "nodes").join(a.select("id", "state"), "id", "left").join(own, "id", "left")
    none = F.lit(None).cast("string")
    return every.select("*", none.alias("role"), none.alias("grain"), none.alias("semantic_type"), F.when(F.col("state").isNotNull(), F.lit(0.5)).alias("confidence"), F.lit("proposal").alias("provenance"), F.array().cast(review.REVIEWS).alias("reviews"))


_ANN = f"{g.sql('annotated', 'nodes', 'objects', 'fields')}, nn as (select n.*, a.state from nodes n left join annotated a on a.id = n.id), qn as (select n.*, case when n.type = 'field' then p.label || '.' || n.label else n.label end as reference from nn n left join objects p on p.graph = n.graph and p.id = n.parent_id)"


@_query(f"with {_ANN} select reference, id, state from qn where state in ('draft', 'review_required')")
def annotation_reviews(spark, sf_dir):
    return review.annotation_reviews(_annotated(spark, sf_dir), ("draft", "review_required"))


def _annotation_decisions(spark, sf_dir):
    o = g.table(spark, sf_dir, "nodes")
    return o.where("id like '%1' or id like '%2'").select("id", F.lit(1).alias("seq"), F.when(F.col("type") == "field", "defer").otherwise("validate").alias("decision"), F.lit("seen").alias("reason"), (F.col("type") != "field").alias("include_fields"))


@_query(f"""with {_ANN}, d as (select id, type <> 'field' as top from nodes where id like '%1' or id like '%2'), c as (select id, 'defer' as decision from d where not top union all select id, 'validate' from d where top union all select f.id, 'validate' from fields f join d on d.top and d.id = f.parent_id)
select nn.id, case when nn.state is null then null when x.id is null then nn.state when x.n = 1 then case x.d when 'defer' then 'deferred' else 'validated' end else 'validated' end as state, case when nn.state is null then 0 else coalesce(n, 0) end::int as reviews from nn left join (select id, max(decision) as d, count(*) as n from c group by 1) x on x.id = nn.id""")
def annotation_decisions(spark, sf_dir):
    return review.decide_annotations(_annotated(spark, sf_dir), _annotation_decisions(spark, sf_dir)).select("id", "state", F.size("reviews").alias("reviews"))


_PATCH = "select id, case when id like '%3' then ' ' when id like '%4' then 'new words' end as description, case when id like '%6' then 'measure' end as role, case when id like '%2' or id like '%4' then 'a row' end as grain, case when id like '%9' then 'money' end as semantic_type, case when id like '%8' then '' else 'seen' end as reason from {nodes}"
_REFUSED = """select 'annotation_known' as rule, id as key from pj where now is null union all select 'reason_given', id from pj where trim(reason) = '' union all select 'patch_given', id from pj where description is null and role is null and grain is null and semantic_type is null
union all select 'grain_of_objects', id from pj where type = 'field' and grain is not null union all select 'semantic_type_of_fields', id from pj where type <> 'field' and semantic_type is not null union all select 'description_given', id from pj where trim(description) = ''"""
_PJ = f"pt as ({_PATCH.format(nodes='nodes')}), pj as (select pt.*, nn.type, nn.state as now from pt left join nn on nn.id = pt.id)"


def _patches(spark, sf_dir):
    return spark.sql(_PATCH, nodes=g.table(spark, sf_dir, "nodes"))


@_query(f"with {_ANN}, {_PJ} {_REFUSED}")
def annotation_patches_refused(spark, sf_dir):
    return review.patch_violations(_annotated(spark, sf_dir), _patches(spark, sf_dir))


@_query(f"""with {_ANN}, {_PJ}, bad as ({_REFUSED}), ok as (select * from pt where id not in (select key from bad))
select nn.id, coalesce(ok.description, nn.description) as description, ok.role, ok.grain, ok.semantic_type, case when ok.id is not null then 'draft' else nn.state end as state, case when ok.id is null and nn.state is not null then 0.5::double end as confidence, case when ok.id is not null then 'human' else 'proposal' end as provenance from nn left join ok on ok.id = nn.id""")
def annotation_edits(spark, sf_dir):
    return review.edit_annotations(_annotated(spark, sf_dir), _patches(spark, sf_dir)).select("id", "description", "role", "grain", "semantic_type", "state", "confidence", "provenance")


@_query(f"with {_ANN} select graph, id, label from nn where type <> 'field' and state is null")
def annotation_plan(spark, sf_dir):
    return review.plan_tasks(_annotated(spark, sf_dir))


_REFS = "select 'NS1.sup_1' as reference union all select ' sup_3' union all select 'object:2' union all select 'ns0.SUP_0.f_0' union all select 'nothing' union all select 'sup_5'"


@_query(f"""with {_ANN}, r as ({_REFS}), k as (select qn.id, lower(qn.id) as name from qn union select id, lower(reference) from qn union select qn.id, lower(objects.name) from qn join objects on objects.id = qn.id and objects.graph = qn.graph)
select reference, case when count(k.id) = 1 then max(k.id) end as id, count(k.id) as matches from r left join k on k.name = lower(trim(reference)) group by 1""")
def resolve_references(spark, sf_dir):
    return review.resolve(_annotated(spark, sf_dir), spark.sql(_REFS))


def _proposals(spark, sf_dir):
    """A proposal for each object with its fields; some stale, some with a field too few."""
    nodes = _annotated(spark, sf_dir)
    tasks = review.tasks(nodes)
    o = nodes.where("type <> 'field'").select("graph", F.col("id").alias("target_id"), F.lit(None).cast("string").alias("field"))
    f = nodes.where("type = 'field' and not (parent_id like '%4' and label like '%4')").select("graph", F.col("parent_id").alias("target_id"), F.col("label").alias("field"))
    each = o.union(f).join(tasks.select("graph", "target_id", "task_id"), ["graph", "target_id"])
    task = F.when(F.col("target_id").like("%2"), "annotation:old").otherwise(F.col("task_id"))
    return nodes, each.select("graph", "target_id", task.alias("task_id"), "field", F.concat(F.lit("about "), F.coalesce("field", "target_id")).alias("description"), F.lit("key").alias("role"), F.lit(0.75).alias("confidence")), tasks


_BAD = """bad as (select 'stale_proposal' as rule, graph || ':' || id as key from objects where id like '%2' union all select distinct 'every_field_once', graph || ':' || parent_id from fields where parent_id like '%4' and label like '%4'
 union all select distinct 'reviewed_annotation', graph || ':' || case when type = 'field' then parent_id else id end from nn where state = 'validated')"""


@_query(f"with {_ANN}, {_BAD} select * from bad")
def annotation_proposals_refused(spark, sf_dir):
    return review.proposal_violations(*_proposals(spark, sf_dir))


@_query(f"""with {_ANN}, {_BAD}, h as (select *, graph || ':' || case when type = 'field' then parent_id else id end not in (select key from bad) as hit from nn)
select id, case when hit then 'about ' || case when type = 'field' then label else id end else description end as description, case when hit then 'draft' else state end as state from h""")
def annotation_proposals(spark, sf_dir):
    return review.apply_proposals(*_proposals(spark, sf_dir)).select("id", "description", "state")


_PAIRS = "select 'ns' || (s_nationkey % 4) || '.sup_' || s_suppkey || '.f_' || s_suppkey as from_reference, 'NS' || (s_nationkey % 4) || '.SUP_' || s_suppkey || '.F_' || (s_suppkey + case when s_suppkey % 3 = 0 then 0 else {n} end) as to_reference, case when s_suppkey % 7 = 5 then ' ' else 'known' end as reason, s_suppkey % 2 = 0 as validated from {supplier}"


def _pairs(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return spark.sql(_PAIRS.replace("{n}", str(supplier.count())), supplier=supplier)


_REL = f"""{_ANN}, pr as ({_PAIRS.replace('{n}', '(select count(*) from supplier)').format(supplier='supplier')}), fk as (select id, lower(reference) as name from qn where type = 'field'),
mt as (select pr.*, a.id as ff, b.id as tf, case when a.id is null or b.id is null then 'field_resolved' when a.id = b.id then 'fields_differ' when trim(reason) = '' then 'reason_given' end as rule from pr left join fk a on a.name = lower(from_reference) left join fk b on b.name = lower(to_reference))"""


@_query(f"with {_REL} select 'relationship_candidate:' || substr(sha256(ff || chr(10) || tf), 1, 20) as id, ff as from_field, tf as to_field, case when validated then 'validated' else 'draft' end as state from mt where rule is null")
def relationships_added(spark, sf_dir):
    none = spark.createDataFrame([], "from_field string, to_field string")
    return review.new_relationships(_annotated(spark, sf_dir), none, _pairs(spark, sf_dir))[0].select("id", "from_field", "to_field", "state")


@_query(f"with {_REL} select rule, from_reference || '->' || to_reference as key from mt where rule is not null")
def relationships_refused(spark, sf_dir):
    none = spark.createDataFrame([], "from_field string, to_field string")
    return review.new_relationships(_annotated(spark, sf_dir), none, _pairs(spark, sf_dir))[1]


_EDGE = "select claim as id, case when line % 3 = 0 then 'foreign_key' else 'relationship_candidate' end as type, state, 'profile' as origin, cast(null as varchar(40)) as reason from {claims}"


@_query(f"""with {g.sql('claims', 'decisions')}, e as ({_EDGE.format(claims='claims')}), l as (select id, arg_max(decision, seq) as d, arg_max(trim(reason), seq) as r from decisions where decision in ('validate', 'reject') and trim(reason) <> '' group by 1)
select e.id, type, case when type <> 'foreign_key' and d is not null then case d when 'validate' then 'validated' else 'rejected' end else state end as state, case when type <> 'foreign_key' then r end as reason from e left join l on l.id = e.id""")
def relationships_decided(spark, sf_dir):
    edges = spark.sql(_EDGE, claims=g.table(spark, sf_dir, "claims"))
    return review.decide_relationships(edges, g.table(spark, sf_dir, "decisions")).select("id", "type", "state", "reason")


@_query(f"with {g.sql('claims')}, e as ({_EDGE.format(claims='claims')}) select id, type, state from e where type = 'foreign_key' or state = 'validated'")
def relationships_usable(spark, sf_dir):
    from .operators.relationships import usable_relationships

    return usable_relationships(spark.sql(_EDGE, claims=g.table(spark, sf_dir, "claims"))).select("id", "type", "state")


_ED = "select candidate as id, 1 as seq, case when evaluated % 2 = 0 then 'approve' else 'reject' end as decision, 'seen' as reason from {entities} where evaluated % 4 < 3 union all select candidate, 2, 'approve', 'again' from {entities} where evaluated % 5 = 0 union all select candidate, 0, 'approve', '' from {entities}"


@_query(f"""with {g.sql('entities')}, d as ({_ED.format(entities='entities')}), f as (select id, arg_min(decision, seq) as d from d where trim(reason) <> '' group by 1)
select candidate as id, case when state = 'candidate' and d is not null then case d when 'approve' then 'reviewed' else 'rejected' end else state end as state, (state = 'candidate' and d is not null)::int as reviews from entities left join f on f.id = candidate""")
def entities_reviewed(spark, sf_dir):
    e = g.table(spark, sf_dir, "entities")
    items = e.select(F.col("candidate").alias("id"), "state", F.array().cast(review.REVIEWS).alias("reviews"))
    return review.review_entities(items, spark.sql(_ED, entities=e)).withColumn("reviews", F.size("reviews"))


@_query(f"""with {g.sql('entities')}, k as (select distinct 'field:' || (p_partkey % 30) as f from part) select 'entity_resolution_candidate:' || candidate as id, left_field as source_id, right_field as target_id, case when state = 'reviewed' then 'confirmed' else 'exploratory_only' end as usage, state <> 'reviewed' as requires_runtime_validation
from entities where state <> 'rejected' and left_field in (select f from k) and right_field in (select f from k)""")
def entities_projected(spark, sf_dir):
    fields = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("field:"), (F.col("p_partkey") % 30).cast("string")).alias("id"))
    return review.entity_edges(g.table(spark, sf_dir, "entities"), fields)


@_query(f"with {g.sql('entities')} select candidate, state from entities where evaluated % 3 = 0 union all select candidate, state from entities where evaluated % 3 <> 0 and state = 'candidate'")
def entities_imported(spark, sf_dir):
    e = g.table(spark, sf_dir, "entities")
    return review.import_entities(e.where("evaluated % 3 = 0"), e).select("candidate", "state")


_TEXT = "select definition, 'insert into dw.t' || substr(definition, 2) || ' select a from [Raw] . \"T ' || substr(definition, 2) || '\"' || chr(10) || 'with c1 as (select 1)' || chr(10) || ', c2 as (select 2) select * from c1 join stage.x' || substr(definition, 2) as content, revision from {definitions}"
_PROP = """select definition, 'read' as operation, 'raw.t ' || substr(definition, 2) as target, 1 as line_start, 1 as line_end, 'seen' as reason from {definitions} union all select definition, 'read', 'stage.x' || substr(definition, 2), case when definition like '%3' then 1 else 3 end, case when definition like '%3' then 1 when definition like '%4' then 9 else 3 end, 'seen' from {definitions}
 union all select definition, 'read', 'c1', 2, 3, 'seen' from {definitions} union all select definition, case when definition like '%6' then 'drop' else 'call' end, 'c2', 3, 3, case when definition like '%7' then '' else 'seen' end from {definitions} union all select definition, 'read', 'select', 1, 1, 'seen' from {definitions} where definition like '%8'"""
_DECL = "select definition, 'READ' as operation, 'db.stage.x' || substr(definition, 2) as target from {definitions} where definition like '%9'"
_CL = f"""{g.sql('definitions')}, pp as ({_PROP.format(definitions='definitions')}), cv as (select 'lines_in_source' as rule, definition, operation, target, line_start from pp where line_end > 3 union all select 'target_in_lines', definition, operation, target, line_start from pp where target like 'stage.x%' and line_start = 1
 union all select 'operation_known', definition, operation, target, line_start from pp where operation = 'drop' union all select 'reason_given', definition, operation, target, line_start from pp where reason = '' union all select 'target_a_name', definition, operation, target, line_start from pp where target = 'select')"""


def _proposed(spark, sf_dir):
    d = g.table(spark, sf_dir, "definitions")
    return spark.sql(_PROP, definitions=d), spark.sql(_TEXT.replace("chr(10)", "char(10)"), definitions=d), spark.sql(_DECL, definitions=d)


@_query(f"with {_CL} select rule, definition || '|' || operation || '|' || target || '|' || line_start as key from cv")
def lineage_claims_refused(spark, sf_dir):
    return review.claim_violations(*_proposed(spark, sf_dir)[:2])


@_query(f"""with {_CL} select 'claim:' || substr(sha256('claim' || chr(10) || pp.operation || chr(10) || pp.definition || chr(10) || pp.target || chr(10) || pp.line_start || chr(10) || revision), 1, 24) as claim, pp.definition, pp.operation, pp.target, 'draft' as state
from pp join definitions using (definition) left join cv on cv.definition = pp.definition and cv.operation = pp.operation and cv.target = pp.target and cv.line_start = pp.line_start where cv.rule is null and not (pp.operation = 'read' and pp.target = 'c1') and not (pp.definition like '%9' and pp.target like 'stage.x%')""")
def lineage_claims_proposed(spark, sf_dir):
    return review.proposed_claims(*_proposed(spark, sf_dir))


_DONE = "select definition, case when definition like '%1' then 'old' else revision end as revision from {definitions} where definition not like '%5'"


@_query(f"with {g.sql('definitions')} select definition, revision from definitions where (definition like '%5' or definition like '%1') and definition not like '%15'")
def lineage_tasks(spark, sf_dir):
    d = g.table(spark, sf_dir, "definitions")
    return review.due_tasks(d, spark.sql(_DONE, definitions=d), d.where("definition like '%15'").select("definition", "revision"))


@_query("select c_name as id, c_mktsegment as value from customer where c_custkey % 3 = 0")
def proposals_leaking(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("mostly "), F.lower("c_mktsegment"))).otherwise("nothing said")
    return review.leaks(c.select(F.col("c_name").alias("id"), F.col("c_custkey").cast("string").alias("target_id"), said.alias("text")), c.select(F.col("c_custkey").cast("string").alias("target_id"), F.col("c_mktsegment").alias("value")))


# constraints


@_query(f"""with {g.sql('definitions', 'steps')}, dd as (select * from definitions union all select * from definitions where definition like '%17'), ss as (select step, case when step like '%44' then 'zz' else definition end as definition, case when step like '%33' then step else dependency end as dependency from steps union all select step, definition, dependency from steps where step like '%55')
{con.rules_sql('definition', 'dd', 'definition')} union all select 'definition_unique', document || '|' || definition from dd group by document, definition having count(*) > 1 union all select 'external_id_unique', document || '|' || external_id from dd group by document, external_id having count(*) > 1
union all select 'step_definition_known', step from ss where definition not in (select definition from dd) union all select 'dependency_known', step || '|' || dependency from ss where dependency not in (select step from ss) union all select 'dependency_on_itself', step from ss where step = dependency
union all select 'dependency_unique', step || '|' || dependency from ss where dependency is not null group by step, dependency having count(*) > 1""")
def definition_violations(spark, sf_dir):
    d, s = g.table(spark, sf_dir, "definitions"), g.table(spark, sf_dir, "steps").select("step", "definition", "dependency")
    broken = s.withColumn("definition", F.when(F.col("step").like("%44"), "zz").otherwise(F.col("definition"))).withColumn("dependency", F.when(F.col("step").like("%33"), F.col("step")).otherwise(F.col("dependency")))
    return con.definition_violations(d.union(d.where("definition like '%17'")), broken.union(s.where("step like '%55'")))


@_query(f"""with {g.sql('definitions')}, a as ({_DONE.format(definitions='definitions')} union all select 'ghost', 'r'), f as (select definition, revision from definitions where definition like '%5' or definition like '%23' union all select definition, revision from definitions where definition like '%35')
select 'analysis_revision_current' as rule, a.definition as key from a join definitions d using (definition) where a.revision <> d.revision union all select 'analysis_definition_known', definition from a where definition not in (select definition from definitions)
union all select 'failure_unique', definition from f group by 2 having count(*) > 1 union all select 'analyzed_or_failed', definition from a where definition in (select definition from f)""")
def analysis_violations(spark, sf_dir):
    d = g.table(spark, sf_dir, "definitions")
    f = d.where("definition like '%5' or definition like '%23'").select("definition", "revision")
    return con.analysis_violations(d, spark.sql(_DONE, definitions=d).union(spark.sql("select 'ghost', 'r'")), f.union(f.where("definition like '%35'")))


@_query(f"""with {g.sql('definitions', 'claims', 'units', 'materializations', 'decisions')}, df as (select * from definitions where definition not like '%9'), l as (select id, arg_max(decision, seq) as decision from decisions group by 1),
it as (select i.*, decision from (select claim as id, state from claims union all select materialization, state from materializations union all select distinct unit, state from units) i left join l using (id))
{con.rules_sql('claim', 'claims', 'claim')} union all {con.rules_sql('unit', 'units', 'unit')} union all {con.rules_sql('materialization', 'materializations', 'materialization')} union all {con.rules_sql('reviewed', 'it', 'id')}
union all select 'unit_source_unique', unit || '|' || lower(source) || '|' || line from units group by unit, lower(source), line having count(*) > 1 union all select 'one_materialization', definition from materializations group by definition having count(*) > 1 union all select 'claim_unique', claim from claims group by claim having count(*) > 1
union all select 'claim_definition_known', claim from claims where definition not in (select definition from df) union all select distinct 'unit_definition_known', unit from units where definition not in (select definition from df) union all select 'materialization_definition_known', materialization from materializations where definition not in (select definition from df)""")
def item_violations(spark, sf_dir):
    t = [g.table(spark, sf_dir, n) for n in ("claims", "units", "materializations", "decisions")]
    return con.item_violations(g.table(spark, sf_dir, "definitions").where("definition not like '%9'"), *t)


_LIST = "list_filter(string_split(coalesce({0}, ''), ','), lambda x: x <> '')"


@_query(f"""with {g.sql('events_log')}, n as (select log, count(*) as n from events_log group by 1), tw as (select log, sequence from events_log group by 1, 2 having count(*) > 1),
l as (select call_id, kind in ('sql_query', 'mongo_query') as asked, {_LIST.format('inputs')} as i, {_LIST.format('consumes')} as c, {_LIST.format('columns')} as r, row_count is not null as res from events_log),
u as (select log, call_id, sequence, unnest({_LIST.format('consumes')}) as used from events_log), m as (select u.*, e.sequence as pos, e.status from u left join events_log e on e.log = u.log and e.call_id = u.used)
{con.rules_sql('event', 'events_log', 'call_id')} union all select distinct 'sequence_contiguous', call_id from events_log join n using (log) left join tw on tw.log = events_log.log and tw.sequence = events_log.sequence where events_log.sequence not between 1 and n or tw.log is not null
union all select 'call_unique', log || '|' || call_id from events_log group by log, call_id having count(*) > 1 union all select 'inputs_given', call_id from l where asked and len(i) = 0 union all select 'inputs_unique', call_id from l where len(list_distinct(i)) < len(i)
union all select 'consumes_given', call_id from l where not asked and len(c) = 0 union all select 'consumes_unique', call_id from l where len(list_distinct(c)) < len(c) union all select 'columns_counted', call_id from l where res and len(r) not between 1 and 256
union all select 'columns_unique', call_id from l where len(list_distinct(list_transform(r, lambda x: lower(x)))) < len(r) union all select 'consumes_earlier', call_id || '|' || used from m where pos is null or pos >= sequence union all select 'consumes_successful', call_id || '|' || used from m where pos < sequence and status not in ('accepted', 'succeeded')""")
def event_violations(spark, sf_dir):
    return con.event_violations(g.table(spark, sf_dir, "events_log"))


def _workspace(spark, sf_dir):
    m = g.table(spark, sf_dir, "members")
    systems = m.where("graph <> 'g4'").select("system", "graph").distinct()
    areas = m.where("area is not null").select("system", "area", "graph", "namespace").distinct()
    zones = m.select("system", "zone", "graph", "object_id")
    rels = m.select(
        F.concat_ws("-", "graph", "zone").alias("id"), F.when(F.col("zone") == "zone3", "open").otherwise("draft").alias("state"), F.when(F.col("zone") == "zone4", "").otherwise("known").alias("reason"), F.col("graph").alias("source_graph"),
        F.col("object_id").alias("source_object"), F.lit("f_1").alias("source_field"), F.col("graph").alias("target_graph"), F.col("object_id").alias("target_object"), F.when(F.col("zone") == "zone5", "F_1").otherwise("f_2").alias("target_field"),
    )
    return systems, areas, zones, rels


_WS = f"""{g.sql('members', 'objects', 'fields')}, sy as (select distinct system, graph from members where graph <> 'g4'), ar as (select distinct system, area, graph, namespace from members where area is not null), zo as (select system, zone, graph, object_id from members),
re as (select graph || '-' || zone as id, case when zone = 'zone3' then 'open' else 'draft' end as state, case when zone = 'zone4' then '' else 'known' end as reason, graph, object_id, 'f_1' as sfd, case when zone = 'zone5' then 'F_1' else 'f_2' end as tfd from members)"""


@_query(f"""with {_WS} select 'graph_in_one_system' as rule, graph as key from sy group by graph having count(*) > 1 union all select 'schema_in_one_area', system || '|' || graph || '|' || namespace from ar group by system, graph, namespace having count(*) > 1
union all select 'area_graph_in_system', system || '|' || area || '|' || graph from ar where not exists (select 1 from sy where sy.system = ar.system and sy.graph = ar.graph) union all select 'zone_graph_in_system', system || '|' || zone || '|' || graph from zo where not exists (select 1 from sy where sy.system = zo.system and sy.graph = zo.graph)
union all select 'zone_member_unique', system || '|' || zone || '|' || graph || '|' || object_id from zo group by system, zone, graph, object_id having count(*) > 1 union all select 'relationship_unique', id from re group by id having count(*) > 1
union all select 'relationship_graph_known', id || '|' || graph from (select * from re union all select * from re) where graph not in (select graph from sy) union all select 'relationship_ends_differ', id from re where lower(sfd) = lower(tfd) union all select 'relationship_reason_given', id from re where reason = '' union all select 'relationship_state_known', id from re where state = 'open'""")
def workspace_violations(spark, sf_dir):
    return con.workspace_violations(*_workspace(spark, sf_dir))


@_query(f"""with {_WS}, e as (select id, graph, object_id, unnest([lower(sfd), lower(tfd)]) as f from re), pl as (select zo.*, namespace from zo join objects o on o.graph = zo.graph and o.id = zo.object_id)
select distinct 'schema_known' as rule, graph || '|' || namespace as key from ar where not exists (select 1 from objects o where o.graph = ar.graph and o.namespace = ar.namespace)
union all select 'zone_member_known', zone || '|' || graph || '|' || object_id from zo where not exists (select 1 from objects o where o.graph = zo.graph and o.id = zo.object_id)
union all select 'zone_schema_assigned', zone || '|' || graph || '|' || object_id from pl where not exists (select 1 from ar where ar.system = pl.system and ar.graph = pl.graph and ar.namespace = pl.namespace)
union all select 'relationship_object_known', id || '|' || graph || '|' || object_id from e where not exists (select 1 from objects o where o.graph = e.graph and o.id = e.object_id)
union all select 'relationship_field_known', id || '|' || graph || '|' || object_id || '|' || f from e where exists (select 1 from objects o where o.graph = e.graph and o.id = e.object_id) and not exists (select 1 from fields x where x.graph = e.graph and x.parent_id = e.object_id and lower(x.label) = f)""")
def workspace_reference_violations(spark, sf_dir):
    _, areas, zones, rels = _workspace(spark, sf_dir)
    return con.workspace_reference_violations(areas, zones, rels, g.table(spark, sf_dir, "objects"), g.table(spark, sf_dir, "fields"))


@_query(f"with {g.sql('entities')}, ee as (select * from entities union all select * from entities where evaluated = 11) {con.rules_sql('entity', 'ee', 'candidate')} union all select 'candidate_unique', candidate from ee group by candidate having count(*) > 1")
def entity_violations(spark, sf_dir):
    e = g.table(spark, sf_dir, "entities")
    return con.entity_violations(e.union(e.where("evaluated = 11")))


@_query(f"with {g.sql('knowledge')} {con.rules_sql('knowledge', 'knowledge', 'id')}")
def knowledge_violations(spark, sf_dir):
    return con.knowledge_violations(g.table(spark, sf_dir, "knowledge"))


_JOBS = "select case when s_suppkey % 6 = 0 then 'doc1' else 'manual' || (s_suppkey % 2) end as document, 'j' || s_suppkey as job, case when s_suppkey % 4 = 1 then 'Etl.' else 'etl.' end || (s_suppkey % 8) as qualified_name from {supplier}"
_MHOPS = "select 'manual' || (l_suppkey % 2) as document, 'j' || l_suppkey as job, 'insert' as operation, case when l_linenumber % 2 = 0 then 'DW.T' else 'dw.t' end || (l_partkey % 20) as target, 'raw.' || (l_partkey % 7) as source, case when l_linenumber = 7 then 'validated' else 'draft' end as state from {lineitem}"


@_query(f"""with j as ({_JOBS.format(supplier='supplier')}), h as ({_MHOPS.format(lineitem='lineitem')}) select 'job_unique' as rule, document || '|' || lower(qualified_name) as key from j group by document, lower(qualified_name) having count(*) > 1
union all select 'hop_unique', document || '|' || job || '|' || operation || '|' || lower(target) || '|' || lower(source) from h group by document, job, operation, lower(target), lower(source) having count(*) > 1 union all select 'hop_starts_as_draft', document || '|' || job || '|' || target from h where state <> 'draft'
union all select 'hop_job_known', document || '|' || job || '|' || target from h where not exists (select 1 from j where j.document = h.document and j.job = h.job) union all select distinct 'manual_overlay', document from j where document not like 'manual%'""")
def manual_violations(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return con.manual_violations(spark.sql(_JOBS, supplier=read("supplier")), spark.sql(_MHOPS, lineitem=read("lineitem")))


_PARTS = "select case when event_id % 501 = 500 then 'other' else 'one' end as identity, case when event_id % 250 = 249 then event_id + 100000 when event_id % 100 = 99 then event_id - 1 else event_id end as position from {events}"


@_query(f"""with p as ({_PARTS.format(events='events')}) select 'identity_equal' as rule, position::varchar as key from p where identity <> 'one' union all select 'prefix_contiguous', position::varchar from p where position not between 0 and (select count(*) - 1 from p)
union all select 'position_unique', position::varchar from p group by position having count(*) > 1""")
def checkpoint_violations(spark, sf_dir):
    return con.checkpoint_violations(spark.sql(_PARTS, events=spark.read.parquet(f"{sf_dir}/events.parquet")), "one")


_PROPOSED = "select p_partkey as id, case when p_size % 10 = 3 then ' ' else p_name end as description, case when p_size % 11 = 4 then cast(null as varchar(9)) else p_type end as confidence_reason, p_retailprice / 1000 as confidence, p_size % 4 as evidence from {part}"


@_query(f"with p as ({_PROPOSED.format(part='part')}) {con.rules_sql('proposal', 'p', 'id::varchar')}")
def proposal_violations(spark, sf_dir):
    return con.broken(spark.sql(_PROPOSED, part=spark.read.parquet(f"{sf_dir}/part.parquet")), "proposal", "id")


_EVID = "select l_orderkey || '-' || l_linenumber as id, case when l_linenumber = 7 then '' else 'script' end as source, 's' || l_suppkey as reference, case when l_partkey % 50 = 0 then cast(null as varchar(9)) else 'seen' end as reason, cast(l_quantity as int) - 2 as line_start, cast(l_quantity as int) - 2 + (l_linenumber - 2) as line_end from {lineitem}"


@_query(f"with p as ({_EVID.format(lineitem='lineitem')}) {con.rules_sql('evidence', 'p', 'id')}")
def evidence_violations(spark, sf_dir):
    return con.broken(spark.sql(_EVID, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")), "evidence", "id")


_TARGETS = "select 'model/' || (p_partkey % 150) as id from {part}"
_EDITS = "select 'e' || s_suppkey as edit, 'model/' || (s_suppkey * 20) as id, case when s_suppkey % 4 = 1 then ' ' else 'seen' end as reason from {supplier}"


@_query(f"""with t as ({_TARGETS.format(part='part')}), e as ({_EDITS.format(supplier='supplier')}) select 'target_unique' as rule, id as key from t group by id having count(*) > 1 union all select 'fields_aligned', r_name from region where r_regionkey <> 1
union all select 'reason_given', edit from e where trim(reason) = '' union all select 'edit_target_known', edit || '|' || id from e where id not in (select id from t)""")
def semantic_violations(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rels = read("region").select(F.col("r_name").alias("id"), F.array_repeat(F.lit("f"), F.col("r_regionkey")).alias("from_fields"), F.array(F.lit("t")).alias("to_fields"))
    return con.semantic_violations(spark.sql(_TARGETS, part=read("part")), rels, spark.sql(_EDITS, supplier=read("supplier")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
