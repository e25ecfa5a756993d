"""Registered queries of the metadata operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import made as mk
from . import queries_catalog, queries_estate, queries_lineage, queries_search
from .functions import text as X
from .operators import drift, graph, lineage, profile, relationships, retrieval, scopes

#: Pairs whose overlap is probed: source table and field, target table and field.
PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("orders", "o_orderkey", "part", "p_partkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_rows_customer(spark, sf_dir):
    return profile.sample_rows(_t(spark, sf_dir, "customer"), ["c_custkey"])


def profile_columns_orders(spark, sf_dir):
    return profile.profile_columns(_t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


def profile_mixed_customer(spark, sf_dir):
    return profile.profile_columns(_t(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_acctbal"])


def profile_columns_part(spark, sf_dir):
    return profile.profile_columns(_t(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def profile_bounded_lineitem(spark, sf_dir):
    return profile.profile_columns(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"], _LINE_ORDER, 5000)


def small_domain_orderstatus(spark, sf_dir):
    return profile.histogram(_t(spark, sf_dir, "orders"), "o_orderstatus")


def small_domain_event_type(spark, sf_dir):
    return profile.histogram(_t(spark, sf_dir, "events"), "event_type")


#: The string columns of all tables; the gate keeps those of a small domain.
TEXTS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"]}


def histogram_gate(spark, sf_dir):
    out = None
    for table in TEXTS:
        df = _t(spark, sf_dir, table)
        for column in [f.name for f in df.schema.fields if profile.textual(f.dataType)]:
            one = profile.histogram(df, column).select(F.lit(table).alias("table_name"), "*")
            out = one if out is None else out.union(one)
    return out


def _probe(i):
    def run(spark, sf_dir):
        a, x, b, y = PAIRS[i]
        return profile.probe_pair(_t(spark, sf_dir, a), x, _t(spark, sf_dir, b), y)

    return run


def _probe_sql(a, x, b, y):
    return f"""select '{x}' as source_field, '{y}' as target_field, sn as source_non_null, sd as source_distinct, tn as target_non_null, td as target_distinct, ov as overlap,
      ov / greatest(1, sd) as source_coverage, ov / greatest(1, td) as target_coverage, td / greatest(1, tn) as target_uniqueness
      from (select (select count({x}) from {a}) as sn, (select count(distinct {x}) from {a}) as sd, (select count({y}) from {b}) as tn, (select count(distinct {y}) from {b}) as td,
      (select count(*) from (select {x} from {a} where {x} is not null intersect select {y} from {b} where {y} is not null)) as ov)"""


def discover_relationships(spark, sf_dir):
    known = fx.RELATIONSHIPS.df(spark).select(F.col("object").alias("from_object"), F.col("from_fields")[0].alias("from_field"), "to_object", F.col("to_fields")[0].alias("to_field"))
    pairs = relationships.eligible_pairs(fx.FIELDS.df(spark), known, _family())
    pairs = [tuple(r) for r in pairs.collect()]  # as many as fields of the catalog, squared at most
    tables = {t: _t(spark, sf_dir, t) for t in sorted({t for p in pairs for t in (p[0], p[2])})}
    found = profile.probe_all(tables, pairs)
    return relationships.best_candidates(found.withColumnRenamed("source_field", "from_field").withColumnRenamed("target_field", "to_field"))


def _existing(spark, sf_dir):
    return mk.RELATIONSHIPS.df(spark, sf_dir).select(F.col("object").alias("from_object"), F.col("from_fields")[0].alias("from_field"), "to_object", F.col("to_fields")[0].alias("to_field"))


def _family():
    names = F.lit(None).cast("string")
    for k, v in X.SPARK_FAMILIES.items():
        names = F.when(F.col("data_type") == k, v).otherwise(names)
    return F.coalesce(names, F.lit("unknown"))


def candidate_pairs_catalog(spark, sf_dir):
    return relationships.candidate_pairs(mk.FIELDS.df(spark, sf_dir), _existing(spark, sf_dir), "sup_1", 20, _family())


def key_pattern_customer_name(spark, sf_dir):
    return relationships.dominant_pattern(_t(spark, sf_dir, "customer"), "c_name")


def key_pattern_brand(spark, sf_dir):
    return relationships.dominant_pattern(_t(spark, sf_dir, "part"), "p_brand")


def transformed_join_name_segment(spark, sf_dir):
    return relationships.segment_overlap(_t(spark, sf_dir, "customer"), "c_name", "Customer#{digits_1:9}", 1, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_key")), "cust_key", True)


def transformed_join_partial(spark, sf_dir):
    keys = _t(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 == 0, "legacy-key").otherwise(F.col("c_name")).alias("c_name"), F.col("c_custkey").alias("cust_key"))
    return relationships.segment_overlap(keys, "c_name", "Customer#{digits_1:9}", 1, keys, "cust_key", True)


def tokenize_documents(spark, sf_dir):
    return profile.spread(_t(spark, sf_dir, "documents")).select("doc_id", X.bm25_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


BM25_DOCS, BM25_BENCH = "the scum of Nation and idiot clown thedble thtion", "the reti ingeser onatth of that"


def bm25_documents(spark, sf_dir):
    return retrieval.bm25(_t(spark, sf_dir, "documents"), BM25_DOCS, 20, "doc_id")


def bm25_benchmark(spark, sf_dir):
    return retrieval.bm25(_t(spark, sf_dir, "benchmark"), BM25_BENCH, 20, "item_id")


def _query_vector(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(_t(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20)


def rrf_hybrid(spark, sf_dir):
    words = retrieval.bm25(_t(spark, sf_dir, "documents"), BM25_DOCS, 50, "doc_id").withColumnRenamed("doc_id", "id")
    vectors = retrieval.vector_topk(_t(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 50).withColumnRenamed("vec_id", "id")
    return retrieval.rank_fusion({"bm25": words, "vector": vectors}, 30)


def object_rollup(spark, sf_dir):
    best = retrieval.bm25(_t(spark, sf_dir, "documents"), BM25_DOCS, 100, "doc_id").join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return retrieval.roll_up(best.select(F.col("source").alias("object_id"), F.format_string("%06d", "doc_id").alias("field_id"), "score"))


LEXICAL = "orders keys of customer nations"


def lexical_search_catalog(spark, sf_dir):
    objects = mk.OBJECTS.df(spark, sf_dir).select("object", F.col("object").alias("name"), F.col("description").alias("technical_description"))
    fields = mk.FIELDS.df(spark, sf_dir).select("object", F.col("field").alias("name"))
    return retrieval.lexical_search(objects, fields, LEXICAL, 20)


def _nodes(spark, sf_dir):
    return graph.graph_nodes(mk.OBJECTS.df(spark, sf_dir), mk.FIELDS.df(spark, sf_dir), "ware house")


def graph_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


def graph_edges(spark, sf_dir):
    return graph.graph_edges(_nodes(spark, sf_dir), mk.OBJECTS.df(spark, sf_dir), mk.RELATIONSHIPS.df(spark, sf_dir), "ware house")


def graph_violations(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    edges = graph_edges(spark, sf_dir)
    return graph.graph_violations(nodes.union(nodes.where("label = 'name'")).where("label <> 'main.sup_2'"), edges)


def catalog_violations(spark, sf_dir):
    objects = mk.OBJECTS.df(spark, sf_dir)
    objects = objects.union(objects.where("object like '%4'")).withColumn("kind", F.expr("case when object like '%15' then 'cube' else kind end")).where("object not like '%6'")
    fields = mk.FIELDS.df(spark, sf_dir).withColumn("position", F.expr("case when field = 'name' and object like '%8' then 1 else position end")).withColumn("is_primary_key", F.expr("is_primary_key and object not like '%9'"))
    return graph.catalog_violations(objects, fields, mk.RELATIONSHIPS.df(spark, sf_dir))


def _retail(spark, sf_dir):
    return [tuple(t.df(spark, sf_dir) for t in v) for v in ((mk.OBJECTS, mk.FIELDS, mk.RELATIONSHIPS), (mk.OBJECTS_AFTER, mk.FIELDS_AFTER, mk.RELATIONSHIPS_AFTER))]


def schema_changes(spark, sf_dir):
    return drift.schema_changes(*_retail(spark, sf_dir))


def field_renames(spark, sf_dir):
    before, after = _retail(spark, sf_dir)
    return drift.field_renames(before[1], after[1])


def refresh_annotations(spark, sf_dir):
    return drift.refreshed_annotations(mk.ANNOTATIONS.df(spark, sf_dir), drift.schema_changes(*_retail(spark, sf_dir)))


def refresh_counts(spark, sf_dir):
    return refresh_annotations(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def step_changes(spark, sf_dir):
    after = mk.STEPS.df(spark, sf_dir).where("step <> 's4'").withColumn("depends_on", F.when(F.col("step") == "s3", F.array(F.lit("s2"), F.lit("s5"))).otherwise(F.col("depends_on"))).withColumn("definition", F.when(F.col("step") == "s1", "d9").otherwise(F.col("definition")))
    return drift.step_changes(mk.STEPS.df(spark, sf_dir), after)


def definition_changes(spark, sf_dir):
    d = mk.DEFINITIONS.df(spark, sf_dir).select("definition", "name", "kind", F.col("analysis").alias("content"))
    after = d.where("definition <> 'd4'").withColumn("content", F.when(F.col("definition") == "d1", "new").otherwise(F.col("content"))).withColumn("name", F.when(F.col("definition") == "d2", "etl.build").otherwise(F.col("name")))
    return lineage.definition_changes(d.where("definition <> 'd3'"), after)


def packet_diff(spark, sf_dir):
    return drift.packet_diff(mk.PACKETS.df(spark, sf_dir))


def packet_impact(spark, sf_dir):
    p = mk.PACKETS.df(spark, sf_dir)
    return drift.packet_impact(p.where("side = 'left'"), p.where("side = 'right' and id in ('o1', 'j2')"))


def upstream_trace(spark, sf_dir):
    return graph.trace_upstream(mk.EDGES.df(spark, sf_dir), "rep.best")[0]


def upstream_origins(spark, sf_dir):
    return graph.trace_upstream(mk.EDGES.df(spark, sf_dir), "rep.best")[1]


def upstream_truncated(spark, sf_dir):
    hops, _, cut = graph.trace_upstream(mk.EDGES.df(spark, sf_dir), "rep.best", 2)
    return hops.agg(F.count("*").alias("hops")).crossJoin(cut)


def one_hop(spark, sf_dir):
    fk = mk.RELATIONSHIPS.df(spark, sf_dir).select(F.col("object").alias("source"), F.col("to_object").alias("target"))
    return graph.one_hop(fk, mk.OBJECTS.df(spark, sf_dir).where("object = 'sup_2'").select("object"))


def _static(spark, sf_dir):
    return [t.df(spark, sf_dir) for t in (mk.DEFINITIONS, mk.CLAIMS, mk.WRITES, mk.MATERIALIZATIONS)]


def table_lineage(spark, sf_dir):
    return lineage.table_lineage(*_static(spark, sf_dir))


def lineage_network(spark, sf_dir):
    return lineage.network(*_static(spark, sf_dir))


def process_order(spark, sf_dir):
    return lineage.process_view(mk.DEFINITIONS.df(spark, sf_dir), mk.STEPS.df(spark, sf_dir), mk.CLAIMS.df(spark, sf_dir))


def lineage_status(spark, sf_dir):
    return lineage.lineage_status(*_static(spark, sf_dir))


def lineage_find(spark, sf_dir):
    nodes = mk.DEFINITIONS.df(spark, sf_dir).select(F.col("definition").alias("id"), F.substring_index("name", ".", -1).alias("name"), "kind", F.col("name").alias("reference"))
    return lineage.find_references(nodes, "[ETL] . load_7")


def runtime_closure(spark, sf_dir):
    calls, inputs = graph.closure(mk.RUNTIME.df(spark, sf_dir), "p1")
    return calls.select(F.lit("call").alias("kind"), F.col("call_id").alias("name")).union(inputs.select(F.lit("origin"), "node"))


def runtime_violations(spark, sf_dir):
    return graph.runtime_violations(mk.BROKEN.df(spark, sf_dir))


def workspace_scope(spark, sf_dir):
    return scopes.resolve_scope(mk.SCOPE_OBJECTS.df(spark, sf_dir), mk.ZONES.df(spark, sf_dir), systems=["erp", "crm"], schemas=["dbo", "crm"], in_zones=["private", "revenue"])


def workspace_impact(spark, sf_dir):
    return scopes.change_impacts(mk.CHANGED.df(spark, sf_dir), mk.SCOPE_OBJECTS.df(spark, sf_dir), mk.ZONES.df(spark, sf_dir))


def focus_members(spark, sf_dir):
    return scopes.focus_members(graph.trace_upstream(mk.EDGES.df(spark, sf_dir), "rep.best")[0], "rep.best")


def knowledge_budget(spark, sf_dir):
    scope = F.element_at(F.array(*[F.lit(s) for s in scopes.SCOPE_RANK]), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = _t(spark, sf_dir, "documents").select(F.format_string("k%06d", "doc_id").alias("id"), scope.alias("scope"), (F.col("doc_id") % 97 == 3).alias("explicit"), F.col("text").alias("content"))
    return scopes.knowledge_budget(docs, 24000)


def context_fields_topn(spark, sf_dir):
    fields = mk.FIELDS.df(spark, sf_dir)
    hits = fields.where("field like '%name%' or field like '%price%'").select("object", "field", F.length("field").alias("score"))
    return scopes.context_fields(fields, hits, 3)


def semantic_bindings(spark, sf_dir):
    bound = scopes.dataset_bindings(mk.DATASETS.df(spark, sf_dir), mk.OBJECTS.df(spark, sf_dir), "hive")
    each = scopes.field_bindings(mk.MODEL_FIELDS.df(spark, sf_dir), bound, mk.FIELDS.df(spark, sf_dir))
    return bound.select("dataset", F.lit("").alias("field"), F.col("object").alias("target"), "tier").union(each.select("dataset", "field", "column", F.lit(0)))


def er_find_modes(spark, sf_dir):
    c = mk.CANDIDATES.df(spark, sf_dir)
    out = None
    for mode in ("confirmed", "candidates", "confirmed_then_candidates"):
        one = scopes.find_candidates(c, "r2", mode).select(F.lit(mode).alias("mode"), "candidate", "usage")
        out = one if out is None else out.union(one)
    return out


def er_evidence(spark, sf_dir):
    return scopes.candidate_evidence(mk.CANDIDATES.df(spark, sf_dir))


def entity_rule_overlap(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    loud = part.select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" !")).alias("loud"))
    return scopes.rule_overlap(loud, "loud", part, "p_name", ["strip_punctuation", "collapse_whitespace", "trim", "casefold"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "oracle_sql")}
    return {f"probe_{a}_{b}": _probe(i) for i, (a, _, b, _) in enumerate(PAIRS)} | names | queries_estate.queries() | queries_catalog.queries() | queries_lineage.QUERIES | queries_search.QUERIES


def _profile_sql(table, columns, text, source=None, complete="true"):
    sizes = ["{f}(length({c}))" if text or (text is None and c.endswith("name")) else "null" for c in columns]
    rows = [f"select '{c}' as column_name, count(*) as rows_profiled, count({c}) as non_null, count(*) - count({c}) as null_count, count(distinct {c}) as distinct_count, min({c})::varchar as min_value, max({c})::varchar as max_value, {size.format(f='min', c=c)}::int as min_length, {size.format(f='max', c=c)}::int as max_length, {complete} as complete from {source or table}" for c, size in zip(columns, sizes, strict=True)]
    return " union all ".join(rows)


_TOKENS = """list_filter(string_split_regex(lower(regexp_replace(strip_accents(replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+'), lambda t: t <> '' and not list_contains([{stop}], t))"""


def _tokens_sql(x):
    return _TOKENS.replace("{x}", x).replace("{stop}", ", ".join(f"'{w}'" for w in X.BM25_STOP))


def _bm25_sql(table, key, query, limit):
    terms = ", ".join(f"'{t}'" for t in _static_terms(query))
    return f"""with t as (select {key}, {_tokens_sql("' ' || text")} as ts from {table}),
q as (select unnest([{terms}]) as term), n as (select {key}, len(ts) as n from t), st as (select count(*) as docs, avg(n) as mean from n),
c as (select {key}, term, count(*) as c from (select {key}, unnest(ts) as term from t) where term in (select term from q) group by 1, 2),
df as (select term, count(*) as df from c group by 1),
s as (select c.{key}, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (c * 2.5) / (c + 1.5 * (0.25 + 0.75 * n / greatest(mean, 1.0)))), 9) as score from q join c using (term) join df using (term) join n using ({key}), st group by 1)
select {key}, score, row_number() over (order by score desc, {key})::int as rank from s order by score desc, {key} limit {limit}"""


def _static_terms(query):
    """Terms of a plain ASCII query, as written in SQL."""
    import re

    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query).lower()
    return [t for t in re.split("[^a-z0-9]+", spaced) if t and t not in X.BM25_STOP]


def _vector_sql(limit):
    return f"select vec_id, round(list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score, row_number() over (order by round(list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) desc, vec_id)::int as rank from embeddings order by score desc, vec_id limit {limit}"


def _url(x):
    return f"replace(url_encode({x}), '+', '%20')"


_NODES_SQL = f"""nodes as (select 'catalog:ware%20house' as id, 'catalog' as type, 'ware house' as label, null as parent_id
 union all select distinct 'namespace:ware%20house/' || namespace, 'namespace', namespace, 'catalog:ware%20house' from objects
 union all select 'object:ware%20house/' || namespace || '/' || object, kind, namespace || '.' || object, 'namespace:ware%20house/' || namespace from objects
 union all select 'field:ware%20house/' || namespace || '/' || object || '/' || field, 'field', field, 'object:ware%20house/' || namespace || '/' || object from fields)"""
_EDGES_SQL = """edges as (select 'contains:' || parent_id || '->' || id as id, parent_id as source_id, id as target_id, 'contains' as type from nodes where parent_id is not null
 union all select 'foreign_key:ware%20house/' || namespace || '/' || object || '/' || name, 'object:ware%20house/' || namespace || '/' || object, 'object:ware%20house/' || to_namespace || '/' || to_object, 'foreign_key' from rels where to_object in (select object from objects)
 union all select 'foreign_key:ware%20house/' || namespace || '/' || object || '/' || name || '/field/' || i, 'field:ware%20house/' || namespace || '/' || object || '/' || from_fields[i], 'field:ware%20house/' || to_namespace || '/' || to_object || '/' || to_fields[i], 'foreign_key_field' from (select *, unnest(range(1, least(len(from_fields), len(to_fields)) + 1)) as i from rels) where to_object in (select object from objects))"""
_TRACE_SQL = """walk as (select 'rep.best' as node, 0 as depth union select e.source, w.depth + 1 from walk w join e on e.target = w.node where w.depth < {most}),
seen as (select node, min(depth) as depth from walk group by 1)"""


def _changes_sql() -> str:
    """Changes between catalogs o1, f1, r1 and o2, f2, r2."""
    diff = lambda c, kind, sev: f"select reference, '{kind}' as kind, '{sev}' as severity, b_{c}::varchar as before, a_{c}::varchar as after from {{src}} where a_is and b_is and b_{c} is distinct from a_{c}"
    seen = lambda src, r, rs, a, s: f"select reference, case when a_is is null then '{r}' else '{a}' end, case when a_is is null then '{rs}' else '{s}' end, null, null from {src} where a_is is null or b_is is null"
    return f"""ob as (select coalesce(x.namespace, y.namespace) || '.' || coalesce(x.object, y.object) as reference, x.kind as b_kind, y.kind as a_kind, x.primary_key as b_pk, y.primary_key as a_pk, x.description as b_d, y.description as a_d, x.object is not null or null as b_is, y.object is not null or null as a_is from o1 x full join o2 y on x.namespace = y.namespace and x.object = y.object),
fb as (select coalesce(x.namespace, y.namespace) || '.' || coalesce(x.object, y.object) || '.' || coalesce(x.field, y.field) as reference, x.data_type as b_t, y.data_type as a_t, x.nullable as b_n, y.nullable as a_n, x.is_primary_key as b_k, y.is_primary_key as a_k, x.position as b_p, y.position as a_p, x.description as b_d, y.description as a_d, x.field is not null or null as b_is, y.field is not null or null as a_is, x.namespace as ns, coalesce(x.object, y.object) as ob, x.field as bf, y.field as af from f1 x full join f2 y on x.namespace = y.namespace and x.object = y.object and x.field = y.field),
rb as (select coalesce(x.name, y.name) as reference, x.sh as b_s, y.sh as a_s, x.name is not null or null as b_is, y.name is not null or null as a_is from (select *, array_to_string(from_fields, ',') || '|' || to_namespace || '|' || to_object || '|' || array_to_string(to_fields, ',') as sh from r1) x full join (select *, array_to_string(from_fields, ',') || '|' || to_namespace || '|' || to_object || '|' || array_to_string(to_fields, ',') as sh from r2) y on x.object = y.object and x.name = y.name),
g1 as (select ob, b_p, b_t, b_n, b_k, max(bf) as bf from fb where a_is is null group by all having count(*) = 1), g2 as (select ob, a_p, a_t, a_n, a_k, max(af) as af from fb where b_is is null group by all having count(*) = 1),
rn as (select 'main.' || g1.ob || '.' || bf as reference, bf as before, af as after from g1 join g2 on g1.ob = g2.ob and b_p = a_p and b_t = a_t and b_n = a_n and b_k = a_k),
ch as (select * from (select null as reference, null as kind, null as severity, null as before, null as after where false) union all {seen('ob', 'object_removed', 'breaking', 'object_added', 'info')}
 union all {diff('kind', 'object_kind_changed', 'review_required').format(src='ob')} union all {diff('pk', 'primary_key_changed', 'breaking').format(src='ob')} union all {diff('d', 'technical_description_changed', 'info').format(src='ob')}
 union all {seen('fb', 'field_removed', 'breaking', 'field_added', 'info')} union all {diff('t', 'field_type_changed', 'review_required').format(src='fb')} union all {diff('n', 'field_nullability_changed', 'review_required').format(src='fb')}
 union all {diff('k', 'field_key_status_changed', 'breaking').format(src='fb')} union all {diff('p', 'field_position_changed', 'info').format(src='fb')} union all {diff('d', 'technical_description_changed', 'info').format(src='fb')}
 union all select reference, 'possible_field_rename', 'review_required', before, after from rn
 union all {seen('rb', 'relationship_removed', 'breaking', 'relationship_added', 'info')} union all {diff('s', 'relationship_changed', 'breaking').format(src='rb')})"""


def oracle_sql() -> dict[str, str]:
    given = ", ".join([fx.OBJECTS.sql("objects"), fx.FIELDS.sql("fields"), fx.RELATIONSHIPS.sql("rels")])
    catalog = ", ".join([mk.OBJECTS.sql("objects"), mk.FIELDS.sql("fields"), mk.RELATIONSHIPS.sql("rels")])
    retail = ", ".join([r.sql(n) for v, k in (((mk.OBJECTS, mk.FIELDS, mk.RELATIONSHIPS), "1"), ((mk.OBJECTS_AFTER, mk.FIELDS_AFTER, mk.RELATIONSHIPS_AFTER), "2")) for r, n in zip(v, (f"o{k}", f"f{k}", f"r{k}"), strict=True)])
    e = mk.EDGES.sql("e")
    static = ", ".join([mk.DEFINITIONS.sql("d"), mk.CLAIMS.sql("c"), mk.WRITES.sql("w"), mk.MATERIALIZATIONS.sql("m"), mk.STEPS.sql("s")])
    out = {f"probe_{a}_{b}": _probe_sql(a, x, b, y) for a, x, b, y in PAIRS}
    out["sample_rows_customer"] = "select * from customer order by c_custkey limit 10"
    out["profile_columns_orders"] = _profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], False)
    out["profile_columns_part"] = _profile_sql("part", ["p_name", "p_brand", "p_type"], True)
    out["profile_bounded_lineitem"] = "with l as (select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity limit 5000) " + _profile_sql("l", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"], False, complete="(select count(*) <= 5000 from lineitem)")
    histogram = lambda t, c: f"select '{c}' as column_name, {c}::varchar as value, count(*) as count from {t} where {c} is not null and (select count(distinct {c}) from {t}) <= 20 group by 2"
    out["small_domain_orderstatus"], out["small_domain_event_type"] = histogram("orders", "o_orderstatus"), histogram("events", "event_type")
    out["histogram_gate"] = " union all ".join(f"select '{t}' as table_name, * from ({histogram(t, c)})" for t, cs in TEXTS.items() for c in cs)
    out["profile_mixed_customer"] = _profile_sql("customer", ["c_custkey", "c_name", "c_acctbal"], None)
    columns = {}
    for _, o, f, *_ in fx.FIELDS.rows:
        columns.setdefault(o, []).append(f)
    numbers = [(o, f) for _, o, f, _, t, *_ in fx.FIELDS.rows if X.SPARK_FAMILIES.get(t) == "number"]
    domains = " union all ".join(f"select '{o}' as object, '{f}' as field, {f}::double as v from {o} where {f} is not null" for o, f in numbers)
    out["discover_relationships"] = f"""with {given}, dom as ({domains}), st as (select object, field, count(*) as nn, count(distinct v) as d from dom group by 1, 2), u as (select distinct object, field, v from dom),
ov as (select a.object as ao, a.field as af, b.object as bo, b.field as bf, count(*) as ov from u a join u b on a.v = b.v group by 1, 2, 3, 4),
pr as (select s.object as from_object, s.field as source_field, t.object as to_object, t.field as target_field, s.nn as sn, s.d as sd, t.nn as tn, t.d as td, coalesce(ov, 0) as overlap from st s join fields x on x.object = s.object and x.field = s.field join st t on t.object <> s.object join fields y on y.object = t.object and y.field = t.field and (y.is_primary_key or y.position = 1)
 left join ov on ao = s.object and af = s.field and bo = t.object and bf = t.field where not exists (select 1 from rels where rels.object = s.object and from_fields[1] = s.field and to_object = t.object and to_fields[1] = t.field)),
p as (select *, row_number() over (order by from_object, source_field, to_object, target_field) as position, overlap / greatest(1, sd) as source_coverage, overlap / greatest(1, td) as target_coverage, td / greatest(1, tn) as target_uniqueness from pr),
r as (select *, row_number() over (partition by from_object, source_field order by source_coverage desc, target_uniqueness desc, target_coverage desc, overlap desc, position) as r from p where overlap >= 3 and source_coverage >= 0.85 and target_uniqueness >= 0.9)
select 'relationship_candidate:' || substr(sha256('field:' || from_object || '/' || source_field || chr(10) || 'field:' || to_object || '/' || target_field), 1, 20) as id, from_object, source_field as from_field, to_object, target_field as to_field, overlap, round(source_coverage, 6) as source_coverage, round(target_uniqueness, 6) as target_uniqueness,
round(cast(cast(least(0.98::double, 0.2::double + 0.35::double * source_coverage + 0.2::double * target_uniqueness + 0.15::double * target_coverage + least(0.1::double, overlap / 100)) as varchar) as decimal(38, 20)), 4)::double as confidence, 'draft' as state from r where r = 1"""
    family = "case " + " ".join(f"when data_type = '{k}' then '{v}'" for k, v in X.SPARK_FAMILIES.items()) + " else 'unknown' end"
    norm = lambda c: f"replace(regexp_replace(lower({c}), '(^|_)(id|key)$', ''), '_', '')"
    out["candidate_pairs_catalog"] = f"""with {catalog}, f as (select *, {family} as family from fields), s as (select *, row_number() over (order by position, field) as so from f where object = 'sup_1'),
p as (select s.object as from_object, s.field as from_field, t.object as to_object, t.field as to_field, so as source_order, row_number() over (partition by so order by not t.is_primary_key, {norm('s.field')} <> {norm('t.field')}, s.data_type <> t.data_type, t.object, t.field) as target_rank
 from s join f t on s.family = t.family and t.object <> 'sup_1' and (t.is_primary_key or t.position = 1) where so <= 16 and s.family not in ('bool', 'binary', 'unknown') and not exists (select 1 from rels r where r.object = s.object and r.from_fields[1] = s.field and r.to_object = t.object and r.to_fields[1] = t.field))
select from_object, from_field, to_object, to_field, source_order::int as source_order, target_rank::int as target_rank from p order by target_rank, source_order limit 20"""
    one_run = lambda t, c: f"""with v as (select {c} as v, regexp_extract({c}, '[0-9]+') as d from {t} where {c} is not null), p as (select replace(v, d, '{{digits_1:' || len(d) || '}}') as pattern, count(*) as match_count from v where d <> '' and regexp_matches(v, '[A-Za-z]') group by 1 order by 2 desc, 1 limit 1)
select '{c}' as field, pattern, n as sample_count, match_count, match_count / n as coverage, 1::bigint as components from p, (select count(*) as n from v) where match_count >= 3 and match_count / n >= 0.8"""  # noqa: E731
    out["key_pattern_customer_name"], out["key_pattern_brand"] = one_run("customer", "c_name"), one_run("part", "p_brand")
    out["transformed_join_name_segment"] = """with a as (select distinct cast(cast(regexp_extract(c_name, '[0-9]+') as bigint) as varchar) as v from customer where regexp_matches(c_name, '^Customer#[0-9]{9}$')), b as (select c_custkey::varchar as v from customer),
x as (select (select avg(regexp_matches(c_name, '^Customer#[0-9]{9}$')::int) from customer) as pc, (select count(*) from a) as sd, (select count(distinct v) from b) as td, (select count(*) from b) as tn, (select count(*) from (select v from a intersect select v from b)) as ov)
select 'c_name' as from_field, 'cust_key' as to_field, 1 as component, sd as source_distinct, td as target_distinct, ov as overlap, pc as pattern_coverage, ov / greatest(1, sd) as source_coverage, td / greatest(1, tn) as target_uniqueness,
round(least(0.95, 0.15 + 0.25 * pc + 0.3 * (ov / greatest(1, sd)) + 0.2 * (td / greatest(1, tn)) + least(0.1, ov / 100)), 4) as confidence from x where ov >= 2 and ov / greatest(1, sd) >= 0.6 and td / greatest(1, tn) >= 0.9"""
    out["transformed_join_partial"] = out["transformed_join_name_segment"].replace("with a as", "with customer as (select case when c_custkey % 10 = 0 then 'legacy-key' else c_name end as c_name, c_custkey from main.customer), a as")
    out["tokenize_documents"] = f"select doc_id, len(ts)::bigint as n_tokens, md5(array_to_string(ts, ' ')) as digest from (select doc_id, {_tokens_sql('text')} as ts from documents)"
    out["bm25_documents"] = _bm25_sql("documents", "doc_id", BM25_DOCS, 20)
    out["bm25_benchmark"] = _bm25_sql("benchmark", "item_id", BM25_BENCH, 20)
    out["vector_topk"] = _vector_sql(20)
    out["rrf_hybrid"] = f"""with a as ({_bm25_sql("documents", "doc_id", BM25_DOCS, 50)}), b as ({_vector_sql(50)}), u as (select doc_id as id, rank, 'bm25' as s from a union all select vec_id, rank, 'vector' from b)
select id, round(sum(1 / (60 + rank)), 9) as score, string_agg(distinct s, '+' order by s) as sources from u group by 1 order by score desc, id limit 30"""
    out["object_rollup"] = f"""with h as (select source as object_id, format('{{:06d}}', doc_id) as field_id, score from ({_bm25_sql("documents", "doc_id", BM25_DOCS, 100)}) join documents using (doc_id)), r as (select *, row_number() over (partition by object_id order by score desc, field_id) as r from h)
select object_id, max(score) as score, string_agg(field_id, ',' order by r) filter (where r <= 8) as fields from r group by 1"""
    singular = "case when len(t) > 4 and t like '%ies' then t[:-4] || 'y' when len(t) > 3 and t like '%s' and not regexp_matches(t, '(ss|us|is)$') then t[:-2] else t end"
    toks = lambda x: f"list_distinct(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> ''), lambda t: {singular}))"
    out["lexical_search_catalog"] = f"""with {catalog}, q as (select unnest(['customer', 'key', 'nation', 'order']) as term),
o as (select object, unnest({toks('object')}) as term, 12 as w from objects union all select object, unnest({toks('description')}), 5 from objects),
f as (select distinct object, field as name, term from (select object, field, unnest({toks('field')}) as term from fields) join q using (term)),
b as (select object, term, max(w) as w from (select object, term, w from o join q using (term) union all select object, term, 9 from f) group by 1, 2),
t as (select object, sum(w) as s, count(*) as m from b group by 1), n as (select object, list_has_all({toks('object')}, ['customer', 'key', 'nation', 'order']) as named from objects),
h as (select object, name, sum(9) as w from f group by 1, 2), r as (select *, row_number() over (partition by object order by w desc, lower(name)) as r from h)
select t.object, (s + 2 * m + case when m = 4 then 10 else 0 end + case when named then 12 else 0 end)::bigint as score, m as matched, coalesce((select string_agg(name, ',' order by r) from r where r.object = t.object and r <= 8), '') as fields from t join n using (object) order by score desc, lower(object) limit 20"""
    out["graph_nodes"] = f"with {catalog}, {_NODES_SQL} select * from nodes"
    out["graph_edges"] = f"with {catalog}, {_NODES_SQL}, {_EDGES_SQL} select * from edges"
    out["graph_violations"] = f"""with {catalog}, {_NODES_SQL}, {_EDGES_SQL}, n2 as (select * from (select * from nodes union all select * from nodes where label = 'name') where label <> 'main.sup_2')
select 'node_id_unique' as rule, id as key from n2 group by 2 having count(*) > 1 union all select distinct 'edge_endpoint_known', id from edges where source_id not in (select id from n2) or target_id not in (select id from n2)"""
    out["catalog_violations"] = f"""with {catalog}, o as (select namespace, object, case when object like '%15' then 'cube' else kind end as kind, primary_key from (select * from objects union all select * from objects where object like '%4') where object not like '%6'),
f as (select namespace, object, field, case when field = 'name' and object like '%8' then 1 else position end as position, is_primary_key and object not like '%9' as pk from fields), k as (select namespace, object, unnest(string_split(primary_key, ',')) as field from o where primary_key <> '')
select 'object_unique' as rule, namespace || '.' || object as key from o group by 2 having count(*) > 1
union all select 'field_unique', namespace || '.' || object || '.' || field from f group by 2 having count(*) > 1
union all select 'position_unique', namespace || '.' || object || '.' || position from f group by 2 having count(*) > 1
union all select 'relationship_unique', namespace || '.' || object || '.' || name from rels group by 2 having count(*) > 1
union all select 'kind_known', namespace || '.' || object from o where kind not in ('table', 'view')
union all select 'position_positive', namespace || '.' || object || '.' || field from f where position < 1
union all select 'primary_key_flagged', namespace || '.' || object || '.' || field from k where not exists (select 1 from f where f.pk and f.object = k.object and f.field = k.field)
union all select 'primary_key_listed', namespace || '.' || object || '.' || field from f where pk and not exists (select 1 from k where f.object = k.object and f.field = k.field)
union all select 'reference_fields_equal', namespace || '.' || object || '.' || name from rels where len(from_fields) <> len(to_fields)
union all select 'reference_target_known', namespace || '.' || object || '.' || name from rels where to_object not in (select object from o)"""
    changes = _changes_sql()
    out["schema_changes"] = f"with {retail}, {changes} select * from ch"
    out["field_renames"] = f"with {retail}, {changes} select * from rn"
    stale = ", ".join(f"'{k}'" for k in drift.STALE)
    refreshed = f"""rf as (select a.reference, case when coalesce(reasons, '') like '%field_removed%' or coalesce(reasons, '') like '%object_removed%' then 'removed' when reasons is not null and state = 'validated' then 'review_required' else state end as state, coalesce(reasons, '') as reasons
 from ann a left join (select reference, string_agg(distinct kind, ',' order by kind) as reasons from ch where kind in ({stale}) group by 1) using (reference))"""
    out["refresh_annotations"] = f"with {retail}, {mk.ANNOTATIONS.sql('ann')}, {changes}, {refreshed} select * from rf"
    out["refresh_counts"] = f"with {retail}, {mk.ANNOTATIONS.sql('ann')}, {changes}, {refreshed} select state, count(*) as n from rf group by 1"
    out["step_changes"] = f"""with {static}, a as (select step, case when step = 's1' then 'd9' else definition end as definition, case when step = 's3' then ['s2', 's5'] else depends_on end as depends_on from s where step <> 's4')
select step as reference, 'step_removed' as kind, 'breaking' as severity from s where step not in (select step from a) union all select step, 'step_added', 'info' from a where step not in (select step from s)
union all select s.step, 'step_definition_changed', 'review_required' from s join a using (step) where s.definition <> a.definition
union all select s.step || '<-' || x, 'dependency_removed', 'breaking' from (select s.step, unnest(s.depends_on) as x, a.depends_on as o from s join a using (step)) s where not list_contains(o, x)
union all select s.step || '<-' || x, 'dependency_added', 'info' from (select s.step, unnest(a.depends_on) as x, s.depends_on as o from s join a using (step)) s where not list_contains(o, x)"""
    out["definition_changes"] = f"""with {static}, b as (select definition, name, kind, analysis as content from d where definition <> 'd3'), a as (select definition, case when definition = 'd2' then 'etl.build' else name end as name, kind, case when definition = 'd1' then 'new' else analysis end as content from d where definition <> 'd4')
select definition as reference, 'definition_removed' as kind, 'breaking' as severity from b where definition not in (select definition from a) union all select definition, 'definition_added', 'info' from a where definition not in (select definition from b)
union all select definition, 'definition_kind_changed', 'review_required' from a join b using (definition) where a.kind <> b.kind union all select definition, 'definition_content_changed', 'review_required' from a join b using (definition) where a.content <> b.content
union all select definition, 'definition_name_changed', 'info' from a join b using (definition) where a.name <> b.name"""
    out["packet_diff"] = f"""with {mk.PACKETS.sql('p')} select coalesce(l.section, r.section) as section, coalesce(l.id, r.id) as id, case when l.id is null then 'added' when r.id is null then 'removed' else 'changed' end as change
from (select * from p where side = 'left') l full join (select * from p where side = 'right') r on l.section = r.section and l.id = r.id where l.payload is distinct from r.payload"""
    out["packet_impact"] = f"with {mk.PACKETS.sql('p')} select distinct id, id in (select id from p where side = 'right' and id in ('o1', 'j2')) as affected from p where side = 'left'"
    out["upstream_trace"] = f"with recursive {e}, {_TRACE_SQL.format(most=12)} select distinct s.depth + 1 as depth, e.source, e.target, e.relation, e.state from seen s join e on e.target = s.node"
    out["upstream_origins"] = f"with recursive {e}, {_TRACE_SQL.format(most=12)} select node from seen where node not in (select target from e)"
    out["upstream_truncated"] = f"with recursive {e}, {_TRACE_SQL.format(most=2)} select (select count(*) from seen s join e on e.target = s.node where s.depth < 2) as hops, exists (select 1 from seen s join e on e.target = s.node where s.depth = 2) as truncated"
    out["focus_members"] = f"""with recursive {e}, {_TRACE_SQL.format(most=12)}, h as (select s.depth + 1 as depth, e.source, e.target from seen s join e on e.target = s.node), u as (select source as node, depth, 'upstream' as r from h union all select target, depth - 1, 'consumer' from h union all select 'rep.best', 0, 'start')
select node, min(depth)::int as depth, string_agg(distinct r, ',' order by r) as reasons from u group by 1"""
    out["one_hop"] = f"with {catalog} select distinct object from (select 'sup_2' as object union all select to_object from rels where object = 'sup_2' union all select object from rels where to_object = 'sup_2')"
    out["table_lineage"] = f"""with {static} select distinct w.source, w.target, d.name as via, w.state, w.unit, w.role from w join d using (definition) where w.state <> 'rejected'
union select c.target, m.target, d.name, case when 'review_required' in (c.state, m.state) then 'review_required' when 'draft' in (c.state, m.state) then 'draft' else 'validated' end, m.materialization, 'unknown' from m join c using (definition) join d using (definition) where m.state <> 'rejected' and c.state <> 'rejected' and c.operation = 'read'"""
    norm_ref = lambda c: f"lower(trim(regexp_replace(translate({c}, '[]\"`', ''), '\\s*\\.\\s*', '.', 'g')))"
    node = lambda c: f"coalesce((select d.definition from d where lower(d.name) = {norm_ref(c)} or d.definition = {norm_ref(c)}), 'external:' || {norm_ref(c)})"
    out["lineage_network"] = f"""with {static} select distinct {node('c.target')} as source, definition as target, 'reads_from' as relation, state from c where state <> 'rejected' and operation = 'read'
union select definition, {node('m.target')}, 'materializes_as', state from m where state <> 'rejected' union select {node('w.source')}, {node('w.target')}, 'derived_from', state from w where state <> 'rejected'"""
    out["lineage_find"] = f"""with {static}, nn as (select definition as id, split_part(name, '.', 2) as nm, name as ref, string_split_regex(lower(name || ' ' || split_part(name, '.', 2) || ' ' || kind), '[^a-z0-9]+') as ts from d),
rk as (select id, case when 'etl.load_7' in (nm, ref) then 0 when ends_with(ref, '.etl.load_7') or ends_with(nm, '.etl.load_7') then 1 when contains(nm, 'etl.load_7') then 2 when contains(ref, 'etl.load_7') then 3 else 4 end::int as rank_class, len(list_filter(['etl', 'load', '7'], lambda t: list_contains(ts, t)))::int as matched, length(nm) as size, ref from nn)
select id, rank_class, matched from rk where rank_class < 4 or matched > 0 order by rank_class, matched desc, size, ref, id limit 20"""
    out["process_order"] = f"""with recursive {static}, l as (select step, 0 as layer from s where len(depends_on) = 0 union select s.step, l.layer + 1 from s join l on list_contains(s.depends_on, l.step)), m2 as (select step, max(layer) as layer from l group by 1)
select step, row_number() over (order by layer, position, step)::int as place, layer::int as layer, name, coalesce((select string_agg(target, ',' order by claim) from c where c.definition = s.definition and operation = 'call' and state <> 'rejected'), '') as calls from s join m2 using (step) join d using (definition)"""
    cols = ", ".join(f"coalesce((select count(*) from {src} x where x.definition = d.definition and x.state = '{s}'), 0) as {k}_{s}" for k, src in (("claims", "c"), ("materializations", "m"), ("units", "(select distinct unit, definition, state from w)")) for s in lineage.STATES)
    out["lineage_status"] = f"with {static} select definition, name, analysis as analysis_state, {cols} from d"
    out["runtime_closure"] = f"""with recursive {mk.RUNTIME.sql('v')}, r as (select 'p1' as call_id union select u from (select call_id, unnest(consumes) as u from v) x join r using (call_id))
select 'call' as kind, call_id as name from r union all select distinct 'origin', i from (select call_id, kind, unnest(inputs) as i from v) x join r using (call_id) where x.kind in ('sql', 'mongo')"""
    out["runtime_violations"] = f"""with {mk.BROKEN.sql('v')}, u as (select call_id, sequence, unnest(consumes) as used from v), g as (select call_id as used, min(sequence) as pos, max(case when status = 'succeeded' then 1 else 0 end) as ok from v group by 1)
select distinct 'sequence_contiguous' as rule, call_id || ':' || sequence as key from v where sequence not between 1 and (select count(*) from v) or sequence in (select sequence from v group by 1 having count(*) > 1) union all select 'call_unique', call_id from v group by 2 having count(*) > 1
union all select case when pos is null then 'consumes_unknown' when pos >= sequence then 'consumes_later' else 'consumes_failed' end, call_id || '>' || used from u left join g using (used) where pos is null or pos >= sequence or ok = 0"""
    scope = ", ".join([mk.SCOPE_OBJECTS.sql("o"), mk.ZONES.sql("z"), mk.CHANGED.sql("ch")])
    out["workspace_scope"] = f"""with {scope} select system, graph, area, schema_name, object, (select string_agg(distinct zone, ',' order by zone) from z where z.graph = o.graph and z.object = o.object) as zones from o
where schema_name in ('dbo', 'crm') and system in ('erp', 'crm') and exists (select 1 from z where z.graph = o.graph and z.object = o.object)"""
    out["workspace_impact"] = f"""with {scope} select 'area' as kind, area as name, count(*) as changes from ch join (select distinct graph, schema_name, area from o where area is not null) using (graph, schema_name) group by 2
union all select 'zone', zone, count(*) from ch join z using (graph, object) group by 2"""
    out["knowledge_budget"] = """with k as (select format('k{:06d}', doc_id) as id, doc_id % 5 as rank, doc_id % 97 = 3 as explicit, length(text) as n from documents where length(text) > 0), b as (select *, coalesce(sum(n) over (order by explicit desc, rank desc, id rows between unbounded preceding and 1 preceding), 0) as before from k)
select id, least(n, 24000 - before)::bigint as characters, 24000 - before < n as truncated from b where before < 24000"""
    out["context_fields_topn"] = f"""with {catalog}, h as (select *, case when field like '%name%' or field like '%price%' then length(field) else 0 end as score from fields)
select object, field, place::int as place from (select *, row_number() over (partition by object order by score > 0 desc, score desc, is_primary_key desc, position, field) as place from h) where place <= 3"""
    sem = ", ".join([catalog, mk.DATASETS.sql("ds"), mk.MODEL_FIELDS.sql("mf")])
    out["semantic_bindings"] = f"""with {sem}, a as (select namespace || '.' || object as target, object, unnest(['hive.' || namespace || '.' || object, namespace || '.' || object, object]) as alias, unnest([1, 2, 3]) as tier from objects),
b as (select dataset, tier, max(target) as target, max(object) as object, count(*) as n from ds join a on lower(source) = lower(alias) group by 1, 2), f as (select *, row_number() over (partition by dataset order by tier) as r from b)
select dataset, '' as field, target, tier from f where r = 1 and n = 1
union all select mf.dataset, mf.field, fields.field, 0 from mf join f on f.dataset = mf.dataset and r = 1 and n = 1 join fields on fields.object = f.object and lower(fields.field) = lower(replace(expression, '"', ''))"""
    er = mk.CANDIDATES.sql("c")
    out["er_find_modes"] = f"""with {er}, l as (select * from c where revision = 'r2' and status <> 'rejected'), s as (select * from l where status = 'reviewed'), r as (select * from l where status = 'candidate')
select 'confirmed' as mode, candidate, 'confirmed' as usage from s union all select 'candidates', candidate, 'exploratory_only' from r union all select 'confirmed_then_candidates', candidate, 'confirmed' from s
union all select 'confirmed_then_candidates', candidate, 'exploratory_only' from r where not exists (select 1 from s where s.left_field = r.left_field and s.right_field = r.right_field)"""
    out["er_evidence"] = f"with {er} select candidate, round(matched / evaluated, 6) as coverage, round(collisions / matched, 6) as collision_rate, matched <= evaluated and collisions <= matched and counterexamples <= evaluated as valid from c"
    out["entity_rule_overlap"] = """with a as (select distinct lower(p_name) as k, p_name from part), b as (select lower(p_name) as k, count(distinct p_name) as n from part group by 1)
select count(*) as evaluated, count(n) as matched, count(case when n > 1 then 1 end) as collisions from (select distinct upper(p_name) as l from part) x left join b on lower(x.l) = b.k"""
    return out | queries_estate.oracle_sql() | queries_catalog.oracle_sql(_changes_sql()) | queries_lineage.SQL | queries_search.oracle_sql(_tokens_sql)
