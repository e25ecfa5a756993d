"""Queries over the BM25 index, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generated as g
from .operators import search
from .operators.postings import Postings, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ASKED = "Nation of thedble thtion idiot the clown die tion Nation"


def _query(run):
    QUERIES[run.__name__] = run
    return run


def _index(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> Postings:
    index = Postings(spark, shared_folder(spark, "postings"))
    index.build(docs, id_col)
    return index


@_query
def postings_documents(spark, sf_dir):
    """Every posting of the documents."""
    return _index(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).postings().where("term is not null").select("term", F.col("id").alias("doc_id"), "tf", "n")


@_query
def postings_search(spark, sf_dir):
    return _index(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).search(ASKED, 30)


@_query
def postings_search_many(spark, sf_dir):
    """All benchmark passages as queries over all documents."""
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query"), "text")
    return _index(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).search_many(asked, 10)


@_query
def postings_refreshed(spark, sf_dir):
    """A search after a second build in which documents have come, changed and gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = _index(spark, docs.where("doc_id % 7 <> 3"))
    index.build(docs.where("doc_id % 5 <> 2").withColumn("text", F.when(F.col("doc_id") % 11 == 4, F.concat(F.lit("thtion clown "), "text")).otherwise(F.col("text"))), "doc_id")
    return index.search(ASKED, 30)


WORDS = "steel supplier promo f sups brushed of 7"


def _workspace(spark, sf_dir):
    """Objects and fields of two graphs, and a scope of half of them."""
    o, f = g.table(spark, sf_dir, "objects"), g.table(spark, sf_dir, "fields")
    objects = o.select("graph", F.col("id").alias("object_id"), "label", "name", F.col("description").alias("technical_description"))
    fields = f.select("graph", F.col("parent_id").alias("object_id"), "name", F.col("description").alias("technical_description"))
    return objects, fields, o.where("namespace in ('ns0', 'ns3')").select("graph", F.col("id").alias("object_id"))


@_query
def workspace_search_lexical(spark, sf_dir):
    return search.workspace_lexical(*_workspace(spark, sf_dir), WORDS, 25)


@_query
def workspace_search_bm25(spark, sf_dir):
    objects, fields, scope = _workspace(spark, sf_dir)
    own = objects.select("graph", F.col("object_id").alias("id"), "object_id", F.lit(None).cast("string").alias("field_id"), "label", F.col("technical_description").alias("text"))
    inner = fields.select("graph", F.concat_ws("/", "object_id", "name").alias("id"), "object_id", F.col("name").alias("field_id"), F.col("name").alias("label"), F.col("technical_description").alias("text"))
    return search.workspace_search(own.unionByName(inner), scope, WORDS, 25)


def oracle_sql(tokens: Callable[[str], str]) -> dict[str, str]:
    """tokens gives the SQL of a text's tokens."""
    docs = f"t as (select doc_id as id, {tokens('text')} as ts from documents)"
    scored = """n as (select id, len(ts) as n from t), st as (select count(*) as docs, avg(n) as mean from n), p as (select id, term, count(*) as tf from (select id, unnest(ts) as term from t) group by 1, 2), df as (select term, count(*) as df from p group by 1),
s as (select q.query, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * n / greatest(mean, 1.0)))), 9) as score from q join p using (term) join df using (term) join n using (id), st group by 1, 2),
r as (select query, id, score, row_number() over (partition by query order by score desc, id)::int as rank from s)"""
    one = f"q as (select 1 as query, unnest({tokens(chr(39) + ASKED + chr(39))}) as term)"
    cut = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
    one_of = "case when len(t) > 4 and t like '%ies' then t[:-4] || 'y' when len(t) > 3 and t like '%s' and not regexp_matches(t, '(ss|us|is)$') then t[:-2] else t end"
    terms = lambda x: f"list_distinct(list_transform({cut(x)}, lambda t: {one_of}))"
    held = f"{g.sql('objects', 'fields')}, ob as (select graph, id as object_id, label, name, description from objects where namespace in ('ns0', 'ns3')), fi as (select f.graph, parent_id as object_id, f.name, f.description from fields f join ob on ob.graph = f.graph and object_id = parent_id)"
    last = "select graph, object_id, graph || ':' || label as label, score, {cols} from (select *, row_number() over (partition by graph order by score desc, lower(label), object_id) as place from {src}) where place <= 100 order by score desc, lower(graph || ':' || label), object_id limit 25"
    words = "['7', 'brushed', 'f', 'promo', 'steel', 'sup', 'supplier']"
    lexical = f"""with {held}, q as (select unnest({words}) as term),
ow as (select graph, object_id, term, max(w) as w from (select graph, object_id, unnest({terms('name')}) as term, 12 as w from ob union all select graph, object_id, unnest({terms('description')}), 5 from ob) join q using (term) group by 1, 2, 3),
fw as (select graph, object_id, name, term, max(w) as w from (select graph, object_id, name, unnest({terms('name')}) as term, 9 as w from fi union all select graph, object_id, name, unnest({terms('description')}), 4 from fi) join q using (term) group by 1, 2, 3, 4),
bw as (select graph, object_id, term, max(w) as w from (select * from ow union all select graph, object_id, term, w from fw) group by 1, 2, 3), tw as (select graph, object_id, sum(w) as s, count(*) as matched from bw group by 1, 2),
sf as (select graph, object_id, string_agg(name, ',' order by r) as fields from (select graph, object_id, name, row_number() over (partition by graph, object_id order by sum(w) desc, lower(name)) as r from fw group by 1, 2, 3) where r <= 8 group by 1, 2),
sc as (select graph, object_id, label, (s + 2 * matched + case when matched = 7 then 10 else 0 end + case when len(list_filter({words}, lambda x: not list_contains({terms('name')}, x))) = 0 then 12 else 0 end)::bigint as score, matched, coalesce(fields, '') as fields from tw join ob using (graph, object_id) left join sf using (graph, object_id))
{last.format(cols='matched, fields', src='sc')}"""
    ranked = f"""with {held}, dd as (select graph, object_id as id, object_id, null as field_id, label, description as text from ob union all select graph, object_id || '/' || name, object_id, name, name, description from fi),
tk as (select graph, id, object_id, field_id, label, {tokens("label || ' ' || text")} as ts from dd), q as (select unnest({tokens("'" + WORDS + "'")}) as term), st as (select graph, count(*) as docs, avg(len(ts)) as mean from tk group by 1),
p as (select graph, id, term, count(*) as tf from (select graph, id, unnest(ts) as term from tk) group by 1, 2, 3), df as (select graph, term, count(*) as df from p group by 1, 2),
s as (select graph, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(ts) / greatest(mean, 1.0)))), 9) as score from q join p using (term) join df using (graph, term) join tk using (graph, id) join st using (graph) group by 1, 2),
r as (select * from (select s.graph, s.id, s.score, object_id, field_id, row_number() over (partition by s.graph order by s.score desc, lower(label), s.id) as rank from s join tk using (graph, id)) where rank <= 500),
f as (select *, row_number() over (partition by graph, object_id order by score desc, field_id nulls first) as r from r),
b as (select graph, object_id, greatest(1, round(max(score) * 1000000))::bigint as score, coalesce(string_agg(field_id, ',' order by r) filter (where r <= 8 and field_id is not null), '') as fields, 'bm25' as sources from f group by 1, 2), sc as (select b.*, label from b join ob using (graph, object_id))
{last.format(cols='fields, sources', src='sc')}"""
    changed = docs.replace("from documents", "from (select doc_id, case when doc_id % 11 = 4 then 'thtion clown ' || text else text end as text from documents where doc_id % 5 <> 2)")
    return {
        "workspace_search_lexical": lexical,
        "workspace_search_bm25": ranked,
        "postings_documents": f"with {docs}, e as (select id, len(ts)::bigint as n, unnest(ts) as term from t) select term, id as doc_id, count(*) as tf, any_value(n) as n from e group by 1, 2",
        "postings_search": f"with {docs}, {one}, {scored} select id, score, rank from r where rank <= 30",
        "postings_search_many": f"with {docs}, q as (select item_id as query, unnest({tokens('text')}) as term from benchmark), {scored} select * from r where rank <= 10",
        "postings_refreshed": f"with {changed}, {one}, {scored} select id, score, rank from r where rank <= 30",
    }
