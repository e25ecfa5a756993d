"""Search over documents: BM25, vectors, rank fusion, weighted lexical search and roll-up of field hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions import text as X

from . import profile
from .graph import cut

#: BM25's constants, the constant of rank fusion, the most field hits of an object.
K1, B, RRF, FIELD_HITS = 1.5, 0.75, 60, 8
#: Weights of what a term is found in.
OBJECT_WEIGHTS = {"name": 12, "synonyms": 10, "description": 8, "role": 6, "technical_description": 5, "grain": 5}
FIELD_WEIGHTS = {"name": 9, "synonyms": 8, "description": 7, "role": 5, "semantic_type": 5, "technical_description": 4}


def tokenized_query(spark, query: str, tokens=X.bm25_tokens) -> list[str]:
    """A query's terms; one row of one short text."""
    return list(spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t)


def _equals(word: str):
    return lambda x: x == F.lit(word)


def bm25(docs: DataFrame, query: str, limit: int = 20, id_col: str = "id", text: Column | None = None, label: Column | None = None) -> DataFrame:
    """(id, score, rank) of the best documents; repeated query terms count again.

    Texts are cut into tokens once; what is kept of a document is its length and its counts of the query's terms. Statistics
    are a single row, scores need no shuffle but the final top-k.
    """
    terms = tokenized_query(docs.sparkSession, query)
    label = F.lit("") if label is None else label
    body = F.concat_ws(" ", label, F.col("text") if text is None else text)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    distinct = list(dict.fromkeys(terms))
    tokens = profile.spread(docs).select(F.col(id_col), label.alias("label"), X.bm25_tokens(body).alias("t"))
    # through a generator, below which no filter goes: texts are cut once; the counts are small, and read twice
    counts = F.struct(F.size("t").alias("n"), *[F.size(F.filter("t", _equals(w))).alias(f"c{i}") for i, w in enumerate(distinct)])
    counted = cut(tokens.select(id_col, "label", F.inline(F.array(counts))))
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct))])
    hit = counted.where(" or ".join(f"c{i} > 0" for i in range(len(distinct)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for w in terms:
        i = distinct.index(w)
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        c = F.col(f"c{i}")
        score = score + idf * (c * (K1 + 1)) / (c + K1 * (1 - B + B * F.col("n") / F.greatest(F.col("mean"), F.lit(1.0))))
    best = hit.select(id_col, "label", F.round(score, 9).alias("score")).orderBy(F.desc("score"), F.lower("label"), id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.lower("label"), id_col))).drop("label")


def normalized_vector(v: Column) -> Column:
    """v over its length as doubles; null if empty, zero or not finite."""
    wide = v.cast("array<double>")
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    fine = (F.size(v) > 0) & (length > 0) & F.forall(wide, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(wide, lambda x: x / length))


def dot(column: str, query: list[float]) -> Column:
    """The dot product with a query, to six places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.round(F.aggregate(F.zip_with(F.col(column).cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6)


def vector_topk(vectors: DataFrame, query: list[float], limit: int = 20, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, score, rank) by dot product with the query, exact over all vectors."""
    scored = vectors.where(F.size(column) == len(query)).select(id_col, dot(column, query).alias("score")).where(~F.isnan("score"))
    best = scored.orderBy(F.desc("score"), id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def rank_fusion(lists: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """(id, score, sources) of ranked lists (id, rank): the sum of 1 / (60 + rank)."""
    parts = [df.select(F.col(df.columns[0]).alias("id"), "rank", F.lit(name).alias("source")) for name, df in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = both.groupBy("id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("sources"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def roll_up(hits: DataFrame) -> DataFrame:
    """(object_id, score, fields) of hits(object_id, field_id, score): the best score and up to eight best fields."""
    best = F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("score"), "field_id"))
    top = hits.withColumn("r", best)
    fields = F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("r") <= FIELD_HITS) & F.col("field_id").isNotNull(), F.struct("r", "field_id")))), lambda x: x["field_id"]), ",")
    return top.groupBy("object_id").agg(F.max("score").alias("score"), fields.alias("fields"))


def _term_weights(items: DataFrame, weights: dict[str, int], keys: list[str], terms: DataFrame) -> DataFrame:
    """The strongest weight of each (item, term)."""
    sources = [F.struct(F.col(c).alias("text"), F.lit(w).alias("weight")) for c, w in weights.items() if c in items.columns]
    texts = items.select(*keys, F.explode(F.array(*sources)).alias("s")).where("s.text is not null")
    found = texts.select(*keys, "s.weight", F.explode(X.lexical_tokens(F.col("s.text"))).alias("term")).join(F.broadcast(terms), "term")
    return found.groupBy(*keys, "term").agg(F.max("weight").alias("weight"))


def _no_hits(objects: DataFrame, by: list[str]) -> DataFrame:
    return objects.select(*by, F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("matched"), F.lit("").alias("fields")).limit(0)


def lexical_scores(objects: DataFrame, fields: DataFrame, query: str, by: list[str]) -> DataFrame:
    """(by, score, matched, fields) of every object, keyed by the columns `by`, that has a term of the query.

    A term takes its strongest place; 2 more for each term found, 10 if all are, 12 if all are in the object's name.
    """
    spark = objects.sparkSession
    wanted = tokenized_query(spark, query, X.query_terms)
    if not wanted:
        return _no_hits(objects, by)
    terms = spark.createDataFrame([(t,) for t in wanted], "term string")
    own = _term_weights(objects, OBJECT_WEIGHTS, by, terms)
    by_field = _term_weights(fields, FIELD_WEIGHTS, [*by, "name"], terms)
    best = own.unionByName(by_field.select(*by, "term", "weight")).groupBy(*by, "term").agg(F.max("weight").alias("weight"))
    total = best.groupBy(*by).agg(F.sum("weight").alias("sum"), F.count("*").alias("matched"))
    named = objects.select(*by, (F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), X.lexical_tokens(F.col("name")))) == 0).alias("named"))
    score = F.col("sum") + 2 * F.col("matched") + F.when(F.col("matched") == len(wanted), 10).otherwise(0) + F.when(F.col("named"), 12).otherwise(0)
    hits = by_field.groupBy(*by, "name").agg(F.sum("weight").alias("w"))
    shown = hits.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), F.lower("name")))).where(f"r <= {FIELD_HITS}")
    shown = shown.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("fields"))
    return total.join(named, by).join(shown, by, "left").select(*by, score.cast("long").alias("score"), "matched", F.coalesce("fields", F.lit("")).alias("fields"))


def lexical_search(objects: DataFrame, fields: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(object, score, matched, fields) of the best of objects(object, name, ...) and fields(object, name, ...) by weighted terms."""
    if not 1 <= limit <= 100:
        raise ValueError("a search gives 1 to 100 hits")
    return lexical_scores(objects, fields, query, ["object"]).orderBy(F.desc("score"), F.lower("object")).limit(limit)


def bm25_groups(docs: DataFrame, query: str, limit: int, by: str, id_col: str = "id", label: Column | None = None) -> DataFrame:
    """(by, id, score, rank) of the best documents of each group: `bm25` with every group's own statistics, in one pass over all groups."""
    terms = tokenized_query(docs.sparkSession, query)
    label = F.lit("") if label is None else label
    if not terms:
        return docs.select(by, id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    distinct = list(dict.fromkeys(terms))
    tokens = profile.spread(docs).select(by, id_col, label.alias("label"), X.bm25_tokens(F.concat_ws(" ", label, F.col("text"))).alias("t"))
    counts = F.struct(F.size("t").alias("n"), *[F.size(F.filter("t", _equals(w))).alias(f"c{i}") for i, w in enumerate(distinct)])
    counted = cut(tokens.select(by, id_col, "label", F.inline(F.array(counts))))
    stats = counted.groupBy(by).agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct))])
    score = F.lit(0.0)
    for w in terms:
        i = distinct.index(w)
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * (F.col(f"c{i}") * (K1 + 1)) / (F.col(f"c{i}") + K1 * (1 - B + B * F.col("n") / F.greatest(F.col("mean"), F.lit(1.0))))
    hit = counted.where(" or ".join(f"c{i} > 0" for i in range(len(distinct)))).join(stats, by).select(by, id_col, "label", F.round(score, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.lower("label"), id_col))
    return hit.withColumn("rank", rank).where(F.col("rank") <= limit).select(by, id_col, "score", "rank")
