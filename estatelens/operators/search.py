"""Retrieval over a graph: documents of objects and fields, embeddings, a persisted index, and one search with four modes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.functions import text as X

from . import retrieval, review

MODES = ("lexical", "bm25", "vector", "hybrid")
#: Width of the built-in embedding.
WIDTH = 64


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def _flags() -> Column:
    shown = [
        F.when(F.coalesce("data_type", F.lit("")) != "", F.concat(F.lit("data type="), "data_type")), F.when(F.coalesce("shown_type", F.lit("")) != "", F.concat(F.lit("semantic type="), "shown_type")),
        F.when(F.col("is_primary_key"), F.lit("primary key")), F.when(F.col("is_foreign_key"), F.lit("foreign key")), F.when(F.coalesce("shown_role", F.lit("")) != "", F.concat(F.lit("role="), "shown_role")),
    ]
    return F.array_compact(F.array(*shown))


def documents(nodes: DataFrame, states: tuple[str, ...] = review.VISIBLE, dialect: str | None = None) -> DataFrame:
    """(id, object_id, field_id, namespace, label, text): one document for each object and field, of allowed texts only.

    nodes(graph, catalog, id, type, label, parent_id, namespace, position, data_type, is_primary_key, is_foreign_key,
    technical_description, state, description, role, synonyms, grain, semantic_type); a null state is a node without annotation.
    What an annotation says shows in the given states; elsewhere the technical description stands in.
    """
    seen = F.coalesce(F.col("state").isin(*states), F.lit(False))
    free = F.col("state").isNull() | seen
    n = nodes.withColumn("told", F.when(seen, F.col("description")).otherwise(F.trim(F.coalesce("technical_description", F.lit("")))))
    n = n.withColumn("shown_role", F.when(seen, F.col("role"))).withColumn("said", F.when(seen, F.array_join("synonyms", ", "))).withColumn("shown_grain", F.when(free, F.col("grain"))).withColumn("shown_type", F.when(free, F.col("semantic_type")))
    f = n.where("type = 'field'").withColumn("flags", _flags())
    head = F.concat(F.lit("- "), "label", F.when(F.size("flags") > 0, F.concat(F.lit(" ("), F.array_join("flags", "; "), F.lit(")"))).otherwise(F.lit("")))
    entry = F.concat_ws("\n", head, _line("  Description", F.col("told")), _line("  Synonyms", F.col("said")))
    listed = f.groupBy("graph", F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("position", F.lit(9999)).alias("p"), F.col("id").alias("i"), entry.alias("e")))).alias("fs"))
    listed = listed.select("graph", "id", F.concat(F.lit("Fields:\n"), F.array_join(F.transform("fs", lambda x: x["e"]), "\n")).alias("fields"))
    o = n.where("type in ('table', 'view')")
    lines = [F.concat(F.lit("Database object: "), "label"), F.concat(F.lit("Object type: "), "type"), F.concat(F.lit("Catalog: "), "catalog"), F.concat(F.lit("Namespace: "), "namespace")]
    lines += [F.lit(f"SQL dialect: {dialect}")] if dialect else []
    lines += [_line("Description", F.col("told")), _line("Role", F.col("shown_role")), _line("Synonyms", F.col("said")), _line("Grain", F.col("shown_grain")), F.col("fields")]
    own = o.join(listed, ["graph", "id"], "left").select(F.concat(F.lit("object:"), "id").alias("id"), F.col("id").alias("object_id"), F.lit(None).cast("string").alias("field_id"), "namespace", "label", F.concat_ws("\n", *lines).alias("text"))
    parents = o.select("graph", F.col("id").alias("parent_id"), F.col("label").alias("parent"), F.col("namespace").alias("ns"))
    under = f.join(parents, ["graph", "parent_id"])
    name = F.concat_ws(".", "parent", "label")
    lines = [
        F.concat(F.lit("Database field: "), name), F.concat(F.lit("Parent object: "), "parent"), F.concat(F.lit("Namespace: "), "ns"), F.when(F.size("flags") > 0, F.concat(F.lit("Properties: "), F.array_join("flags", ", "))),
        _line("Description", F.col("told")), _line("Role", F.col("shown_role")), _line("Synonyms", F.col("said")),
    ]
    return own.union(under.select(F.concat(F.lit("field:"), "id"), "parent_id", "id", "ns", name, F.concat_ws("\n", *lines)))


def hashed_embedding(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `vector`: counts of its tokens by hash, over their length; zero for a text without tokens. An offline stand-in for a model."""
    places = F.transform(X.bm25_tokens(F.col(text)), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % WIDTH)
    counts = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.size(F.filter("__p", lambda p: p == i)).cast("double"))
    # through generators, so that a text is cut once and not for each place
    placed = df.select("*", F.inline(F.array(F.struct(places.alias("__p"))))).select("*", F.inline(F.array(F.struct(counts.alias("__c")))))
    length = F.sqrt(F.aggregate("__c", F.lit(0.0), lambda a, x: a + x * x))
    return placed.withColumn("vector", F.transform("__c", lambda x: x / F.greatest(length, F.lit(1e-12)))).select(*df.columns, "vector")


#: Adds `vector` to a table with a text column.
Embedder = Callable[[DataFrame], DataFrame]


def revision(*tables: DataFrame) -> str:
    """A digest of tables' rows, whatever their order: one pass, one row out of each."""
    out = []
    for t in tables:
        cols = sorted(t.columns)
        row = F.xxhash64(*[F.to_json(F.struct(*[F.col(c) for c in cols]))])
        n, total, mixed = t.select(row.alias("h")).agg(F.count("*"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("h")), F.lit(0))).first()
        out.append(f"{','.join(cols)}|{n}|{total}|{mixed}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


class Index:
    """Documents and vectors below a folder, with the identity of what they were made from; a build can be resumed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}")

    def metadata(self) -> dict | None:
        """identity, model and documents of the index; the identity is that of documents and model."""
        rows = self._read("metadata")
        return None if rows is None else rows.first().asDict()

    def build(self, docs: DataFrame, embed: Embedder = hashed_embedding, model: str = "hashed", batches: int = 1, stop_after: int | None = None, resume: bool = True) -> None:
        """Embed docs(id, text, ...) in batches by id; what an earlier build of the same identity finished is not made again.

        An unfinished index of another identity is refused, not silently replaced; resume=False starts anew.
        """
        identity = revision(docs.select("id", "text")) + ":" + model
        was = self.metadata()
        if was is not None and resume and was["identity"] != identity and self.status()["missing"]:
            raise ValueError("an unfinished index has another identity")
        if was is None or not resume or was["identity"] != identity:
            docs.write.mode("overwrite").parquet(f"{self.root}/documents")
            self.spark.createDataFrame([(identity, model, docs.count())], "identity string, model string, documents long").write.mode("overwrite").parquet(f"{self.root}/metadata")
            self.spark.createDataFrame([], "id string, vector array<double>").write.mode("overwrite").parquet(f"{self.root}/vectors")
        kept = self._read("documents")
        for b in range(batches if stop_after is None else min(stop_after, batches)):
            part = kept.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b).join(self._read("vectors").select("id"), "id", "left_anti")
            embed(part.select("id", "text")).select("id", "vector").write.mode("append").parquet(f"{self.root}/vectors")

    def status(self) -> dict:
        """documents and missing vectors of the index."""
        meta = self.metadata()
        if meta is None:
            return {"documents": 0, "missing": 0, "identity": None}
        missing = self._read("documents").join(self._read("vectors").select("id"), "id", "left_anti").count()
        return {"documents": meta["documents"], "missing": missing, "identity": meta["identity"]}

    def load(self, docs: DataFrame | None = None) -> DataFrame:
        """The indexed documents with their vectors; raises if vectors are missing or if docs have changed since."""
        meta = self.metadata()
        if meta is None or self.status()["missing"]:
            raise ValueError("the index is not built")
        if docs is not None and not meta["identity"].startswith(revision(docs.select("id", "text")) + ":"):
            raise ValueError("the index is stale")
        return self._read("documents").join(self._read("vectors"), "id")


def within(docs: DataFrame, namespace: str | None = None, object_ids: DataFrame | None = None) -> DataFrame:
    """Documents of a namespace, whatever its case, and of the objects (object_id) if they are given."""
    if namespace is not None:
        docs = docs.where(F.lower("namespace") == namespace.lower())
    return docs if object_ids is None else docs.join(object_ids.select("object_id").distinct(), "object_id", "left_semi")


def ranked(docs: DataFrame, query: str, mode: str, limit: int, embed: Embedder = hashed_embedding) -> DataFrame:
    """(id, score, sources) of the best documents by BM25, vectors (docs with vector) or both; five times the limit are looked at."""
    if mode not in MODES[1:]:
        raise ValueError(f"unknown mode: {mode}")
    most = max(20, min(docs.count(), 5 * limit))
    lists = {}
    if mode in ("bm25", "hybrid"):
        lists["bm25"] = retrieval.bm25(docs, query, most, "id", label=F.col("label"))
    if mode in ("vector", "hybrid"):
        if "vector" not in docs.columns:
            raise ValueError("vector modes need an index")
        asked = list(embed(docs.sparkSession.createDataFrame([(query,)], "text string")).first().vector)
        lists["vector"] = retrieval.vector_topk(docs, asked, most, "id", "vector")
    if mode == "hybrid":
        return retrieval.rank_fusion(lists, most)
    return lists[mode].select("id", "score", F.lit(mode).alias("sources"))


def search(docs: DataFrame, query: str, mode: str = "bm25", limit: int = 20, namespace: str | None = None, object_ids: DataFrame | None = None, embed: Embedder = hashed_embedding) -> DataFrame:
    """(object_id, score, fields, sources, matched) of the best objects: their best document, up to eight fields, the query terms met."""
    if not 1 <= limit <= 100:
        raise ValueError("a search gives 1 to 100 hits")
    found = within(docs, namespace, object_ids)
    hits = ranked(found, query, mode, limit, embed).join(found.select("id", "object_id", "field_id", "text"), "id")
    terms = F.array_sort(F.array_distinct(X.bm25_tokens(F.lit(query))))
    hits = hits.withColumn("met", F.array_intersect(terms, X.bm25_tokens(F.col("text"))))
    best = retrieval.roll_up(hits.select("object_id", "field_id", "score"))
    more = hits.groupBy("object_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", "[+]"))))), "+").alias("sources"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))), ",").alias("matched"))
    score = F.greatest(F.lit(1), F.round(F.col("score") * 1_000_000)).cast("long")
    return best.join(more, "object_id").select("object_id", score.alias("score"), "fields", "sources", "matched").orderBy(F.desc("score"), "object_id").limit(limit)


#: Hits of each graph that a workspace's search ranks together.
GRAPH_HITS = 100


def _in_scope(df: DataFrame, scope: DataFrame) -> DataFrame:
    return df.join(scope.select("graph", "object_id").distinct(), ["graph", "object_id"], "left_semi")


def workspace_lexical(objects: DataFrame, fields: DataFrame, scope: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(graph, object_id, label, score, matched, fields) of the best objects of a scope(graph, object_id) by weighted terms.

    objects(graph, object_id, label, name, ...) and fields(graph, object_id, name, ...) are those of all graphs, searched in one
    pass: what is out of scope leaves first, then every graph's best GRAPH_HITS are ranked together.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a search gives 1 to 100 hits")
    own = _in_scope(objects, scope)
    hits = retrieval.lexical_scores(own, _in_scope(fields, scope), query, ["graph", "object_id"]).join(own.select("graph", "object_id", "label"), ["graph", "object_id"])
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("score"), F.lower("label"), "object_id"))
    return _ranked_together(hits.withColumn("place", place).where(F.col("place") <= GRAPH_HITS), limit).select("graph", "object_id", "label", "score", "matched", "fields")


def workspace_search(docs: DataFrame, scope: DataFrame, query: str, limit: int = 20, mode: str = "bm25", embed: Embedder = hashed_embedding) -> DataFrame:
    """(graph, object_id, label, score, fields, sources) of the best objects of a scope(graph, object_id) by BM25, vectors or both.

    docs(graph, id, object_id, field_id, label, text) are those of all graphs, with vector for the vector modes; every graph has
    its own statistics and ranks over what the scope allows of it.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a search gives 1 to 100 hits")
    if mode not in MODES[1:]:
        raise ValueError(f"unknown mode: {mode}")
    own = _in_scope(docs, scope)
    lists = {}
    if mode in ("bm25", "hybrid"):
        lists["bm25"] = retrieval.bm25_groups(own, query, 5 * GRAPH_HITS, "graph", "id", F.col("label"))
    if mode in ("vector", "hybrid"):
        if "vector" not in docs.columns:
            raise ValueError("vector modes need an index")
        asked = list(embed(docs.sparkSession.createDataFrame([(query,)], "text string")).first().vector)
        rank = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("score"), "id"))
        lists["vector"] = own.select("graph", "id", retrieval.dot("vector", asked).alias("score")).withColumn("rank", rank).where(F.col("rank") <= 5 * GRAPH_HITS)
    if mode == "hybrid":
        both = lists["bm25"].select("graph", "id", "rank", F.lit("bm25").alias("source")).unionByName(lists["vector"].select("graph", "id", "rank", F.lit("vector").alias("source")))
        hits = both.groupBy("graph", "id").agg(F.round(F.sum(1 / (retrieval.RRF + F.col("rank"))), 9).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))
    else:
        hits = lists[mode].select("graph", "id", "score", F.array(F.lit(mode)).alias("sources"))
    met = hits.join(own.select("graph", "id", "object_id", "field_id"), ["graph", "id"])
    order = F.row_number().over(Window.partitionBy("graph", "object_id").orderBy(F.desc("score"), F.col("field_id").asc_nulls_first()))
    met = met.withColumn("r", order)
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("r") <= retrieval.FIELD_HITS) & F.col("field_id").isNotNull(), F.struct("r", "field_id")))), lambda x: x["field_id"]), ",")
    best = met.groupBy("graph", "object_id").agg(F.max("score").alias("best"), shown.alias("fields"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))), "+").alias("sources"))
    best = best.withColumn("score", F.greatest(F.lit(1), F.round(F.col("best") * 1_000_000)).cast("long"))
    names = own.where("field_id is null").select("graph", "object_id", "label")
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("score"), F.lower("label"), "object_id"))
    first = best.join(names, ["graph", "object_id"]).withColumn("place", place).where(F.col("place") <= GRAPH_HITS)
    return _ranked_together(first, limit).select("graph", "object_id", "label", "score", "fields", "sources")


def _ranked_together(hits: DataFrame, limit: int) -> DataFrame:
    label = F.concat_ws(":", "graph", "label")
    return hits.withColumn("label", label).orderBy(F.desc("score"), F.lower("label"), "object_id").limit(limit)
