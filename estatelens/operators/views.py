"""Views for people: lineage flows, the review queue, single assets, degrees and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import text as X

#: Places of annotation states in the review queue.
QUEUE = {"draft": 0, "review_required": 1, "deferred": 2, "missing": 3, "validated": 4, "rejected": 5}


def lineage_flows(table_lineage: DataFrame, steps: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, label) and (source, target, relation) of assets and jobs: sources feed jobs, jobs write targets, steps precede steps.

    table_lineage(source, target, via), steps(step, definition, via, dependency), objects(id, reference); references without one
    object are assets of their own.
    """
    refs = table_lineage.select(F.explode(F.array("source", "target")).alias("reference")).distinct().withColumn("n", X.normalized_reference(F.col("reference")))
    own = objects.groupBy(X.normalized_reference(F.col("reference")).alias("n")).agg(F.count("*").alias("c"), F.max("id").alias("id")).where("c = 1")
    named = refs.join(own, "n", "left").select("reference", F.coalesce("id", F.concat(F.lit("lineage-ref::"), F.substring(F.sha2("n", 256), 1, 20))).alias("node"), F.col("id").isNull().alias("new"))
    job = lambda c: F.concat(F.lit("job::"), c)
    fed = table_lineage.join(named.select(F.col("reference").alias("source"), F.col("node").alias("a")), "source").select(F.col("a").alias("source"), job("via").alias("target"), F.lit("reads").alias("relation"))
    written = table_lineage.join(named.select(F.col("reference").alias("target"), F.col("node").alias("b")), "target").select(job("via"), "b", F.lit("writes"))
    first = steps.select(F.col("step").alias("dependency"), F.col("via").alias("earlier")).distinct()
    order = steps.join(first, "dependency").select(job("earlier"), job("via"), F.lit("precedes"))
    nodes = named.where("new").groupBy("node").agg(F.min("reference").alias("label")).select(F.col("node").alias("id"), F.lit("asset").alias("kind"), "label")
    jobs = table_lineage.select("via").union(steps.select("via")).distinct().select(job("via"), F.lit("job"), "via")
    return nodes.union(jobs), fed.union(written).union(order).distinct()


def review_queue(objects: DataFrame) -> DataFrame:
    """(place, id, label, state) of objects(id, label, state), what waits for a person first; a null state is a missing description."""
    state = F.coalesce("state", F.lit("missing"))
    rank = F.create_map(*[x for k, v in QUEUE.items() for x in (F.lit(k), F.lit(v))])
    return objects.select(F.coalesce(rank[state], F.lit(99)).alias("place"), "id", "label", state.alias("state")).orderBy("place", "label", "id")


def asset(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row of an object: label, fields in order, and the joins it takes part in; an unknown id raises."""
    one = nodes.where((F.col("id") == node_id) & F.col("type").isin("table", "view"))
    if one.isEmpty():
        raise ValueError(f"asset_not_found: {node_id}")
    fields = nodes.where(F.col("parent_id") == node_id).groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]), ",").alias("fields"))
    joins = edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id)).groupBy().agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("joins"))
    return one.select("id", "label", "type").crossJoin(fields).crossJoin(joins)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of every end of edges(source_id, target_id), a loop counting once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def most_connected(edges: DataFrame) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(1)


def payload(nodes: DataFrame) -> DataFrame:
    """(id, json) of every object with its fields, as a page shows it."""
    fields = nodes.where("type = 'field'").groupBy("graph", F.col("parent_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "label", "data_type"))), lambda f: F.struct(f["label"].alias("label"), f["data_type"].alias("data_type"))).alias("fields"))
    met = nodes.where("type in ('table', 'view')").join(fields, ["graph", "id"], "left")
    return met.select("id", F.to_json(F.struct("graph", "id", "label", "type", "description", "fields")).alias("json"))
