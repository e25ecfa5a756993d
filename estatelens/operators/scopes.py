"""Workspace scopes, focus snapshots, knowledge budgets, semantic bindings and entity-resolution candidates."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scopes from broad to narrow, and the operations of entity rules.
SCOPE_RANK = {"global": 0, "system": 1, "graph": 2, "schema": 3, "object": 4}
RULES = ("trim", "casefold", "collapse_whitespace", "strip_punctuation", "unicode_nfkc")


def resolve_scope(objects: DataFrame, zones: DataFrame, systems: Sequence[str] = (), graphs: Sequence[str] = (), areas: Sequence[str] = (), schemas: Sequence[str] = (), in_zones: Sequence[str] = ()) -> DataFrame:
    """(system, graph, area, schema_name, object, zones) of what all selectors that are given allow."""
    out = objects
    for column, wanted in (("system", systems), ("graph", graphs), ("area", areas), ("schema_name", schemas)):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    if in_zones:
        out = out.join(zones.where(F.col("zone").isin(*in_zones)).select("graph", "object"), ["graph", "object"], "left_semi")
    member = zones.groupBy("graph", "object").agg(F.array_join(F.sort_array(F.collect_set("zone")), ",").alias("zones"))
    return out.join(member, ["graph", "object"], "left").select("system", "graph", "area", "schema_name", "object", F.coalesce("zones", F.lit("")).alias("zones"))


def change_impacts(changes: DataFrame, objects: DataFrame, zones: DataFrame) -> DataFrame:
    """(kind, name, changes): areas of changed schemas and zones of changed objects."""
    schema = objects.where("area is not null").select("graph", "schema_name", "area").distinct()
    area = changes.join(schema, ["graph", "schema_name"]).groupBy("area").agg(F.count("*").alias("changes")).select(F.lit("area").alias("kind"), F.col("area").alias("name"), "changes")
    zone = changes.join(zones, ["graph", "object"]).groupBy("zone").agg(F.count("*").alias("changes")).select(F.lit("zone"), "zone", "changes")
    return area.union(zone)


def focus_members(hops: DataFrame, start: str) -> DataFrame:
    """(node, depth, reasons) of a trace's hops: the least depth of each end and why it is in."""
    spark = hops.sparkSession
    ends = hops.select(F.col("source").alias("node"), "depth", F.lit("upstream").alias("reason")).union(hops.select("target", F.col("depth") - 1, F.lit("consumer")))
    ends = ends.union(spark.createDataFrame([(start, 0, "start")], "node string, depth int, reason string"))
    return ends.groupBy("node").agg(F.min("depth").alias("depth"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def knowledge_budget(documents: DataFrame, most: int) -> DataFrame:
    """(id, characters, truncated) of documents(id, scope, explicit, content) within a character budget.

    Asked-for documents come first, then the narrowest scopes; what finds no room is left out, and empty documents are. Each
    document takes a character at least, so that the first `most` in the order are all that one task sums.
    """
    rank = F.create_map(*[x for k, v in SCOPE_RANK.items() for x in (F.lit(k), F.lit(v))])
    lengths = documents.select("id", "scope", "explicit", F.length("content").alias("n"))
    keys = [F.desc("explicit"), F.desc(rank[F.col("scope")]), F.lower("id"), F.col("id")]
    lengths = lengths.where("n > 0").orderBy(*keys).limit(most)
    before = F.coalesce(F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lengths.withColumn("before", before).where(F.col("before") < most)
    given = F.least(F.col("n").cast("long"), F.lit(most) - F.col("before"))
    return placed.select("id", given.alias("characters"), (given < F.col("n")).alias("truncated"))


def context_fields(fields: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """(object, field, place): the fields of each object worth showing, hits first, then keys, then by position."""
    met = fields.join(hits.select("object", "field", "score"), ["object", "field"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    order = Window.partitionBy("object").orderBy(F.desc(F.col("score") > 0), F.desc("score"), F.desc("is_primary_key"), "position", "field")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("object", "field", "place")


def dataset_bindings(datasets: DataFrame, objects: DataFrame, catalog: str) -> DataFrame:
    """(dataset, object, tier): the table that a dataset's source names, by catalog, schema and name, or less.

    The first tier with a match decides; if it has several, none is bound.
    """
    tiers = [F.concat_ws(".", F.lit(catalog), "namespace", "object"), F.concat_ws(".", "namespace", "object"), F.col("object")]
    names = objects.select("namespace", "object", F.posexplode(F.array(*[F.lower(t) for t in tiers])).alias("tier", "alias"))
    met = datasets.withColumn("alias", F.lower("source")).join(names, "alias")
    counted = met.groupBy("dataset", "tier").agg(F.count("*").alias("n"), F.max(F.concat_ws(".", "namespace", "object")).alias("object"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy("tier"))).where("r = 1 and n = 1")
    return first.select("dataset", "object", (F.col("tier") + 1).alias("tier"))


def field_bindings(model_fields: DataFrame, bound: DataFrame, fields: DataFrame) -> DataFrame:
    """(dataset, field, column) where an expression is just one column's name in the bound table."""
    plain = F.when(F.col("expression").rlike(r'^("[^"]+"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][A-Za-z0-9_]*)$'), F.lower(F.translate("expression", '"`[]', "")))
    wanted = model_fields.join(bound.select("dataset", "object"), "dataset").withColumn("name", plain).where("name is not null")
    own = fields.select(F.concat_ws(".", "namespace", "object").alias("object"), F.col("field").alias("column"), F.lower("field").alias("name"))
    met = wanted.join(own, ["object", "name"])
    return met.groupBy("dataset", "field").agg(F.count("*").alias("n"), F.max("column").alias("column")).where("n = 1").drop("n")


def find_candidates(candidates: DataFrame, revision: str, mode: str = "confirmed_then_candidates") -> DataFrame:
    """(candidate, usage) of the current revision, rejected ones left out, by mode.

    confirmed: reviewed ones; candidates: open ones; confirmed_then_candidates: both, open ones only where no reviewed one has
    the same fields.
    """
    live = candidates.where((F.col("revision") == revision) & (F.col("status") != "rejected"))
    sure = live.where("status = 'reviewed'").select("candidate", "left_field", "right_field", F.lit("confirmed").alias("usage"))
    rest = live.where("status = 'candidate'").select("candidate", "left_field", "right_field", F.lit("exploratory_only").alias("usage"))
    if mode == "confirmed":
        return sure.select("candidate", "usage")
    if mode == "candidates":
        return rest.select("candidate", "usage")
    if mode != "confirmed_then_candidates":
        raise ValueError(f"unknown mode: {mode}")
    return sure.union(rest.join(sure, ["left_field", "right_field"], "left_anti").select(*sure.columns)).select("candidate", "usage")


def candidate_evidence(candidates: DataFrame) -> DataFrame:
    """(candidate, coverage, collision_rate, valid) from a candidate's counts."""
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    sound = F.expr("matched <= evaluated and collisions <= matched and counterexamples <= evaluated")
    return candidates.select("candidate", rate("matched", "evaluated").alias("coverage"), rate("collisions", "matched").alias("collision_rate"), sound.alias("valid"))


def _nfkc(value):
    """Compatibility composition; the one rule without a built-in function, in Arrow batches."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return composed(value)


def apply_rule(value, operations: Sequence[str]):
    """A matching rule's operations, in order, as one Column; an extension, rules being declared only."""
    if len(operations) > 8 or not set(operations) <= set(RULES):
        raise ValueError("a rule has at most eight known operations")
    out = value
    for o in operations:
        out = {"trim": lambda v: F.trim(v), "casefold": lambda v: F.lower(F.replace(v, F.lit("ß"), F.lit("ss"))), "collapse_whitespace": lambda v: F.regexp_replace(v, r"\s+", " "), "strip_punctuation": lambda v: F.regexp_replace(v, r"[^\p{L}\p{N}\s]", ""), "unicode_nfkc": _nfkc}[o](out)
    return out


def rule_overlap(left: DataFrame, left_field: str, right: DataFrame, right_field: str, operations: Sequence[str]) -> DataFrame:
    """(evaluated, matched, collisions): distinct left values, those with a match, and those with several."""
    a = left.where(F.col(left_field).isNotNull()).select(F.col(left_field).alias("l")).distinct().withColumn("k", apply_rule(F.col("l"), operations))
    b = right.where(F.col(right_field).isNotNull()).select(F.col(right_field).alias("r")).distinct().withColumn("k", apply_rule(F.col("r"), operations))
    counted = a.join(b.groupBy("k").agg(F.count("*").alias("n")), "k", "left")
    return counted.agg(F.count("*").alias("evaluated"), F.count("n").alias("matched"), F.count(F.when(F.col("n") > 1, 1)).alias("collisions"))
