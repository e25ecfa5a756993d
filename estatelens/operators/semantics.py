"""Semantic imports bound to a catalog: datasets, fields and relationships, edits, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scopes


def bind(tables: dict[str, DataFrame], objects: DataFrame, fields: DataFrame, relationships: DataFrame, catalog: str) -> tuple[DataFrame, DataFrame]:
    """(id, kind, target) of an import's parts that name something of the catalog, and (level, code, source_reference) of the others.

    A dataset binds by its source, a field by an expression that is just a column of the bound table, a relationship by
    the one declared foreign key between the bound tables with the same fields, spelt alike and in the same order.
    """
    d = tables["datasets"].select(F.col("id").alias("dataset"), "source", "model", "name", "source_reference")
    bound = scopes.dataset_bindings(d.select("dataset", "source"), objects, catalog).select("dataset", "object")
    own = fields.select("namespace", "object", "field")
    f = scopes.field_bindings(tables["fields"].select("dataset", F.col("id").alias("field"), "expression"), bound, own)
    ends = d.join(bound, "dataset").select("model", "name", "object")
    r = tables["relationships"]
    met = r.join(ends.select("model", F.col("name").alias("from_dataset"), F.col("object").alias("a")), ["model", "from_dataset"]).join(ends.select("model", F.col("name").alias("to_dataset"), F.col("object").alias("b")), ["model", "to_dataset"])
    keys = relationships.select("name", F.concat_ws(".", "namespace", "object").alias("a"), F.concat_ws(".", "to_namespace", "to_object").alias("b"), F.col("from_fields").alias("x"), F.col("to_fields").alias("y"))
    named = met.select("id", "a", "b", F.col("from_fields").alias("x"), F.col("to_fields").alias("y")).join(keys, ["a", "b", "x", "y"]).groupBy("id").agg(F.count("*").alias("n"), F.max("name").alias("target"))
    fk = named.where("n = 1")
    out = bound.select(F.col("dataset").alias("id"), F.lit("dataset").alias("kind"), F.col("object").alias("target"))
    out = out.union(f.select("field", F.lit("field"), F.col("column"))).union(fk.select("id", F.lit("relationship"), "target"))
    notes = None
    for kind in ("datasets", "fields", "relationships"):
        code = F.lit(f"{kind[:-1]}_not_bound")
        left = tables[kind].join(out.select("id"), "id", "left_anti")
        if kind == "relationships":
            left = left.join(named.where("n > 1").select("id", F.lit("relationship_binding_ambiguous").alias("several")), "id", "left")
            code = F.coalesce("several", code)
        left = left.select(F.lit("warning").alias("level"), code.alias("code"), "source_reference")
        notes = left if notes is None else notes.union(left)
    return out, tables["diagnostics"].union(notes)


def targets(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, kind, description) of everything that can be edited."""
    out = None
    for kind in ("models", "datasets", "fields", "metrics", "relationships"):
        description = F.col("description") if "description" in tables[kind].columns else F.lit(None).cast("string")
        one = tables[kind].select("id", F.lit(kind[:-1]).alias("kind"), description.alias("description"))
        out = one if out is None else out.union(one)
    return out


def effective(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, kind, description, original, edits) of parts(id, kind, description) after edits(edit, id, description, reason): the last one holds."""
    sound = edits.where(F.trim(F.coalesce("reason", F.lit(""))) != "")
    last = sound.groupBy("id").agg(F.max_by(F.struct("description"), "edit").alias("now"), F.count("*").alias("n"))
    met = parts.join(last, "id", "left")
    return met.select("id", "kind", F.when(F.col("now").isNotNull(), F.col("now.description")).otherwise(F.col("description")).alias("description"), F.col("description").alias("original"), F.coalesce("n", F.lit(0)).alias("edits"))


def summary(parts: DataFrame, bindings: DataFrame) -> DataFrame:
    """(kind, parts, bound) of an import."""
    return parts.join(bindings.select("id", F.lit(1).alias("b")), "id", "left").groupBy("kind").agg(F.count("*").alias("parts"), F.count("b").alias("bound"))


def by_target(parts: DataFrame, bindings: DataFrame) -> DataFrame:
    """(target, parts): what an import says about each thing of the catalog."""
    met = bindings.join(parts.select("id", "description"), "id")
    return met.groupBy("kind", "target").agg(F.sort_array(F.collect_list("id")).alias("parts"))
