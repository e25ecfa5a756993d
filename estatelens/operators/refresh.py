"""Refreshes that carry reviewed state from one version of a catalog or a lineage document to the next, with reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drift
from .graph import cut

#: Field changes that send a validated candidate at one of its ends back to review.
END_CHANGES = ["field_key_status_changed", "field_nullability_changed", "field_removed", "field_type_changed"]
_STALE = ["claim_type", "reference", "previous_state", "present", "reasons"]


@dataclass
class Refresh:
    """The carried tables, the stale claims, the changes and the counts (name, n)."""

    carried: dict[str, DataFrame]
    stale: DataFrame
    changes: DataFrame
    counts: DataFrame


def _references(objects: DataFrame, fields: DataFrame) -> DataFrame:
    return objects.select(F.concat_ws(".", "namespace", "object").alias("reference")).union(fields.select(F.concat_ws(".", "namespace", "object", "field")))


def _counted(spark_counts: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, df in spark_counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def refresh_graph(before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame], annotations: DataFrame, candidates: DataFrame) -> Refresh:
    """Carry annotations(reference, state) and candidates(id, from_object, from_field, to_object, to_field, state) to the next catalog.

    Validated annotations of changed nodes and validated candidates of changed fields need review again; annotations of
    removed nodes, candidates without ends and candidates that the source now declares become stale claims.
    """
    changes = cut(drift.schema_changes(before, after))
    old, new = _references(*before[:2]), _references(*after[:2])
    reasons = changes.where(F.col("kind").isin(*drift.STALE)).groupBy("reference").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("reasons"))
    met = annotations.join(new.withColumn("here", F.lit(True)), "reference", "left").join(reasons, "reference", "left")
    again = F.col("here") & F.col("reasons").isNotNull() & (F.col("state") == "validated")
    met = cut(met.withColumn("again", F.coalesce(again, F.lit(False))))
    carried = met.where("here").select("reference", F.when(F.col("again"), "review_required").otherwise(F.col("state")).alias("state"))
    stale = met.where("again or here is null").select(
        F.lit("annotation").alias("claim_type"), "reference", F.col("state").alias("previous_state"), F.coalesce("here", F.lit(False)).alias("present"), F.coalesce("reasons", F.lit("node_removed")).alias("reasons"),
    )
    ends = after[1].select(F.concat_ws(".", "namespace", "object").alias("object"), "field")
    there = lambda s: ends.select(F.col("object").alias(f"{s}_object"), F.col("field").alias(f"{s}_field"), F.lit(True).alias(f"{s}_here"))
    declared = after[2].where("size(from_fields) = 1").select(
        F.concat_ws(".", "namespace", "object").alias("from_object"), F.col("from_fields")[0].alias("from_field"), F.concat_ws(".", "to_namespace", "to_object").alias("to_object"), F.col("to_fields")[0].alias("to_field"), F.lit(True).alias("declared"),
    ).distinct()
    moved = changes.where(F.col("kind").isin(*END_CHANGES)).select(F.col("reference").alias("end")).distinct()
    changed = lambda s: moved.select(F.col("end").alias(f"{s}_end"), F.lit(True).alias(f"{s}_changed"))
    c = candidates.join(there("from"), ["from_object", "from_field"], "left").join(there("to"), ["to_object", "to_field"], "left").join(declared, ["from_object", "from_field", "to_object", "to_field"], "left")
    c = c.withColumn("from_end", F.concat_ws(".", "from_object", "from_field")).withColumn("to_end", F.concat_ws(".", "to_object", "to_field")).join(changed("from"), "from_end", "left").join(changed("to"), "to_end", "left")
    fate = (
        F.when(F.col("from_here").isNull() | F.col("to_here").isNull(), "endpoint_removed").when(F.col("declared"), "superseded_by_declared_relationship")
        .when((F.col("state") == "validated") & (F.col("from_changed") | F.col("to_changed")), "relationship_endpoint_changed")
    )
    c = cut(c.withColumn("fate", fate))
    kept = c.where("fate is null or fate = 'relationship_endpoint_changed'").select("id", "from_object", "from_field", "to_object", "to_field", F.when(F.col("fate").isNotNull(), "review_required").otherwise(F.col("state")).alias("state"))
    stale = stale.union(c.where("fate is not null").select(F.lit("relationship"), "id", "state", F.col("fate") == "relationship_endpoint_changed", "fate"))
    counts = _counted([
        ("carried_annotations", carried), ("review_required_annotations", met.where("again")), ("removed_annotated_nodes", met.where("here is null")), ("carried_relationships", kept),
        ("removed_relationships", c.where("fate = 'endpoint_removed'").select("id").union(changes.where("kind = 'relationship_removed'").select("reference"))), ("superseded_relationships", c.where("fate = 'superseded_by_declared_relationship'")),
        ("review_required_relationships", c.where("fate = 'relationship_endpoint_changed'")), ("added_nodes", new.join(old, "reference", "left_anti")), ("removed_nodes", old.join(new, "reference", "left_anti")),
    ])
    return Refresh({"annotations": carried, "candidates": kept}, stale.select(*_STALE), changes, counts)


def _differs(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    return out


def refresh_lineage(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> Refresh:
    """Carry lineage items to the next version of a document.

    Each version is definitions(definition, kind, language, content, ...) and items(definition, item_type, id, key, state, declared,
    evidence, target, mode): analyses, failures, claims, write units and materializations; of the new version only what the source
    declares. key names what a claim is about. Items of an unchanged definition stay as they are; those of a changed one need
    review, its analyses go; declared items follow the source.
    """
    keys = ["definition"]
    b = before[0].select("definition", *[F.col(c).alias(f"b_{c}") for c in ("kind", "language", "content")], F.lit(True).alias("b_is"))
    a = after[0].select("definition", *[F.col(c).alias(f"a_{c}") for c in ("kind", "language", "content")], F.lit(True).alias("a_is"))
    both = b.join(a, keys, "full")
    why = F.array_join(F.array_compact(F.array(*[F.when(_differs(c), F.lit(f"definition_{c}_changed")) for c in ("kind", "content", "language")])), ",")
    fate = F.when(F.col("a_is").isNull(), "definition_removed").when(F.col("b_is").isNull(), "new").otherwise(why)
    fates = both.select("definition", fate.alias("fate"))
    old = before[1].join(fates, keys)
    new = after[1].where("declared")
    claims = new.where("item_type = 'claim'")
    again = claims.select("definition", "id", F.col("evidence").alias("now"), F.lit(True).alias("still"))
    shadow = claims.select("definition", "key", F.lit(True).alias("shadowed")).distinct()
    c = old.where("item_type <> 'materialization'").join(again, ["definition", "id"], "left").join(shadow, ["definition", "key"], "left")
    gone = F.col("declared") & F.col("still").isNull()
    hidden = (F.col("item_type") == "claim") & ~F.col("declared") & F.coalesce("shadowed", F.lit(False))
    moved = F.col("declared") & F.col("still") & ~F.col("evidence").eqNullSafe(F.col("now"))
    analysis = F.col("item_type").isin("analysis", "analysis_failure")
    step = (
        F.when(F.col("fate") == "definition_removed", "removed").when(gone, "undeclared").when(hidden, "hidden").when((F.col("fate") != "") & analysis, "dropped")
        .when(F.col("fate") != "", "again").when(F.coalesce(moved, F.lit(False)), "moved").otherwise("same")
    )
    c = cut(c.withColumn("step", step))
    state = F.when(F.col("step") == "again", "review_required").when((F.col("step") == "moved") & (F.col("state") == "validated"), "review_required").otherwise(F.col("state"))
    out = ["definition", "item_type", "id", "key", "state", "declared", "evidence", "target", "mode"]
    kept = c.where("step in ('again', 'moved', 'same')").select("definition", "item_type", "id", "key", state.alias("state"), "declared", F.coalesce(F.when(F.col("declared"), F.col("now")), F.col("evidence")).alias("evidence"), "target", "mode")
    added = claims.join(kept.select("id"), "id", "left_anti").select(*out)
    m = before[1].where("item_type = 'materialization'").select("definition", F.col("state").alias("b_state"), F.col("target").alias("b_target"), F.col("mode").alias("b_mode"))
    n = new.where("item_type = 'materialization'").select(*out, F.lit(True).alias("now_is"))
    mats = m.withColumn("was", F.lit(True)).join(n, "definition", "full").join(fates, keys, "left")
    other = F.col("was") & F.col("now_is") & ((F.col("b_target") != F.col("target")) | (F.col("b_mode") != F.col("mode")))
    made = mats.where("now_is").select("definition", "item_type", "id", "key", F.when(F.col("was").isNull(), F.col("state")).when(other, "review_required").otherwise(F.col("b_state")).alias("state"), "declared", "evidence", "target", "mode")
    reason = F.when(F.col("step").isin("again", "dropped"), F.col("fate")).when(F.col("step") == "removed", "definition_removed").when(F.col("step") == "undeclared", "declared_reference_removed").when(F.col("step") == "moved", "declared_reference_evidence_changed")
    stale = c.select("item_type", "definition", F.col("state").alias("previous_state"), (F.col("step") != "removed").alias("present"), reason.alias("reasons")).where("reasons is not null")
    lost = F.when(F.col("fate") == "definition_removed", "definition_removed").when(F.col("now_is").isNull(), "materialization_removed").when(other, "materialization_changed")
    stale = stale.union(mats.where("was").select(F.lit("materialization"), "definition", "b_state", F.col("fate") != "definition_removed", lost.alias("r")).where("r is not null"))
    carried = cut(kept.unionByName(added).unionByName(made))
    of = lambda t: carried.where(F.col("item_type") == t)
    review = c.where("step = 'again' or (step = 'moved' and state = 'validated')")
    counts = _counted([
        ("carried_analyses", of("analysis")), ("carried_failures", of("analysis_failure")), ("carried_claims", of("claim")), ("carried_write_units", of("write_unit")),
        ("review_required_claims", review.where("item_type = 'claim'")), ("review_required_write_units", review.where("item_type = 'write_unit'")),
        ("added_definitions", fates.where("fate = 'new'")), ("removed_definitions", fates.where("fate = 'definition_removed'")),
    ])
    stale = stale.select(F.col("item_type").alias("claim_type"), F.col("definition").alias("reference"), "previous_state", "present", "reasons")
    return Refresh({"items": carried}, stale, lineage_changes(before, after), counts)


def lineage_changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(reference, kind, severity) between two versions: definitions with all their attributes, declared references, materializations."""
    sides = drift._sides(before[0], after[0], ["definition"])
    none = ["reference", "kind", "severity"]
    attributes = [("kind", "definition_kind_changed", "review_required"), ("language", "definition_language_changed", "review_required"), ("content", "definition_content_changed", "review_required")]
    attributes += [(c, f"definition_{c}_changed", "info") for c in ("name", "qualified_name", "source_reference") if c in before[0].columns]
    out = drift._presence(sides, F.col("definition"), ("definition_removed", "breaking"), ("definition_added", "info")).select(*none)
    out = out.union(drift._changes(sides.where("a_is and b_is"), F.col("definition"), attributes).select(*none))

    def declared(items: DataFrame, tag: str) -> DataFrame:
        # several lines for one target count as the last one
        return items.where("declared and item_type = 'claim'").groupBy("definition", "key").agg(F.max_by("evidence", "id").alias(f"{tag}_evidence")).withColumn(f"{tag}_is", F.lit(True))

    refs = declared(before[1], "b").join(declared(after[1], "a"), ["definition", "key"], "full")
    kind = F.when(F.col("a_is").isNull(), "declared_reference_removed").when(F.col("b_is").isNull(), "declared_reference_added").when(~F.col("a_evidence").eqNullSafe(F.col("b_evidence")), "declared_reference_evidence_changed")
    out = out.union(refs.select("definition", kind.alias("kind"), F.when(F.col("b_is").isNull(), "info").otherwise("review_required")).where("kind is not null"))

    def made(items: DataFrame, tag: str) -> DataFrame:
        return items.where("item_type = 'materialization'").select("definition", F.col("target").alias(f"{tag}_target"), F.col("mode").alias(f"{tag}_mode"), F.lit(True).alias(f"{tag}_is"))

    mats = made(before[1], "b").join(made(after[1], "a"), "definition", "full")
    kind = F.when(F.col("a_is").isNull(), "materialization_removed").when(F.col("b_is").isNull(), "materialization_added").when(_differs("target", "mode"), "materialization_changed")
    return out.union(mats.select("definition", kind.alias("kind"), F.when(F.col("b_is").isNull(), "info").otherwise("review_required")).where("kind is not null"))


def workflow_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(reference, kind, severity) of workflows(document, source_kind, source_name, source_reference, workflow_name, steps) in both versions."""
    met = drift._sides(before, after, ["document"]).where("a_is and b_is")
    info = [(c, f"{c}_changed", "info") for c in ("source_kind", "source_name", "source_reference", "workflow_name")]
    out = drift._changes(met, F.col("document"), info).select("reference", "kind", "severity")
    moved = met.where("array_sort(b_steps) = array_sort(a_steps) and b_steps <> a_steps")
    return out.union(moved.select("document", F.lit("step_order_changed"), F.lit("info")))


def graph_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(reference, kind, severity, before, after) of graphs(graph, dialect, source_type)."""
    kinds = [("dialect", "graph_dialect_changed", "review_required"), ("source_type", "source_type_changed", "review_required")]
    return drift._changes(drift._sides(before, after, ["graph"]).where("a_is and b_is"), F.col("graph"), kinds)
