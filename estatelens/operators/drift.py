"""Changes between two versions of a catalog, of lineage and of compiled contexts, and what they make stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Change kinds that send a validated description back to review.
STALE = ["field_key_status_changed", "field_nullability_changed", "field_removed", "field_type_changed", "object_kind_changed", "object_removed", "possible_field_rename", "primary_key_changed"]
_OUT = ["reference", "kind", "severity", "before", "after"]


def _changes(both: DataFrame, reference: Column, attributes: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each attribute (column, kind, severity) that differs between b_<column> and a_<column>."""
    items = [F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.col(f"b_{c}").cast("string").alias("before"), F.col(f"a_{c}").cast("string").alias("after")) for c, k, s in attributes]
    out = both.select(reference.alias("reference"), F.explode(F.array(*items)).alias("x")).select("reference", "x.*")
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def _sides(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in before.columns if c not in keys]
    b = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest], F.lit(True).alias("b_is"))
    a = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in rest], F.lit(True).alias("a_is"))
    return b.join(a, keys, "full")


def _presence(both: DataFrame, reference: Column, removed: tuple[str, str], added: tuple[str, str]) -> DataFrame:
    gone, none = F.col("a_is").isNull(), F.lit(None).cast("string")
    one = both.where("a_is is null or b_is is null")
    return one.select(reference.alias("reference"), F.when(gone, removed[0]).otherwise(added[0]).alias("kind"), F.when(gone, removed[1]).otherwise(added[1]).alias("severity"), none.alias("before"), none.alias("after"))


def field_renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """(reference, before, after): a removed and an added field that alone share object, place, type, nullability and key."""
    signature = ["namespace", "object", "position", "data_type", "nullable", "is_primary_key"]
    keys = ["namespace", "object", "field"]
    gone = before.join(after.select(*keys), keys, "left_anti").groupBy(*signature).agg(F.count("*").alias("n"), F.max("field").alias("before")).where("n = 1").drop("n")
    new = after.join(before.select(*keys), keys, "left_anti").groupBy(*signature).agg(F.count("*").alias("n"), F.max("field").alias("after")).where("n = 1").drop("n")
    return gone.join(new, signature).select(F.concat_ws(".", "namespace", "object", "before").alias("reference"), "before", "after")


def schema_changes(before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(reference, kind, severity, before, after) between two catalogs (objects, fields, relationships)."""
    objects = _sides(before[0], after[0], ["namespace", "object"])
    name = F.concat_ws(".", "namespace", "object")
    kept = objects.where("a_is and b_is")
    out = _presence(objects, name, ("object_removed", "breaking"), ("object_added", "info"))
    out = out.union(_changes(kept, name, [("kind", "object_kind_changed", "review_required"), ("primary_key", "primary_key_changed", "breaking"), ("description", "technical_description_changed", "info")]))
    fields = _sides(before[1], after[1], ["namespace", "object", "field"])
    name = F.concat_ws(".", "namespace", "object", "field")
    out = out.union(_presence(fields, name, ("field_removed", "breaking"), ("field_added", "info")))
    kinds = [("data_type", "field_type_changed", "review_required"), ("nullable", "field_nullability_changed", "review_required"), ("is_primary_key", "field_key_status_changed", "breaking"), ("position", "field_position_changed", "info"), ("description", "technical_description_changed", "info")]
    out = out.union(_changes(fields.where("a_is and b_is"), name, kinds))
    out = out.union(field_renames(before[1], after[1]).select("reference", F.lit("possible_field_rename"), F.lit("review_required"), "before", "after"))

    def shaped(df: DataFrame) -> DataFrame:
        shape = F.concat_ws("|", F.array_join("from_fields", ","), "to_namespace", "to_object", F.array_join("to_fields", ","))
        return df.select("namespace", "object", "name", shape.alias("shape"))

    fks = _sides(shaped(before[2]), shaped(after[2]), ["namespace", "object", "name"])
    out = out.union(_presence(fks, F.col("name"), ("relationship_removed", "breaking"), ("relationship_added", "info")))
    return out.union(_changes(fks.where("a_is and b_is"), F.col("name"), [("shape", "relationship_changed", "breaking")])).select(*_OUT)


def refreshed_annotations(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """(reference, state, reasons) after a refresh: stale validated ones need review, those of removed nodes are archived."""
    stale = changes.where(F.col("kind").isin(*STALE)).groupBy("reference").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("reasons"))
    met = annotations.join(stale, "reference", "left")
    removed = F.coalesce(F.col("reasons"), F.lit("")).rlike("(field|object)_removed")
    state = F.when(removed, "removed").when(F.col("reasons").isNotNull() & (F.col("state") == "validated"), "review_required").otherwise(F.col("state"))
    return met.select("reference", state.alias("state"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def step_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(reference, kind, severity) between two step lists (step, definition, position, depends_on)."""
    both = _sides(before, after, ["step"])
    kept = both.where("a_is and b_is")
    none = ["reference", "kind", "severity"]
    out = _presence(both, F.col("step"), ("step_removed", "breaking"), ("step_added", "info")).select(*none)
    out = out.union(_changes(kept, F.col("step"), [("definition", "step_definition_changed", "review_required")]).select(*none))
    for a, b, kind, severity in (("b", "a", "dependency_removed", "breaking"), ("a", "b", "dependency_added", "info")):
        lost = kept.select("step", F.explode(F.array_except(f"{a}_depends_on", f"{b}_depends_on")).alias("dep"))
        out = out.union(lost.select(F.concat_ws("<-", "step", "dep"), F.lit(kind), F.lit(severity)))
    return out


def packet_diff(packets: DataFrame) -> DataFrame:
    """(section, id, change) between the left and the right side of packets(side, section, id, payload)."""
    both = _sides(packets.where("side = 'left'").drop("side"), packets.where("side = 'right'").drop("side"), ["section", "id"])
    change = F.when(F.col("b_is").isNull(), "added").when(F.col("a_is").isNull(), "removed").when(F.col("a_payload") != F.col("b_payload"), "changed")
    return both.select("section", "id", change.alias("change")).where("change is not null")


def packet_impact(packet: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, affected) of the packet's ids: whether a report changed them."""
    hit = changed.select("id").distinct().withColumn("affected", F.lit(True))
    return packet.select("id").distinct().join(hit, "id", "left").select("id", F.coalesce("affected", F.lit(False)).alias("affected"))
