"""Static lineage: table and process views, review status, the traceable network and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions import text as X

from .graph import topological_layers

#: Review states.
STATES = ["draft", "rejected", "review_required", "validated"]


def table_lineage(definitions: DataFrame, claims: DataFrame, writes: DataFrame, materializations: DataFrame) -> DataFrame:
    """(source, target, via, state, unit, role): writes with their sources, and reads of a definition that materializes.

    Rejected items are out; a derived row has the weaker state of its two.
    """
    names = definitions.select("definition", F.col("name").alias("via"))
    direct = writes.where("state <> 'rejected'").join(names, "definition").select("source", "target", "via", "state", "unit", "role")
    m = materializations.where("state <> 'rejected'").alias("m")
    c = claims.where("state <> 'rejected' and operation = 'read'").alias("c")
    either = lambda s: (F.col("m.state") == s) | (F.col("c.state") == s)
    state = F.when(either("review_required"), "review_required").when(either("draft"), "draft").otherwise("validated")
    derived = m.join(c, F.col("m.definition") == F.col("c.definition")).join(names.alias("n"), F.col("m.definition") == F.col("n.definition"))
    derived = derived.select(F.col("c.target").alias("source"), F.col("m.target").alias("target"), "n.via", state.alias("state"), F.col("m.materialization").alias("unit"), F.lit("unknown").alias("role"))
    return direct.unionByName(derived).distinct()


def process_view(definitions: DataFrame, steps: DataFrame, claims: DataFrame) -> DataFrame:
    """(step, place, layer, name, calls) of a workflow in the order of its dependencies."""
    calls = claims.where("operation = 'call' and state <> 'rejected'").groupBy("definition").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim", "target"))), lambda x: x["target"]), ",").alias("calls"))
    out = topological_layers(steps).join(steps.select("step", "definition"), "step").join(definitions.select("definition", "name"), "definition").join(calls, "definition", "left")
    return out.select("step", "place", "layer", "name", F.coalesce("calls", F.lit("")).alias("calls"))


def lineage_status(definitions: DataFrame, claims: DataFrame, writes: DataFrame, materializations: DataFrame) -> DataFrame:
    """Per definition its analysis state and the number of items of each kind in each review state."""
    items = claims.select("definition", "state", F.lit("claims").alias("kind")).union(materializations.select("definition", "state", F.lit("materializations")))
    items = items.union(writes.select("definition", "state", F.lit("units"), "unit").distinct().drop("unit"))
    counts = [F.sum(F.when((F.col("kind") == k) & (F.col("state") == s), 1).otherwise(0)).alias(f"{k}_{s}") for k in ("claims", "materializations", "units") for s in STATES]
    met = definitions.join(items.groupBy("definition").agg(*counts), "definition", "left")
    return met.select("definition", "name", F.col("analysis").alias("analysis_state"), *[F.coalesce(f"{k}_{s}", F.lit(0)).alias(f"{k}_{s}") for k in ("claims", "materializations", "units") for s in STATES])


def network(definitions: DataFrame, claims: DataFrame, writes: DataFrame, materializations: DataFrame, states: tuple[str, ...] = ("draft", "review_required", "validated")) -> DataFrame:
    """Edges (source, target, relation, state): a reference becomes the definition it names, else an external node; an ambiguous one raises."""
    aliases = definitions.select(F.col("definition").alias("node"), F.explode(F.array("definition", X.normalized_reference(F.col("name")))).alias("alias")).distinct()
    used = claims.where("operation = 'read'").select("target").union(materializations.select("target")).union(writes.select(F.explode(F.array("target", "source")))).select(X.normalized_reference(F.col("target")).alias("alias")).distinct()
    several = aliases.groupBy("alias").agg(F.count("*").alias("n")).where("n > 1").join(used, "alias", "left_semi").limit(1).collect()
    if several:
        raise ValueError(f"the reference {several[0].alias} names several definitions")

    def resolved(df: DataFrame, c: str) -> DataFrame:
        named = df.withColumn("__a", X.normalized_reference(F.col(c))).join(aliases, F.col("__a") == F.col("alias"), "left")
        return named.withColumn(c, F.coalesce("node", F.concat(F.lit("external:"), "__a"))).drop("__a", "alias", "node")

    live = F.col("state").isin(*states)
    reads = resolved(claims.where(live & (F.col("operation") == "read")), "target").select(F.col("target").alias("source"), F.col("definition").alias("target"), F.lit("reads_from").alias("relation"), "state")
    made = resolved(materializations.where(live), "target").select(F.col("definition").alias("source"), "target", F.lit("materializes_as").alias("relation"), "state")
    derived = resolved(resolved(writes.where(live), "target"), "source").select("source", "target", F.lit("derived_from").alias("relation"), "state")
    return reads.unionByName(made).unionByName(derived).distinct()


def find_references(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, rank_class, matched) of nodes(id, name, kind, reference) by how a query names them.

    0 exact, 1 last parts, 2 part of the name, 3 part of the reference, 4 shared terms; then coverage and short names.
    """
    needle = X.normalized_reference(F.lit(query))
    name, ref = X.normalized_reference(F.col("name")), X.normalized_reference(F.col("reference"))
    rank = F.when((needle == name) | (needle == ref), 0).when(F.endswith(ref, F.concat(F.lit("."), needle)) | F.endswith(name, F.concat(F.lit("."), needle)), 1).when(F.contains(name, needle), 2).when(F.contains(ref, needle), 3).otherwise(4)
    terms = X.bm25_tokens(F.lit(query))
    matched = F.size(F.array_intersect(F.array_distinct(terms), X.bm25_tokens(F.concat_ws(" ", "reference", "name", "kind"))))
    out = nodes.select("id", rank.alias("rank_class"), matched.alias("matched"), F.length(name).alias("size"), ref.alias("ref")).where("rank_class < 4 or matched > 0")
    return out.orderBy("rank_class", F.desc("matched"), "size", "ref", "id").limit(limit).select("id", "rank_class", "matched")


def definition_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(reference, kind, severity) between two lists of definitions (definition, name, kind, content)."""
    both = before.alias("b").join(after.alias("a"), F.col("b.definition") == F.col("a.definition"), "full")
    key = F.coalesce("b.definition", "a.definition")
    checks = [("kind", "definition_kind_changed", "review_required"), ("content", "definition_content_changed", "review_required"), ("name", "definition_name_changed", "info")]
    gone = F.when(F.col("a.definition").isNull(), F.struct(F.lit("definition_removed").alias("kind"), F.lit("breaking").alias("severity")))
    new = F.when(F.col("b.definition").isNull(), F.struct(F.lit("definition_added").alias("kind"), F.lit("info").alias("severity")))
    here = F.col("a.definition").isNotNull() & F.col("b.definition").isNotNull()
    rows = [gone, new, *[F.when(here & ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for c, k, s in checks]]
    return both.select(key.alias("reference"), F.explode(F.array_compact(F.array(*rows))).alias("x")).select("reference", "x.*")

