"""The traceable network of static lineage and technical graphs: nodes with aliases, edges, search and upstream traces.

Definitions and graph nodes are known by their aliases; a reference meets them by its normal form. One match is the node, none
becomes an external node, several are refused. A trace walks incoming edges level by level; each level is a join of
the frontier with the edges, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import text as X

from .graph import cut

#: Review states of lineage, and those that a network holds if nothing else is asked.
STATES = ("draft", "rejected", "review_required", "validated")
DEFAULT_STATES = ("draft", "review_required", "validated")
#: Texts of a trace's warnings.
WIDENS = "Physical lineage widens from a field to object-level procedure lineage."
UNVALIDATED = "The trace contains lineage that has not been human-validated."
NOTHING = "No upstream lineage was found for the selected reference."
_NODE = ["id", "reference", "name", "kind", "source", "description", "aliases"]


def definition_nodes(definitions: DataFrame) -> DataFrame:
    """Nodes of definitions(document, definition, external_id, name, qualified_name, kind, summary)."""
    return definitions.select(
        F.concat(F.lit("lineage:"), "document", F.lit(":"), "definition").alias("id"), F.col("qualified_name").alias("reference"), "name", "kind",
        F.concat(F.lit("lineage:"), "document").alias("source"), F.col("summary").alias("description"), F.array("definition", "external_id", "name", "qualified_name").alias("aliases"),
    )


def technical_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of graph nodes(graph, catalog, id, type, label, parent_id, description), fields under their objects."""
    parents = nodes.where("type in ('table', 'view')").select("graph", F.col("id").alias("parent_id"), F.col("label").alias("parent_label"))
    met = nodes.where("type in ('field', 'table', 'view')").join(parents, ["graph", "parent_id"], "left")
    local = F.when((F.col("type") == "field") & F.col("parent_label").isNotNull(), F.concat_ws(".", "parent_label", "label")).otherwise(F.col("label"))
    reference = F.concat_ws(".", "catalog", local)
    aliases = F.when((F.col("type") == "field") & F.col("parent_label").isNull(), F.array("id", reference)).otherwise(F.array(F.col("id"), local, reference))
    return met.select(F.concat(F.lit("graph:"), "graph", F.lit(":"), "id").alias("id"), reference.alias("reference"), F.col("label").alias("name"), F.col("type").alias("kind"), F.concat(F.lit("graph:"), "graph").alias("source"), "description", aliases.alias("aliases"))


def aliases(nodes: DataFrame) -> DataFrame:
    """(alias, ids): the sorted nodes that each normalized alias names."""
    each = nodes.select(F.col("id").alias("node"), F.explode("aliases").alias("a"))
    return each.groupBy(X.normalized_reference(F.col("a")).alias("alias")).agg(F.sort_array(F.collect_set("node")).alias("ids"))


def references(claims: DataFrame, materializations: DataFrame, writes: DataFrame, states: tuple[str, ...] = DEFAULT_STATES) -> DataFrame:
    """(reference) of every name that the live items use for other nodes."""
    live = F.col("state").isin(*states)
    named = claims.where(live & (F.col("operation") == "read")).select(F.col("target").alias("reference")).union(materializations.where(live).select("target"))
    return named.union(writes.where(live).select(F.explode(F.array("target", "source")))).distinct()


def resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reference, node, matches) of refs(reference): its node, an external one if nothing has the alias, null if several have."""
    normal = X.normalized_reference(F.col("reference"))
    met = refs.withColumn("alias", normal).join(aliases(nodes), "alias", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    n = F.when(F.col("ids").isNull(), 0).otherwise(n)
    return met.select("reference", F.when(n == 0, F.concat(F.lit("external:"), "alias")).when(n == 1, F.col("ids")[0]).alias("node"), n.alias("matches"))


def ambiguous(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule, key) of references that name several nodes."""
    return resolved(refs, nodes).where("matches > 1").select(F.lit("ambiguous_lineage_reference").alias("rule"), F.col("reference").alias("key"))


def network(nodes: DataFrame, claims: DataFrame, materializations: DataFrame, writes: DataFrame, states: tuple[str, ...] = DEFAULT_STATES, fields: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with the external ones, and edges (id, source, target, relation, state, document, role).

    claims(document, claim, definition, operation, target, state), materializations(document, materialization, definition,
    target, state), writes(document, unit, definition, target, state, source, role, line); fields are graph nodes that scope
    their objects. An ambiguous reference raises.
    """
    if not states or set(states) - set(STATES):
        raise ValueError("unknown lineage states")
    names = cut(resolved(references(claims, materializations, writes, states), nodes))
    bad = names.where("matches > 1").limit(1).collect()
    if bad:
        raise ValueError(f"the lineage reference is ambiguous: {bad[0].reference}")
    live = F.col("state").isin(*states)
    own = F.concat(F.lit("lineage:"), "document", F.lit(":"), "definition")

    def named(df: DataFrame, column: str) -> DataFrame:
        return df.join(names.select(F.col("reference").alias(column), F.col("node").alias(f"{column}_node")), column)

    part = lambda kind, key: F.concat(F.lit("lineage:"), "document", F.lit(f":{kind}:"), key)
    none = F.lit(None).cast("string")
    reads = named(claims.where(live & (F.col("operation") == "read")), "target").select(part("claim", "claim").alias("id"), F.col("target_node").alias("source"), own.alias("target"), F.lit("reads_from").alias("relation"), "state", "document", none.alias("role"))
    made = named(materializations.where(live), "target").select(part("materialization", "materialization"), own, "target_node", F.lit("materializes_as"), "state", "document", none)
    identity = F.concat_ws("\x1f", X.normalized_reference(F.col("source")), "role", F.col("line").cast("string"))
    derived = named(named(writes.where(live), "target"), "source").select(F.concat(part("write", "unit"), F.lit(":source:"), F.substring(F.sha2(identity, 256), 1, 16)), "source_node", "target_node", F.lit("derived_from"), "state", "document", "role")
    edges = reads.union(made).union(derived)
    if fields is not None:
        scope = fields.where("type = 'field' and parent_id is not null")
        graph = F.concat(F.lit("graph:"), "graph", F.lit(":"))
        edges = edges.union(scope.select(F.concat(graph, F.lit("field-scope:"), "id"), F.concat(graph, "parent_id"), F.concat(graph, "id"), F.lit("field_of"), F.lit("observed"), none, none))
    outside = names.where("matches = 0").groupBy("node").agg(F.min("reference").alias("reference"))
    extra = outside.select(F.col("node").alias("id"), "reference", F.col("reference").alias("name"), F.lit("unresolved").alias("kind"), F.lit("external").alias("source"), none.alias("description"), F.array("reference").alias("aliases"))
    return nodes.select(*_NODE).unionByName(extra), edges


@dataclass
class Trace:
    """What lies upstream of a node."""

    start: str
    hops: DataFrame
    origins: DataFrame
    warnings: DataFrame
    truncated: bool


def start_of(nodes: DataFrame, reference: str) -> str:
    """The one node that a reference names; none or several raise."""
    normal = X.normalized_reference(F.lit(reference))
    ids = [r.id for r in nodes.where(F.exists("aliases", lambda a: X.normalized_reference(a) == normal)).select("id").distinct().orderBy("id").limit(6).collect()]
    if len(ids) != 1:
        raise ValueError(f"the reference {reference} names {'no node' if not ids else 'several nodes: ' + ', '.join(ids[:5])}")
    return ids[0]


def trace_upstream(nodes: DataFrame, edges: DataFrame, reference: str, max_hops: int = 12) -> Trace:
    """Hops (id, depth, source, target, relation, state, cycle), origins (node) and warnings upstream of a reference.

    Every incoming edge of each node is a hop at the node's least depth + 1. A node's path is the first in the order of its
    ids among the shortest; an edge from a node of the path closes a cycle.
    """
    if not reference.strip() or not 1 <= max_hops <= 100:
        raise ValueError("a trace needs a reference and 1 to 100 hops")
    start = start_of(nodes, reference)
    spark, edges = nodes.sparkSession, cut(edges.select("id", "source", "target", "relation", "state"))
    front = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen, levels, truncated = front.select("node"), [], False
    for depth in range(1, max_hops + 2):
        step = edges.join(front.withColumnRenamed("node", "target"), "target")
        if depth > max_hops:
            truncated = not step.isEmpty()
            break
        step = cut(step.select("id", F.lit(depth).alias("depth"), "source", "target", "relation", "state", F.array_contains("path", F.col("source")).alias("cycle"), "path"))
        levels.append(step.drop("path"))
        near = step.groupBy(F.col("source").alias("node")).agg(F.min(F.concat("path", F.array("source"))).alias("path"))
        front = cut(near.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front.select("node")))
    hops = levels[0]
    for step in levels[1:]:
        hops = hops.union(step)
    reached = hops.select(F.col("source").alias("node")).union(spark.createDataFrame([(start,)], "node string")).distinct()
    origins = reached.join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
    return Trace(start, hops, origins, _warnings(hops, nodes, max_hops, truncated), truncated)


def _warnings(hops: DataFrame, nodes: DataFrame, max_hops: int, truncated: bool) -> DataFrame:
    one = hops.sparkSession.range(1)
    ends = hops.join(nodes.select(F.col("id").alias("source"), "reference", "kind"), "source")
    found = [
        hops.where("relation = 'field_of'").select(F.lit(WIDENS).alias("warning")),
        hops.where("state in ('draft', 'review_required')").select(F.lit(UNVALIDATED)),
        ends.where("kind = 'unresolved'").select(F.concat(F.lit("Unresolved upstream reference: "), "reference")),
        ends.where("cycle").select(F.concat(F.lit("Lineage cycle detected at: "), "reference")),
        one.join(hops.limit(1), how="left_anti").select(F.lit(NOTHING)),
    ]
    if truncated:
        found.append(one.select(F.lit(f"Trace stopped at the configured max_hops={max_hops} boundary.")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def lexical(nodes: DataFrame, query: str) -> DataFrame:
    """(id, rank_class, matched, place keys) of nodes by how a query names them, best first when ordered by `lexical_order`.

    0 exact, 1 last parts, 2 part of the name, 3 part of an alias, 4 shared terms.
    """
    needle = X.normalized_reference(F.lit(query))
    normal = F.transform("aliases", X.normalized_reference)
    name = X.normalized_reference(F.col("name"))
    rank = (
        F.when((needle == name) | F.array_contains(normal, needle), 0).when(F.exists(normal, lambda a: F.endswith(a, F.concat(F.lit("."), needle))), 1)
        .when(F.contains(name, needle), 2).when(F.exists(normal, lambda a: F.contains(a, needle)), 3).otherwise(4)
    )
    text = F.concat_ws(" ", "reference", "name", "kind", "description", F.array_join("aliases", " "))
    matched = F.size(F.array_intersect(F.array_distinct(X.bm25_tokens(F.lit(query))), X.bm25_tokens(text)))
    found = nodes.select("id", rank.alias("rank_class"), matched.alias("matched"), (~F.startswith("source", F.lit("lineage:"))).cast("int").alias("outside"), F.length(name).alias("size"), F.lower("reference").alias("ref"))
    return found.where("rank_class < 4 or matched > 0")


def lexical_order() -> list[Column]:
    return [F.col("rank_class"), F.desc("matched"), F.col("outside"), F.col("size"), F.col("ref"), F.col("id")]


def retrieval_documents(nodes: DataFrame) -> DataFrame:
    """(id, label, text) of every node for BM25 and vectors."""
    lines = [("Name", F.col("name")), ("Kind", F.col("kind")), ("Reference", F.col("reference")), ("Aliases", F.array_join("aliases", ", ")), ("Description", F.coalesce("description", F.lit("")))]
    return nodes.select("id", F.col("reference").alias("label"), F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines]).alias("text"))
