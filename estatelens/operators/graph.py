"""The typed property graph: building, validation, neighbours, upstream traces, layers and closures.

Recursion is a driver loop over frontier DataFrames: each step is a join of a checkpointed frontier with the
edges; how many steps there are follows the graph's depth, not its size.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.functions.text import node_id


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context has; on one machine alone a new one."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local($|\[)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def graph_nodes(objects: DataFrame, fields: DataFrame, catalog: str) -> DataFrame:
    """(id, type, label, parent_id) of a catalog's nodes: the catalog, namespaces, tables and views, fields."""
    c = F.lit(catalog)
    top = objects.sparkSession.range(1).select(node_id("catalog", c).alias("id"), F.lit("catalog").alias("type"), c.alias("label"), F.lit(None).cast("string").alias("parent_id"))
    spaces = objects.select("namespace").distinct().select(node_id("namespace", c, F.col("namespace")), F.lit("namespace"), "namespace", node_id("catalog", c))
    tables = objects.select(node_id("object", c, F.col("namespace"), F.col("object")), "kind", F.concat_ws(".", "namespace", "object"), node_id("namespace", c, F.col("namespace")))
    columns = fields.select(node_id("field", c, F.col("namespace"), F.col("object"), F.col("field")), F.lit("field"), "field", node_id("object", c, F.col("namespace"), F.col("object")))
    return top.union(spaces).union(tables).union(columns)


def graph_edges(nodes: DataFrame, objects: DataFrame, relationships: DataFrame, catalog: str) -> DataFrame:
    """(id, source_id, target_id, type): contains edges, foreign keys with known ends, and their field pairs."""
    c = F.lit(catalog)
    contains = nodes.where("parent_id is not null").select(F.concat(F.lit("contains:"), "parent_id", F.lit("->"), "id").alias("id"), F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("type"))
    known = objects.select(F.col("namespace").alias("to_namespace"), F.col("object").alias("to_object"))
    fk = relationships.join(objects.select("namespace", "object"), ["namespace", "object"], "left_semi").join(known, ["to_namespace", "to_object"], "left_semi")
    fk = fk.withColumn("fk", node_id("foreign_key", c, F.col("namespace"), F.col("object"), F.col("name")))
    whole = fk.select("fk", node_id("object", c, F.col("namespace"), F.col("object")), node_id("object", c, F.col("to_namespace"), F.col("to_object")), F.lit("foreign_key"))
    # lists of different lengths are refused by catalog_violations(); here what has no partner has no edge
    pairs = fk.select("*", F.posexplode(F.arrays_zip("from_fields", "to_fields")).alias("pos", "pair")).where("pair.from_fields is not null and pair.to_fields is not null")
    each = pairs.select(
        F.concat("fk", F.lit("/field/"), (F.col("pos") + 1).cast("string")), node_id("field", c, F.col("namespace"), F.col("object"), F.col("pair.from_fields")),
        node_id("field", c, F.col("to_namespace"), F.col("to_object"), F.col("pair.to_fields")), F.lit("foreign_key_field"),
    )
    return contains.union(whole).union(each)


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, key): repeated node ids and edges whose ends are not nodes."""
    repeated = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("node_id_unique").alias("rule"), F.col("id").alias("key"))
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("node"))
    lost = ends.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select(F.lit("edge_endpoint_known"), F.col("id")).distinct()
    return repeated.union(lost)


def catalog_violations(objects: DataFrame, fields: DataFrame, relationships: DataFrame) -> DataFrame:
    """(rule, key) of a catalog: unique objects, field names and positions, known kinds, keys that are fields, sound references."""
    name = F.concat_ws(".", "namespace", "object")

    def repeated(df: DataFrame, rule: str, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws(".", *[F.col(b).cast("string") for b in by]).alias("key"))

    keys = objects.where("primary_key <> ''").select("namespace", "object", F.explode(F.split("primary_key", ",")).alias("field"))
    flagged = fields.where("is_primary_key").select("namespace", "object", "field")
    rules = [
        repeated(objects, "object_unique", "namespace", "object"),
        repeated(fields, "field_unique", "namespace", "object", "field"),
        repeated(fields, "position_unique", "namespace", "object", "position"),
        repeated(relationships, "relationship_unique", "namespace", "object", "name"),
        objects.where("kind not in ('table', 'view')").select(F.lit("kind_known"), name),
        fields.where("position < 1").select(F.lit("position_positive"), F.concat_ws(".", "namespace", "object", "field")),
        keys.join(flagged, ["namespace", "object", "field"], "left_anti").select(F.lit("primary_key_flagged"), F.concat_ws(".", "namespace", "object", "field")),
        flagged.join(keys, ["namespace", "object", "field"], "left_anti").select(F.lit("primary_key_listed"), F.concat_ws(".", "namespace", "object", "field")),
        relationships.where("size(from_fields) <> size(to_fields)").select(F.lit("reference_fields_equal"), F.concat_ws(".", "namespace", "object", "name")),
        relationships.join(objects.select(F.col("namespace").alias("to_namespace"), F.col("object").alias("to_object")), ["to_namespace", "to_object"], "left_anti").select(F.lit("reference_target_known"), F.concat_ws(".", "namespace", "object", "name")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out


def one_hop(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(object) of start(object) and their neighbours over edges(source, target) in both directions."""
    both = edges.select("source", "target").union(edges.select("target", "source"))
    near = both.join(start.withColumnRenamed("object", "source"), "source").select(F.col("target").alias("object"))
    return start.select("object").union(near).distinct()


def trace_upstream(edges: DataFrame, start: str, max_hops: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hops (depth, source, target, relation, state), origins (node) and one row (truncated) upstream of a node.

    Nodes are names as they are; `network.trace_upstream` resolves references and warns. edges(source, target, relation, state). Every incoming edge of each node is recorded at the node's first depth + 1.
    """
    if not 1 <= max_hops <= 100:
        raise ValueError("a trace has 1 to 100 hops")
    spark = edges.sparkSession
    edges = cut(edges)
    front = spark.createDataFrame([(start,)], "node string")
    seen, hops, depth = front, None, 0
    while depth < max_hops:
        step = edges.join(front.withColumnRenamed("node", "target"), "target").withColumn("depth", F.lit(depth + 1))
        step = cut(step.select("depth", "source", "target", "relation", "state"))
        hops = step if hops is None else hops.unionByName(step)
        nxt = cut(step.select(F.col("source").alias("node")).distinct().join(seen, "node", "left_anti"))
        if nxt.isEmpty():
            front = nxt
            break
        seen, front, depth = cut(seen.unionByName(nxt)), nxt, depth + 1
    incoming = edges.select(F.col("target").alias("node")).distinct()
    origins = seen.join(incoming, "node", "left_anti")
    cut_off = front.join(incoming, "node", "left_semi").limit(1).agg((F.count("*") > 0).alias("truncated"))
    return hops, origins, cut_off


def topological_layers(steps: DataFrame) -> DataFrame:
    """(step, layer, place) of steps(step, position, depends_on): layers peel off what has no open dependency.

    Raises on a cycle. Within a layer the given positions decide.
    """
    need = cut(steps.select("step", F.explode("depends_on").alias("dep")))
    left, done, layer = cut(steps.select("step", "position")), None, 0
    while not left.isEmpty():
        ready = cut(left.join(need, "step", "left_anti").withColumn("layer", F.lit(layer)))
        if ready.isEmpty():
            raise ValueError("the dependencies contain a cycle")
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready, "step", "left_anti"))
        need = cut(need.join(ready.select(F.col("step").alias("dep")), "dep", "left_anti"))
        layer += 1
    if done is None:
        return steps.select("step", F.lit(0).alias("layer"), F.lit(0).alias("place")).limit(0)
    place = F.row_number().over(Window.orderBy("layer", "position", "step"))
    return done.select("step", "layer", place.alias("place"))


def closure(events: DataFrame, call_id: str) -> tuple[DataFrame, DataFrame]:
    """Calls that a successful call depends on (call_id, itself included) and the physical inputs of sql and mongo calls."""
    end = events.where(F.col("call_id") == call_id).select("status").first()
    if end is None or end.status != "succeeded":
        raise ValueError("only a successful call can be traced")
    uses = cut(events.select("call_id", F.explode("consumes").alias("used")))
    front = events.sparkSession.createDataFrame([(call_id,)], "call_id string")
    seen = front
    while True:
        nxt = cut(uses.join(front, "call_id").select(F.col("used").alias("call_id")).distinct().join(seen, "call_id", "left_anti"))
        if nxt.isEmpty():
            break
        seen, front = cut(seen.unionByName(nxt)), nxt
    inputs = events.where("kind in ('sql', 'mongo')").join(seen, "call_id", "left_semi").select(F.explode("inputs").alias("node")).distinct()
    return seen, inputs


def closures(events: DataFrame) -> DataFrame:
    """(log, call_id, used) of every successful call of events(log, call_id, status, consumes): itself and all that it depends on.

    Paths double in length each round, so that a chain of n calls takes log2(n) rounds. What a log doesn't hold is not followed.
    """
    known = events.select("log", F.col("call_id").alias("used")).distinct()
    uses = events.select("log", "call_id", F.explode("consumes").alias("used")).distinct().join(known, ["log", "used"], "left_semi")
    pairs = cut(uses.select("log", "call_id", "used"))
    n = pairs.count()
    while True:
        further = pairs.alias("a").join(pairs.alias("b"), F.expr("a.log = b.log and a.used = b.call_id")).select("a.log", "a.call_id", "b.used")
        pairs = cut(pairs.unionByName(further).distinct())
        before, n = n, pairs.count()
        if n == before:
            break
    good = events.where("status = 'succeeded'").select("log", "call_id").distinct()
    return good.withColumn("used", F.col("call_id")).unionByName(pairs.join(good, ["log", "call_id"], "left_semi")).distinct()


def closure_inputs(events: DataFrame, closed: DataFrame) -> DataFrame:
    """(log, call_id, node): the physical inputs that the sql and mongo calls of each closure of closures(events) read."""
    read = events.where("kind in ('sql', 'mongo')").select("log", F.col("call_id").alias("used"), F.explode("inputs").alias("node"))
    return closed.join(read, ["log", "used"]).select("log", "call_id", "node").distinct()


def runtime_violations(events: DataFrame) -> DataFrame:
    """(rule, key): sequences 1..n, unique calls, and only earlier successful calls consumed."""
    # n numbers are 1..n exactly if all lie there and none comes twice
    total = events.agg(F.count("*").alias("n"))
    twice = events.groupBy("sequence").agg(F.count("*").alias("m")).where("m > 1")
    outside = events.crossJoin(F.broadcast(total)).where("sequence is null or sequence not between 1 and n").select("call_id", "sequence")
    place = outside.union(events.join(twice, "sequence", "left_semi").select("call_id", "sequence")).distinct()
    repeated = events.groupBy("call_id").agg(F.count("*").alias("n")).where("n > 1")
    uses = events.select("call_id", "sequence", F.explode("consumes").alias("used"))
    given = events.groupBy(F.col("call_id").alias("used")).agg(F.min("sequence").alias("at"), F.max(F.when(F.col("status") == "succeeded", 1).otherwise(0)).alias("ok"))
    met = uses.join(given, "used", "left")
    bad = met.select("*", F.when(F.col("at").isNull(), "consumes_unknown").when(F.col("at") >= F.col("sequence"), "consumes_later").when(F.col("ok") == 0, "consumes_failed").alias("rule")).where("rule is not null")
    return (
        place.select(F.lit("sequence_contiguous").alias("rule"), F.concat_ws(":", "call_id", F.coalesce(F.col("sequence").cast("string"), F.lit("?"))).alias("key"))
        .union(repeated.select(F.lit("call_unique"), "call_id"))
        .union(bad.select("rule", F.concat_ws(">", "call_id", "used")))
    )
