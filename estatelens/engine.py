"""A facade over one session and one state folder: groups of operations whose tables are kept below the root.

Every group reads and writes named tables; what a step refuses is raised, what it reports is returned. Stores are folders of
Parquet; logs and reports are written once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import drift, graph, lineage, network, profile, refresh, relationships, retrieval, review, scopes, search, semantics, workspaces
from .operators.network import DEFAULT_STATES
from .plans import context
from .sources import catalogs, demo, semantic, sqlite

#: Fixed pattern: names of graphs, sources and imports.
NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def _refuse(violations: DataFrame, what: str) -> None:
    bad = violations.limit(1).collect()
    if bad:
        raise ValueError(f"{what} breaks {bad[0].rule}: {bad[0].key}")


class _Group:
    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark


class Sources(_Group):
    """Registered sources: a graph's connector, its configuration by reference, what may be read, and probes of what it holds."""

    CONNECTORS = ("parquet", "sqlite", "sqlserver", "tables")

    def configure(self, name: str, connector: str, config: str, graph_name: str, permissions: tuple[str, ...] = ("aggregates",)) -> None:
        """config is env:NAME or state:NAME, never an address; permissions are of aggregates and raw_samples."""
        if not re.fullmatch(NAME, name) or connector not in self.CONNECTORS or set(permissions) - {"aggregates", "raw_samples"}:
            raise ValueError("the source's name, connector or permissions are not known")
        if config.partition(":")[0] not in ("env", "state") or not config.partition(":")[2]:
            raise ValueError("a configuration is env:NAME or state:NAME")
        self.engine.save("sources", name, self.spark.createDataFrame([(name, connector, config, graph_name, list(permissions))], "name string, connector string, config string, graph string, permissions array<string>"))

    def load(self, name: str) -> dict:
        return self.engine.load("sources", name).first().asDict()

    def list(self) -> list[str]:
        return self.engine.list("sources")

    def check(self, name: str) -> dict:
        """Whether the connector's packages are there and the reference resolves."""
        import importlib.util
        import os

        s = self.load(name)
        kind, _, key = s["config"].partition(":")
        configured = key in os.environ if kind == "env" else self.engine.exists("config", key)
        return {"available": s["connector"] != "sqlserver" or importlib.util.find_spec("pyspark") is not None, "configured": configured}

    def for_graph(self, graph_name: str, name: str | None = None) -> dict:
        """The one source of a graph, or the named one."""
        found = [s for s in map(self.load, self.list()) if s["graph"] == graph_name and name in (None, s["name"])]
        if len(found) != 1:
            raise ValueError(f"{len(found)} sources for the graph {graph_name}")
        return found[0]

    def discover_sqlite(self, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return sqlite.harvest(self.spark, path)

    def discover_files(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
        return catalogs.from_files(self.spark, tables, keys)

    def demo(self, path: str, version: int = 1, force: bool = False) -> None:
        demo.write(self.spark, path, version, force)

    def enrich(self, name: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
        """Profiles, samples and key patterns of a source's tables, as far as it permits; a table that fails is named, the others go on."""
        allowed = set(self.load(name)["permissions"])
        if "aggregates" not in allowed:
            raise ValueError("the source permits no aggregates")
        profiles, failed, texts = None, [], None
        for table, df in tables.items():
            try:
                columns = [f.name for f in df.schema.fields if profile.supported(f.dataType)]
                p = profile.profile_columns(df, columns).select(F.lit(table).alias("object"), "column_name", "non_null", "null_count", "distinct_count", F.col("min_value").cast("string").alias("min_value"), F.col("max_value").cast("string").alias("max_value"))
                profiles = p if profiles is None else profiles.union(p)
                if "raw_samples" in allowed:
                    for c in [f.name for f in df.schema.fields if profile.textual(f.dataType)]:
                        v = df.select(F.lit(table).alias("object"), F.lit(c).alias("field"), F.col(c).alias("value"))
                        texts = v if texts is None else texts.union(v)
            except Exception as e:  # one table's failure is reported, not raised
                failed.append((table, type(e).__name__))
        out = {"profiles": profiles, "failed": self.spark.createDataFrame(failed, "object string, error string")}
        if texts is not None:
            out["patterns"] = relationships.dominant_patterns(texts)
        return out


class Graphs(_Group):
    """Catalogs as graphs: import, build, refresh with reports."""

    TABLES = ("objects", "fields", "relationships")

    def build(self, name: str, objects: DataFrame, fields: DataFrame, rels: DataFrame, replace: bool = True) -> None:
        _refuse(graph.catalog_violations(objects, fields, rels), "the catalog")
        for kind, df in zip(self.TABLES, (objects, fields, rels), strict=True):
            self.engine.save(f"graphs/{name}", kind, df, create_only=not replace)

    def import_catalog(self, name: str, objects: DataFrame, fields: DataFrame, rels: DataFrame) -> None:
        """As build, but a graph that is there is never overwritten."""
        self.build(name, objects, fields, rels, replace=False)

    def load(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.engine.load(f"graphs/{name}", k) for k in self.TABLES)

    def list(self) -> list[str]:
        return self.engine.list("graphs")

    def revision(self, name: str) -> str:
        return search.revision(*self.load(name))

    def refresh(self, name: str, objects: DataFrame, fields: DataFrame, rels: DataFrame, annotations: DataFrame, candidates: DataFrame) -> refresh.Refresh:
        """Carry reviews to a new catalog; the report is written once under the revisions before and after."""
        before = self.revision(name)
        found = refresh.refresh_graph(self.load(name), (objects, fields, rels), annotations, candidates)
        kept = {k: graph.cut(v) for k, v in found.carried.items()}
        out = refresh.Refresh(kept, graph.cut(found.stale), graph.cut(found.changes), graph.cut(found.counts))
        after = search.revision(objects, fields, rels)
        if before != after:
            report = f"changes/{name}/{before[:12]}-{after[:12]}"
            for k in ("stale", "changes", "counts"):
                self.engine.save(report, k, getattr(out, k), create_only=True)
            self.build(name, graph.cut(objects), graph.cut(fields), graph.cut(rels))
        return out


class Semantics(_Group):
    """Semantic imports: read, bind, edit."""

    def import_files(self, name: str, format_name: str, path: str, graph_name: str) -> dict[str, int]:
        """Read a file or folder, bind it to a graph and keep its tables; gives the number of rows of each."""
        read = semantic.read_import(name, format_name, semantic.read_bundle(path))
        tables = read.tables(self.spark)
        bound, notes = semantics.bind(tables, *self.engine.graphs.load(graph_name), graph_name)
        tables |= {"bindings": bound, "diagnostics": notes, "source": self.spark.createDataFrame([(name, format_name, read.version, read.sha256, graph_name)], "name string, format string, version string, sha256 string, graph string")}
        for k, df in tables.items():
            self.engine.save(f"semantics/{name}", k, df)
        return {k: self.engine.load(f"semantics/{name}", k).count() for k in tables}

    def load(self, name: str) -> dict[str, DataFrame]:
        return {k: self.engine.load(f"semantics/{name}", k) for k in [*semantic.SCHEMAS, "bindings", "source"]}

    def list(self, graph_name: str | None = None) -> list[str]:
        names = self.engine.list("semantics")
        return [n for n in names if graph_name in (None, self.engine.load(f"semantics/{n}", "source").first().graph)]

    def edit(self, name: str, target: str, description: str | None, reason: str) -> None:
        """An edit over the import; the last one of a target holds, the source stays."""
        parts = semantics.targets(self.load(name))
        if not reason.strip() or parts.where(F.col("id") == target).isEmpty():
            raise ValueError("an edit needs a known target and a reason")
        n = self.engine.load(f"semantics/{name}", "edits").count() if self.engine.exists(f"semantics/{name}", "edits") else 0
        self.engine.append(f"semantics/{name}", "edits", self.spark.createDataFrame([(n + 1, target, description, reason.strip())], "edit long, id string, description string, reason string"))

    def targets(self, name: str) -> DataFrame:
        parts = semantics.targets(self.load(name))
        if not self.engine.exists(f"semantics/{name}", "edits"):
            return parts.select("*", F.col("description").alias("original"), F.lit(0).cast("long").alias("edits"))
        return semantics.effective(parts, self.engine.load(f"semantics/{name}", "edits"))


class Workspaces(_Group):
    """Systems, areas, zones and joins across graphs."""

    TABLES = {"systems": "system string, graph string", "areas": "system string, area string, graph string, namespace string", "zones": "system string, zone string, graph string, object_id string"}

    def create(self, name: str) -> None:
        for t, s in self.TABLES.items():
            self.engine.save(f"workspaces/{name}", t, self.spark.createDataFrame([], s), create_only=True)

    def load(self, name: str) -> dict[str, DataFrame]:
        return {t: self.engine.load(f"workspaces/{name}", t) for t in self.TABLES}

    def define(self, name: str, kind: str, rows: DataFrame, objects: DataFrame) -> None:
        out = workspaces.define(kind, self.load(name), rows, objects)
        self.engine.save(f"workspaces/{name}", kind, graph.cut(out[kind]))

    def scope(self, name: str, objects: DataFrame, selectors: list[tuple[str, str]] = ()) -> DataFrame:
        return workspaces.resolve_scope(self.load(name), objects, self.spark.createDataFrame(list(selectors), "kind string, name string"))

    def zone(self, name: str, objects: DataFrame, system: str, zone: str) -> DataFrame:
        return workspaces.resolve_zone(self.load(name), objects, system, zone)


class Searches(_Group):
    """One search over a graph in four modes, and over the graphs of a scope."""

    def graph(self, name: str, query: str, limit: int = 20, mode: str = "lexical", docs: DataFrame | None = None, namespace: str | None = None) -> DataFrame:
        if mode not in search.MODES:
            raise ValueError(f"unknown mode: {mode}")
        if mode == "lexical":
            o, f, _ = self.engine.graphs.load(name)
            o = o if namespace is None else o.where(F.lower("namespace") == namespace.lower())
            f = f if namespace is None else f.where(F.lower("namespace") == namespace.lower())
            return retrieval.lexical_search(o.select("object", F.col("object").alias("name"), F.col("description").alias("technical_description")), f.select("object", F.col("field").alias("name")), query, limit)
        indexed = self.engine.index(name).load() if docs is None or mode != "bm25" else docs
        return search.search(indexed, query, mode, limit, namespace)

    def workspace(self, scope: DataFrame, query: str, limit: int = 20, mode: str = "lexical") -> DataFrame:
        """The best hits of a scope(graph, object_id) over all its graphs in one pass; what is out of scope leaves before anything is ranked."""
        names = [r.graph for r in scope.select("graph").distinct().orderBy("graph").collect()]  # what a workspace names
        if not names:
            raise ValueError("the scope has no graphs")

        def every(load) -> DataFrame:
            return reduce(DataFrame.unionByName, [load(n).withColumn("graph", F.lit(n)) for n in names])

        if mode == "lexical":
            objects = every(lambda n: self.engine.graphs.load(n)[0].select(F.col("object").alias("object_id"), F.col("object").alias("label"), F.col("object").alias("name"), F.col("description").alias("technical_description")))
            fields = every(lambda n: self.engine.graphs.load(n)[1].select(F.col("object").alias("object_id"), F.col("field").alias("name")))
            return search.workspace_lexical(objects, fields, scope, query, limit)
        return search.workspace_search(every(lambda n: self.engine.index(n).load()), scope, query, limit, mode)


class Contexts(_Group):
    """Context packets of a graph: by question, or as a prefix for all questions."""

    #: Joins of one object that an expansion looks at: those to other hits first, foreign keys before candidates, by object and id.
    JOINS = 1000

    def _edges(self, name: str, candidates: DataFrame | None) -> DataFrame:
        """Foreign keys of a graph and validated candidates(id, source, target, from_fields, to_fields, state, origin) in one shape."""
        rels = self.engine.graphs.load(name)[2]
        edges = rels.select(F.col("name").alias("id"), F.lit("foreign_key").alias("type"), F.col("object").alias("source"), F.col("to_object").alias("target"), "from_fields", "to_fields", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("origin"))
        if candidates is None:
            return edges
        return edges.unionByName(candidates.where("state = 'validated'").select("id", F.lit("relationship_candidate").alias("type"), "source", "target", "from_fields", "to_fields", "state", "origin"))

    def _joins(self, name: str, around: list[str], hops: int, candidates: DataFrame | None = None) -> tuple[list[dict], int]:
        """The joins within some hops of the objects around, JOINS at each object at most, and how many more there are."""
        edges = graph.cut(self._edges(name, candidates))
        ends = edges.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("at"))
        other = F.when(F.col("source") == F.col("at"), F.col("target")).otherwise(F.col("source"))
        place = F.row_number().over(Window.partitionBy("at").orderBy(~other.isin(*around), F.col("type") != "foreign_key", other, "id"))
        ends = graph.cut(ends.withColumn("other", other).withColumn("place", place))
        seen, front, found, more = set(around), list(around), {}, 0
        for _ in range(hops):
            if not front:
                break
            near = ends.join(F.broadcast(self.spark.createDataFrame([(x,) for x in front], "at string")), "at")
            for r in near.where(F.col("place") <= self.JOINS).collect():
                found[r.id, r.type] = r
            more += near.where(F.col("place") > self.JOINS).count()
            front = sorted({x for r in found.values() for x in (r["at"], r.other)} - seen)
            seen |= set(front)
        rows = [found[k].asDict() for k in sorted(found)]
        return [j for j in map(context.joined, rows) if j is not None], more

    def _joins_between(self, name: str, objects: list[str], candidates: DataFrame | None = None) -> list[dict]:
        among = F.col("source").isin(*objects) & F.col("target").isin(*objects)
        rows = self._edges(name, candidates).where(among).orderBy("type", "id").collect()  # between PREFIX objects
        return [j for j in (context.joined(r.asDict()) for r in rows) if j is not None]

    def _with_fields(self, name: str, packet: context.Packet, most: int) -> None:
        chosen = [o["object"] for o in packet.objects]
        fields = self.engine.graphs.load(name)[1]
        none = self.spark.createDataFrame([], "object string, field string, score int")
        top = scopes.context_fields(fields.where(F.col("object").isin(*chosen)), none, most).orderBy("object", "place").collect()
        for o in packet.objects:
            o["fields"] = [r.field for r in top if r.object == o["object"]]

    def graph(self, name: str, query: str, characters: int = 24_000, candidates: DataFrame | None = None, **budgets: int) -> context.Packet:
        """A packet around the best hits, over foreign keys and validated candidates; what is left out is counted in it."""
        hits = self.engine.search(name, query, 50).collect()  # 50 rows at most
        joins, more = self._joins(name, [r.object for r in hits], budgets.get("hops", 2), candidates)
        packet = context.expand({r.object: float(r.score) for r in hits}, joins, **budgets)
        packet.omitted["joins"] += more
        self._with_fields(name, packet, 12)
        return context.fit(packet, characters)

    def prefix(self, name: str, characters: int = 500_000, namespace: str | None = None) -> context.Packet:
        o = self.engine.graphs.load(name)[0]
        o = o if namespace is None else o.where(F.lower("namespace") == namespace.lower())
        rows = o.select("object").orderBy(F.lower("object"), "object").limit(context.PREFIX["objects"] + 1).collect()
        packet = context.prefix([{"fields": [], "object": r.object} for r in rows], self._joins_between(name, [r.object for r in rows]))
        self._with_fields(name, packet, context.PREFIX["fields"])
        return context.fit(packet, characters)

    def split(self, name: str, packet: context.Packet, query: str = "") -> context.Parts:
        return context.split(packet, name, self.engine.graphs.revision(name), query)

    def diff(self, left: DataFrame, right: DataFrame) -> DataFrame:
        side = lambda df, s: df.withColumn("side", F.lit(s))
        return drift.packet_diff(side(left, "left").unionByName(side(right, "right")))

    def impact(self, packet: DataFrame, changes: DataFrame) -> DataFrame:
        return drift.packet_impact(packet, changes.select(F.col("reference").alias("id")))


class Lineages(_Group):
    """Static lineage: documents, reviews, tasks, views and traces."""

    TABLES = ("definitions", "steps", "claims", "units", "materializations")

    def save(self, name: str, **tables: DataFrame) -> None:
        for k, df in tables.items():
            if k not in self.TABLES:
                raise ValueError(f"unknown lineage table: {k}")
            self.engine.save(f"lineage/{name}", k, df)

    def load(self, name: str) -> dict[str, DataFrame]:
        return {k: self.engine.load(f"lineage/{name}", k) for k in self.TABLES if self.engine.exists(f"lineage/{name}", k)}

    def list(self) -> list[str]:
        return self.engine.list("lineage")

    def network(self, name: str, states: tuple[str, ...] = DEFAULT_STATES) -> tuple[DataFrame, DataFrame]:
        t = self.load(name)
        return network.network(network.definition_nodes(t["definitions"]), t["claims"], t["materializations"], t["units"], states)

    def upstream(self, name: str, reference: str, max_hops: int = 12, states: tuple[str, ...] = DEFAULT_STATES) -> network.Trace:
        return network.trace_upstream(*self.network(name, states), reference, max_hops)

    def find(self, name: str, query: str, limit: int = 20) -> DataFrame:
        return network.lexical(self.network(name)[0], query).orderBy(*network.lexical_order()).limit(limit).select("id", "rank_class", "matched")

    def reviews(self, name: str, states: tuple[str, ...] | None = None) -> DataFrame:
        t = self.load(name)
        return review.lineage_items(t["claims"], t["materializations"], t["units"], states)

    def decide(self, name: str, table: str, key: str, decisions: DataFrame) -> None:
        """Apply decisions to one table of items; unsound ones raise and nothing is written."""
        items = self.load(name)[table]
        shaped = items.withColumn("id", F.col(key))
        shaped = shaped if "reviews" in items.columns else shaped.withColumn("reviews", F.array().cast(review.REVIEWS))
        _refuse(review.decision_violations(shaped, decisions, review.LINEAGE), "a decision")
        self.engine.save(f"lineage/{name}", table, graph.cut(review.decide(shaped, decisions, review.LINEAGE).drop("id")))

    def process(self, name: str) -> DataFrame:
        t = self.load(name)
        steps = t["steps"].groupBy("step").agg(F.min("definition").alias("definition"), F.min("position").alias("position"), F.collect_set("dependency").alias("depends_on"))
        return lineage.process_view(t["definitions"], steps, t["claims"])

    def import_runtime(self, name: str, events: DataFrame) -> None:
        """Keep a log of events, once; a log that breaks a rule is refused."""
        _refuse(graph.runtime_violations(events), "the log")
        self.engine.save("runtime", name, events, create_only=True)

    def trace_runtime(self, name: str, call_id: str) -> tuple[DataFrame, DataFrame]:
        return graph.closure(self.engine.load("runtime", name), call_id)


class Focuses(_Group):
    """Snapshots of traces, valid while their sources stay the same."""

    def build(self, name: str, trace: network.Trace, sources: DataFrame) -> DataFrame:
        members = workspaces.focus(trace.hops, trace.origins, trace.start)
        _refuse(workspaces.focus_violations(members, trace.hops), "the focus")
        self.engine.save(f"focus/{name}", "members", members)
        self.engine.save(f"focus/{name}", "sources", sources)
        return self.load(name)

    def load(self, name: str, current: DataFrame | None = None) -> DataFrame:
        """The members; with the current sources(kind, name, revision), a stale focus raises."""
        if current is not None:
            stale = workspaces.stale_sources(self.engine.load(f"focus/{name}", "sources"), current).limit(1).collect()
            if stale:
                raise ValueError(f"the focus {name} is stale: {stale[0].kind}:{stale[0].name} {stale[0].problem}")
        return self.engine.load(f"focus/{name}", "members")

    def list(self) -> list[str]:
        return self.engine.list("focus")


class Annotations(_Group):
    """Descriptions of nodes: planned, proposed, edited and decided."""

    plan, tasks, reviews = staticmethod(review.plan_tasks), staticmethod(review.tasks), staticmethod(review.annotation_reviews)
    apply, decide, edit = staticmethod(review.apply_proposals), staticmethod(review.decide_annotations), staticmethod(review.edit_annotations)


class Relationships(_Group):
    """Joins: discovered, added by people, checked and decided."""

    pairs, best, add, decide = staticmethod(relationships.candidate_pairs), staticmethod(relationships.best_candidates), staticmethod(review.new_relationships), staticmethod(review.decide_relationships)

    def discover(self, fields: DataFrame, existing: DataFrame, tables: dict[str, DataFrame], source: str, most: int = 20) -> DataFrame:
        """Candidate pairs of a source object, probed in one pass, and the best of each field."""
        pairs = [tuple(r)[:4] for r in relationships.candidate_pairs(fields, existing, source, most).collect()]
        found = profile.probe_all({t: tables[t] for p in pairs for t in (p[0], p[2])}, pairs)
        return relationships.best_candidates(found.withColumnRenamed("source_field", "from_field").withColumnRenamed("target_field", "to_field"))

    def check(self, tables: dict[str, DataFrame], pair: tuple[str, str, str, str]) -> DataFrame:
        return profile.probe_pair(tables[pair[0]], pair[1], tables[pair[2]], pair[3])


class Knowledge(_Group):
    """Documents that speak about systems, graphs, schemas and objects."""

    def add(self, doc_id: str, scope: str, path: str, workspace: str | None = None, state: str = "draft") -> None:
        s = self.spark.range(1).select(workspaces.parse_scope(F.lit(scope)).alias("s")).first().s
        if s is None or not re.fullmatch(NAME, doc_id) or state not in ("draft", "validated"):
            raise ValueError("the document's name, scope or state is not known")
        row = workspaces.read_document(self.spark, path).select(F.lit(doc_id).alias("id"), F.lit(s.kind).alias("kind"), F.lit(s.reference).alias("reference"), F.lit(s.graph).cast("string").alias("graph"), F.lit(workspace).cast("string").alias("workspace"), F.lit(state).alias("state"), "content", "revision")
        self.engine.save("knowledge", doc_id, row)

    def list(self) -> list[str]:
        return self.engine.list("knowledge")

    def documents(self) -> DataFrame:
        out = None
        for n in self.list():
            one = self.engine.load("knowledge", n)
            out = one if out is None else out.unionByName(one)
        return out

    def resolve(self, nodes: DataFrame, systems: DataFrame, workspace: str, graph_name: str, node: str, most: int = 24_000, **how) -> tuple[DataFrame, DataFrame]:
        docs, here = self.documents(), nodes.where((F.col("graph") == graph_name) & (F.col("id") == node))
        return workspaces.resolve_knowledge(docs, workspaces.applies(docs, here, systems, workspace), graph_name, node, most, **how)


class Entities(_Group):
    """Entity-resolution candidates, bound to a revision."""

    find, decide, edges, merge = staticmethod(scopes.find_candidates), staticmethod(review.review_entities), staticmethod(review.entity_edges), staticmethod(review.import_entities)


class Engine:
    """Stores tables below `root` as Parquet and runs the operators on them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.sources, self.graphs, self.semantics, self.workspaces = Sources(self), Graphs(self), Semantics(self), Workspaces(self)
        self.searches, self.contexts, self.lineages, self.focuses = Searches(self), Contexts(self), Lineages(self), Focuses(self)
        self.annotations, self.relationships, self.knowledge, self.entities = Annotations(self), Relationships(self), Knowledge(self), Entities(self)

    # stores

    def save(self, kind: str, name: str, df: DataFrame, create_only: bool = False) -> None:
        """Write a table; create_only refuses to replace one, as logs and reports need."""
        df.write.mode("errorifexists" if create_only else "overwrite").parquet(f"{self.root}/{kind}/{name}")

    def append(self, kind: str, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.root}/{kind}/{name}")

    def load(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}/{name}")

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, kind: str, name: str) -> bool:
        files, path = self._folder(f"{self.root}/{kind}/{name}")
        return files.exists(path)

    def list(self, kind: str) -> list[str]:
        files, path = self._folder(f"{self.root}/{kind}")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def index(self, name: str) -> search.Index:
        return search.Index(self.spark, f"{self.root}/index/{name}")

    # the shortest ways

    def build_graph(self, name: str, objects: DataFrame, fields: DataFrame, rels: DataFrame) -> None:
        self.graphs.build(name, objects, fields, rels)

    def nodes(self, name: str) -> DataFrame:
        o, f, _ = self.graphs.load(name)
        return graph.graph_nodes(o, f, name)

    def changes(self, before: str, after: str) -> DataFrame:
        return drift.schema_changes(self.graphs.load(before), self.graphs.load(after))

    def search(self, name: str, query: str, limit: int = 20) -> DataFrame:
        return self.searches.graph(name, query, limit)

    def context(self, name: str, query: str, characters: int = 24_000, **budgets: int) -> context.Packet:
        return self.contexts.graph(name, query, characters, **budgets)

    def grounding(self, name: str, query: str, lineage_name: str | None = None, reference: str | None = None) -> tuple[str, str]:
        """Two texts: what the graph gives to every question, and what this question adds, with matches and a trace if asked."""
        parts = self.contexts.split(name, self.context(name, query), query)
        stable, dynamic = context.verified(parts.stable), context.verified(parts.dynamic)
        sources = [self.sources.load(s) for s in self.sources.list()]
        shown = [{"graph": s["graph"], "source": s["name"], "objects": [o["object"] for o in stable["stable"]["objects"]]} for s in sources if s["graph"] == name] or [{"graph": name}]
        matches, trace = [], None
        if lineage_name:
            matches = [r.id for r in self.lineages.find(lineage_name, query, 5).collect()]
            if reference:
                t = self.lineages.upstream(lineage_name, reference)
                hops = t.hops.orderBy("depth", "target", "source", "relation", "id").limit(1001).collect()
                origins = [r.node for r in t.origins.orderBy("node").limit(101).collect()]
                warnings = [r.warning for r in t.warnings.orderBy("warning").limit(101).collect()]
                shown_of = ((hops, 1000, "hops"), (origins, 100, "origins"), (warnings, 100, "warnings"))
                left_out = [f"Only the first {most} {what} are shown." for rows, most, what in shown_of if len(rows) > most]
                trace = {"origins": origins[:100], "hops": [h.asDict() for h in hops[:1000]], "warnings": warnings[:100] + left_out}
        return context.stable_prompt(stable, shown), context.dynamic_prompt(dynamic, matches, trace)
