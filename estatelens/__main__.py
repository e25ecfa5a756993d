"""Commands over one state folder: python -m estatelens --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="estatelens")
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), [c.add_argument(a) for a in args]][0]
    add("demo", "path").add_argument("--version", type=int, default=1)
    add("graphs")
    add("build-sqlite", "graph", "path")
    s = add("search", "graph", "query")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--mode", default="lexical")
    add("context", "graph", "query").add_argument("--characters", type=int, default=24_000)
    add("prefix", "graph")
    add("ground", "graph", "query")
    add("changes", "before", "after")
    add("upstream", "lineage", "reference").add_argument("--hops", type=int, default=12)
    add("find", "lineage", "query")
    add("reviews", "lineage")
    return p


def run(engine: Engine, a: argparse.Namespace) -> str:
    """What a command prints: JSON, one line a row."""
    rows = lambda df: "\n".join(df.toJSON().collect())
    match a.command:
        case "demo":
            engine.sources.demo(a.path, a.version)
            return json.dumps({"path": a.path})
        case "graphs":
            return json.dumps(engine.graphs.list())
        case "build-sqlite":
            engine.graphs.build(a.graph, *engine.sources.discover_sqlite(a.path))
            return json.dumps({"graph": a.graph, "revision": engine.graphs.revision(a.graph)})
        case "search":
            return rows(engine.searches.graph(a.graph, a.query, a.limit, a.mode))
        case "context":
            return json.dumps(engine.context(a.graph, a.query, a.characters).body())
        case "prefix":
            return json.dumps(engine.contexts.prefix(a.graph).body())
        case "ground":
            return "\n".join(engine.grounding(a.graph, a.query))
        case "changes":
            return rows(engine.changes(a.before, a.after))
        case "upstream":
            return rows(engine.lineages.upstream(a.lineage, a.reference, a.hops).hops)
        case "find":
            return rows(engine.lineages.find(a.lineage, a.query))
        case _:
            return rows(engine.lineages.reviews(a.lineage))


if __name__ == "__main__":
    arguments = parser().parse_args()
    print(run(Engine(SparkSession.builder.getOrCreate(), arguments.root), arguments))
