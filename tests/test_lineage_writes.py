"""The script lexer, proposals for writes, and closures of all calls, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import graph, proposals, scripts


def plain_mask(source):
    """Character by character."""
    out, i, until = [], 0, None
    while i < len(source):
        two = source[i : i + 2]
        if until is None and (two in ("--", "/*") or source[i] == "'"):
            until = {"--": "\n", "/*": "*/"}.get(two, "'")
            n = 2 if two in ("--", "/*") else 1
            out.append(" " * n)
            i += n
        elif until is None:
            out.append(source[i])
            i += 1
        elif source.startswith(until, i) and not (until == "'" and two == "''"):
            out.append("\n" if until == "\n" else " " * len(until))
            i += len(until)
            until = None
        else:
            n = 2 if until == "'" and two == "''" else 1
            out.append("".join("\n" if c == "\n" else " " for c in source[i : i + n]))
            i += n
    return "".join(out)


def test_masking_equals_the_plain_version(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["'", "''", "--", "-", "/*", "*/", "*", "/", "\n", "a", " b", "é", "insert", ";", "\t"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["a -- 'x\nb /* ' \n */ c 'it''s -- no' d", "", "/*" + "x" * 300_000, "'" * 100_001, "''x" * 100_000, "- - /", "/**/a", "'a\n'b", "--"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scripts.masked(F.col("t")).alias("m")).collect()
    assert {r.i: r.m for r in got} == {i: plain_mask(t) for i, t in enumerate(texts)}


def test_write_markers(spark):
    rows = [("a", "-- INSERT INTO no\nINSERT INTO dw.t\nSELECT 'DELETE FROM x'\nFROM s"), ("b", "/* UPDATE x\n set */ UPDATE dw.u SET a = 1;\n  delete from dw.v\n\tSELECT a INTO #t FROM x\nINTO @y"), ("c", None), ("d", "MERGE dw.x\ntruncate table y\nupdated\nselect a; insert into x"), ("e", "")]
    df = spark.createDataFrame(rows, "definition string, content string")
    got = {(r.definition, r.line, r.operation, r.text) for r in scripts.write_markers(df).collect()}
    assert got == {("a", 2, "insert", "INSERT INTO dw.t"), ("b", 2, "update", "set */ UPDATE dw.u SET a = 1;"), ("b", 3, "delete", "delete from dw.v"), ("b", 4, "select_into", "SELECT a INTO #t FROM x"), ("b", 5, "select_into", "INTO @y"), ("d", 1, "merge", "MERGE dw.x"), ("d", 2, "truncate", "truncate table y")}
    plan = scripts.write_markers(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r.n for r in df.select("definition", scripts.line_count(F.col("content")).alias("n")).orderBy("definition").collect()] == [4, 5, 0, 4, 0]


DEFINITION = ("d", "INSERT INTO dw.t\nSELECT a FROM [Raw].[x y]\nJOIN stage.z\nDELETE FROM #tmp\n", "r1")
UNITS = "definition string, operation string, target string, line_start int, line_end int, reason string"
SOURCES = "definition string, operation string, target string, line_start int, source string, role string, via array<string>, source_start int, source_end int, reason string"
EXCLUSIONS = "definition string, operation string, target string, disposition string, line_start int, line_end int, reason string"


def judged(spark, units=(("d", "insert", "DW . t", 1, 3, "loads"),), sources=(("d", "insert", "DW . t", 1, "raw.x  y", "business_data", ["join"], 2, 2, "read"),), exclusions=(("d", "delete", "#tmp", "local_intermediate", 4, 4, "local"),), revision="r1", definition="d", reviewed=None):
    tables = (
        spark.createDataFrame([(definition, revision)], "definition string, revision string"), spark.createDataFrame(list(units), UNITS), spark.createDataFrame(list(sources), SOURCES), spark.createDataFrame(list(exclusions), EXCLUSIONS),
        spark.createDataFrame([DEFINITION, ("other", "MERGE x", "r1")], "definition string, content string, revision string"), None if reviewed is None else spark.createDataFrame(reviewed, "definition string, state string, n_reviews int"),
    )
    return tables, proposals.violations(*tables)


def rules(spark, **changes):
    return sorted(r.rule for r in judged(spark, **changes)[1].collect())


UNIT, SOURCE, LEFT = ("d", "insert", "DW . t", 1, 3, "loads"), ("d", "insert", "DW . t", 1, "raw.x  y", "business_data", ["join"], 2, 2, "read"), ("d", "delete", "#tmp", "local_intermediate", 4, 4, "local")


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({}, []),
        ({"revision": "r0"}, ["revision_current"]),
        ({"definition": "gone", "units": [], "sources": [], "exclusions": []}, ["definition_known"]),
        ({"units": [], "sources": []}, ["write_unclassified"]),
        ({"exclusions": []}, ["write_unclassified"]),
        # an entry covers the marker of its first line only
        ({"units": [UNIT, ("d", "delete", "#tmp", 3, 4, "late")], "exclusions": []}, ["write_not_found", "write_unclassified"]),
        ({"units": [UNIT, ("d", "update", "dw.t", 1, 1, "no")]}, ["write_not_found"]),
        ({"units": [UNIT, ("d", "insert", "dw.[t]", 1, 1, "twice")]}, ["unit_once"]),
        ({"units": [UNIT, ("d", "insert", "insert", 1, 1, "word")]}, ["target_a_name"]),
        ({"units": [("d", "insert", "DW . t", 1, 5, "long")]}, ["lines_in_source"]),
        ({"units": [("d", "insert", "DW . t", 1, 3, " \t ")]}, ["reason_given"]),
        ({"sources": [SOURCE[:5] + ("friend",) + SOURCE[6:]]}, ["role_known"]),
        ({"sources": [SOURCE[:6] + (["join", "join"],) + SOURCE[7:]]}, ["via_sound"]),
        ({"sources": [SOURCE, SOURCE[:4] + ("RAW.x  y", "lookup", None, 2, 2, "again")]}, ["source_once"]),
        ({"sources": [SOURCE[:4] + ("raw.x", "lookup", None, 3, 3, "no")]}, ["target_in_lines"]),
        ({"sources": [("d", "insert", "dw.t", 1) + SOURCE[4:]]}, ["unit_known"]),
        ({"exclusions": [LEFT[:3] + ("forgotten",) + LEFT[4:]]}, ["disposition_known"]),
        ({"exclusions": [LEFT, ("d", "delete", "#TMP", "unresolved", 4, 4, "again")]}, ["exclusion_once"]),
        ({"reviewed": [("d", "validated", 1)]}, ["reviewed_item"]),
        ({"reviewed": [("d", "review_required", 2), ("d", "draft", 0), ("other", "validated", 3)]}, []),
    ],
)
def test_rules_of_proposals(spark, changes, want):
    assert rules(spark, **changes) == want


def test_a_sound_proposal_becomes_drafts(spark):
    tables, found = judged(spark)
    taken = proposals.accepted(tables[0], found)
    units, sources, left = proposals.write_units(tables[1], taken), proposals.write_sources(tables[2], taken), proposals.excluded_writes(tables[3], taken)
    assert [(r.definition, r.target, r.state) for r in units.collect()] == [("d", "DW . t", "draft")]
    assert units.first().unit == sources.first().unit and units.first().unit.startswith("write:")
    assert left.count() == 1
    standing = units.withColumn("target", F.lit("old")).unionByName(units.withColumn("definition", F.lit("other")))
    now = proposals.replaced(standing, units, taken)
    assert {(r.definition, r.target) for r in now.collect()} == {("other", "DW . t"), ("d", "DW . t")}
    broken, found = judged(spark, revision="r0")
    assert proposals.write_units(broken[1], proposals.accepted(broken[0], found)).count() == 0


def test_closures_equal_a_walk(spark):
    rng = random.Random(8)
    events = [(f"l{log}", f"q{i}", rng.choice(["succeeded", "succeeded", "failed"]), rng.choice(["sql", "mongo", "python"]), [f"n{rng.randrange(9)}" for _ in range(rng.randrange(3))], [f"q{rng.randrange(i + 2)}" for _ in range(rng.randrange(3))] if i % 7 else [f"q{i - 1}"]) for log in range(3) for i in range(60)]
    chain = [("c", f"q{i}", "succeeded", "sql", [f"n{i}"], [f"q{i - 1}"] if i else []) for i in range(300)]
    df = spark.createDataFrame(events + chain, "log string, call_id string, status string, kind string, inputs array<string>, consumes array<string>")
    used = {(log, c): set(u) for log, c, _, _, _, u in events + chain}
    want, inputs = set(), set()
    for log, call, status, *_ in events + chain:
        if status == "succeeded":
            seen, open_ = {call}, [call]
            while open_:
                for u in used[log, open_.pop()]:
                    if (log, u) in used and u not in seen:
                        seen.add(u)
                        open_.append(u)
            want |= {(log, call, u) for u in seen}
            inputs |= {(log, call, n) for lg, c, _, kind, ns, _ in events + chain if lg == log and c in seen and kind != "python" for n in ns}
    closed = graph.closures(df)
    assert {tuple(r) for r in closed.collect()} == want
    assert {tuple(r) for r in graph.closure_inputs(df, closed).collect()} == inputs
