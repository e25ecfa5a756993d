"""Conversation repair against a shortest-path search over edits, and against its SQL, on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from rows import rows_of

from estatelens.llm import conversation_repair as cr
from estatelens.llm import queries

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
COSTS = {"I": 5}
SCHEMA = "conv_id long, turn long, role string, text string, present boolean, nth int, turns string, `a.b` string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(c, t, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired) by a search over (turns taken, roles so far); turns of (initial, role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, done = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, done
        if (i, state) in seen:
            continue
        seen.add((i, state))
        after = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]
        for role in ("user", "assistant"):
            if role[0] in after:
                heapq.heappush(heap, (cost + COSTS["I"], audit + "I", i, role[0], (*done, (role, ""))))
        if i < len(turns):
            initial, role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, done))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if initial in after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial, (*done, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in after:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, new[0], (*done, (new, text))))
    raise AssertionError


def brute(rows):
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in damage(rows):
        by[c].append((t is not None, t or 0, role.encode(), text.encode(), t, role, text))
    out = []
    for c, mine in by.items():
        seen, turns, counts, numbers = set(), [], defaultdict(int), set()
        for *_, t, role, text in sorted(mine, key=lambda x: x[:4]):
            solid = text.strip(SPACES)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role[:1], role, text, fault))
            numbers |= {t} - {None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, done = cheapest(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest()
        out.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "é", "uploader", "s"]
    texts = ["Yes.", "No!", "cut", "", None, " \n", "Why? \t", "Yes.", "日本。", "end. ", "x.\x1f", "a\nb!\n", "long " * 50]
    rows = [(c, rng.choice([None, *range(9), 10**12, -4]), rng.choice(roles), rng.choice(texts)) for c in range(400) for _ in range(rng.randrange(1, 8))]
    rows += [(None, t, r, x) for t, r, x in ((0, "user", "a."), (1, "assistant", "b."), (None, "user", "c"), (1, "assistant", "b."))]
    rows += [(7000 + c, t, ["user", "assistant"][t % 2], f"turn {t}.") for c in range(60) for t in range(6)]
    # whole conversations that are dropped
    rows += [(c, 0, "user", "gone.") for c in range(8000, 8100)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, False, 7, "x", "y") for r in cases()], SCHEMA).repartition(3)


def found(df):
    out = cr.repair(cr.damaged(df)).withColumn("sha", cr.repaired_sha256("repaired")).drop("repaired")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_the_search(table):
    want = brute(cases())
    assert found(table) == want
    # at these costs a deletion mends whatever an insertion would
    assert {x for r in want for x in r[7]} == set("KRD")
    assert any(r[7] == "" for r in want)


def test_insertions_where_they_pay(table, monkeypatch):
    monkeypatch.setattr(cr, "INSERT", 1)
    monkeypatch.setitem(COSTS, "I", 1)
    want = brute(cases())
    assert found(table) == want
    assert {x for r in want for x in r[7]} == set("KRDI")


def test_equals_the_sql(table):
    con = duckdb.connect()
    con.register("given", table.toPandas()[["conv_id", "turn", "role", "text"]])
    con.execute("create table conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role, text from given")
    got = cr.repair(cr.damaged(table)).withColumn("repaired_sha256", cr.repaired_sha256("repaired")).drop("repaired")
    assert rows_of(got.toPandas()) == rows_of(con.execute(queries.oracle_sql()["op13_conversation_repair"]).df())


def test_repaired_turns_are_well_formed(table):
    out = cr.repair(cr.damaged(table)).select("cost", F.expr("array_join(transform(repaired, x -> left(x.role, 1)), '')").alias("roles"), "audit")
    assert all(re.fullmatch(r"(s?(ua)+)?", r.roles) and len(r.roles) == len(r.audit.replace("D", "")) for r in out.collect())


def test_long_conversations_and_texts(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b!", "c", "", f"{i}?"])) for i in range(1500)]
    rows += [(2, 0, "user", "w " * 500_000 + "."), (2, 1, "assistant", " " * 500_000), (2, 2, "assistant", "end." + " " * 300_000)]
    assert found(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == []
