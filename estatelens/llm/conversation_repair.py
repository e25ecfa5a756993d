"""Conversation structure repair by a fold of higher-order functions.

A conversation is well formed if its roles are an optional system turn and then pairs of user and assistant, or if it is
empty. Every turn gets its first fault: blank (no character but ASCII white space), duplicate (an earlier turn has its role and
text; told by a window) or truncated (its last such character is none of . ! ?). Edits are Keep (0), Rerole to user or assistant (1),
Delete (2, the only one for blank and duplicate turns) and Insert of an empty user or assistant turn anywhere (5); a truncated
turn that is not deleted adds 5.

The turns of a conversation are collected as sorted structs, and aggregate() carries the cheapest (cost, audit) of four
states: nothing yet, after system, after user, after assistant. least() over structs takes the lower cost and then the lesser audit,
the string of edit initials. An audit names its states: from each state every edit of a given turn leads to one other state.
So of two audits of one state and cost none begins with the other, and the lesser of two prefixes stays the lesser. The audit is
replayed over the turns for the repaired conversation.

One conversation is one row: its turns, and by contract its repaired text, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
LEGAL = ("su", "ua", "au")
STATES = ("empty", "system", "user", "assistant")
#: Cost of a state that nothing leads to: above that of any conversation.
_NEVER = 1 << 50
_SOLID = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of conversations(conv_id, turn, role, text), damaged by the crc32 of `conv_id:turn` modulo 20.

    0 drops a row (it stays, not present), 1 empties its text, 2 takes . ! ? out of it, 3 repeats it, 4 makes its role user. A
    null is read as one blank, in roles, texts and the text of the key.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), blank).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))
    damaged_rows = rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"), F.explode(copies).alias("copy"))
    return damaged_rows.drop("copy")


def _edit(state: Column, cost: Column | int, initial: str) -> Column:
    return F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], F.lit(initial)).alias("audit"))


def _four(*states: Column) -> Column:
    return F.struct(*[s.alias(n) for s, n in zip(states, STATES, strict=True)])


def _inserted(four: Column) -> Column:
    """The states after any insertions; more than two in a row never pay."""
    user = F.least(four["user"], *[_edit(four[s], INSERT, "I") for s in ("empty", "system", "assistant")])
    return let(user, lambda u: _four(four["empty"], four["system"], u, F.least(four["assistant"], _edit(u, INSERT, "I"))))


def _turned(four: Column, turn: Column) -> Column:
    """The states after one more turn."""
    free = ~turn["fault"].isin("blank", "duplicate")
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def reached(state: str, initial: str, *before: str) -> Column:
        kept = [F.when(free & (turn["initial"] == initial), _edit(four[b], extra, "K")) for b in before]
        reroled = [F.when(free, _edit(four[b], extra + REROLE, "R")) for b in before] if initial != "s" else []
        return F.least(_edit(four[state], DELETE, "D"), *kept, *reroled)

    return _four(_edit(four["empty"], DELETE, "D"), reached("system", "s", "empty"), reached("user", "u", "empty", "system", "assistant"), reached("assistant", "a", "user"))


def _cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of turns."""
    never = F.struct(F.lit(_NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))
    start = _four(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")), never, never, never)
    return F.aggregate(turns, start, lambda four, turn: let(_inserted(four), lambda x: _turned(x, turn)), lambda four: let(_inserted(four), lambda x: F.least(x["empty"], x["assistant"])))


def _replayed(turns: Column, audit: Column) -> Column:
    """The repaired turns (role, text): segment k of the audit is turn k with the insertions before it."""
    segments = F.regexp_extract_all(audit, F.lit("I*[DKR]|I+$"), F.lit(0))
    edits = F.flatten(F.transform(segments, lambda s, k: F.transform(F.regexp_extract_all(s, F.lit("[IKR]"), F.lit(0)), lambda e: F.struct(e.alias("edit"), k.alias("k")))))
    # in front of the pairs there is a kept system turn or nothing
    led = F.coalesce((F.get(edits, F.lit(0))["edit"] == "K") & (F.get(turns, F.get(edits, F.lit(0))["k"])["initial"] == "s"), F.lit(False)).cast("int")

    def replayed(found: Column) -> Column:
        def one(x: Column, place: Column) -> Column:
            turn = F.get(turns, x["k"])
            role = F.when(x["edit"] == "K", turn["role"]).when((place - found["led"]) % 2 == 0, "user").otherwise("assistant")
            return F.struct(role.alias("role"), F.when(x["edit"] == "I", "").otherwise(turn["text"]).alias("text"))

        return F.transform(found["edits"], one)

    return let(F.struct(edits.alias("edits"), led.alias("led")), replayed)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of rows(conv_id, turn, role, text, present).

    Turns are taken by turn (nulls first), those of one turn by role and text in UTF-8 order. Rows that are not present only make
    their conversation known. gaps counts the turn numbers missing between the least and the largest; blank, duplicate and
    truncated count first faults; illegal counts neighbours whose role initials are none of su, ua, au; repaired is the array of
    (role, text) after the cheapest edits, of equally cheap ones those with the least audit.
    A conversation without turns has zeros, an empty audit and an empty array. A null conv_id is a conversation of its own, roles and
    texts must not be null (damaged() sees to that), very long texts are read whole, an empty table gives no rows.
    """
    # partitioned once by the conversation, which serves the window and the aggregation
    dealt = rows.select("conv_id", "turn", "role", "text", "present").repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    last = F.regexp_extract("text", rf"({_SOLID})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(_SOLID), "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    turn = F.struct("turn", "role", "text", "nth", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    # the sort is by turn, role, text and the place among equal ones
    turns = F.sort_array(F.collect_list(F.when(F.col("present"), turn))).alias("turns")
    folded = dealt.withColumn("nth", nth).groupBy("conv_id").agg(turns)
    numbers = F.filter(F.transform("turns", lambda x: x["turn"]), lambda x: x.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long").alias("gaps")
    faults = [F.size(F.filter(F.transform("turns", lambda x: x["fault"]), F.lit(f).__eq__)).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")]
    unlike = F.filter("turns", lambda x, i: (i > 0) & ~F.concat(F.get(F.col("turns"), i - 1)["initial"], x["initial"]).isin(*LEGAL))
    folded = folded.select("conv_id", "turns", gaps, *faults, F.size(unlike).cast("long").alias("illegal"), _cheapest(F.col("turns")).alias("best"))
    repaired = _replayed(F.col("turns"), F.col("best.audit"))
    return folded.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired.alias("repaired"))


def repaired_sha256(repaired: str) -> Column:
    """SHA-256 of the repaired turns as `role:text`, joined by line feeds."""
    return F.sha2(F.array_join(F.transform(repaired, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").cast("binary"), 256)
