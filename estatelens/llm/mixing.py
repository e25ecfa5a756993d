"""Mixing sources to target weights over fixed-length token blocks.

Each source's tokens (words) are laid out document by document and cut into blocks of BLOCK tokens. Targets
follow the weights, no source beyond REPEATS times its size. The slots of the mix lie in output shards of SHARD slots. How many
slots of a shard each source gets is drawn first: a multinomial draw conditioned on the targets (the tickets of all
sources' slots are dealt to the places of all shards by a pseudorandom permutation and counted). The shards' counts
then number a source's slots from the first shard to the last: the q-th takes the block that the source's own
pseudorandom permutation gives for q, and starts over once all are used. So the draw decides which shard holds which of a source's blocks;
how often a document is taken in all depends on the source's slots alone, whatever shards they fall into. A source's last
slot may be filled in part, so that its words meet the target to one word. Within a shard slots are permuted once more. Permutations are
swap-or-not networks over exactly the index range: no table, no rejection, the same in each run. Slots meet
documents by joining on (source, block). `mixed_blocks` gives the shards, slot by slot; `mix` sums what they hold of each
document, and `mixed_documents` gives the documents' own view of the same takes, without shards. Only DataFrame
operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, positional

BLOCK, REPEATS = 64, 3
#: Rounds of a permutation; slots of an output shard; tickets that a task deals at a time.
ROUNDS, SHARD, CHUNK = 24, 4096, 8192
#: Parts that a source is laid out in: PARTS, or more where one would have over PART_ROWS rows on average; shards summed together.
PARTS, PART_ROWS, SHARDS = 64, 200_000, 4096
#: A prime below 2**31, and the multipliers of the permutations' bits; any odd values do.
PRIME, A, B, C = 2147483647, 48271, 69621, 16807
HALF = 1 << 31


def round_keys(n: Column, seed: Column) -> Column:
    """Each round's reflection point below n, and what it adds to the bit of a place."""

    def of(r: Column) -> Column:
        high = (r * A + seed * B + 12345) % PRIME * C % PRIME
        return F.struct(((high * HALF + (high * A + r) % PRIME) % n).alias("k"), (r * B + seed * C).alias("c"))

    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), of)


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, n below 2**61: in each round x and k - x swap, or not, by a bit that both share."""

    def step(v: Column, r: Column) -> Column:
        other = (r["k"] - v + n) % n
        top = F.greatest(v, other)
        low = (top % HALF % PRIME * A + F.shiftright(top, 31) * B + r["c"]) % PRIME
        bit = F.shiftright(low * A % PRIME * B % PRIME, 10).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(v)

    return F.aggregate(keys, x.cast("long"), step)


def place_of(y: Column, n: Column, keys: Column) -> Column:
    """The x that `permuted` sends to y: each round undoes itself."""
    return permuted(y, n, F.reverse(keys))


def targets(sized: DataFrame) -> DataFrame:
    """(source, number, rows, source_size, target) of each source of sized(source, size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; targets add up to all sizes and stop at REPEATS times a
    source's size, what is beyond going to the others by weight. One task sorts one short row per source (ten million take
    less than a gigabyte, and the sort spills).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("number", F.row_number().over(order).cast("long") - 1).withColumn("weight", F.col("number") % 3 + 1)
    everything = Window.partitionBy()
    w = w.withColumn("cap", REPEATS * F.col("source_size")).withColumn("all", F.sum("source_size").over(everything))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all") - F.coalesce(F.sum("cap").over(by), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by), F.lit(0))
    w = w.withColumn("full", F.col("cap") * heavy <= left * F.col("weight"))
    free = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(free * F.col("weight") / share)
    return w.select("source", "number", "rows", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized_sources(totals: DataFrame) -> DataFrame:
    """targets(...) with blocks, whole (times that all blocks are taken), part (words of a last slot filled in part) and slots."""
    s = totals.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    s = s.withColumn("rest", F.when(F.col("source_size") > 0, F.least(rest, F.col("source_size"))).otherwise(0)).withColumn("keys", round_keys(F.greatest("blocks", F.lit(1)), F.col("number") + 1))
    # the last block is short: words that slots lack once they have passed it
    last = F.col("source_size") - (F.col("blocks") - 1) * BLOCK
    at = place_of(F.col("blocks") - 1, F.greatest("blocks", F.lit(1)), F.col("keys"))
    full = F.expr(f"rest div {BLOCK}")
    passed = (F.col("source_size") > 0) & ((at < full) | ((at == full) & (F.col("rest") % BLOCK >= last)))
    s = s.withColumn("need", F.col("rest") + F.when(passed, BLOCK - last).otherwise(0)).withColumn("part", F.col("need") % BLOCK)
    slots = F.col("whole") * F.col("blocks") + F.expr(f"need div {BLOCK}") + (F.col("part") > 0).cast("long")
    return s.withColumn("slots", slots).drop("rest", "need")


def shard_counts(sources: DataFrame, total: int) -> DataFrame:
    """(shard, number, n) with n > 0: how many slots of each shard each source gets; they add up to the sources' slots.

    A multinomial draw conditioned on the sources' slots: every slot has a ticket, all tickets are dealt to all places.
    """
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}"))).alias("chunk")
    chunks = sources.where("slots > 0").select("number", "before", "slots", chunk).repartition(max(1, min(100_000, total // 50_000 + 1)), "number", "chunk")
    chunks = chunks.withColumn("keys", round_keys(F.lit(total).cast("long"), F.lit(0).cast("long")))
    first = F.col("before") + F.col("chunk") * CHUNK
    tickets = chunks.select("number", "keys", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("before") + F.col("slots")) - 1)).alias("g"))
    place = permuted(F.col("g"), F.lit(total).cast("long"), F.col("keys"))
    dealt = tickets.select("number", place.alias("place"))
    return dealt.groupBy("number", F.expr(f"place div {SHARD}").alias("shard")).agg(F.count("*").alias("n"))


def slots_of(counts: DataFrame, sources: DataFrame, total: int, space: Workspace) -> DataFrame:
    """(number, block, shard, slot, words) of each slot of the shards whose counts(shard, number, n) are given."""
    counts = space.keep(counts.withColumn("group", F.expr(f"shard div {SHARDS}")))
    grouped = counts.groupBy("number", "group").agg(F.sum("n").alias("all"))
    earlier = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = space.keep(grouped.select("number", "group", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base")))
    inside = Window.partitionBy("number", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.join(groups, ["number", "group"]).withColumn("q", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    numbered = numbered.withColumn("at", F.coalesce(F.sum("n").over(beside), F.lit(0)))
    numbered = space.keep(numbered.select("shard", "number", "n", "q", "at")).repartition(max(1, min(100_000, total // 50_000 + 1)), "shard", "number")
    size = F.least(F.lit(SHARD).cast("long"), F.lit(total) - F.col("shard") * SHARD)
    drawn = numbered.join(sources.select("number", "blocks", "slots", "part", "keys"), "number").withColumn("size", size)
    drawn = drawn.withColumn("inner", round_keys(F.col("size"), F.col("shard") + 1)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    q = F.col("q") + F.col("j")
    block = permuted(q % F.col("blocks"), F.col("blocks"), F.col("keys"))
    slot = permuted(F.col("at") + F.col("j"), F.col("size"), F.col("inner"))
    words = F.when((q == F.col("slots") - 1) & (F.col("part") > 0), F.col("part")).otherwise(BLOCK)
    return drawn.select("number", block.alias("block"), "shard", slot.alias("slot"), words.cast("long").alias("words"))


def part_of(x: Column, parts: int) -> Column:
    """The part of an id (of a size where the id is null): mixed, so that ids of any stride spread over all parts."""
    x = F.pmod(x, F.lit(PRIME)) * A % PRIME
    x = x.bitwiseXOR(F.shiftright(x, 13)) * B % PRIME
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 11)), F.lit(parts))


def plan(rows: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Laid-out documents, sources and slots of a mix of rows(row, doc_id, key, source, size).

    laid: (row, doc_id, size, number, first) where first is the place of its first token; sources: one row each; slots:
    (number, block, shard, slot, words) of each slot of the mix.
    """
    sources = sized_sources(space.keep(targets(rows)))
    until = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    sources = space.keep(sources.withColumn("before", F.coalesce(F.sum("slots").over(until), F.lit(0))))
    counted = sources.agg(F.sum("slots").alias("slots"), F.sum("rows").alias("rows")).first()
    total, parts = int(counted.slots or 0), max(PARTS, (counted.rows or 0) // PART_ROWS)
    docs = rows.join(sources.select(F.col("source").alias("s"), "number"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    docs = docs.withColumn("part", part_of(F.coalesce("doc_id", "size"), parts))
    filled = docs.groupBy("number", "part").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = space.keep(filled.select("number", "part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("start")))
    inside = Window.partitionBy("number", "part").orderBy("doc_id", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = docs.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(start, ["number", "part"])
    laid = laid.select("row", "doc_id", "size", "number", (F.col("start") + F.col("own")).alias("first"))
    # written, so that the planner knows their size: they grow with the corpus
    return space.keep(laid), sources, space.keep(slots_of(shard_counts(sources, total), sources, total, space))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"), F.xxhash64("text").alias("key"))


def _spans(laid: DataFrame) -> DataFrame:
    """(row, block, ...): the blocks that each document lies in."""
    block = F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + size - 1) div {BLOCK}"))).alias("block")
    return laid.where("size > 0").select("row", "doc_id", "size", "number", "first", block)


def _met(spans: DataFrame, lo: Column | int, hi: Column) -> DataFrame:
    """spans with at and n: the words of the document between the lo-th and the hi-th word of the block."""
    start = F.greatest(F.col("first"), F.col("block") * BLOCK + lo)
    end = F.least(F.col("first") + F.col("size"), F.col("block") * BLOCK + hi)
    return spans.withColumn("at", start - F.col("first")).withColumn("n", end - start).where("n > 0")


def _packed(laid: DataFrame, slots: DataFrame) -> DataFrame:
    """What each slot of each shard holds of each document."""
    return _met(_spans(laid).join(slots.hint("merge"), ["number", "block"]), 0, F.col("words"))


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """(shard, slot, source, block, doc_id, at, n) of docs(doc_id, text, source): the mix as it is packed into shards.

    Each slot of a shard holds one block of one source, and a row is the part of it that a document fills: n words from its
    at-th on. Shards have SHARD slots, the last one fewer; a source's last slot may hold the first words of its block
    only; null texts have no words; other columns are ignored; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession)
    laid, sources, slots = plan(space.keep(_sized(docs)), space)
    out = _packed(laid, slots).join(sources.select("number", "source"), "number")
    return out.select("shard", "slot", "source", "block", "doc_id", "at", "n")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs(doc_id, text, source).

    size counts words `[^\x20\x09-\x0D]+` (null: none); taken the words that the shards hold of the row, repeats counted.
    A source's taken words are its target to one word. Repeated rows are rows of their own, null ids are laid out first; empty
    texts take nothing; other columns are ignored; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession)
    laid, sources, slots = plan(space.keep(_sized(docs)), space)
    taken = _packed(laid, slots).groupBy("row").agg(F.sum("n").alias("taken"))
    out = laid.join(taken, "row", "left").join(sources.select("number", "source_size", "target"), "number")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs(doc_id, text, source): a row for each time that words of a document are taken.

    The k-th row of a document holds the words of its blocks that are taken k times at least; where those are all, the
    text is whole, else the words are joined by blanks. n_chars, if it is there, is set anew. Documents without
    words (null or empty texts) belong to no block and stay as they are. Repeated rows and null ids are documents of their
    own; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession)
    plain, named = positional(docs)
    # written, so that rows keep their numbers
    held = space.keep(plain.withColumn("row", F.monotonically_increasing_id()))
    text, source, doc_id = (F.col(named[c]) for c in ("text", "source", "doc_id"))
    sized = space.keep(held.select("row", doc_id.cast("long").alias("doc_id"), source.alias("source"), word_count(named["text"]).alias("size"), F.xxhash64(text).alias("key")))
    laid, _, slots = plan(sized, space)
    whole = F.sum((F.col("words") == BLOCK).cast("int"))
    times = slots.groupBy("number", "block").agg(whole.alias("whole"), F.max(F.when(F.col("words") < BLOCK, F.col("words"))).alias("some"))
    parts = f"if(some is null, array(named_struct('lo', 0L, 'hi', {BLOCK}L, 'times', whole)), array(named_struct('lo', 0L, 'hi', some, 'times', whole + 1), named_struct('lo', some, 'hi', {BLOCK}L, 'times', whole)))"
    times = space.keep(times.select("number", "block", F.inline(F.expr(parts))).where("times > 0"))
    pieces = _met(_spans(laid).join(times.hint("merge"), ["number", "block"]), F.col("lo"), F.col("hi"))
    turn = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn")
    runs = pieces.select("row", "size", "at", "n", turn).groupBy("row", "size", "turn").agg(F.sum("n").alias("kept"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
    # at most REPEATS turns of a row, and a run for each of its blocks
    spread = space.keep(runs.groupBy("row").agg(F.collect_list(F.struct("turn", "kept", F.expr("if(kept = size, null, runs) as runs"))).alias("turns")))
    joined = held.join(spread.hint("merge"), "row", "left").join(sized.where("size = 0").select("row", F.lit(True).alias("blank")).hint("merge"), "row", "left")
    joined = joined.where("turns is not null or blank").select(*named.values(), F.explode_outer("turns").alias("turn"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = F.array_join(F.flatten(F.transform("turn.runs", lambda r: F.slice(words, r["at"].cast("int") + 1, r["n"].cast("int")))), " ")
    entire = F.col("turn.runs").isNull()
    values = {c: F.col(n) for c, n in named.items()} | {"text": F.when(entire, text).otherwise(cut)}
    if "n_chars" in named:
        values["n_chars"] = F.when(entire, F.col(named["n_chars"])).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[v.alias(c) for c, v in values.items()])
