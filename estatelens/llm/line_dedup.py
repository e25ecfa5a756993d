"""Line deduplication by site-relative frequency.

Pages are grouped by host. For each host and line the pages that hold the line are counted and divided by
the host's pages; lines above RATIO are boilerplate of the site and leave all its pages. Hosts with fewer than MIN_PAGES
pages keep all lines, since there every line is on a large share of the pages; min_pages=1 judges them as all others.
Only DataFrame operations are used. A page's lines travel as hashes; hot hosts and lines are counted from partial
counts, and pages meet the boilerplate of their host by host, line and a salt of the page.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, let

RATIO, MIN_PAGES, SALTS = 0.3, 4, 16
#: What opens a hidden part, and what closes it.
PARTS = {"script": "</script>", "style": "</style>", "!--": "-->"}
#: A noncharacter that no page should hold; it is left out of pages and breaks openers that nothing closes.
BROKEN = "\uffff"
#: Elements whose tags end a line; other tags vanish. Content of script and style and comments go.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
HIDDEN = r"(?is)<script[^<>]*>.*?</script>|<style[^<>]*>.*?</style>|<!--.*?-->"
BREAKS = rf"(?i)</?({BLOCKS})([\s/][^>]*)?>"
TAGS = r"<[^>]+>"


def host(url: str | Column) -> Column:
    """The lower-case host of a URL, without user and port; empty if there is none or the URL is null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)", 2)), F.lit(""))


def _before_last(text: Column, end: str, pattern: str, to: str) -> Column:
    """text with the pattern replaced up to the last `end`: behind it no match can end, and the search for one would start anew again and again."""

    def cut(parts: Column) -> Column:
        head = F.left(parts["text"], F.length(parts["text"]) - F.length(parts["tail"]))
        return F.concat(F.regexp_replace(head, pattern, to), parts["tail"])

    return let(let(text, lambda t: F.struct(t.alias("text"), F.substring_index(t, end, -1).alias("tail"))), cut)


def _breakable(text: Column, opener: str, closer: str) -> Column:
    """text with openers behind the last closer broken, so that every opener left finds a closer."""

    def cut(parts: Column) -> Column:
        rest = F.substring(parts["text"], F.length(parts["head"]) + 1, F.length(parts["text"]))
        return F.concat(parts["head"], F.regexp_replace(rest, f"(?i)<({opener})", f"<{BROKEN}$1"))

    return let(let(text, lambda t: F.struct(t.alias("text"), F.regexp_extract(t, f"(?is)^.*{closer}", 0).alias("head"))), cut)


def _open(text: Column) -> Column:
    """Whether an opener stands behind the last closer of its kind; plain searches, so that few pages need _broken()."""
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(F.substring_index(low, c, -1), F.lit(f"<{o}")) for o, c in PARTS.items()]))


def _broken(text: Column) -> Column:
    for opener, closer in PARTS.items():
        text = _breakable(text, opener, closer)
    return text


def lines(html: str) -> Column:
    """The text lines of a page, trimmed, white space squeezed, empty ones left out; entities stay as written.

    Scripts, styles and comments that nothing closes are no hidden parts. Linear in the page, whatever it holds.
    """
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), BROKEN, "")
    text = let(text, lambda t: F.when(_open(t), _broken(t)).otherwise(t))
    text = F.regexp_replace(F.regexp_replace(text, HIDDEN, "\n"), BROKEN, "")
    text = _before_last(_before_last(text, ">", BREAKS, "\n"), ">", TAGS, "")
    cut = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(cut, lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of every row of pages(page_id, url, html).

    text holds the lines that stay, joined by line feeds. A line counts once a page; each row is a page, also
    repeated ones. Null or empty html has no lines; pages without a host are one group; very long pages are read whole;
    other columns are ignored; an empty table gives no rows. Lines are told apart by two 64-bit hashes.
    """
    space = Workspace(pages.sparkSession)
    # written, so that pages are cut once
    cut = space.keep(pages.select("page_id", host("url").alias("host"), lines("html").alias("lines")))
    # rows are told apart by their content, so that equal rows get equal answers and still count each
    keyed = cut.withColumn("row", F.xxhash64("page_id", "host", "lines"))
    held = keyed.select("page_id", "row", "host", F.explode(F.array_distinct("lines")).alias("line"))
    held = space.keep(held.select("page_id", "row", "host", F.xxhash64("line").alias("a"), F.hash("line", F.lit(7)).alias("b")))
    totals = cut.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    on = held.groupBy("host", "a", "b").agg(F.count("*").alias("n"))
    # at most (lines of a page) / ratio lines a host
    common = space.keep(on.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "a", "b"))
    salted = held.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    every = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    gone = salted.join(every, ["host", "a", "b", "salt"]).groupBy("page_id", "row").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    gone = space.keep(gone)
    met = keyed.alias("k").join(gone.alias("g"), F.expr("k.page_id <=> g.page_id and k.row = g.row"), "left")
    met = met.select("k.page_id", "k.host", "k.lines", F.coalesce("g.gone", F.array().cast(gone.schema["gone"].dataType)).alias("gone"))
    stays = F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), F.struct(F.xxhash64(x).alias("a"), F.hash(x, F.lit(7)).alias("b"))))
    met = met.withColumn("stays", F.when(F.size("gone") == 0, F.col("lines")).otherwise(stays))
    n, left = F.size("lines").cast("long"), F.size("stays").cast("long")
    return met.select("page_id", "host", n.alias("n_lines"), (n - left).alias("n_dropped"), F.array_join("stays", "\n").alias("text"))
