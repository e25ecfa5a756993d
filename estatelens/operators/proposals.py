"""What an analysis proposes for the writes of definitions: write units with their sources, and writes left out on purpose.

All tables hold the proposals of many definitions at once:
proposals(definition, revision), units(definition, operation, target, line_start, line_end, reason),
sources(definition, operation, target, line_start, source, role, via, source_start, source_end, reason) of the unit with the same
first four columns, exclusions(definition, operation, target, disposition, line_start, line_end, reason) and
definitions(definition, content, revision). A proposal is taken whole or, if any rule is broken, refused whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import review, scripts

#: What a write does, what a source is for, why a write is left out.
OPERATIONS = ("delete", "insert", "merge", "select_into", "truncate", "update")
ROLES = ("audit", "business_data", "control", "deduplication", "filter", "lookup", "unknown")
DISPOSITIONS = ("dynamic_sql", "local_intermediate", "unresolved")


def _name(*parts: str) -> Column:
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def _broken(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(definition, rule, key) for each rule of which the condition holds; null is false."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return df.select("definition", F.explode(found).alias("rule"), key.alias("key"))


def _evidence(df: DataFrame, definitions: DataFrame, key: Column, target: str, first: str, last: str, rules: dict[str, Column]) -> DataFrame:
    """_broken() of rules, and of those that all evidence obeys: a known definition, lines in its source that name the target, a reason."""
    met = df.join(definitions.select("definition", "content"), "definition", "left").withColumn("lines", scripts.line_count(F.col("content")))
    known = F.col("content").isNotNull()
    inside = (F.col(first) >= 1) & (F.col(last) >= F.col(first)) & (F.col(last) <= F.col("lines"))
    named = review.present(F.col(target), review.cited(F.col("content"), F.greatest(first, F.lit(1)), F.col(last)))
    common = {
        "definition_known": ~known, "lines_in_source": known & ~F.coalesce(inside, F.lit(False)), "target_in_lines": known & inside & ~F.coalesce(named, F.lit(False)),
        "reason_given": ~F.coalesce("reason", F.lit("")).rlike(r"\S"), "target_given": ~F.coalesce(target, F.lit("")).rlike(r"\S"),
    }
    return _broken(met, key, common | rules)


def _repeated(df: DataFrame, rule: str, key: Column) -> DataFrame:
    twice = df.select("definition", key.alias("key")).groupBy("definition", "key").agg(F.count("*").alias("n")).where("n > 1")
    return twice.select("definition", F.lit(rule).alias("rule"), "key")


def _dotted(reference: str) -> Column:
    return F.array_join(review._parts(F.col(reference)), ".")


def coverage_violations(markers: DataFrame, units: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(definition, rule, key): markers(definition, line, operation) that no unit or exclusion starts at, and those of them that start at no marker.

    An entry covers a marker of its operation on its first line, so that both sides meet by an equality join.
    """
    cols = ["definition", "operation", F.col("line_start").alias("line")]
    entries = units.where("line_end >= line_start").select(*cols).union(exclusions.where("line_end >= line_start").select(*cols)).distinct()
    on, key = ["definition", "operation", "line"], F.concat("operation", F.lit("@"), F.col("line").cast("string"))
    missing = markers.select(*on).join(entries, on, "left_anti").select("definition", F.lit("write_unclassified").alias("rule"), key.alias("key"))
    return missing.union(entries.join(markers.select(*on), on, "left_anti").select("definition", F.lit("write_not_found"), key))


def violations(proposals: DataFrame, units: DataFrame, sources: DataFrame, exclusions: DataFrame, definitions: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """(definition, rule, key) of all rules that proposals break.

    reviewed(definition, state, n_reviews) lists claims and units that stand already: what people have reviewed and nothing has
    put up for review again is not overwritten.
    """
    wanted = proposals.select("definition").distinct()
    current = definitions.select("definition", F.col("revision").alias("now"))
    stale = proposals.join(current, "definition", "left").where("not (revision <=> now)").select("definition", F.when(F.col("now").isNull(), "definition_known").otherwise("revision_current").alias("rule"), F.coalesce("revision", F.lit("")).alias("key"))
    unit, source, left_out = _name("definition", "operation", "target", "line_start"), _name("definition", "source", "role", "source_start"), _name("definition", "operation", "target", "line_start")
    placeholder = lambda c: F.lower(F.trim(F.col(c))).isin(*review.NO_TARGETS)
    ways = F.coalesce("via", F.array().cast("array<string>"))
    parts = [
        stale,
        _repeated(proposals, "proposal_once", F.col("definition")),
        _evidence(units, definitions, unit, "target", "line_start", "line_end", {"operation_known": ~F.col("operation").isin(*OPERATIONS), "target_a_name": placeholder("target")}),
        _evidence(sources, definitions, source, "source", "source_start", "source_end", {
            "role_known": ~F.col("role").isin(*ROLES), "target_a_name": placeholder("source"),
            "via_sound": F.exists(ways, lambda v: ~v.rlike(r"\S")) | (F.size(F.array_distinct(ways)) < F.size(ways)),
        }),
        _evidence(exclusions, definitions, left_out, "target", "line_start", "line_end", {"operation_known": ~F.col("operation").isin(*OPERATIONS), "disposition_known": ~F.col("disposition").isin(*DISPOSITIONS)}),
        _repeated(units, "unit_once", F.concat_ws("|", "operation", _dotted("target"), F.col("line_start").cast("string"))),
        _repeated(sources, "source_once", F.concat_ws("|", "operation", _dotted("target"), F.col("line_start").cast("string"), F.lower("source"), F.col("source_start").cast("string"), F.col("source_end").cast("string"))),
        _repeated(exclusions, "exclusion_once", F.concat_ws("|", "operation", F.lower("target"), F.col("line_start").cast("string"))),
        sources.join(units, ["definition", "operation", "target", "line_start"], "left_anti").select("definition", F.lit("unit_known"), source),
        coverage_violations(scripts.write_markers(definitions.join(wanted, "definition", "left_semi")), units, exclusions),
    ]
    if reviewed is not None:
        held = reviewed.where("n_reviews > 0 and state <> 'review_required'").select("definition").distinct()
        parts.append(wanted.join(held, "definition", "left_semi").select("definition", F.lit("reviewed_item"), "definition"))
    return reduce(DataFrame.union, parts).join(wanted, "definition", "left_semi").distinct()


def _unit_id() -> Column:
    said = F.concat_ws("\n", F.lit("write"), "operation", "definition", _dotted("target"), F.col("line_start").cast("string"), "revision")
    return F.concat(F.lit("write:"), F.substring(F.sha2(said, 256), 1, 24))


def accepted(proposals: DataFrame, found: DataFrame) -> DataFrame:
    """(definition, revision) of the proposals that break no rule of found = violations(...)."""
    return proposals.join(found.select("definition").distinct(), "definition", "left_anti").select("definition", "revision")


def write_units(units: DataFrame, taken: DataFrame) -> DataFrame:
    """(unit, definition, operation, target, line_start, line_end, reason, state) of the proposals taken: drafts."""
    own = units.join(taken, "definition")
    return own.select(_unit_id().alias("unit"), "definition", "operation", "target", "line_start", "line_end", "reason", F.lit("draft").alias("state"))


def write_sources(sources: DataFrame, taken: DataFrame) -> DataFrame:
    """(unit, source, role, via, line_start, line_end, reason) of the units of write_units()."""
    own = sources.join(taken, "definition").withColumn("unit", _unit_id())
    return own.select("unit", "source", "role", "via", F.col("source_start").alias("line_start"), F.col("source_end").alias("line_end"), "reason")


def excluded_writes(exclusions: DataFrame, taken: DataFrame) -> DataFrame:
    """(definition, operation, target, disposition, line_start, line_end, reason) of the proposals taken."""
    return exclusions.join(taken.select("definition"), "definition", "left_semi").select("definition", "operation", "target", "disposition", "line_start", "line_end", "reason")


def replaced(standing: DataFrame, fresh: DataFrame, taken: DataFrame) -> DataFrame:
    """standing rows of other definitions than those taken, and the fresh ones; both have a definition and the same columns."""
    return standing.join(taken.select("definition"), "definition", "left_anti").select(*fresh.columns).unionByName(fresh)
