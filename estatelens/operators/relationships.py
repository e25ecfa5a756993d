"""Inference of joins: candidate pairs, evidence-based choice, key patterns and joins through key segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions import text as X

#: Fixed thresholds of the inference.
SOURCE_FIELDS, COVERAGE, OVERLAP, UNIQUENESS = 16, 0.85, 3, 0.9
PATTERN_MATCHES, PATTERN_COVERAGE, SEGMENT_OVERLAP, SEGMENT_COVERAGE, SEGMENT_UNIQUENESS = 3, 0.8, 2, 0.6, 0.9


def eligible_pairs(fields: DataFrame, existing: DataFrame, family: Column | None = None) -> DataFrame:
    """Every pair of a field and another object's key or first field of the same type family, those known left out.

    (from_object, from_field, to_object, to_field) in this order; the first SOURCE_FIELDS fields of each object are sources.
    """
    f = fields.withColumn("family", X.type_family(F.col("data_type")) if family is None else family)
    order = F.row_number().over(Window.partitionBy("object").orderBy("position", "field"))
    source = f.withColumn("source_order", order).where((F.col("source_order") <= SOURCE_FIELDS) & ~F.col("family").isin("bool", "binary", "unknown")).alias("s")
    target = f.where(F.col("is_primary_key") | (F.col("position") == 1)).alias("t")
    pairs = source.join(target, (F.col("s.family") == F.col("t.family")) & (F.col("s.object") != F.col("t.object")))
    names = ["from_object", "from_field", "to_object", "to_field"]
    pairs = pairs.select(*[F.col(f"{c}").alias(n) for c, n in zip(("s.object", "s.field", "t.object", "t.field"), names, strict=True)])
    return pairs.join(existing, names, "left_anti").orderBy(*names)


def candidate_pairs(fields: DataFrame, existing: DataFrame, source_object: str, max_pairs: int = 20, family: Column | None = None) -> DataFrame:
    """Pairs of a source object's fields and other objects' key or first fields of the same type family.

    fields(object, field, position, data_type, is_primary_key), existing(from_object, from_field, to_object, to_field).
    Best targets come first for every source field; the budget goes round the source fields. `family` replaces the native type
    rule where types are Spark's.
    """
    if not 1 <= max_pairs <= 50:
        raise ValueError("a discovery has 1 to 50 pairs")
    f = fields.withColumn("family", X.type_family(F.col("data_type")) if family is None else family)
    order = F.row_number().over(Window.orderBy("position", "field"))
    source = f.where(F.col("object") == source_object).withColumn("source_order", order).where(F.col("source_order") <= SOURCE_FIELDS)
    source = source.where(~F.col("family").isin("bool", "binary", "unknown")).alias("s")
    target = f.where((F.col("object") != source_object) & (F.col("is_primary_key") | (F.col("position") == 1))).alias("t")
    pairs = source.join(target, F.col("s.family") == F.col("t.family")).select(
        F.col("s.object").alias("from_object"), F.col("s.field").alias("from_field"), F.col("t.object").alias("to_object"), F.col("t.field").alias("to_field"),
        "s.source_order", (~F.col("t.is_primary_key")).alias("r1"), (X.normalized_name(F.col("s.field")) != X.normalized_name(F.col("t.field"))).alias("r2"), (F.col("s.data_type") != F.col("t.data_type")).alias("r3"),
    )
    new = pairs.join(existing, ["from_object", "from_field", "to_object", "to_field"], "left_anti")
    place = F.row_number().over(Window.partitionBy("source_order").orderBy("r1", "r2", "r3", "to_object", "to_field"))
    ranked = new.withColumn("target_rank", place).orderBy("target_rank", "source_order").limit(max_pairs)
    return ranked.select("from_object", "from_field", "to_object", "to_field", "source_order", "target_rank")


def confidence(source_coverage: Column, target_uniqueness: Column, target_coverage: Column, overlap: Column) -> Column:
    total = F.lit(0.2) + 0.35 * source_coverage + 0.2 * target_uniqueness + 0.15 * target_coverage + F.least(F.lit(0.1), overlap / 100)
    return F.round(F.least(F.lit(0.98), total), 4)


def best_candidates(profiles: DataFrame, coverage: float = COVERAGE, overlap: int = OVERLAP, uniqueness: float = UNIQUENESS) -> DataFrame:
    """The best profile of each source field among those that pass the thresholds; of equals the first.

    profiles(position, from_object, from_field, to_object, to_field, overlap, source_coverage, target_coverage, target_uniqueness).
    """
    fit = profiles.where((F.col("overlap") >= overlap) & (F.col("source_coverage") >= coverage) & (F.col("target_uniqueness") >= uniqueness))
    best = Window.partitionBy("from_object", "from_field").orderBy(F.desc("source_coverage"), F.desc("target_uniqueness"), F.desc("target_coverage"), F.desc("overlap"), "position")
    one = fit.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    digest = F.substring(F.sha2(F.concat_ws("\n", X.node_id("field", "from_object", "from_field"), X.node_id("field", "to_object", "to_field")), 256), 1, 20)
    return one.select(
        F.concat(F.lit("relationship_candidate:"), digest).alias("id"), "from_object", "from_field", "to_object", "to_field", "overlap", F.round("source_coverage", 6).alias("source_coverage"),
        F.round("target_uniqueness", 6).alias("target_uniqueness"), confidence(F.col("source_coverage"), F.col("target_uniqueness"), F.col("target_coverage"), F.col("overlap")).alias("confidence"), F.lit("draft").alias("state"),
    )


def usable_relationships(edges: DataFrame) -> DataFrame:
    """Declared foreign keys and validated candidates of edges(type, state, ...)."""
    return edges.where((F.col("type") == "foreign_key") | ((F.col("type") == "relationship_candidate") & (F.col("state") == "validated")))


def dominant_pattern(df: DataFrame, field: str) -> DataFrame:
    """(field, pattern, sample_count, match_count, coverage, components) of a text column's keys; none below the gates."""
    values = df.where(F.col(field).isNotNull()).select(X.key_shape(F.col(field)).alias("shape"))
    counted = values.groupBy(F.col("shape.pattern").alias("pattern")).agg(F.count("*").alias("match_count"), F.first("shape.parts").alias("parts"))
    total = values.agg(F.count("*").alias("sample_count"))
    best = counted.where("pattern is not null").orderBy(F.desc("match_count"), "pattern").limit(1)
    out = best.crossJoin(total).withColumn("coverage", F.col("match_count") / F.col("sample_count"))
    out = out.where(f"match_count >= {PATTERN_MATCHES} and coverage >= {PATTERN_COVERAGE}")
    return out.select(F.lit(field).alias("field"), "pattern", "sample_count", "match_count", "coverage", F.size("parts").cast("long").alias("components"))


def segment_overlap(source: DataFrame, field: str, pattern: str, index: int, target: DataFrame, target_field: str, numeric: bool) -> DataFrame:
    """Evidence that the index-th digit run of keys of one pattern refers to a target field; one row or none."""
    every = source.where(F.col(field).isNotNull()).select(X.key_shape(F.col(field)).alias("s"))
    share = every.agg(F.avg(F.coalesce(F.col("s.pattern") == pattern, F.lit(False)).cast("double")).alias("pattern_coverage"))
    shaped = every.where(F.col("s.pattern") == pattern)
    a = shaped.select(X.normalized_value(F.element_at("s.parts", index)["text"], numeric).alias("v")).where("v is not null").distinct()
    raw = target.where(F.col(target_field).isNotNull()).select(X.normalized_value(F.col(target_field), numeric).alias("v"))
    counted = raw.groupBy("v").agg(F.count("*").alias("n"))
    both = a.withColumn("a", F.lit(1)).join(counted.withColumn("b", F.lit(1)), "v", "full")
    out = both.agg(F.count("a").alias("source_distinct"), F.count(F.when(F.col("v").isNotNull(), F.col("b"))).alias("target_distinct"), F.sum("n").alias("target_non_null"), F.count(F.when((F.col("a") == 1) & (F.col("b") == 1), 1)).alias("overlap"))
    out = out.withColumn("source_coverage", F.col("overlap") / F.greatest(F.lit(1), "source_distinct")).withColumn("target_uniqueness", F.col("target_distinct") / F.greatest(F.lit(1), "target_non_null"))
    out = out.where(f"overlap >= {SEGMENT_OVERLAP} and source_coverage >= {SEGMENT_COVERAGE} and target_uniqueness >= {SEGMENT_UNIQUENESS}")
    out = out.crossJoin(share)
    score = F.lit(0.15) + 0.25 * F.col("pattern_coverage") + 0.3 * F.col("source_coverage") + 0.2 * F.col("target_uniqueness") + F.least(F.lit(0.1), F.col("overlap") / 100)
    return out.select(F.lit(field).alias("from_field"), F.lit(target_field).alias("to_field"), F.lit(index).alias("component"), "source_distinct", "target_distinct", "overlap", "pattern_coverage", "source_coverage", "target_uniqueness", F.round(F.least(F.lit(0.95), score), 4).alias("confidence"))


#: Fixed patterns and values: names of key fields, pattern parts, literals that may be a cue, textual native types.
KEY_FIELD = r"(?i)(?:^|_)(?:cd|code|id|identifier|key|ky|no|nr|number)(?:_|$)"
COMPONENT, LITERAL = r"\{digits_\d+:\d+\}", "[A-Za-z]{2,}"
TEXTUAL = ("char", "nchar", "nvarchar", "text", "varchar", "string")


def is_key_pattern(data_type: Column, is_key: Column, label: Column, pattern: Column) -> Column:
    """Whether a text field's pattern is taken for a key: by its role or name, or by two components between two literals."""
    textual = F.trim(F.substring_index(F.lower(data_type), "(", 1)).isin(*TEXTUAL)
    literals = F.regexp_count(F.regexp_replace(pattern, COMPONENT, ""), F.lit(LITERAL))
    return textual & (is_key | label.rlike(KEY_FIELD) | ((F.regexp_count(pattern, F.lit(COMPONENT)) >= 2) & (literals >= 2)))


def matches_target(pattern: Column, index: Column, target_object: Column, target_field: Column) -> Column:
    """Whether the last literal before a pattern's index-th digit run is a word, or the initials, of the target's names."""
    before = F.element_at(F.split(pattern, COMPONENT), index)
    cue = F.upper(F.try_element_at(F.regexp_extract_all(before, F.lit(LITERAL), F.lit(0)), F.lit(-1)))

    def words(label: Column) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(label, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.upper), lambda w: ~w.isin(*X.GENERIC_KEY_TOKENS))

    groups = [words(target_object), words(target_field)]
    initials = [F.array_join(F.transform(g, lambda w: F.substring(w, 1, 1)), "") for g in groups]
    has = F.regexp_count(before, F.lit(LITERAL)) > 0
    return has & F.coalesce(F.array_contains(F.concat(*groups), cue) | F.array_contains(F.array_remove(F.array(*initials), ""), cue), F.lit(False))


def dominant_patterns(values: DataFrame) -> DataFrame:
    """(object, field, pattern, sample_count, match_count, pattern_coverage, components) of values(object, field, value): the most
    frequent shape of each field, if it passes the gates; one aggregation for all fields.
    """
    shaped = values.where("value is not null").select("object", "field", X.key_shape(F.col("value")).alias("s"))
    counted = shaped.groupBy("object", "field", F.col("s.pattern").alias("pattern")).agg(F.count("*").alias("match_count"), F.max(F.size("s.parts")).alias("components"))
    whole = Window.partitionBy("object", "field")
    ranked = counted.withColumn("sample_count", F.sum("match_count").over(whole)).where("pattern is not null")
    best = ranked.withColumn("r", F.row_number().over(whole.orderBy(F.desc("match_count"), "pattern"))).where("r = 1").drop("r")
    out = best.withColumn("pattern_coverage", F.col("match_count") / F.col("sample_count"))
    return out.where(f"sample_count >= {PATTERN_MATCHES} and match_count >= {PATTERN_MATCHES} and pattern_coverage >= {PATTERN_COVERAGE}").select("object", "field", "pattern", "sample_count", "match_count", "pattern_coverage", "components")


def transformed_candidates(values: DataFrame, fields: DataFrame, targets: DataFrame) -> DataFrame:
    """Joins through segments of keys: values(object, field, value) of text fields, fields(object, field, data_type, is_key) and
    targets(object, field, numeric, value) of other objects' keys and first fields.

    Every component of every key pattern meets every target whose names its cue fits, by value; per source field and component the
    best target stays: coverage, uniqueness, overlap, then names.
    """
    patterns = dominant_patterns(values).join(fields, ["object", "field"])
    patterns = patterns.where(is_key_pattern(F.col("data_type"), F.col("is_key"), F.col("field"), F.col("pattern"))).select("object", "field", "pattern", "pattern_coverage", "match_count")
    shaped = values.where("value is not null").select("object", "field", X.key_shape(F.col("value")).alias("s")).withColumn("pattern", F.col("s.pattern"))
    parts = shaped.join(patterns, ["object", "field", "pattern"]).select("object", "field", "pattern", "pattern_coverage", F.explode("s.parts").alias("p"))
    segments = parts.select("object", "field", "pattern", "pattern_coverage", F.col("p.index").alias("component"), F.col("p.text").alias("text"))
    names = segments.select("object", "field", "pattern", "component").distinct()
    places = targets.select(F.col("object").alias("to_object"), F.col("field").alias("to_field"), "numeric").distinct()
    pairs = names.join(places, (F.col("object") != F.col("to_object")) & matches_target(F.col("pattern"), F.col("component"), F.col("to_object"), F.col("to_field")))
    key = ["object", "field", "component", "to_object", "to_field"]
    a = segments.join(pairs, ["object", "field", "pattern", "component"]).select(*key, "pattern", "pattern_coverage", F.when(F.col("numeric"), X.normalized_value(F.col("text"), True)).otherwise(X.normalized_value(F.col("text"), False)).alias("v")).where("v is not null").distinct()
    t = targets.where("value is not null").select(F.col("object").alias("to_object"), F.col("field").alias("to_field"), F.when(F.col("numeric"), X.normalized_value(F.col("value"), True)).otherwise(X.normalized_value(F.col("value"), False)).alias("v"))
    counted = t.groupBy("to_object", "to_field", "v").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("to_object", "to_field").agg(F.count("v").alias("target_distinct"), F.sum("n").alias("target_non_null"))
    met = a.join(counted.where("v is not null").withColumn("hit", F.lit(1)), ["to_object", "to_field", "v"], "left").groupBy(*key, "pattern", "pattern_coverage").agg(F.count("*").alias("source_distinct"), F.count("hit").alias("overlap"))
    out = met.join(sizes, ["to_object", "to_field"]).withColumn("source_coverage", F.col("overlap") / F.greatest(F.lit(1), "source_distinct")).withColumn("target_uniqueness", F.col("target_distinct") / F.greatest(F.lit(1), "target_non_null"))
    out = out.where(f"overlap >= {SEGMENT_OVERLAP} and source_coverage >= {SEGMENT_COVERAGE} and target_uniqueness >= {SEGMENT_UNIQUENESS}")
    best = Window.partitionBy("object", "field", "component").orderBy(F.desc("source_coverage"), F.desc("target_uniqueness"), F.desc("overlap"), "to_object", "to_field")
    out = out.withColumn("r", F.row_number().over(best)).where("r = 1")
    score = F.lit(0.15) + 0.25 * F.col("pattern_coverage") + 0.3 * F.col("source_coverage") + 0.2 * F.col("target_uniqueness") + F.least(F.lit(0.1), F.col("overlap") / 100)
    return out.select(F.col("object").alias("from_object"), F.col("field").alias("from_field"), "component", "pattern", "to_object", "to_field", "overlap", F.round("source_coverage", 6).alias("source_coverage"), F.round(F.least(F.lit(0.95), score), 4).alias("confidence"))


def add_candidates(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges(id, from_object, from_field, to_object, to_field, state, origin) and found ones, as drafts, whose pair has no edge yet."""
    pair = ["from_object", "from_field", "to_object", "to_field"]
    digest = F.substring(F.sha2(F.concat_ws("\n", F.concat_ws("/", "from_object", "from_field"), F.concat_ws("/", "to_object", "to_field")), 256), 1, 20)
    new = found.select(*pair).distinct().join(edges.select(*pair), pair, "left_anti")
    return edges.unionByName(new.select(F.concat(F.lit("relationship_candidate:"), digest).alias("id"), *pair, F.lit("draft").alias("state"), F.lit("profile").alias("origin")))
