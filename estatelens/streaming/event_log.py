"""Append-only ingestion of runtime events with Structured Streaming.

An extension: batches of events are validated as they arrive, sound ones are appended, others go aside with the rule they
break. Calls seen before within the watermark are dropped, so that a source that sends again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "sequence int, call_id string, kind string, status string, inputs array<string>, consumes array<string>, at timestamp"
#: Kinds of events.
KINDS = ["federated", "mongo", "python", "sql"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(path)


def judged(events: DataFrame) -> DataFrame:
    """events with `rule`: the first rule an event breaks by itself, or null."""
    rule = F.when(F.coalesce(F.col("call_id"), F.lit("")) == "", "call_named").when(~F.col("kind").isin(*KINDS), "kind_known").when(F.col("sequence") < 1, "sequence_positive")
    rule = rule.when(F.col("kind").isin("sql", "mongo") & (F.size("inputs") == 0), "inputs_given").when(F.col("kind").isin("federated", "python") & (F.size("consumes") == 0), "consumes_given")
    return events.withColumn("rule", rule)


def ingest(events: DataFrame, accepted: str, refused: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Append sound events to `accepted` and others to `refused` (Parquet folders), each call once."""
    once = judged(events).withWatermark("at", late).dropDuplicatesWithinWatermark(["call_id"])

    def write(batch: DataFrame, _: int) -> None:
        batch.where("rule is null").drop("rule").write.mode("append").parquet(accepted)
        batch.where("rule is not null").write.mode("append").parquet(refused)

    return once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window start, kind, events) per tumbling window."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), kind, "events")
