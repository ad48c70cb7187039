"""Event envelopes as a stream: decode, gate, deduplicate, route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.dedup import uuid_key

#: Event types and the version that is understood.
EVENT_TYPES = ["AnalysisRequested", "AnalysisFailed", "Epic1Completed", "Epic2Completed", "Epic3Completed", "Epic4Completed"]
VERSION = 1


def envelope_stream(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def gate(events: DataFrame) -> DataFrame:
    """``ok`` and ``reason``: both ids of 8 characters at least, a known type and the understood version."""
    short = F.coalesce(F.length(F.trim("correlationId")), F.lit(0)) < 8
    reason = (
        F.when(uuid_key(F.col("eventId")).isNull() | short, "id").when(~F.coalesce(F.col("eventType").isin(EVENT_TYPES), F.lit(False)), "type").when(F.coalesce(F.col("eventVersion"), F.lit(0)) != VERSION, "version")
    )
    return events.withColumn("reason", reason).withColumn("ok", reason.isNull())


#: Fields that each type's payload must hold, those that only some values may have, and defaults.
_RUN = ["runId", "projectId", "branch", "commitSha", "refName", "refType", "githubUrl"]
REQUIRED = {
    "AnalysisRequested": ["runId", "projectId", "githubUrl", "commitSha", "refName", "refType"], "Epic1Completed": _RUN, "Epic2Completed": _RUN, "Epic3Completed": _RUN,
    "Epic4Completed": _RUN, "AnalysisFailed": ["runId", "projectId", "failedStage", "errorMessage", "retryCount"],
}
TRIGGERS = ["manual", "push", "pull_request", "system"]
STAGES = ["epic1", "epic2", "epic3", "epic4"]


def typed_payloads(events: DataFrame) -> DataFrame:
    """``payload_ok`` and ``missing``: does the payload hold what its event type asks for.

    ``missing`` lists required fields that are null and fields with values
    beyond the known ones; unknown types have no payload and aren't ok.
    """
    none = F.array().cast("array<string>")
    lacks = none
    for kind, fields in REQUIRED.items():
        lacks = F.when(F.col("eventType") == kind, F.array(*(F.when(F.col(f"payload.{f}").isNull(), F.lit(f)) for f in fields))).otherwise(lacks)
    failed = F.col("eventType") == "AnalysisFailed"
    odd = F.array(
        F.when(~failed & ~F.col("payload.triggerType").isin(TRIGGERS), F.lit("triggerType")),
        F.when(failed & ~F.col("payload.failedStage").isin(STAGES), F.lit("failedStage")),
        F.when(failed & (F.col("payload.errorMessage") == ""), F.lit("errorMessage")),
        F.when(failed & (F.col("payload.retryCount") < 0), F.lit("retryCount")),
    )
    missing = F.array_sort(F.array_distinct(F.filter(F.concat(lacks, odd), lambda x: x.isNotNull())))
    known = F.coalesce(F.col("eventType").isin(EVENT_TYPES), F.lit(False))
    return events.withColumn("missing", missing).withColumn("payload_ok", known & (F.size(missing) == 0))


def unique_events(events: DataFrame, delay: str = "1 day", time: str = "received_at") -> DataFrame:
    """One event per id and correlation within the watermark, as in storage: ids are reused; state is bounded by time."""
    keyed = events.withColumn("_t", F.col(time).cast("timestamp")).withColumn("_key", uuid_key(F.col("eventId")))
    return keyed.withWatermark("_t", delay).dropDuplicatesWithinWatermark(["_key", "correlationId"]).drop("_key")


def route(events: DataFrame, accepted: str, rejected: str, checkpoint: str, trigger: dict | None = None):
    """Write accepted and rejected events to two tables, each batch once: a batch written again replaces its own folder."""

    def both(batch: DataFrame, no: int) -> None:
        batch.persist()
        batch.where("ok").write.mode("overwrite").parquet(f"{accepted}/batch={no}")
        batch.where("not ok").write.mode("overwrite").parquet(f"{rejected}/batch={no}")
        batch.unpersist()

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, size: str = "1 day", delay: str = "2 days", time: str = "received_at") -> DataFrame:
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    return t.groupBy(F.window("_t", size), "eventType").agg(F.count(F.lit(1)).alias("events"))


def make_envelope(payload: DataFrame, event_type: str, parent: Callable | None = None) -> DataFrame:
    """An envelope around ``payload`` rows; correlation and trace are carried over, the id is new."""
    keep = [c for c in payload.columns if c not in ("correlationId", "traceId")]
    return payload.select(
        F.expr("uuid()").alias("eventId"), F.lit(event_type).alias("eventType"), F.lit(VERSION).alias("eventVersion"), "correlationId", "traceId",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.struct(*keep).alias("payload"),
    )
