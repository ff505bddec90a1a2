"""Streaming intake of erasure requests and of job events, with keyed state in Spark's state store.

State per key lives in the state store of the query, so a micro-batch touches the keys of its own rows and
nothing else. Every batch writes what changed to a folder of its own, so a repeated
batch overwrites itself and an interrupted one leaves the earlier folders as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factsieve import schemas, settings

HORIZON = "1 day"  # how far requests and events may come behind the newest seen before they are dropped


def request_files(spark: SparkSession, inbox: str, max_files: int = 1000) -> DataFrame:
    """Request files of a folder as a stream: request_id (file name), entity, attribute, received_at (file time)."""
    return (
        spark.readStream.schema(schemas.REQUEST_FILE).option("multiLine", True).option("maxFilesPerTrigger", max_files).json(inbox)
        .select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "").alias("request_id"),
                "entity", "attribute", F.col("_metadata.file_modification_time").alias("received_at"))
    )


def _started(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_requests(requests: DataFrame, out: str, checkpoint: str, validate: Callable[[DataFrame], DataFrame],
                    horizon: str = HORIZON, available_now: bool = True) -> StreamingQuery:
    """Validate requests (request_id, entity, attribute, received_at) as they come and append them to ``out``
    with a verdict. Of requests with one id the first to come counts.

    Ids are remembered until ``horizon`` after their request's time; one that comes again later is a new
    request. Requests that come more than ``horizon`` behind the newest are dropped. Earlier results are
    never read.
    """
    first = requests.withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(["request_id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the lists that validation builds are used more than once; the batch itself must not be read again
        batch = batch.drop("received_at").persist()
        try:
            validate(batch).withColumn(
                "verdict", F.when(F.col("status") == "accepted", "accepted").otherwise("rejected")
            ).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    return _started(first, handle, checkpoint, "append", available_now)


def _latest_first(created: str = "created_us", job: str = "job_id", status: str = "status") -> Column:
    """Order of events: by time, then job, then status, missing ones last."""
    return F.struct(created, F.col(job).isNull(), job, F.col(status).isNull(), status)


def stream_job_status(events: DataFrame, out: str, checkpoint: str, timeout_seconds: int, key: str = "request_id",
                      horizon: str = HORIZON, available_now: bool = True, span: str = "1 day") -> StreamingQuery:
    """Latest status per key from a stream of job events (key, job_id, status, created_at).

    State is Spark's own aggregate, the latest event and the number of events of a key per ``span`` of event time,
    so no Python runs per key and a key with a large share of the events costs a row per task. Event time is the
    newest event less ``horizon``; a span that ended before it is forgotten by the state store, and events that
    come for it are dropped. With a change goes the time at which its key becomes stale, if its status is an
    active one: when event time is ``timeout_seconds`` past it. ``read_job_status`` compares that with the newest
    event, so keys that time out cost nothing while the stream runs, and later events make them current again.
    """
    rows = events.select(F.col(key).cast("string").alias(key), F.col("created_at").cast("timestamp").alias("created_at"), "job_id", "status")
    timed = rows.withColumn("created_us", F.unix_micros("created_at")).withWatermark("created_at", horizon)
    latest = timed.groupBy(key, F.window("created_at", span).alias("w")).agg(F.max(_latest_first()).alias("e"), F.count(F.lit(1)).alias("n_events"))
    behind = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {horizon})")
    # in milliseconds, as Spark's watermark
    due = (F.floor(F.col("e.created_us") / 1000) + 1000 * timeout_seconds) * 1000 + behind
    changes = latest.select(key, F.unix_micros("w.start").alias("span_us"), "e.created_us", "e.job_id", "e.status", "n_events",
                            F.when(F.col("e.status").isin(*settings.ACTIVE_STATUSES), due).cast("long").alias("due_us"))
    return _started(changes, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint, "update", available_now)


def read_job_status(spark: SparkSession, out: str, key: str = "request_id") -> DataFrame:
    """Current state: of each key's spans the last change, of these the latest event, with status ``stale`` for keys
    that have timed out."""
    changes = spark.read.schema(f"{key} string, span_us long, created_us long, job_id string, status string, n_events long, due_us long, batch long").parquet(out)
    spans = changes.groupBy(key, "span_us").agg(F.max_by(F.struct("created_us", "job_id", "status", "n_events", "due_us"), "batch").alias("c")).select(key, "c.*")
    now = spans.groupBy(key).agg(F.max_by(F.struct("created_us", "status", "due_us"), _latest_first()).alias("e"), F.sum("n_events").alias("n_events"))
    newest = changes.agg(F.floor(F.max("created_us") / 1000) * 1000).scalar()
    return now.select(key, F.when(F.col("e.due_us") < newest, "stale").otherwise(F.col("e.status")).alias("status"),
                      F.col("e.status").alias("last_status"), F.timestamp_micros("e.created_us").alias("updated_at"), "n_events")
