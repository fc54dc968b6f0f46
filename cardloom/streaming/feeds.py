"""Streaming forms of sync, job states and rate limits. All can run with availableNow and then end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cardloom.operators.ingest import applied, counters, snapshot_diff


def files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sync_sink(spark: SparkSession, folder: str):
    """A foreachBatch function that applies each micro-batch of notes (note_id, mod, content_hash, synced_at).

    Versions of the table are written side by side: version N comes from N - 1, so a batch that runs again
    after a failure writes the same version again. A feed deletes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("note_id").agg(F.max(F.struct("synced_at", "mod", "content_hash")).alias("x")).select("note_id", "x.mod", "x.content_hash", "x.synced_at")
        old = spark.read.parquet(f"{folder}/v={number - 1}") if number else latest.where("false")
        applied(old, latest, delete_missing=False).write.mode("overwrite").parquet(f"{folder}/v={number}")
        counters(snapshot_diff(old, latest, delete_missing=False)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/counts={number}")

    return run


_STATES = "note_id long, status string, attempts int, last_error string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts, error = state.get if state.exists else ("pending", 0, None)
    for b in batches:
        for e in b.sort_values("at", kind="stable").itertuples():
            if e.event == "start":
                status = "in_progress"
            elif e.event == "done":
                status, error = "done", None
            elif e.event == "failed":
                status, attempts, error = "pending", attempts + 1, e.error
            elif e.event == "enqueue" and status == "done":
                status = "pending"
    state.update((status, attempts, error))
    yield pd.DataFrame({"note_id": [key[0]], "status": [status], "attempts": [attempts], "last_error": [error]})


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after events (note_id, event, at, error): enqueue, start, done, failed.

    A failed job is pending again with one more attempt.
    """
    return events.groupBy("note_id").applyInPandasWithState(_advance, _STATES, "status string, attempts int, last_error string", "update", GroupStateTimeout.NoTimeout)


def rate_windows(events: DataFrame, late: str = "2 minutes", size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """(key, window, requests, tokens) of events (key, ts, tokens) in sliding windows, late ones kept up to the watermark."""
    return events.withWatermark("ts", late).groupBy("key", F.window("ts", size, slide)).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def run_now(df: DataFrame, mode: str, checkpoint: str, path: str | None = None, each=None) -> None:
    """Run a streaming frame over what is there, then end."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()
    q.awaitTermination()


def merged_progress(events: list[dict]) -> dict:
    """Progress events as one: the latest value that is not None of each key, and percent of completed over total."""
    out: dict = {}
    for e in events:
        out.update({k: v for k, v in e.items() if v is not None})
    if out.get("total"):
        out["percent"] = 100.0 * (out.get("completed") or 0) / out["total"]
    return out
