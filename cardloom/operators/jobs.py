"""Embedding jobs: what to enqueue, states, rates and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T


def front_hashes(fronts: DataFrame) -> DataFrame:
    """(note_id, hash) of non-empty front texts."""
    return fronts.select("note_id", T.plain(F.col("front")).alias("text")).where("text <> ''").select("note_id", F.sha2("text", 256).alias("hash"))


def to_enqueue(hashes: DataFrame, vectors: DataFrame, rebuild: bool = False) -> DataFrame:
    """(note_id, hash, reason): notes whose vector is missing or of another text; with rebuild all."""
    have = vectors.groupBy("note_id").agg(F.max("hash").alias("had"), F.lit(True).alias("known"))
    rows = hashes.join(have, "note_id", "left").withColumn("reason", F.when(F.col("known").isNull(), "missing").when(~F.col("had").eqNullSafe(F.col("hash")), "stale").when(F.lit(rebuild), "rebuild"))
    return rows.where("reason is not null").select("note_id", "hash", "reason")


def after_attempt(jobs: DataFrame) -> DataFrame:
    """Jobs (note_id, status, attempts, outcome, error): done, or back to pending with one more attempt and the error."""
    fail = F.col("outcome") == "failed"
    return jobs.select("note_id", F.when(fail, "pending").when(F.col("outcome") == "done", "done").otherwise(F.col("status")).alias("status"), (F.col("attempts") + F.when(fail, 1).otherwise(0)).alias("attempts"), F.when(fail, F.col("error")).alias("last_error"))


def reset_stuck(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def next_jobs(jobs: DataFrame, k: int) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy("enqueued_at", "note_id").limit(k)


def rolling_rate(events: DataFrame, key: str, at: str, tokens: str, seconds: int = 60) -> DataFrame:
    """events with the requests and tokens of the last `seconds` up to each, per key. at is in whole seconds."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0)
    return events.withColumn("requests", F.count("*").over(w)).withColumn("tokens_in_window", F.sum(tokens).over(w))


def progress(notes: DataFrame, vectors: DataFrame, jobs: DataFrame, rate: float) -> DataFrame:
    """(total, embedded, pending, errors, remaining, eta): eta in seconds, rounded half up; null without a rate."""
    total = notes.agg(F.countDistinct("note_id").alias("total"))
    done = vectors.agg(F.countDistinct("note_id").alias("embedded"))
    states = jobs.agg(F.count_if(F.col("status").isin("pending", "in_progress")).alias("pending"), F.count_if(F.col("status") == "error").alias("errors"))
    row = total.join(F.broadcast(done)).join(F.broadcast(states))  # one row each
    left = F.greatest(F.col("total") - F.col("embedded"), F.lit(0))
    return row.withColumn("remaining", left).withColumn("eta", F.when(F.lit(rate > 0), F.floor(left / F.lit(float(rate or 1)) + 0.5)).cast("long"))


def progress_of_models(notes: DataFrame, vectors: DataFrame, jobs: DataFrame, rates: DataFrame) -> DataFrame:
    """(backend, model, total, embedded, pending, errors, rate, eta) of every configured model: rates (backend, model, rate); eta is 0 without a rate.

    A vector counts once per note, a job by its own state.
    """
    key = ["backend", "model"]
    total = notes.where("note_id is not null").agg(F.countDistinct("note_id").alias("total"))
    done = vectors.where("note_id is not null").groupBy(*key).agg(F.countDistinct("note_id").alias("embedded"))
    states = jobs.groupBy(*key).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "error").alias("errors"))
    rows = rates.join(F.broadcast(total)).join(done, key, "left").join(states, key, "left").na.fill(0, ["embedded", "pending", "errors", "rate"])  # one row of totals
    left = F.greatest(F.col("total") - F.col("embedded"), F.lit(0))
    return rows.withColumn("eta", F.when(F.col("rate") > 0, F.floor(left / F.col("rate") + 0.5)).otherwise(0).cast("long"))


def rehashed(vectors: DataFrame, hashes: DataFrame, scheme: str | None) -> DataFrame:
    """vectors with the hash of their note's front text where the stored scheme is an older one; other columns, and vectors of notes without a row in hashes, stay.

    hashes has (note_id, hash) of existing notes, the empty front included; see notes.with_front and text_hash.
    """
    if scheme == "front_v1":
        return vectors
    return vectors.join(hashes.select("note_id", F.col("hash").alias("_new")), "note_id", "left").withColumn("hash", F.coalesce("_new", "hash")).drop("_new").select(*vectors.columns)


def run_rate(jobs: DataFrame, started: str, finished: str) -> DataFrame:
    """(processed, elapsed, rate): rate per second of at least one."""
    row = jobs.where(F.col(finished).isNotNull()).agg(F.count("*").alias("processed"), (F.max(finished) - F.min(started)).alias("elapsed"))
    return row.withColumn("rate", F.col("processed") / F.greatest(F.lit(1), F.col("elapsed")))


def worker_plan(backend: str, workers: int | None = None, batch: int | None = None) -> tuple[int, int]:
    """(partitions, batch size) within each backend's bounds."""
    # Default and greatest workers, default and greatest batch per backend.
    bounds = {"hosted": (200, 200, 8, 16), "batchapi": (100, 3000, 8, 32), "local": (4, 4, 16, 64)}
    w, most_w, b, most_b = bounds[backend]
    return max(1, min(most_w, workers or w)), max(1, min(most_b, batch or b))
