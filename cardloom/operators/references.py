"""References whose note is absent, was deleted, or came after the row that names it.

Parents are range-partitioned by key together with the references. In each range the parents form
sorted arrays, and every Arrow batch of references is probed against them by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "table_name string, note_id long, kind string, n_rows long"

#: Keys of one range: some 100 MB of sorted parents in a task.
RANGE = 4_000_000

_NONE = np.iinfo(np.int64).max


def _references(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(table_name, note_id, n_rows, first_at): one row per table and key, aggregated before the range shuffle."""
    out = None
    for name, (df, when) in tables.items():
        at = F.min(F.col(when).cast("long")) if when else F.lit(None).cast("long")
        part = df.where(F.col("note_id").isNotNull()).groupBy(F.col("note_id").cast("long").alias("note_id")).agg(F.count("*").alias("n_rows"), at.alias("first_at")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _parents(notes: DataFrame, deletions: DataFrame) -> DataFrame:
    """(note_id, first_at, present, deleted): one row per key known to either parent table."""
    a = notes.where("note_id is not null").groupBy("note_id").agg(F.min("fetched_at").alias("first_at")).select("note_id", "first_at", F.lit(True).alias("present"), F.lit(False).alias("deleted"))
    b = deletions.where("note_id is not null").groupBy("note_id").agg(F.lit(None).cast("long").alias("first_at")).select("note_id", "first_at", F.lit(False).alias("present"), F.lit(True).alias("deleted"))
    return a.unionByName(b)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its parent rows come first in key order, then its references."""
    present: list[np.ndarray] = []
    since: list[np.ndarray] = []
    deleted: list[np.ndarray] = []
    index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    names = [f.split()[0] for f in FOUND.split(", ")]
    for batch in batches:
        role = batch.column("role").to_numpy(zero_copy_only=False)
        key = batch.column("note_id").to_numpy(zero_copy_only=False)
        at = batch.column("first_at").fill_null(_NONE).to_numpy(zero_copy_only=False)
        n = int(np.searchsorted(role, 2))  # sorted by role
        here = role[:n] == 0
        if n:
            present.append(key[:n][here])
            since.append(at[:n][here])
            deleted.append(key[:n][~here])
        if n == len(role):
            continue
        if index is None:
            cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            index = cat(present), cat(since), cat(deleted)
        keys, at_note, gone = index
        ref, seen = key[n:], at[n:]

        def hit(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pos = np.searchsorted(sorted_keys, ref)
            inside = np.minimum(pos, max(0, len(sorted_keys) - 1))
            return inside, (sorted_keys[inside] == ref if len(sorted_keys) else np.zeros(len(ref), bool))

        pos, known = hit(keys)
        _, was_deleted = hit(gone)
        fetched = at_note[pos] if len(keys) else np.full(len(ref), _NONE)
        late = known & (seen != _NONE) & (fetched != _NONE) & (seen < fetched)
        bad = ~known | late
        if not bad.any():
            continue
        kind = np.where(known, "late", np.where(was_deleted, "deleted", "missing"))[bad]
        take = pa.array(np.flatnonzero(bad) + n)
        columns = [batch.column("table_name").take(take), pa.array(ref[bad]), pa.array(kind.astype(object), pa.string()), batch.column("n_rows").take(take)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def orphan_references(tables: Mapping[str, tuple[DataFrame, str | None]], notes: DataFrame, deletions: DataFrame, ranges: int | None = None) -> DataFrame:
    """(table_name, note_id, kind, n_rows) for every reference without a fitting parent.

    tables maps a name to (table, time column or None). kind is "deleted" (absent from notes, in
    deletions), "missing" (in neither) or "late" (only for tables with a time column: in notes, but a
    row's time lies before the note's first fetched_at). n_rows counts the rows behind the reference.
    A null key is no reference; a null time is never late, nor is a note whose fetched_at are all null.
    Repeated rows count in n_rows; empty parents make every reference missing; other columns are ignored.
    Keys are aggregated before the range shuffle, so a hot key arrives as one row per table.
    """
    spark = notes.sparkSession
    parent = _parents(notes, deletions).select(F.when(F.col("present"), 0).otherwise(1).alias("role"), "note_id", "first_at", F.lit(None).cast("string").alias("table_name"), F.lit(0).cast("long").alias("n_rows"))
    refs = _references(tables).select(F.lit(2).alias("role"), "note_id", "first_at", "table_name", "n_rows")
    rows = parent.unionByName(refs)
    # counts of whole tables come from their files' footers; a range gets some RANGE keys at most
    most = sum(df.count() for df in (notes, deletions, *(t for t, _ in tables.values())))
    width = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // RANGE))
    return rows.repartitionByRange(width, "note_id").sortWithinPartitions("role", "note_id").mapInArrow(_probe, FOUND)


def month_of_id(note_id: Column) -> Column:
    """yyyy-MM of an epoch-millisecond id, in UTC whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(note_id / 86_400_000).cast("int"))
    return F.format_string("%04d-%02d", F.year(day), F.month(day))


def orphan_report(found: DataFrame) -> DataFrame:
    """(table_name, month, kind, n_ids, n_rows): misses per table and month of the id."""
    return found.groupBy("table_name", month_of_id(F.col("note_id")).alias("month"), "kind").agg(F.count("*").alias("n_ids"), F.sum("n_rows").alias("n_rows"))
