"""Distributed prefix sums: a range sort, sums within each range, and offsets of the ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.shared import cut, shuffle_width


def _within(group: list[str], weight: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            w = np.ones(n, np.int64) if weight is None else b.column(weight).to_numpy(zero_copy_only=False)
            starts = np.zeros(n, bool)
            for g in group:
                codes = b.column(g).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                starts[1:] |= codes[1:] != codes[:-1]
            total = np.concatenate(([0], np.cumsum(w)))
            first = tuple(b.column(g)[0].as_py() for g in group)
            heads = np.flatnonzero(starts)
            base = np.zeros(n, np.int64)
            base[heads] = total[heads]
            base = np.maximum.accumulate(base)
            before = total[:-1] - base
            if first == last:
                before[: heads[0] if len(heads) else n] += carry
            last = tuple(b.column(g)[n - 1].as_py() for g in group)
            carry = int(before[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(before)], names=[*b.schema.names, "part", "local"])

    return run


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """rows with `before`: the sum of weight (a non-negative long; 1 if None) over the rows before it in its group.

    Rows are range-partitioned by group and order, so a hot group spreads over many tasks as far as
    `order` tells its rows apart. Group columns are not null. The offsets that are broadcast are a row
    per range and group that meet: at most the ranges plus the groups.
    """
    by = [*group, *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, local long"
    sorted_rows = rows.repartitionByRange(shuffle_width(rows.sparkSession), *by).sortWithinPartitions(*by)
    done = cut(sorted_rows.mapInArrow(_within(group, weight), schema), "prefix")
    sums = done.groupBy(*group, "part").agg((F.count("*") if weight is None else F.sum(weight)).alias("s"))
    w = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "part", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("offset"))
    joined = done.join(F.broadcast(offsets), [*group, "part"])
    return joined.select(*rows.columns, (F.col("local") + F.col("offset")).alias("before"))
