"""Reading note vectors: which can be used, and their Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.shared import cut

#: Numbers per vector of each model.
MODEL_DIMS = {"quill-embed-8b": 64, "tern-embed-2": 64, "finch-300m": 48}


def usable(vectors: DataFrame, dims: dict[str, int] | None = None) -> DataFrame:
    """(model, note_id, updated_at, vec) of the rows whose vector can be used, superseded ones included.

    A vector can be used if it has its model's count of numbers, all of them finite and not all zero;
    stored norm and dim are not read. dims maps models to that count, others are left out; without dims
    it is the commonest count of each model (of equally common ones the greatest). Rows without model or
    note_id are left out, as are unusable vectors; extra columns are ignored.
    """
    rows = vectors.select("model", F.col("note_id").cast("long").alias("note_id"), F.coalesce(F.col("updated_at").cast("long"), F.lit(-(2**62))).alias("updated_at"), "vec").where("model is not null and note_id is not null and vec is not null")
    if dims is None:
        counts = rows.groupBy("model", F.size("vec").alias("n")).agg(F.count("*").alias("c")).where("n > 0")
        best = counts.groupBy("model").agg(F.max(F.struct("c", "n")).alias("b")).select("model", F.col("b.n").alias("n")).collect()  # a row per model
        dims = {r["model"]: r["n"] for r in best}
    want: Column = F.lit(None).cast("int")
    for model, n in dims.items():
        want = F.when(F.col("model") == model, n).otherwise(want)
    # the sum of absolute values is NaN, infinite or null exactly if a number is; it is 0 if all are
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x))
    return rows.where(F.size("vec") == want).where(total.isNotNull() & ~F.isnan(total) & (total < float("inf")) & (total > 0))


#: Rows up to which a table of keys is broadcast; more are joined by a shuffle.
FEW_KEYS = 500_000

MARKS = ["h1", "h2"]


def some(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW_KEYS else rows


def newest(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, keys, all keys): the newest row of each (model, note_id), with 128-bit digests (h1, h2) of its numbers.

    Of equally new rows the one of the greatest digest; rows that repeat it stay. keys are the rows without
    vec, all keys those of superseded rows too; both are written. Only the repeated keys are joined to the vectors.
    """
    marked = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64("vec", F.lit(1))})
    version = F.struct("updated_at", *MARKS)
    every = cut(marked.drop("vec"), "keys")
    repeated = cut(every.groupBy("model", "note_id").agg(F.count("*").alias("c"), F.max(version).alias("best")).where("c > 1").select("model", "note_id", "best"), "repeated")
    few = some(repeated)
    last = lambda df: df.join(few, ["model", "note_id"], "left").where(F.col("best").isNull() | (version == F.col("best"))).drop("best")
    return last(marked), last(every), every


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths as unit rows in float32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(n, -1) if n else flat.reshape(0, 1)
    big = np.abs(x).max(1, initial=0)[:, None]  # first to the scale of one: squares of huge or tiny numbers would not fit
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def latest(ids: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row numbers of the newest row of each id, by ascending id; of equally new rows the greatest vector."""
    keys = [x[:, j] for j in range(min(4, x.shape[1]))][::-1] if len(ids) else []
    order = np.lexsort((*keys, at, ids))
    last = np.ones(len(order), bool)
    last[:-1] = ids[order][1:] != ids[order][:-1]
    return order[last]
