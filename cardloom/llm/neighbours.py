"""The k most similar vectors of every vector, within an accepted loss.

Vectors are projected by 2-stable (Gaussian) directions to a few dimensions and indexed by a kd-tree.
Leaves are verified in the order of their projected distance until the chi-square test says that the
rest is farther than the k-th best with the wanted probability. The space is cut into cells (see cells);
which cells have to meet follows from the same test on the projections to the normals of their borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm import cells as S
from cardloom.llm import projections as P
from cardloom.llm.vectors import MARKS, matrix, newest, some, usable
from cardloom.shared import cut

SCHEMA = "model string, note_id long, neighbour_id long, cosine double"

#: Projected dimensions, rows of a leaf, probability of the stopping test.
PROJECTED, LEAF, CERTAINTY = 4, 128, 0.99

#: Rows a cell is planned for.
CELL = 8_000

#: Candidates kept per row beyond k, so that ties within float32 precision are settled in float64.
SPARE = 5

_SENT = "task int, code int, side int, note_id long, floor float, vec array<float>"
_FIRST = "asks boolean, code int, model string, note_id long, neighbour_id long, cosine double, vec array<float>"


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


def _sent(space: S.Space, cell: np.ndarray, side: int | np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array((space.base + cell).astype(np.int32)), pa.array(np.full(n, space.code, np.int32)), pa.array(np.broadcast_to(np.int32(side), n).copy()), pa.array(ids), pa.nulls(n, pa.float32()) if floor is None else pa.array(floor.astype(np.float32)), _vectors(x)]
    return pa.RecordBatch.from_arrays(columns, names=["task", "code", "side", "note_id", "floor", "vec"])


def _by_model(batch: pa.RecordBatch, spaces: dict[str, S.Space]):
    models = batch.column("model").dictionary_encode()
    codes = models.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(models.dictionary.to_pylist()):
        if name in spaces:
            yield spaces[name], np.flatnonzero(codes == i)


def _send(shared, distance: float | None, certainty: float, asking: bool):
    """Rows to their home cell (side 0, or 2 if they ask), and, given a distance, to the cells such a pair may meet in (side 1). A note is sent once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = {s.model: s for s in shared.value}
        for b in batches:
            for space, rows in _by_model(b, spaces):
                part = b.take(pa.array(rows))
                ids = part.column("note_id").to_numpy(zero_copy_only=False)
                first = np.sort(np.unique(ids, return_index=True)[1])
                x, ids = matrix(part.column("vec").take(pa.array(first))), ids[first]
                side = 2 * part.column("asks").to_numpy(zero_copy_only=False)[first].astype(np.int32) if asking else np.zeros(len(ids), np.int32)
                if distance is None:
                    yield _sent(space, S.homes(x, space.pivots), side, ids, x)
                    continue
                start = 0
                for home, i, j in S.visits(x, space, S.reach(distance, x.shape[1], certainty) / 2):
                    end = start + len(home)
                    yield _sent(space, home, side[start:end], ids[start:end], x[start:end])
                    if len(i):
                        yield _sent(space, j, 1, ids[i], x[i])
                    start = end

    return run


def _gather(batches: Iterator[pa.RecordBatch]):
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return t, t["side"].to_numpy(), t["note_id"].to_numpy()


def _once(t: pa.Table, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table, each note once: (row numbers by ascending id, unit vectors)."""
    rows = rows[np.unique(ids[rows], return_index=True)[1]]
    return rows, matrix(t["vec"].take(pa.array(rows)))


def _emit(model: str, ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, top: P.TopK, floor: float):
    """Hits of one side with cosines in float64."""
    r, c, _ = top.hits()
    for s in range(0, len(r), 200_000):
        a, b = r[s : s + 200_000], c[s : s + 200_000]
        u, v = x[a].astype(np.float64), y[b].astype(np.float64)
        cos = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
        ok = (cos >= floor) & (ids[a] != other_ids[b])
        yield pa.RecordBatch.from_arrays([pa.array([model] * int(ok.sum()), pa.string()), pa.array(ids[a][ok]), pa.array(other_ids[b][ok]), pa.array(cos[ok])], names=["model", "note_id", "neighbour_id", "cosine"])


def _floor32(floor: float) -> float:
    return max(-1.1, floor - 2e-6)


def _meet(models: list[str], k: int, floor: float, quantile: float, m: int, leaf: int) -> Callable:
    """One cell: its rows search each other, and they and the guests search each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        if got is None or not (got[1] == 0).any():
            return
        t, side, ids = got
        model = models[t["code"][0].as_py()]
        rows, x = _once(t, np.flatnonzero(side == 0), ids)
        a = P.Index(x, m, leaf)
        home = ids[rows][a.order]
        top_a = P.TopK(len(home), k + SPARE, _floor32(floor))
        P.search_both(a, a, top_a, top_a, True, quantile)
        every, y = home, a.x
        if (side == 1).any():
            rows, g = _once(t, np.flatnonzero(side == 1), ids)
            b = P.Index(g, m, leaf)
            guests = ids[rows][b.order]
            top_b = P.TopK(len(guests), k + SPARE, _floor32(floor))
            P.search_both(a, b, top_a, top_b, False, quantile, shift=len(home))
            yield from _emit(model, guests, b.x, home, a.x, top_b, floor)
            every, y = np.concatenate([home, guests]), np.concatenate([a.x, b.x])
        yield from _emit(model, home, a.x, every, y, top_a, floor)

    return run


def _ask(models: list[str], k: int, floor: float, quantile: float, m: int, leaf: int, again: bool) -> Callable:
    """One cell: the asking rows (side 2, or 1 where they are guests) search its rows.

    Besides hits, unless `again`, every asking row comes out with its k-th best cosine, to ask other cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        if got is None or not (got[1] > 0).any():
            return
        t, side, ids = got
        code = t["code"][0].as_py()
        rows, x = _once(t, np.flatnonzero(side != 1), ids)
        b = P.Index(x, m, leaf)
        known = ids[rows][b.order]
        asking, q = _once(t, np.flatnonzero(side > 0), ids)
        order, _ = P.kd_leaves(q @ P.stable_projection(q.shape[1], m), leaf)
        asking, q = asking[order], q[order]
        least = t["floor"].to_numpy()[asking] if again else np.full(len(asking), _floor32(floor), np.float32)
        top = P.TopK(len(q), k + SPARE + 1, least)  # one more: a query finds itself
        if len(known):
            P.search(q, b, top, quantile, block=leaf)
        for hits in _emit(models[code], ids[asking], q, known, b.x, top, floor):
            n = hits.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(np.full(n, code, np.int32)), *hits.columns, pa.nulls(n, pa.list_(pa.float32()))], names=[c.split()[0] for c in _FIRST.split(", ")])
        if not again:
            n = len(asking)
            best = np.maximum(np.where(np.isfinite(top.cos[:, k]), top.cos[:, k], -1.1), least).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.array(np.full(n, code, np.int32)), pa.array([models[code]] * n, pa.string()), pa.array(ids[asking]), pa.array(ids[asking]), pa.array(best), _vectors(q)], names=[c.split()[0] for c in _FIRST.split(", ")])

    return run


def _further(shared, certainty: float):
    """Asking rows (model, note_id, cosine, vec) to the other cells that may hold a nearer vector than their k-th best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = {s.model: s for s in shared.value}
        for b in batches:
            for space, rows in _by_model(b, spaces):
                part = b.take(pa.array(rows))
                x, ids, floor = matrix(part.column("vec")), part.column("note_id").to_numpy(zero_copy_only=False), part.column("cosine").to_numpy(zero_copy_only=False)
                distance = np.sqrt(np.maximum(2 - 2 * floor, 0))
                for _, i, j in S.visits(x, space, S.reach(distance, x.shape[1], certainty)):
                    if len(i):
                        yield _sent(space, j, 1, ids[i], x[i], floor[i])

    return run


def _searched(known: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(rows to search, sure hits, keys of all rows): the newest row of each note, and of equal vectors the k + 1 smallest note_ids.

    Every further copy has k neighbours of cosine 1 already: the k smallest ids. Vectors are equal if their numbers are.
    """
    rows, keys, every = newest(known)
    often = cut(every.groupBy("model", *MARKS).agg(F.count("*").alias("c")).where(F.col("c") > k + 1).select("model", *MARKS), "often")
    if often.isEmpty():
        return rows.select("model", "note_id", "vec"), None, every
    copies = cut(keys.join(some(often), ["model", *MARKS]).select("model", *MARKS, "note_id").distinct(), "copies")
    place = F.row_number().over(Window.partitionBy("model", *MARKS).orderBy("note_id"))
    first = copies.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("model", *MARKS).agg(F.sort_array(F.collect_list("note_id")).alias("ids")).where(F.size("ids") == k + 1)
    crowded = some(cut(first.select("model", *MARKS, "ids", F.element_at("ids", -1).alias("last")), "crowded"))
    rows = rows.join(crowded.select("model", *MARKS, "last"), ["model", *MARKS], "left").where("last is null or note_id <= last")
    sure = copies.join(crowded, ["model", *MARKS]).where("note_id > last").select("model", "note_id", F.explode(F.slice("ids", 1, k)).alias("neighbour_id"), F.lit(1.0).alias("cosine"))
    return rows.select("model", "note_id", "vec"), sure, every


def nearest(vectors: DataFrame, k: int, min_cosine: float | None = None, query: Column | None = None, dims: dict[str, int] | None = None, certainty: float = CERTAINTY, cell: int = CELL) -> DataFrame:
    """(model, note_id, neighbour_id, cosine, place): the k most similar other notes of each note, per model.

    Only usable vectors count (see vectors.usable), of each (note_id, model) the newest, of equally new
    ones that of the greatest digest. min_cosine bounds the search: less similar notes are no neighbours. query, a condition
    on note_id, picks the notes searched for; neighbours come from all. certainty is the probability with
    which a test keeps a true neighbour. place runs from 1 by falling cosine, then by note_id; of more
    than k notes equally similar within float32 precision any may be kept, of equal vectors those of the
    smallest ids. A note alone in its model has no row; an empty table gives none.

    Rows go to their home cell. With min_cosine alone each row also visits the cells such a pair may lie
    in; otherwise queries search their home cell first, and then the cells that may hold a nearer note
    than the k-th best found. Cells hold about `cell` rows, hot ones are split by pivots of their own, and
    of a vector's copies only k + 1 are sent.
    """
    spark = vectors.sparkSession
    known = usable(vectors, dims)
    rows, sure, keys = _searched(known, k)
    spaces, tasks = S.fit(known, keys, cell)
    if not tasks:
        return spark.createDataFrame([], SCHEMA + ", place int")
    models = [s.model for s in spaces]
    shared = spark.sparkContext.broadcast(spaces)
    quantile, floor = P.chi2_quantile(certainty, PROJECTED), -1.1 if min_cosine is None else float(min_cosine)
    shape = (models, k, floor, quantile, PROJECTED, LEAF)
    if query is None and min_cosine is not None:
        sent = rows.mapInArrow(_send(shared, float(np.sqrt(max(0.0, 2 - 2 * floor))), certainty, False), _SENT)
        found = sent.repartitionById(tasks, "task").mapInArrow(_meet(*shape), SCHEMA)
    else:
        asks = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
        sent = rows.withColumn("asks", asks).mapInArrow(_send(shared, None, certainty, True), _SENT)
        first = cut(sent.repartitionById(tasks, "task").mapInArrow(_ask(*shape, False), _FIRST), "first")
        found = first.where("not asks")
        if tasks > len(models):
            guests = first.where("asks").mapInArrow(_further(shared, certainty), _SENT)
            data = rows.mapInArrow(_send(shared, None, certainty, False), _SENT)
            found = found.unionByName(data.unionByName(guests).repartitionById(tasks, "task").mapInArrow(_ask(*shape, True), _FIRST))
        found = found.select("model", "note_id", "neighbour_id", "cosine")
    if sure is not None:
        found = found.unionByName(sure if query is None else sure.where(query))
    # two cells may have found a pair; both steps need the rows of a note together
    once = found.repartition("model", "note_id").groupBy("model", "note_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("model", "note_id").orderBy(F.desc("cosine"), "neighbour_id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def near_pairs(vectors: DataFrame, k: int = 5, min_cosine: float = 0.95, dims: dict[str, int] | None = None, **options) -> DataFrame:
    """(model, note_id_a, note_id_b): pairs at least so similar of which one is among the other's k nearest."""
    n = nearest(vectors, k, min_cosine, dims=dims, **options)
    return n.select("model", F.least("note_id", "neighbour_id").alias("note_id_a"), F.greatest("note_id", "neighbour_id").alias("note_id_b")).distinct()
