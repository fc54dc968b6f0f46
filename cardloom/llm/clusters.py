"""Clusters of mutually similar vectors: neighbour descent, then communities of high modularity.

1. A bounded sample gives each model pivots, which cut its space into cells (see cells). A vector goes to its
   home cell and, as a guest, to the cells where vectors near enough for an edge may lie.
2. In each cell neighbour descent builds the graph of similar vectors, and modularity-based community
   detection cuts it into pieces.
3. Pieces of different cells are linked by their guests; the graph of pieces is merged by modularity
   gains in distributed rounds, and so are communities whose mean directions are too near.
4. Every vector is tested against the mean direction of its community. Vectors that fail, that have no edge, or
   whose community stays too small are compared with the mean directions of all communities of their model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm import cells as S
from cardloom.llm import graphs as G
from cardloom.llm.vectors import matrix, newest, some, usable
from cardloom.shared import cut

#: Rows a cell is planned for, and the probability with which a pair of an edge's least cosine meets in some cell.
CELL, CERTAINTY = 4_000, 0.9

#: Neighbours per vector, least cosine of an edge, resolution of the modularity.
NEIGHBOURS, EDGE, RESOLUTION = 12, 0.55, 1.0

#: Least length of the mean of a piece's unit vectors, and least cosine of the means of pieces that may join.
COHERENT, LINK = 0.75, 0.6

#: Mean directions that are sent to all tasks at once: 200,000 of 64 numbers are some 50 MB.
MEANS = 200_000

#: A community whose mean has this cosine with another mean has rivals: its notes are compared with all means.
RIVAL = 0.5

#: Linked rows from which a community may join several others that are near; a smaller one joins the nearest only.
FIRM = 3


_SENT = "task int, code int, home boolean, note_id long, copies array<long>, vec array<float>"


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))


def _vectors(x: np.ndarray) -> pa.Array:
    return _lists(x.ravel(), np.full(len(x), x.shape[1]))


def _send(spaces, distance: float, certainty: float):
    """Rows to their home cell and to those that a pair of this distance may meet in; notes of equal vectors in a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {s.model: s for s in spaces.value}
        for b in batches:
            models = np.array(b.column("model").to_pylist(), object)
            for model in dict.fromkeys(models):
                rows = np.flatnonzero(models == model)
                space = by_name[model]
                part = b.take(pa.array(rows))
                x = matrix(part.column("vec"))
                ids = part.column("note_id").to_numpy(zero_copy_only=False)
                key = S.digest(x)
                by = np.lexsort((ids, key))
                head = np.ones(len(by), bool)
                head[1:] = key[by][1:] != key[by][:-1]
                x, note, others = x[by[head]], ids[by[head]], pa.array(ids[by[~head]])
                starts = np.append(np.flatnonzero(head), len(by))
                copies = pa.ListArray.from_arrays(pa.array((starts - np.arange(len(starts))).astype(np.int32)), others)
                start = 0
                for home, i, j in S.visits(x, space, S.reach(distance, x.shape[1], certainty) / 2):
                    own = np.arange(start, start + len(home))
                    start += len(home)
                    for cell, rows, at_home in ((home, own, True), (j, i, False)):
                        if len(rows):
                            n = len(rows)
                            columns = [pa.array((space.base + cell).astype(np.int32)), pa.array(np.full(n, space.code, np.int32)), pa.array(np.full(n, at_home)), pa.array(note[rows]), copies.take(pa.array(rows)), _vectors(x[rows])]
                            yield pa.RecordBatch.from_arrays(columns, names=["task", "code", "home", "note_id", "copies", "vec"])

    return run


_PIECES = "kind int, code int, note_id long, piece long, weight double, task int, n int, vec array<float>"


def _cell(batches: Iterator[pa.RecordBatch], edges: bool = False) -> Iterator[pa.RecordBatch]:
    """Graph and pieces of one cell.

    kind 0: a home row with its piece, weighted degree and vector; kind 1: a guest of a
    piece with the weight of its edges to it; kind 2: a piece with its home rows and their vector sum;
    kind 4: a home row without an edge, with its vector.
    With edges, kind 3: a note, as `piece` a neighbour in the cell and the weight of their edge; copies of the
    note count as one edge to itself. A piece is named by its smallest home note_id. Notes of equal vectors are one node of the graph, which
    counts as often in numbers and sums; without other edges they are a piece of their own.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    copies = t["copies"].combine_chunks()
    row = np.concatenate([np.arange(len(t)), np.repeat(np.arange(len(t)), copies.value_lengths().to_numpy(zero_copy_only=False))])
    notes = np.concatenate([t["note_id"].to_numpy(), copies.flatten().to_numpy(zero_copy_only=False)])
    at_home = t["home"].to_numpy(zero_copy_only=False)[row]
    x = matrix(t["vec"])
    by = np.lexsort((S.digest(x)[row], ~at_home, notes))
    first = np.ones(len(by), bool)
    first[1:] = notes[by][1:] != notes[by][:-1]
    by = by[first]  # a note once, as home row if it is one
    row, notes, at_home = row[by], notes[by], at_home[by]
    _, one, node_of = np.unique(S.digest(x)[row], return_index=True, return_inverse=True)
    x, ids, n = x[row[one]], notes[one], len(one)  # notes ascend, so ids has the smallest of each node
    home = np.bincount(node_of, at_home, n) > 0
    times = np.bincount(node_of, minlength=n)
    code, task = t["code"][0].as_py(), t["task"][0].as_py()
    empty = np.empty(0, np.int64)
    a, b, w = G.graph(*G.neighbour_descent(x, min(NEIGHBOURS, n - 1)), EDGE) if n > 1 else (empty, empty, np.empty(0))
    label = G.coherent_communities(x, a, b, w, RESOLUTION, COHERENT)
    m = int(label.max()) + 1
    big = np.iinfo(np.int64).max
    name = np.full(m, big)
    np.minimum.at(name, label[home], ids[home])
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    degree = np.where(times > 1, np.maximum(degree, 1.0), degree)
    same = label[a] == label[b]
    mixed = same & (home[a] != home[b])
    guest, size = np.where(home[a], b, a)[mixed], n
    link = np.bincount(guest, w[mixed], size)
    node = np.flatnonzero((home & (degree > 0))[node_of])
    of = node_of[node]
    visitor = np.flatnonzero(~home & (link > 0) & (name[label] != big))
    members = np.flatnonzero(home & (degree > 0))
    sums = np.zeros((m, x.shape[1]))
    np.add.at(sums, label[members], x[members] * times[members, None])
    count = np.bincount(label[members], times[members], m).astype(np.int64)
    pieces = np.flatnonzero((count > 0) & (name != big))

    def rows(kind: int, note: np.ndarray, piece: np.ndarray, weight: np.ndarray, number: np.ndarray, vec: pa.Array) -> pa.RecordBatch:
        k = len(piece)
        full = lambda v: pa.array(np.full(k, v, np.int32))
        return pa.RecordBatch.from_arrays([full(kind), full(code), pa.array(note.astype(np.int64)), pa.array(piece), pa.array(weight.astype(float)), full(task), pa.array(number.astype(np.int32)), vec], names=[c.split()[0] for c in _PIECES.split(", ")])

    none = lambda k: pa.nulls(k, pa.list_(pa.float32()))
    zero = np.zeros
    for k in range(0, len(node), 10_000):
        part, at = node[k : k + 10_000], of[k : k + 10_000]
        yield rows(0, notes[part], name[label[at]], degree[at], zero(len(part)), _vectors(x[at]))
    lone = np.flatnonzero((home & (degree <= 0))[node_of])
    if len(lone):
        yield rows(4, notes[lone], notes[lone], zero(len(lone)), zero(len(lone)), _vectors(x[node_of[lone]]))
    yield rows(1, ids[visitor], name[label[visitor]], link[visitor], zero(len(visitor)), none(len(visitor)))
    total = np.bincount(label[members], degree[members], m)
    vec = pa.array([s.astype(np.float32) for s in sums[pieces]], pa.list_(pa.float32()))
    yield rows(2, zero(len(pieces)), name[pieces], total[pieces], count[pieces], vec)
    if not edges:
        return
    order = np.argsort(node_of, kind="stable")
    starts = np.cumsum(times) - times
    for u, v in ((a, b), (b, a)):
        for k in range(0, len(u), 100_000):
            p, q, ww = u[k : k + 100_000], v[k : k + 100_000], w[k : k + 100_000]
            each = np.repeat(np.arange(len(p)), times[p])
            place = np.arange(len(each)) - np.repeat(np.cumsum(times[p]) - times[p], times[p])
            yield rows(3, notes[order[starts[p[each]] + place]], ids[q[each]], ww[each], zero(len(each)), none(len(each)))
    more = np.flatnonzero(times[node_of] > 1)
    yield rows(3, notes[more], notes[more], np.minimum(times[node_of[more]] - 1, NEIGHBOURS), zero(len(more)), none(len(more)))


def merge_by_modularity(nodes: DataFrame, edges: DataFrame, resolution: float) -> DataFrame:
    """(code, piece, root): pieces joined while it raises modularity.

    nodes: (code, piece, weight), the degree of each; edges: (code, a, b, weight), both directions.
    In a round each node has its best partner by gain; where two are each other's best, the smaller is
    head, and whoever prefers one of the two joins it. Rounds go over the shrinking graph of roots, until no
    pair gains: the best pair of all always merges.
    """
    spark: SparkSession = nodes.sparkSession
    twice = nodes.groupBy("code").agg(F.sum("weight").alias("total"))
    root = nodes.select("code", "piece", F.col("piece").alias("root"))
    nodes, edges = cut(nodes, "nodes"), cut(edges, "edges")
    while True:
        ka = nodes.select("code", F.col("piece").alias("a"), F.col("weight").alias("ka"))
        kb = nodes.select("code", F.col("piece").alias("b"), F.col("weight").alias("kb"))
        gains = edges.join(ka, ["code", "a"]).join(kb, ["code", "b"]).join(F.broadcast(twice), "code")  # a row per model
        gain = F.col("weight") - resolution * F.col("ka") * F.col("kb") / F.col("total")
        # of equal gains the pair of the smallest ids, from either side alike
        best = gains.select("code", "a", "b", gain.alias("gain")).where("gain > 1e-9").groupBy("code", "a").agg(F.max(F.struct("gain", (-F.least("a", "b")).alias("l"), (-F.greatest("a", "b")).alias("g"), "b")).alias("x")).select("code", "a", F.col("x.b").alias("b"))
        best = cut(best, "best")
        if best.isEmpty():
            break
        back = best.select("code", F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("mutual"))
        heads = best.join(back, ["code", "a", "b"]).select("code", "a", F.least("a", "b").alias("head"))
        joins = best.join(heads.select("code", F.col("a").alias("b"), "head"), ["code", "b"]).select("code", F.col("a").alias("piece"), "head")
        joins = cut(joins, "joins")
        to = lambda df, col: df.join(joins.select("code", F.col("piece").alias(col), F.col("head").alias(f"h_{col}")), ["code", col], "left").withColumn(col, F.coalesce(f"h_{col}", col)).drop(f"h_{col}")
        root = cut(to(root, "root").select("code", "piece", "root"), "root")
        nodes = cut(to(nodes, "piece").groupBy("code", "piece").agg(F.sum("weight").alias("weight")), "nodes")
        edges = cut(to(to(edges, "a"), "b").where("a <> b").groupBy("code", "a", "b").agg(F.sum("weight").alias("weight")), "edges")
    return root


def _sum_vectors(rows: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """keys, n and the sum of vec as an array; shorter vectors keep their length."""
    sums = [F.sum(F.try_element_at("vec", F.lit(i + 1)).cast("double")).alias(f"s{i}") for i in range(dim)]
    out = rows.groupBy(*keys).agg(F.sum("n").alias("n"), *sums)
    return out.select(*keys, "n", F.filter(F.array(*[F.col(f"s{i}") for i in range(dim)]), lambda v: v.isNotNull()).alias("vec"))


_NEAR = "code int, id long, root long, cosine double"


def _compare(shared, least: float):
    """Rows (code, id, vec) against all means of their code: every pair of at least this cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = shared.value
        for batch in batches:
            codes, ids = batch.column("code").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                if code not in means:
                    continue
                roots, c = means[code]
                mine = np.flatnonzero(codes == code)
                x = matrix(batch.column("vec").take(pa.array(mine)))
                for s in range(0, len(x), 1024):
                    for t in range(0, len(c), 8192):
                        # single precision is off by less than 1e-4
                        i, j = np.nonzero(x[s : s + 1024] @ c[t : t + 8192].T >= least - 1e-4)
                        i, j = i + s, j + t
                        cos = np.empty(len(i))
                        for k in range(0, len(i), 65536):
                            cos[k : k + 65536] = np.einsum("ij,ij->i", x[i[k : k + 65536]].astype(np.float64), c[j[k : k + 65536]].astype(np.float64))
                        ok = cos >= least
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), code, np.int32)), pa.array(ids[mine[i[ok]]]), pa.array(roots[j[ok]]), pa.array(cos[ok])], names=["code", "id", "root", "cosine"])

    return run


def _near(rows: DataFrame, means: DataFrame, least: float) -> DataFrame:
    """(code, id, root, cosine): every pair of a row (code, id, vec) and a mean (code, root, vec) of at least this cosine.

    Exact: all means of a code are compared, MEANS of them at a time.
    """
    out = rows.sparkSession.createDataFrame([], _NEAR)
    for _, shared in _blocks(means):
        out = out.unionByName(rows.select("code", "id", "vec").mapInArrow(_compare(shared, least), _NEAR))
    return out


def _own(shared):
    """Rows (code, id, root, vec) against the mean of their own root: with their cosine, and without vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = shared.value
        for batch in batches:
            codes, mine = batch.column("code").to_numpy(zero_copy_only=False), batch.column("root").to_numpy(zero_copy_only=False)
            cos = np.full(len(codes), -2.0)
            for code in np.unique(codes):
                roots, c = means[code]
                by = np.argsort(roots)
                rows = np.flatnonzero(codes == code)
                x, at = matrix(batch.column("vec").take(pa.array(rows))), by[np.searchsorted(roots, mine[rows], sorter=by)]
                for k in range(0, len(rows), 65536):
                    cos[rows[k : k + 65536]] = np.einsum("ij,ij->i", x[k : k + 65536].astype(np.float64), c[at[k : k + 65536]].astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("id"), batch.column("root"), pa.array(cos)], names=["code", "id", "root", "cosine"])

    return run


def _blocks(means: DataFrame):
    """(condition on root, broadcast of the means) for blocks of some MEANS means."""
    spark = means.sparkSession
    blocks = max(1, -(-means.count() // MEANS))
    for block in range(blocks):
        here = F.pmod(F.xxhash64("root"), F.lit(blocks)) == block
        t = means.where(here).select("code", "root", F.col("vec").cast("array<float>").alias("vec")).toArrow()  # some MEANS rows
        codes = t["code"].to_numpy()
        parts = {int(code): t.take(pa.array(np.flatnonzero(codes == code))) for code in np.unique(codes)}
        yield here, spark.sparkContext.broadcast({code: (part["root"].to_numpy(), matrix(part["vec"])) for code, part in parts.items()})


def _members(pieces: DataFrame, roots: DataFrame, means: DataFrame, least: float, least_size: int) -> DataFrame:
    """(code, note_id, root, cosine): the notes of every community that have the least cosine to its mean, and where
    that is no home for a note the communities of its model that would be.

    A community of least_size such notes and without a rival keeps them. All other notes are compared with all means.
    """
    rows = pieces.where("kind = 0").join(some(roots), ["code", "piece"]).select("code", F.col("note_id").alias("id"), "root", "vec")
    tested = None
    for here, shared in _blocks(means):
        part = rows.where(here).mapInArrow(_own(shared), _NEAR)
        tested = part if tested is None else tested.unionByName(part)
    tested = cut(tested, "tested")
    large = tested.where(F.col("cosine") >= least).groupBy("code", "root").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("code", "root")
    rivals = _near(means.withColumnRenamed("root", "id"), means, RIVAL).where("id <> root").select("code", F.col("id").alias("root")).distinct()
    firm = cut(large.join(rivals, ["code", "root"], "left_anti"), "firm")
    kept = tested.where(F.col("cosine") >= least).join(some(firm), ["code", "root"], "left_semi")
    away = tested.join(some(firm), ["code", "root"], "left_anti").unionByName(tested.join(some(firm), ["code", "root"], "left_semi").where(F.col("cosine") < least)).select("code", "id")
    away = some(cut(away, "away"))
    loose = pieces.where("kind = 0").select("code", F.col("note_id").alias("id"), "vec").join(away, ["code", "id"], "left_semi").unionByName(pieces.where("kind = 4").select("code", F.col("note_id").alias("id"), "vec"))
    found = kept.select("code", "id", "root", "cosine").unionByName(_near(loose, means, least))
    return found.withColumnRenamed("id", "note_id")


def _settled(hits: DataFrame, least_size: int) -> DataFrame:
    """(code, note_id, root, cosine): each note's best root, of those that have least_size notes at the end.

    A root of too few notes is dropped and its notes go to their next best. Where such roots have notes
    in common the smaller go first, so that one cluster in several parts is not lost with all of them.
    """
    # no root can have more notes than it has hits
    whole = hits.groupBy("code", "root").agg(F.countDistinct("note_id").alias("most")).where(F.col("most") >= least_size).select("code", "root")
    hits = cut(hits.join(whole, ["code", "root"], "left_semi"), "hits")
    while True:
        best = cut(hits.groupBy("code", "note_id").agg(F.max(F.struct("cosine", "root")).alias("x")).select("code", "note_id", "x.root", "x.cosine"), "members")
        size = best.groupBy("code", "root").agg(F.count("*").alias("size"))
        failing = cut(hits.select("code", "root").distinct().join(size, ["code", "root"], "left").select("code", "root", F.coalesce("size", F.lit(0)).alias("size")).where(F.col("size") < least_size), "failing")
        if failing.isEmpty():
            return best
        rival = hits.join(failing, ["code", "root"]).select("code", "note_id", "root", F.struct("size", "root").alias("mine")).withColumns({"top": F.max("mine").over(w := Window.partitionBy("code", "note_id")), "n": F.count("*").over(w)})
        drop = rival.groupBy("code", "root").agg(F.bool_or(F.col("mine") < F.col("top")).alias("loses"), F.max("n").alias("n")).where("loses or n = 1").select("code", "root")
        hits = cut(hits.join(drop, ["code", "root"], "left_anti"), "hits")


@dataclass
class Found:
    """members: (model, root, note_id, cosine); pieces: the written rows of _cell; roots: (code, piece, root)."""

    members: DataFrame
    pieces: DataFrame
    roots: DataFrame
    names: DataFrame


def similarity_clusters(vectors: DataFrame, least_cosine: float = 0.74, apart: float = 0.7, least_size: int = 8, dims: dict[str, int] | None = None, sample: int = S.SAMPLE, cell: int = CELL, hot: int = S.HOT, edges: bool = False) -> Found | None:
    """Clusters of each model: see clusters() for the result and the defined cases; None for an empty table. edges: pieces have the edges too."""
    spark, keep_edges = vectors.sparkSession, edges
    known = usable(vectors, dims)
    rows, _, every = newest(known)
    spaces, tasks = S.fit(known, every, cell, sample, hot)
    if not tasks:
        return None
    shared = spark.sparkContext.broadcast(spaces)
    sent = rows.select("model", "note_id", "vec").mapInArrow(_send(shared, float(np.sqrt(2 - 2 * EDGE)), CERTAINTY), _SENT)
    pieces = cut(sent.repartitionById(tasks, "task").mapInArrow(lambda batches: _cell(batches, keep_edges), _PIECES), "pieces")
    node = pieces.where("kind = 0").select("code", "note_id", "piece")
    guest = pieces.where("kind = 1").select("code", "note_id", F.col("piece").alias("other"), "weight")
    half = guest.join(node, ["code", "note_id"]).where("piece <> other").groupBy("code", F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b")).agg(F.sum("weight").alias("weight"))
    half = _alike(half, pieces.where("kind = 2").select("code", "piece", "vec"), LINK)
    edges = half.unionByName(half.select("code", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    sizes = pieces.where("kind = 2").groupBy("code", "piece").agg(F.sum("weight").alias("weight"))
    roots = merge_by_modularity(sizes, edges, RESOLUTION)
    dim = max(s.pivots.shape[1] for s in spaces)
    roots = _join_near(pieces, roots, apart, dim)
    sums = _sum_vectors(pieces.where("kind = 2").join(roots, ["code", "piece"]), ["code", "root"], dim)
    means = cut(sums.select("code", "root", "vec"), "means")
    names = spark.createDataFrame([(s.code, s.model) for s in spaces], "code int, model string")
    one = _settled(cut(_members(pieces, roots, means, least_cosine, least_size), "checked"), least_size)
    ok = one.groupBy("code", "root").agg(F.count("*").alias("size"), F.min("note_id").alias("cluster_id"))
    members = one.join(ok, ["code", "root"]).join(F.broadcast(names), "code")  # a row per model
    return Found(members, pieces, roots, names)


def _cosine(a: str, b: str):
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(F.greatest(dot(a, a) * dot(b, b), F.lit(1e-300)))


def _length(a: str):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _alike(edges: DataFrame, means: DataFrame, least: float) -> DataFrame:
    """Edges (code, a, b, weight) between pieces whose mean directions have at least this cosine.

    Modularity alone joins small communities of a large graph by any edge.
    """
    a = means.select("code", F.col("piece").alias("a"), F.col("vec").alias("va"))
    b = means.select("code", F.col("piece").alias("b"), F.col("vec").alias("vb"))
    return edges.join(a, ["code", "a"]).join(b, ["code", "b"]).where(_cosine("va", "vb") >= least).select("code", "a", "b", "weight")


def _join_near(pieces: DataFrame, roots: DataFrame, apart: float, dim: int) -> DataFrame:
    """Roots whose mean directions have at least this cosine are one; those of very few rows join the nearest only, as they could link others."""
    mine = pieces.where("kind = 2").join(roots, ["code", "piece"])
    sums = cut(_sum_vectors(mine, ["code", "root"], dim), "loose")
    # a root whose vectors share no direction falls back to its pieces
    loose = sums.where((F.col("n") > 2) & (_length("vec") < COHERENT * F.col("n"))).select("code", "root", F.lit(True).alias("loose"))
    roots = cut(roots.join(loose, ["code", "root"], "left").select("code", "piece", F.when(F.col("loose"), F.col("piece")).otherwise(F.col("root")).alias("root")), "roots")
    mine = pieces.where("kind = 2").join(roots, ["code", "piece"])
    sums = cut(_sum_vectors(mine, ["code", "root"], dim), "sums")
    spots = cut(sums.where(_length("vec") >= COHERENT * F.col("n")), "spots")
    n_of = lambda name: spots.select("code", F.col("root").alias(name), F.col("n").alias(f"n_{name}"))
    met = _near(spots.withColumnRenamed("root", "id"), spots, apart).where("id <> root").select("code", F.col("id").alias("a"), F.col("root").alias("b"), "cosine")
    met = cut(met.join(n_of("a"), ["code", "a"]).join(n_of("b"), ["code", "b"]), "met")
    firm = met.where((F.col("n_a") >= FIRM) & (F.col("n_b") >= FIRM)).select("code", "a", "b")
    few = met.where(F.col("n_a") < FIRM).groupBy("code", "a").agg(F.max(F.struct("cosine", "n_b", "b")).alias("x")).select("code", "a", F.col("x.b").alias("b"))
    half = cut(firm.unionByName(few).select("code", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("weight", F.lit(1.0)), "near")
    if half.isEmpty():
        return roots
    edges = half.unionByName(half.select("code", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    nodes = sums.select("code", F.col("root").alias("piece"), F.lit(1.0).alias("weight"))
    again = merge_by_modularity(nodes, edges, 0.0).withColumnRenamed("root", "last").withColumnRenamed("piece", "root")
    return cut(roots.join(again, ["code", "root"]).select("code", "piece", F.col("last").alias("root")), "roots")


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """(model, note_id, cluster_id, cosine): the members of every cluster.

    cluster_id is the cluster's smallest note_id, cosine that with its mean direction. Only usable vectors
    count (see vectors.usable), of each (note_id, model) the newest; equally new ones may place a note by
    either. A note is in one cluster at most, a cluster has at least least_size notes, each with at least
    least_cosine to the mean direction; mean directions of different clusters have a cosine below `apart`.
    Null, empty or unusable vectors are in none, an empty table gives no rows, extra columns are ignored.
    Copies are mutually similar like any other notes. Cells are planned for bounded numbers of distinct
    vectors: a hot cell is split by pivots of its own, and copies are one row a batch.
    """
    found = similarity_clusters(vectors, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "model string, note_id long, cluster_id long, cosine double")
    return found.members.select("model", "note_id", "cluster_id", "cosine")


def cluster_report(vectors: DataFrame, typical: int = 3, names: DataFrame | None = None, **options) -> DataFrame:
    """(model, cluster_id, size, label, typical_ids): each cluster by size and its members of the highest internal weighted degree.

    The degree sums a note's edges to all notes of its cluster, whichever cell or piece found them.
    typical_ids are ordered by falling degree, then by note_id. label is the name, from names (note_id, name), of
    the first of them that has one that is not blank, else the first id.
    """
    found = similarity_clusters(vectors, edges=True, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "model string, cluster_id long, size long, label string, typical_ids array<long>")
    edges = found.pieces.where("kind = 3").groupBy("code", "note_id", F.col("piece").alias("other")).agg(F.max("weight").alias("weight"))  # two cells may have found one
    mine = found.members.select("code", "note_id", "root")
    degree = edges.join(mine, ["code", "note_id"]).join(mine.withColumnRenamed("note_id", "other"), ["code", "other", "root"]).groupBy("code", "note_id").agg(F.sum("weight").alias("inside"))
    with_degree = found.members.join(degree, ["code", "note_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    w = Window.partitionBy("model", "cluster_id").orderBy(F.desc("inside"), "note_id")
    top = with_degree.withColumn("place", F.row_number().over(w)).where(F.col("place") <= typical)
    if names is None:
        top = top.withColumn("name", F.lit(None).cast("string"))
    else:
        top = top.join(names.where("note_id is not null").groupBy("note_id").agg(F.min(F.nullif(F.trim("name"), F.lit(""))).alias("name")), "note_id", "left")
    first = F.min(F.when(F.col("name").isNotNull(), F.struct("place", "name")))["name"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "note_id"))), lambda s: s["note_id"])
    out = top.groupBy("model", "cluster_id").agg(F.max("size").alias("size"), first.alias("label"), listed.alias("typical_ids"))
    return out.withColumn("label", F.coalesce("label", F.element_at("typical_ids", 1).cast("string"))).select("model", "cluster_id", "size", "label", "typical_ids")
