"""Vector search: exact cosine scans for one or more query vectors, and what builds on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import scores as S
from cardloom.operators.ranking import top


def current_vectors(vectors: DataFrame) -> DataFrame:
    """(note_id, backend, model, vec): per key the newest usable vector: numbers only, finite, not all zero."""
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x))
    ok = vectors.where("note_id is not null and model is not null and vec is not null").where(total.isNotNull() & ~F.isnan(total) & (total > 0) & (total < float("inf")))
    return ok.groupBy("note_id", "backend", "model").agg(F.max(F.struct(F.coalesce("updated_at", F.lit(-1)).alias("at"), "vec")).alias("x")).select("note_id", "backend", "model", F.col("x.vec").alias("vec"))


def stored_query(vectors: DataFrame, note_id: int, model: str, query_id: int = 0) -> DataFrame:
    """(query_id, model, qvec): a note's own vector as the query."""
    return vectors.where((F.col("note_id") == note_id) & (F.col("model") == model)).select(F.lit(query_id).alias("query_id"), "model", F.col("vec").alias("qvec"))


def cosine_scan(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, model, note_id, cos) for every vector of the query's model and length.

    queries is a frame of typed queries, joined by model; the planner broadcasts it if it is small.
    """
    met = vectors.join(queries, "model").where(F.size("vec") == F.size("qvec"))
    return met.select("query_id", "model", "note_id", S.cosine(F.col("vec"), F.col("qvec")).alias("cos"))


def overlap_cosine(a: Column, b: Column) -> Column:
    """Cosine over the numbers that both vectors have: the longer one is cut."""
    n = F.least(F.size(a), F.size(b))
    return S.cosine(F.slice(a, 1, n), F.slice(b, 1, n))


def vectors_for(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(note_id, vec, known) for ids (note_id, pos): vectors cut or filled with zeros to the length of the first id's that has one; zeros where there is none.

    A length is found by one aggregate; the zeros keep each id in its place for what reads by position.
    """
    rows = ids.join(vectors.select("note_id", "vec"), "note_id", "left")
    dim = rows.where("vec is not null").agg(F.min(F.struct("pos", "note_id", F.size("vec").alias("n")))["n"].alias("dim"))
    sized = rows.join(F.broadcast(dim))  # one row
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.coalesce("dim", F.lit(0)))
    kept = F.slice(F.concat(F.coalesce("vec", F.array().cast("array<float>")), zeros), 1, F.coalesce("dim", F.lit(0)))
    return sized.select("note_id", kept.alias("vec"), F.col("vec").isNotNull().alias("known"))


def cosine_scan_arrow(vectors: DataFrame, query: list[float], model: str) -> DataFrame:
    """(note_id, cos): the same for one query vector by matrix products over Arrow batches."""
    q = np.asarray(query, np.float64)
    q = q / (np.sqrt(q @ q) or 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["vec"].to_numpy()).astype(np.float64) if len(b) else np.empty((0, len(q)))
            yield pd.DataFrame({"note_id": b["note_id"], "cos": x @ q / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-300)})

    return vectors.where((F.col("model") == model) & (F.size("vec") == len(q))).select("note_id", "vec").mapInPandas(run, "note_id long, cos double")


#: Query vectors that are sent to all tasks at once: 20,000 of 64 numbers are some 10 MB, and their k best so far in a
#: task 16 bytes each; they meet the vectors in blocks of some 512 x 4,096 cosines (16 MB).
QUERY_BLOCK, STEP = 20_000, 512

#: Rows of one part of a bucket of the approximate index.
PART = 20_000


def semantic_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, note_id, cos, place): the k nearest for each of many query vectors (query_id, qvec) of one length.

    Blocks of some QUERY_BLOCK queries go to all tasks; a task multiplies its vectors with the block and
    passes on its own k best per query, so the shuffle holds k rows per query and task.
    """
    spark = vectors.sparkSession
    size = int(queries.agg(F.max(F.size("qvec")).alias("n")).head()["n"] or 0)
    fit = queries.where(F.size("qvec") == size)
    n = fit.count()
    blocks = -(-n // QUERY_BLOCK) + (n > QUERY_BLOCK)  # hashed blocks are not quite even
    out = spark.createDataFrame([], "query_id long, note_id long, cos double")
    for block in range(blocks):
        t = fit.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")).toArrow()
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((t["query_id"].to_numpy(), _unit(t["qvec"].combine_chunks())))
        part = vectors.where(F.size("vec") == size).select("note_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_best_of_block(shared, k), "query_id long, note_id long, cos double")
        out = out.unionByName(part)
    return top(out, k, F.desc("cos"))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x**2).sum(1)), 1e-300)[:, None]


def _best_of_block(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            x, notes = _unit(b.column("vec")), b.column("note_id").to_numpy(zero_copy_only=False)
            for s in range(0, len(x), 4096):
                these = notes[s : s + 4096]
                for i in range(0, len(ids), STEP):
                    mine = slice(i, i + STEP)
                    cos = (q[mine] @ x[s : s + 4096].T).round(12)  # exact copies have equal cosines
                    least = best[mine, -1:]
                    row, col = np.nonzero((cos > least) | ((cos == least) & (these[None] < who[mine, -1:])))
                    if not len(row):
                        continue
                    n = len(best[mine])
                    r = np.concatenate([np.repeat(np.arange(n), k), row])
                    c = np.concatenate([best[mine].ravel(), cos[row, col]])
                    w = np.concatenate([who[mine].ravel(), these[col]])
                    order = np.lexsort((w, -c, r))
                    r, c, w = r[order], c[order], w[order]
                    place = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
                    keep = place < k
                    best[mine], who[mine] = c[keep].reshape(n, k), w[keep].reshape(n, k)
        r, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(who[r, j]), pa.array(best[r, j])], names=["query_id", "note_id", "cos"])

    return run


def semantic(vectors: DataFrame, queries: DataFrame, k: int = 100, most: int = 100) -> DataFrame:
    """(query_id, note_id, cos, place): the k nearest, k between 1 and `most`."""
    best = cosine_scan(vectors, queries).groupBy("query_id", "note_id").agg(F.max("cos").alias("cos"))
    return top(best, max(1, min(most, k)), F.desc("cos"))


def semantic_mean(vectors: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, note_id, cos, n_models, by_model): mean over the models that have a vector, with each model's cosine."""
    rows = cosine_scan(vectors, queries)
    mean = rows.groupBy("query_id", "note_id").agg(F.avg("cos").alias("cos"), F.count("*").alias("n_models"), F.array_sort(F.collect_list(F.struct("model", "cos"))).alias("x"))
    named = mean.withColumn("by_model", F.array_join(F.transform("x", lambda s: F.concat(s["model"], F.lit(":"), F.format_number(s["cos"], 4))), " ")).drop("x")
    return top(named, k, F.desc("cos"))


def related(vectors: DataFrame, note_id: int, model: str, candidates: DataFrame | None, least: float = 0.7, k: int = 50) -> DataFrame:
    """(note_id, cos): nearest notes to a note, among candidates if there are any; k between 1 and 200."""
    pool = vectors if candidates is None else vectors.join(candidates.select("note_id"), "note_id", "left_semi")
    rows = cosine_scan(pool, stored_query(vectors, note_id, model)).where((F.col("note_id") != note_id) & (F.col("cos") >= least))
    return rows.orderBy(F.desc("cos"), "note_id").limit(max(1, min(200, k))).select("note_id", "cos")


def related_by_terms(vectors: DataFrame, queries: DataFrame, k: int, rrf_k: int = S.RRF_K, list_size: int = 200) -> DataFrame:
    """(note_id, cos, rrf): ranks of list_size notes per query vector, fused; sorted by best cosine, then by fusion."""
    rows = top(cosine_scan(vectors, queries), list_size, F.desc("cos"))
    out = rows.groupBy("note_id").agg(F.max("cos").alias("cos"), F.sum(1 / (rrf_k + F.col("place"))).alias("rrf"))
    return out.orderBy(F.desc("cos"), F.desc("rrf"), "note_id").limit(max(1, min(100, k)))


def best_over_terms(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(note_id, cos): the best cosine over the query vectors."""
    return cosine_scan(vectors, queries).groupBy("note_id").agg(F.max("cos").alias("cos")).orderBy(F.desc("cos"), "note_id").limit(k)


def mean_vector(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """keys, centroid: mean of the vectors of a group that have the length of most common use in it (the greatest of equally common)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    # one pass: the sums of each length, of which the commonest is kept
    sums = rows.where(F.size(vec) > 0).groupBy(*keys, F.size(vec).alias("_n")).agg(F.count("*").alias("_c"), Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("_m"))
    means = sums.select(*keys, F.struct("_c", "_n", vector_to_array("_m").alias("m")).alias("_x"))
    return means.groupBy(*keys).agg(F.max("_x").alias("_x")).select(*keys, F.col("_x.m").alias("centroid"))


def term_cosines(terms: DataFrame, qvec: DataFrame) -> DataFrame:
    """(term, cos): cosine of cached term vectors (term, vec) to a query vector; -1 without one of its length. qvec is a frame of one row."""
    met = terms.join(F.broadcast(qvec.select("qvec")))
    return met.select("term", F.coalesce(S.cosine(F.col("vec"), F.col("qvec")), F.lit(-1.0)).alias("cos"))


def cosines_against(vectors: DataFrame, ids: DataFrame, qvec: DataFrame) -> DataFrame:
    """(note_id, cos) for the given ids; -1 where lengths differ. qvec is a frame of one row."""
    rows = vectors.join(ids.select("note_id"), "note_id", "left_semi").join(F.broadcast(qvec.select("qvec")))
    return rows.select("note_id", "model", F.coalesce(S.cosine(F.col("vec"), F.col("qvec")), F.lit(-1.0)).alias("cos"))


def truncated(vectors: DataFrame, most: int = 4096) -> DataFrame:
    """Vectors longer than `most` cut to it, with dim and norm recomputed; others as they are but for null norms."""
    cut = F.slice("vec", 1, most)
    long = F.size("vec") > most
    return vectors.withColumn("dim", F.when(long, most).otherwise(F.col("dim"))).withColumn("norm", F.when(long, S.norm(cut)).otherwise(F.col("norm"))).withColumn("vec", F.when(long, cut).otherwise(F.col("vec")))


def norms(vectors: DataFrame) -> DataFrame:
    """(note_id, model, norm, safe_norm): the length of each vector; safe_norm is 1 for zero vectors."""
    n = S.norm(F.col("vec"))
    return vectors.select("note_id", "model", n.alias("norm"), F.when(n == 0, 1.0).otherwise(n).alias("safe_norm"))


def greedy_clusters(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """(list_id, term, head): per list (list_id, place, term, vec), in order of place, a term not yet taken heads
    a cluster and takes all terms not yet taken with at least that cosine.

    A list is the keywords of one query or note: small by nature.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "term"], kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x = x / np.maximum(np.sqrt((x**2).sum(1)), 1e-300)[:, None]
        head = np.full(len(x), -1)
        for i in range(len(x)):
            if head[i] < 0:
                head[(head < 0) & (x @ x[i] >= least)] = i
                head[i] = i
        terms = pdf["term"].to_numpy()
        return pd.DataFrame({"list_id": pdf["list_id"], "term": terms, "head": terms[head]})

    return rows.groupBy("list_id").applyInPandas(run, "list_id long, term string, head string")


def precomputed(rows: DataFrame, kind: str, note_id: int, fronts: DataFrame, k: int = 20) -> DataFrame:
    """(note_id, score, front) of stored related rows (source_note_id, type, target_note_id, score)."""
    hit = rows.where((F.col("type") == kind) & (F.col("source_note_id") == note_id)).select(F.col("target_note_id").alias("note_id"), "score").orderBy(F.desc("score"), "note_id").limit(k)
    return hit.join(fronts, "note_id", "left")


def from_blobs(rows: DataFrame, blob: str = "blob") -> DataFrame:
    """Binary columns of little-endian float32 as `vec`."""

    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))

    return rows.withColumn("vec", decode(F.col(blob)))


def to_blobs(rows: DataFrame, vec: str = "vec") -> DataFrame:
    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return rows.withColumn("blob", encode(F.col(vec)))


def lsh_search(vectors: DataFrame, model: str, dim: int, query: Column, k: int, tables: int = 24, planes: int = 7) -> DataFrame:
    """(model, note_id, neighbour_id, cos, place): approximately the k nearest notes of the queries (a condition on note_id) in one model.

    The index: every vector of the model has a bucket in each table, by the sides it lies on of some random
    planes. A query meets the vectors of its own buckets and of those beyond its nearest plane; each query
    and bucket keeps its k best before they are put together.
    """
    rng = np.random.default_rng([29, dim, tables, planes])
    normals = rng.standard_normal((tables, planes, dim))
    rows = vectors.where((F.col("model") == model) & (F.size("vec") == dim))

    def buckets(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                side = np.einsum("nd,tpd->ntp", _unit(b.column("vec")), normals)
                code = (side > 0) @ (1 << np.arange(planes))
                if probe:
                    near = 1 << np.argmin(np.abs(side), 2)
                    code = np.concatenate([code, code ^ near], 1)
                code = code + (np.arange(code.shape[1]) % tables << planes)
                n = code.shape[1]
                row = np.repeat(np.arange(b.num_rows), n)
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel().astype(np.int32)), b.column("note_id").take(pa.array(row)), b.column("vec").take(pa.array(row))], names=["bucket", "note_id", "vec"])

        return run

    def best(key: tuple[int], left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"note_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        asks, notes = left["note_id"].to_numpy(), right["note_id"].to_numpy()
        q, x = _unit(left["vec"].combine_chunks()), _unit(right["vec"].combine_chunks())
        got = [[], [], []]
        for s in range(0, len(q), STEP):
            cos = q[s : s + STEP] @ x.T
            cos[asks[s : s + STEP, None] == notes[None]] = -2
            few = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k]
            value = np.take_along_axis(cos, few, 1)
            r, j = np.nonzero(value > -2)
            for to, v in zip(got, (asks[s + r], notes[few[r, j]], value[r, j])):
                to.append(v)
        return pa.table({name: np.concatenate(v) for name, v in zip(("note_id", "neighbour_id", "cos"), got)})

    as_double = rows.select("note_id", F.col("vec").cast("array<double>").alias("vec"))
    kind = "bucket int, note_id long, vec array<double>"
    # hot buckets are cut by a hash of the note; a query goes to all parts
    data = as_double.mapInArrow(buckets(False), kind)
    sizes = data.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # tables x 2^planes rows
    sized = F.broadcast(sizes)
    data = data.join(sized, "bucket").withColumn("part", F.pmod(F.xxhash64("note_id"), F.col("parts")).cast("int"))
    asks = as_double.where(query).mapInArrow(buckets(True), kind).join(sized, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["bucket", "part", "note_id", "vec"]
    found = asks.select(*cols).groupBy("bucket", "part").cogroup(data.select(*cols).groupBy("bucket", "part")).applyInArrow(best, "note_id long, neighbour_id long, cos double")
    once = found.groupBy("note_id", "neighbour_id").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("note_id").orderBy(F.desc("cos"), "neighbour_id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(F.lit(model).alias("model"), "note_id", "neighbour_id", "cos", "place")


def index_status(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """(backend, model, dim, n_vectors, indexed): vectors by length, and whether the approximate index holds them."""
    want = F.lit(None).cast("int")
    for model, n in dims.items():
        want = F.when(F.col("model") == model, n).otherwise(want)
    rows = vectors.groupBy("backend", "model", F.size("vec").alias("dim")).agg(F.count("*").alias("n_vectors"))
    return rows.withColumn("indexed", F.coalesce(F.col("dim") == want, F.lit(False)))


def pair_cosines(rows: DataFrame, key: str, least: float) -> DataFrame:
    """(key, a, b, cos) of pairs within a list of bounded length."""
    a = rows.select(key, F.col("term").alias("a"), F.col("vec").alias("va"))
    b = rows.select(key, F.col("term").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, key).where("a < b").select(key, "a", "b", S.cosine(F.col("va"), F.col("vb")).alias("cos")).where(F.col("cos") >= least)

