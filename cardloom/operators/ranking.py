"""BM25 for batches of queries, rank fusion, and fuzzy search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import scores as S
from cardloom.functions import text as T
from cardloom.operators.index import Index
from cardloom.shared import cut


def query_terms(spark: SparkSession, queries: dict[int, list[str]]) -> DataFrame:
    """(query_id, term_idx, term, words): terms as typed, and their index words. Terms without words match nothing."""
    rows = [(q, i, t) for q, terms in queries.items() for i, t in enumerate(terms)]
    if 0 < len(rows) <= 500:  # as a constant, whose size the planner knows
        items = [F.struct(F.lit(q).alias("query_id"), F.lit(i).alias("term_idx"), F.lit(t).alias("term")) for q, i, t in rows]
        df = spark.range(1).select(F.inline(F.array(*items)))
    else:
        df = spark.createDataFrame(rows, "query_id int, term_idx int, term string")
    return df.withColumn("words", T.index_tokens(F.col("term")))


def without_terms(terms: DataFrame, exclude: list[str]) -> DataFrame:
    """Query terms without the excluded ones, whatever their case."""
    return terms.where(~F.lower("term").isin([e.lower() for e in exclude])) if exclude else terms


def term_hits(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, note_id, length, tf) for keys (key, words): a word's postings as they are, a phrase's from the places of its words."""
    singles = keys.where(F.size("words") == 1).select("key", F.element_at("words", 1).alias("term"))
    one = posts.join(singles, "term").select("key", "note_id", "length", "tf")
    many = keys.where(F.size("words") > 1).select("key", F.size("words").alias("n"), F.posexplode("words").alias("i", "term"))
    # a phrase begins where each of its words stands at its own distance
    met = posts.join(many, "term").select("key", "n", "note_id", "length", F.transform("places", lambda p: p - F.col("i")).alias("starts"))
    whole = met.groupBy("key", "n", "note_id", "length").agg(F.collect_list("starts").alias("s")).where(F.size("s") == F.col("n"))
    phrases = whole.select("key", "note_id", "length", F.size(F.reduce("s", F.element_at("s", 1), F.array_intersect)).alias("tf")).where("tf > 0")
    return one.unionByName(phrases)


#: Words of typed queries up to which they select the postings that are read; more queries are joined to all of them.
TYPED = 1_000


def term_parts(index: Index, keys: DataFrame) -> DataFrame:
    """(key, note_id, part, df, n): the BM25 share of each key (key, words) in each note that has it."""
    words = [r["w"] for r in keys.select(F.explode("words").alias("w")).distinct().limit(TYPED + 1).collect()]
    hits = term_hits(index.of_words(words if len(words) <= TYPED else None), keys)
    df = hits.groupBy("key").agg(F.count("*").alias("df"))
    rows = hits.join(df, "key").join(F.broadcast(index.stats))  # one row
    return rows.select("key", "note_id", S.bm25_part(S.bm25_idf(F.col("n"), F.col("df")), F.col("tf"), F.col("length"), F.col("mean")).alias("part"), "df", "n")


def _keyed(terms: DataFrame) -> DataFrame:
    return terms.where(F.size("words") > 0).withColumn("key", F.concat_ws(" ", "words"))


def term_scores(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, term_idx, term, note_id, part, df, n): each term's BM25 share in each note that has it.

    Each different term is looked up once for all queries, then joined to the queries that have it. terms
    is a frame of typed queries and small by nature; its size is left to the planner. df counts the notes
    of the whole index, n all of them.
    """
    want = _keyed(terms)
    parts = term_parts(index, want.select("key", "words").distinct())
    return parts.join(want.select("query_id", "term_idx", "term", "key"), "key").select("query_id", "term_idx", "term", "note_id", "part", "df", "n")


#: (query, term) rows that are sent to all tasks at once: a million are some 20 MB.
TERM_BLOCK = 1_000_000


def bm25_top_of_many(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, note_id, bm25, place): as bm25_top(), for many queries of many terms.

    The notes stay where they are and the queries come to them: postings of the wanted terms are
    partitioned by note, a task adds up the scores of its notes for blocks of queries as a matrix, and passes
    on its own k best per query. So the shuffles hold the postings once, and k rows per query and task.
    A term counts as often as a query has it.
    """
    want = cut(_keyed(terms).select("query_id", "key", "words"), "terms")
    parts = term_parts(index, want.select("key", "words").distinct()).select("key", "note_id", "part")
    parts = parts.repartition("note_id").sortWithinPartitions("note_id")  # one exchange for all blocks
    n = want.count()
    blocks = -(-n // TERM_BLOCK) + (n > TERM_BLOCK)  # hashed blocks are not quite even
    out = index.docs.sparkSession.createDataFrame([], "query_id long, note_id long, bm25 double")
    for block in range(blocks):
        t = want.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select(F.col("query_id").cast("long").alias("query_id"), "key").toArrow()
        if t.num_rows:
            shared = index.docs.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), t["key"].to_pylist()))
            out = out.unionByName(parts.mapInArrow(_best_by_words(shared, k), "query_id long, note_id long, bm25 double"))
    return top(out, k, F.col("bm25"))


def _best_by_words(shared, k: int, rows: int = 50_000, queries: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, keys = shared.value
        ids, number = np.unique(who, return_inverse=True)
        asked: dict[str, list[int]] = {}
        for q, key in zip(number.tolist(), keys):
            asked.setdefault(key, []).append(q)
        asked = {key: np.unique(q, return_counts=True) for key, q in asked.items()}
        best, note = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for t in _whole_notes(batches, rows):
            notes, at = np.unique(t["note_id"].to_numpy(), return_inverse=True)
            part = t["part"].to_numpy()
            coded = t["key"].combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            by = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[by], np.arange(len(coded.dictionary) + 1))
            names = coded.dictionary.to_pylist()
            more = np.zeros((len(ids), min(k, len(notes))))
            which = np.zeros(more.shape, np.int64)
            for s in range(0, len(ids), queries):
                e = min(len(ids), s + queries)
                scores = np.zeros((e - s, len(notes)))
                for c, key in enumerate(names):
                    q, times = asked.get(key, (None, None))
                    if q is None:
                        continue
                    lo, hi = np.searchsorted(q, [s, e])
                    if lo < hi:
                        r = by[ends[c] : ends[c + 1]]
                        scores[(q[lo:hi] - s)[:, None], at[r]] += times[lo:hi, None] * part[r]
                cols = _lowest(scores, notes, k)
                more[s:e], which[s:e] = np.take_along_axis(scores, cols, 1), notes[cols]
            best, note = np.concatenate([best, more], 1), np.concatenate([note, which], 1)
            order = np.lexsort((note, best), axis=1)[:, :k]
            best, note = np.take_along_axis(best, order, 1), np.take_along_axis(note, order, 1)
        q, j = np.nonzero(best < 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(note[q, j]), pa.array(best[q, j])], names=["query_id", "note_id", "bm25"])

    return run


def _lowest(scores: np.ndarray, notes: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k lowest of each row; of equal ones those of the smallest notes, which ascend."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argsort(scores, axis=1, kind="stable")[:, :k]


def _whole_notes(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows of a stream sorted by note_id; no note is in two of them."""
    kept, n = [], 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(kept)
        end = int(np.searchsorted(t["note_id"].to_numpy(), t["note_id"][-1].as_py()))
        if end:
            yield t.slice(0, end)
            kept, n = t.slice(end).to_batches(), len(t) - end
    if n:
        yield pa.Table.from_batches(kept)


def bm25(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, note_id, bm25): the sum over the terms found; lower is better."""
    return term_scores(index, terms).groupBy("query_id", "note_id").agg(F.sum("part").alias("bm25"))


def top(rows: DataFrame, k: int, *order, by: str = "query_id") -> DataFrame:
    """First k per query in the given order, then by note_id."""
    w = Window.partitionBy(by).orderBy(*order, "note_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def bm25_top(index: Index, terms: DataFrame, k: int) -> DataFrame:
    return top(bm25(index, terms), k, F.col("bm25"))


def related_terms(fields_front: DataFrame, note_id: int, words: int = 16) -> list[str]:
    """First words of a note's front text, as typed: the query of its related notes (a row of one note)."""
    row = fields_front.where(F.col("note_id") == note_id).select(F.slice(F.filter(F.split(T.plain(F.col("front")), " "), lambda w: w != ""), 1, words).alias("w")).head()
    return [w.replace('"', "") for w in (row["w"] if row else [])]


def placed(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows with their `place`: the cut comes first, so the window that counts sees k rows at most."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def rrf_two(a: DataFrame, b: DataFrame, k: int = S.RRF_K, most: int = 5_000) -> DataFrame:
    """(note_id, rrf) of two ranked lists (note_id, score) of at most `most` places: the first is best low, the second best high."""
    ra = placed(a, most, F.col("score"), F.col("note_id")).select("note_id", F.col("place").alias("r"))
    rb = placed(b, most, F.desc("score"), F.col("note_id")).select("note_id", F.col("place").alias("r"))
    return ra.unionByName(rb).groupBy("note_id").agg(F.sum(1 / (k + F.col("r"))).alias("rrf"))


def rrf(lists: DataFrame, k: int = S.RRF_K, weight=None) -> DataFrame:
    """(query_id, note_id, rrf, list_idx, rank) of rows (query_id, list_idx, note_id, rank).

    weight is a column or None; a weight that is no number counts as 1, a negative one as 0. list_idx and
    rank are the first place a note has: the order among equal sums.
    """
    w = F.lit(1.0) if weight is None else F.when(weight.isNull() | F.isnan(weight), 1.0).otherwise(F.greatest(weight, F.lit(0.0)))
    out = lists.groupBy("query_id", "note_id").agg(F.sum(w / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("list_idx", "rank")).alias("x"))
    return out.select("query_id", "note_id", "rrf", F.col("x.list_idx").alias("list_idx"), F.col("x.rank").alias("rank"))


def fuzzy(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, note_id, rrf, bm25): the terms' BM25 lists of k notes each, fused with the terms' weights.

    The weight counts notes that have the term as typed: single words are looked up unfolded, so a
    capital, an accent or a hyphen makes them rare. A note's bm25 is its best one over the lists.
    """
    parts = term_scores(index, terms)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "term_idx").orderBy("part", "note_id"))).where(F.col("rank") <= k)
    folded = T.fold(F.col("term")) == F.col("term")
    known = F.when(F.contains("term", F.lit(" ")) | (folded & ~F.contains("term", F.lit("-"))), F.col("df")).otherwise(0)
    weighted = ranked.withColumn("weight", S.term_weight(F.col("term"), F.col("n"), known))
    fused = rrf(weighted.select("query_id", F.col("term_idx").alias("list_idx"), "note_id", "rank", "weight"), weight=F.col("weight"))
    best = ranked.groupBy("query_id", "note_id").agg(F.min("part").alias("bm25"))
    return fused.join(best, ["query_id", "note_id"]).select("query_id", "note_id", "rrf", "bm25")


def where_found(rows: DataFrame, fronts: DataFrame, backs: DataFrame, terms: list[str]) -> DataFrame:
    """rows with `found_in`: front, back or both, by raw lower-cased HTML containing a term; null if neither."""
    low = [t.lower() for t in terms]
    hit = lambda c: F.coalesce(F.exists(F.array(*[F.lit(t) for t in low]), lambda t: F.contains(F.lower(c), t)), F.lit(False))
    out = rows.join(fronts, "note_id", "left").join(backs, "note_id", "left")
    f, b = hit(F.col("front")), hit(F.col("back"))
    return out.withColumn("found_in", F.when(f & b, "both").when(f, "front").when(b, "back")).drop("front", "back")


def trigram_overlap(rows: DataFrame, text: str, grams: list[str], k: int) -> DataFrame:
    """(note_id, hits): distinct trigrams of the query in each text, most first."""
    have = F.size(F.array_intersect(T.trigrams(F.lower(F.col(text))), F.array(*[F.lit(g) for g in grams])))
    return rows.select("note_id", have.alias("hits")).where("hits > 0").groupBy("note_id").agg(F.max("hits").alias("hits")).orderBy(F.desc("hits"), "note_id").limit(k)


def trigrams_of(terms: list[str]) -> list[str]:
    s = " ".join(terms).lower()
    return list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))

