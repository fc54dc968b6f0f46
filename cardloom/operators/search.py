"""Search from typed text: query to keywords, words and vector, to a list of notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import scores as S
from cardloom.functions import text as T
from cardloom.operators import hybrid as H
from cardloom.operators import keyphrases as K
from cardloom.operators import notes as N
from cardloom.operators import ranking as R
from cardloom.operators import similarity as V
from cardloom.operators.index import Index

#: Keywords of a query, words of an OR query and of a whole text as one, notes read per term.
KEYWORDS, OR_TERMS, TEXT_WORDS = 16, 16, 64


def fetched(limit: int) -> int:
    """Notes that are read per term for a list of this length."""
    return min(5000, max(2 * limit, 1000))


def query_keywords(query: str, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """The keywords of a typed query without the excluded ones; where none is left, its words."""
    flat = " ".join(query.split())
    gone = {e.lower() for e in exclude}
    return [t for t in K.keywords(flat, KEYWORDS) if t.lower() not in gone] or flat.split()


def text_words(text: str, most: int = TEXT_WORDS) -> list[str]:
    """Distinct ASCII words of two or more characters, in order."""
    import re

    return list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 2))[:most]


def fuzzy_search(spark: SparkSession, index: Index, notes: DataFrame, fields: DataFrame, query: str, limit: int = 50, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(note_id, rrf, bm25, front, found_in): the notes of the query's keywords, fused; an empty query lists the newest notes with rrf 0."""
    if not query.strip():
        return N.page(notes, fields, limit).select("note_id", F.lit(0.0).alias("rrf"), F.lit(None).cast("double").alias("bm25"), "front", F.lit(None).cast("string").alias("found_in"))
    terms = query_keywords(query, exclude)
    rows = R.fuzzy(index, R.query_terms(spark, {0: terms}), fetched(limit)).select("note_id", "rrf", "bm25")
    few = fields.join(rows.select("note_id"), "note_id", "left_semi")
    fronts = N.front(few)
    return R.where_found(rows, fronts, N.back(few), terms).join(fronts, "note_id", "left").select("note_id", "rrf", "bm25", "front", "found_in")


def or_search(spark: SparkSession, index: Index, terms: list[str], k: int) -> DataFrame:
    """(note_id, bm25, place): the k best notes for any of the first OR_TERMS terms."""
    return R.bm25_top(index, R.query_terms(spark, {0: terms[:OR_TERMS]}), k).select("note_id", "bm25", "place")


def _asked(spark: SparkSession, vec: list[float], model: str) -> DataFrame:
    return spark.createDataFrame([(0, model, [float(x) for x in vec])], "query_id int, model string, qvec array<double>")


def semantic_search(spark: SparkSession, vectors: DataFrame, fields: DataFrame, query: str, embed: dict[str, Callable[[list[str]], list]], k: int = 200) -> DataFrame:
    """(note_id, cos, by_model, front): the notes nearest to a typed query, k cut to 1..100, then those with a visible front.

    embed maps a model to its embedder; with several a note's cosine is the mean over the models that have
    a vector of it. An empty query finds nothing.
    """
    text = " ".join(query.split())
    asked = None
    for model, f in embed.items() if text else ():
        one = _asked(spark, f([text])[0], model)
        asked = one if asked is None else asked.unionByName(one)
    if asked is None:
        return spark.createDataFrame([], "note_id long, cos double, by_model string, front string")
    near = V.semantic_mean(vectors, asked, max(1, min(100, k)))
    return N.visible_only(near.select("note_id", "cos", "by_model"), fields)


def related_by_note(spark: SparkSession, index: Index, vectors: DataFrame, fields: DataFrame, note_id: int, model: str, least: float = 0.7, k: int = 50) -> DataFrame:
    """(note_id, cos, front): the notes nearest to a note's own vector among the best for the first 12 words of its front, all if there are none; then those with a visible front."""
    words = R.related_terms(N.front(fields.where(F.col("note_id") == note_id)), note_id, 12)
    pool = None
    if words:
        some = or_search(spark, index, words, min(800, max(200, 12 * k))).where(F.col("note_id") != note_id).select("note_id")
        pool = None if some.isEmpty() else some
    return N.visible_only(V.related(vectors, note_id, model, pool, least, k), fields)


def related_by_terms(spark: SparkSession, index: Index, vectors: DataFrame, terms: list[str], model: str, embed: Callable[[list[str]], list], k: int = 20, fused: bool = False) -> DataFrame:
    """(note_id, cos[, rrf]): notes by the best cosine over the terms' vectors, among the best notes for the terms by words, all if there are none.

    fused also ranks the notes per term and fuses the ranks, for ties.
    """
    clean = [t.strip() for t in terms if t.strip()]
    if not clean:
        return spark.createDataFrame([], "note_id long, cos double" + (", rrf double" if fused else ""))
    pool = or_search(spark, index, clean, min(1000, max(200, 20 * k))).select("note_id")
    among = vectors if pool.isEmpty() else N.restrict(vectors, pool)
    asked = spark.createDataFrame([(i, model, [float(x) for x in v]) for i, v in enumerate(embed(clean))], "query_id int, model string, qvec array<double>")
    return V.related_by_terms(among, asked, k) if fused else V.best_over_terms(among, asked, k)


def _combined(spark: SparkSession, index: Index, fields: DataFrame, near: DataFrame, text: str, limit: int, late: DataFrame | None) -> DataFrame:
    _, most = H.candidate_caps(limit)
    words = R.bm25_top(index, R.query_terms(spark, {0: text_words(text)}), most).select("query_id", "note_id", "bm25")
    rows = H.merge_candidates(near.select(F.lit(0).alias("query_id"), "note_id", "cos"), words)
    if late is not None:
        rows = H.backfill(rows, N.restrict(late, rows))
    few = fields.join(rows.select("note_id"), "note_id", "left_semi")
    terms = R.query_terms(spark, {0: K.keywords(" ".join(text.split()), KEYWORDS)})
    return H.hybrid(H.matched_terms(rows, N.front(few), N.back(few), terms), limit)


def hybrid_search(spark: SparkSession, index: Index, vectors: DataFrame, fields: DataFrame, query: str, model: str, embed: Callable[[list[str]], list], limit: int = 200) -> DataFrame:
    """(query_id, note_id, cos, bm25, matched, score, place): notes of a typed query by vector and by words, by their modulated score.

    Candidates by words without a cosine get one from their vector. matched counts the query's keywords in front and back.
    """
    text = " ".join(query.split())
    if not text:
        return spark.createDataFrame([], "query_id int, note_id long, cos double, bm25 double, matched int, score double, place int")
    cosines = V.cosine_scan(vectors, _asked(spark, embed([text])[0], model))
    near = R.top(cosines, min(100, H.candidate_caps(limit)[0]), F.desc("cos"))
    return _combined(spark, index, fields, N.visible_only(near, fields), text, limit, cosines)


def hybrid_of_note(spark: SparkSession, index: Index, vectors: DataFrame, fields: DataFrame, note_id: int, model: str, limit: int = 200) -> DataFrame:
    """The same for a note: its front is the query, its stored vector that of the query, and candidates by words keep no cosine."""
    row = N.front(fields.where(F.col("note_id") == note_id)).select(T.plain(F.col("front")).alias("t")).head()
    text = row["t"] if row else ""
    if not text:
        return hybrid_search(spark, index, vectors, fields, "", model, lambda _: [], limit)
    near = related_by_note(spark, index, vectors, fields, note_id, model, 0.0, H.candidate_caps(limit)[0])
    return _combined(spark, index, fields, near, text, limit, None)


def hybrid_batch(index: Index, vectors: DataFrame, asks: DataFrame, fields: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """(query_id, note_id, cos, bm25, matched, score, place): hybrid_search() of many texts (query_id, text) with vectors asks (query_id, qvec).

    All words of a text are asked for. The candidates are cut per query before any text is joined to them.
    """
    near_k, words_k = H.candidate_caps(limit)
    words = texts.select("query_id", F.posexplode(T.ascii_words(F.col("text"), most=None)).alias("term_idx", "term")).withColumn("words", T.index_tokens(F.col("term")))
    near = V.semantic_batch(vectors, asks, near_k)
    rows = H.merge_candidates(near, R.bm25_top_of_many(index, words, words_k))
    bare = rows.where("cos is null").join(asks, "query_id").join(vectors.select("note_id", "vec"), "note_id")
    rows = H.backfill(rows, bare.select("query_id", "note_id", S.cosine(F.col("vec"), F.col("qvec")).alias("cos")))
    terms = texts.select("query_id", F.explode(K.keyword_column(F.col("text"), KEYWORDS)).alias("term"))
    return H.hybrid(H.matched_terms(rows, N.front(fields), N.back(fields), terms), limit)
