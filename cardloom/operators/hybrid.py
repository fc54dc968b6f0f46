"""Hybrid search, reranking and the order of result lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import scores as S
from cardloom.operators.ranking import placed, top


def candidate_caps(limit: int) -> tuple[int, int]:
    """Candidates by vector and by words."""
    return min(200, max(60, 2 * limit)), min(800, max(200, 8 * limit))


def merge_candidates(near: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, note_id, cos, bm25): both lists, each note once with its best values."""
    a = near.groupBy("query_id", "note_id").agg(F.max("cos").alias("cos"))
    b = words.groupBy("query_id", "note_id").agg(F.min("bm25").alias("bm25"))
    return a.join(b, ["query_id", "note_id"], "full_outer")


def backfill(candidates: DataFrame, cosines: DataFrame) -> DataFrame:
    """Missing cosines from the vectors of the candidates, where there are any."""
    found = cosines.groupBy("query_id", "note_id").agg(F.avg("cos").alias("late"))
    return candidates.join(found, ["query_id", "note_id"], "left").withColumn("cos", F.coalesce("cos", "late")).drop("late")


def matched_terms(rows: DataFrame, fronts: DataFrame, backs: DataFrame, terms: DataFrame) -> DataFrame:
    """rows with `matched`: how many of the query's terms the raw lower-cased front or back HTML contains."""
    lists = terms.groupBy("query_id").agg(F.collect_list(F.lower("term")).alias("terms"))
    out = rows.join(fronts, "note_id", "left").join(backs, "note_id", "left").join(lists, "query_id", "left")
    text = F.concat_ws("\n", F.lower("front"), F.lower("back"))
    n = F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(text, t)))
    return out.withColumn("matched", n).drop("front", "back", "terms")


def hybrid(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, note_id, cos, bm25, matched, score): candidates by their modulated score."""
    scored = candidates.withColumn("score", S.hybrid_score(F.col("cos"), F.col("bm25"), F.col("matched")))
    return top(scored, k, F.desc("score"))


def union_pool(words: DataFrame, near: DataFrame, k: int = 100, most: int = 200) -> DataFrame:
    """(note_id, bm25, cos, pos): the first k by words, then the first k by vector not yet in, at most `most`.

    Both lists are result lists: bounded by k.
    """
    a = placed(words, k, F.col("bm25"), F.col("note_id")).withColumn("o", F.col("place"))
    b = placed(near, k, F.desc("cos"), F.col("note_id")).withColumn("o", k + F.col("place"))
    both = a.select("note_id", "bm25", F.lit(None).cast("double").alias("cos"), "o").unionByName(b.select("note_id", F.lit(None).cast("double").alias("bm25"), "cos", "o"))
    one = both.groupBy("note_id").agg(F.min("bm25").alias("bm25"), F.max("cos").alias("cos"), F.min("o").alias("o"))
    return one.withColumn("pos", F.row_number().over(Window.orderBy("o"))).where(F.col("pos") <= most).drop("o")


def rerank(pool: DataFrame, words: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(note_id, rerank, bm25, segment, place): the pool by falling score (none: last), then the other word hits by bm25. Both are result lists, already cut.

    scorer maps (note_id, ...) to (note_id, rerank).
    """
    head = pool.join(scorer(pool), "note_id", "left").select("note_id", "rerank", "bm25", F.lit(0).alias("segment"), "pos")
    tail = words.join(pool, "note_id", "left_anti").select("note_id", F.lit(None).cast("double").alias("rerank"), "bm25", F.lit(1).alias("segment"), F.lit(0).alias("pos"))
    rows = head.unionByName(tail)
    w = Window.orderBy("segment", F.desc_nulls_last("rerank"), F.when(F.col("segment") == 0, F.col("pos")), F.asc_nulls_last("bm25"), "note_id")
    return rows.withColumn("place", F.row_number().over(w)).drop("pos")


def small_rerank(words: DataFrame, near: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """(note_id, rerank, place): the first k by words and the first k by vector by falling score; a note without one scores 0."""
    pool = union_pool(words, near, k, 2 * k)
    rows = pool.join(scorer(pool), "note_id", "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))
    return placed(rows, 2 * k, F.desc("rerank"), F.col("pos")).select("note_id", "rerank", "place")


def rerank_filter(rows: DataFrame, least: float) -> DataFrame:
    """Rows whose score, scaled to 0..1 over the list, reaches `least` (of equal scores all)."""
    from cardloom.operators.notes import min_max_filter

    return min_max_filter(rows, F.col("rerank"), least)


def panel(rows: DataFrame, note_id: int, least: float = 0.7, k: int = 20) -> DataFrame:
    """Related rows for a side panel: not the note itself, a least score, the first k."""
    return rows.where((F.col("note_id") != note_id) & (F.col("score") >= least)).orderBy(F.desc("score"), "note_id").limit(k)


def resorted(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(note_id, bm25, place): visible rows (note_id, pos) by bm25, those without one last, then by their old place. rows are the list on view, cut before."""
    out = rows.join(words.select("note_id", "bm25"), "note_id", "left")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("bm25"), "pos"))).drop("pos")


def cascade(exact: DataFrame, fuzzy: Callable[[], DataFrame]) -> DataFrame:
    """The exact result, or if it is empty the fuzzy one."""
    return fuzzy() if exact.isEmpty() else exact
