"""The inverted index over front texts: postings by term, lengths, vocabulary.

It is stored once and read by term: postings lie in buckets of a hash of their term, sorted by term, so a
query reads the buckets of its own words only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators.notes import front

#: Folders that postings are spread over by a hash of their term.
BUCKETS = 64


@dataclass
class Index:
    """docs (note_id, tokens), postings (bucket, term, note_id, length, tf, places) and stats (n, mean) of one row."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame

    def of_words(self, words: list[str] | None) -> DataFrame:
        """The postings of these words: buckets and terms are constants, so other folders and row groups are not read. None: all."""
        if words is None:
            return self.postings
        buckets = self.docs.sparkSession.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w")).alias("b")).distinct().collect() if words else []  # a row per word of a typed query
        return self.postings.where(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("term").isin(words))


def documents_index(notes: DataFrame, fields: DataFrame) -> DataFrame:
    """(note_id, tokens): folded words of the front text, one row per note; a note without a front has none."""
    fronts = notes.where("note_id is not null").select("note_id").distinct().join(front(fields), "note_id", "left")
    return fronts.select("note_id", T.index_tokens(T.indexed(F.col("front"))).alias("tokens"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def of_documents(docs: DataFrame) -> Index:
    """The index of (note_id, tokens), not stored."""
    per = docs.select("note_id", F.size("tokens").alias("length"), F.posexplode("tokens").alias("place", "term"))
    posts = per.groupBy("term", "note_id", "length").agg(F.sort_array(F.collect_list("place")).alias("places"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    return Index(docs, posts.select(_bucket(F.col("term")).alias("bucket"), "term", "note_id", "length", F.size("places").alias("tf"), "places"), stats)


def stored(docs: DataFrame, path: str) -> Index:
    """The index of (note_id, tokens), written under path. A term of very many notes is spread over several files."""
    docs.write.parquet(f"{path}/docs")
    made = of_documents(docs.sparkSession.read.parquet(f"{path}/docs"))
    made.stats.write.parquet(f"{path}/stats")
    made.postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    return opened(docs.sparkSession, path)


def opened(spark, path: str) -> Index:
    """An index that stored() has written."""
    posts = spark.read.schema("term string, note_id long, length int, tf int, places array<int>, bucket int").parquet(f"{path}/postings")
    return Index(spark.read.schema("note_id long, tokens array<string>").parquet(f"{path}/docs"), posts, spark.read.schema("n long, mean double").parquet(f"{path}/stats"))


def postings(index: DataFrame) -> DataFrame:
    """(note_id, pos, term)."""
    return index.select("note_id", F.posexplode("tokens").alias("pos", "term"))


def vocabulary(index: DataFrame) -> DataFrame:
    """(term, docs, n): notes with the term, and its occurrences."""
    per = postings(index).groupBy("term", "note_id").agg(F.count("*").alias("c"))
    return per.groupBy("term").agg(F.count("*").alias("docs"), F.sum("c").alias("n"))


def phrase_frequency(index: DataFrame, phrase: list[str]) -> DataFrame:
    """(docs): notes that hold the words next to each other."""
    return index.where(occurrences("tokens", phrase) > 0).agg(F.count("*").alias("docs"))


def occurrences(tokens: str, phrase: list[str]):
    """How often the words stand next to each other in a token array; 0 for no words."""
    n = len(phrase)
    if not n:
        return F.lit(0)
    want = F.array(*[F.lit(p) for p in phrase])
    if n == 1:
        return F.size(F.filter(F.col(tokens), lambda t: t == phrase[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, F.lit(n)) == want))


def refreshed(old: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after changed rows (note_id, tokens) came in and ids went: unchanged rows stay as they are."""
    gone = changed.select("note_id").unionByName(deleted.select("note_id"))
    return old.join(gone, "note_id", "left_anti").unionByName(changed.select(*old.columns))


def needs_rebuild(index: DataFrame, notes: DataFrame) -> DataFrame:
    """(n_index, n_notes, rebuild): counts differ if the index is stale."""
    a, b = index.agg(F.count("*").alias("n_index")), notes.where("note_id is not null").agg(F.countDistinct("note_id").alias("n_notes"))
    return a.join(F.broadcast(b)).withColumn("rebuild", F.col("n_index") != F.col("n_notes"))  # one row each
