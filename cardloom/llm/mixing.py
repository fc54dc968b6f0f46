"""Documents of several sources mixed to target shares of all tokens.

Each document gets a hash-random key; documents are range-sorted by it within their source, distributed
prefix sums of tokens give every document its place, and a source is cut at its budget. A source whose
budget is larger than itself is used in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.prefix import prefix_sums
from cardloom.llm.tokens import VOCABULARY, with_tokens
from cardloom.shared import cut


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, runs of other signs than letters and digits as "_"."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def _targets(targets: DataFrame) -> DataFrame:
    """(mix_id, source, share, max_repeats): a row per mix and source, shares of a mix scaled to 1."""
    rows = targets.where("mix_id is not null and source is not null and target_share > 0 and max_repeats > 0").groupBy("mix_id", source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = rows.groupBy("mix_id").agg(F.sum("target_share").alias("all_shares"))
    return rows.join(total, "mix_id").withColumn("share", F.col("target_share") / F.col("all_shares")).drop("all_shares")


def ordered(documents: DataFrame, targets: DataFrame, seed: int = 11, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, doc_id, tokens, before): the documents of the targeted sources, in random order, with the tokens before each."""
    names = _targets(targets).select("source").distinct()
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").join(names, "source", "left_semi")
    sized = cut(with_tokens(rows, "source string", vocabulary).where("tokens > 0"), "sizes").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    return prefix_sums(sized, ["source"], ["key", "doc_id"], "tokens").drop("key")


def budgets(placed: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, have, budget, epochs, rest) per mix and source.

    Without total_tokens a mix is as large as its sources allow: the least of have * max_repeats / share
    over its sources. A source without documents cannot give anything and does not bind the others. With
    total_tokens a source that is too small gives max_repeats times itself.
    """
    have = placed.groupBy("source").agg(F.sum("tokens").alias("have"))
    rows = _targets(targets).join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    if total_tokens is None:
        size = rows.where("have > 0").groupBy("mix_id").agg(F.min(F.col("have") * F.col("max_repeats") / F.col("share")).alias("size"))
    else:
        size = rows.select("mix_id").distinct().withColumn("size", F.lit(float(total_tokens)))
    most = F.col("have") * F.col("max_repeats")
    rows = rows.join(size, "mix_id", "left").withColumn("budget", F.least(most, F.round(F.coalesce("size", F.lit(0.0)) * F.col("share")).cast("long")))
    epochs = F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("int")
    return rows.select("mix_id", "source", "target_share", "max_repeats", "have", "budget", epochs.alias("epochs")).withColumn("rest", F.col("budget") - F.col("have") * F.col("epochs"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (mix_id, source, doc_id, tokens, repeats) and shares per mix and source.

    A document is used `epochs` times, and once more if it lies before the cut of its source's last,
    partial epoch; the document on the cut is taken if at least half of it lies before. So a source meets
    its budget within half a document, and no document is used more than max_repeats times.
    Spellings of a source that differ in case or separators are one. Rows without doc_id, text, source or
    tokens are left out; repeated rows are documents of their own; empty tables give no rows; extra columns
    are ignored. Shares are scaled to 1 per mix. The budgets that are broadcast are the rows of targets.
    """
    placed = cut(ordered(documents, targets, seed, vocabulary), "mix")
    plan = cut(budgets(placed, targets, total_tokens), "budgets")
    took = placed.join(F.broadcast(plan), "source")
    took = took.withColumn("repeats", F.col("epochs") + F.when(F.col("before") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    chosen = took.where("repeats > 0").select("mix_id", "source", "doc_id", "tokens", "repeats")
    used = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    total = used.groupBy("mix_id").agg(F.sum("used_tokens").alias("all_tokens"))
    shares = plan.join(used, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    shares = shares.select("mix_id", "source", "target_share", F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.col("have").alias("source_tokens"), "budget", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    return chosen, shares
