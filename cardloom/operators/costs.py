"""Size of the corpus and the cost of describing topics with a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import text as T

# Dollars per million tokens: input, cached input, output.
PRICES = (("small", 0.05, 0.005, 0.40), ("medium", 0.25, 0.02, 1.00), ("large", 1.25, 0.10, 5.00))


def corpus_stats(fields: DataFrame, ord_: int = 0) -> DataFrame:
    """(notes, chars, tokens, avg_chars, max_chars, avg_tokens) over the fields at one place, by their visible text."""
    n = F.length(T.cost_text(F.col("value_html"))).cast("long")
    rows = fields.where(F.col("ord") == ord_).select(n.alias("n"), T.token_estimate(n).alias("t"))
    return rows.agg(F.count("*").alias("notes"), F.sum("n").alias("chars"), F.sum("t").alias("tokens"), F.avg("n").alias("avg_chars"), F.max("n").alias("max_chars"), F.avg("t").alias("avg_tokens"))


def cost_model(stats: DataFrame, per_topic: int = 12, docs: int = 5, snippet: int = 160, prompt: int = 120, words: int = 12, output: int = 48, cached: float = 0.0) -> DataFrame:
    """(tier, topics, input_tokens, output_tokens, dollars) per price tier, from corpus_stats of one row."""
    spark = stats.sparkSession
    prices = spark.createDataFrame(PRICES, "tier string, input double, cached_input double, out double")
    topics = F.greatest(F.lit(1), F.floor(F.col("notes") / per_topic + 0.5)).cast("long")
    shown = F.greatest(F.lit(1.0), F.least(F.col("avg_tokens"), F.lit(float(snippet))))
    rows = prices.join(F.broadcast(stats)).withColumn("topics", topics)  # one row
    rows = rows.withColumn("input_tokens", (prompt + docs * shown + words) * F.col("topics")).withColumn("output_tokens", F.lit(output) * F.col("topics"))
    share = max(0.0, min(1.0, cached))
    dollars = (F.col("input_tokens") * ((1 - share) * F.col("input") + share * F.col("cached_input")) + F.col("output_tokens") * F.col("out")) / 1_000_000
    return rows.select("tier", "topics", "input_tokens", "output_tokens", dollars.alias("dollars"))
