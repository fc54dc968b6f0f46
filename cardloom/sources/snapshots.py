"""Reading note dumps, page texts and raw vectors; writing topic maps and related rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cardloom import schemas
from cardloom.shared import cut


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A JSON dump of notes: one object per line, or one array."""
    return spark.read.schema(schemas.SNAPSHOT).option("multiLine", False).json(path)


def snapshot_tables(raw: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """notes, note_fields and note_tags of a snapshot."""
    rows = raw.where("noteId is not null")
    notes = rows.select(F.col("noteId").alias("note_id"), F.col("modelName").alias("model_name"), "profile", "mod", F.lit(now).cast("long").alias("fetched_at"), F.lit(now).cast("long").alias("synced_at"))
    fields = rows.select(F.col("noteId").alias("note_id"), F.explode("fields").alias("field_name", "f")).select("note_id", "field_name", F.col("f.value").alias("value_html"), F.col("f.order").alias("ord"))
    tags = rows.select(F.col("noteId").alias("note_id"), F.explode("tags").alias("tag")).distinct()
    return notes, fields, tags


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_num, text): the text items of each page (page_num, items array<string>) joined by blanks."""
    raw = spark.read.schema("page_num int, items array<string>").json(path)
    return raw.select("page_num", F.trim(F.regexp_replace(F.array_join("items", " "), r"\s+", " ")).alias("text"))


def write_topic_map(run: DataFrame, topics: DataFrame, terms: DataFrame, docs: DataFrame, folder: str) -> None:
    """The four tables of a map, a partition per run; writing a run again replaces it."""
    for name, df in (("topic_runs", run), ("topics", topics), ("topic_terms", terms), ("topic_docs", docs)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/{name}")


def write_related(rows: DataFrame, folder: str, buckets: int = 64) -> None:
    """Related rows, replacing those of the same type and source; others stay.

    Files are partitioned by type and a bucket of sources, and only the buckets that rows fall into are
    written again, with what they held of other sources.
    """
    spark = rows.sparkSession
    new = cut(rows.withColumn("bucket", F.pmod(F.xxhash64("source_note_id"), F.lit(buckets)).cast("int")), "related")
    try:
        old = spark.read.parquet(folder)
    except AnalysisException:  # the first write
        old = new.limit(0)
    kept = old.join(new.select("type", "bucket").distinct(), ["type", "bucket"], "left_semi").join(new.select("type", "source_note_id").distinct(), ["type", "source_note_id"], "left_anti")
    both = cut(new.unionByName(kept.select(*new.columns)), "related")
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type", "bucket").parquet(folder)


class NoteService(DataSource):
    """Notes of a service that answers {"action", "params"} posts: format "notes", option url.

    A partition asks for one slice of the ids, so tasks fetch in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return schemas.SNAPSHOT

    def reader(self, schema) -> DataSourceReader:
        return _NoteReader(self.options)


class _Slice(InputPartition):
    def __init__(self, ids: list[int]):
        self.ids = ids


def post(url: str, action: str, params: dict):
    """The result of one call; an error in the answer is raised."""
    import json
    import urllib.request

    body = json.dumps({"action": action, "version": 6, "params": params}).encode()
    with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=60) as r:
        answer = json.load(r)
    if answer.get("error"):
        raise RuntimeError(str(answer["error"]))
    return answer["result"]


class _NoteReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.query, self.size = options["url"], options.get("query", ""), int(options.get("slice", "500"))

    def partitions(self):
        ids = post(self.url, "findNotes", {"query": self.query})
        return [_Slice(ids[i : i + self.size]) for i in range(0, len(ids), self.size)]

    def read(self, partition):
        for n in post(self.url, "notesInfo", {"notes": partition.ids}):
            fields = {k: (v.get("value"), v.get("order")) for k, v in (n.get("fields") or {}).items()}
            yield (n.get("noteId"), n.get("modelName"), n.get("profile"), n.get("mod"), fields, n.get("tags") or [])


def unsuspended(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n): notes suspended before and not after; rows (note_id, suspended)."""
    both = before.select("note_id", F.col("suspended").alias("b")).join(after.select("note_id", F.col("suspended").alias("a")), "note_id")
    return both.agg(F.count_if(F.col("b") & ~F.col("a")).alias("n"))
