"""Notes, their ordered fields, and lookups by id, tag and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T


def current_notes(notes: DataFrame) -> DataFrame:
    """One row per note_id: the latest synced_at (null first), of equal ones the greatest fetched_at, mod and hash."""
    w = Window.partitionBy("note_id").orderBy(F.desc_nulls_last("synced_at"), F.desc_nulls_last("fetched_at"), F.desc_nulls_last("mod"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("profile"), F.desc_nulls_last("model_name"))
    return notes.where("note_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current_fields(fields: DataFrame) -> DataFrame:
    """Distinct field rows with a note_id."""
    return fields.where("note_id is not null").select("note_id", "field_name", "value_html", "ord").distinct()


def current_tags(tags: DataFrame) -> DataFrame:
    return tags.where("note_id is not null and tag is not null").select("note_id", "tag").distinct()


def front(fields: DataFrame) -> DataFrame:
    """(note_id, front): the value of the lowest ord, null ord lowest, ties by name then value (nulls last)."""
    first = F.struct(F.coalesce("ord", F.lit(-(2**31))).alias("o"), F.coalesce("field_name", F.lit("")).alias("f"), F.col("value_html").isNull().alias("z"), F.coalesce("value_html", F.lit("")).alias("v"))
    return fields.where("note_id is not null").groupBy("note_id").agg(F.min(first).alias("x")).select("note_id", F.when(~F.col("x.z"), F.col("x.v")).alias("front"))


def back(fields: DataFrame) -> DataFrame:
    """(note_id, back): the value of the highest ord, null ord as -999999, ties to the last name then value."""
    last = F.struct(F.coalesce("ord", F.lit(-999999)).alias("o"), F.coalesce("field_name", F.lit("")).alias("f"), F.col("value_html").isNotNull().alias("z"), F.coalesce("value_html", F.lit("")).alias("v"))
    return fields.where("note_id is not null").groupBy("note_id").agg(F.max(last).alias("x")).select("note_id", F.when(F.col("x.z"), F.col("x.v")).alias("back"))


def with_front(ids: DataFrame, notes: DataFrame, fields: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(note_id, front) of the given ids that notes has, newest id first; front is null for a note without fields.

    A page (limit, offset) is cut before fields are read for it; without a limit all notes come out.
    """
    have = notes.where("note_id is not null").select("note_id").distinct()
    known = ids.select("note_id").distinct().join(have, "note_id", "left_semi")
    if limit is None:
        return known.join(front(fields), "note_id", "left")
    known = known.orderBy(F.desc("note_id")).offset(offset).limit(limit)
    return known.join(front(fields.join(known, "note_id", "left_semi")), "note_id", "left").orderBy(F.desc("note_id"))


def page(notes: DataFrame, fields: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(note_id, front), newest id first."""
    return with_front(notes, notes, fields, limit, offset)


def exact_search(notes: DataFrame, fields: DataFrame, query: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(note_id, front): notes in which every word or quoted phrase of the query occurs in some field, newest first.

    One pass: a flag per part, or-ed over the fields of a note. Comparison folds A to Z only. An empty
    query lists the notes. Without a limit all come out.
    """
    parts = T.query_parts(query)
    if not parts:
        return with_front(notes, notes, fields, limit, offset)
    low = T.ascii_lower(F.col("value_html"))
    flags = [F.bool_or(F.contains(low, F.lit(p))).alias(f"p{i}") for i, p in enumerate(parts)]
    cond = F.lit(True)
    for i in range(len(parts)):
        cond &= F.col(f"p{i}")
    hits = fields.where("note_id is not null and value_html is not null").groupBy("note_id").agg(*flags).where(cond)
    return with_front(hits, notes, fields, limit, offset)


def details(notes: DataFrame, fields: DataFrame, tags: DataFrame) -> DataFrame:
    """A row per note: its columns, fields as "name=value" by order, and sorted tags."""
    item = F.struct(F.coalesce("ord", F.lit(-(2**31))).alias("o"), "field_name", F.coalesce("value_html", F.lit("")).alias("v"))
    f = current_fields(fields).groupBy("note_id").agg(F.array_sort(F.collect_list(item)).alias("x")).select("note_id", F.array_join(F.transform("x", lambda s: F.concat(s["field_name"], F.lit("="), s["v"])), " | ").alias("fields"), F.size("x").alias("n_fields"))
    t = current_tags(tags).groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    return current_notes(notes).select("note_id", "model_name", "mod").join(f, "note_id", "left").join(t, "note_id", "left")


def visible_notes(fields: DataFrame) -> DataFrame:
    """(note_id, visible)."""
    return front(fields).select("note_id", T.is_visible(F.col("front")).alias("visible"))


def visible_only(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """rows (note_id, ...) with their `front`, without those whose front shows nothing. rows are a result list, already cut."""
    fronts = front(fields.join(rows.select("note_id"), "note_id", "left_semi"))
    return rows.join(fronts, "note_id").where(T.is_visible(F.col("front")))


def restrict(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows of the given ids; an id list of any length is a semi-join, broadcast by its size alone."""
    return rows.join(ids.select("note_id"), "note_id", "left_semi")


def first_ids(ids: DataFrame, most: int = 400) -> DataFrame:
    """Distinct ids in rising order, the first `most` of them (0: all)."""
    out = ids.where("note_id is not null").select("note_id").distinct()
    return out.orderBy("note_id").limit(most) if most else out


def min_max_filter(rows: DataFrame, score: Column, least: float) -> DataFrame:
    """Rows whose score, scaled to 0..1 over all rows, reaches `least`; equal scores scale to 1, rows without one go."""
    s = rows.withColumn("_s", score).where("_s is not null")
    w = s.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return s.join(F.broadcast(w)).withColumn("scaled", scaled).where(F.col("scaled") >= least).drop("_s", "_lo", "_hi")  # one row


def shared_tags(tags: DataFrame, head: str) -> DataFrame:
    return current_tags(tags).where(T.tag_head(F.col("tag")) == head)
