"""Hierarchical tags: counts, roll-ups, subtrees and group trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators.notes import current_tags, with_front


def tag_counts(tags: DataFrame) -> DataFrame:
    """(tag, n_notes): distinct notes per tag."""
    return current_tags(tags).groupBy("tag").agg(F.count("*").alias("n_notes"))


def under(tag: Column, prefix: str) -> Column:
    """The tag itself or below it. As with LIKE, A to Z fold, and "_" and "%" in the prefix are wildcards."""
    return (tag == prefix) | T.ascii_lower(tag).like(prefix.translate(str.maketrans(T._UPPER, T._LOWER)) + "::%")


def notes_with_tag(notes: DataFrame, fields: DataFrame, tags: DataFrame, tag: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(note_id, front) of the notes with exactly this tag, newest first; ids that notes has not are none."""
    return with_front(current_tags(tags).where(F.col("tag") == tag), notes, fields, limit, offset)


def notes_under(notes: DataFrame, fields: DataFrame, tags: DataFrame, prefix: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(note_id, front) of the notes with this tag or one below it, newest first."""
    return with_front(current_tags(tags).where(under(F.col("tag"), prefix)), notes, fields, limit, offset)


def child_tags(tags: DataFrame, prefix: str = "") -> DataFrame:
    """(tag, n): the next level under a prefix ("" for the top), by the sum of the counts of all tags below.

    A note with two tags under a child counts twice, as in the per-tag counts.
    """
    depth = len(prefix.split("::")) if prefix else 0
    rows = tag_counts(tags)
    if prefix:
        rows = rows.where(F.startswith("tag", F.lit(prefix + "::")))
    child = F.array_join(F.slice(F.split("tag", "::"), 1, depth + 1), "::")
    return rows.where(F.size(F.split("tag", "::")) > depth).groupBy(child.alias("tag")).agg(F.sum("n_notes").alias("n"))


def prefixes(tag: Column) -> Column:
    parts = F.split(tag, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))


def tag_tree(tags: DataFrame) -> DataFrame:
    """(path, depth, n): every path with the counts of all tags at and below it."""
    rows = tag_counts(tags).select(F.explode(prefixes(F.col("tag"))).alias("path"), "n_notes")
    return rows.groupBy("path").agg(F.sum("n_notes").alias("n")).withColumn("depth", F.size(F.split("path", "::")))


def unique_counts(tags: DataFrame) -> DataFrame:
    """(path, n_notes): distinct notes at and below every path."""
    rows = current_tags(tags).select("note_id", F.explode(prefixes(F.col("tag"))).alias("path"))
    return rows.groupBy("path").agg(F.countDistinct("note_id").alias("n_notes"))


def additive_counts(tags: DataFrame) -> DataFrame:
    """(path, n): of every tag that notes have, its count and those of all tags below it at any depth, notes of several tags counted repeatedly."""
    own = tag_counts(tags).select(F.col("tag").alias("path"))
    return own.join(tag_tree(tags).select("path", "n"), "path")


def group_tree(tags: DataFrame, depth: int = 3, children: int = 20, leaf_notes: int = 500) -> DataFrame:
    """(path, level, n, place): the tree shown for grouping: per parent the largest children, ties by path, to a depth."""
    tree = tag_tree(tags).where(F.col("depth") <= depth)
    parent = F.array_join(F.slice(F.split("path", "::"), 1, F.col("depth") - 1), "::")
    ranked = tree.withColumn("parent", parent).withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n"), "path"))).where(F.col("place") <= children)
    kept = ranked.select("path", F.col("depth").alias("level"), F.least("n", F.lit(leaf_notes)).alias("n"), "place", "parent")
    for _ in range(depth - 1):  # a child of a cut parent goes too
        kept = kept.join(kept.select(F.col("path").alias("parent"), F.lit(True).alias("has")), "parent", "left").where("level = 1 or has").drop("has")
    return kept.select("path", "level", "n", "place")


def flat_groups(tree: DataFrame, expanded: list[str]) -> DataFrame:
    """(path, level, key): rows of the tree whose ancestors are all expanded, in pre-order of key."""
    up = F.filter(prefixes(F.col("path")), lambda p: p != F.col("path"))
    return tree.where(F.size(F.array_except(up, F.array(*[F.lit(e) for e in expanded]).cast("array<string>"))) == 0).select("path", "level", F.lower("path").alias("key"))


def flat_rows(tags: DataFrame, notes: DataFrame, expanded: list[str]) -> DataFrame:
    """(kind, path, level, n, note_id): the tag tree as a list: a header per shown path with its distinct notes, and below an expanded one its own notes.

    A path is shown if all above it are expanded. In order of (path, kind) headers come before their notes, and both before the paths below.
    """
    have = notes.where("note_id is not null").select("note_id").distinct()
    known = current_tags(tags).join(have, "note_id", "left_semi")
    heads = flat_groups(unique_counts(known).select("path", "n_notes", (F.size(F.split("path", "::"))).alias("level")).drop("n_notes"), expanded).select("path", "level")
    counts = unique_counts(known).withColumnRenamed("n_notes", "n")
    shown = heads.join(counts, "path")
    own = known.join(heads.where(F.col("path").isin(expanded)).select(F.col("path").alias("tag"), "level"), "tag")
    none = F.lit(None).cast("long")
    return shown.select(F.lit("header").alias("kind"), "path", "level", "n", none.alias("note_id")).unionByName(own.select(F.lit("note").alias("kind"), F.col("tag").alias("path"), "level", none.alias("n"), "note_id"))
