"""Badges, groups of results, and the trees they are shown in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T


def badges(answers: DataFrame) -> DataFrame:
    """(note_id, badge) from a model's answers (note_id, answer); null where no digit can be read."""
    return answers.select("note_id", T.answer_digit(T.answer_text(F.col("answer"))).alias("badge"))


def badge_histogram(rows: DataFrame) -> DataFrame:
    """(n0, n1, n2, n3)."""
    return rows.agg(*[F.count_if(F.col("badge") == i).alias(f"n{i}") for i in range(4)])


def badge_order(rows: DataFrame) -> DataFrame:
    """rows (note_id, badge, pos) with `place` by badge, those without one last, then by pos.

    Places are counted within a badge and shifted by the counts of the badges before, a row each.
    """
    rows = rows.withColumn("b", F.coalesce("badge", F.lit(99)))
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # five badges at most
    place = F.row_number().over(Window.partitionBy("b").orderBy("pos", "note_id"))
    return rows.withColumn("inner", place).join(F.broadcast(before), "b").withColumn("place", (F.col("inner") + F.col("before")).cast("int")).drop("b", "inner", "before")


def clean_groups(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, note_id) of a model's groups: unknown ids and repeats within a group dropped, missing ids to "Other".

    An id may be in several groups. Groups without ids vanish.
    """
    known = groups.where("label is not null").join(wanted.select("note_id"), "note_id", "left_semi").select("label", "note_id").distinct()
    rest = wanted.select("note_id").distinct().join(known, "note_id", "left_anti").select(F.lit("Other").alias("label"), "note_id")
    return known.unionByName(rest).distinct()


def parse_groups(answers: DataFrame) -> DataFrame:
    """(label, note_id) of answers holding {"groups": [{"label", "notes"}]} or that list alone; a blank label is "Other"."""
    item = "array<struct<label:string,notes:array<bigint>>>"
    text = T.answer_text(F.col("answer"))
    groups = F.coalesce(F.from_json(text, f"struct<groups:{item}>")["groups"], F.from_json(text, item))
    rows = answers.select(F.explode(groups).alias("g")).select(F.trim("g.label").alias("label"), F.explode("g.notes").alias("note_id"))
    return rows.select(F.when(F.coalesce("label", F.lit("")) == "", "Other").otherwise(F.col("label")).alias("label"), "note_id").where("note_id is not null")


def parse_hierarchy(answers: DataFrame) -> DataFrame:
    """(label, child) of answers that also hold {"hierarchy": [{"label", "children"}]}."""
    kind = "struct<hierarchy:array<struct<label:string,children:array<string>>>>"
    return answers.select(F.explode(F.from_json(T.answer_text(F.col("answer")), kind)["hierarchy"]).alias("h")).select(F.col("h.label").alias("label"), F.explode("h.children").alias("child"))


#: Notes that are shown to a model at once.
MOST_NOTES = 60


def group_by_model(wanted: DataFrame, fronts: DataFrame, query: str, make) -> DataFrame:
    """(label, note_id): the first MOST_NOTES wanted notes (note_id, pos) in the groups a language model forms of their fronts.

    make makes the model, see models.Answerer. Ids it leaves out, or all of them if its answer cannot be read, are in "Other".
    """
    from cardloom.sources.models import answered

    some = wanted.orderBy("pos", "note_id").limit(MOST_NOTES)
    lines = some.join(fronts, "note_id", "left").select("pos", "note_id", F.format_string("%d) %s", "note_id", T.plain(F.col("front"))).alias("line"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "note_id", "line"))), lambda s: s["line"]), "\n").alias("x"))
    prompt = body.select(F.concat(F.lit(f"SEARCH QUERY:\n{query}\n\nNOTES (numbered by note identifier):\n"), F.coalesce("x", F.lit(""))).alias("prompt"))
    return clean_groups(parse_groups(answered(prompt, "prompt", make)), some.select("note_id"))


def badges_by_model(fronts: DataFrame, make) -> DataFrame:
    """(note_id, badge): a language model's grade of every front text, null where its answer has no digit."""
    from cardloom.sources.models import answered

    return badges(answered(fronts.select("note_id", T.plain(F.col("front")).alias("prompt")), "prompt", make))


def group_list(rows: DataFrame) -> DataFrame:
    """(label, n, ids, place): groups by label, case folded, with their sorted ids (result lists of bounded size)."""
    g = rows.groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("note_id")), lambda i: i.cast("string")), ",").alias("ids"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.lower("label"), "label")))


def first_group(rows: DataFrame) -> DataFrame:
    """(note_id, label): each note in the first of its groups by (pos, label)."""
    return rows.groupBy("note_id").agg(F.min(F.struct("pos", "label")).alias("x")).select("note_id", F.col("x.label").alias("label"))
