"""Snapshots of notes against the stored table: hashes, decisions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators.notes import current_fields, current_notes, current_tags


def content_hash(notes: DataFrame, fields: DataFrame, tags: DataFrame) -> DataFrame:
    """(note_id, content_hash): SHA-256 of model||name=value|...||tag|..., fields by order, tags sorted."""
    item = F.struct(F.coalesce("ord", F.lit(0)).alias("o"), F.coalesce("field_name", F.lit("")).alias("f"), T.with_media(F.col("value_html")).alias("v"))
    f = current_fields(fields).groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat(s["f"], F.lit("="), s["v"])), "|").alias("f"))
    t = current_tags(tags).groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("t"))
    rows = current_notes(notes).select("note_id", "model_name").join(f, "note_id", "left").join(t, "note_id", "left")
    text = F.concat(F.coalesce("model_name", F.lit("")), F.lit("||"), F.coalesce("f", F.lit("")), F.lit("||"), F.coalesce("t", F.lit("")))
    return rows.select("note_id", F.sha2(text, 256).alias("content_hash"))


def decision(old_known: Column, new_known: Column, old_mod: Column, new_mod: Column, old_hash: Column, new_hash: Column) -> Column:
    same_mod = old_mod.isNotNull() & new_mod.isNotNull() & (old_mod == new_mod)
    return (
        F.when(~new_known, "delete").when(~old_known, "insert").when(same_mod, "touch")
        .when(old_hash.eqNullSafe(new_hash), "touch_mod").otherwise("update")
    )


def snapshot_diff(old: DataFrame, new: DataFrame, delete_missing: bool = True) -> DataFrame:
    """(note_id, action): what a snapshot (note_id, mod, content_hash) means for the stored rows.

    insert, update, touch (mod is the same), touch_mod (mod differs, content does not), delete (not in the
    snapshot). An empty snapshot deletes nothing; delete_missing is False for snapshots of a narrower query.
    """
    a = old.select("note_id", F.col("mod").alias("om"), F.col("content_hash").alias("oh"), F.lit(True).alias("ok"))
    b = new.select("note_id", F.col("mod").alias("nm"), F.col("content_hash").alias("nh"), F.lit(True).alias("nk"))
    rows = a.join(b, "note_id", "full_outer")
    no = F.lit(False)
    out = rows.select("note_id", decision(F.coalesce("ok", no), F.coalesce("nk", no), F.col("om"), F.col("nm"), F.col("oh"), F.col("nh")).alias("action"))
    if not delete_missing or new.isEmpty():
        out = out.where("action <> 'delete'")
    return out


def counters(actions: DataFrame) -> DataFrame:
    """(inserted, updated, unchanged, deleted)."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return actions.agg(n("insert").alias("inserted"), n("update").alias("updated"), n("touch", "touch_mod").alias("unchanged"), n("delete").alias("deleted"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in by key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def applied(old: DataFrame, new: DataFrame, delete_missing: bool = True) -> DataFrame:
    """The stored table (note_id, mod, content_hash, synced_at) after a snapshot of the same columns."""
    act = snapshot_diff(old, new, delete_missing)
    kept = old.join(act.where("action in ('delete', 'insert', 'update', 'touch_mod')"), "note_id", "left_anti")
    touched = new.join(act.where("action = 'touch'"), "note_id", "left_semi").select("note_id", F.col("synced_at").alias("s"))
    kept = kept.join(touched, "note_id", "left").withColumn("synced_at", F.coalesce("s", "synced_at")).drop("s")
    fresh = new.join(act.where("action in ('insert', 'update', 'touch_mod')"), "note_id", "left_semi")
    return kept.unionByName(fresh.select(*kept.columns))


def without_children(children: DataFrame, gone: DataFrame) -> DataFrame:
    """Fields, tags or vectors whose note went."""
    return children.join(gone.select("note_id"), "note_id", "left_anti")


def migrated_vectors(old: DataFrame, current: DataFrame, default_backend: str, default_model: str) -> DataFrame:
    """Rows of a vector table without backend and model, for those keys that the current table lacks.

    Hashes of the form gemma|model|... tell a local vector and its model.
    """
    local = F.startswith("hash", F.lit("gemma|"))
    named = old.withColumn("backend", F.when(local, "gemma").otherwise(default_backend)).withColumn("model", F.when(local, F.split_part("hash", F.lit("|"), F.lit(2))).otherwise(default_model))
    return named.join(current.select("note_id", "backend", "model"), ["note_id", "backend", "model"], "left_anti")
