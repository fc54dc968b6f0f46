"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "floats": T.ArrayType(T.FloatType())}


def _table(text: str) -> T.StructType:
    """"name kind, name kind?, ..."; a question mark for nullable."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _KINDS[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


NOTES = _table("note_id long, model_name string, profile string?, mod long?, fetched_at long, content_hash string?, synced_at long")
NOTE_FIELDS = _table("note_id long, field_name string, value_html string, ord int?")
NOTE_TAGS = _table("note_id long, tag string")
EMBEDDINGS = _table("note_id long, backend string, model string, dim int, vec floats, norm double, hash string, updated_at long")
EMBED_JOBS = _table("note_id long, backend string, model string, hash string, status string, attempts int, last_error string?, enqueued_at long, started_at long?, finished_at long?")
KEYWORD_EMBEDDINGS = _table("term string, dim int, vec floats, norm double, updated_at long")
TOPIC_RUNS = _table("run_id string, scope string, scope_hash string, backend string, model string, note_count int, params_json string?, created_at long, query string?, query_embedding floats?, query_dim int?")
TOPICS = _table("run_id string, topic_id int, parent_id int?, label string, level int, size int, score double?, query_cos double?, centroid floats?, centroid_dim int?")
TOPIC_TERMS = _table("run_id string, topic_id int, term string, score double, rank int")
TOPIC_DOCS = _table("run_id string, topic_id int, note_id long, weight double?, cos double?")
RELATED = _table("source_note_id long, type string, target_note_id long, score double, created_at long")
NOTE_TRIGRAMS = _table("note_id long, trigram string")

#: Input of a sync: one JSON object per note.
SNAPSHOT = "noteId long, modelName string, profile string, mod long, fields map<string,struct<value:string,order:int>>, tags array<string>"
