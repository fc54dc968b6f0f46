"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions.text import plain
from cardloom.llm import clusters as G
from cardloom.llm import lookalikes as L
from cardloom.llm import mixing as M
from cardloom.llm import nearcopies as C
from cardloom.llm import neighbours as N
from cardloom.llm import packing as K
from cardloom.llm.vectors import MODEL_DIMS
from cardloom.operators.notes import front
from cardloom.shared import table


def p1_found(spark, d):
    return G.clusters(table(spark, d, "embeddings2"), dims=MODEL_DIMS).select("model", "note_id", "cluster_id")


def p1_topics(spark, d):
    names = front(table(spark, d, "note_fields")).select("note_id", plain(F.col("front")).alias("name"))
    return G.cluster_report(table(spark, d, "embeddings2"), names=names, dims=MODEL_DIMS)


def p4_found(spark, d):
    return N.near_pairs(table(spark, d, "embeddings2"), 5, 0.95, MODEL_DIMS)


def p4_nearest(spark, d):
    """Ten nearest notes of every note whose id is divisible by 20, against all."""
    return N.nearest(table(spark, d, "embeddings2"), 10, query=F.col("note_id") % 20 == 0, dims=MODEL_DIMS)


def p5_found(spark, d):
    pairs = C.near_copies(table(spark, d, "note_fields"), "note_id", "value_html", 70, 18)
    return pairs.select(F.col("a").alias("note_id_a"), F.col("b").alias("note_id_b"))


def p5_classes(spark, d):
    return C.copy_classes(table(spark, d, "note_fields"), "note_id", "value_html", 70, 18).withColumnRenamed("id", "note_id")


def p6_containers(spark, d):
    return K.containers(K.placements(table(spark, d, "documents"), table(spark, d, "container_specs")))


def p6_report(spark, d):
    return K.packing_report(K.placements(table(spark, d, "documents"), table(spark, d, "container_specs")))


def p7_mix(spark, d):
    return M.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p7_shares(spark, d):
    return M.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p8_found(spark, d):
    return L.same_reading(table(spark, d, "documents"))


def p8_classes(spark, d):
    return L.reading_classes(table(spark, d, "documents"))


def p8_scripts(spark, d):
    return L.script_report(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_topics, p4_found, p4_nearest, p5_found, p5_classes, p6_containers, p6_report, p7_mix, p7_shares, p8_found, p8_classes, p8_scripts)}

#: Brute force over all pairs of vectors.
_VECTORS = """u as (select model, note_id, vec::double[] as vec, updated_at from embeddings2 where note_id is not null and vec is not null and len(vec) = case model when 'quill-embed-8b' then 64 when 'tern-embed-2' then 64 when 'finch-300m' then 48 end),
ok as (select *, list_sum(list_transform(vec, lambda x: abs(x))) as total from u), cv as (select model, note_id, vec from (select *, row_number() over (partition by model, note_id order by updated_at desc nulls last, vec desc) as rn from ok where total is not null and not isnan(total) and not isinf(total) and total > 0) where rn = 1),
e as (select model, note_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as v from cv)"""

SQL: dict[str, str] = {
    "p4_found": f"""with {_VECTORS}, pairs as (select a.model, a.note_id as a, b.note_id as b, list_dot_product(a.v, b.v) as cos from e a join e b on a.model = b.model and a.note_id < b.note_id where list_dot_product(a.v, b.v) >= 0.95),
pairs_both as (select model, a, b, cos from pairs union all select model, b, a, cos from pairs), top as (select * from pairs_both qualify row_number() over (partition by model, a order by cos desc, b) <= 5)
select distinct model, least(a, b) as note_id_a, greatest(a, b) as note_id_b from top""",
}
