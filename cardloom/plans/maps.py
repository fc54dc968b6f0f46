"""Queries of topic maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import hierarchy as Y
from cardloom.operators import index as I
from cardloom.operators import notes as N
from cardloom.operators import similarity as V
from cardloom.operators import topicmaps as M
from cardloom.plans import sql as S
from cardloom.plans.upkeep import _TREE
from cardloom.shared import table

QUERIES, SQL = {}, {}
_DIMS = {"quill-embed-8b": 64, "tern-embed-2": 64, "finch-300m": 48}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOPICS = "tr as (select * exclude (rn) from (select *, row_number() over (partition by run_id, topic_id order by size desc nulls last, label nulls last, parent_id nulls last, level nulls last) as rn from topics where run_id is not null and topic_id is not null) where rn = 1)"


def _vectors(spark, d, model):
    return V.current_vectors(table(spark, d, "embeddings2")).where((F.col("model") == model) & (F.size("vec") == _DIMS[model]))


_SIZES = (100, 1499, 1500, 5000, 10_000, 10_001, 20_000, 20_001, 40_000)
_PARAMETERS = """with a as (select n, case when n >= 40000 then 18 when n >= 20000 then 16 when n >= 10000 then 12 when n >= 5000 then 9 when n >= 1500 then 7 else 5 end as size from (values {}) v(n)),
p as (select n, size as min_cluster_size, greatest(3, size // 3) as min_samples, greatest(4, floor(size * 0.8 + 0.5)) as min_topic_size,
  least(45, greatest(8, floor(sqrt(least(n, 2500)) + 0.5) + 5)) as n_neighbors, 15 as n_components, case when n > 10000 then 0.015 else 0.035 end as min_dist,
  case when n > 20000 then 10 when n > 10000 then 5 else 1 end as min_df, case when n > 20000 then 20000 when n > 10000 then 15000 else 8000 end as max_features, 12 as top_terms, 42 as seed from a)
select n, parameter, value from (select n, columns(* exclude n)::double from p) unpivot (value for parameter in (* exclude n))"""


@query(_PARAMETERS.format(", ".join(f"({n})" for n in _SIZES)))
def topic_parameters(spark, d):
    rows = [(n, k, float(v)) for n in _SIZES for k, v in M.schedule(n).items()]
    return spark.createDataFrame(rows, "n int, parameter string, value double")


_CENT = f"""{S.VECTORS}, td as (select distinct run_id, topic_id, note_id from topic_docs where topic_id >= 0),
tv as (select run_id, topic_id, vec from td join cv using (note_id) where model = 'quill-embed-8b'),
e as (select run_id, topic_id, p, avg(vec[p]::double) as x from (select *, unnest(range(1, 65)) as p from tv where len(vec) = 64) group by all),
c as (select run_id, topic_id, list(x order by p) as centroid from e group by all)"""


@query(f"with {_CENT} select run_id, topic_id, cast(len(centroid) as int) as dim, round(centroid[1], 5) as c1, round(centroid[64], 5) as c64, round(list_sum(centroid), 5) as total from c")
def topic_centroids(spark, d):
    c = M.centroids(table(spark, d, "topic_docs"), _vectors(spark, d, "quill-embed-8b"))
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return c.select("run_id", "topic_id", F.size("centroid").alias("dim"), F.round(F.col("centroid")[0], 5).alias("c1"), F.round(F.element_at("centroid", -1), 5).alias("c64"), F.round(total, 5).alias("total"))


@query(f"with {_CENT} select td.run_id, td.topic_id, td.note_id, round({S.cosine('cv.vec', 'c.centroid')}, 5) as cos from td join c using (run_id, topic_id) join cv on cv.note_id = td.note_id and cv.model = 'quill-embed-8b' and len(cv.vec) = 64")
def topic_doc_cos(spark, d):
    docs, v = table(spark, d, "topic_docs").where("topic_id >= 0"), _vectors(spark, d, "quill-embed-8b")
    return M.document_cosines(docs, v, M.centroids(docs, v)).select("run_id", "topic_id", "note_id", F.round("cos", 5).alias("cos"))


@query(f"""with {_CENT}, r as (select run_id, query_embedding as q from (select *, row_number() over (partition by run_id order by created_at desc, query_embedding desc) as rn from topic_runs where query_embedding is not null) where rn = 1)
select run_id, topic_id, round(case when len(q) = 64 then {S.cosine('centroid', 'case when len(q) = 64 then q else centroid::float[] end')} end, 5) as query_cos from c join r using (run_id)""")
def topic_query_cos(spark, d):
    c = M.centroids(table(spark, d, "topic_docs"), _vectors(spark, d, "quill-embed-8b"))
    return M.query_cosines(table(spark, d, "topic_runs"), c).select("run_id", "topic_id", F.round("query_cos", 5).alias("query_cos"))


_CLASS = f"""{S.INDEX}, w as (select 'run' as k, td.run_id || '/' || td.topic_id as class, unnest(tokens) as term from (select distinct run_id, topic_id, note_id from topic_docs where topic_id >= 0) td join idx using (note_id)),
tf as (select class, term, count(*) as tf from w group by all), sz as (select class, sum(tf) as size from tf group by 1), tot as (select term, sum(tf) as total from tf group by 1),
sc as (select class, term, tf / size * ln(1 + (select avg(size) from sz) / total) as score from tf join sz using (class) join tot using (term)),
ct as (select class, term, score, row_number() over (partition by class order by round(score, 9) desc, term) as rank from sc qualify rank <= 12)"""


def _classes(spark, d):
    docs = table(spark, d, "topic_docs").where("topic_id >= 0").select("run_id", "topic_id", "note_id").distinct()
    rows = docs.join(I.documents_index(table(spark, d, "notes"), table(spark, d, "note_fields")), "note_id")
    return rows.select(F.concat_ws("/", "run_id", F.col("topic_id").cast("string")).alias("class"), "tokens")


@query(f"with {_CLASS} select class, term, round(score, 6) as score, cast(rank as int) as rank from ct")
def ctfidf_terms(spark, d):
    return M.class_terms(_classes(spark, d), 12).select("class", "term", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_CLASS}, {_TOPICS}, t as (select string_split(class, '/')[1] as run_id, cast(string_split(class, '/')[2] as int) as topic_id, term, score from ct),
p as (select run_id, parent_id, term, sum(t.score * greatest(coalesce(size, 0), 1)) as score from t join tr using (run_id, topic_id) where parent_id is not null group by all)
select run_id, parent_id, term, round(score, 5) as score, cast(rank as int) as rank from (select *, row_number() over (partition by run_id, parent_id order by round(score, 9) desc, term) as rank from p) where rank <= 12""")
def parent_term_rollup(spark, d):
    parts = F.split("class", "/")
    terms = M.class_terms(_classes(spark, d), 12).select(parts[0].alias("run_id"), parts[1].cast("int").alias("topic_id"), "term", "score")
    return M.parent_terms(terms, table(spark, d, "topics")).select("run_id", "parent_id", "term", F.round("score", 5).alias("score"), "rank")


@query()
def topic_terms_diverse(spark, d):
    from cardloom.sources.models import HashingEmbedder, embedded

    terms = M.class_terms(_classes(spark, d), 20)
    vectors = embedded(terms.select("term").distinct(), "term", HashingEmbedder).select("term", "vec")
    return M.diverse_terms(terms.select("class", "term", "score"), vectors)


@query(f"""with recursive {_TREE}, {_TOPICS},
up as (select run_id, topic_id, unnest(string_split(node_path, '/')) as anc from all_nodes where state = 'tree')
select run_id, cast(anc as int) as topic_id, cast(sum(greatest(coalesce(size, 0), 0)) as bigint) as total from up join tr using (run_id, topic_id) group by all""")
def topic_tree_sizes(spark, d):
    t = table(spark, d, "topics")
    return M.tree_sizes(t, Y.hierarchy(t))


@query(f"""with recursive {_TREE}, x as (select a.*, exists (select 1 from all_nodes b where b.run_id = a.run_id and b.parent_id = a.topic_id and b.state = 'tree' and b.depth > 0) as inner_node from all_nodes a where state = 'tree')
select run_id, count(*) as n_topics, count(*) filter (depth = 0) as n_roots, count(*) filter (not inner_node) as n_leaves, count(*) filter (depth > 0) as n_links, max(depth) as max_depth from x group by 1""")
def topic_tree_stats(spark, d):
    return M.tree_stats(Y.hierarchy(table(spark, d, "topics")))


@query(f"""with {_TOPICS}, x as (select tr.run_id, tr.parent_id, p.topic_id is not null as known from tr left join tr p on p.run_id = tr.run_id and p.topic_id = tr.parent_id),
g as (select run_id, count(parent_id) as n_links, count(*) filter (parent_id is not null and not known) as n_missing from x group by 1) select *, n_links > 0 and n_missing = 0 as valid from g""")
def topic_links_valid(spark, d):
    return M.invalid_links(table(spark, d, "topics"))


@query(f"""with {_TOPICS}, x as (select tr.run_id, tr.topic_id, tr.parent_id, greatest(coalesce(tr.size, 0), 1) as value, p.topic_id is not null as known from tr left join tr p on p.run_id = tr.run_id and p.topic_id = tr.parent_id and p.topic_id >= 0 where tr.topic_id >= 0)
select run_id, case when known then cast(parent_id as varchar) else 'ROOT' end as source, cast(topic_id as varchar) as target, cast(value as bigint) as value from x""")
def topic_sankey_edges(spark, d):
    return M.sankey(table(spark, d, "topics"))


@query("with o as (select distinct scope_hash, backend, model, run_id, created_at from topic_runs) select scope_hash, run_id, created_at, cast(row_number() over (partition by scope_hash, backend, model order by created_at desc, run_id) as int) as place from o qualify place <= 5")
def topic_history(spark, d):
    return M.history(table(spark, d, "topic_runs"), 5)


@query("select run_id, topic_id, note_id from topic_docs where run_id in (select run_id from topic_runs where created_at >= 1767500000)")
def purge_runs(spark, d):
    kept = M.purged(table(spark, d, "topic_runs"), 1_770_000_000, 2_500_000).select("run_id").distinct()
    return table(spark, d, "topic_docs").join(kept, "run_id", "left_semi").select("run_id", "topic_id", "note_id")


@query("select run_id, topic_id, note_id, weight from topic_docs where run_id <> (select min(run_id) from topic_docs)")
def delete_run(spark, d):
    t = table(spark, d, "topic_docs")
    return M.without_run(t, t.agg(F.min("run_id").alias("r")).head()["r"]).select("run_id", "topic_id", "note_id", "weight")


@query(f"""with {S.FIELDS}, {S.FRONT}, {_TOPICS}, r as (select max(run_id) as run_id from topics), v as (select note_id, {S.strip_html('front')} <> '' or regexp_matches(front, '\\[sound:[^\\]]+\\]', 'i') or regexp_matches(front, '<img\\b', 'i') as visible from front),
k as (select parent_id as topic_id, string_agg(cast(topic_id as varchar), ',' order by topic_id) as children from tr where run_id = (select run_id from r) and parent_id is not null group by 1),
n as (select topic_id, count(*) as n_notes, count(*) filter (visible) as n_visible from (select distinct topic_id, note_id from topic_docs where run_id = (select run_id from r)) left join v using (note_id) group by 1)
select topic_id, parent_id, label, size, coalesce(children, '') as children, coalesce(n_notes, 0) as n_notes, coalesce(n_visible, 0) as n_visible from tr left join k using (topic_id) left join n using (topic_id) where run_id = (select run_id from r)""")
def topic_map_details(spark, d):
    t = table(spark, d, "topics")
    run = t.agg(F.max("run_id").alias("r")).head()["r"]
    return M.details(t, table(spark, d, "topic_docs"), N.visible_notes(table(spark, d, "note_fields")), run or "")


@query(f"with {_TOPICS} select run_id, topic_id from tr where parent_id is null or not exists (select 1 from tr p where p.run_id = tr.run_id and p.topic_id = tr.parent_id)")
def topic_map_roots(spark, d):
    return M.map_roots(table(spark, d, "topics"))


@query(f"""with {S.LISTED}, o as (select *, row_number() over (partition by run_id, topic_id, note_id order by weight desc nulls last, cos desc nulls last) as rn from topic_docs)
select run_id, topic_id, note_id, round(weight, 6) as weight, round(cos, 6) as cos, front from o join listed using (note_id) where rn = 1 and {S.VISIBLE}""")
def topic_map_notes(spark, d):
    fronts = N.with_front(table(spark, d, "topic_docs").where("note_id is not null"), table(spark, d, "notes"), table(spark, d, "note_fields"))
    rows = M.map_notes(table(spark, d, "topic_docs"), fronts)
    return rows.withColumns({"weight": F.round("weight", 6), "cos": F.round("cos", 6)})


@query(f"""with {S.FIELDS}, {S.FRONT}, w as (select run_id, topic_id, note_id, max(weight) as weight from topic_docs group by all), t as (select note_id, {S.strip_html('front')} as text from front)
select run_id, topic_id, note_id, text, cast(row_number() over (partition by run_id, topic_id order by weight desc nulls last, note_id) as int) as place from w join t using (note_id) where text <> '' qualify place <= 12""")
def topic_preview_notes(spark, d):
    return M.preview_notes(table(spark, d, "topic_docs"), N.front(table(spark, d, "note_fields")))


@query("""select distinct run_id, case when scope->>'type' in ('query', 'tag', 'deck') then (scope->>'type') || ':' || case scope->>'type' when 'query' then scope->>'query' when 'tag' then scope->>'tag' else scope->>'deck' end
  when scope->>'type' = 'note-set' then 'note-set:' || coalesce(array_to_string(list_sort(cast(scope->'noteIds' as bigint[])), ','), '')
  when scope->>'type' = 'global' then concat_ws(':', 'global', scope->>'profile')
  else coalesce((scope->>'id') || ':' || (scope->>'label'), 'custom:' || (scope->>'id')) end as scope_label from topic_runs""")
def topic_scope_labels(spark, d):
    return M.scope_label(table(spark, d, "topic_runs")).select("run_id", "scope_label").distinct()


def _maps(spark, d, part):
    """A map over all notes with a front of every model."""
    index, out = I.documents_index(table(spark, d, "notes"), table(spark, d, "note_fields")), None
    for model in _DIMS:
        rows = M.build(_vectors(spark, d, model).select("note_id", "vec").join(index, "note_id"))[part].withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def topic_map_build(spark, d):
    """Bisecting clusters of reduced vectors, c-TF-IDF labels of up to three words, Ward's tree over c-TF-IDF."""
    return _maps(spark, d, 0)


@query()
def topic_map_members(spark, d):
    return _maps(spark, d, 1).withColumn("cos", F.round("cos", 6))


@query(f"with {_TOPICS} select run_id, topic_id, {S.collapse('lower(label)')} as label from tr")
def topic_labels_normal(spark, d):
    return M.topic_rows(table(spark, d, "topics")).select("run_id", "topic_id", T.collapse(F.lower("label")).alias("label"))
