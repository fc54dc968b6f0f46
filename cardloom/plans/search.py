"""Queries of full-text, vector, hybrid and reranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import scores as C
from cardloom.functions import text as T
from cardloom.operators import hybrid as H
from cardloom.operators import index as I
from cardloom.operators import keyphrases as K
from cardloom.operators import notes as N
from cardloom.operators import ranking as R
from cardloom.operators import search as Q
from cardloom.operators import similarity as V
from cardloom.plans import sql as S
from cardloom.shared import cut, scratch, table, version, written
from cardloom.sources import models as M

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_opened: dict[tuple, str] = {}


def _index(spark, d):
    """The stored index of the tables: written by the first query of an application and opened by the later ones, unless notes or fields have changed."""
    key = spark.sparkContext.applicationId, d, version(spark, f"{d}/notes.parquet"), version(spark, f"{d}/note_fields.parquet")
    if key not in _opened or not written(spark, f"{_opened[key]}/postings"):
        _opened[key] = scratch(spark, "index")
        return I.stored(I.documents_index(table(spark, d, "notes"), table(spark, d, "note_fields")), _opened[key])
    return I.opened(spark, _opened[key])


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


TERMS = {0: ["ganglion", "linear capacitor", "vesicle"]}
BATCH = {0: ["ganglion", "linear"], 1: ["tensor test"], 2: ["chamber", "sinus", "reef"], 3: ["nothing-here"]}


@query(f"with {S.bm25(TERMS)} select note_id, round(bm25, 6) as bm25, cast(place as int) as place from (select *, row_number() over (order by bm25, note_id) as place from scores) where place <= 200")
def bm25_terms(spark, d):
    rows = R.bm25_top(_index(spark, d), R.query_terms(spark, TERMS), 200)
    return rows.select("note_id", _r("bm25").alias("bm25"), "place")


@query(f"with {S.bm25({0: ['tensor test for']})} select note_id, round(bm25, 6) as bm25 from scores")
def bm25_phrase(spark, d):
    return R.bm25(_index(spark, d), R.query_terms(spark, {0: ["tensor test for"]})).select("note_id", _r("bm25").alias("bm25"))


@query(f"with {S.bm25(BATCH)} select query_id, note_id, round(bm25, 6) as bm25, cast(place as int) as place from (select *, row_number() over (partition by query_id order by bm25, note_id) as place from scores) where place <= 40")
def bm25_batch(spark, d):
    return R.bm25_top(_index(spark, d), R.query_terms(spark, BATCH), 40).select("query_id", "note_id", _r("bm25").alias("bm25"), "place")


@query(f"with {S.bm25(TERMS)} select note_id, round(bm25, 6) as bm25 from scores where note_id in (select note_id from note_tags where tag = 'inbox::unsorted')")
def bm25_for_ids(spark, d):
    ids = table(spark, d, "note_tags").where("tag = 'inbox::unsorted'")
    return N.restrict(R.bm25(_index(spark, d), R.query_terms(spark, TERMS)), ids).select("note_id", _r("bm25").alias("bm25"))


@query(f"""with {S.INDEX}, src as (select max(note_id) as note_id from listed where length(front) > 60),
t as (select replace(w, '"', '') as term, i from (select unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from (select list_filter(string_split({S.strip_html('front')}, ' '), lambda x: x <> '') as ws from listed join src using (note_id))) where i <= 16),
terms as (select 0 as query_id, i as term_idx, term, {S.tokens('term')} as words from t),
{S.SCORES} select note_id, round(bm25, 6) as bm25 from (select *, row_number() over (order by bm25, note_id) as p from scores) where p <= 100 and note_id <> (select note_id from src) order by bm25, note_id limit 20""")
def related_bm25(spark, d):
    """Notes related to the newest one by the words of its front; it is not its own relative."""
    fronts = N.with_front(table(spark, d, "notes"), table(spark, d, "notes"), table(spark, d, "note_fields"))
    note = fronts.where(F.length("front") > 60).agg(F.max("note_id").alias("n")).head()["n"] or 0
    terms = R.related_terms(fronts, note)
    rows = R.bm25_top(_index(spark, d), R.query_terms(spark, {0: terms}), 100).where(F.col("note_id") != note)
    return rows.orderBy("bm25", "note_id").limit(20).select("note_id", _r("bm25").alias("bm25"))


@query(f"with {S.bm25({0: ['ganglion', 'linear capacitor', 'reef']})} select note_id, round(bm25, 6) as bm25, cast(place as int) as place from (select *, row_number() over (order by bm25, note_id) as place from scores) where place <= 150")
def bm25_any_of_terms(spark, d):
    return Q.or_search(spark, _index(spark, d), ["ganglion", "linear capacitor", "reef"], 150).select("note_id", _r("bm25").alias("bm25"), "place")


_NOUN = "(?:" + "|".join(C.NOUN_ENDINGS) + ")$"
FUZZY = {0: ["ganglion", "linear capacitor", "Vesicle", "slow"]}


def _fuzzy_sql(terms):
    hit = lambda c: "coalesce(" + " or ".join(f"contains(lower({c}), '{t.lower()}')" for t in terms) + ", false)"
    return rf"""with {S.bm25({0: terms})}, {S.BACK},
ranked as (select * from (select *, row_number() over (partition by query_id, term_idx order by part, note_id) as rank from parts) where rank <= 1000),
w as (select *, case when contains(term, ' ') or (strip_accents(lower(term)) = term and not contains(term, '-')) then df else 0 end as known from ranked),
f as (select *, 1 + least(3.0, greatest(0.0, ln((n - known + 0.5) / (known + 0.5)))) + case when contains(term, '-') then 0.75 else 0.0 end + case when len(term) >= 8 then 0.25 else 0.0 end
  + case when contains(term, '-') or regexp_matches(term, '{_NOUN}') or (len(term) >= 5 and not regexp_matches(term, '(?:ing|ed)$')) then 3.5 else 0.0 end as weight from w),
fused as (select query_id, note_id, sum(weight / (60 + rank)) as rrf, min(part) as bm25 from f group by all),
hit as (select note_id, rrf, bm25, front, {hit('front')} as f, {hit('back')} as b from fused left join front using (note_id) left join back using (note_id))
select note_id, round(rrf, 6) as rrf, round(bm25, 6) as bm25, case when f and b then 'both' when f then 'front' when b then 'back' end as found_in"""


@query(_fuzzy_sql(FUZZY[0]) + " from hit")
def fuzzy_fixed_terms(spark, d):
    f = table(spark, d, "note_fields")
    rows = R.fuzzy(_index(spark, d), R.query_terms(spark, FUZZY), 1000).select("note_id", _r("rrf").alias("rrf"), _r("bm25").alias("bm25"))
    return R.where_found(rows, N.front(f), N.back(f), FUZZY[0])


#: A query as typed.
TYPED = "The ganglion of a linear-capacitor includes a vesicle and reef osmosis"


def _fuzzy_text(spark, d, text, exclude=()):
    rows = Q.fuzzy_search(spark, _index(spark, d), table(spark, d, "notes"), table(spark, d, "note_fields"), text, 50, exclude)
    return rows.select("note_id", _r("rrf").alias("rrf"), _r("bm25").alias("bm25"), "found_in", "front")


@query(_fuzzy_sql(Q.query_keywords(TYPED)) + ", front from hit")
def fuzzy_search_text(spark, d):
    return _fuzzy_text(spark, d, TYPED)


@query(_fuzzy_sql(["the", "ganglion"]) + ", front from hit")
def fuzzy_search_plain_words(spark, d):
    """Where all keywords are excluded the query's words are searched."""
    return _fuzzy_text(spark, d, "the ganglion", ["GANGLION"])


@query(f"with {S.LISTED} select note_id, 0.0::double as rrf, null::double as bm25, null::varchar as found_in, front from listed order by note_id desc limit 50")
def fuzzy_search_empty(spark, d):
    return _fuzzy_text(spark, d, "  ")


@query(f"""with {S.bm25(BATCH)},
a as (select note_id, r from (select note_id, row_number() over (order by bm25, note_id) as r from scores where query_id = 0) where r <= 5000),
b as (select note_id, r from (select note_id, row_number() over (order by length(front) desc, note_id) as r from front where front is not null) where r <= 5000)
select note_id, round(sum(1.0 / (60 + r)), 6) as rrf from (select * from a union all select * from b) group by 1""")
def rrf_two_lists(spark, d):
    a = R.bm25(_index(spark, d), R.query_terms(spark, BATCH)).where("query_id = 0").select("note_id", F.col("bm25").alias("score"))
    b = N.front(table(spark, d, "note_fields")).where("front is not null").select("note_id", F.length("front").cast("double").alias("score"))
    return R.rrf_two(a, b).select("note_id", _r("rrf").alias("rrf"))


_LISTS = f"{S.bm25(BATCH)}, l as (select query_id, term_idx as list_idx, note_id, row_number() over (partition by query_id, term_idx order by part, note_id) as rank from parts)"


def _lists(spark, d):
    parts = R.term_scores(_index(spark, d), R.query_terms(spark, BATCH))
    w = R.Window.partitionBy("query_id", "term_idx").orderBy("part", "note_id")
    return parts.select("query_id", F.col("term_idx").alias("list_idx"), "note_id", F.row_number().over(w).alias("rank"))


@query(f"with {_LISTS} select query_id, note_id, round(sum(1.0 / (60 + rank)), 6) as rrf from l group by all")
def rrf_per_keyword(spark, d):
    return R.rrf(_lists(spark, d)).select("query_id", "note_id", _r("rrf").alias("rrf"))


@query(f"with {_LISTS} select query_id, note_id, round(sum((case list_idx when 0 then 2.0 when 1 then 1.0 else 0.0 end) / (60 + rank)), 6) as rrf from l group by all")
def rrf_weighted(spark, d):
    weight = F.when(F.col("list_idx") == 0, 2.0).when(F.col("list_idx") == 1, F.lit(float("nan"))).otherwise(-1.0)
    return R.rrf(_lists(spark, d), weight=weight).select("query_id", "note_id", _r("rrf").alias("rrf"))


@query(f"""with {S.FIELDS}, {S.FRONT}, g as (select distinct unnest({R.trigrams_of(['linear', 'capacitor'])}) as gram),
t as (select note_id, lower(substr(front, i, 3)) as gram from (select note_id, front, unnest(range(1, length(front) - 1)) as i from front where length(front) >= 3))
select note_id, cast(count(distinct gram) as int) as hits from t where gram in (select gram from g) group by 1 order by hits desc, note_id limit 300""")
def trigram_overlap(spark, d):
    rows = N.front(table(spark, d, "note_fields")).where("front is not null")
    return R.trigram_overlap(rows, "front", R.trigrams_of(["linear", "capacitor"]), 300)


# vectors -----------------------------------------------------------------------------------------

#: The smallest note with a usable vector asks for its model's others.
_Q = f"{S.VECTORS}, q as (select model, min(note_id) as note_id from cv group by 1), qv as (select cv.* from cv join q using (model, note_id))"


def _vectors(spark, d):
    return V.current_vectors(table(spark, d, "embeddings2"))


def _ask(vectors):
    first = vectors.groupBy("model").agg(F.min("note_id").alias("note_id"))
    return vectors.join(first, ["model", "note_id"]).select(F.lit(0).alias("query_id"), "model", F.col("vec").alias("qvec"))


_SCAN = f"{_Q}, cos as (select cv.model, cv.note_id, {S.cosine('cv.vec', 'qv.vec')} as cos from cv join qv on cv.model = qv.model and len(cv.vec) = len(qv.vec))"


@query(f"with {_SCAN} select model, note_id, round(cos, 6) as cos, cast(place as int) as place from (select *, row_number() over (partition by model order by cos desc, note_id) as place from cos) where place <= 100")
def semantic_topk(spark, d):
    v = _vectors(spark, d)
    rows = V.cosine_scan(v, _ask(v))
    return R.top(rows, 100, F.desc("cos"), by="model").select("model", "note_id", _r("cos").alias("cos"), "place")


@query(f"with {_SCAN}, m as (select note_id, avg(cos) as cos, count(*) as n_models from cos group by 1) select note_id, round(cos, 6) as cos, n_models, cast(place as int) as place from (select *, row_number() over (order by cos desc, note_id) as place from m) where place <= 100")
def semantic_multi_mean(spark, d):
    v = _vectors(spark, d)
    return V.semantic_mean(v, _ask(v)).select("note_id", _r("cos").alias("cos"), "n_models", "place")


@query(f"with {_SCAN} select note_id, round(max(cos), 6) as cos from cos where model = 'quill-embed-8b' group by 1")
def semantic_arrow(spark, d):
    """The same scan by matrix products over Arrow batches."""
    v = _vectors(spark, d)
    q = _ask(v).where("model = 'quill-embed-8b'").head()
    return V.cosine_scan_arrow(v, list(q["qvec"]), "quill-embed-8b").select("note_id", _r("cos").alias("cos"))


@query(f"""with {_SCAN}, pool as (select distinct note_id from note_tags where tag = 'inbox::unsorted')
select note_id, round(cos, 6) as cos from (select * from cos where model = 'quill-embed-8b' and note_id in (select note_id from pool) and note_id <> (select note_id from q where model = 'quill-embed-8b') and cos >= 0.1 order by cos desc, note_id limit 50)""")
def related_by_embedding(spark, d):
    v = _vectors(spark, d)
    note = v.where("model = 'quill-embed-8b'").agg(F.min("note_id").alias("n")).head()["n"]
    pool = table(spark, d, "note_tags").where("tag = 'inbox::unsorted' and note_id is not null").select("note_id").distinct()
    return V.related(v, note or 0, "quill-embed-8b", pool, 0.1, 50).select("note_id", _r("cos").alias("cos"))


_THREE = f"{S.VECTORS}, three as (select note_id as qid, vec from (select *, row_number() over (order by note_id) as n from cv where model = 'tern-embed-2') where n <= 3), cos as (select qid, note_id, {S.cosine('cv.vec', 'three.vec')} as cos from cv join three on cv.model = 'tern-embed-2' and len(cv.vec) = len(three.vec))"


def _three(v):
    first = v.where("model = 'tern-embed-2'").orderBy("note_id").limit(3)
    return first.select(F.col("note_id").alias("query_id"), "model", F.col("vec").alias("qvec"))


@query(f"with {_THREE}, l as (select * from (select *, row_number() over (partition by qid order by cos desc, note_id) as place from cos) where place <= 200) select note_id, round(max(cos), 6) as cos, round(sum(1.0 / (60 + place)), 6) as rrf from l group by 1 order by max(cos) desc, sum(1.0 / (60 + place)) desc, note_id limit 100")
def related_terms_rrf(spark, d):
    v = _vectors(spark, d)
    return V.related_by_terms(v, _three(v), 100).select("note_id", _r("cos").alias("cos"), _r("rrf").alias("rrf"))


@query(f"with {_THREE} select note_id, round(max(cos), 6) as cos from cos group by 1 order by max(cos) desc, note_id limit 20")
def related_terms_best(spark, d):
    v = _vectors(spark, d)
    return V.best_over_terms(v, _three(v), 20).select("note_id", _r("cos").alias("cos"))


@query(f"""with {S.VECTORS}, q as (select vec from cv where model = 'tern-embed-2' order by note_id limit 1)
select note_id, model, round(case when len(cv.vec) = len(q.vec) then {S.cosine('cv.vec', 'q.vec')} else -1 end, 6) as cos from cv cross join q where note_id in (select note_id from note_tags where tag = 'inbox::unsorted')""")
def cosine_for_terms(spark, d):
    v = _vectors(spark, d)
    q = v.where("model = 'tern-embed-2'").orderBy("note_id").limit(1).select(F.col("vec").alias("qvec"))
    ids = table(spark, d, "note_tags").where("tag = 'inbox::unsorted'")
    return V.cosines_against(v, ids, q).select("note_id", "model", _r("cos").alias("cos"))


@query(f"""with {_THREE}, m as (select list(x order by p) as vec from (select p, avg(vec[p]::double) as x from (select vec, unnest(range(1, len(vec) + 1)) as p from three) group by p))
select note_id, model, round(case when len(cv.vec) = len(m.vec) then {S.cosine('cv.vec', 'm.vec')} else -1 end, 6) as cos from cv cross join m where note_id in (select note_id from note_tags where tag = 'inbox::unsorted')""")
def cosine_terms_combo(spark, d):
    v = _vectors(spark, d)
    mean = V.mean_vector(_three(v).withColumn("g", F.lit(0)), ["g"], "qvec").select(F.col("centroid").alias("qvec"))
    ids = table(spark, d, "note_tags").where("tag = 'inbox::unsorted'")
    return V.cosines_against(v, ids, mean).select("note_id", "model", _r("cos").alias("cos"))


@query(f"with {S.VECTORS} select note_id, model, cast(least(len(vec), 48) as int) as dim, round(sqrt(list_dot_product(vec[1:48]::double[], vec[1:48]::double[])), 5) as norm from cv")
def vector_truncate_norm(spark, d):
    rows = _vectors(spark, d).withColumn("dim", F.size("vec")).withColumn("norm", C.norm(F.col("vec")))
    return V.truncated(rows, 48).select("note_id", "model", "dim", F.round("norm", 5).alias("norm"))


@query(f"with {S.VECTORS} select note_id, model, round(sqrt(list_dot_product(vec::double[], vec::double[])), 5) as norm from cv")
def vector_norms(spark, d):
    return V.norms(V.from_blobs(V.to_blobs(_vectors(spark, d)).drop("vec"))).select("note_id", "model", F.round("norm", 5).alias("norm"))


@query(f"""with {S.VECTORS}, q as (select vec from cv where model = 'finch-300m' and len(vec) = 48 order by note_id limit 1), m as (select note_id, model, vec, least(len(cv.vec), 48) as n from cv)
select m.note_id, m.model, round({S.cosine('m.vec[1:n]', 'q.vec[1:n]')}, 6) as cos from m cross join q""")
def cosine_overlap(spark, d):
    """A shorter vector against those of all models, over the numbers both have."""
    v = _vectors(spark, d)
    q = v.where("model = 'finch-300m' and size(vec) = 48").orderBy("note_id").limit(1).select(F.col("vec").alias("qvec"))
    return v.join(F.broadcast(q)).select("note_id", "model", F.round(V.overlap_cosine(F.col("vec"), F.col("qvec")), 6).alias("cos"))  # one row


@query(f"""with {S.VECTORS}, ids as (select distinct note_id, note_id as pos from notes where note_id is not null), x as (select ids.note_id, pos, vec from ids left join (select note_id, vec from cv where model = 'tern-embed-2') using (note_id)),
n as (select len(vec) as dim from x where vec is not null order by pos limit 1)
select note_id, vec is not null as known, cast(dim as int) as dim, round(coalesce(list_sum(vec[1:dim]::double[]), 0), 4) as total from x cross join n""")
def vectors_of_ids(spark, d):
    """A vector for every note, zeros where there is none."""
    ids = table(spark, d, "notes").where("note_id is not null").select("note_id").distinct().withColumn("pos", F.col("note_id"))
    rows = V.vectors_for(ids, _vectors(spark, d).where("model = 'tern-embed-2'"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rows.select("note_id", "known", F.size("vec").alias("dim"), F.round(total, 4).alias("total"))


@query()
def keyword_clusters(spark, d):
    """The keywords of each note's front as a list of at most eight terms, clustered greedily by their vectors."""
    words = N.front(table(spark, d, "note_fields")).select(F.col("note_id").alias("list_id"), F.posexplode(K.keyword_column(T.plain(F.col("front")), 8)).alias("place", "term"))
    return V.greedy_clusters(M.embedded(words, "term", M.HashingEmbedder, "query").select("list_id", "place", "term", "vec"), 0.6)


@query()
def ann_search(spark, d):
    """The ten nearest notes of every note whose id is divisible by 20, in each model, by the approximate index over all its vectors."""
    v = _vectors(spark, d)
    out = None
    for model, dim in _DIMS.items():
        rows = V.lsh_search(v, model, dim, F.col("note_id") % 20 == 0, 10)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {S.VECTORS} select backend, model, cast(len(vec) as int) as dim, count(*) as n_vectors, len(vec) = case model when 'finch-300m' then 48 else 64 end as indexed from cv group by all")
def ann_status(spark, d):
    return V.index_status(_vectors(spark, d), _DIMS)


# hybrid and rerank ----------------------------------------------------------------------------

_EMB, _WORDS = H.candidate_caps(40)
_MODEL = "quill-embed-8b"
_DIMS = {"quill-embed-8b": 64, "tern-embed-2": 64, "finch-300m": 48}
_SCORE = """(select *, 1 - (least(1, greatest(0, (s - 7) / 4.0)) ** 2) * (3 - 2 * least(1, greatest(0, (s - 7) / 4.0))) as plow,
  1 - (least(1, greatest(0, (c - 0.5) / (0.6 - 0.5))) ** 2) * (3 - 2 * least(1, greatest(0, (c - 0.5) / (0.6 - 0.5)))) as gate from
  (select *, least(1.0, greatest(0.0, coalesce(cos, 0))) as c, greatest(0.0, -coalesce(bm25, 0)) as s from cand))"""


def _hybrid_sql(words, keywords, qvec, near_most):
    """Hybrid search in SQL: words asked for, keywords counted, the query's vector."""
    matched = " + ".join(f"(contains(html, '{k.lower()}'))::int" for k in keywords)
    q = "[" + ", ".join(repr(float(x)) for x in qvec) + "]::double[]"
    return f"""with {S.bm25({0: words})}, {S.BACK}, {S.VECTORS},
cosines as (select note_id, {S.cosine('vec', q)} as cos from cv where model = '{_MODEL}' and len(vec) = {len(qvec)}),
near as (select note_id, cos from (select *, row_number() over (order by cos desc, note_id) as p from cosines) join front using (note_id) where p <= {near_most} and {S.VISIBLE}),
words as (select note_id, bm25 from (select *, row_number() over (order by bm25, note_id) as p from scores) where p <= {_WORDS}),
merged as (select coalesce(near.note_id, words.note_id) as note_id, cos, bm25 from near full join words on near.note_id = words.note_id),
m as (select note_id, coalesce(cos, late) as cos, bm25, concat_ws(chr(10), lower(front), lower(back)) as html from merged left join front using (note_id) left join back using (note_id) left join (select note_id, cos as late from cosines) using (note_id)),
cand as (select note_id, cos, bm25, {matched} as matched from m),
parts2 as (select *, plow * plow as heavy, greatest(0, plow - plow * plow) as modest, 0.03 * (1 - exp(-greatest(0, matched - 1) / 2.0)) as bonus from {_SCORE}),
final as (select *, c * least(1, greatest(0, 1 - (0.35 * heavy + 0.15 * modest) * gate)) as damped, least(0.65, greatest(0, 0.6 * (1 - exp(-s / 9.0)) - 0.02 + bonus) / (1 + exp(-0.45 * (s - 18)))) as share from parts2),
done as (select note_id, cos, bm25, matched, damped + share * (1 - damped) as score from final)
select note_id, round(cos, 6) as cos, round(bm25, 6) as bm25, cast(matched as int) as matched, round(score, 6) as score from (select *, row_number() over (order by score desc, note_id) as p from done) where p <= 40"""


def _model_vectors(spark, d):
    return _vectors(spark, d).where(F.col("model") == _MODEL)


def _scored(rows):
    return rows.select("note_id", _r("cos").alias("cos"), _r("bm25").alias("bm25"), "matched", _r("score").alias("score"))


@query(_hybrid_sql(Q.text_words(TYPED), K.keywords(TYPED, 16), M.HashingEmbedder()([TYPED])[0], min(100, _EMB)))
def hybrid_score(spark, d):
    """Hybrid search of a query as typed."""
    return _scored(Q.hybrid_search(spark, _index(spark, d), _model_vectors(spark, d), table(spark, d, "note_fields"), TYPED, _MODEL, M.HashingEmbedder(), 40))


@query()
def hybrid_from_note(spark, d):
    """Hybrid search by the front and the stored vector of the first note that has both."""
    v = _model_vectors(spark, d)
    note = v.join(N.front(table(spark, d, "note_fields")).where(F.length("front") > 40), "note_id").agg(F.min("note_id").alias("n")).head()["n"]
    return _scored(Q.hybrid_of_note(spark, _index(spark, d), v, table(spark, d, "note_fields"), note or 0, _MODEL, 40))


@query(f"""with {S.VECTORS}, {S.FIELDS}, {S.FRONT}, q(model, q) as (values ('quill-embed-8b', {S.numbers(M.HashingEmbedder(64)([TYPED])[0])}), ('finch-300m', {S.numbers(M.HashingEmbedder(48)([TYPED])[0])})),
c as (select note_id, avg({S.cosine('vec', 'q')}) as cos, count(*) as n_models from cv join q using (model) where len(vec) = len(q) group by 1)
select note_id, round(cos, 6) as cos, front from (select *, row_number() over (order by cos desc, note_id) as p from c) join front using (note_id) where p <= 100 and {S.VISIBLE}""")
def semantic_search_text(spark, d):
    """A typed query by the vectors of two models."""
    embed = {m: M.HashingEmbedder(_DIMS[m]) for m in ("quill-embed-8b", "finch-300m")}
    return Q.semantic_search(spark, _vectors(spark, d), table(spark, d, "note_fields"), TYPED, embed).select("note_id", _r("cos").alias("cos"), "front")


@query(f"""with {S.INDEX}, {S.VECTORS}, src as (select note_id, vec from (select cv.note_id, vec from cv join listed using (note_id) where model = 'quill-embed-8b' and len(vec) = 64 and length({S.strip_html('front')}) > 40) order by note_id limit 1),
t as (select replace(w, '"', '') as term, i from (select unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from (select list_filter(string_split({S.strip_html('front')}, ' '), lambda x: x <> '') as ws from listed join src using (note_id))) where i <= 12),
terms as (select 0 as query_id, i as term_idx, term, {S.tokens('term')} as words from t),
{S.SCORES}, pool as (select note_id from (select *, row_number() over (order by bm25, note_id) as p from scores) where p <= 600 and note_id <> (select note_id from src))
select note_id, round(cos, 6) as cos, front from (select cv.note_id, {S.cosine('cv.vec', 'src.vec')} as cos from cv cross join src where model = 'quill-embed-8b' and len(cv.vec) = 64 and cv.note_id in (select note_id from pool) order by cos desc, 1 limit 50) join front using (note_id) where cos >= 0 and {S.VISIBLE}""")
def related_by_note_words(spark, d):
    """The notes nearest to a note among the best for the words of its front."""
    v, f = _model_vectors(spark, d).where("size(vec) = 64"), table(spark, d, "note_fields")
    with_text = N.with_front(table(spark, d, "notes"), table(spark, d, "notes"), f).where(F.length(T.plain(F.col("front"))) > 40)
    note = v.join(with_text, "note_id").agg(F.min("note_id").alias("n")).head()["n"]
    return Q.related_by_note(spark, _index(spark, d), v, f, note or 0, _MODEL, 0.0, 50).select("note_id", _r("cos").alias("cos"), "front")


_RELATED = ["ganglion", "linear capacitor", "reef"]


def _related_sql(last):
    q = S.values([(i, t) for i, t in enumerate(_RELATED)], "qid, term")
    vecs = ", ".join(f"({i}, {S.numbers(v)})" for i, v in enumerate(M.HashingEmbedder()(_RELATED)))
    return f"""with {S.bm25({0: _RELATED})}, {S.VECTORS}, q(qid, q) as (values {vecs}), pool as (select note_id from (select *, row_number() over (order by bm25, note_id) as p from scores) where p <= 400),
cos as (select qid, note_id, {S.cosine('vec', 'q')} as cos from cv cross join q where model = '{_MODEL}' and len(vec) = 64 and note_id in (select note_id from pool)),
l as (select *, row_number() over (partition by qid order by cos desc, note_id) as place from cos) {last}"""


@query(_related_sql("select note_id, round(max(cos), 6) as cos from cos group by 1 order by max(cos) desc, note_id limit 20"))
def related_by_words_best(spark, d):
    return Q.related_by_terms(spark, _index(spark, d), _model_vectors(spark, d), _RELATED, _MODEL, M.HashingEmbedder(), 20).select("note_id", _r("cos").alias("cos"))


@query(_related_sql("select note_id, round(max(cos), 6) as cos, round(sum(1.0 / (60 + place)), 6) as rrf from l where place <= 200 group by 1 order by max(cos) desc, sum(1.0 / (60 + place)) desc, note_id limit 20"))
def related_by_words_fused(spark, d):
    rows = Q.related_by_terms(spark, _index(spark, d), _model_vectors(spark, d), _RELATED, _MODEL, M.HashingEmbedder(), 20, fused=True)
    return rows.select("note_id", _r("cos").alias("cos"), _r("rrf").alias("rrf"))


@query()
def hybrid_batch(spark, d):
    """Every document whose id is divisible by 20 as a query against all notes: its words by BM25, its hashed vector against hashed fronts; the first 40 of each."""
    f = table(spark, d, "note_fields")
    texts = table(spark, d, "documents").where("text is not null and doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text").dropDuplicates(["query_id"])
    vectors = M.embedded(N.front(f).select("note_id", T.plain(F.col("front")).alias("text")).where("text <> ''"), "text", M.HashingEmbedder, "document").select("note_id", "vec")
    asks = M.embedded(texts, "text", M.HashingEmbedder, "query").select("query_id", F.col("vec").alias("qvec"))
    return Q.hybrid_batch(_index(spark, d), cut(vectors, "fronts"), cut(asks, "asks"), f, texts, 40).select("query_id", "note_id", "cos", "bm25", "matched", "score", "place")


_RERANK = f"""{S.bm25(TERMS)}, {_Q},
cosines as (select cv.note_id, {S.cosine('cv.vec', 'qv.vec')} as cos from cv join qv on cv.model = qv.model and len(cv.vec) = len(qv.vec) where cv.model = 'quill-embed-8b'),
a as (select note_id, bm25, null::double as cos, row_number() over (order by bm25, note_id) as o from scores qualify o <= 100),
b as (select note_id, null::double as bm25, cos, 100 + row_number() over (order by cos desc, note_id) as o from cosines qualify o <= 200),
pool as (select *, row_number() over (order by o) as pos from (select note_id, min(bm25) as bm25, max(cos) as cos, min(o) as o from (select * from a union all select * from b) group by 1) qualify pos <= 200),
words as (select note_id, bm25 from scores qualify row_number() over (order by bm25, note_id) <= 400),
r as (
  select p.note_id, c.cos as rerank, p.bm25, 0 as segment, p.pos from pool p left join cosines c using (note_id)
  union all select note_id, null, bm25, 1, 0 from words where note_id not in (select note_id from pool)),
ranked as (select note_id, rerank, bm25, segment, cast(row_number() over (order by segment, rerank desc nulls last, case when segment = 0 then pos end, bm25 nulls last, note_id) as int) as place from r)"""


def _rerank(spark, d, k=100):
    v = _vectors(spark, d).where("model = 'quill-embed-8b'")
    cosines = V.cosine_scan(v, _ask(v)).select("note_id", "cos")
    words = R.bm25(_index(spark, d), R.query_terms(spark, TERMS)).select("note_id", "bm25")
    pool = H.union_pool(words, cosines, k)
    score = lambda pool: cosines.join(pool.select("note_id"), "note_id", "left_semi").withColumnRenamed("cos", "rerank")
    return H.rerank(pool, words.orderBy("bm25", "note_id").limit(400), score)


@query(f"with {_RERANK} select note_id, round(rerank, 6) as rerank, round(bm25, 6) as bm25, segment, place from ranked")
def rerank_union_head_tail(spark, d):
    return _rerank(spark, d).select("note_id", _r("rerank").alias("rerank"), _r("bm25").alias("bm25"), "segment", "place")


@query(f"""with {_RERANK.partition('a as (select')[0]}
a as (select note_id, row_number() over (order by bm25, note_id) as o from scores qualify o <= 5), b as (select note_id, 5 + row_number() over (order by cos desc, note_id) as o from cosines qualify o <= 10),
pool as (select note_id, min(o) as o from (select * from a union all select * from b) group by 1)
select note_id, round(coalesce(cos, 0), 6) as rerank, cast(row_number() over (order by coalesce(cos, 0) desc, o) as int) as place from pool left join cosines using (note_id)""")
def rerank_small(spark, d):
    """Five by words and five by vector, reranked; a note without a score has 0."""
    v = _model_vectors(spark, d)
    cosines = V.cosine_scan(v, _ask(v)).select("note_id", "cos")
    words = R.bm25(_index(spark, d), R.query_terms(spark, TERMS)).select("note_id", "bm25")
    score = lambda pool: N.restrict(cosines, pool).withColumnRenamed("cos", "rerank")
    return H.small_rerank(words, cosines, score).select("note_id", _r("rerank").alias("rerank"), "place")


@query(f"with {_RERANK}, m as (select min(rerank) as lo, max(rerank) as hi from ranked) select note_id, round(case when hi = lo then 1 else (rerank - lo) / (hi - lo) end, 6) as scaled from ranked cross join m where rerank is not null and (hi = lo or (rerank - lo) / (hi - lo) >= 0.5)")
def threshold_minmax(spark, d):
    return H.rerank_filter(_rerank(spark, d), 0.5).select("note_id", _r("scaled").alias("scaled"))


@query(f"with {_SCAN} select note_id, round(cos, 6) as score from cos where model = 'quill-embed-8b' and note_id <> (select note_id from q where model = 'quill-embed-8b') and cos >= 0.3 order by cos desc, note_id limit 20")
def related_panel(spark, d):
    v = _vectors(spark, d).where("model = 'quill-embed-8b'")
    note = v.agg(F.min("note_id").alias("n")).head()["n"]
    rows = V.cosine_scan(v, _ask(v)).select("note_id", F.col("cos").alias("score"))
    return H.panel(rows, note or 0, 0.3, 20).select("note_id", _r("score").alias("score"))


@query(f"with {S.bm25(TERMS)}, v as (select note_id, row_number() over (order by note_id) as pos from (select distinct note_id from note_tags where tag = 'inbox::unsorted' and note_id is not null)) select note_id, round(bm25, 6) as bm25, cast(row_number() over (order by bm25 nulls last, pos) as int) as place from v left join scores using (note_id)")
def visible_resorted(spark, d):
    rows = table(spark, d, "note_tags").where("tag = 'inbox::unsorted' and note_id is not null").select("note_id").distinct()
    rows = rows.withColumn("pos", F.col("note_id"))
    words = R.bm25(_index(spark, d), R.query_terms(spark, TERMS))
    return H.resorted(rows, words).select("note_id", _r("bm25").alias("bm25"), "place")


@query(f"with {S.bm25({0: ['qqqqzzz', 'ganglion']})} select note_id from scores")
def exact_then_fuzzy(spark, d):
    exact = N.exact_search(table(spark, d, "notes"), table(spark, d, "note_fields"), "qqqqzzz ganglion").select("note_id")
    return H.cascade(exact, lambda: R.bm25(_index(spark, d), R.query_terms(spark, {0: ["qqqqzzz", "ganglion"]})).select("note_id"))
