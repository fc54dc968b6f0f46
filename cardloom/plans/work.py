"""Queries of sync, jobs, costs and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import costs as C
from cardloom.operators import grouping as G
from cardloom.operators import ingest as I
from cardloom.operators import jobs as J
from cardloom.operators import notes as N
from cardloom.plans import sql as S
from cardloom.shared import scratch, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HASH = f"""{S.NOTES}, {S.FIELDS}, {S.TAGS},
f as (select note_id, string_agg(coalesce(field_name, '') || '=' || v, '|' order by coalesce(ord, 0), coalesce(field_name, ''), v) as f from (select *, {S.with_media('value_html')} as v from cf) group by 1),
t as (select note_id, string_agg(tag, '|' order by tag) as t from ct group by 1),
h as (select note_id, sha256(coalesce(model_name, '') || '||' || coalesce(f, '') || '||' || coalesce(t, '')) as content_hash from cn left join f using (note_id) left join t using (note_id))"""


@query(f"with {_HASH} select * from h")
def content_hash(spark, d):
    return I.content_hash(table(spark, d, "notes"), table(spark, d, "note_fields"), table(spark, d, "note_tags"))


def _old_new(spark, d):
    """First versions of the notes as the stored table, last ones as the snapshot; notes in the deletion log are not in it."""
    notes = table(spark, d, "notes").where("note_id is not null")
    w = N.Window.partitionBy("note_id").orderBy(F.asc_nulls_first("synced_at"), F.asc_nulls_first("mod"), F.asc_nulls_first("content_hash"))
    old = notes.withColumn("_n", F.row_number().over(w)).where("_n = 1").where(F.col("fetched_at") < 1_700_000_000)
    gone = table(spark, d, "note_deletions").select("note_id")
    new = N.current_notes(notes).join(gone, "note_id", "left_anti")
    cols = ["note_id", "mod", "content_hash", "synced_at"]
    return old.select(*cols), new.select(*cols)


_DIFF = f"""{S.NOTES},
o as (select note_id, mod, content_hash, synced_at from (select *, row_number() over (partition by note_id order by synced_at nulls first, mod nulls first, content_hash nulls first) as rn from notes where note_id is not null) where rn = 1 and fetched_at < 1700000000),
s as (select note_id, mod, content_hash, synced_at from cn anti join note_deletions using (note_id)),
a as (select coalesce(o.note_id, s.note_id) as note_id, case when s.note_id is null then 'delete' when o.note_id is null then 'insert' when o.mod = s.mod then 'touch' when o.content_hash is not distinct from s.content_hash then 'touch_mod' else 'update' end as action from o full join s on o.note_id = s.note_id)"""


@query(f"with {_DIFF} select * from a")
def snapshot_diff(spark, d):
    return I.snapshot_diff(*_old_new(spark, d))


@query(f"with {_DIFF} select count(*) filter (action = 'insert') as inserted, count(*) filter (action = 'update') as updated, count(*) filter (action in ('touch', 'touch_mod')) as unchanged, count(*) filter (action = 'delete') as deleted from a")
def sync_counters(spark, d):
    return I.counters(I.snapshot_diff(*_old_new(spark, d)))


@query(f"with {_DIFF} select s.note_id, case when action = 'touch' then o.mod else s.mod end as mod, case when action = 'touch' then o.content_hash else s.content_hash end as content_hash, s.synced_at from s join a using (note_id) left join o on o.note_id = s.note_id")
def sync_applied(spark, d):
    return I.applied(*_old_new(spark, d))


@query("select note_id, field_name, value_html, ord from note_fields anti join note_deletions using (note_id)")
def cascade_delete(spark, d):
    return I.without_children(table(spark, d, "note_fields"), table(spark, d, "note_deletions"))


@query(f"with {S.VECTORS}, old as (select note_id, max(hash) as hash from embeddings2 where model = 'tern-embed-2' and note_id is not null group by 1) select note_id, 'hosted' as backend, 'quill-embed-8b' as model, hash from old where note_id not in (select note_id from embeddings2 where backend = 'hosted' and model = 'quill-embed-8b' and note_id is not null)")
def vectors_migrated(spark, d):
    v = table(spark, d, "embeddings2").where("note_id is not null")
    old = v.where("model = 'tern-embed-2'").groupBy("note_id").agg(F.max("hash").alias("hash"))
    return I.migrated_vectors(old, v.select("note_id", "backend", "model").distinct(), "hosted", "quill-embed-8b").select("note_id", "backend", "model", "hash")


@query(f"""with {S.FIELDS}, {S.FRONT}, h as (select note_id, sha256(text) as hash from (select note_id, {S.strip_html('front')} as text from front) where text <> ''),
v as (select note_id, max(hash) as had from embeddings2 where note_id is not null and model = 'quill-embed-8b' group by 1)
select note_id, h.hash, case when v.note_id is null then 'missing' else 'stale' end as reason from h left join v using (note_id) where v.note_id is null or had is distinct from h.hash""")
def embed_enqueue_stale(spark, d):
    v = table(spark, d, "embeddings2").where("note_id is not null and model = 'quill-embed-8b'")
    return J.to_enqueue(J.front_hashes(N.front(table(spark, d, "note_fields"))), v)


def _jobs(spark, d):
    """The event table as attempts of jobs: errors fail, purchases end, clicks run."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "click", "in_progress").otherwise("pending")
    outcome = F.when(kind == "error", "failed").when(kind == "purchase", "done").otherwise("none")
    return table(spark, d, "events").select(F.col("event_id").alias("note_id"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts"), outcome.alias("outcome"), kind.alias("error"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("enqueued_at"), F.col("user_id"))


_JOBS = "jobs as (select event_id as note_id, case event_type when 'purchase' then 'done' when 'click' then 'in_progress' else 'pending' end as status, cast(event_id % 3 as int) as attempts, case event_type when 'error' then 'failed' when 'purchase' then 'done' else 'none' end as outcome, event_type as error, cast(floor(epoch(ts)) as bigint) as enqueued_at, user_id from events)"


@query(f"with {_JOBS} select note_id, case outcome when 'failed' then 'pending' when 'done' then 'done' else status end as status, cast(attempts + (outcome = 'failed')::int as int) as attempts, case when outcome = 'failed' then error end as last_error from jobs")
def job_after_attempt(spark, d):
    return J.after_attempt(_jobs(spark, d))


@query(f"with {_JOBS} select note_id, enqueued_at from (select * replace (case status when 'in_progress' then 'pending' else status end as status) from jobs) where status = 'pending' order by enqueued_at, note_id limit 100")
def job_fifo_pick(spark, d):
    return J.next_jobs(J.reset_stuck(_jobs(spark, d)), 100).select("note_id", "enqueued_at")


@query(f"with {_JOBS} select (select count(distinct note_id) from notes where note_id is not null) as total, (select count(distinct note_id) from embeddings2 where note_id in (select note_id from notes)) as embedded, count(*) filter (status in ('pending', 'in_progress')) as pending, count(*) filter (status = 'error') as errors, greatest((select count(distinct note_id) from notes where note_id is not null) - (select count(distinct note_id) from embeddings2 where note_id in (select note_id from notes)), 0) as remaining, cast(floor(greatest((select count(distinct note_id) from notes where note_id is not null) - (select count(distinct note_id) from embeddings2 where note_id in (select note_id from notes)), 0) / 4.0 + 0.5) as bigint) as eta from jobs")
def job_progress(spark, d):
    notes = table(spark, d, "notes").where("note_id is not null")
    return J.progress(notes, N.restrict(table(spark, d, "embeddings2"), notes), _jobs(spark, d), 4.0)


@query(f"""with {_JOBS}, r(backend, model, rate) as (select e.backend, e.model, case e.model when 'quill-embed-8b' then 4.0 when 'tern-embed-2' then 0.0 else 1.5 end from (select distinct backend, model from embeddings2) e),
t as (select count(distinct note_id) as total from notes where note_id is not null), v as (select backend, model, count(distinct note_id) as embedded from embeddings2 where note_id is not null group by all),
j as (select case user_id % 3 when 0 then 'quill-embed-8b' when 1 then 'tern-embed-2' else 'other' end as model, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'error') as errors from jobs group by 1)
select r.backend, r.model, total, coalesce(embedded, 0) as embedded, coalesce(pending, 0) as pending, coalesce(errors, 0) as errors, rate::double as rate, cast(case when rate > 0 then floor(greatest(total - coalesce(embedded, 0), 0) / rate + 0.5) else 0 end as bigint) as eta
from r cross join t left join v using (backend, model) left join j on j.model = r.model""")
def job_progress_all(spark, d):
    """Every model of the vectors with its own rate; jobs by user stand for the models' queues."""
    v = table(spark, d, "embeddings2")
    known = v.select("backend", "model").distinct()
    rates = known.withColumn("rate", F.when(F.col("model") == "quill-embed-8b", 4.0).when(F.col("model") == "tern-embed-2", 0.0).otherwise(1.5))
    model = F.when(F.col("user_id") % 3 == 0, "quill-embed-8b").when(F.col("user_id") % 3 == 1, "tern-embed-2").otherwise("other")
    jobs = _jobs(spark, d).withColumn("model", model).join(known, "model")
    return J.progress_of_models(table(spark, d, "notes"), v, jobs, rates)


@query(f"""with {S.LISTED}, h as (select note_id, sha256({S.strip_html('front')}) as new from listed)
select e.note_id, e.model, e.updated_at, coalesce(h.new, e.hash) as hash from embeddings2 e left join h on h.note_id = e.note_id""")
def hash_scheme_migrated(spark, d):
    """Vectors hashed by an older scheme get the hash of their note's front."""
    fronts = N.with_front(table(spark, d, "notes"), table(spark, d, "notes"), table(spark, d, "note_fields"))
    hashes = fronts.select("note_id", F.sha2(T.plain(F.col("front")), 256).alias("hash"))
    return J.rehashed(table(spark, d, "embeddings2"), hashes, "content_v1").select("note_id", "model", "updated_at", "hash")


@query(f"with {_JOBS} select count(*) as processed, max(enqueued_at) - min(enqueued_at) as elapsed, round(count(*) / greatest(1, max(enqueued_at) - min(enqueued_at)), 6) as rate from jobs")
def job_run_rate(spark, d):
    rows = J.run_rate(_jobs(spark, d), "enqueued_at", "enqueued_at")
    return rows.withColumn("rate", F.round("rate", 6))


@query(f"with {_JOBS}, x as (select note_id, user_id, enqueued_at, greatest(1, note_id % 50) as tokens from jobs) select note_id, user_id, count(*) over w as requests, cast(sum(tokens) over w as bigint) as tokens_in_window from x window w as (partition by user_id order by enqueued_at range between 60 preceding and current row)")
def rate_window_60s(spark, d):
    rows = _jobs(spark, d).select("note_id", "user_id", "enqueued_at", F.greatest(F.lit(1), F.col("note_id") % 50).alias("tokens"))
    return J.rolling_rate(rows, "user_id", "enqueued_at", "tokens").select("note_id", "user_id", "requests", "tokens_in_window")


_STATS = f"st as (select count(*) as notes, cast(sum(n) as bigint) as chars, cast(sum(ceil(n / 4.0)) as bigint) as tokens, avg(n) as avg_chars, max(n) as max_chars, avg(ceil(n / 4.0)) as avg_tokens from (select length({S.cost_text('value_html')}) as n from note_fields where ord = 0))"


@query(f"with {_STATS} select notes, chars, tokens, round(avg_chars, 6) as avg_chars, max_chars, round(avg_tokens, 6) as avg_tokens from st")
def corpus_stats(spark, d):
    rows = C.corpus_stats(table(spark, d, "note_fields"))
    return rows.withColumn("avg_chars", F.round("avg_chars", 6)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(f"""with {_STATS}, p(tier, input, cached, output) as (values ('small', 0.05, 0.005, 0.40), ('medium', 0.25, 0.02, 1.00), ('large', 1.25, 0.10, 5.00)),
x as (select tier, cast(greatest(1, floor(notes / 12.0 + 0.5)) as bigint) as topics, greatest(1, least(avg_tokens, 160)) as shown, input, cached, output from p cross join st),
y as (select *, (120 + 5 * shown + 12) * topics as input_tokens, 48 * topics as output_tokens from x)
select tier, topics, round(input_tokens, 4) as input_tokens, output_tokens, round((input_tokens * (0.75 * input + 0.25 * cached) + output_tokens * output) / 1000000, 6) as dollars from y""")
def corpus_cost(spark, d):
    rows = C.cost_model(C.corpus_stats(table(spark, d, "note_fields")), cached=0.25)
    return rows.withColumn("input_tokens", F.round("input_tokens", 4)).withColumn("dollars", F.round("dollars", 6))


# groups: the tags of a note stand for a model's groups, notes of the inbox are the wanted ids ------


@query("""with w as (select distinct note_id from note_tags where tag = 'inbox::unsorted' and note_id is not null),
k as (select distinct string_split(tag, '::')[1] as label, note_id from note_tags where note_id in (select note_id from w) and string_split(tag, '::')[1] <> 'inbox'),
o as (select 'Other' as label, note_id from w where note_id not in (select note_id from k)), g as (select * from k union select * from o)
select label, n, ids, cast(row_number() over (order by lower(label), label) as int) as place from (select label, count(*) as n, string_agg(cast(note_id as varchar), ',' order by note_id) as ids from g group by 1)""")
def ai_group_cleanup(spark, d):
    tags = table(spark, d, "note_tags").where("note_id is not null")
    wanted = tags.where("tag = 'inbox::unsorted'").select("note_id")
    groups = tags.select(T.tag_head(F.col("tag")).alias("label"), "note_id").where("label <> 'inbox'")
    return G.group_list(G.clean_groups(groups, wanted))


@query("""with g as (select string_split(tag, '::')[1] as label, note_id, min(length(tag)) as pos from note_tags where note_id is not null group by all)
select note_id, label from (select *, row_number() over (partition by note_id order by pos, label) as rn from g) where rn = 1""")
def first_group_wins(spark, d):
    rows = table(spark, d, "note_tags").where("note_id is not null").groupBy("note_id", T.tag_head(F.col("tag")).alias("label")).agg(F.min(F.length("tag")).alias("pos"))
    return G.first_group(rows)


def _answers(spark, d):
    """A model's answers about the inbox, made from the ids: marked, plain and unreadable ones."""
    i = F.abs("note_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("BEGIN_DIGITS <"), (i % 5).cast("string"), F.lit("> END_DIGITS"))).when(i % 4 == 1, F.concat(F.lit("class "), (i % 7).cast("string"))).when(i % 4 == 2, "none")
    json = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("output_text")))
    return table(spark, d, "note_tags").where("tag = 'inbox::unsorted' and note_id is not null").select("note_id").distinct().select("note_id", json.alias("answer"))


_BADGES = """a as (select distinct note_id from note_tags where tag = 'inbox::unsorted' and note_id is not null),
b as (select note_id, cast(case when i % 4 = 0 then least(i % 5, 3) when i % 4 = 1 and i % 7 <= 3 then i % 7 end as int) as badge from (select note_id, abs(note_id) as i from a))"""


@query(f"with {_BADGES} select count(*) filter (badge = 0) as n0, count(*) filter (badge = 1) as n1, count(*) filter (badge = 2) as n2, count(*) filter (badge = 3) as n3 from b")
def badge_histogram(spark, d):
    return G.badge_histogram(G.badges(_answers(spark, d)))


@query(f"with {_BADGES} select note_id, badge, cast(row_number() over (order by coalesce(badge, 99), -note_id, note_id) as int) as place from b")
def badge_order(spark, d):
    rows = G.badges(_answers(spark, d)).withColumn("pos", -F.col("note_id"))
    return G.badge_order(rows).select("note_id", "badge", "place")


@query(f"""with {S.FIELDS}, {S.FRONT}, a as (select note_id, len(list_filter(string_split({S.strip_html('front')}, ' '), lambda x: x <> '')) % 4 as badge from front)
select note_id, cast(badge as int) as badge from a""")
def badges_by_model(spark, d):
    """Every front graded by a stand-in of a language model."""
    from cardloom.sources.models import EchoAnswerer

    return G.badges_by_model(N.front(table(spark, d, "note_fields")), EchoAnswerer)


@query("""with tc as (select tag, count(distinct note_id) as n from note_tags where note_id is not null and tag is not null group by 1)
select t.tag as path, cast(sum(c.n) as bigint) as n from tc t join tc c on c.tag = t.tag or starts_with(c.tag, t.tag || '::') group by 1""")
def group_additive_counts(spark, d):
    from cardloom.operators.tags import additive_counts

    return additive_counts(table(spark, d, "note_tags"))


# streaming forms ---------------------------------------------------------------------------------


@query("select note_id, mod, content_hash, synced_at from (select *, row_number() over (partition by note_id order by synced_at desc nulls last, mod desc nulls last, content_hash desc nulls last) as rn from notes where note_id is not null) where rn = 1")
def stream_sync(spark, d):
    """Notes as a feed of files into the sync sink; the last version of the table."""
    from cardloom.streaming import feeds as X

    where = scratch(spark, "sync")
    rows = N.current_notes(table(spark, d, "notes")).select("note_id", "mod", "content_hash", "synced_at")
    rows.repartition(3, "note_id").write.parquet(f"{where}/in")
    X.run_now(X.files(spark, f"{where}/in", rows.schema), "append", f"{where}/check", each=X.sync_sink(spark, f"{where}/out"))
    return spark.read.parquet(f"{where}/out/v=2") if _exists(spark, f"{where}/out/v=2") else spark.read.parquet(f"{where}/out/v=0")


def _exists(spark, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True


_STREAM_JOBS = """with e as (select user_id as note_id, case event_type when 'error' then 'failed' when 'purchase' then 'done' when 'click' then 'start' else 'enqueue' end as event, event_id as pos, event_type as error from events),
l as (select note_id, max(pos) filter (event = 'start') as s, max(pos) filter (event = 'done') as d, max(pos) filter (event = 'failed') as f, max(pos) filter (event = 'enqueue') as q, count(*) filter (event = 'failed') as attempts, max(error) filter (event = 'failed') as error from e group by 1),
z as (select *, greatest(coalesce(s, -1), coalesce(d, -1), coalesce(f, -1)) as last from l)
select note_id, case when last = s then 'in_progress' when last = d and coalesce(q, -1) < d then 'done' else 'pending' end as status, cast(attempts as int) as attempts, case when coalesce(f, -1) > coalesce(d, -1) then error end as last_error from z"""


@query(_STREAM_JOBS)
def stream_job_states(spark, d):
    """The events of each user as attempts of one job, a stream through the state machine; the last state of each."""
    from cardloom.streaming import feeds as X

    where = scratch(spark, "jobs")
    kind = F.col("event_type")
    event = F.when(kind == "error", "failed").when(kind == "purchase", "done").when(kind == "click", "start").otherwise("enqueue")
    rows = table(spark, d, "events").select(F.col("user_id").alias("note_id"), event.alias("event"), F.col("event_id").alias("at"), kind.alias("error"))
    rows.write.parquet(f"{where}/in")
    out = []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{where}/out/n={number}")
        out.append(number)

    X.run_now(X.job_states(X.files(spark, f"{where}/in", rows.schema)), "update", f"{where}/check", each=keep)
    return spark.read.parquet(f"{where}/out/n={max(out)}")


@query("select cast(user_id as bigint) as key, cast(epoch(w) as bigint) as start, count(*) as requests from (select user_id, to_timestamp(cast(floor(epoch(ts) / 10) as bigint) * 10 - 10 * i) as w from events cross join range(6) r(i)) group by all")
def stream_rate_windows(spark, d):
    from cardloom.streaming import feeds as X

    where = scratch(spark, "rates")
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("tokens"))
    # a last event far ahead, in a file of its own that is read last, closes every window; its own stay open
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"), F.lit(1).cast("long").alias("tokens"))
    rows.write.parquet(f"{where}/in")
    X.run_now(X.rate_windows(X.files(spark, f"{where}/in", rows.schema)), "append", f"{where}/check", f"{where}/out")
    end.coalesce(1).write.mode("append").parquet(f"{where}/in")
    X.run_now(X.rate_windows(X.files(spark, f"{where}/in", rows.schema)), "append", f"{where}/check", f"{where}/out")
    return spark.read.parquet(f"{where}/out").select("key", F.unix_timestamp("window.start").alias("start"), "requests")
