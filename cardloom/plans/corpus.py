"""Queries over notes, fields, tags and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import index as I
from cardloom.operators import keyphrases as K
from cardloom.operators import notes as N
from cardloom.operators import tags as G
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


@query("select count(distinct note_id) as n from notes where note_id is not null")
def note_count(spark, d):
    return N.current_notes(table(spark, d, "notes")).agg(F.count("*").alias("n"))


@query(f"with {S.FIELDS}, {S.FRONT}, p as (select distinct note_id from notes where note_id is not null order by note_id desc limit 50 offset 100) select note_id, front from p left join front using (note_id)")
def note_list_page(spark, d):
    return N.page(table(spark, d, "notes"), table(spark, d, "note_fields"), 50, 100)


def _exact(parts):
    low = S.ascii_lower("value_html")
    cond = " and ".join(f"exists (select 1 from note_fields f where f.note_id = listed.note_id and contains({low}, '{p}'))" for p in parts)
    return f"with {S.LISTED} select note_id, front from listed where {cond}"


def _search(spark, d, text, limit=None, offset=0):
    return N.exact_search(table(spark, d, "notes"), table(spark, d, "note_fields"), text, limit, offset)


@query(_exact(["linear", "vesicle"]))
def exact_search_and(spark, d):
    return _search(spark, d, "Linear vesicle")


@query(_exact(["tensor test", "the"]))
def exact_search_phrase(spark, d):
    return _search(spark, d, '"tensor test" the')


@query(_exact(["linear"]) + " order by note_id desc limit 20 offset 5")
def exact_search_page(spark, d):
    return _search(spark, d, "linear", 20, 5)


@query(f"with {S.LISTED} select note_id, front from listed order by note_id desc limit 200")
def exact_search_empty(spark, d):
    """An empty query lists the newest notes."""
    return _search(spark, d, "  ", 200)


@query(f"with {S.LISTED} select note_id, front from listed where note_id in (select note_id from embeddings2 where model = 'finch-300m')")
def first_field_of_ids(spark, d):
    return N.with_front(table(spark, d, "embeddings2").where("model = 'finch-300m'"), table(spark, d, "notes"), table(spark, d, "note_fields"))


@query(f"with {S.FIELDS}, {S.FRONT} select * from front")
def first_field(spark, d):
    return N.front(table(spark, d, "note_fields"))


@query(f"with {S.FIELDS}, {S.BACK} select * from back")
def back_field(spark, d):
    return N.back(table(spark, d, "note_fields"))


@query(f"""with {S.NOTES}, {S.FIELDS}, {S.TAGS},
f as (select note_id, string_agg(field_name || '=' || coalesce(value_html, ''), ' | ' order by coalesce(ord, -2147483648), field_name, coalesce(value_html, '')) as fields, cast(count(*) as int) as n_fields from cf group by 1),
t as (select note_id, string_agg(tag, ' ' order by tag) as tags from ct group by 1)
select note_id, model_name, mod, fields, n_fields, tags from cn left join f using (note_id) left join t using (note_id)""")
def note_details(spark, d):
    return N.details(table(spark, d, "notes"), table(spark, d, "note_fields"), table(spark, d, "note_tags"))


@query(f"with {S.FIELDS}, {S.FRONT} select note_id, coalesce(regexp_matches(front, '\\[sound:[^\\]]+\\]', 'i') or regexp_matches(front, '<img\\b', 'i') or length({S.strip_html('front')}) > 0, false) as visible from front")
def front_visible(spark, d):
    return N.visible_notes(table(spark, d, "note_fields"))


@query("select note_id, field_name, ord from note_fields semi join (select distinct note_id from notes where profile = 'work' and note_id is not null) using (note_id)")
def fields_of_ids(spark, d):
    return N.restrict(table(spark, d, "note_fields"), table(spark, d, "notes").where("profile = 'work'")).select("note_id", "field_name", "ord")


@query("select distinct note_id from embeddings2 where note_id is not null order by note_id limit 400")
def first_ids(spark, d):
    return N.first_ids(table(spark, d, "embeddings2"))


def _three(spark, d):
    return table(spark, d, "notes"), table(spark, d, "note_fields"), table(spark, d, "note_tags")


_TAGGED = f"with {S.LISTED} select listed.note_id, front from listed"


@query(f"{_TAGGED} join (select distinct note_id, tag from note_tags) t using (note_id) where t.tag = 'inbox::unsorted'")
def notes_by_tag(spark, d):
    return G.notes_with_tag(*_three(spark, d), "inbox::unsorted")


@query(f"{_TAGGED} join (select distinct note_id, tag from note_tags) t using (note_id) where t.tag = 'inbox::unsorted' order by note_id desc limit 100 offset 40")
def notes_by_tag_page(spark, d):
    return G.notes_with_tag(*_three(spark, d), "inbox::unsorted", 100, 40)


@query(f"{_TAGGED} where exists (select 1 from note_tags t where t.note_id = listed.note_id and (t.tag = 'physics' or {S.ascii_lower('t.tag')} like 'physics::%'))")
def notes_by_tag_prefix(spark, d):
    return G.notes_under(*_three(spark, d), "physics")


@query(f"with {S.TAGS} select tag, count(*) as n_notes from ct group by 1")
def tag_counts(spark, d):
    return G.tag_counts(table(spark, d, "note_tags"))


_COUNTS = f"{S.TAGS}, tc as (select tag, count(*) as n from ct group by 1)"


@query(f"with {_COUNTS} select string_split(tag, '::')[1] as tag, cast(sum(n) as bigint) as n from tc group by 1")
def child_tags_root(spark, d):
    return G.child_tags(table(spark, d, "note_tags"))


@query(f"with {_COUNTS} select array_to_string(string_split(tag, '::')[1:2], '::') as tag, cast(sum(n) as bigint) as n from tc where starts_with(tag, 'Physics::') group by 1")
def child_tags_prefix(spark, d):
    return G.child_tags(table(spark, d, "note_tags"), "Physics")


_TREE = f"{_COUNTS}, tt as (select path, cast(len(string_split(path, '::')) as int) as depth, cast(sum(n) as bigint) as n from (select array_to_string(parts[1:i], '::') as path, n from (select parts, n, unnest(range(1, len(parts) + 1)) as i from (select string_split(tag, '::') as parts, n from tc))) group by 1)"


@query(f"with {_TREE} select path, n, depth from tt")
def tag_tree_inclusive(spark, d):
    return G.tag_tree(table(spark, d, "note_tags"))


@query(f"with {S.TAGS} select array_to_string(parts[1:i], '::') as path, count(distinct note_id) as n_notes from (select note_id, parts, unnest(range(1, len(parts) + 1)) as i from (select note_id, string_split(tag, '::') as parts from ct)) group by 1")
def group_unique_count(spark, d):
    return G.unique_counts(table(spark, d, "note_tags"))


@query(f"""with recursive {_TREE},
r as (select *, array_to_string(string_split(path, '::')[1:depth - 1], '::') as parent from tt where depth <= 3),
k as (select *, row_number() over (partition by parent order by n desc, path) as place from r),
t as (select path, depth, n, place from k where depth = 1 and place <= 20 union all select k.path, k.depth, k.n, k.place from k join t on k.parent = t.path and k.depth = t.depth + 1 where k.place <= 20)
select path, depth as level, least(n, 500) as n, cast(place as int) as place from t""")
def tag_group_tree(spark, d):
    return G.group_tree(table(spark, d, "note_tags"))


@query(f"""with {_TREE} select path, depth as level, lower(path) as key from tt
where len(list_filter(list_transform(range(1, depth), lambda i: array_to_string(string_split(path, '::')[1:i], '::')), lambda p: p not in ('Physics', 'Biochem'))) = 0""")
def tag_rows_expanded(spark, d):
    return G.flat_groups(G.tag_tree(table(spark, d, "note_tags")).withColumnRenamed("depth", "level"), ["Physics", "Biochem"])


@query("""with ct as (select distinct note_id, tag from note_tags semi join notes using (note_id) where tag is not null),
x as (select note_id, array_to_string(parts[1:i], '::') as path, i as level, parts[1:i-1] as above from (select note_id, parts, unnest(range(1, len(parts) + 1)) as i from (select note_id, string_split(tag, '::') as parts from ct))),
h as (select path, level, count(distinct note_id) as n from x where array_to_string(above, '::') in ('', 'Physics', 'Biochem') and (len(above) < 2) group by all)
select 'header' as kind, path, cast(level as int) as level, n, null::bigint as note_id from h
union all select 'note', tag, cast(1 as int), null, note_id from ct where tag in ('Physics', 'Biochem')""")
def tag_rows_with_notes(spark, d):
    """The tag tree as a list with two paths expanded."""
    return G.flat_rows(table(spark, d, "note_tags"), table(spark, d, "notes"), ["Physics", "Biochem"])


@query("select note_id, tag, string_split(tag, '::')[1] as head, string_split(tag, '::')[-1] as leaf from (select distinct note_id, tag from note_tags where note_id is not null and tag is not null)")
def tag_parts(spark, d):
    t = F.col("tag")
    return N.current_tags(table(spark, d, "note_tags")).select("note_id", "tag", T.tag_head(t).alias("head"), T.tag_leaf(t).alias("leaf"))


def _text_query(name, column, sql):
    def run(spark, d):
        return N.current_fields(table(spark, d, "note_fields")).select("note_id", "field_name", "ord", "value_html", column(F.col("value_html")).alias("out"))

    run.__name__ = name
    query(f"with {S.FIELDS} select note_id, field_name, ord, value_html, {sql} as out from cf")(run)


_text_query("strip_html_plain", T.plain, S.strip_html("value_html"))
_text_query("strip_html_media", T.with_media, S.with_media("value_html"))
_text_query("strip_html_index", T.indexed, f"lower({S.with_media('value_html')})")
_text_query("strip_html_cost", T.cost_text, S.cost_text("value_html"))
_text_query("normalized_text", T.normalize, S.collapse("lower(coalesce(value_html, ''))"))
_display = "regexp_replace(coalesce(value_html, ''), '<[^>]*>', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''")):
    _display = f"replace({_display}, '{_a}', '{_b}')"
_text_query("display_text", T.display_text, S.collapse(rf"regexp_replace({_display}, '\{{\{{[^}}]*\}}\}}', '', 'g')"))


# plain inline tags are marked by signs no text has, all others go, and the marked ones come back
_INLINE = r"<(/?(?:b|i|u|em|strong|sub|sup|mark)\b[^>]*)>"
_OPENED = r"regexp_replace(regexp_replace(regexp_replace(coalesce(front, ''), '<img[^>]*>', '{}', 'gi'), '\[sound:[^\]]+\]', '{}', 'gi'), '\{{\{{c\d+::(.*?)(?:::[^}}]*)?\}}\}}', '<mark>\1</mark>', 'g')".format(T.PICTURE, T.SPEAKER)
_PREVIEW = rf"replace(replace(regexp_replace(regexp_replace({_OPENED}, '{_INLINE}', '\x01\1\x02', 'gi'), '<[^>]*>', ' ', 'g'), chr(1), '<'), chr(2), '>')".replace("\\x01", "' || chr(1) || '").replace("\\x02", "' || chr(2) || '")


@query(f"with {S.FIELDS}, {S.FRONT} select note_id, {S.collapse(_PREVIEW)} as preview from front")
def preview_html(spark, d):
    return N.front(table(spark, d, "note_fields")).select("note_id", T.preview(F.col("front")).alias("preview"))


@query(f"""with {S.FIELDS}, {S.FRONT},
w as (select note_id, list_filter(regexp_split_to_array(lower(coalesce(front, '')), '[^a-z0-9]+'), lambda x: len(x) >= 2) as ws from front),
u as (select note_id, word, min(i) as i from (select note_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w) group by 1, 2),
k as (select note_id, word, row_number() over (partition by note_id order by i) as place from u)
select f.note_id, coalesce(string_agg(word, ' ' order by place) filter (place <= 64), '') as words from front f left join k on k.note_id = f.note_id group by 1""")
def ascii_query_words(spark, d):
    return N.front(table(spark, d, "note_fields")).select("note_id", F.array_join(T.ascii_words(F.col("front")), " ").alias("words"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(T.COMMON + T.COMMON_EXTRA))


@query(rf"""with {S.FIELDS}, {S.FRONT},
w as (select note_id, regexp_extract_all(lower({S.strip_html('front')}), '\p{{L}}+') as ws from front),
u as (select note_id, word, min(i) as i from (select note_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w) where len(word) >= 3 and regexp_full_match(word, '[a-z]+') and word not in ({_STOP}) group by 1, 2),
k as (select note_id, word, row_number() over (partition by note_id order by len(word) desc, i) as place from u)
select f.note_id, coalesce(string_agg(word, ' ' order by place) filter (place <= 10), '') as words from front f left join k on k.note_id = f.note_id group by 1""")
def keywords_rarity(spark, d):
    return N.front(table(spark, d, "note_fields")).select("note_id", F.array_join(F.slice(T.rare_words(T.plain(F.col("front"))), 1, 10), " ").alias("words"))


@query()
def keywords_heuristic(spark, d):
    return N.front(table(spark, d, "note_fields")).select("note_id", K.keyword_column(T.plain(F.col("front")), 8).alias("keywords"))


@query()
def keyphrases_textrank(spark, d):
    return K.phrase_rows(table(spark, d, "documents"), "doc_id", "text")


def _docs(spark, d):
    return I.documents_index(table(spark, d, "notes"), table(spark, d, "note_fields"))


@query(f"with {S.INDEX}, p as (select note_id, unnest(tokens) as term from idx) select term, count(distinct note_id) as docs, count(*) as n from p group by 1")
def vocab_df(spark, d):
    return I.vocabulary(_docs(spark, d))


@query(f"with {S.INDEX} select note_id, cast(i - 1 as int) as pos, tokens[i] as term from (select note_id, tokens, unnest(range(1, len(tokens) + 1)) as i from idx)")
def index_postings(spark, d):
    return I.postings(_docs(spark, d))


@query(f"with {S.INDEX} select count(*) as docs from idx where len(list_filter(range(1, len(tokens)), lambda i: tokens[i : i + 1] = ['tensor', 'test'])) > 0")
def phrase_df(spark, d):
    return I.phrase_frequency(_docs(spark, d), ["tensor", "test"])


_STALE = "select count(distinct note_id) as n_index from notes where note_id is not null and fetched_at < 1700000000"
_HEALTH = "select n_index, n_notes, n_index <> n_notes as rebuild from ({}) cross join (select count(distinct note_id) as n_notes from notes)"


@query(_HEALTH.format(_STALE))
def index_health(spark, d):
    """An index of the notes fetched before a day, against all notes."""
    notes = table(spark, d, "notes")
    return I.needs_rebuild(I.documents_index(notes.where("fetched_at < 1700000000"), table(spark, d, "note_fields")), notes)


@query(_HEALTH.format("select count(distinct note_id) as n_index from notes where note_id is not null"))
def index_health_fresh(spark, d):
    return I.needs_rebuild(_docs(spark, d), table(spark, d, "notes"))


@query(f"with {S.INDEX}, p as (select note_id, cast(len(tokens) as int) as length, unnest(tokens) as term, unnest(range(len(tokens))) as place from idx) select term, note_id, length, cast(count(*) as int) as tf, min(place)::int as first_place, max(place)::int as last_place from p group by all")
def index_build(spark, d):
    """The index stored by term and read back."""
    posts = I.stored(_docs(spark, d), scratch(spark, "index")).postings
    return posts.select("term", "note_id", "length", "tf", F.element_at("places", 1).alias("first_place"), F.element_at("places", -1).alias("last_place"))


@query(f"""with {S.INDEX}, late as (select distinct note_id from notes where synced_at > fetched_at), gone as (select distinct note_id from note_deletions)
select note_id, cast(len(tokens) as int) as n_tokens from idx where note_id in (select note_id from late) or note_id not in (select note_id from gone)""")
def index_maintenance(spark, d):
    whole = _docs(spark, d)
    late = table(spark, d, "notes").where("synced_at > fetched_at").select("note_id").distinct()
    gone = table(spark, d, "note_deletions").where("note_id is not null").select("note_id").distinct()
    return I.refreshed(whole, whole.join(late, "note_id", "left_semi"), gone).select("note_id", F.size("tokens").alias("n_tokens"))


@query(r"select doc_id, cast(list_sum(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> ''), lambda s: 1)) as int) as sentences, cast(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*')) as int) as words from documents where text is not null and trim(text) <> ''")
def sentence_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null and trim(text) <> ''").select("doc_id", F.nullif(F.size(T.sentences(t)), F.lit(0)).alias("sentences"), F.size(T.phrase_tokens(t)).alias("words"))
