"""Pieces of DuckDB SQL that state the same rules as the column functions, independently of Spark."""

from __future__ import annotations

WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _sub(c: str, pattern: str, to: str, flags: str = "g") -> str:
    q = lambda s: s.replace("'", "''")
    return f"regexp_replace({c}, '{q(pattern)}', '{q(to)}', '{flags}')"


def collapse(c: str) -> str:
    return f"trim({_sub(c, WS + '+', ' ')})"


def strip_html(c: str, image: str = " ", sound: str = " ") -> str:
    c = f"coalesce({c}, '')"
    if image != " ":
        c = _sub(c, "<img[^>]*>", image, "gi")
    c = _sub(_sub(c, r"<br\s*/?\s*>", " ", "gi"), "<[^>]*>", " ")
    c = _sub(c, r"\[sound:[^\]]+\]", sound, "gi")
    return collapse(f"replace(replace(replace(replace({c}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")


def with_media(c: str) -> str:
    return strip_html(c, " \U0001f5bc️ ", " \U0001f50a ")


def cost_text(c: str) -> str:
    c = _sub(_sub(f"coalesce({c}, '')", "<script.*?</script>", " ", "gis"), "<style.*?</style>", " ", "gis")
    c = _sub(_sub(c, r"<br\s*/?\s*>", " ", "gi"), "<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = _sub(c, name, sign, "gi")
    return collapse(c)


def ascii_lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokens(c: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}\x{{1F5BC}}]+')"


def cosine(a: str, b: str) -> str:
    d = lambda v: f"cast({v} as double[])"
    return f"list_dot_product({d(a)}, {d(b)}) / sqrt(list_dot_product({d(a)}, {d(a)}) * list_dot_product({d(b)}, {d(b)}))"


FIELDS = "cf as (select distinct note_id, field_name, value_html, ord from note_fields where note_id is not null)"
FRONT = "front as (select note_id, value_html as front from (select *, row_number() over (partition by note_id order by coalesce(ord, -2147483648), coalesce(field_name, ''), value_html is null, value_html) as rn from cf) where rn = 1)"
BACK = "back as (select note_id, value_html as back from (select *, row_number() over (partition by note_id order by coalesce(ord, -999999) desc, coalesce(field_name, '') desc, value_html is not null desc, value_html desc) as rn from cf) where rn = 1)"
TAGS = "ct as (select distinct note_id, tag from note_tags where note_id is not null and tag is not null)"
NOTES = "cn as (select * exclude (rn) from (select *, row_number() over (partition by note_id order by synced_at desc nulls last, fetched_at desc nulls last, mod desc nulls last, content_hash desc nulls last, profile desc nulls last, model_name desc nulls last) as rn from notes where note_id is not null) where rn = 1)"
#: The notes of a condition on note_id, with the first field each has.
LISTED = f"{FIELDS}, {FRONT}, listed as (select note_id, front from (select distinct note_id from notes where note_id is not null) left join front using (note_id))"
INDEX = f"{LISTED}, idx as (select note_id, {tokens(with_media('front'))} as tokens from listed)"
VECTORS = """cv as (select note_id, backend, model, vec from (
  select *, row_number() over (partition by note_id, backend, model order by updated_at desc nulls last, vec desc) as rn
  from (select *, list_sum(list_transform(vec, lambda x: abs(x::double))) as total from embeddings2 where note_id is not null and model is not null and vec is not null)
  where total is not null and not isnan(total) and total > 0 and not isinf(total)) where rn = 1)"""


def values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(values {body}) v({columns})"


def numbers(vec) -> str:
    return "[" + ", ".join(repr(float(x)) for x in vec) + "]::double[]"


#: Whether a front shows anything.
VISIBLE = rf"coalesce(regexp_matches(front, '\[sound:[^\]]+\]', 'i') or regexp_matches(front, '<img\b', 'i') or length({strip_html('front')}) > 0, false)"


def bm25(terms: dict[int, list[str]]) -> str:
    """CTEs up to scores(query_id, note_id, bm25)."""
    rows = [(q, i, t) for q, ts in terms.items() for i, t in enumerate(ts)]
    return f"""{INDEX},
terms as (select query_id, term_idx, term, {tokens('term')} as words from {values(rows, 'query_id, term_idx, term')}),
{SCORES}"""


#: CTEs from idx and terms(query_id, term_idx, term, words) up to parts(query_id, term_idx, term, note_id, part, df, n) and scores.
SCORES = """stats as (select count(*) as n, avg(len(tokens)) as mean from idx),
hits as (
  select query_id, term_idx, term, note_id, len(tokens) as length,
    len(list_filter(range(1, greatest(len(tokens) - len(words) + 2, 1)), lambda i: tokens[i : i + len(words) - 1] = words)) as tf
  from idx join terms on len(words) > 0 and list_contains(tokens, words[1])),
dfs as (select query_id, term_idx, count(*) as df from hits where tf > 0 group by all),
parts as (
  select query_id, term_idx, term, note_id, df, n,
    -(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) as part
  from hits join dfs using (query_id, term_idx) cross join stats where tf > 0),
scores as (select query_id, note_id, sum(part) as bm25 from parts group by all)"""
