"""Column functions over HTML fields, queries and model answers. All run in the JVM but for two tokenisers."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space everywhere: also no-break and typographic spaces.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PICTURE, SPEAKER = "\U0001f5bc️", "\U0001f50a"
SOUND = r"(?i)\[sound:[^\]]+\]"
BREAK = r"(?i)<br\s*/?\s*>"
TAG = r"<[^>]*>"
#: Entities in the order they are decoded.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def _decode(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def strip_html(c: Column, image: str = " ", sound: str | None = " ") -> Column:
    """Text of an HTML field. image and sound stand for pictures and sound marks; sound None keeps the mark.

    Null is as the empty string. Tags become blanks; entities are decoded after tags are removed, so
    "&lt;b&gt;" stays visible as "<b>".
    """
    c = F.coalesce(c, F.lit(""))
    if image != " ":
        c = F.regexp_replace(c, "(?i)<img[^>]*>", image)
    c = F.regexp_replace(F.regexp_replace(c, BREAK, " "), TAG, " ")
    if sound is not None:
        c = F.regexp_replace(c, SOUND, sound)
    return collapse(_decode(c))


def plain(c: Column) -> Column:
    return strip_html(c)


def with_media(c: Column) -> Column:
    """Pictures and sounds leave an emoji."""
    return strip_html(c, f" {PICTURE} ", f" {SPEAKER} ")


def indexed(c: Column) -> Column:
    return F.lower(with_media(c))


def cost_text(c: Column) -> Column:
    """For size estimates: scripts and styles go with their content, sound marks stay, entities in any case."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style).*?</\1>", " ")
    c = F.regexp_replace(F.regexp_replace(c, BREAK, " "), "<[^>]+>", " ")
    for name, sign in ENTITIES:
        c = F.regexp_replace(c, f"(?i){name}", sign)
    return collapse(c)


def display_text(c: Column) -> Column:
    """For short labels: tags vanish without a blank, quotes are decoded, {{...}} marks are dropped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), TAG, "")
    for name, sign in (*ENTITIES, ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return collapse(F.regexp_replace(c, r"\{\{[^}]*\}\}", ""))


def preview(c: Column) -> Column:
    """For lists: cloze marks opened, pictures and sounds as emoji, all but plain inline tags removed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)<img[^>]*>", PICTURE)
    c = F.regexp_replace(c, SOUND, SPEAKER)
    c = F.regexp_replace(c, r"\{\{c\d+::(.*?)(?:::[^}]*)?\}\}", "<mark>$1</mark>")
    c = F.regexp_replace(c, r"(?i)<(?!/?(?:b|i|u|em|strong|sub|sup|mark)\b)[^>]*>", " ")
    return collapse(F.translate(c, "".join(map(chr, range(0x9000, 0x9005))), "?????"))


def is_visible(c: Column) -> Column:
    """Has a sound, a picture, or text."""
    return F.coalesce(c.rlike(SOUND) | c.rlike(r"(?i)<img\b") | (F.length(plain(c)) > 0), F.lit(False))


def normalize(c: Column) -> Column:
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z only: accented capitals stay."""
    return F.translate(c, _UPPER, _LOWER)


@functools.cache
def _folding() -> tuple[str, str]:
    """Latin letters with marks and their base letters; combining marks last, to be dropped."""
    src, dst = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) > 1 and d[0].isalpha() and d[0].isascii():
            src.append(chr(code))
            dst.append(d[0])
    return "".join(src) + "".join(map(chr, range(0x300, 0x370))), "".join(dst)


def fold(c: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    src, dst = _folding()
    return F.translate(F.lower(F.translate(c, src, dst)), src, dst)


def index_tokens(c: Column) -> Column:
    """Folded runs of letters and numbers of any script; the picture sign is a token too."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}\x{1F5BC}]+"), F.lit(0))


_DASHES = "‐‑‒–—―−⁃﹘﹣－"


def keyword_tokens(c: Column) -> Column:
    """Words with inner hyphens, and apostrophes between letters."""
    joined = r"[\p{L}\p{N}]+(?:(?:-(?=[\p{L}\p{N}])|(?<=\p{L})'(?=\p{L}))[\p{L}\p{N}]+)*"
    return F.regexp_extract_all(F.translate(c, _DASHES, "-" * len(_DASHES)), F.lit(joined), F.lit(0))


def phrase_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def ascii_words(c: Column, least: int = 2, most: int | None = 64) -> Column:
    """Distinct lower-case ASCII words in order of appearance, at most so many (None: all)."""
    found = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(found) if most is None else F.slice(F.array_distinct(found), 1, most)


# Common English words by falling frequency.
COMMON = "the of and to in a is that it for on as with this by an be are from or was at which also but not have has were their can may more most other some such no one two than into between without within over after before about during against under".split()
# Words that are never keywords besides the common ones.
COMMON_EXTRA = "i you he she we they my our your his her its their yes no".split()


def rare_words(c: Column, least: int = 3, alpha_only: bool = True, extra_stop: tuple[str, ...] = ()) -> Column:
    """Distinct letter-only words that are not common ones, long ones first, else in order of appearance.

    A common word would rank by its frequency; as all of them are stop words, every word left is equally rare.
    """
    stop = F.array(*[F.lit(w) for w in dict.fromkeys([*COMMON, *COMMON_EXTRA, *map(str.lower, extra_stop)])])
    found = F.array_except(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= least), stop)
    if alpha_only:
        found = F.filter(found, lambda w: w.rlike("^[a-z]+$"))
    placed = F.transform(found, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(placed), lambda s: s["w"])


def is_roman(c: Column) -> Column:
    return c.rlike("(?i)^[IVXLCDM]{1,6}$")


def trigrams(c: Column) -> Column:
    """Distinct three-character windows."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def query_parts(query: str) -> list[str]:
    """A typed query as its quoted phrases and words, lower-cased."""
    import re

    return [(a or b).lower().strip() for a, b in re.findall(r'"([^"]+)"|(\S+)', query) if (a or b).strip()]


def first_int(c: Column) -> Column:
    """The integer at the end of a text, else the first one in it."""
    last, any_ = F.regexp_extract(c, r"(-?\d+)\s*$", 1), F.regexp_extract(c, r"(-?\d+)", 1)
    return F.coalesce(F.try_to_number(F.nullif(last, F.lit("")), F.lit("S9999999999999999")), F.try_to_number(F.nullif(any_, F.lit("")), F.lit("S9999999999999999"))).cast("long")


def answer_digit(c: Column) -> Column:
    """The class 0..3 in a model's answer: marked, else the first lone digit; null if there is none."""
    marked = F.regexp_extract(c, r"BEGIN_DIGITS\s*<?\s*(\d+)\s*>?\s*END_DIGITS", 1)
    lone = F.regexp_extract(c, r"\b([0-3])\b", 1)
    found = F.coalesce(F.nullif(marked, F.lit("")), F.nullif(lone, F.lit(""))).cast("int")
    return F.when(found.isNotNull(), F.least(found, F.lit(3)))


def answer_text(c: Column) -> Column:
    """Text of a model's JSON answer: output_text, else the texts (or their values) of all output[].content[], joined by blanks."""
    deep = F.from_json(c, "struct<output:array<struct<content:array<struct<text:string>>>>>")["output"]
    texts = F.flatten(F.transform(deep, lambda o: F.transform(F.coalesce(o["content"], F.array().cast("array<struct<text:string>>")), lambda x: F.coalesce(F.get_json_object(x["text"], "$.value"), x["text"]))))
    joined = F.trim(F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), " "))
    return F.coalesce(F.nullif(F.trim(F.get_json_object(c, "$.output_text")), F.lit("")), joined)


def list_items(c: Column, most: int = 10) -> Column:
    """Items of a comma-, semicolon- or line-separated list, trimmed; of items equal but for case the first."""
    raw = F.filter(F.transform(F.split(c, r"[,;\n]"), lambda s: F.trim(s)), lambda s: s != "")
    low = F.transform(raw, lambda s: F.lower(s))
    first = F.filter(F.transform(raw, lambda s, i: F.struct(s.alias("s"), (F.array_position(low, F.lower(s)) == i + 1).alias("new"))), lambda x: x["new"])
    return F.slice(F.transform(first, lambda x: x["s"]), 1, most)


def token_estimate(chars: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.when(chars > 0, F.ceil(chars / 4)).otherwise(0).cast("long")


def token_floor(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")


def tag_head(c: Column) -> Column:
    return F.split_part(c, F.lit("::"), F.lit(1))


def tag_leaf(c: Column) -> Column:
    return F.split_part(c, F.lit("::"), F.lit(-1))


def model_hash(model: Column, dtype: Column, text: Column) -> Column:
    """Hash that tells the model: gemma|model|dtype|digest of the text."""
    return F.concat_ws("|", F.lit("gemma"), model, dtype, F.sha2(text, 256))


def cache_key(model: Column, dims: Column, query: Column) -> Column:
    return F.url_encode(F.concat_ws("|", model, dims.cast("string"), query))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%d%%", F.round(100 * done / total).cast("int"))).otherwise(F.lit("0%"))


def duration(seconds: Column) -> Column:
    """1h 2m 3s without leading zero parts; "-" for none."""
    s = seconds.cast("long")
    return F.when(s.isNull() | (s < 0), "-").when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
