"""One spelling for texts that look the same.

Each token gets the script set it resolves to: the intersection of its letters' scripts. Tokens of
mixed scripts, and tokens of one script that another can spell, are respelled in the script that can
spell all of their letters; the remaining forms (width, accents, spaces, hyphens, ligatures, invisible
characters) are normalised.

Which letters look alike follows from the confusables of the Unicode consortium, as the ICU library that
Spark brings along has them, and from a list of the most common ones.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata as U
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.shared import cut

# Letters of other alphabets that look like the Latin letter before the colon.
LOOKALIKES = """
A: Α А Ꭺ
B: Β В Ᏼ
C: Ϲ С Ꮯ
D: Ꭰ
E: Ε Е Ꭼ
G: Ԍ Ꮐ
H: Η Н Ꮋ
I: Ι І Ӏ
J: Ϳ Ј Ꭻ
K: Κ К Ꮶ
L: Ꮮ
M: Μ М Ꮇ
N: Ν
O: Ο О Օ
P: Ρ Р Ꮲ
Q: Ԛ
R: Ꭱ
S: Ѕ Տ Ꮪ
T: Τ Т Ꭲ
U: Ս
V: Ѵ Ꮩ
W: Ԝ Ꮃ
X: Χ Х
Y: Υ Ү
Z: Ζ Ꮓ
a: а
c: ϲ с
d: ԁ
e: е
g: ց
h: һ հ
i: і
j: ϳ ј
l: ӏ
n: ո
o: ο о օ
p: р
q: ԛ
s: ѕ
u: ս
w: ԝ
x: х
y: у
"""
# Variants of a letter within an alphabet, or signs used as it, which look like it.
VARIANTS = {"ɡ": "g", "ɑ": "a", "µ": "μ", "∆": "Δ", "∑": "Σ", "∏": "Π"}
# Signs of other alphabets that look like the ASCII sign.
SIGNS = {"։": ":", "׃": ":", "∶": ":", "꞉": ":", "٪": "%", "‚": ",", "․": ".", "ʹ": "'", "՚": "'", "ǃ": "!", "⁎": "*", "∗": "*", "⁓": "~", "∼": "~", "⁄": "/", "∕": "/"}
# Hyphens that read like the ASCII one; dashes differ visibly in length.
HYPHENS = "‐‑‒˗﹣－⁃−"
# Characters without width that are not of the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
# Format characters that are visible.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢"

#: In this order a script is taken for a token that several can spell, others by name after them.
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")

# Writing systems of several scripts, by the public rules for mixed scripts (Han with Bopomofo, Japanese, Korean).
SYSTEMS = {"CJK": {"CJK", "HANB", "JPAN", "KORE"}, "BOPOMOFO": {"BOPOMOFO", "HANB"}, "HIRAGANA": {"HIRAGANA", "JPAN"}, "KATAKANA": {"KATAKANA", "JPAN"}, "HANGUL": {"HANGUL", "KORE"}}

#: Identical texts up to which every document of a reading is paired with every one written otherwise; of more the smallest stands for all.
COPIES = 50


@functools.cache
def script(letter: str) -> str:
    """Script of a letter, from the first word of its Unicode name; "" for what all scripts share."""
    if not letter.isalpha():
        return ""
    word = U.name(letter, "").split(" ")[0].split("-")[0]
    return {"MICRO": "GREEK", "OHM": "GREEK", "KELVIN": "LATIN", "ANGSTROM": "LATIN"}.get(word, word)


def systems(letter: str) -> frozenset[str]:
    """Scripts and writing systems a letter may belong to."""
    name = script(letter)
    return frozenset(SYSTEMS.get(name, {name}))


def confusables(spark: SparkSession) -> dict[str, str]:
    """letter -> the ASCII letter it looks like, for the letters of all other scripts: those whose skeleton is one ASCII letter.

    Skeletons do not tell capital I from small l; a capital letter is taken for I, any other for l. Raises where ICU
    does not answer (its class is missing, the session is remote): fewer look-alikes would give results that only seem whole.
    """
    letters = [c for c in map(chr, [*range(0x250, 0x3000), *range(0xA000, 0xAC00), *range(0xFB00, 0xFF00), *range(0x10000, 0x12000), *range(0x16000, 0x17000), *range(0x1D000, 0x1F000)]) if c.isalpha() and script(c) != "LATIN" and U.normalize("NFKC", c) == c]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = checker.getSkeleton("\n".join(letters)).split("\n")
    except Exception as error:
        raise RuntimeError("look-alikes need com.ibm.icu.text.SpoofChecker of ICU4J in the driver's JVM, which Spark 4 brings along") from error
    if len(skeletons) != len(letters):
        raise RuntimeError(f"SpoofChecker gave {len(skeletons)} skeletons for {len(letters)} letters")
    looks = {}
    for c, look in zip(letters, skeletons):
        if len(look) == 1 and look.isascii() and look.isalpha():
            looks[c] = "I" if look == "l" and c.isupper() else look
    if not looks:
        raise RuntimeError("SpoofChecker knows no look-alikes of ASCII letters")
    return looks


class Looks:
    """Classes of letters that look the same, and what follows from them: how tokens are spelled, and the one form of a text."""

    def __init__(self, more: dict[str, str] | None = None):
        self.more = more or {}
        self.table: dict[str, dict[str, str]] = {}
        for line in LOOKALIKES.strip().splitlines():
            latin, _, rest = line.partition(": ")
            members = {"LATIN": latin}
            for letter in rest.split():
                members.setdefault(script(letter), letter)
            for letter in [latin, *rest.split()]:
                self.table[letter] = members
        # letters of one script differ visibly: a look belongs to one of them, best to one whose other case has the look's other case
        fits = lambda c: self.more.get(c.swapcase(), "") == self.more[c].swapcase() and c.swapcase() != c
        for c in sorted(self.more, key=lambda c: (not fits(c), c)):
            look = self.more[c]
            if c in self.table or look not in self.table and not look.isalpha():
                continue
            members = self.table.setdefault(look, {"LATIN": look})
            if script(c) not in members:
                members[script(c)] = c
                self.table[c] = members
        self.spell = functools.lru_cache(200_000)(self._spell)
        self.kind = functools.lru_cache(200_000)(self._kind)

    def __reduce__(self):
        return Looks, (self.more,)

    def scripts_of(self, letter: str) -> frozenset[str]:
        """Scripts that can spell a letter by its look."""
        members = self.table.get(letter)
        return frozenset(members) if members else frozenset([script(letter)])

    def _spell(self, token: str) -> str:
        """A token of decomposed letters in the one script that can spell it, else letter by letter in Latin where that can.

        A token that some script can spell has a non-empty intersection of the scripts of its letters' looks.
        Which those are depends on the looks only, so look-alike tokens come out the same.
        """
        able: frozenset[str] | None = None
        for c in token:
            if c.isalpha():
                able = self.scripts_of(c) if able is None else able & self.scripts_of(c)
        into = min(able, key=lambda s: (SCRIPTS.index(s) if s in SCRIPTS else len(SCRIPTS), s)) if able else "LATIN"
        return "".join(self.table[c][into] if c in self.table else c for c in token)

    def _kind(self, token: str) -> str:
        """"single", "mixed" (no one script or writing system has all letters as written) or "whole" (one script, but Latin can spell it too)."""
        plain = [c for c in U.normalize("NFD", token) if c.isalpha()]
        if not plain:
            return "single"
        if not frozenset.intersection(*map(systems, plain)):
            return "mixed"
        able = frozenset.intersection(*map(self.scripts_of, plain))
        return "whole" if "LATIN" in able and {script(c) for c in plain} != {"LATIN"} else "single"

    def canonical(self, text: str) -> str:
        """The one form of all texts that read the same."""
        if _PLAIN.fullmatch(text):
            return text
        flat = "".join(map(_form, text.replace("\r\n", "\n").replace("\r", "\n")))
        if "\u200d" in flat:
            flat = re.sub("\u200d", lambda m: "\u200d" if m.start() and U.category(flat[m.start() - 1]) in ("So", "Sk") else "", flat)
        if not flat.isascii():
            flat = U.normalize("NFD", flat)
            flat = _WORD.sub(lambda m: m[0] if m[0].isascii() else self.spell(m[0]), flat)
            flat = U.normalize("NFC", flat)
        return flat


@functools.cache
def _form(c: str) -> str:
    """A character without the differences of form: width, ligature, space, hyphen; invisible ones vanish.

    The result is decomposed.
    """
    o = ord(c)
    if c in HYPHENS:
        return "-"
    if c == "‍":
        return c  # joins emoji; handled with its neighbours
    cat = U.category(c)
    if c in INVISIBLE or 0xE0100 <= o <= 0xE01EF or (cat == "Cf" and c not in VISIBLE_FORMAT):
        return ""
    if cat == "Zs" or c == "\t":
        return " "
    if cat in ("Zl", "Zp") or c in "\x85\x0b\x0c":
        return "\n"
    if cat == "Cc" and c not in "\n\r":
        return ""
    if c in SIGNS:
        return SIGNS[c]
    kind = U.decomposition(c).partition(">")[0].lstrip("<") if U.decomposition(c).startswith("<") else ""
    name = U.name(c, "")
    if kind in ("wide", "narrow", "font", "initial", "medial", "final", "isolated") or (kind == "compat" and ("LIGATURE" in name or "DIGRAPH" in name or "ROMAN NUMERAL" in name or name.startswith("LATIN") and " WITH " in name and "LETTER" in name and o in range(0x1C4, 0x1F4))):
        c = U.normalize("NFKC", c)
    return U.normalize("NFD", "".join(VARIANTS.get(x, x) for x in U.normalize("NFD", c)))


_PLAIN = re.compile("[\x20-\x7e\n]*")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


@functools.cache
def _common() -> Looks:
    return Looks()


def canonical(text: str) -> str:
    """The one form of a text by the common look-alikes alone."""
    return _common().canonical(text)


def token_kind(token: str) -> str:
    return _common().kind(token)


def _canon(looks: Looks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([looks.canonical(t) for t in texts], pa.string())], names=["doc_id", "canonical_text"])

    return run


def normalised(documents: DataFrame) -> DataFrame:
    """(doc_id, canonical_text): every text in its one form.

    Null and blank texts are left out; rows without doc_id too. Repeated rows come out repeatedly, extra
    columns are ignored. Whole texts are treated whatever their length.
    """
    return _readable(documents).mapInArrow(_canon(Looks(confusables(documents.sparkSession))), "doc_id long, canonical_text string")


def _readable(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}]")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _keys(looks: Looks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            forms, texts = [], []
            for t in b.column("text").to_pylist():
                k = digest(t)
                c = looks.canonical(t)
                texts.append(k)
                forms.append(k if c == t else digest(c))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forms, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "form", "written"])

    return run


def reading_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, form, written): 128-bit digests of the canonical and of the written text, distinct rows."""
    looks = Looks(confusables(documents.sparkSession))
    return cut(_readable(documents).mapInArrow(_keys(looks), "doc_id long, form binary, written binary").distinct(), "readings")


def same_reading(documents: DataFrame, copies: int = COPIES) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts differ in characters but read the same.

    Exact copies of each other are no pair. Of a text that up to `copies` documents have, all stand in pairs with
    all other texts of that reading; of one with more, the smallest document stands for it, and each further one
    has a pair with a document of the other text with the smallest documents. So every two texts are
    linked, and the rows stay in proportion to the copies. reading_classes() has the membership.
    Forms written in one way only have no pair and leave before the join; a hot form is split by adaptive
    execution, as either side of it may be large.
    """
    keys = reading_keys(documents)
    several = keys.groupBy("form").agg(F.min("written").alias("lo"), F.max("written").alias("hi")).where("lo <> hi").select("form")
    left = cut(keys.join(several, "form", "left_semi"), "spellings")
    texts = left.groupBy("form", "written").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"))
    sized = left.join(texts, ["form", "written"])
    stand = sized.where((F.col("n") <= copies) | (F.col("doc_id") == F.col("head")))
    a = stand.select("form", F.col("doc_id").alias("x"), F.col("written").alias("wa"))
    b = stand.select("form", F.col("doc_id").alias("y"), F.col("written").alias("wb"))
    across = a.join(b, "form").where("x < y and wa <> wb").select("x", "y")
    # the two texts of the smallest heads of a form: one of them is another text than any given one
    first = texts.groupBy("form").agg(F.min(F.struct("head", "written")).alias("one"))
    second = texts.join(first, "form").where(F.col("written") != F.col("one.written")).groupBy("form").agg(F.min("head").alias("other"))
    rest = sized.where((F.col("n") > copies) & (F.col("doc_id") != F.col("head"))).join(first, "form").join(second, "form")
    further = rest.select("doc_id", F.when(F.col("written") != F.col("one.written"), F.col("one.head")).otherwise(F.col("other")).alias("with"))
    rows = across.unionByName(further.where(F.col("doc_id") != F.col("with")).select(F.col("doc_id").alias("x"), F.col("with").alias("y")))
    return rows.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def reading_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_documents, n_spellings): class_id is the smallest doc_id that reads the same."""
    keys = reading_keys(documents)
    classes = keys.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_documents"), F.countDistinct("written").alias("n_spellings"))
    return keys.join(classes, "form").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_documents").alias("n_documents"), F.max("n_spellings").alias("n_spellings"))


def _kinds(looks: Looks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                n = {"mixed": 0, "whole": 0, "single": 0}
                if not t.isascii():
                    for m in _WORD.finditer(U.normalize("NFD", "".join(map(_form, t)))):
                        if not m[0].isascii():
                            n[looks.kind(m[0])] += 1
                out.append((n["mixed"], n["whole"], looks.canonical(t) != t))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "mixed_tokens", "whole_script_tokens", "changed"])

    return run


def script_report(documents: DataFrame) -> DataFrame:
    """(doc_id, mixed_tokens, whole_script_tokens, changed): confusable tokens of each text, and whether it had to change."""
    looks = Looks(confusables(documents.sparkSession))
    return _readable(documents).mapInArrow(_kinds(looks), "doc_id long, mixed_tokens long, whole_script_tokens long, changed boolean")
