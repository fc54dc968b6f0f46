"""Keywords and keyphrases of short texts. Both are sequential rules over one text, run in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no keywords.
STOPWORDS = frozenset("""
a an and are as at by for from has have he her his i in is it its of on or she that the their then there these they this
those to was were will with without within into over under out across after before along during plus minus per via yes no
not treat treats treated treating type types ii iii iv v vi vii viii ix x xi xii one two three four five six seven eight
nine ten external internal female male person present genitalia include includes including such as like both decrease
decreases decreased decreasing increase increases increased increasing reduced reduces lowering lower lowers raise raises
raised raising
""".split())
# Endings of medical nouns and of adjectives.
NOUN_ENDINGS = "itis emia osis oma pathy algia uria plasty scopy graphy ectomy otomy ostomy ology logy gen gens genic ase ose in ide one olol pril sartan azole caine dopa mycin cycline cillin mab ia sia tion rrhea pnea oid oids".split()
ADJECTIVE_ENDINGS = ("ic", "al", "oid", "ed", "y")
# Heads of two- and three-word terms.
DRUG_CLASSES = frozenset("inhibitor inhibitors blocker blockers antagonist antagonists agonist agonists modulator modulators receptor receptors".split())
GREEK = frozenset("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) | frozenset("αβγδεζηθικλμνξοπρστυφχψω")
ELECTRON_HEADS = frozenset("electron electrons bond bonds orbital orbitals".split())
TRIPLE_HEADS = frozenset("syndrome disease deficiency cancer alopecia".split())

_DASHES = str.maketrans(dict.fromkeys("‐‑‒–—―−⁃﹘﹣－", "-"))
_TOKEN = re.compile(r"[^\W_]+(?:(?:-(?=[^\W_])|(?<=[^\W\d_])'(?=[^\W\d_]))[^\W_]+)*")
_ROMAN = re.compile("[IVXLCDM]{1,6}", re.I)
_CLOZE = re.compile(r"c\d+", re.I)
_UPPER_LOWER = r"[A-Z][a-zA-Zß-öø-ÿ]+"


@dataclass
class Word:
    """A token with the tests its rules need."""

    text: str
    low: str = field(init=False)
    stop: bool = field(init=False)
    roman: bool = field(init=False)
    adjective: bool = field(init=False)
    medical: bool = field(init=False)
    noun: bool = field(init=False)

    def __post_init__(self):
        self.low = low = self.text.lower()
        self.stop = low in STOPWORDS
        self.roman = bool(_ROMAN.fullmatch(self.text))
        self.adjective = len(low) >= 4 and low.endswith(ADJECTIVE_ENDINGS)
        enzyme = "-" in low and (low.endswith(("ase", "gen")) or any(p.endswith("ase") for p in low.split("-")))
        self.medical = enzyme or any(low.endswith(e) and len(low) >= max(4, len(e) + 1) for e in NOUN_ENDINGS)
        plural = len(low) >= 5 and low.endswith(("us", "is", "um", "a", "ae", "es", "s"))
        self.noun = self.medical or low.endswith(("testes", "testis")) or plural

    @property
    def score(self) -> float:
        """Worth as a one-word term, -1 for none."""
        if self.stop or self.roman:
            return -1
        t, hyphen = self.text, "-" in self.text
        parts = (
            (hyphen, 2.0), (self.medical, 2.0), (len(t) >= 7 and re.fullmatch("[A-Z][a-z]+", t), 1.8), (re.fullmatch("[A-Z]{3,7}s", t), 2.6),
            (re.fullmatch(f"{_UPPER_LOWER}(?:-[A-Z][a-zA-Zß-öø-ÿ]+)+", t), 1.5), (len(t) >= 8, 0.4), (not hyphen and self.low.endswith(("ing", "ed")), -0.6),
        )
        return sum(v for test, v in parts if test)


def words(text: str) -> list[Word]:
    return [Word(t) for t in _TOKEN.findall(text.translate(_DASHES))]


def _pair_score(a: Word, b: Word) -> float:
    if a.stop or b.stop or a.roman or b.roman:
        return -1
    named = re.fullmatch(_UPPER_LOWER, a.text)
    possessive = re.fullmatch(rf"{_UPPER_LOWER}(?:'s)?", a.text) or re.search(r"[^\W\d_]'s$", a.text)
    parts = (
        (a.adjective and b.noun, 2.2), (re.fullmatch("[A-Z]{2,6}", a.text) and b.low in DRUG_CLASSES, 3.0), (named and b.low in ("syndrome", "disease"), 3.0),
        (possessive and b.low == "rule", 4.0), ((a.low in GREEK or a.text in GREEK) and b.low in ELECTRON_HEADS, 1.6), (len(a.text) >= 6, 0.2), (len(b.text) >= 6, 0.4),
    )
    return 2.2 + sum(v for test, v in parts if test)


def _triple_score(a: Word, b: Word, c: Word) -> float:
    if any(w.stop or w.roman for w in (a, b, c)):
        return -1
    if (b.low, c.low) == ("insensitivity", "syndrome"):
        base = 6.5 if a.adjective or a.noun else 6.0
    elif c.low in TRIPLE_HEADS and all(w.adjective or w.noun for w in (a, b)):
        base = 4.2
    else:
        base = 0.0
    return base + 0.1 * (len(a.text) >= 6) + 0.2 * (len(b.text) >= 6) + 0.3 * (len(c.text) >= 6)


def _skip(ws: list[Word], i: int) -> int:
    """The next place that is no stop word and no cloze mark."""
    while i < len(ws) and (ws[i].stop or _CLOZE.fullmatch(ws[i].low)):
        i += 1
    return i


def _pairs_after(ws: list[Word], cue: str) -> Iterator[tuple[Word, Word]]:
    """X and Y of "cue X ... and Y", with "and" among the five words after X."""
    for i, w in enumerate(ws):
        if w.low != cue:
            continue
        a = _skip(ws, i + 1)
        link = next((k for k in range(a + 1, min(len(ws), a + 6)) if ws[k].low == "and"), None)
        if a < len(ws) and link is not None and (b := _skip(ws, link + 1)) < len(ws):
            yield ws[a], ws[b]


def _after_list_cue(ws: list[Word]) -> Iterator[tuple[str, float, bool]]:
    """(term, score, is a pair) of everything listed after "include", "such as" or "like", to the end of the text."""
    for i, w in enumerate(ws):
        such = w.low == "such" and i + 1 < len(ws) and ws[i + 1].low == "as"
        if not such and w.low not in ("include", "includes", "including", "like"):
            continue
        rest = iter(range(i + 1 + such, len(ws)))
        for j in rest:
            a, b = ws[j], ws[j + 1] if j + 1 < len(ws) else None
            if a.stop:
                continue
            if b and not b.stop and a.adjective and b.noun:
                yield f"{a.text} {b.text}", 5.5, True
                next(rest, None)
            elif a.noun:
                yield a.text, max(2.4, a.score + 0.8), False


def keywords(text: str, k: int = 8) -> list[str]:
    """The best terms of one to three words, each once whatever its case.

    Three-word terms come first, then two-word terms that are in none of them, then single words that are in
    no kept term; phrases score by their place in their list. Plural acronyms lose their s.
    """
    ws = words(text)
    single = [(w.text, s) for w in ws if (s := w.score) >= 2.2]
    double = [(f"{a.text} {b.text}", s) for a, b in zip(ws, ws[1:]) if (s := _pair_score(a, b)) >= 3.0]
    triple = [(f"{a.text} {b.text} {c.text}", s) for a, b, c in zip(ws, ws[1:], ws[2:]) if (s := _triple_score(a, b, c)) >= 4.2]
    for term, s, pair in _after_list_cue(ws):
        (double if pair else single).append((term, s))
    for cue, fits in (("between", lambda w: w.noun), ("both", lambda w: w.noun or len(w.text) >= 5)):
        for pair in _pairs_after(ws, cue):
            single += [(w.text, max(2.6, w.score + 1.0)) for w in pair if fits(w)]
    for i in range(1, len(ws) - 1):
        a, b = ws[i - 1], ws[i + 1]
        if ws[i].low == "and" and not a.stop and not b.stop and any(w.low in ("approved", "indicated") for w in ws[i + 1 : i + 7]):
            single += [(w.text, max(2.5, w.score + 1.2)) for w in (a, b)]
    best = lambda rows: [t for t, _ in sorted(rows, key=lambda r: -r[1])]
    threes = list(dict.fromkeys(best(triple)))
    twos = [t for t in best(double) if not any(t.lower() in long.lower() for long in threes)]
    inside = {w for t in threes + twos for w in t.lower().split(" ")}
    rows = [(t, 10 - i) for i, t in enumerate(threes)] + [(t, 5 - i) for i, t in enumerate(twos)] + [r for r in single if r[0].lower() not in inside]
    named = [t[:-1] if re.fullmatch("[A-Z]{2,7}s", t) else t for t in best(rows)]
    return _first_of_each(named)[:k]


def _first_of_each(terms: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for t in terms:
        seen.setdefault(t.lower(), t)
    return list(seen.values())


def keyword_column(c: Column, k: int = 8) -> Column:
    """keywords() as a column of arrays; null texts have none."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: keywords(t, k) if t else [])

    return run(c)


# Stop words of the phrase extractor, with general words of its domain.
PHRASE_STOP = frozenset("""
the a an and or but if then else of to in on for by with as at from into about over after before between out against during
without within along across behind beyond plus minus per via is are was were be been being do does did done can could should
would may might must will not no yes this that these those it its his her their our your my we you they he she i
pattern rate depth breathing respiration respirations followed again period
""".split())
_PHRASE_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


@dataclass
class PhraseOptions:
    most_candidates: int = 200
    k: int = 30
    longest: int = 5
    window: int = 3
    damping: float = 0.85
    rounds: int = 20
    fusion: str = "avg"
    per_sentence: int = 2
    alike: float = 0.8


def _folded(text: str) -> str:
    d = unicodedata.normalize("NFKD", text)
    return "".join(c for c in d if not (unicodedata.category(c) in ("Mn", "Sk", "Lm") and not c.isalnum())).lower()


def _sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, re.split(r"[.!?\n]+", text)) if s]


def _scaled(values: np.ndarray) -> np.ndarray:
    span = values.max() - values.min()
    return (values - values.min()) / (span or 1)


def _statistic_scores(sents: list[list[str]], originals: list[list[str]], vocab: dict[str, int]) -> np.ndarray:
    """Word scores from first place, frequency, sentences and neighbours, each scaled over the text's words."""
    n = len(vocab)
    first, freq, proper = np.full(n, np.inf), np.zeros(n), np.zeros(n, bool)
    inside: list[set] = [set() for _ in range(n)]
    left, right = [set() for _ in range(n)], [set() for _ in range(n)]
    for s, toks in enumerate(sents):
        orig = originals[s] if s < len(originals) else []
        for i, w in enumerate(toks):
            if (v := vocab.get(w)) is None:
                continue
            first[v], freq[v] = min(first[v], i), freq[v] + 1
            inside[v].add(s)
            left[v].update(toks[i - 1 : i] if i else ())
            right[v].update(toks[i + 1 : i + 2])
            proper[v] |= i < len(orig) and bool(re.search("[A-Z]", orig[i]))
    around = np.array([len(a) + len(b) for a, b in zip(left, right)], float)
    score = np.ones(n)
    for values in (-first, np.log1p(freq), np.array([len(x) for x in inside], float), around):
        score *= np.maximum(1e-6, _scaled(values))
    names = list(vocab)
    score *= np.where(["-" in w for w in names], 2.2, 1.0) * np.where(proper, 1.6, 1.0) * np.where([w.endswith(("ed", "ing")) for w in names], 0.6, 1.0)
    return np.minimum(1, score)


def _graph_scores(sents: list[list[str]], vocab: dict[str, int], o: PhraseOptions) -> np.ndarray:
    """TextRank: power iteration on the co-occurrence matrix; words without neighbours lose their mass."""
    n = len(vocab)
    w = np.zeros((n, n))
    for toks in sents:
        at = [vocab.get(t, -1) for t in toks]
        for gap in range(1, o.window):
            for a, b in zip(at, at[gap:]):
                if a >= 0 and b >= 0:
                    w[a, b] += 1
                    # a word beside itself counts from both ends
                    w[b, a] += 1
    out = w.sum(1)
    step = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    rank = np.full(n, 1 / n)
    for _ in range(o.rounds):
        rank = (1 - o.damping) / n + o.damping * (rank @ step)
    return _scaled(rank)


def keyphrases(text: str, o: PhraseOptions | None = None) -> list[tuple[str, float]]:
    """(phrase, score): runs of at most `longest` words without stop words, by statistics and graph rank together."""
    o = o or PhraseOptions()
    sents = [_PHRASE_TOKEN.findall(s) for s in _sentences(_folded(text))]
    originals = [_PHRASE_TOKEN.findall(s) for s in _sentences(text)]
    vocab: dict[str, int] = {}
    home: dict[tuple[str, ...], int] = {}
    for s, toks in enumerate(sents):
        run: list[str] = []
        for t in [*toks, None]:
            stop = t is None or t in PHRASE_STOP
            if not stop:
                vocab.setdefault(t, len(vocab))
                run.append(t)
            if run and (stop or len(run) == o.longest):
                home.setdefault(tuple(run), s)
                run = []
    if not home:
        return []
    stat, graph = _statistic_scores(sents, originals, vocab), _graph_scores(sents, vocab, o)
    rows = []
    for phrase, s in home.items():
        at = [vocab[w] for w in phrase]
        rows.append((phrase, s, float(stat[at].mean()), float(graph[at].mean())))
    rows = sorted(rows, key=lambda r: -max(r[2], r[3]))[: o.most_candidates]
    if o.fusion == "avg":
        fused = [0.5 * r[2] + 0.5 * r[3] for r in rows]
    else:
        places = [np.argsort(np.argsort([-r[c] for r in rows], kind="stable"), kind="stable") for c in (2, 3)]
        fused = [1 / (61 + int(a)) + 1 / (61 + int(b)) for a, b in zip(*places)]
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[str, float, set[str]]] = []
    for (phrase, s, _, _), score in sorted(zip(rows, fused), key=lambda r: -r[1]):
        if used[s] >= o.per_sentence:
            continue
        used[s] += 1
        have = set(phrase)
        if all(len(have & q) / len(have | q) < o.alike for _, _, q in out):
            out.append((" ".join(phrase), score, have))
        if len(out) >= o.k:
            break
    return [(p, s) for p, s, _ in out]


def phrase_rows(rows: DataFrame, key: str, text: str, o: PhraseOptions | None = None) -> DataFrame:
    """(key, phrase, score, place) of every text; null and empty texts have none. Texts are independent."""
    options = o or PhraseOptions()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, p, s, n) for i, t in zip(b[key], b[text]) if t for n, (p, s) in enumerate(keyphrases(t, options), 1)]
            yield pd.DataFrame(found, columns=[key, "phrase", "score", "place"])

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, phrase string, score double, place int")

