"""Scoring formulas as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the scoring formulas.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
# Endings that mark a likely noun in query weights.
NOUN_ENDINGS = "tion sion ment ness ity ism ology logy itis emia osis oma ectomy plasty scopy gram graphy phobia philia gen genic ase ose algia derm cyte blast coccus cocci bacter virus enzyme receptor syndrome disease anemia ecchymosis contusion hematoma neuron artery vein nerve muscle bone cortex nucleus organ tissue cell protein".split()


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = clamp01((x - a) / max(1e-9, b - a))
    return t * t * (3 - 2 * t)


def hybrid_score(cos: Column, bm25: Column, matched: Column) -> Column:
    """Cosine, damped where the words match badly, raised where they match well. Missing values count as 0."""
    cos, s = clamp01(F.coalesce(cos, F.lit(0.0))), F.greatest(F.lit(0.0), -F.coalesce(bm25, F.lit(0.0)))
    low = 1 - smoothstep(7, 11, s)
    heavy = low * low
    modest = F.greatest(F.lit(0.0), low - heavy)
    gate = 1 - smoothstep(0.5, 0.6, cos)
    damped = cos * clamp01(1 - (0.35 * heavy + 0.15 * modest) * gate)
    bonus = 0.03 * (1 - F.exp(-F.greatest(F.lit(0.0), matched - 1) / 2))
    raw = F.greatest(F.lit(0.0), 0.60 * (1 - F.exp(-s / 9)) - 0.02 + bonus)
    share = F.least(F.lit(0.65), raw / (1 + F.exp(-0.45 * (s - 18))))
    return damped + share * (1 - damped)


def bm25_idf(n: Column, df: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, IDF_FLOOR).otherwise(idf)


def bm25_part(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    """A phrase's share of the score: negative, lower is better."""
    return -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def likely_noun(term: Column) -> Column:
    return term.contains("-") | term.rlike("(?:" + "|".join(NOUN_ENDINGS) + ")$") | ((F.length(term) >= 5) & ~term.rlike("(?:ing|ed)$"))


def term_weight(term: Column, n: Column, df: Column) -> Column:
    idf = F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.ln((n - df + 0.5) / (df + 0.5))))
    return 1 + idf + F.when(term.contains("-"), 0.75).otherwise(0.0) + F.when(F.length(term) >= 8, 0.25).otherwise(0.0) + F.when(likely_noun(term), 3.5).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero; null where lengths differ."""
    bottom = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(bottom == 0, 0.0).otherwise(dot(a, b) / bottom))
