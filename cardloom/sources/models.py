"""External models as functions of Arrow batches, with deterministic stand-ins that need no network."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is put before queries and documents for models that tell them apart.
ROLES = {"query": "task: search result | query: ", "document": "title: none | text: ", "plain": ""}


class Embedder(Protocol):
    """Vectors for texts."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """A score per text for a query; None where there is none."""

    def __call__(self, query: str, texts: list[str]) -> list[float | None]: ...


class Answerer(Protocol):
    """A language model's answer per prompt."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class HashingEmbedder:
    """Signed feature hashing of words and word pairs: alike texts get alike vectors, the same everywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            words = t.lower().split()
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        n = np.sqrt((out**2).sum(1, keepdims=True))
        return out / np.where(n > 0, n, 1)


class OverlapReranker:
    """Share of the query's words that a text has."""

    def __call__(self, query: str, texts: list[str]) -> list[float | None]:
        want = set(query.lower().split())
        return [len(want & set(t.lower().split())) / len(want) if want else 0.0 for t in texts]


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder], role: str = "plain", batch: int = 64) -> DataFrame:
    """rows with `vec` and `norm`; the model is made once per task, and called with at most `batch` texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vec array<float>, norm double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            texts = [ROLES[role] + (t or "") for t in b[text]]
            parts = [model(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            x = np.concatenate(parts) if parts else np.empty((0, model.dim), np.float32)
            yield b.assign(vec=list(x.astype(np.float32)), norm=np.sqrt((x.astype(np.float64) ** 2).sum(1)))

    return rows.mapInPandas(run, schema)


def reranked(rows: DataFrame, text: str, query: str, make: Callable[[], Reranker]) -> DataFrame:
    """(note_id, rerank)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame({"note_id": b["note_id"], "rerank": pd.Series(model(query, b[text].fillna("").tolist()), dtype="float64")})

    return rows.select("note_id", text).mapInPandas(run, "note_id long, rerank double")


class EchoAnswerer:
    """Answers with the digits of the prompt's length, as a grading model does: the same everywhere."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"output_text": f"BEGIN_DIGITS <{len(p.split()) % 4}> END_DIGITS"}) for p in prompts]


def answered(rows: DataFrame, prompt: str, make: Callable[[], Answerer], batch: int = 8) -> DataFrame:
    """rows with `answer`; the model is made once per task, and called with at most `batch` prompts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            texts = [t or "" for t in b[prompt]]
            yield b.assign(answer=[a for i in range(0, len(texts), batch) for a in model(texts[i : i + batch])])

    return rows.mapInPandas(run, schema)


def cached_terms(terms: DataFrame, cache: DataFrame, make: Callable[[], Embedder], dim: int) -> DataFrame:
    """(term, vec): vectors of lower-cased terms from the cache where their dim fits, else from the model."""
    want = terms.select(F.lower("term").alias("term")).where("term is not null").distinct()
    have = cache.where(F.size("vec") == dim).groupBy("term").agg(F.max(F.struct("updated_at", "vec")).alias("x")).select("term", F.col("x.vec").alias("vec"))
    known = want.join(have, "term")
    missing = want.join(have, "term", "left_anti")
    return known.unionByName(embedded(missing, "term", make, "query").select("term", "vec"))


class QueryCache:
    """Vectors of typed queries on the driver, for some minutes."""

    def __init__(self, model: Embedder, seconds: float = 600, most: int = 1000):
        self.model, self.seconds, self.most, self.kept = model, seconds, most, {}

    def __call__(self, query: str, now: float | None = None) -> np.ndarray:
        import time

        at = time.time() if now is None else now
        hit = self.kept.get(query)
        if hit is None or at - hit[0] > self.seconds:
            if len(self.kept) >= self.most:
                del self.kept[min(self.kept, key=lambda q: self.kept[q][0])]
            hit = self.kept[query] = (at, self.model([query])[0])
        return hit[1]


class Settings(dict):
    """Configuration values as strings, with typed reads."""

    def flag(self, key: str) -> bool:
        return self.get(key) in ("1", "true")

    def number(self, key: str, default: float) -> float:
        try:
            return float(self[key])
        except (KeyError, ValueError):
            return default
