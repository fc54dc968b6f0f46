"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of that vocabulary, as its publisher gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A text is encoded in pieces of about so many characters, cut where the pattern has a boundary: merges never cross one.
PIECE = 100_000

_loaded: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a ranks file, loaded once in a worker."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of `most` characters or more, each ending where a run of the pattern ends.

    Between a letter and a sign or space, and so on, there always is a boundary, as no alternative of the pattern but
    the contractions and the optional leading space crosses kinds of characters. A run of one kind longer
    than `most` is not cut.
    """
    kind = lambda c: "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if c.isspace() else "P"
    start = 0
    while len(text) - start > most:
        end = start + most
        # a letter, digit or sign followed by one space and by none: the space belongs to what follows
        while end < len(text) - 1 and not (text[end] == " " and kind(text[end - 1]) != "S" and kind(text[end + 1]) != "S") and not (kind(text[end - 1]) in "LN" and kind(text[end]) in "LN" and kind(text[end - 1]) != kind(text[end])) and not (text[end] == "\n" and kind(text[end - 1]) != "S" and kind(text[end + 1]) != "S"):
            end += 1
        end = end if end < len(text) - 1 else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    enc = encoding(vocabulary)
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def _counts(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, vocabulary) for t in b.column("text").to_pylist()]
            names = [x for x in b.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([b.column(x) for x in names] + [pa.array(n, pa.int64())], names=[*names, "tokens"])

    return run


def with_tokens(documents: DataFrame, keep: str = "", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, keep..., tokens) of the rows with doc_id and text; keep is a schema such as "source string".

    Blank texts have tokens too; the empty text has none (0).
    """
    names = [x.split()[0] for x in keep.split(",") if x.strip()]
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *names, "text")
    schema = ", ".join(["doc_id long", *([keep] if keep else []), "tokens long"])
    return rows.mapInArrow(_counts(vocabulary), schema)
