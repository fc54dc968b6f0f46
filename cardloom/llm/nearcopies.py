"""Groups of records that share most of their words: a grouped prefix join.

Records with the same words are one class. Classes of equal size and equal prefix (their rarest words)
are one group; group pairs are found by a common prefix word, filtered by size and position, then
expanded to their classes, which are verified.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.shared import cut

_SOUND = re.compile(r"\[sound:[^\]]*\]")
_TAG = re.compile(r"<!--.*?-->|<[^>]*>", re.S)
_CLOZE = re.compile(r"\{\{c\d+::((?:(?!\{\{|\}\}|::).)*)(?:::(?:(?!\{\{|\}\}).)*)?\}\}", re.S)
_WORD = re.compile(r"[^\W_]+")

#: Buckets of the word counts that order the words: some 2 MB on every executor, whatever the vocabulary.
BUCKETS = 1 << 18

#: A word of more sets than this is a key only together with another.
FREQUENT = 100

#: A key of several words that more groups than this have grows by one word, up to so many words.
HOT, MOST_WORDS = 4_000, 8

#: Notes with one text up to which every pair of them is a row; of a text with more each note is paired with the smallest.
COPIES = 50


def visible(value: str) -> str:
    """Text of an HTML field: sounds dropped, tags as spaces, entities decoded, cloze marks opened."""
    value = _SOUND.sub(" ", value) if "[sound:" in value else value
    value = _TAG.sub(" ", value) if "<" in value else value
    value = html.unescape(value) if "&" in value else value
    while "{{c" in value:
        value, n = _CLOZE.subn(r"\1", value)
        if not n:
            break
    return value


def words(value: str) -> set[str]:
    return set(_WORD.findall(visible(value).lower()))


@functools.lru_cache(500_000)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def _word_sets(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, sets, rows = [], [], [], []
            for i, value in enumerate(b.column("value").to_pylist()):
                text = visible(value)
                found = set(_WORD.findall(text.lower()))
                if len(found) < least:
                    continue
                w = np.array(sorted(map(_hash, found)), np.int64)
                rows.append(i)
                sets.append(w)
                keys.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                texts.append(xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass")) - (1 << 63))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(texts, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "key", "text", "words"])

    return run


def word_sets(records: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(id, key, text, words): the distinct words of each text with at least so many, as sorted 64-bit hashes; key digests them, text the visible text."""
    rows = records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("value")).where("id is not null and value is not null").where(F.length("value") >= 2 * least - 1)
    return rows.mapInArrow(_word_sets(least), "id long, key binary, text long, words array<long>")


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Words in the probing and in the indexing prefix of a set of n: the latter for partners that are no smaller."""
    probe = n - -(-percent * n // 100) + 1
    index = n - -(-2 * percent * n // (100 + percent)) + 1
    return max(1, probe), max(1, index)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of two words in their order."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.view(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def prefix_keys(w: np.ndarray, rare: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the last word of each) of a set's ordered words.

    Sets that are similar enough have a word in common in their prefixes, and m words in prefixes longer by
    m - 1. So a rare word is a key by itself; a frequent one is a key with each later word of the longer
    prefix. The first words in common give both sets the same key.
    """
    i, j = np.triu_indices(min(probe + 1, len(w)), 1)
    often = ~rare[i] & (i < probe)
    i, j = i[often], j[often]
    alone = np.flatnonzero(rare[:probe])
    return np.concatenate([w[alone], _pair_keys(w[i], w[j])]), np.concatenate([alone, j]).astype(np.int32)


def _bitmap(w: np.ndarray) -> tuple[int, int]:
    """128 bits, one set for each word."""
    bit = (w.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(57)
    one = np.uint64(1)
    lo = np.bitwise_or.reduce(one << bit[bit < 64], initial=np.uint64(0))
    hi = np.bitwise_or.reduce(one << (bit[bit >= 64] - np.uint64(64)), initial=np.uint64(0))
    return int(lo.astype(np.int64)), int(hi.astype(np.int64))


def _group_rows(counts, percent: int, frequent: int):
    """Each class with the keys of its prefix, its words by rising count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for b in batches:
            out: list[tuple] = []
            column = b.column("words")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            at = ends - ends[0]
            for i in range(len(column)):
                w = flat[at[i] : at[i + 1]]
                count = table[w & (BUCKETS - 1)]
                order = np.lexsort((w, count))
                probe, _ = prefix_lengths(len(w), percent)
                p = w[order[: probe + 1]]
                gid = hashlib.blake2b(p.tobytes() + len(w).to_bytes(8, "little"), digest_size=16).digest()
                rare = count[order[: probe + 1]] <= frequent
                keys, last = prefix_keys(p, rare, probe)
                alone = int(rare[:probe].sum())
                level = np.where(np.arange(len(keys)) < alone, 1, 2).astype(np.int32)
                out.append((gid, len(w), *_bitmap(w), keys, last, level, w[order]))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["key", "gid", "n", "lo", "hi", "words", "lasts", "levels", "ordered"])

    return run


def classes(sets: DataFrame) -> DataFrame:
    """(key, words): one row per set of words."""
    return sets.groupBy("key").agg(F.first("words").alias("words"))


def _enough(inter: Column, n1: Column, n2: Column, percent: int) -> Column:
    return inter * (100 + percent) >= (n1 + n2) * percent


def _prefix(n: Column, part: int, whole: int) -> Column:
    """Words of a prefix: those beyond part / whole of n, and one more. See prefix_lengths()."""
    return n - F.ceil(n * part / whole - 1e-9) + 1


def _of_bounded_frequency(keys: DataFrame, members: DataFrame, groups: DataFrame, percent: int, hot: int) -> DataFrame:
    """keys (word, last, level, gid, ...) where every one that more than `hot` groups have is replaced by those with one word more.

    The m-th word in common lies in the prefix longer by m - 1, so a key of m words grows by each later word of
    the prefix longer by m. The words beyond the common prefix are those of a group's members. Keys of as many
    words as the smallest similar sets must share stay as they are.
    """
    level, smallest = 2, groups.agg(F.min("n").alias("n")).head()["n"] or 0
    while level < min(MOST_WORDS, -(-percent * smallest // 100)):
        often = cut(keys.groupBy("word").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("word"), "hot")
        if often.isEmpty():
            break
        few = F.broadcast(often) if often.count() <= 200_000 else often
        grow = keys.join(few, "word", "left_semi").where(F.col("level") == level).select("word", "last", "gid")
        probe = _prefix(F.col("n"), percent, 100)
        at = F.sequence(F.col("last") + 1, F.least(F.col("n"), probe + level) - 1)
        met = grow.join(members, "gid").where(F.col("last") + 1 <= F.least(F.col("n"), probe + level) - 1)
        longer = met.select("gid", "word", F.explode(at).alias("last"), "ordered").select("gid", F.xxhash64("word", F.get("ordered", F.col("last"))).alias("word"), F.col("last").cast("int").alias("last")).distinct()
        stay = keys.join(few, "word", "left_anti").unionByName(keys.join(few, "word", "left_semi").where(F.col("level") < level))
        level += 1
        keys = cut(stay.unionByName(longer.withColumn("level", F.lit(level)).join(groups, "gid").select(*keys.columns)), "keys")
    return keys


def similar_classes(sets: DataFrame, percent: int, frequent: int = FREQUENT, hot: int = HOT) -> DataFrame:
    """(key_a, key_b, common, n_a, n_b): all pairs of different sets that share percent of the words in either.

    Exact: any total order of words gives a complete prefix filter, so the counts that order them may
    share buckets. Words are compared by 64-bit hashes. Group pairs are filtered in the join by size and
    by bitmaps: a bit that all sets of one group have and none of the other stands for a word not shared.
    """
    spark = sets.sparkSession
    one = cut(classes(sets), "classes")
    hist = one.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).count().toPandas()  # BUCKETS rows at most
    table = np.zeros(BUCKETS, np.int64)
    table[hist["bucket"].to_numpy()] = hist["count"].to_numpy()
    members = cut(one.mapInArrow(_group_rows(spark.sparkContext.broadcast(table), percent, frequent), "key binary, gid binary, n int, lo long, hi long, words array<long>, lasts array<int>, levels array<int>, ordered array<long>"), "groups")
    bits = [F.bit_and("lo").alias("lo_all"), F.bit_and("hi").alias("hi_all"), F.bit_or("lo").alias("lo_any"), F.bit_or("hi").alias("hi_any")]
    zipped = F.arrays_zip("words", "lasts", "levels")
    groups = cut(members.groupBy("gid").agg(F.first("n").alias("n"), F.first(zipped).alias("keys"), *bits), "joined")
    rest = ["gid", "n", "lo_all", "hi_all", "lo_any", "hi_any"]
    keys = groups.select(*rest, F.explode("keys").alias("k")).select(F.col("k.words").alias("word"), F.col("k.lasts").alias("last"), F.col("k.levels").alias("level"), *rest)
    keys = _of_bounded_frequency(keys, members.select("gid", "n", "ordered"), groups.select(*rest), percent, hot)
    # a key whose last place lies in the shorter prefix serves partners that are no smaller
    shorter = F.col("last") < _prefix(F.col("n"), 2 * percent, 100 + percent) + F.col("level") - 1
    a = keys.where(shorter).select("word", *[F.col(c).alias(f"a_{c}") for c in rest])
    b = keys.select("word", *[F.col(c).alias(f"b_{c}") for c in rest])
    na, nb = F.col("a_n"), F.col("b_n")
    least = F.ceil((na + nb) * percent / (100 + percent) - 1e-9)  # words that must be shared
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}_{h}_all").bitwiseAND(F.bitwise_not(f"{y}_{h}_any"))) for h in ("lo", "hi")), F.lit(0))
    fits = (na <= nb) & (na * 100 >= nb * percent) & ((na < nb) | (F.col("a_gid") < F.col("b_gid"))) & (alone("a", "b") <= na - least) & (alone("b", "a") <= nb - least)
    pairs = a.join(b, "word").where(fits).select(F.col("a_gid").alias("ga"), F.col("b_gid").alias("gb")).distinct()
    # a group of several classes is also a candidate with itself
    alone = members.groupBy("gid").agg(F.count("*").alias("c")).where("c > 1").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    candidates = pairs.unionByName(alone)
    a = members.select(F.col("gid").alias("ga"), F.col("key").alias("key_a"))
    b = members.select(F.col("gid").alias("gb"), F.col("key").alias("key_b"))
    expanded = candidates.join(a, "ga").join(b, "gb").where((F.col("ga") != F.col("gb")) | (F.col("key_a") < F.col("key_b"))).select("key_a", "key_b")
    wa = one.select(F.col("key").alias("key_a"), F.col("words").alias("wa"))
    wb = one.select(F.col("key").alias("key_b"), F.col("words").alias("wb"))
    both = expanded.join(wa, "key_a").join(wb, "key_b")
    done = both.select("key_a", "key_b", F.size(F.array_intersect("wa", "wb")).alias("common"), F.size("wa").alias("n_a"), F.size("wb").alias("n_b"))
    return done.where(_enough(F.col("common"), F.col("n_a"), F.col("n_b"), percent))


def near_copies(records: DataFrame, key: str, text: str, percent: int, least: int, copies: int = COPIES, frequent: int = FREQUENT, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: ids of which a text each has at least `least` distinct words and shares percent of the words in either.

    Words are runs of letters and digits, lower-cased, of the visible text. An id may have several texts,
    repeated rows count once, an id is never its own partner. Null ids and texts are left out, an empty
    table gives no rows, other columns are ignored; whole texts are read.
    Ids with the same words form a class, and those with the same visible text a group of copies in it. Ids of
    a group of up to `copies` stand for themselves; of a larger group the smallest stands for all, and every
    other one has a row with it. All pairs of ids that stand in one class, or in two similar ones, are rows.
    So no link between different texts is lost, and the rows stay in proportion to the copies.
    """
    sets = cut(word_sets(records, key, text, least), "words")
    ids = sets.select("key", "text", "id").distinct()
    sizes = ids.groupBy("key", "text").agg(F.count("*").alias("c"), F.min("id").alias("head"))
    named = cut(ids.join(sizes, ["key", "text"]).select("key", "id", "head", "c"), "members")
    stand = cut(named.where((F.col("c") <= copies) | (F.col("id") == F.col("head"))).select("key", "id").distinct(), "stand")
    links = similar_classes(sets, percent, frequent, hot).select("key_a", "key_b")
    a = stand.select(F.col("key").alias("key_a"), F.col("id").alias("x"))
    b = stand.select(F.col("key").alias("key_b"), F.col("id").alias("y"))
    across = links.join(a, "key_a").join(b, "key_b").select("x", "y")
    several = stand.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    few = stand.join(several, "key", "left_semi")
    within = few.withColumnRenamed("id", "x").join(few.withColumnRenamed("id", "y"), "key").select("x", "y").where("x < y")
    star = named.where((F.col("c") > copies) & (F.col("id") != F.col("head"))).select(F.col("head").alias("x"), F.col("id").alias("y"))
    rows = across.unionByName(within).unionByName(star).where("x <> y")
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def copy_classes(records: DataFrame, key: str, text: str, percent: int, least: int) -> DataFrame:
    """(id, class_id, n_ids, n_links): every class an id belongs to, by the smallest id with the same words.

    n_ids counts the ids of the class, n_links the other classes it is similar to.
    """
    sets = cut(word_sets(records, key, text, least), "words")
    ids = sets.select("key", "id").distinct()
    sizes = ids.groupBy("key").agg(F.count("*").alias("n_ids"), F.min("id").alias("class_id"))
    links = similar_classes(sets, percent)
    degree = links.select(F.col("key_a").alias("key")).unionByName(links.select(F.col("key_b").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
    return ids.join(sizes.join(degree, "key", "left"), "key").select("id", "class_id", "n_ids", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
