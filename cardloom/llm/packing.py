"""Documents in containers of fixed capacity: best fit decreasing.

Sizes are whole numbers up to the capacity, so documents of one size are interchangeable and so are
containers with the same room left. The driver plans best fit decreasing for counts of sizes, with a
segment tree over the rooms left; its work and memory follow the capacity, not the documents. Documents
then find their containers by their rank within their size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.prefix import prefix_sums
from cardloom.llm.tokens import VOCABULARY, with_tokens
from cardloom.shared import cut

#: The capacities of all specs together may be at most so large: the plan is a table of that order.
MOST_CAPACITY = 4_000_000


class RoomTree:
    """Segment tree over room left: which is the least room of at least s that some container has?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, room: int, present: bool) -> None:
        i = room + self.size
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, s: int) -> int:
        """-1 if there is none."""
        i = s + self.size
        if not self.any[i]:
            while i > 1 and (i % 2 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return -1
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


@dataclass
class Plan:
    """Placements in order: of the items of a size, those from rank `first` on go by `each` into containers from `box` on."""

    size: list[int]
    first: list[int]
    box: list[int]
    each: list[int]
    boxes: int = 0


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Plan for counts of sizes (1..capacity), as if items came one by one by falling size.

    The tightest container with room r takes items until less than one fits: after an item it is still
    the tightest that can take another. Of equally tight ones the one that came to this room first.
    """
    tree = RoomTree(capacity)
    runs: dict[int, deque[tuple[int, int]]] = {}
    plan = Plan([], [], [], [])

    def add(room: int, box: int, n: int) -> None:
        if n and room:
            if not runs.setdefault(room, deque()):
                tree.put(room, True)
            runs[room].append((box, n))

    for s in sorted(counts, reverse=True):
        n, rank = counts[s], 0
        while rank < n:
            room = tree.least(s)
            each = (capacity if room < 0 else room) // s
            need = -(-(n - rank) // each)
            if room < 0:
                room, box, have = capacity, plan.boxes, need
                plan.boxes += need
            else:
                box, have = runs[room].popleft()
            used = min(have, need)
            full = min(used, (n - rank) // each)
            if full:
                _place(plan, s, rank, box, each)
                rank += full * each
            rest = n - rank if full < used else 0
            if rest:
                _place(plan, s, rank, box + full, rest)
                rank += rest
            if room in runs:
                if have > used:
                    runs[room].appendleft((box + used, have - used))
                elif not runs[room]:
                    tree.put(room, False)
            add(room - each * s, box, full)
            if rest:
                add(room - rest * s, box + full, 1)
    return plan


def _place(plan: Plan, size: int, first: int, box: int, each: int) -> None:
    plan.size.append(size)
    plan.first.append(first)
    plan.box.append(box)
    plan.each.append(each)


def _assign(plans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for spec, plan in plans.value.items():
            size, first = np.array(plan.size, np.int64), np.array(plan.first, np.int64)
            by = np.lexsort((first, size))
            tables[spec] = size[by], first[by], np.array(plan.box, np.int64)[by], np.array(plan.each, np.int64)[by]
        for b in batches:
            spec, size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("spec_id", "tokens", "before"))
            out = np.zeros(len(spec), np.int64)
            for s in np.unique(spec):
                rows = np.flatnonzero(spec == s)
                sizes, first, box, each = tables[int(s)]
                # placements of a size are neighbours, by rank: the last one that begins at or before the item's rank
                shift = int(first.max()) + 1
                at = np.searchsorted(sizes * shift + first, size[rows] * shift + np.minimum(rank[rows], shift - 1), "right") - 1
                out[rows] = box[at] + (rank[rows] - first[at]) // each[at]
            names = ["spec_id", "capacity_tokens", "doc_id", "piece", "tokens"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out)], names=[*names, "container_id"])

    return run


def placements(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_id, capacity_tokens, doc_id, piece, tokens, container_id): every document placed once per spec.

    A document of at most the capacity is one item (piece 0). A longer one is cut into pieces of the full
    capacity and a rest; these are the only splits. Texts without tokens and null texts need no room and
    are left out, as are null doc_ids; repeated rows are items of their own. Specs of equal spec_id count
    once, with the smallest capacity; those without a positive capacity are left out. Empty tables give no
    rows; extra columns are ignored. Ties of size go by doc_id.
    """
    spark = documents.sparkSession
    known = specs.where("spec_id is not null and capacity_tokens > 0").groupBy("spec_id").agg(F.min("capacity_tokens").alias("c")).limit(100_001).collect()  # a row per spec
    caps = {r["spec_id"]: int(r["c"]) for r in known}
    if len(known) > 100_000 or sum(caps.values()) > MOST_CAPACITY:
        raise ValueError("more container specs, or larger ones, than can be planned at once")
    schema = "spec_id int, capacity_tokens long, doc_id long, piece int, tokens long, container_id long"
    if not caps:
        return spark.createDataFrame([], schema)
    texts = cut(with_tokens(documents, vocabulary=vocabulary).where("tokens > 0"), "sizes")  # else the range sort would count tokens twice
    spec_list = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity_tokens")) for s, c in sorted(caps.items())])
    each = texts.select("doc_id", F.col("tokens").alias("total"), F.explode(spec_list).alias("s")).select("doc_id", "total", "s.*")
    last = F.floor((F.col("total") - 1) / F.col("capacity_tokens")).cast("int")
    pieces = each.select("spec_id", "capacity_tokens", "doc_id", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    items = pieces.select("spec_id", "capacity_tokens", "doc_id", "piece", F.least(F.col("capacity_tokens"), F.col("total") - F.col("piece") * F.col("capacity_tokens")).alias("tokens"))
    ranked = prefix_sums(items, ["spec_id", "tokens"], ["doc_id", "piece"])
    counts: dict[int, dict[int, int]] = {}
    for r in ranked.groupBy("spec_id", "tokens").agg(F.count("*").alias("n")).toLocalIterator():  # at most a row per spec and size
        counts.setdefault(r["spec_id"], {})[r["tokens"]] = r["n"]
    plans = {s: best_fit_decreasing(c, caps[s]) for s, c in counts.items()}
    return ranked.mapInArrow(_assign(spark.sparkContext.broadcast(plans)), schema)


def containers(placed: DataFrame) -> DataFrame:
    """(spec_id, container_id, capacity_tokens, fill_tokens, n_items, doc_ids): what each container holds; at most capacity items."""
    return placed.groupBy("spec_id", "container_id").agg(F.min("capacity_tokens").alias("capacity_tokens"), F.sum("tokens").alias("fill_tokens"), F.count("*").alias("n_items"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def packing_report(placed: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, n_containers, least_containers, tokens, fill_share, n_split): how full the containers of a spec are.

    least_containers is the bound that no packing can go below: all tokens over the capacity, rounded up.
    """
    per = placed.groupBy("spec_id", "container_id").agg(F.min("capacity_tokens").alias("capacity_tokens"), F.sum("tokens").alias("fill"), F.count_if(F.col("piece") == 1).alias("split"))
    out = per.groupBy("spec_id", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("fill").alias("tokens"), F.sum("split").alias("n_split"))
    return out.select("spec_id", "capacity_tokens", "n_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "tokens", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill_share"), "n_split")
