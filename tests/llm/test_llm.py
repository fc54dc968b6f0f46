"""The training-data operators against brute force on small inputs, and their edge cases."""

import itertools
import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.llm import cells, clusters, graphs, lookalikes, mixing, nearcopies, neighbours, packing, tokens
from cardloom.llm import projections as P

VEC = "note_id long, backend string, model string, dim int, vec array<float>, norm double, hash string, updated_at long"


def vectors(spark, rows):
    """rows of (note_id, model, vec, updated_at)."""
    return spark.createDataFrame([(i, "b", m, None, None if v is None else [float(x) if x is not None else None for x in v], -1.0, "h", at) for i, m, v, at in rows], VEC)


def unit(x):
    return x / np.sqrt((x**2).sum(-1, keepdims=True))


def blobs(rng, centers, each, dim=16, spread=0.12):
    c = unit(rng.standard_normal((centers, dim)))
    return unit(np.repeat(c, each, 0) + spread * rng.standard_normal((centers * each, dim)))


# p1 -----------------------------------------------------------------------------------------------


def test_neighbour_descent_recall():
    x = blobs(np.random.default_rng(0), 30, 60).astype(np.float32)
    ids, _ = graphs.neighbour_descent(x, 10)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    true = np.argsort(-sim, 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true)]) >= 0.9


def test_modularity_separates_cliques():
    pairs = [(i, j) for base in (0, 10, 20) for i, j in itertools.combinations(range(base, base + 10), 2)] + [(9, 10), (19, 20)]
    a, b = map(np.array, zip(*pairs))
    label = graphs.modularity_communities(30, a, b, np.ones(len(a)), 1.0)
    assert len({tuple(label[s : s + 10]) for s in (0, 10, 20)}) == 3 and len(set(label)) == 3


def test_clusters_found(spark):
    rng = np.random.default_rng(1)
    x = blobs(rng, 12, 40)
    noise = unit(rng.standard_normal((60, 16)))
    rows = [(100 + i, "m", v * rng.uniform(0.1, 9), 5) for i, v in enumerate(np.concatenate([x, noise]))]
    rows += [(100, "m", -x[0], 1), (7, "m", [float("nan")] * 16, 5), (8, "m", [0.0] * 16, 5), (9, "m", None, 5), (10, "m", [1.0], 5), (11, "m", [None] * 16, 5), (101, "m", x[1], 5)]
    df = vectors(spark, rows)
    got = {r["note_id"]: r["cluster_id"] for r in clusters.clusters(df, dims={"m": 16}, sample=200, cell=100).collect()}
    for c in range(12):
        ids = [100 + 40 * c + i for i in range(40)]
        mean = unit(x[40 * c : 40 * c + 40].mean(0))
        inside = [i for i, v in zip(ids, x[40 * c : 40 * c + 40]) if v @ mean >= 0.75]
        assert len({got.get(i) for i in inside}) == 1 and got[inside[0]] is not None
    assert not {7, 8, 9, 10, 11} & got.keys()
    report = clusters.cluster_report(df, dims={"m": 16}, sample=200, cell=100).collect()
    assert all(len(r["typical_ids"]) == 3 for r in report)
    assert clusters.clusters(df.limit(0), dims={"m": 16}).count() == 0


def test_split_cell_stays_one_cluster(spark):
    x = blobs(np.random.default_rng(2), 1, 600)
    df = vectors(spark, [(i, "m", v, 1) for i, v in enumerate(x)])
    got = clusters.clusters(df, dims={"m": 16}, cell=10_000, hot=150).collect()
    assert len({r["cluster_id"] for r in got}) == 1 and len(got) >= 590


def test_members_of_far_cells_are_found(spark, monkeypatch):
    """A member alone in a cell that 14 others are nearer to its cluster than."""
    e = np.eye(32)
    pivots = np.stack([e[0], *(0.66 * e[0] + 0.75 * e[k] for k in range(1, 15)), 0.35 * e[0] + 0.94 * e[20]])
    monkeypatch.setattr(cells, "fit_pivots", lambda x, n, seed=23: unit(pivots).astype(np.float32))
    x = unit(e[0] + 0.02 * np.random.default_rng(6).standard_normal((12, 32)))
    rows = [*x, 0.76 * e[0] + 0.65 * e[20]]
    got = clusters.clusters(vectors(spark, [(i, "m", v, 1) for i, v in enumerate(rows)]), dims={"m": 32}).collect()
    assert {(r["note_id"], r["cluster_id"]) for r in got} == {(i, 0) for i in range(13)}


def test_pivots_are_distinct():
    rng = np.random.default_rng(8)
    x = unit(rng.standard_normal((900, 16))).astype(np.float32)
    x[:300] = x[0]
    c = cells.fit_pivots(x, 64)
    assert len(np.unique(c.round(4), axis=0)) == len(c) >= 50
    assert set(np.argmax(x @ c.T, 1)) == set(range(len(c)))
    assert len(cells.fit_pivots(x[:300], 20)) == 1


def test_small_clusters_of_a_hot_cell(spark):
    """A cell of 16 small clusters and many copies, far above the rows of one: each cluster stays whole."""
    rng = np.random.default_rng(9)
    x = np.concatenate([blobs(rng, 16, 10, 32, 0.06), np.repeat(unit(rng.standard_normal((1, 32))), 150, 0)])
    got = clusters.clusters(vectors(spark, [(i, "m", v * rng.uniform(0.5, 2), 1) for i, v in enumerate(x)]), dims={"m": 32}, cell=10_000, hot=60).collect()
    assert {r["note_id"]: r["cluster_id"] for r in got} == {i: i // 10 * 10 if i < 160 else 160 for i in range(310)}


def test_lists_of_all_cells(spark):
    """Collection-wide recall of the neighbour lists: those of all cells a vector is in, against brute force."""
    import pyarrow as pa

    from cardloom.llm.vectors import MODEL_DIMS, latest, matrix, usable
    from tests.oracle import DATA

    part = usable(spark.read.parquet(f"{DATA}/sf0.1/embeddings2.parquet"), MODEL_DIMS).where("model = 'tern-embed-2'").toPandas()
    x, ids = matrix(pa.array(part["vec"].tolist(), pa.list_(pa.float32()))), part["note_id"].to_numpy()
    keep = latest(ids, part["updated_at"].to_numpy(), x)
    x, ids = x[keep], ids[keep]
    pivots = cells.fit_pivots(x, 24)
    within = cells.reach(math.sqrt(2 - 2 * clusters.EDGE), x.shape[1], clusters.CERTAINTY) / 2
    at = [[] for _ in pivots]
    start = 0
    for home, i, j in cells.visits(x, cells.Space("m", 0, pivots, 0), within):
        for c in range(len(pivots)):
            at[c] += [*(np.flatnonzero(home == c) + start), *i[j == c]]
        start += len(home)
    lists = [set() for _ in x]
    for rows in at:
        rows = np.array(rows)
        near, _ = graphs.neighbour_descent(x[rows], clusters.NEIGHBOURS)
        for i, r in zip(rows, near):
            lists[i] |= set(rows[r[r >= 0]].tolist())
    recall = [len(lists[i] & set(np.argsort(-np.where(np.arange(len(x)) == i, -2, x @ x[i]))[:10].tolist())) / 10 for i in np.flatnonzero(ids % 20 == 0)]
    assert len(recall) > 400 and np.mean(recall) >= 0.9


def test_typical_members_of_several_cells(spark, monkeypatch):
    """The degree counts edges of all cells, not only of a note's home."""
    rng = np.random.default_rng(10)
    x = unit(unit(rng.standard_normal(16)) + 0.13 * rng.standard_normal((11, 16))).astype(np.float32)
    pivots = x[:5]
    monkeypatch.setattr(cells, "fit_pivots", lambda x, n, seed=23: pivots)
    space = cells.Space("m", 0, pivots, 0)
    home, guest, cell = next(cells.visits(x, space, cells.reach(math.sqrt(2 - 2 * clusters.EDGE), 16, clusters.CERTAINTY) / 2))
    seen = [{int(h)} | {int(c) for g, c in zip(guest, cell) if g == i} for i, h in enumerate(home)]
    cos = x.astype(float) @ x.T.astype(float)
    met = np.array([[i != j and cos[i, j] >= 0.55 and bool(seen[i] & seen[j]) for j in range(11)] for i in range(11)])
    at_home = np.array([[met[i, j] and int(home[i]) in seen[j] for j in range(11)] for i in range(11)])
    best = lambda edges: [int(i) for i in np.argsort(-(cos * edges).sum(1), kind="stable")[:3]]
    assert best(met) != best(at_home)
    got = clusters.cluster_report(vectors(spark, [(i, "m", v, 1) for i, v in enumerate(x)]), dims={"m": 16}).collect()
    assert [(r["size"], r["typical_ids"], r["label"]) for r in got] == [(11, best(met), str(best(met)[0]))]
    names = spark.createDataFrame([(best(met)[0], " "), (best(met)[1], "second"), (best(met)[2], "third")], "note_id long, name string")
    assert clusters.cluster_report(vectors(spark, [(i, "m", v, 1) for i, v in enumerate(x)]), names=names, dims={"m": 16}).head()["label"] == "second"


# p4 -----------------------------------------------------------------------------------------------


def test_chi_square():
    assert math.isclose(P.chi2_cdf(P.chi2_quantile(0.99, 4), 4), 0.99, abs_tol=1e-9) and math.isclose(P.chi2_quantile(0.99, 4), 13.2767, abs_tol=1e-3)


@given(st.integers(0, 700), st.integers(1, 40))
@settings(max_examples=30, deadline=None)
def test_kd_leaves(n, leaf):
    p = np.random.default_rng(n).standard_normal((n, 3)).astype(np.float32)
    order, starts = P.kd_leaves(p, leaf)
    assert sorted(order) == list(range(n)) and starts[0] == 0 and starts[-1] == n and (np.diff(starts) <= leaf).all()


def brute_knn(x, k, least=-2.0):
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    return {(i, j): sim[i, j] for i in range(len(x)) for j in np.argsort(-sim[i], kind="stable")[:k] if sim[i, j] >= least}


@pytest.mark.parametrize("least", [None, 0.8])
def test_nearest_recall(spark, least):
    x = blobs(np.random.default_rng(3), 25, 40)
    df = vectors(spark, [(i, "m", v * 3, 1) for i, v in enumerate(x)] + [(0, "m", -x[0], 0), (5000, "m", [0.0] * 16, 1), (5001, "m", [float("inf")] * 16, 1), (None, "m", x[0], 1), (1, None, x[0], 1)])
    want = brute_knn(x.astype(np.float32).astype(float), 5, -2 if least is None else least)
    got = {(r["note_id"], r["neighbour_id"]): r["cosine"] for r in neighbours.nearest(df, 5, least, dims={"m": 16}, cell=60).collect()}
    assert len(got.keys() & want.keys()) >= 0.98 * len(want)
    assert all(math.isclose(got[p], want[p], abs_tol=1e-5) for p in got.keys() & want.keys())


def test_nearest_edges(spark):
    same = vectors(spark, [(i, "m", [1.0, 2.0], 1) for i in range(40)] + [(3, "m", [1.0, 2.0], 1), (50, "solo", [1.0, 0.0, 0.0], 1)])
    rows = neighbours.nearest(same, 3, 0.9).collect()
    assert Counter(r["note_id"] for r in rows) == {i: 3 for i in range(40)} and all(r["note_id"] != r["neighbour_id"] for r in rows)
    some = neighbours.nearest(same, 2, query=F.col("note_id") % 20 == 0).collect()
    assert Counter(r["note_id"] for r in some) == {0: 2, 20: 2}
    assert neighbours.nearest(same.limit(0), 3, 0.9).count() == 0
    assert neighbours.near_pairs(same, 5, 0.95).count() == neighbours.near_pairs(same, 5, 0.95).distinct().count()


def test_nearest_of_copies(spark):
    """A third of all rows are one vector: each copy has the k smallest ids, and the others come out as without the copies."""
    rng = np.random.default_rng(8)
    x = blobs(rng, 20, 15)
    rows = [(i, "m", v, 1) for i, v in enumerate(x)] + [(1000 + i, "m", x[7], 1) for i in range(150)] + [(1003, "m", x[7], 1), (2, "m", x[9], 0)]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows), 3, 0.8, cell=40).collect():
        got.setdefault(r["note_id"], []).append((r["place"], r["neighbour_id"], round(r["cosine"], 5)))
    assert sorted(got[1100]) == [(1, 7, 1.0), (2, 1000, 1.0), (3, 1001, 1.0)] and sorted(got[7]) == [(1, 1000, 1.0), (2, 1001, 1.0), (3, 1002, 1.0)]
    want = brute_knn(x.astype(np.float32).astype(float), 3, 0.8)
    far = [p for p in want if want[p] < 1 and p[0] < 30 and not (x[p[0]] @ x[7] >= 0.8)]
    assert far and all(any(n == p[1] for _, n, _ in got[p[0]]) for p in far)


def test_cells_of_real_vectors(spark):
    """Cut into many cells, the search finds what brute force finds, and a row goes to few cells at either size."""
    from cardloom.llm.vectors import MODEL_DIMS, latest, matrix, usable
    from tests.oracle import DATA

    share = {}
    for sf, cell in (("0.001", 15), ("0.01", 90)):
        df = spark.read.parquet(f"{DATA}/sf{sf}/embeddings2.parquet")
        rows = usable(df, MODEL_DIMS)
        spaces, _ = cells.fit(rows, rows, cell)
        sent = rows.mapInArrow(neighbours._send(spark.sparkContext.broadcast(spaces), math.sqrt(0.1), 0.99, False), neighbours._SENT)
        n = {r["side"]: r["count"] for r in sent.groupBy("side").count().collect()}
        share[sf] = (n[0] + n[1]) / n[0]
    assert max(len(s.pivots) for s in spaces) >= 20 and share["0.01"] <= 2 and share["0.01"] <= 1.25 * share["0.001"]
    got = {}
    for r in neighbours.nearest(df, 10, query=F.col("note_id") % 20 == 0, dims=MODEL_DIMS, cell=90).collect():
        got.setdefault((r["model"], r["note_id"]), set()).add(r["neighbour_id"])
    recall = []
    for model, part in rows.toPandas().groupby("model"):
        import pyarrow as pa

        x, ids, at = matrix(pa.array(part["vec"].tolist(), pa.list_(pa.float32()))), part["note_id"].to_numpy(), part["updated_at"].to_numpy()
        keep = latest(ids, at, x)
        x, ids = x[keep], ids[keep]
        for i in np.flatnonzero(ids % 20 == 0):
            sim = x @ x[i]
            sim[i] = -2
            recall.append(len(got[(model, ids[i])] & set(ids[np.argsort(-sim)[:10]].tolist())) / 10)
    assert len(recall) > 100 and np.mean(recall) >= 0.99


# p5 -----------------------------------------------------------------------------------------------


def test_words():
    assert nearcopies.words("<b>One</b>two {{c1::three::hint}} &amp;four [sound:five.mp3] Σιγμα a_b {{c2::{{c3::in}} out}}") == {"one", "two", "three", "four", "σιγμα", "a", "b", "in", "out"}


def brute_pairs(texts, percent, least):
    sets = [(i, nearcopies.words(t)) for i, t in texts if i is not None and t]
    return {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(sets, 2) if i != j and len(a) >= least and len(b) >= least and 100 * len(a & b) >= percent * len(a | b)}


@pytest.mark.parametrize("frequent, hot", [(0, 10**9), (3, 10**9), (10**9, 10**9), (3, 30)])
def test_near_copies(spark, frequent, hot):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(120)]
    texts, base = [], []
    for i in range(400):
        if base and rng.random() < 0.5:
            t = base[rng.integers(len(base))].split()
            for _ in range(rng.integers(0, 5)):
                t[rng.integers(len(t))] = vocab[rng.integers(120)]
            rng.shuffle(t)
        else:
            t = [vocab[int(120 * rng.random() ** 3)] for _ in range(rng.integers(10, 60))]
        base.append(" ".join(t))
        texts.append((int(rng.integers(0, 380)), base[-1]))
    texts += [(900, "x " * 30000), (901, None), (None, base[0]), (902, ""), (903, " ".join(vocab) * 40), *texts[:5]]
    df = spark.createDataFrame([(i, t, "key", "words") for i, t in texts], "note_id long, value_html string, key string, words string")
    got = {tuple(r) for r in nearcopies.near_copies(df, "note_id", "value_html", 70, 8, frequent=frequent, hot=hot).collect()}
    want = brute_pairs(texts, 70, 8)
    assert got == want and len(want) > 50


def test_many_copies(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(i, text) for i in range(200)] + [(500, text.replace("w3", "z"))], "note_id long, value_html string")
    got = {tuple(r) for r in nearcopies.near_copies(df, "note_id", "value_html", 70, 18, copies=50).collect()}
    assert got == {(0, i) for i in range(1, 200)} | {(0, 500)}
    rows = {r["id"]: (r["class_id"], r["n_ids"], r["n_links"]) for r in nearcopies.copy_classes(df, "note_id", "value_html", 70, 18).collect()}
    assert rows[7] == (0, 200, 1) and rows[500] == (500, 1, 1)
    assert nearcopies.near_copies(df.limit(0), "note_id", "value_html", 70, 18).count() == 0


# p6 -----------------------------------------------------------------------------------------------


def slow_bfd(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= s]
        i = min(fit, key=lambda i: (room[i], i), default=None)
        if i is None:
            room.append(capacity - s)
        else:
            room[i] -= s
    return sorted(room)


@given(st.integers(1, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
@settings(max_examples=150, deadline=None)
def test_best_fit(case):
    capacity, sizes = case
    counts = Counter(sizes)
    plan = packing.best_fit_decreasing(dict(counts), capacity)
    room = [capacity] * plan.boxes
    rows = sorted(zip(plan.size, plan.first, plan.box, plan.each))
    for k, (s, first, box, each) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == s else counts[s]
        for r in range(first, end):
            room[box + (r - first) // each] -= s
    assert all(r >= 0 for r in room) and sorted(room) == slow_bfd(sizes, capacity)


def test_packing(spark):
    texts = ["word " * n for n in (1, 3, 9, 30, 30, 30, 31, 64, 65, 200, 500)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (50, None, 7), (51, "", 7), (None, "x", 7)], "doc_id long, text string, tokens int")
    specs = spark.createDataFrame([(1, 64, "a"), (2, 128, "b"), (2, 200, "b"), (3, None, "c"), (None, 5, "d")], "spec_id int, capacity_tokens int, purpose string")
    rows = packing.placements(docs, specs).collect()
    for spec, cap in ((1, 64), (2, 128)):
        mine = [r for r in rows if r["spec_id"] == spec]
        fill = Counter()
        for r in mine:
            fill[r["container_id"]] += r["tokens"]
        sizes = [r["tokens"] for r in mine]
        assert max(fill.values()) <= cap and sorted(cap - v for v in fill.values()) == slow_bfd(sizes, cap)
        whole = Counter()
        for r in mine:
            whole[r["doc_id"]] += r["tokens"]
        want = Counter({i: tokens.count_tokens(t) for i, t in enumerate(texts)}) + Counter({3: tokens.count_tokens(texts[3])})
        assert whole == want
        assert all(r["piece"] == 0 or tokens.count_tokens(texts[r["doc_id"]]) > cap for r in mine)
    assert packing.placements(docs.limit(0), specs).count() == 0 and packing.placements(docs, specs.limit(0)).count() == 0
    assert packing.containers(packing.placements(docs, specs)).where("fill_tokens > capacity_tokens").count() == 0


def test_long_text_tokens():
    enc = tokens.encoding()
    t = ("the quick brown fox, " * 9000) + "x" * 300
    assert tokens.count_tokens(t) == len(enc.encode_ordinary(t))


# p7 -----------------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, "word " * (5 + i % 7), src) for src, n in (("Big", 900), ("b-i-g", 2), ("mid_one", 120), ("MID-ONE ", 30), ("tiny", 12)) for i in range(1000 * len(src), 1000 * len(src) + n)]
    rows += [(1, None, "big"), (2, "", "big"), (3, "x", None), (None, "x", "big"), (4, "x", "unknown")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid_one", 0.3, 2), ("m", "tiny", 0.2, 8), ("n", "big", 0.9, 1), ("n", "none", 0.1, 3)], "mix_id string, source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    got = {(r["mix_id"], r["source"]): r for r in shares.collect()}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 for r in got.values() if r["mix_id"] == "m")
    assert got["n", "none"]["actual_share"] == 0 and got["n", "big"]["actual_share"] == 1
    assert all(r["most_repeats"] <= r["max_repeats"] for r in got.values())
    assert all(abs(r["used_tokens"] - r["budget"]) <= 8 for r in got.values())
    used = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()
    assert {(r["mix_id"], r["source"]): r["t"] for r in used} == {k: v["used_tokens"] for k, v in got.items() if v["used_tokens"]}
    fixed = {r["source"]: r for r in mixing.mix(docs, targets.where("mix_id = 'm'"), total_tokens=400)[1].collect()}
    assert abs(sum(r["used_tokens"] for r in fixed.values()) - 400) < 20
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0 and mixing.mix(docs, targets.limit(0))[1].count() == 0


# p8 -----------------------------------------------------------------------------------------------

SAME = [
    ("phase, 5%", "ｐｈａｓｅ， ５％"), ("razón", "rаzόn"), ("é", "é"), ("fine flow", "ﬁne ﬂow"), ("the end", "th​e­ end"), ("a-b", "a‐b"), ("a-b", "a‑b"),
    ("A K Ω Å μ", "А K Ω Å µ"), ("тяхуд", "тяxуд"), ("systemic lattice", "ѕуѕtеmіс ӏаttісе"), ("going", "ɡοіnɡ"), ("a\nb", "a\r\nb"), ("xopa", "хора"), ("Ë", "Ё"), ("IV", "Ⅳ"),
]
DIFFERENT = [("resume", "résumé"), ("Phase", "phase"), ("m2", "m²"), ("1/2", "½"), ("strasse", "straße"), ("o", "ø"), ("a b", "a\nb"), ("a-b", "a–b"), ("l", "I"), ("O", "0"), ("Δ", "D"), ("в", "b"), ("a b", "ab")]


@pytest.mark.parametrize("a, b", SAME)
def test_reads_the_same(a, b):
    assert lookalikes.canonical(a) == lookalikes.canonical(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_reads_differently(a, b):
    assert lookalikes.canonical(a) != lookalikes.canonical(b)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_canonical_is_stable(t):
    once = lookalikes.canonical(t)
    assert lookalikes.canonical(once) == once


def test_same_reading(spark):
    rows = [(1, "Blood phase"), (2, "Вlооd phase"), (3, "Blood phase"), (4, "blood phase"), (5, None), (6, " ​"), (7, ""), (None, "Blood phase"), (8, "Ｂｌｏｏｄ phase" * 3000), (9, "Blood phase" * 3000), (2, "Вlооd phase")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, form int")
    assert {tuple(r) for r in lookalikes.same_reading(df).collect()} == {(1, 2), (2, 3), (8, 9)}
    assert {r["doc_id"]: (r["class_id"], r["n_spellings"]) for r in lookalikes.reading_classes(df).collect()}[3] == (1, 2)
    assert lookalikes.same_reading(df.limit(0)).count() == 0
    assert lookalikes.token_kind("lаtin") == "mixed" and lookalikes.token_kind("хора") == "whole" and lookalikes.token_kind("тяхуд") == "single"
    assert lookalikes.script_report(df).where("doc_id = 2").head()["mixed_tokens"] == 1


def test_scripts_of_all_alphabets(spark):
    looks = lookalikes.Looks(lookalikes.confusables(spark))
    assert len(looks.more) > 200
    for token in ("食べる", "カタカナと漢字", "한국어漢字", "ㄅ漢"):
        assert looks.kind(token) == "single" and looks.canonical(token) == token
    assert looks.kind("pаypal") == "mixed" and looks.kind("한a") == "mixed" and looks.kind("食한") == "single"
    for a, b in (("ⲥⲣ", "cp"), ("ꓔꓗꓐ", "TKB"), ("νυρ", "vup"), ("сορе", "cope"), ("αβγ", "αβγ")):
        assert looks.canonical(a) == looks.canonical(b)
    # letters of one alphabet stay apart
    assert looks.canonical("σ") != looks.canonical("ο") and looks.canonical("I") != looks.canonical("l")
    assert lookalikes.Looks().canonical("ⲥ") != "c"


class WithoutIcu:
    """A JVM that lacks the classes of ICU."""

    def __init__(self, jvm):
        self.jvm = jvm

    def __getattr__(self, name):
        return self.jvm.no.such if name == "com" else getattr(self.jvm, name)


@pytest.mark.parametrize("op", [lookalikes.same_reading, lookalikes.reading_classes, lookalikes.script_report, lookalikes.normalised])
def test_no_result_without_confusables(spark, monkeypatch, op):
    df = spark.createDataFrame([(1, "cp"), (2, "ⲥⲣ")], "doc_id long, text string")
    monkeypatch.setattr(spark, "_jvm", WithoutIcu(spark._jvm))
    with pytest.raises(RuntimeError, match="SpoofChecker"):
        op(df)


@pytest.mark.parametrize("answer", [lambda letters: letters, lambda letters: letters.replace("\n", "", 1), lambda letters: ""])
def test_no_confusables_from_a_wrong_answer(answer):
    checker = SimpleNamespace(getSkeleton=answer)
    icu = SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: SimpleNamespace(build=lambda: checker))))
    jvm = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=icu)))
    with pytest.raises(RuntimeError, match="SpoofChecker"):
        lookalikes.confusables(SimpleNamespace(_jvm=jvm))


def test_reading_pairs_stay_in_proportion_to_copies(spark):
    rows = [(i, "pay now", "a") for i in range(300)] + [(1000 + i, "pаy now", "a") for i in range(300)] + [(2000, "раy now", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = {tuple(r) for r in lookalikes.same_reading(df, copies=10).collect()}
    assert {(0, 1000), (0, 2000), (1000, 2000)} <= got and len(got) <= 3 + 600
    assert {x for p in got for x in p} == {*range(300), *range(1000, 1300), 2000}
    assert all((a < 1000) != (b < 1000) or b == 2000 or a == 2000 for a, b in got)
    assert len(lookalikes.same_reading(df).collect()) <= 3 + 600


@given(st.lists(st.sampled_from(["a", "é", "1", " ", "  ", "\n", "'s", "'", "!", "漢", "word"]), max_size=400))
@settings(max_examples=60, deadline=None)
def test_pieces_of_texts(parts):
    text = "".join(parts)
    enc = tokens.encoding()
    cut = list(tokens.pieces(text, 20))
    assert "".join(cut) == text and sum(len(enc.encode_ordinary(p)) for p in cut) == len(enc.encode_ordinary(text))


def test_tokens_of_a_text_without_spaces():
    text = "x" + "hello" * 30_000
    assert tokens.count_tokens(text) == len(tokens.encoding().encode_ordinary(text))
