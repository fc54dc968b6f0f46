"""Golden cases of the core functions and operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardloom.functions import scores as S
from cardloom.functions import text as T
from cardloom.operators import grouping as G
from cardloom.operators import hierarchy as Y
from cardloom.operators import hybrid as H
from cardloom.operators import index as I
from cardloom.operators import ingest as N
from cardloom.operators import jobs as J
from cardloom.operators import keyphrases as K
from cardloom.operators import notes as O
from cardloom.operators import ranking as R
from cardloom.operators import references as X
from cardloom.operators import similarity as V
from cardloom.operators import tags as A
from cardloom.operators import topicmaps as M
from cardloom.sources import models, snapshots
from cardloom.streaming import feeds


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*[F.col(n) for n in names]).alias("x")).head()["x"]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.plain, "a<br/>b &lt;i&gt;&nbsp;[sound:x.mp3] &amp;lt;", "a b <i> &lt;"), (T.plain, None, ""), (T.with_media, "<img src=x>[sound:y]", "\U0001f5bc️ \U0001f50a"),
        (T.is_visible, "<img src=x>", True), (T.is_visible, "<b> </b>", False), (T.is_visible, None, False), (T.ascii_lower, "ÉAb", "Éab"),
        (T.cost_text, "<script>x</script>a&NBSP;b[sound:c]", "a b[sound:c]"), (T.display_text, "a<b>b</b>{{c1::x}} &quot;c&quot;", 'ab "c"'),
        (T.index_tokens, "🖼️ 🔊 don't x_y ß Straße ñandú 4α² ½ Ⅳ c1::foo} ± über", ["🖼", "don", "t", "x", "y", "ß", "straße", "nandu", "4α²", "½", "ⅳ", "c1", "foo", "uber"]),
        (T.keyword_tokens, "Cheyne-Stokes a--b 4'n don't -x x- 5α-reductase Hückel's rule {{c1::acetyl-CoA}} a-'b a'-b rock'n'roll x9's", ["Cheyne-Stokes", "a", "b", "4", "n", "don't", "x", "x", "5α-reductase", "Hückel's", "rule", "c1", "acetyl-CoA", "a", "b", "a", "b", "rock'n'roll", "x9", "s"]),
        (T.trigrams, "ab cd", ["ab ", "b c", " cd"]), (T.trigrams, "ab", []), (T.answer_digit, "BEGIN_DIGITS <2> END_DIGITS 1", 2), (T.answer_digit, "maybe 3", 3), (T.answer_digit, "7", None),
        (T.first_int, "topic 4 of 12", 12), (T.first_int, "4 topics", 4), (T.first_int, "none", None), (T.list_items, "A, b;a\nC", ["A", "b", "C"]), (T.answer_text, '{"output":[{"content":[{"text":{"value":"v"}}]}]}', "v"),
        (T.preview, "<div>{{c1::x::h}} <b>y</b></div>", "<mark>x</mark> <b>y</b>"), (T.tag_leaf, "a::b::c", "c"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f, given) == want


def test_query_parts():
    assert T.query_parts('Foo "Bar baz"  x') == ["foo", "bar baz", "x"] and T.query_parts("") == []


@pytest.mark.parametrize("cos, bm25, matched, want", [(0.4, 0.0, 0, 0.26), (0.6, 0.0, 1, 0.6), (0.8, 0.0, 4, 0.8000002006449537), (0.55, -9.0, 3, 0.5187622605683404), (0.3, -25.0, 4, 0.6799197569245674), (0.0, -20.0, 2, 0.37451630114972995)])
def test_hybrid_score(spark, cos, bm25, matched, want):
    row = spark.createDataFrame([(cos, bm25, matched)], "c double, b double, m int").select(S.hybrid_score(F.col("c"), F.col("b"), F.col("m")).alias("s")).head()
    assert math.isclose(row["s"], want, abs_tol=1e-9)


DOCS = ["Hückel's rule pi electrons", "acetyl-CoA beta-oxidation fatty acids", "the rule of nines rule", "É_x 🖼️ 5α-reductase Finasteride treats alopecia", "apnea and hyperpnea", "rule electrons a b c d e", "zzz one two", "qqq qqq rule", "mmm nnn", "ooo ppp rrr"]


def test_bm25(spark):
    index = spark.createDataFrame(list(enumerate(DOCS)), "note_id long, t string").select("note_id", T.index_tokens(F.col("t")).alias("tokens"))
    terms = R.query_terms(spark, {0: ["rule", "electrons"], 1: ["Hückel's rule"], 2: ["HUCKEL"], 3: ["beta-oxidation"], 4: ["rule", "rule"], 5: ["-"]})
    got = {(r["query_id"], r["note_id"]): r["bm25"] for r in R.bm25(I.of_documents(index), terms).collect()}
    want = {(0, 0): -1.52230455036711, (0, 5): -1.2967779503127232, (0, 2): -0.4902997068337565, (0, 7): -0.4257865875135254, (1, 0): -1.7655733561288383, (2, 0): -1.7655733561288383, (3, 1): -1.6243274876385312, (4, 2): -0.980599413667513, (4, 7): -0.8515731750270508, (4, 0): -0.7034734924136506, (4, 5): -0.599255197241258}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert I.phrase_frequency(index, ["rule", "electrons"]).head()[0] == 1
    many = {(r["query_id"], r["note_id"]): (r["bm25"], r["place"]) for r in R.bm25_top_of_many(I.of_documents(index), terms, 2).collect()}
    assert all(math.isclose(many[k][0], want[k], abs_tol=1e-12) for k in many) and many.keys() == want.keys() - {(0, 2), (0, 7), (4, 0), (4, 5)} and many[0, 0][1] == 1


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "note_id long, t string").select("note_id", T.index_tokens(F.col("t")).alias("tokens"))
    index = I.stored(docs, f"file://{tmp_path}/index")
    terms = R.query_terms(spark, {0: ["rule", "electrons"], 1: ["pi electrons"], 2: ["rule of nines"], 3: ["nines rule of"]})
    rows = lambda i: {(r["query_id"], r["note_id"], round(r["bm25"], 12)) for r in R.bm25(i, terms).collect()}
    assert rows(index) == rows(I.of_documents(docs)) and {q for q, _, _ in rows(index)} == {0, 1, 2}
    plan = index.of_words(["rule"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.partition("PartitionFilters: [")[2].partition("]")[0] and "EqualTo(term,rule)" in plan
    assert index.of_words([]).count() == 0


def test_rrf(spark):
    lists = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 2, 1), (0, 1, 3, 2)], "query_id int, list_idx int, note_id long, rank int")
    plain = {r["note_id"]: r["rrf"] for r in R.rrf(lists).collect()}
    assert plain == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})
    weighted = {r["note_id"]: r["rrf"] for r in R.rrf(lists, weight=F.when(F.col("list_idx") == 0, 2.0).otherwise(-1.0)).collect()}
    assert weighted == pytest.approx({1: 2 / 61, 2: 2 / 62, 3: 0})


def test_tags(spark):
    rows = [(i, "a::b") for i in range(2)] + [(9, "a::c"), (8, "a")] + [(i, "d") for i in range(20, 25)] + [(None, "z"), (3, None), (0, "a::b")]
    df = spark.createDataFrame(rows, "note_id long, tag string")
    assert {r[0]: r[1] for r in A.child_tags(df).collect()} == {"a": 4, "d": 5}
    assert {r[0]: r[1] for r in A.child_tags(df, "a").collect()} == {"a::b": 2, "a::c": 1}
    assert {r["path"]: r["n"] for r in A.tag_tree(df).collect()} == {"a": 4, "a::b": 2, "a::c": 1, "d": 5}
    like = spark.createDataFrame([(1, "Foo::X"), (2, "axb::y"), (3, "foo")], "note_id long, tag string")
    notes = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 7)], "note_id long")
    fields = spark.createDataFrame([(1, "f", "x", 1), (9, "f", "y", 1)], "note_id long, field_name string, value_html string, ord int")
    under = lambda tag, *page: [tuple(r) for r in A.notes_under(notes, fields, like.unionByName(like.where("note_id = 3").withColumn("note_id", F.lit(99).cast("long"))), tag, *page).collect()]
    assert sorted(under("foo")) == [(1, "x"), (3, None)] and under("a_b") == [(2, None)] and under("foo", 1, 1) == [(1, "x")]
    assert [r[0] for r in A.notes_with_tag(notes, fields, like, "foo").collect()] == [3]
    deep = spark.createDataFrame([(1, "a"), (2, "a::b"), (3, "a::b::c"), (4, "a::b::c"), (5, "a::x::y")], "note_id long, tag string")
    assert {r[0]: r[1] for r in A.additive_counts(deep).collect()} == {"a": 5, "a::b": 3, "a::b::c": 2, "a::x::y": 1}


def test_fields(spark):
    df = spark.createDataFrame([(1, "f", "x", 1), (1, "g", "y", None), (2, "f", "only", None), (None, "f", "n", 0), (3, "f", None, 0)], "note_id long, field_name string, value_html string, ord int")
    assert {r[0]: r[1] for r in O.front(df).collect()} == {1: "y", 2: "only", 3: None}
    assert {r[0]: r[1] for r in O.back(df).collect()} == {1: "x", 2: "only", 3: None}
    notes = spark.createDataFrame([(1,), (3,), (4,), (4,), (None,)], "note_id long")
    assert O.exact_search(notes, df, "ONLY").count() == 0 and [tuple(r) for r in O.exact_search(notes, df, "X").collect()] == [(1, "y")]
    assert [tuple(r) for r in O.exact_search(notes, df, " ", 2).collect()] == [(4, None), (3, None)]
    assert sorted(tuple(r) for r in O.visible_only(notes.where("note_id < 4"), df).collect()) == [(1, "y")]


def test_min_max(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0), (4, None)], "note_id long, rerank double")
    assert sorted(r[0] for r in H.rerank_filter(df, 0.5).collect()) == [2, 3]
    same = spark.createDataFrame([(1, 3.0), (2, 3.0)], "note_id long, rerank double")
    assert H.rerank_filter(same, 0.9).count() == 2


KEYWORD_CASES = [
    ("Markovnikov's rule predicts where halides end up once sigma electrons have gone.", {"Markovnikov's rule", "sigma electrons"}),
    ("Losartan relieves diabetic nephropathy; it is metabolised by 11β-hydroxylase.", {"Losartan", "diabetic nephropathy", "11β-hydroxylase"}),
    ("Patients with partial insulin insensitivity syndrome may show hepatic steatosis", {"insulin insensitivity syndrome", "hepatic steatosis"}),
    ("Common complaints with opioids include emesis, pruritus and constipation", {"emesis", "pruritus", "constipation"}),
    ("Henoch-Schonlein purpura swings between hematuria and proteinuria", {"Henoch-Schonlein", "hematuria", "proteinuria"}),
    ("Of these only clozapine and olanzapine are approved for resistant psychosis", {"clozapine", "olanzapine"}),
    ("Which adrenergic agonists help in Raynaud disease? Corticosteroids and SSRIs", {"Raynaud disease", "adrenergic agonists", "Corticosteroids", "SSRI"}),
    ("A COX inhibitor", {"COX inhibitor"}),
]


@pytest.mark.parametrize("text, want", KEYWORD_CASES)
def test_keywords(text, want):
    assert want <= set(K.keywords(text, 10))


def test_keywords_edges():
    assert K.keywords("") == [] and K.keywords("the of and") == [] and K.keyphrases("") == [] and len(K.keywords("osmotic laxatives " * 5000)) <= 8
    assert K.keyphrases("Beta decay. Beta decay emits electrons.")[0][1] > 0


def test_hierarchy(spark):
    rows = [("r", 1, None), ("r", 2, 1), ("r", 3, 2), ("r", 3, 2), ("r", 4, 4), ("r", 5, 6), ("r", 6, 5), ("r", 7, 5), ("r", 8, 99), ("s", 2, 1), (None, 1, None), ("r", None, 1)] + [("deep", i, i - 1) for i in range(150)] + [("wide", i, 0) for i in range(500)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "run_id string, topic_id int, parent_id int, level int, depth string")
    for hop in (16, 2):
        if hop == 2:
            df = df.where("run_id <> 'deep' or topic_id < 12")
        got = {(r[0], r[1]): r[2] for r in Y.node_paths(Y.hierarchy(df, hop)).collect()}
        assert got["r", 1] == "1" and got["r", 3] == "1/2/3" and got["r", 8] == "8" and got["s", 2] == "2"
        assert got["r", 4] == got["r", 5] == got["r", 6] == "cycle" and got["r", 7] == "below_cycle"
        deep = max(t for r, t in got if r == "deep")
        assert got["deep", deep] == "/".join(map(str, range(deep + 1))) and got["wide", 0] == "cycle" and got["wide", 499] == "below_cycle"
        assert len(got) == 8 + 1 + deep + 1 + 500
    assert Y.hierarchy(df.limit(0)).count() == 0
    pairs = {tuple(r) for r in Y.descendants(Y.hierarchy(df)).where("run_id = 'r'").collect()}
    assert pairs == {("r", 1, 2, 1), ("r", 2, 3, 1), ("r", 1, 3, 2)}


def test_references(spark):
    notes = spark.createDataFrame([(1, 100), (1, 90), (2, None), (None, 5)], "note_id long, fetched_at long")
    gone = spark.createDataFrame([(3,), (1,), (None,)], "note_id long")
    refs = spark.createDataFrame([(1, 89, "x"), (1, 95, "x"), (2, 1, "x"), (3, 5, "x"), (4, None, "x"), (4, 7, "x"), (None, 1, "x")], "note_id long, updated_at long, kind string")
    got = {tuple(r) for r in X.orphan_references({"t": (refs, "updated_at"), "u": (refs, None)}, notes, gone).collect()}
    assert got == {("t", 1, "late", 2), ("t", 3, "deleted", 1), ("t", 4, "missing", 2), ("u", 3, "deleted", 1), ("u", 4, "missing", 2)}
    assert X.orphan_references({"t": (refs.limit(0), None)}, notes, gone).count() == 0
    assert {r["kind"] for r in X.orphan_references({"t": (refs, None)}, notes.limit(0), gone.limit(0)).collect()} == {"missing"}
    hot = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("note_id"))
    assert X.orphan_references({"t": (hot, None)}, notes, gone).where("note_id = 7").head()["n_rows"] == 6668


def test_sync(spark):
    cols = "note_id long, mod long, content_hash string, synced_at long"
    old = spark.createDataFrame([(1, 1, "a", 0), (2, 1, "a", 0), (3, 1, "a", 0), (4, 1, "a", 0)], cols)
    new = spark.createDataFrame([(1, 1, "z", 9), (2, 2, "b", 9), (3, 2, "a", 9), (5, 1, "c", 9)], cols)
    act = N.snapshot_diff(old, new)
    assert {r[0]: r[1] for r in act.collect()} == {1: "touch", 2: "update", 3: "touch_mod", 4: "delete", 5: "insert"}
    assert tuple(N.counters(act).head()) == (1, 1, 2, 1)
    assert {tuple(r) for r in N.applied(old, new).select("note_id", "mod", "content_hash", "synced_at").collect()} == {(1, 1, "a", 9), (2, 2, "b", 9), (3, 2, "a", 9), (5, 1, "c", 9)}
    assert N.snapshot_diff(old, new.limit(0)).where("action = 'delete'").count() == 0


def test_progress(spark):
    notes = spark.createDataFrame([(i,) for i in range(10)], "note_id long")
    jobs = spark.createDataFrame([("pending",), ("done",)], "status string")
    row = J.progress(notes, notes.where("note_id < 4"), jobs, 4.0).head()
    assert (row["remaining"], row["eta"], row["errors"]) == (6, 2, 0)
    assert J.worker_plan("local", 99) == (4, 16)


def test_groups(spark):
    groups = spark.createDataFrame([("B", 2), ("B", 9), ("B", 2)], "label string, note_id long")
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "note_id long")
    assert [(r["label"], r["ids"]) for r in G.group_list(G.clean_groups(groups, wanted)).orderBy("place").collect()] == [("B", "2"), ("Other", "1,3")]


def test_greedy(spark):
    s = 1 / math.sqrt(2)
    rows = [(0, 0, "x", [1.0, 0.0]), (0, 1, "y", [0.9, 0.3]), (0, 2, "z", [s, s])]
    df = spark.createDataFrame(rows, "list_id long, place int, term string, vec array<float>")
    assert {r["term"]: r["head"] for r in V.greedy_clusters(df, 0.85).collect()} == {"x": "x", "y": "x", "z": "z"}


def test_semantic_batch(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    x = np.random.default_rng(0).standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "note_id long, vec array<float>")
    u = x / np.sqrt((x**2).sum(1))[:, None]
    got = {(r["query_id"], r["place"]): r["note_id"] for r in V.semantic_batch(df, df.where("note_id < 7").select(F.col("note_id").alias("query_id"), F.col("vec").alias("qvec")), 4).collect()}
    for q in range(7):
        assert [got[q, p] for p in range(1, 5)] == list(np.argsort(-(u @ u[q]))[:4])
    assert V.semantic_batch(df, df.limit(0).select(F.col("note_id").alias("query_id"), F.col("vec").alias("qvec")), 4).count() == 0


def test_topic_tree():
    leaves = pd.DataFrame({"topic_id": [0, 1], "size": [3, 2], "label": ["a", "b"]})
    merges = pd.DataFrame({"parent": [2], "name": ["ab"], "left": [0], "right": [1], "distance": [0.5]})
    tree = M.tree_from_merges(leaves, merges).set_index("topic_id")
    assert tree.loc[2, "size"] == 5 and tree.loc[2, "level"] == 0 and tree.loc[0, "level"] == tree.loc[1, "level"] == 1
    assert len(M.tree_from_merges(leaves, merges, 0.1)) == 2
    assert len(M.ward_merges(np.eye(5), np.ones(5), 5)) == 4


def test_schedule():
    assert M.schedule(400)["min_cluster_size"] == 5 and M.schedule(40_000)["min_topic_size"] == 14 and M.schedule(100)["n_neighbors"] == 15
    assert M.merged_params({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_models(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, None)], "note_id long, text string")
    got = {r["note_id"]: r for r in models.embedded(rows, "text", models.HashingEmbedder, batch=1).collect()}
    assert math.isclose(got[1]["norm"], 1, abs_tol=1e-6) and got[2]["norm"] == 0
    assert {r[0]: r[1] for r in models.reranked(rows, "text", "red hen", models.OverlapReranker).collect()} == {1: 0.5, 2: 0.0}
    cache = models.QueryCache(models.HashingEmbedder(), seconds=10)
    assert cache("a", now=0) is cache("a", now=5) and cache("a", now=0) is not cache("a", now=50)


def test_sources(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"noteId": 5, "modelName": "Basic", "mod": 3, "fields": {"Front": {"value": "x", "order": 0}}, "tags": ["a", "a"]}\n')
    notes, fields, tags = snapshots.snapshot_tables(snapshots.read_snapshot(spark, str(tmp_path / "n.json")), 9)
    assert notes.head()["note_id"] == 5 and fields.head()["value_html"] == "x" and tags.count() == 1
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    for keep in (runs, runs.where("run_id = 'r1'")):
        snapshots.write_topic_map(keep, keep, keep, keep, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map" / "topics")).count() == 2


def test_progress_events():
    assert feeds.merged_progress([{"total": 10, "completed": 4}, {"completed": 5, "note": None}])["percent"] == 50.0


def test_core_needs_no_llm():
    import ast
    from pathlib import Path

    for p in Path(__file__).resolve().parent.parent.joinpath("cardloom").rglob("*.py"):
        if "llm" not in p.parts:
            for n in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
                assert not any("cardloom.llm" in x for x in names), p


def test_map_leaves_follow_the_schedule():
    assert M.schedule(130_000)["min_topic_size"] == 14


def test_ward_of_many_leaves():
    """The same tree as the plain search for the nearest pair, and in little memory for thousands of leaves."""
    rng = np.random.default_rng(5)
    x, n = rng.standard_normal((40, 6)), rng.integers(1, 50, 40)
    live, want = {i: (x[i], float(n[i])) for i in range(40)}, []
    while len(live) > 1:
        cost = {(a, b): ((live[a][0] - live[b][0]) ** 2).sum() * live[a][1] * live[b][1] / (live[a][1] + live[b][1]) for a in live for b in live if a < b}
        a, b = min(cost, key=cost.get)
        (xa, na), (xb, nb) = live.pop(a), live.pop(b)
        want.append((40 + len(want), a, b, np.sqrt(2 * cost[a, b])))
        live[want[-1][0]] = ((xa * na + xb * nb) / (na + nb), na + nb)
    got = M.ward_merges(x, n, 40)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert len(M.ward_merges(rng.standard_normal((2400, 48)), np.ones(2400), 2400)) == 2399
