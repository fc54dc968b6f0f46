"""Operators that no registered query reaches, on small inputs."""

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom import schemas, shared
from cardloom.functions import text as T
from cardloom.operators import grouping as G
from cardloom.operators import hybrid as H
from cardloom.operators import ingest as N
from cardloom.operators import notes as O
from cardloom.operators import ranking as R
from cardloom.operators import similarity as V
from cardloom.operators import tags as A
from cardloom.operators import topicmaps as M
from cardloom.sources import models, snapshots
from cardloom.streaming import feeds


def test_exclude(spark):
    terms = R.query_terms(spark, {0: ["Reef", "sinus"]})
    assert [r["term"] for r in R.without_terms(terms, ["REEF"]).collect()] == ["sinus"] and R.without_terms(terms, []).count() == 2
    assert R.query_terms(spark, {}).count() == 0


def test_formats(spark):
    row = spark.range(1).select(T.percent(F.lit(1), F.lit(8)).alias("p"), T.percent(F.lit(0), F.lit(0)).alias("z"), T.duration(F.lit(3725)).alias("a"), T.duration(F.lit(65)).alias("b"), T.duration(F.lit(5)).alias("c"), T.duration(F.lit(None).cast("long")).alias("n"), T.token_estimate(F.lit(9)).alias("t"), T.token_floor(F.lit(2)).alias("f"), T.model_hash(F.lit("m"), F.lit("q8"), F.lit("x")).alias("h"), T.cache_key(F.lit("m"), F.lit(64), F.lit("a b")).alias("k")).head()
    assert tuple(row)[:8] == ("13%", "0%", "1h 2m", "1m 5s", "5s", "-", 3, 1) and row["h"].startswith("gemma|m|q8|") and row["k"] == "m%7C64%7Ca+b"


def test_scope_hash():
    import hashlib

    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert M.scope_hash({"type": "note-set", "noteIds": [3, 1, 3]}) == sha('{"type":"note-set","noteIds":[1,3]}')
    assert M.scope_hash({"type": "query", "query": "x"}) == sha('{"type":"query","query":"x","limit":null}')
    assert M.scope_hash({"type": "global"}) == sha('{"type":"global","profile":null}')


def test_cached_terms(spark):
    cache = spark.createDataFrame([("red", [1.0] * 4, 1), ("red", [2.0] * 4, 2), ("old", [1.0] * 3, 1)], "term string, vec array<float>, updated_at long")
    terms = spark.createDataFrame([("Red",), ("old",), ("new",), (None,)], "term string")
    got = {r["term"]: r["vec"] for r in models.cached_terms(terms, cache, lambda: models.HashingEmbedder(4), 4).collect()}
    assert got["red"] == [2.0] * 4 and got.keys() == {"red", "old", "new"} and len(got["old"]) == 4


def test_precomputed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "emb", 2, 0.5, 0), (1, "emb", 3, 0.9, 0), (1, "bm", 4, 9.0, 0), (2, "emb", 5, 0.1, 0)], "source_note_id long, type string, target_note_id long, score double, created_at long")
    fronts = spark.createDataFrame([(3, "three")], "note_id long, front string")
    snapshots.write_related(rows, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert {tuple(r) for r in V.precomputed(back, "emb", 1, fronts, 5).collect()} == {(3, 0.9, "three"), (2, 0.5, None)}
    many = spark.range(300).select(F.col("id").alias("source_note_id"), F.lit("emb").alias("type"), F.lit(8).cast("long").alias("target_note_id"), F.lit(0.1).alias("score"), F.lit(1).cast("long").alias("created_at")).where("id <> 1")
    snapshots.write_related(many, str(tmp_path / "r"))
    snapshots.write_related(rows.where("source_note_id = 2").withColumn("score", F.lit(0.7)), str(tmp_path / "r"))
    again = spark.read.parquet(str(tmp_path / "r"))
    assert again.count() == 299 + 3 and again.where("source_note_id = 2").head()["score"] == 0.7


def test_pages_and_unsuspended(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"page_num": 1, "items": ["a ", " b", ""]}\n')
    assert snapshots.read_pages(spark, str(tmp_path / "p.json")).head()["text"] == "a b"
    before = spark.createDataFrame([(1, True), (2, True), (3, False)], "note_id long, suspended boolean")
    after = spark.createDataFrame([(1, False), (2, True), (3, False)], "note_id long, suspended boolean")
    assert snapshots.unsuspended(before, after).head()["n"] == 1


class _Service(BaseHTTPRequestHandler):
    def do_POST(self):
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if ask["action"] == "findNotes":
            result = list(range(7))
        else:
            result = [{"noteId": i, "modelName": "Basic", "mod": 1, "fields": {"Front": {"value": f"v{i}", "order": 0}}, "tags": ["t"]} for i in ask["params"]["notes"]]
        body = json.dumps({"result": result, "error": None}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_note_service(spark):
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(snapshots.NoteService)
        df = spark.read.format("notes").option("url", f"http://127.0.0.1:{server.server_port}").option("slice", "3").load()
        rows = df.collect()
        assert len(rows) == 7 and rows[0]["fields"]["Front"]["value"].startswith("v")
    finally:
        server.shutdown()


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in N.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in N.insert_or_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_parse_groups(spark):
    text = json.dumps({"output_text": json.dumps({"groups": [{"label": "A", "notes": [1, 2]}, {"label": "B", "notes": []}]})})
    rows = spark.createDataFrame([(text,), ("junk",)], "answer string")
    assert {tuple(r) for r in G.parse_groups(rows).collect()} == {("A", 1), ("A", 2)}


def test_lists(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.8)], "note_id long, score double")
    assert [r["note_id"] for r in H.panel(rows, 1).collect()] == [3]
    tags = spark.createDataFrame([(1, "a::b"), (2, "c")], "note_id long, tag string")
    assert O.shared_tags(tags, "a").count() == 1 and A.notes_under(tags, tags.select("note_id", F.lit("f").alias("field_name"), F.lit("v").alias("value_html"), F.lit(1).alias("ord")), tags, "a").count() == 1


def test_topic_build(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in np.eye(4)[i % 4] + 0.05 * rng.standard_normal(4)], [f"w{i % 4}", "all"]) for i in range(80)]
    docs = spark.createDataFrame(rows, "note_id long, vec array<float>, tokens array<string>")
    topics, members = M.build(docs, k=4)
    t = {r["topic_id"]: r for r in topics.collect()}
    roots = [r for r in t.values() if r["parent_id"] is None]
    assert len(roots) == 1 and roots[0]["size"] == 80 and len(t) == 7
    assert members.count() == 80 and members.agg(F.min("cos")).head()[0] > 0.8
    assert M.build(docs.limit(1))[0].head()["label"] == "All Notes" and M.build(docs.limit(0))[0].count() == 0


def test_unique_terms(spark):
    rows = spark.createDataFrame([("r", 0, "Reef", 0.9, 1), ("r", 0, "reef", 0.8, 2), ("r", 0, " ", 0.7, 3), ("r", 0, "sinus", 0.6, 4)], "run_id string, topic_id int, term string, score double, rank int")
    assert [(r["term"], r["rank"]) for r in M.unique_terms(rows).orderBy("rank").collect()] == [("Reef", 1), ("sinus", 2)]


def test_settings():
    s = models.Settings(a="1", b="2.5", c="x")
    assert s.flag("a") and not s.flag("z") and s.number("b", 0) == 2.5 and s.number("c", 7) == 7


def test_pair_cosines(spark):
    rows = spark.createDataFrame([(0, "x", [1.0, 0.0]), (0, "y", [1.0, 0.1]), (0, "z", [0.0, 1.0])], "list_id long, term string, vec array<float>")
    got = V.pair_cosines(rows, "list_id", 0.9).collect()
    assert [(r["a"], r["b"]) for r in got] == [("x", "y")] and math.isclose(got[0]["cos"], 1 / math.sqrt(1.01), rel_tol=1e-6)


def test_term_cosines(spark):
    terms = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", None)], "term string, vec array<float>")
    q = spark.createDataFrame([([2.0, 0.0],)], "qvec array<float>")
    assert {r["term"]: r["cos"] for r in V.term_cosines(terms, q).collect()} == {"a": 1.0, "b": -1.0, "c": -1.0}


def test_schemas_and_cut(spark):
    assert schemas.NOTES["profile"].nullable and not schemas.NOTES["note_id"].nullable
    df = spark.range(10)
    assert shared.cut(df).count() == 10 and shared.shared_folder(spark) == shared.shared_folder(spark)


def test_sync_is_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 9), (2, 1, "c", 5)], "note_id long, mod long, content_hash string, synced_at long")
    run = feeds.sync_sink(spark, str(tmp_path))
    for number in (0, 1, 1):
        run(rows if number else rows.where("note_id = 1"), number)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/v=1").select("note_id", "content_hash").collect()} == {(1, "b"), (2, "c")}


@pytest.mark.parametrize("n, dim", [(0, 2), (3, 2)])
def test_vector_sizes(spark, n, dim):
    df = spark.createDataFrame([(i, "m", [1.0] * dim) for i in range(n)], "note_id long, model string, vec array<float>")
    q = spark.createDataFrame([(0, "m", [1.0, 2.0, 3.0])], "query_id int, model string, qvec array<float>")
    assert V.cosine_scan(df, q).count() == 0


def _brute(vectors, k):
    """(model, note_id) -> the k nearest other notes, by numpy."""
    out = {}
    for (model, n), part in vectors.withColumn("n", F.size("vec")).toPandas().groupby(["model", "n"]):
        x, ids = np.array(part["vec"].tolist(), float), part["note_id"].to_numpy()
        x /= np.sqrt((x**2).sum(1))[:, None]
        for i in np.flatnonzero(ids % 20 == 0):
            cos = x @ x[i]
            cos[i] = -2
            out[model, n, ids[i]] = ids[np.argsort(-cos, kind="stable")[:k]].tolist()
    return out


def test_approximate_search_recall(spark):
    """Queries are all notes whose id is divisible by 20, every vector of every model is indexed; hot buckets are cut."""
    v = V.current_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings2.parquet"))
    want, share = _brute(v, 10), []
    for model, dim in (("quill-embed-8b", 64), ("tern-embed-2", 64), ("finch-300m", 48)):
        got = {}
        for r in V.lsh_search(v, model, dim, F.col("note_id") % 20 == 0, 10).collect():
            got.setdefault(r["note_id"], set()).add(r["neighbour_id"])
        share += [len(got.get(i, set()) & set(ids)) / 10 for (m, n, i), ids in want.items() if m == model and n == dim]
    assert len(share) > 100 and np.mean(share) >= 0.9


def test_semantic_batch_is_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "STEP", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 20)
    v = V.current_vectors(spark.read.parquet("/root/testdata/sf0.001/embeddings2.parquet")).where("size(vec) = 64 and model = 'quill-embed-8b'")
    asks = v.where("note_id % 3 = 0").select(F.col("note_id").alias("query_id"), F.col("vec").alias("qvec"))
    got = {(r["query_id"], r["place"]): (r["note_id"], r["cos"]) for r in V.semantic_batch(v, asks, 5).collect()}
    p = v.toPandas()
    x, ids = np.array(p["vec"].tolist(), float), p["note_id"].to_numpy()
    x /= np.sqrt((x**2).sum(1))[:, None]
    for i in np.flatnonzero(ids % 3 == 0):
        cos = (x @ x[i]).round(12)
        order = np.lexsort((ids, -cos))[:5]
        assert [got[ids[i], j + 1][0] for j in range(5)] == ids[order].tolist()


def test_hybrid_of_a_note(spark):
    """A note as the query: its front's words, its stored vector among notes with one of them, no vectors for candidates by words."""
    from cardloom.operators import index as I
    from cardloom.operators import search as Q

    texts = {1: "ganglion axon reef steatosis", 2: "ganglion sinus", 3: "reef reef reef", 4: "nothing here at all", 5: "<img src=x>"}
    notes = spark.createDataFrame([(i,) for i in texts], "note_id long")
    fields = spark.createDataFrame([(i, "f", t, 0) for i, t in texts.items()], "note_id long, field_name string, value_html string, ord int")
    vectors = spark.createDataFrame([(1, "b", "m", [1.0, 0.0]), (2, "b", "m", [1.0, 1.0]), (4, "b", "m", [1.0, 0.1])], "note_id long, backend string, model string, vec array<float>")
    index = I.of_documents(I.documents_index(notes, fields))
    rows = {r["note_id"]: r for r in Q.hybrid_of_note(spark, index, vectors, fields, 1, "m", 40).collect()}
    assert rows.keys() == {1, 2, 3} and rows[1]["cos"] is None and abs(rows[2]["cos"] - 0.5**0.5) < 1e-6 and rows[3]["cos"] is None and rows[1]["matched"] >= 1
    by_text = {r["note_id"]: r for r in Q.hybrid_search(spark, index, vectors, fields, texts[1], "m", lambda t: [[1.0, 0.0]], 40).collect()}
    assert by_text.keys() == {1, 2, 3, 4} and abs(by_text[1]["cos"] - 1) < 1e-9 and by_text[2]["bm25"] == rows[2]["bm25"]
    assert Q.hybrid_search(spark, index, vectors, fields, " ", "m", lambda t: [], 40).count() == 0 and Q.hybrid_of_note(spark, index, vectors, fields, 77, "m", 40).count() == 0
    near = Q.semantic_search(spark, vectors, fields, "x", {"m": lambda t: [[0.0, 1.0]]}, 2).collect()
    assert [r["note_id"] for r in near] == [2, 4] or {r["note_id"] for r in near} == {2, 4}
