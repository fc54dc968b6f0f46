"""Hierarchical topic maps: parameters, terms, centroids, tree assembly, reading and upkeep."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import scores as S
from cardloom.functions import text as T
from cardloom.operators.similarity import mean_vector
from cardloom.shared import cut


def schedule(n: int) -> dict[str, float | int]:
    """Parameters for a corpus of n notes."""
    # Least cluster size from so many notes on.
    steps = ((40_000, 18), (20_000, 16), (10_000, 12), (5_000, 9), (1_500, 7), (0, 5))
    half_up = lambda x: math.floor(x + 0.5)
    size = next(c for least, c in steps if n >= least)
    tier = (10, 20_000) if n > 20_000 else (5, 15_000) if n > 10_000 else (1, 8_000)
    return {"min_cluster_size": size, "min_samples": max(3, size // 3), "min_topic_size": max(4, half_up(0.8 * size)), "n_neighbors": min(45, max(8, half_up(math.sqrt(min(n, 2500))) + 5)), "n_components": 15, "min_dist": 0.015 if n > 10_000 else 0.035, "min_df": tier[0], "max_features": tier[1], "top_terms": 12, "seed": 42}


def merged_params(base: dict, extra: dict) -> dict:
    """base with extra put in, dictionaries merged at every depth."""
    out = dict(base)
    for k, v in extra.items():
        out[k] = merged_params(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def topic_rows(topics: DataFrame) -> DataFrame:
    """One row per (run_id, topic_id): of repeated keys that of the greatest size, then of the first label."""
    w = Window.partitionBy("run_id", "topic_id").orderBy(F.desc_nulls_last("size"), F.asc_nulls_last("label"), F.asc_nulls_last("parent_id"), F.asc_nulls_last("level"))
    return topics.where("run_id is not null and topic_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ngrams(tokens: str, longest: int) -> Column:
    """All runs of one to `longest` tokens, joined by blanks."""
    one = F.col(tokens)
    runs = [F.transform(F.sequence(F.lit(1), F.size(one) - n + 1), lambda i, n=n: F.array_join(F.slice(one, i, n), " ")) for n in range(2, longest + 1)]
    return F.concat(one, *[F.when(F.size(one) >= n, r).otherwise(F.array().cast("array<string>")) for n, r in enumerate(runs, 2)])


def class_scores(docs: DataFrame, longest: int = 1, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(class, term, score): c-TF-IDF of the terms of classes from rows (class, tokens).

    Terms are runs of up to `longest` tokens that at least min_df rows have, of these the max_features most frequent.
    score = share of the term in its class times ln(1 + mean words per class / occurrences of the term).
    """
    words = docs.select("class", F.explode(ngrams("tokens", longest)).alias("term"))
    if min_df > 1 or max_features:
        rows = docs.select(F.explode(F.array_distinct(ngrams("tokens", longest))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
        if max_features:
            rows = rows.orderBy(F.desc("df"), "term").limit(max_features)
        words = words.join(rows.select("term"), "term", "left_semi")
    tf = words.groupBy("class", "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy("class").agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("total"))
    rows = tf.join(size, "class").join(total, "term").join(F.broadcast(mean))  # one row
    return rows.select("class", "term", (F.col("tf") / F.col("size") * F.ln(1 + F.col("mean") / F.col("total"))).alias("score"))


def class_terms(docs: DataFrame, k: int = 12, **options) -> DataFrame:
    """(class, term, score, rank): the k best terms of each class, see class_scores()."""
    return best_terms(class_scores(docs, **options), k)


def best_terms(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= k)


def diverse_terms(terms: DataFrame, vectors: DataFrame, diversity: float = 0.3, k: int = 12) -> DataFrame:
    """(class, term, rank): terms (class, term, score) re-ranked by maximal marginal relevance over their vectors (term, vec).

    A class has at most a few dozen candidate terms.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "term"], ascending=[False, True], kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        x /= np.maximum(np.sqrt((x**2).sum(1)), 1e-300)[:, None]
        sim, value = x @ x.T, pdf["score"].to_numpy() / max(1e-300, float(pdf["score"].abs().max()))
        chosen = [0]
        while len(chosen) < min(k, len(pdf)):
            gain = (1 - diversity) * value - diversity * sim[:, chosen].max(1)
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
        return pd.DataFrame({"class": pdf["class"].iloc[0], "term": pdf["term"].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    kind = terms.schema["class"].dataType.simpleString()
    return terms.join(vectors, "term").groupBy("class").applyInPandas(run, f"class {kind}, term string, rank int")


def unique_terms(terms: DataFrame) -> DataFrame:
    """Terms (run_id, topic_id, term, score, rank) without repeats that differ by case; the first by rank stays."""
    w = Window.partitionBy("run_id", "topic_id", F.lower(F.trim("term"))).orderBy("rank", "term")
    kept = terms.where("trim(term) <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "topic_id").orderBy("rank", "term")))


def centroids(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(run_id, topic_id, centroid): mean of the vectors (note_id, vec) of a topic's notes, outliers (-1) left out."""
    rows = docs.where("topic_id >= 0").select("run_id", "topic_id", "note_id").distinct().join(vectors.select("note_id", "vec"), "note_id")
    return mean_vector(rows, ["run_id", "topic_id"])


def document_cosines(docs: DataFrame, vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(run_id, topic_id, note_id, cos) of notes to the centroid of their topic."""
    rows = docs.select("run_id", "topic_id", "note_id").distinct().join(centers, ["run_id", "topic_id"]).join(vectors.select("note_id", "vec"), "note_id")
    return rows.select("run_id", "topic_id", "note_id", S.cosine(F.col("vec"), F.col("centroid")).alias("cos"))


def query_cosines(runs: DataFrame, centers: DataFrame) -> DataFrame:
    """(run_id, topic_id, query_cos) of centroids to their run's query vector."""
    q = runs.where("query_embedding is not null").groupBy("run_id").agg(F.max(F.struct("created_at", "query_embedding")).alias("x")).select("run_id", F.col("x.query_embedding").alias("q"))
    return centers.join(q, "run_id").select("run_id", "topic_id", S.cosine(F.col("centroid"), F.col("q")).alias("query_cos"))


def tree_from_merges(leaves: pd.DataFrame, merges: pd.DataFrame, most: float | None = None) -> pd.DataFrame:
    """(topic_id, parent_id, level, size, label, is_leaf) from leaves (topic_id, size, label) and merges (parent, name, left, right, distance).

    Merges beyond the distance are skipped. Parents get the sum of their children's sizes; roots are parents
    that are nobody's child; level counts from the roots. A run has at most some hundred leaves.
    """
    use = merges if most is None else merges[merges["distance"] <= most]
    up: dict[int, int] = {}
    names: dict[int, str] = {}
    for r in use.itertuples():
        for child in (r.left, r.right):
            up.setdefault(int(child), int(r.parent))
        names[int(r.parent)] = r.name
    sizes = {int(a): int(b) for a, b in zip(leaves["topic_id"], leaves["size"])}
    total = dict.fromkeys({*sizes, *up, *names}, 0)
    for leaf, n in sizes.items():
        node, seen = leaf, set()
        while node is not None and node not in seen:
            seen.add(node)
            total[node] += n
            node = up.get(node)

    def level(node: int) -> int:
        n, seen = 0, set()
        while node in up and node not in seen:
            seen.add(node)
            node, n = up[node], n + 1
        return n

    labels = {int(a): b for a, b in zip(leaves["topic_id"], leaves["label"])}
    rows = [(i, up.get(i), level(i), total[i], labels.get(i, names.get(i)), i in sizes) for i in total]
    out = pd.DataFrame(rows, columns=["topic_id", "parent_id", "level", "size", "label", "is_leaf"])
    return out.sort_values(["level", "topic_id"]).reset_index(drop=True)


def ward_merges(centers: np.ndarray, sizes: np.ndarray, first_parent: int) -> list[tuple[int, int, int, float]]:
    """(parent, left, right, distance) of Ward's agglomeration over a run's centroids, by rising distance.

    Chains of nearest neighbours: work grows with the square of the centroids, memory with their number.
    """
    k = len(centers)
    x, n, live = np.array(centers, float), np.maximum(1, np.array(sizes, float)), np.ones(k, bool)
    found, chain = [], []
    for _ in range(k - 1):
        if not chain:
            chain = [int(np.argmax(live))]
        while True:
            a = chain[-1]
            d = np.where(live, ((x - x[a]) ** 2).sum(1) * (n * n[a] / (n + n[a])), np.inf)
            d[a] = np.inf
            b = int(np.argmin(d))
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        found.append((float(np.sqrt(2 * d[b])), a, b))
        x[a], n[a], live[b] = (x[a] * n[a] + x[b] * n[b]) / (n[a] + n[b]), n[a] + n[b], False
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while i in up:
            if up[i] in up:
                up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for j, (distance, a, b) in enumerate(sorted(found, key=lambda f: f[0])):
        ra, rb = sorted((root(a), root(b)))
        up[ra] = up[rb] = first_parent + j
        out.append((first_parent + j, ra, rb, distance))
    return out


#: Numbers that a class's c-TF-IDF vector is hashed to, for the tree of topics.
HASHED = 128


def class_vectors(scored: DataFrame) -> dict[int, np.ndarray]:
    """class -> its unit c-TF-IDF vector, by signed hashing to HASHED numbers: a row per topic."""
    h = F.xxhash64("term")
    rows = scored.groupBy("class", F.pmod(h, F.lit(HASHED)).cast("int").alias("at")).agg(F.sum(F.when(F.col("score").isNull(), 0.0).otherwise(F.col("score")) * F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).alias("v"))
    t = rows.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m")).select("class", F.transform(F.sequence(F.lit(0), F.lit(HASHED - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("x")).toPandas()
    x = np.array(t["x"].tolist()).reshape(len(t), HASHED)
    x /= np.maximum(np.sqrt((x**2).sum(1)), 1e-300)[:, None]
    return dict(zip(t["class"].astype(int), x))


def build(docs: DataFrame, k: int | None = None, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Topics and memberships of a corpus (note_id, vec, tokens): ((topic_id, parent_id, label, level, size), (topic_id, note_id, cos)).

    Parameters are those of schedule() with params put in. Unit vectors are reduced to n_components principal
    components; leaves are bisecting k-means clusters of these, as many as min_topic_size suggests, and leaves
    of fewer than min_cluster_size notes are no topics: their notes go to topic -1, unless all would. Terms are runs
    of up to three words (min_df, max_features), scored by c-TF-IDF; parents come from Ward's agglomeration of
    the leaves' c-TF-IDF vectors; labels are the four best terms of top_terms. One note gives one topic "All Notes".
    The parameters of the neighbour graph and of density (n_neighbors, min_dist, min_samples) have no counterpart here.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    rows = cut(docs.where("vec is not null and size(tokens) > 0").select("note_id", "tokens", F.transform("vec", lambda v: v.cast("double") / S.norm(F.col("vec"))).alias("unit")), "map")
    n = rows.count()
    topic_schema, member_schema = "topic_id int, parent_id int, label string, level int, size int", "topic_id int, note_id long, cos double"
    if n == 0:
        return spark.createDataFrame([], topic_schema), spark.createDataFrame([], member_schema)
    if n == 1:
        return spark.createDataFrame([(0, None, "All Notes", 0, 1)], topic_schema), rows.select(F.lit(0).alias("topic_id"), "note_id", F.lit(1.0).alias("cos"))
    p = merged_params(schedule(n), params or {})
    want = k or max(2, n // int(p["min_topic_size"]) // 4)
    features = rows.withColumn("features", array_to_vector("unit"))
    dim = len(rows.head()["unit"])
    if dim > p["n_components"]:
        features = PCA(k=int(p["n_components"]), inputCol="features", outputCol="reduced").fit(features).transform(features).drop("features").withColumnRenamed("reduced", "features")
    model = BisectingKMeans(k=want, seed=int(p["seed"]), featuresCol="features", predictionCol="topic_id", maxIter=8).fit(features.select("features"))
    placed = cut(model.transform(features).select("note_id", "tokens", "unit", "topic_id"), "placed")
    sizes = placed.groupBy("topic_id").count().toPandas().set_index("topic_id")["count"]  # a row per leaf
    large = sizes[sizes >= p["min_cluster_size"]]
    if len(large) < 2:
        large = sizes
    ids = sorted(int(i) for i in large.index)
    kept = spark.createDataFrame([(i,) for i in ids], "topic_id int").withColumn("kept", F.lit(True))
    placed = placed.join(F.broadcast(kept), "topic_id", "left").withColumn("topic_id", F.when(F.col("kept"), F.col("topic_id")).otherwise(-1)).drop("kept")  # a row per leaf
    scored = cut(class_scores(placed.where("topic_id >= 0").select(F.col("topic_id").alias("class"), "tokens"), 3, int(p["min_df"]), int(p["max_features"])), "scores")
    best = best_terms(scored, int(p["top_terms"])).where("rank <= 4")
    terms = best.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias("label")).toPandas().set_index("class")["label"]
    vectors = class_vectors(scored)
    merges = ward_merges(np.array([vectors.get(i, np.zeros(HASHED)) for i in ids]), large.loc[ids].to_numpy(), max(ids) + 1)
    name = lambda i: ids[i] if i < len(ids) else i
    fixed = [(q, " / ".join(str(terms.get(x, "")) for x in (name(a), name(b)) if x in terms.index)[:80], name(a), name(b), d) for q, a, b, d in _renumber(merges, ids)]
    tree = tree_from_merges(pd.DataFrame({"topic_id": ids, "size": large.loc[ids].to_numpy(), "label": [terms.get(i, "") for i in ids]}), pd.DataFrame(fixed, columns=["parent", "name", "left", "right", "distance"]))
    data = [(int(r.topic_id), None if pd.isna(r.parent_id) else int(r.parent_id), str(r.label or ""), int(r.level), int(r.size)) for r in tree[["topic_id", "parent_id", "label", "level", "size"]].itertuples(index=False)]
    loose = int(n - large.sum())
    if loose:
        data.append((-1, None, "Outliers", 0, loose))
    center = mean_vector(placed.where("topic_id >= 0"), ["topic_id"], "unit").withColumnRenamed("centroid", "center")
    members = placed.join(center, "topic_id", "left").select("topic_id", "note_id", S.cosine(F.col("unit"), F.col("center")).alias("cos"))
    return spark.createDataFrame(data, topic_schema), members


def _renumber(merges, ids):
    """Merge rows over positions as rows over topic ids; merged topics already have ids above all leaves."""
    base = len(ids)
    place = {}
    for j, (p, a, b, d) in enumerate(merges):
        place[p] = p
        yield p, (a if a < base and a not in place else a), (b if b < base and b not in place else b), d


def tree_sizes(topics: DataFrame, tree: DataFrame) -> DataFrame:
    """(run_id, topic_id, total): sizes of a topic and all its descendants, from hierarchy rows with paths.

    A null or negative size counts 0.
    """
    own = topic_rows(topics).select("run_id", "topic_id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("n"))
    rows = tree.where("state = 'tree'").select("run_id", "topic_id", F.explode(F.split("node_path", "/")).alias("up")).join(own, ["run_id", "topic_id"])
    return rows.groupBy("run_id", F.col("up").cast("int").alias("topic_id")).agg(F.sum("n").cast("long").alias("total"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """(run_id, n_topics, n_roots, n_leaves, n_links, max_depth) from hierarchy rows."""
    parents = tree.where("state = 'tree' and depth > 0").select("run_id", F.col("parent_id").alias("topic_id")).distinct().withColumn("inner_node", F.lit(True))
    rows = tree.where("state = 'tree'").join(parents, ["run_id", "topic_id"], "left")
    return rows.groupBy("run_id").agg(F.count("*").alias("n_topics"), F.count_if(F.col("depth") == 0).alias("n_roots"), F.count_if(F.col("inner_node").isNull()).alias("n_leaves"), F.count_if(F.col("depth") > 0).alias("n_links"), F.max("depth").alias("max_depth"))


def parent_terms(terms: DataFrame, topics: DataFrame, k: int = 12) -> DataFrame:
    """(run_id, parent_id, term, score, rank): children's terms summed with their sizes (at least 1) as weights."""
    child = topic_rows(topics).where("parent_id is not null").select("run_id", "topic_id", "parent_id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(1)).alias("n"))
    rows = terms.join(child, ["run_id", "topic_id"]).groupBy("run_id", "parent_id", "term").agg(F.sum(F.col("score") * F.col("n")).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "parent_id").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= k)


def invalid_links(topics: DataFrame) -> DataFrame:
    """(run_id, n_links, n_missing, valid): a map is valid if it has links and every parent exists."""
    rows = topic_rows(topics).select("run_id", "topic_id", "parent_id")
    known = rows.select("run_id", F.col("topic_id").alias("parent_id"), F.lit(True).alias("known"))
    out = rows.join(known, ["run_id", "parent_id"], "left").groupBy("run_id").agg(F.count_if(F.col("parent_id").isNotNull()).alias("n_links"), F.count_if(F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("n_missing"))
    return out.withColumn("valid", (F.col("n_links") > 0) & (F.col("n_missing") == 0))


def details(topics: DataFrame, docs: DataFrame, visible: DataFrame, run_id: str) -> DataFrame:
    """(topic_id, parent_id, label, size, children, n_notes, n_visible) of one map, by level and id; sizes stay as stored."""
    rows = topic_rows(topics).where(F.col("run_id") == run_id)
    kids = rows.where("parent_id is not null").groupBy(F.col("parent_id").alias("topic_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("topic_id")), lambda i: i.cast("string")), ",").alias("children"))
    notes = docs.where(F.col("run_id") == run_id).select("topic_id", "note_id").distinct().join(visible, "note_id", "left")
    counts = notes.groupBy("topic_id").agg(F.count("*").alias("n_notes"), F.count_if(F.col("visible")).alias("n_visible"))
    out = rows.join(kids, "topic_id", "left").join(counts, "topic_id", "left")
    return out.select("topic_id", "parent_id", "label", "size", F.coalesce("children", F.lit("")).alias("children"), F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.coalesce("n_visible", F.lit(0)).alias("n_visible"))


def map_roots(topics: DataFrame) -> DataFrame:
    """(run_id, topic_id): topics without a parent, or whose parent their run has not."""
    rows = topic_rows(topics).select("run_id", "topic_id", "parent_id")
    known = rows.select("run_id", F.col("topic_id").alias("parent_id"))
    return rows.join(known, ["run_id", "parent_id"], "left_anti").select("run_id", "topic_id")


def map_notes(docs: DataFrame, fronts: DataFrame) -> DataFrame:
    """(run_id, topic_id, note_id, weight, cos, front): the notes of every topic that have a visible front; of repeated rows the greatest weight, then cosine.

    fronts holds existing notes only, see notes.with_front.
    """
    best = F.max(F.struct(F.coalesce("weight", F.lit(float("-inf"))).alias("w"), F.coalesce("cos", F.lit(float("-inf"))).alias("c"), "weight", "cos"))
    rows = docs.groupBy("run_id", "topic_id", "note_id").agg(best.alias("x")).select("run_id", "topic_id", "note_id", "x.weight", "x.cos")
    return rows.join(fronts.where(T.is_visible(F.col("front"))), "note_id").select("run_id", "topic_id", "note_id", "weight", "cos", "front")


def history(runs: DataFrame, k: int = 5) -> DataFrame:
    """The latest k runs per scope, backend and model: (scope_hash, run_id, created_at, place)."""
    one = runs.select("scope_hash", "backend", "model", "run_id", "created_at").distinct()
    w = Window.partitionBy("scope_hash", "backend", "model").orderBy(F.desc("created_at"), "run_id")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("backend", "model")


def without_run(table: DataFrame, run_id: str) -> DataFrame:
    return table.where(~F.col("run_id").eqNullSafe(run_id))


def purged(runs: DataFrame, now: int, seconds: int) -> DataFrame:
    """Runs of at most that age."""
    return runs.where(F.col("created_at") >= now - seconds)


def sankey(topics: DataFrame) -> DataFrame:
    """(run_id, source, target, value): parent to child by the child's size, at least 1; roots hang on "ROOT"."""
    rows = topic_rows(topics).where("topic_id >= 0").select("run_id", "topic_id", "parent_id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(1)).cast("long").alias("value"))
    known = rows.select("run_id", F.col("topic_id").alias("parent_id"), F.lit(True).alias("known"))
    out = rows.join(known, ["run_id", "parent_id"], "left")
    return out.select("run_id", F.when(F.col("known"), F.col("parent_id").cast("string")).otherwise("ROOT").alias("source"), F.col("topic_id").cast("string").alias("target"), "value")


def preview_notes(docs: DataFrame, fronts: DataFrame, k: int = 12) -> DataFrame:
    """(run_id, topic_id, note_id, text, place): the first notes of a topic with visible text, by weight."""
    rows = docs.groupBy("run_id", "topic_id", "note_id").agg(F.max("weight").alias("weight")).join(fronts.select("note_id", T.plain(F.col("front")).alias("text")).where("text <> ''"), "note_id")
    w = Window.partitionBy("run_id", "topic_id").orderBy(F.desc_nulls_last("weight"), "note_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("weight")


def scope_label(scope: DataFrame, column: str = "scope") -> DataFrame:
    """scope rows with `scope_label` from their JSON (type with query, tag, deck, profile, id or label)."""
    j = lambda k: F.get_json_object(column, f"$.{k}")
    kind = j("type")
    label = (
        F.when(kind.isin("query", "tag", "deck"), F.concat(kind, F.lit(":"), F.when(kind == "query", j("query")).when(kind == "tag", j("tag")).otherwise(j("deck"))))
        .when(kind == "note-set", F.concat(F.lit("note-set:"), F.array_join(F.transform(F.array_sort(F.from_json(j("noteIds"), "array<bigint>")), lambda i: i.cast("string")), ",")))
        .when(kind == "global", F.concat_ws(":", F.lit("global"), j("profile")))
        .otherwise(F.coalesce(F.concat(j("id"), F.lit(":"), j("label")), F.concat(F.lit("custom:"), j("id"))))
    )
    return scope.withColumn("scope_label", label)


def scope_hash(scope: dict) -> str:
    """SHA-1 of a scope's JSON with keys in fixed order."""
    import hashlib
    import json

    # Keys of each kind of scope, in the order they are hashed.
    keys = {"query": ("query", "limit"), "tag": ("tag",), "deck": ("deck",), "note-set": ("noteIds",), "global": ("profile",), "custom": ("id", "label")}
    kind = scope.get("type", "custom")
    body = {"type": kind, **{k: scope.get(k) for k in keys[kind]}}
    if kind == "note-set":
        body["noteIds"] = sorted({int(i) for i in scope.get("noteIds") or []})
    return hashlib.sha1(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
