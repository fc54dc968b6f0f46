"""Full hierarchies from parent-child rows of unknown depth.

Level-wise frontier joins start from the roots and extend path and depth, several levels a join. Nodes that
no frontier reaches lie on a cycle or below one; powers of the parent function tell which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.shared import cut, scratch


def tree_nodes(topics: DataFrame) -> DataFrame:
    """(run_id, topic_id, parent_id): one row per key.

    Rows without run_id or topic_id are no nodes. Of rows that repeat a key, the smallest parent_id
    that is not null counts.
    """
    return topics.where("run_id is not null and topic_id is not null").groupBy("run_id", "topic_id").agg(F.min("parent_id").alias("parent_id"))


#: Levels that a frontier goes down in one join.
HOP = 16

_COLUMNS = ["run_id", "topic_id", "parent_id", "node_path", "depth", "root_id", "state"]


def hierarchy(topics: DataFrame, hop: int = HOP) -> DataFrame:
    """(run_id, topic_id, parent_id, node_path, depth, root_id, state), one row per (run_id, topic_id).

    state is "tree", "cycle" (the topic is its own ancestor) or "below_cycle". Paths hold topic ids from
    the root, joined by "/"; depth is 0 at a root. Outside trees node_path, depth and root_id are null.
    A topic whose parent is null or has no row in its run is a root. Stored levels are not read.
    An empty table gives no rows; extra columns are ignored.

    Ancestor pairs of up to `hop` levels come from joins that double their reach; a frontier, at first the
    roots, then goes down so many levels by one join with them, each written to the shared folder. A frontier
    has each node once; a parent of very many children is a skewed join of few rows with many, which
    adaptive execution splits.
    """
    spark = topics.sparkSession
    where, key = scratch(spark, "hierarchy"), ["run_id", "topic_id"]
    nodes = tree_nodes(topics)
    parents = nodes.select("run_id", F.col("topic_id").alias("parent_id"), F.lit(True).alias("known"))
    nodes = cut(nodes.join(parents, ["run_id", "parent_id"], "left").select(*key, "parent_id", F.coalesce("known", F.lit(False)).alias("linked")), "nodes")
    pairs, reach = _near_pairs(nodes, hop)
    frontier = nodes.where("not linked").select(*key, F.col("topic_id").cast("string").alias("node_path"), F.lit(0).alias("depth"), F.col("topic_id").alias("root_id"))
    schema, levels = frontier.schema, []
    while True:
        levels.append(f"{where}/block={len(levels)}")
        frontier.write.parquet(levels[-1])
        end = spark.read.schema(schema).parquet(levels[-1]).where(F.col("depth") == (len(levels) - 1) * reach)
        if end.isEmpty():
            break
        up = end.select("run_id", F.col("topic_id").alias("up"), "node_path", F.col("depth").alias("above"), "root_id")
        frontier = up.join(pairs, ["run_id", "up"]).select("run_id", F.col("down").alias("topic_id"), F.concat_ws("/", "node_path", "way").alias("node_path"), (F.col("above") + F.col("steps")).alias("depth"), "root_id")
    reached = spark.read.schema(schema).parquet(*levels)
    loose = cut(nodes.join(reached.select(*key), key, "left_anti").select(*key, "parent_id"), "loose")
    tree = reached.join(nodes.select(*key, "parent_id"), key).withColumn("state", F.lit("tree")).select(*_COLUMNS)
    n = loose.count()
    if not n:
        return tree
    on = _cycle_nodes(loose, n, where)
    rest = loose.join(on.withColumn("on_cycle", F.lit(True)), key, "left").select(*key, "parent_id", F.lit(None).cast("string").alias("node_path"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("root_id"), F.when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("state"))
    return tree.unionByName(rest)


def _near_pairs(nodes: DataFrame, hop: int) -> tuple[DataFrame, int]:
    """((run_id, up, down, steps, way), reach): ancestor pairs of at most `reach` levels, with the way from below `up` to `down`.

    reach is the least power of two from `hop` on, or less where nothing lies deeper.
    """
    pairs = nodes.where("linked").select("run_id", F.col("parent_id").alias("up"), F.col("topic_id").alias("down"), F.lit(1).alias("steps"), F.col("topic_id").cast("string").alias("way"))
    reach = 1
    while reach < hop:
        far = pairs.where(F.col("steps") == reach).select("run_id", F.col("up").alias("top"), F.col("down").alias("up"), F.col("way").alias("first"))
        if far.isEmpty():
            break
        more = far.join(pairs, ["run_id", "up"]).select("run_id", F.col("top").alias("up"), "down", (F.col("steps") + reach).alias("steps"), F.concat_ws("/", "first", "way").alias("way"))
        pairs, reach = cut(pairs.unionByName(more), "pairs"), 2 * reach
    return pairs, reach


def _cycle_nodes(loose: DataFrame, n: int, where: str) -> DataFrame:
    """Keys on a cycle: every loose node has a loose parent, so the image of parent^m, m >= n, holds just these."""
    spark = loose.sparkSession
    step, power, k = loose.select("run_id", F.col("topic_id").alias("a"), F.col("parent_id").alias("b")), 1, 0
    while power < n:
        image = step.select("run_id", "b").distinct()
        hop = step.select("run_id", F.col("a").alias("b"), F.col("b").alias("c")).join(image, ["run_id", "b"], "left_semi")
        step = step.join(hop, ["run_id", "b"]).select("run_id", "a", F.col("c").alias("b"))
        power, k = power * 2, k + 1
        if k % 4 == 0:
            step.write.parquet(f"{where}/power={k}")
            step = spark.read.parquet(f"{where}/power={k}")
    return step.select("run_id", F.col("b").alias("topic_id")).distinct()


def node_paths(tree: DataFrame) -> DataFrame:
    """(run_id, topic_id, node_path), the state standing in for the path outside trees."""
    return tree.select("run_id", "topic_id", F.when(F.col("state") == "tree", F.col("node_path")).otherwise(F.col("state")).alias("node_path"))


def descendants(tree: DataFrame) -> DataFrame:
    """(run_id, topic_id, descendant_id, distance) for every ancestor pair of the trees; cycles have none."""
    steps = F.split("node_path", "/")
    pairs = tree.where("state = 'tree' and depth > 0").select("run_id", F.col("topic_id").alias("descendant_id"), "depth", F.posexplode(F.slice(steps, 1, F.col("depth"))).alias("at", "up"))
    return pairs.select("run_id", F.col("up").cast("int").alias("topic_id"), "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))


def hierarchy_report(tree: DataFrame) -> DataFrame:
    """hierarchy() with n_descendants per node (0 on and below cycles)."""
    counts = descendants(tree).groupBy("run_id", "topic_id").agg(F.count("*").alias("n"))
    return tree.join(counts, ["run_id", "topic_id"], "left").withColumn("n_descendants", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def cycle_report(tree: DataFrame) -> DataFrame:
    """(run_id, n_cycle, n_below_cycle, smallest_cycle_id) for the runs with damaged links."""
    bad = tree.where("state <> 'tree'")
    return bad.groupBy("run_id").agg(F.count_if(F.col("state") == "cycle").alias("n_cycle"), F.count_if(F.col("state") == "below_cycle").alias("n_below_cycle"), F.min(F.when(F.col("state") == "cycle", F.col("topic_id"))).alias("smallest_cycle_id"))


def level_errors(topics: DataFrame, tree: DataFrame) -> DataFrame:
    """(run_id, topic_id, level, depth): rows whose stored level differs from the true depth."""
    w = Window.partitionBy("run_id", "topic_id")
    stored = topics.select("run_id", "topic_id", "level").distinct().withColumn("n", F.count("*").over(w))
    return stored.join(tree.where("state = 'tree'").select("run_id", "topic_id", "depth"), ["run_id", "topic_id"]).where("level <> depth").select("run_id", "topic_id", "level", "depth")
