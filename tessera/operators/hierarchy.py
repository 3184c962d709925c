"""Parent-child graphs over the catalog."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import cut

#: How a relation's score is raised, and how depth lowers it.
BOOSTS = {"self": 0.5, "parent": 0.4, "child": 0.4, "ancestor": 0.3, "descendant": 0.3}
PENALTIES = [1.0, 0.9, 0.75, 0.6, 0.5]


def edges(entities: DataFrame) -> DataFrame:
    """(src, dst, weight) parent to child, of known ids only; entities (id, parents, children, weights)."""
    known = entities.select("id")
    up = entities.select(F.explode("parents").alias("src"), F.col("id").alias("dst"), F.col("weights").alias("w"))
    down = entities.select(F.col("id").alias("src"), F.explode("children").alias("dst"), F.lit(None).cast("map<string,double>").alias("w"))
    rows = up.unionByName(down).withColumn("weight", F.coalesce(F.col("w")[F.col("src")], F.lit(1.0)))
    rows = rows.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return rows.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def closure(edge: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth): every ancestor at its least depth, up to max_depth. One join a level, until no new pair
    appears; in a cycle each node is an ancestor of the others, none of itself."""
    step = edge.select(F.col("dst").alias("id"), F.col("src").alias("ancestor"))
    out = front = step.withColumn("depth", F.lit(1)).distinct()
    for depth in count(2):
        if max_depth is not None and depth > max_depth:
            break
        front = front.join(step.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        front = cut(front.join(out, ["id", "ancestor"], "left_anti").where("id <> ancestor"))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def ancestors(edge: DataFrame, max_depth: int | None = None) -> DataFrame:
    return closure(edge, max_depth)


def descendants(edge: DataFrame, max_depth: int | None = None) -> DataFrame:
    return closure(edge, max_depth).select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "depth")


def relation_depth(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """pairs (a, b) with depth: steps between them, whichever is the ancestor; 0 if equal, -1 if unrelated."""
    up = closed.select(F.col("id").alias("a"), F.col("ancestor").alias("b"), F.col("depth").alias("up"))
    down = closed.select(F.col("ancestor").alias("a"), F.col("id").alias("b"), F.col("depth").alias("down"))
    rows = pairs.join(up, ["a", "b"], "left").join(down, ["a", "b"], "left")
    return rows.select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce(F.least("up", "down"), F.lit(-1))).alias("depth"))


def root_paths(edge: DataFrame) -> DataFrame:
    """(id, path): from the root to each node, always by the least parent; in a cycle until a node would come again."""
    parent = edge.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    nodes = edge.select(F.col("src").alias("id")).unionByName(edge.select(F.col("dst").alias("id"))).distinct()
    now = nodes.select("id", F.col("id").alias("top"), F.array("id").alias("path"))
    while True:
        up = now.join(parent.withColumnsRenamed({"id": "top"}), "top", "left")
        up = up.withColumn("parent", F.when(~F.array_contains("path", F.col("parent")), F.col("parent")))
        if up.where("parent is not null").isEmpty():
            break
        now = cut(up.select("id", F.coalesce("parent", "top").alias("top"), F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path")))
    return now.select("id", "path")


def score(similarity, relation, depth):
    """(0.7 * similarity + 0.3 * boost) * penalty of the depth."""
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv])[relation], F.lit(0.0))
    penalty = F.coalesce(F.get(F.array(*[F.lit(p) for p in PENALTIES]), depth), F.lit(0.4))
    return (0.7 * similarity + 0.3 * boost) * penalty


def match(base: DataFrame, closed: DataFrame, k: int, level: str = "all") -> DataFrame:
    """(query_id, rank, id, score, relation, depth): base hits (query_id, id, score), their ancestors and descendants,
    the best of each id, the best k; level: all, ancestors or descendants."""
    own = base.select("query_id", "id", "score", F.lit("self").alias("relation"), F.lit(0).alias("depth"))
    up = base.join(closed, "id").select("query_id", F.col("ancestor").alias("id"), "score", F.when(F.col("depth") == 1, "parent").otherwise("ancestor").alias("relation"), "depth")
    low = closed.select(F.col("ancestor").alias("id"), F.col("id").alias("d"), "depth")
    down = base.join(low, "id").select("query_id", F.col("d").alias("id"), "score", F.when(F.col("depth") == 1, "child").otherwise("descendant").alias("relation"), "depth")
    rows = own
    rows = rows.unionByName(up) if level in ("all", "ancestors") else rows
    rows = rows.unionByName(down) if level in ("all", "descendants") else rows
    rows = rows.withColumn("score", F.round(score(F.col("score"), F.col("relation"), F.col("depth")), 6))
    one = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "depth", "relation")
    rows = rows.withColumn("n", F.row_number().over(one)).where("n = 1")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "relation", "depth")
