"""Connected components by alternating star steps on an edge table.

Each step is one aggregation, which is combined before its shuffle, and one join over the edges, in which the edges of a
hub are dealt over several tasks. Nothing but a count and a checksum reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread_join, written


def _star(edges: DataFrame, n_edges: int, large: bool) -> tuple[DataFrame, DataFrame]:
    """Large star: link every larger neighbour of a node to the node's least neighbour; small star: every smaller one.

    The new edges, and a written table that they are made from."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    around = both if large else both.where("dst < src")
    least = written(around.groupBy("src").agg(F.least("src", F.min("dst")).alias("least"), F.count("*").alias("n")))
    linked = spread_join(around, least, "src", 2 * n_edges, "dst")
    if large:
        out = linked.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        out = linked.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))
    return out.where("src <> dst").distinct(), least


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node it reaches.

    ``edges`` has long columns ``src`` and ``dst``; direction, repeats, self-links and nulls don't matter. No edges: no
    rows. Raises if the stars haven't settled after ``most_steps`` rounds (they need about log² of the longest path).
    """
    now = written(edges.select("src", "dst").where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = _mark(now)
    if mark[0]:
        for _ in range(most_steps):
            large, one = _star(now, mark[0], True)
            large = written(large)
            small, other = _star(large, large.count(), False)
            after = written(small)
            for old in (now, large, one, other):
                dropped(old)
            now, was, mark = after, mark, _mark(after)
            if mark == was:
                break
        else:
            raise RuntimeError("components have not settled")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def with_least(nodes: DataFrame, rep: str) -> DataFrame:
    """``nodes`` (written, with ``node``, ``component`` and ``rep``) with ``component_id``: the component's least ``rep``."""
    least = written(nodes.groupBy("component").agg(F.min(rep).alias("component_id"), F.count("*").alias("n")))
    return spread_join(nodes, least, "component", nodes.count(), "node")
