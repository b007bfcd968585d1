"""All shortest paths between pairs of nodes, by search from both ends over distance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written


def _first(roots: DataFrame) -> list[DataFrame]:
    return [written(roots.select("root", F.col("root").alias("node"), F.array("root").alias("nodes")).distinct(), "ways")]


def _further(levels: list[DataFrame], step: DataFrame, roots: DataFrame, most: int, forth: bool) -> None:
    """Add the next level, (root, node, nodes): for the roots that still ask, nodes that are first reached over that many steps(src, dst), with
    the first most of their shortest ways, in the order of the way's nodes from the path's start on."""
    seen = levels[0].select("root", "node")
    for x in levels[1:]:
        seen = seen.unionAll(x.select("root", "node").distinct())
    nodes = F.concat("nodes", F.array("dst")) if forth else F.concat(F.array("dst"), "nodes")
    level = levels[-1].join(roots.distinct(), "root", "left_semi")
    level = level.join(step, level.node == step.src).select("root", F.col("dst").alias("node"), nodes.alias("nodes"))
    level = level.withColumn("nth", F.row_number().over(Window.partitionBy("root", "node").orderBy("nodes"))).where(F.col("nth") <= most).drop("nth")
    levels.append(written(level.join(seen, ["root", "node"], "left_anti"), "ways"))


def all_shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 3, most: int = 10) -> DataFrame:
    """start, end, hops, nth, path (nodes joined by '>'): the shortest directed paths of at most hops steps of edges(src, dst) for each of
    pairs(src, dst), the first most of them in the order of their nodes.

    Each end is searched level by level in turn, for the pairs that are left, half of the way, and a node keeps its first most ways from that end only: of a path among the
    first ones, either half is among the first ways between its middle and its end. For each number of hops in turn the pairs that are
    left look for nodes that lie half way from both ends; a shortest path has exactly one. Nothing is followed for pairs but these nodes,
    so a hub's edges aren't tried once more for every pair that goes over it. Pairs with equal or null ends and pairs that are too far
    apart give no row; repeated pairs and edges count once.
    """
    # every level reads the edges, so they are made once
    step = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    left = written(pairs.select("src", "dst").where("src <> dst").distinct(), "pairs")
    forth, back = _first(left.select(F.col("src").alias("root"))), _first(left.select(F.col("dst").alias("root")))
    order = Window.partitionBy("start", "end").orderBy("nodes")
    out = None
    for h in range(1, hops + 1):
        if h % 2:
            _further(forth, step, left.select(F.col("src").alias("root")), most, True)
        else:
            _further(back, step.toDF("dst", "src"), left.select(F.col("dst").alias("root")), most, False)
        ahead, behind = forth[h - h // 2].toDF("src", "node", "nodes"), back[h // 2].toDF("dst", "node", "rest")
        met = left.join(behind, "dst").join(ahead, ["src", "node"])
        nodes = F.concat("nodes", F.slice("rest", 2, hops))
        found = met.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.lit(h).alias("hops"), nodes.alias("nodes"))
        found = written(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most), "paths")
        out = found if out is None else out.unionAll(found)
        left = written(left.join(found.select(F.col("start").alias("src"), F.col("end").alias("dst")), ["src", "dst"], "left_anti"), "pairs")
    return out.select("start", "end", "hops", "nth", F.array_join("nodes", ">").alias("path"))
