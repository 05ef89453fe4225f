"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import few_files, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node it knows.

    A hub has many neighbours: its rows are summed map-side, and by one column more than the join's key, so that the
    join has an exchange of its own on both sides and Spark can split a hub's partition.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a", F.pmod(F.xxhash64("a"), F.lit(1))).agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node of its component.

    Nodes may be of any orderable type; null ends and loops count for nothing. Every round is a table in the
    shared folder, so lineage stays short and a lost executor costs one round at most. No round has more edges than
    the one before, which bounds its files.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    # a small star first: a node with many hubs keeps one edge, and its hubs are joined among themselves
    edges = written(_small_star(edges), name)
    was = _print(edges)
    for _ in range(rounds):
        if not was[0]:
            break
        edges = written(_small_star(_large_star(edges)), name, rows=was[0])
        now = _print(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
    return few_files(nodes, 2 * was[0])
