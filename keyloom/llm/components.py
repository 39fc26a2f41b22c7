"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join.

Edges are two columns, a and b. A step's table is written to the shared folder, so lineage stays short and lost executors cost
one step. A hub with very many edges is summed before it moves and its join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    return joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame, work: Workspace, name: str, rows: int | None = None) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node. rows: about how many edges, if known."""
    edges = work.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), f"{name}-0", rows)
    before, step = _mark(edges), 0
    while before[0]:
        step += 1
        edges = work.stage(_small_star(_large_star(edges)), f"{name}-{step}", before[0])  # a step adds no edges
        now = _mark(edges)
        work.drop(f"{name}-{step - 1}")
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
