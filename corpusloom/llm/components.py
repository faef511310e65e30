"""Connected components of links, by alternating stars over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, long) but the roots; root: the least node of the component.

    Each round lets every node point its larger neighbours, then its smaller ones, to the least node
    it knows; rounds grow with the logarithm of a component's width. Only joins and minima by key are
    used (no neighbour lists), every round is written to the shared folder, nothing comes to the driver
    but a count and a checksum. Null ends and loops are dropped.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    before = _mark(edges)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        edges = cut_lineage(_small_star(_large_star(edges)))
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For local nodes 0..n-1 joined by the pairs (left, right): the least node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, root):
            return root
        root = new
