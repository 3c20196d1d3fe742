"""Connected components of a graph given by its links, as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable.  Nodes without a link to another node are not returned.

    Alternating large-star and small-star rounds; each writes its links, so a lost executor costs one round at most.
    Links may repeat, point either way or to their own node; null ends are dropped.
    """
    links = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # Stored, so that Spark can split the join at a node with many links.
        least = stored(both.groupBy("x").agg(F.least("x", F.min("y")).alias("m")))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own.select("u", F.col("m").alias("v")))
        old, links = links, stored(small.distinct())
        discard(old, least)
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Joins numbered nodes; keeps only links that connect what was apart."""

    def __init__(self, n: int):
        self.root, self.kept = np.arange(n), []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def link(self, i: int, others) -> None:
        others = np.asarray(others)
        if not len(others) or (self.root[others] == self.root[i]).all():
            return
        for j in others.tolist():
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.kept.append((i, j))
