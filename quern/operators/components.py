"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quern.session import counted, forget, written


#: Up to so many links one task unites them in memory; more take rounds of joins.  The result is the same.
IN_ONE_TASK = 500_000


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roots of all nodes, by union-find with the least node as the root."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for x, y in zip(batch["a"].tolist(), batch["b"].tolist()):
            up.setdefault(x, x)
            up.setdefault(y, y)
            p, q = root(x), root(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    if up:
        yield pd.DataFrame({"node": list(up), "root": [root(x) for x in up]})


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``node, root`` for every node of a link; the root is the least node of its component.

    Alternating star contraction: each round hangs the neighbours of a node that
    are larger than it onto its least neighbour, then those that are smaller.
    A graph of few links is united in one task instead.  A node's links shrink to one as the rounds go, and neighbour minima are
    combined before the shuffle, so a node with very many links is no large
    group.  Null ends and links of a node to itself say nothing.
    """
    x, y = F.col(a), F.col(b)
    stars = links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    stars, n = counted(stars, "links")
    if n <= in_one_task:
        kind = stars.schema["a"].dataType.simpleString()
        return stars.coalesce(1).mapInPandas(_unite, f"node {kind}, root {kind}")
    before = None
    for _ in range(most_rounds):
        # large stars: all larger neighbours of a node to its least neighbour or itself
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small stars: the smaller neighbours and the node itself to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("n"), "m").unionByName(least.select(F.col("a").alias("n"), "m"))
        held, stars = stars, written(small.filter("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct(), "links")
        forget(held)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
