"""Mixing sources to target weights.

A text that several sources hold may serve any of them.  Texts are aggregated
by membership pattern - the set of sources that hold them - and a min-cost flow
routes the patterns' tokens to the sources' quotas, where using a text again
costs more each time.  The flow's graph has a node per pattern and source, not
per text.  Texts are then selected along a seeded order within each pattern.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from quern.session import cut


class Flow:
    """Min-cost flow by successive shortest paths; the costs are small whole numbers."""

    def __init__(self) -> None:
        self.edges: list[list[int]] = []  # to, capacity, cost
        self.of: dict[object, list[int]] = defaultdict(list)
        self.names: list[object] = []
        self.at: dict[object, int] = {}

    def node(self, name: object) -> int:
        if name not in self.at:
            self.at[name] = len(self.names)
            self.names.append(name)
        return self.at[name]

    def add(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        a, b = self.node(a), self.node(b)
        self.of[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.of[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: object, sink: object) -> int:
        s, t, total = self.node(source), self.node(sink), 0
        n = len(self.names)
        height = [0] * n
        while True:
            dist, by = [None] * n, [-1] * n
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > dist[v]:
                    continue
                for e in self.of[v]:
                    w, capacity, cost = self.edges[e]
                    if capacity > 0 and (dist[w] is None or d + cost + height[v] - height[w] < dist[w]):
                        dist[w], by[w] = d + cost + height[v] - height[w], e
                        heapq.heappush(heap, (dist[w], w))
            if dist[t] is None:
                return total
            far = max(d for d in dist if d is not None)
            height = [h + (far if d is None else d) for h, d in zip(height, dist)]
            push, v = None, t
            while v != s:
                push = self.edges[by[v]][1] if push is None else min(push, self.edges[by[v]][1])
                v = self.edges[by[v] ^ 1][0]
            v = t
            while v != s:
                self.edges[by[v]][1] -= push
                self.edges[by[v] ^ 1][1] += push
                v = self.edges[by[v] ^ 1][0]
            total += push


@dataclass
class Route:
    """Tokens of each ``(pattern, repeat, source)``, and the total that was asked for."""

    amounts: dict[tuple[frozenset, int, str], int]
    total: int


def route(patterns: dict[frozenset, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> Route:
    """Route pattern tokens to quotas ``share * total``.

    The shares are those of the sources that hold any tokens, scaled to 1.
    Without ``total`` it is the largest that every such source can reach its
    share of.  A text of several sources is used at most as often as the
    strictest of them allows.
    """
    held = {s for p in patterns if patterns[p] > 0 for s in p if shares.get(s, 0) > 0}
    scale = sum(shares[s] for s in held)
    want = {s: shares[s] / scale for s in sorted(held)}

    def solve(size: int, costs: bool) -> tuple[int, int, dict]:
        flow, used = Flow(), {}
        for p, tokens in sorted(patterns.items(), key=lambda x: sorted(x[0])):
            members = sorted(s for s in p if s in want)
            for r in range(1, min((repeats[s] for s in members), default=0) + 1):
                flow.add("from", (p, r), tokens, (r - 1) if costs else 0)
                for s in members:
                    used[p, r, s] = flow.add((p, r), s, tokens)
        quota = {s: int(size * w) for s, w in want.items()}
        for s, q in quota.items():
            flow.add(s, "to", q)
        return flow.run("from", "to"), sum(quota.values()), {k: flow.edges[e ^ 1][1] for k, e in used.items() if flow.edges[e ^ 1][1]}

    if not want:
        return Route({}, 0)
    if total is None:
        low, high = 0, sum(n * max((repeats[s] for s in p if s in want), default=0) for p, n in patterns.items()) + 1
        while high - low > 1:
            middle = (low + high) // 2
            reached, asked, _ = solve(middle, False)
            low, high = (middle, high) if reached == asked else (low, middle)
        total = low
    return Route(solve(total, True)[2], total)


#: Sources that a mixture may have.
MOST_SOURCES = 20


def mix(df: DataFrame, key: str, content: str, source: str, size: str, targets: DataFrame, seed: int = 7, total: int | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``df`` has a row per document: its ``key``, a fingerprint ``content`` of its
    text, its ``source`` and its ``size`` in tokens.  Rows without text or size
    can't serve and are left aside, as are sources without a target.  Case and
    outer blanks of a source don't count.  Equal fingerprints are one text.

    The mixture has a row per use of a text: ``source, key, repeat_no,
    n_tokens``, the key being the least among the documents of that text in
    that source.  The report has a row per target: ``source, target_share,
    actual_share, n_tokens, n_texts, most_repeats``; a source that holds nothing
    has an actual share of 0 and the others share the rest in proportion.

    Texts are taken in the order of a seeded hash, from a table of sums over
    ``parts`` ranges of it, so a pattern that holds most texts isn't one task;
    unless given, as many as a shuffle has, and 1,024 at least.  The driver holds
    a row per membership pattern: no more than 2^sources, so more than
    ``MOST_SOURCES`` sources with a target are an error.
    """
    parts = parts or max(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    name = F.lower(F.trim(F.col(source)))
    goals = [(r["s"], r["w"], r["m"]) for r in targets.select(name.alias("s"), F.col("target_share").alias("w"), F.col("max_repeats").alias("m")).dropna().distinct().collect()]  # a row per source
    shares, repeats = {s: w for s, w, _ in goals}, {s: m for s, _, m in goals}
    if len(shares) != len(goals):
        raise ValueError("a source has several targets")
    if len(shares) > MOST_SOURCES:
        raise ValueError("too many sources")
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("k"), F.col(content).alias("c"), name.alias("s"), F.col(size).cast("int").alias("n")).filter("k is not null and c is not null and n > 0")
    docs = docs.filter(F.col("s").isin(sorted(shares)))
    texts = docs.groupBy("c", "s").agg(F.min("k").alias("k"), F.max("n").alias("n"))
    texts = texts.groupBy("c").agg(F.max("n").cast("long").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "k")))).alias("keys"))
    texts = texts.withColumn("p", F.array_join(F.map_keys("keys"), "\n")).withColumn("h", F.xxhash64(F.lit(seed), "c"))
    # sums and the choice from them must see the same rows
    texts = cut(texts.withColumn("part", F.floor((F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * parts).cast("int")))
    sums = texts.groupBy("p", "part").agg(F.sum("n").alias("t"))
    # a row per set of sources that some text has; there are few sources
    patterns = {frozenset(r["p"].split("\n")): int(r["t"]) for r in sums.groupBy("p").agg(F.sum("t").alias("t")).collect()}
    chosen = route(patterns, shares, repeats, total)
    slices, at = [], defaultdict(int)
    for (p, r, s), tokens in sorted(chosen.amounts.items(), key=lambda x: (sorted(x[0][0]), x[0][1], x[0][2])):
        slices.append(("\n".join(sorted(p)), r, s, at[p, r], at[p, r] + tokens))
        at[p, r] += tokens
    slices = spark.createDataFrame(slices, "p string, repeat_no int, source string, lo long, hi long")
    before = F.coalesce(F.sum("t").over(Window.partitionBy("p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(Window.partitionBy("p", "part").orderBy("h", "c").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = texts.join(sums.select("p", "part", before.alias("before")), ["p", "part"]).withColumn("middle", F.col("before") + inside - F.col("n") / 2)
    # bounded by patterns, repeats and sources
    uses = placed.join(F.broadcast(slices), "p").filter("middle >= lo and middle < hi")
    out = uses.select("source", F.col("keys")[F.col("source")].alias(key), "repeat_no", F.col("n").alias("n_tokens"), "c")
    reached = out.groupBy("source", "c").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("m")).groupBy("source").agg(F.sum("t").alias("t"), F.count("*").alias("x"), F.max("m").alias("m"))
    goals = spark.createDataFrame(sorted(goals), "source string, target_share double, max_repeats int")
    share = F.col("t") / F.sum("t").over(Window.partitionBy())
    report = goals.join(reached, "source", "left").select(
        "source",
        "target_share",
        F.coalesce(share, F.lit(0.0)).alias("actual_share"),
        F.coalesce("t", F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce("x", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("m", F.lit(0)).cast("int").alias("most_repeats"),
    )
    return out.drop("c"), report
