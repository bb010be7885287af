"""Filling containers of fixed capacity.

The sizes of all items are reduced to a histogram, which has no more rows than
the capacity.  A configuration linear program over it - how many containers to
fill by each pattern of sizes - is solved by multiplicative weights: a knapsack
dynamic program prices patterns under the current weights, every pattern within
a factor of the best takes a step, and what it covers loses weight.  The
fractional counts are rounded; the few items left take the best fit in the gaps.
Only the histogram and the patterns are on the driver; items find their place
by their rank among those of the same size.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F


@dataclass
class Plan:
    """Containers as runs of copies of one pattern: ``(copies, {size: times})``."""

    capacity: int
    runs: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    lower_bound: int = 0

    @property
    def containers(self) -> int:
        return sum(n for n, _ in self.runs)


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each capacity, and the last item taken."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -1
        if k := fit[c]:
            gain = best[c - sizes[:k]] + values[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-15:
                best[c], took[c] = gain[i], i
    return best, took


def _take(took: np.ndarray, sizes: np.ndarray, c: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while c > 0:
        i = int(took[c])
        if i < 0:
            c -= 1
            continue
        out[i] = out.get(i, 0) + 1
        c -= int(sizes[i])
    return out


#: Containers that a solution of the program fills at least before it is solved again.
STEP = 2


def configuration_lp(sizes: np.ndarray, counts: np.ndarray, capacity: int, epsilon: float = 0.15, rounds: int = 160, per_round: int = 48) -> dict[tuple, float]:
    """Patterns with fractional counts that together cover every size's count.

    ``rounds`` bounds the pricing programs and ``per_round`` the patterns that
    step after each; the result holds at most their product of patterns, however
    many items there are.
    """
    covered = np.zeros(len(sizes))
    found: dict[tuple, float] = {}
    for _ in range(rounds):
        weight = np.exp(-(covered - covered.min()) / epsilon) / counts
        best, took = _price(weight, sizes, capacity)
        with_item = best[capacity - sizes] + weight  # the best pattern that holds an item
        near = np.flatnonzero(with_item >= (1 - epsilon) * best[capacity])
        # those whose items are covered least step first
        for i in near[np.argsort(covered[near], kind="stable")][:per_round]:
            pattern = _take(took, sizes, int(capacity - sizes[i]))
            pattern[int(i)] = pattern.get(int(i), 0) + 1
            pattern = {j: min(k, int(counts[j])) for j, k in pattern.items()}
            step = epsilon * min(counts[j] / k for j, k in pattern.items())
            key = tuple(sorted(pattern.items()))
            found[key] = found.get(key, 0.0) + step
            for j, k in pattern.items():
                covered[j] += step * k / counts[j]
        if covered.min() >= 1 + 4 * epsilon:
            break
    scale = max(np.average(covered, weights=counts * sizes), 1e-12)
    return {k: x / scale for k, x in found.items()}


def _round(sizes: np.ndarray, counts: np.ndarray, capacity: int, part: float, fullest: bool, **lp) -> list[tuple[int, dict[int, int]]]:
    """Whole counts: a part of the program's solution is rounded and taken, and the program solved for what is left.

    A pattern's fraction that rounding drops is owed to the next.  Once the
    program adds nothing the rest takes the best fit.  ``fullest`` patterns come
    first, or else the most used.
    """
    left, runs = counts.astype(np.int64).copy(), []
    while left.any():
        on = np.flatnonzero(left > 0)
        patterns = configuration_lp(sizes[on], left[on].astype(float), capacity, **lp)
        need, taken, owed = max(STEP, part * (left * sizes).sum() / capacity), 0, 0.0
        full = {p: sum(int(sizes[on[j]]) * k for j, k in p) for p in patterns}
        for pattern, x in sorted(patterns.items(), key=lambda p: (-full[p[0]] if fullest else -p[1], p[0])):
            owed += x
            n = min(int(owed), *(int(left[on[j]]) // k for j, k in pattern))
            if n > 0:
                owed -= n
                taken += n
                runs.append((n, {int(sizes[on[j]]): k for j, k in pattern}))
                for j, k in pattern:
                    left[on[j]] -= n * k
            owed = min(owed, 1.0 + x)
            if taken >= need:
                break
        if not taken or part >= 1:
            break
    # the rest by decreasing size into the fullest container that takes it; runs with a gap are opened one by one
    gaps: list[tuple[int, int]] = sorted((capacity - sum(s * k for s, k in p.items()), i) for i, (n, p) in enumerate(runs) if n)
    gaps = [g for g in gaps if g[0] > 0]
    for j in range(len(sizes) - 1, -1, -1):
        size = int(sizes[j])
        while left[j] > 0:
            at = bisect.bisect_left(gaps, (size, -1))
            if at == len(gaps):
                # equal new containers at once
                per = capacity // size
                n, rest = divmod(int(left[j]), per)
                for copies, k in ((n, per), (1, rest)):
                    if copies and k:
                        runs.append((copies, {size: k}))
                        if capacity - k * size:
                            bisect.insort(gaps, (capacity - k * size, len(runs) - 1))
                left[j] = 0
                break
            gap, i = gaps.pop(at)
            n, p = runs[i]
            k = gap // size
            use = min(n, int(left[j]) // k)
            if use == 0:
                use, k = 1, int(left[j])
            if use < n:
                runs.append((n - use, p))
                bisect.insort(gaps, (gap, len(runs) - 1))
            runs[i] = (use, {**p, size: p.get(size, 0) + k})
            left[j] -= use * k
            if gap - k * size:
                bisect.insort(gaps, (gap - k * size, i))
    return [(n, p) for n, p in runs if n]


def plan_containers(histogram: dict[int, int], capacity: int, **lp) -> Plan:
    """A plan for items of ``{size: count}``, none above the capacity."""
    items = sorted((s, n) for s, n in histogram.items() if s > 0 and n > 0)
    if not items:
        return Plan(capacity)
    sizes, counts = (np.array(x, dtype=np.int64) for x in zip(*items))
    if sizes[-1] > capacity:
        raise ValueError("an item is larger than the capacity")
    bound = -(-int((sizes * counts).sum()) // capacity)
    # one large step does better with many sizes, small steps with few or large ones
    large = _round(sizes, counts, capacity, 1.0, True, **lp)
    small = _round(sizes, counts, capacity, 0.3, False, **{"epsilon": 0.1, "rounds": 60, "per_round": 16, **lp})
    return Plan(capacity, min(large, small, key=lambda r: sum(n for n, _ in r)), bound)


def pack(df: DataFrame, key: str, size: str, capacity: int, spread: int | None = None, **lp) -> DataFrame:
    """``key, piece_no, n_tokens, container_id``: every item in a container.

    An item above the capacity is cut into pieces of the capacity and one of
    the rest; no other is split.  ``piece_no`` counts from 1.  Items of size 0
    or null take no room and come out without a container.  A key that is
    repeated is one item, of its largest size; rows with a null key are items
    of their own.  ``spread`` is the number of parts over which the items of
    one size are ranked, so that a size that a third of all items have is no
    single task; unless given, as many as a shuffle has, and 64 at least.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = df.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n"))
    items = items.filter("k is not null").groupBy("k").agg(F.max("n").alias("n")).unionByName(items.filter("k is null"))
    pieces = items.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") / capacity).cast("int")))))
    pieces = pieces.withColumn("n", F.least(F.lit(capacity), F.col("n") - (F.col("piece_no") - 1) * capacity))
    from quern.session import cut

    spread = spread or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    # ranks and the plan must see the same rows: a lost executor must not change either
    pieces = cut(pieces.withColumn("part", F.pmod(F.xxhash64("k", "piece_no"), F.lit(spread)).cast("int")))
    by_part = pieces.filter("n > 0").groupBy("n", "part").agg(F.count("*").alias("c"))
    histogram = {r["n"]: r["c"] for r in by_part.groupBy("n").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    plan = plan_containers(histogram, capacity, **lp)
    spark = df.sparkSession
    # where the items of a size go: ranks from .. to, `times` in each container from `first` on
    ranges, start, first = {n: [] for n in histogram}, dict.fromkeys(histogram, 0), 0
    for copies, pattern in plan.runs:
        for s, times in sorted(pattern.items()):
            ranges[s].append((start[s], start[s] + copies * times, times, first))
            start[s] += copies * times
        first += copies
    # ranks of a size fall into as many blocks as it has ranges, so that a rank meets the few ranges of its block
    width = {s: max(1, -(-histogram[s] // max(1, len(r)))) for s, r in ranges.items()}
    blocks = [(s, at, *r) for s, own in ranges.items() for r in own for at in range(r[0] // width[s], (r[1] - 1) // width[s] + 1)]
    places = spark.createDataFrame(blocks, "size int, block long, lo long, hi long, times int, first long")
    widths = spark.createDataFrame(sorted(width.items()), "n int, width long")
    offset = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_part.select("n", "part", offset.alias("before"))
    rank = F.row_number().over(Window.partitionBy("n", "part").orderBy("k", "piece_no")) - 1
    placed = pieces.filter("n > 0").withColumn("r", rank).join(offsets, ["n", "part"]).withColumn("r", F.col("r") + F.col("before"))
    # widths: a row per size; places: rounds * per_round patterns and their sizes twice at most, whatever the number of items
    placed = placed.join(F.broadcast(widths), "n").withColumn("block", F.expr("r div width"))
    placed = placed.join(F.broadcast(places), (F.col("n") == F.col("size")) & (placed["block"] == places["block"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    placed = placed.select("k", "piece_no", F.col("n").alias("n_tokens"), (F.col("first") + F.floor((F.col("r") - F.col("lo")) / F.col("times"))).cast("long").alias("container_id"))
    empty = pieces.filter("n <= 0").select("k", "piece_no", F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty).withColumnRenamed("k", key)
