"""Matching entities of two sources that share no key.

Both sides are resolved into entities first, in one pass with the side in the
key.  Candidate pairs come from blocking on names alone, so an entity meets
rivals of its name in other trades and states.  How a pair agrees in name,
trade, legal form and state is a pattern; the rates at which matches and others
show each agreement are fitted from the counts of all patterns, and give each
pair its prior odds.  As an entity has at most one counterpart, the pairs are a
graph with a factor around each entity; loopy belief propagation passes messages
over it until they settle, and yields each pair's marginal probability of being
a match.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.names import TRADES, edits, name_nodes, name_records, resolve, without_one, without_two
from quern.operators.components import components
from quern.session import counted, written


#: Pairs of a connected graph of up to so many are settled in one task in memory; a larger graph takes rounds of joins.  The result is the same.
IN_ONE_TASK = 500_000


#: Rows that a task settles together; it takes whole graphs, one after another.
AT_ONCE = 100_000


def _settle(most_rounds: int, settled: float, damping: float):
    """Messages of whole connected graphs in memory, by the updates of ``match_marginals``; the graphs of a task come in the order of their roots."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        odds = rows["odds"].to_numpy(float)
        ends = [pd.factorize(rows[c])[0] for c in ("a", "b")]
        said = [np.ones(len(rows)), np.ones(len(rows))]
        for _ in range(most_rounds):
            moved = 0.0
            for me in (0, 1):
                heard = odds * said[1 - me]
                rest = np.maximum(0.0, np.bincount(ends[me], heard)[ends[me]] - heard)
                now = damping * said[me] + (1 - damping) / (1 + rest)
                moved = max(moved, np.abs(np.log(now / said[me])).max())
                said[me] = now
            if moved < settled:
                break
        else:
            raise RuntimeError("the messages did not settle")
        return rows[["a", "b", "odds"]].assign(from_a=said[0], from_b=said[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= AT_ONCE:
                rows = pd.concat(held, ignore_index=True)
                going_on = rows["root"] == rows["root"].iloc[-1]
                if not going_on.all():
                    yield whole(rows[~going_on])
                held, n = [rows[going_on]], int(going_on.sum())
        if n:
            yield whole(pd.concat(held, ignore_index=True))

    return run


def _settle_by_joins(state: DataFrame, most_rounds: int, settled: float, damping: float) -> DataFrame:
    for _ in range(most_rounds):
        # the odds that reach each side exclude what that side itself said; one side speaks after the other, which settles sooner
        state = state.withColumns({"was_a": F.col("from_a"), "was_b": F.col("from_b")})
        for me, other in (("a", "b"), ("b", "a")):
            sums = state.groupBy(me).agg(F.sum(F.col("odds") * F.col(f"from_{other}")).alias("all"))
            rest = F.greatest(F.lit(0.0), F.col("all") - F.col("odds") * F.col(f"from_{other}"))
            said = damping * F.col(f"from_{me}") + (1 - damping) / (1 + rest)
            state = written(state.join(sums, me).withColumn(f"from_{me}", said).drop("all"), "messages")
        moved = state.agg(F.max(F.greatest(*[F.abs(F.log(F.col(f"from_{x}") / F.col(f"was_{x}"))) for x in "ab"]))).first()[0]
        state = state.drop("was_a", "was_b")
        if moved is None or moved < settled:
            return state
    raise RuntimeError("the messages did not settle")


def match_marginals(pairs: DataFrame, most_rounds: int = 20_000, settled: float = 1e-6, damping: float = 0.1, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``a, b, confidence`` for candidate pairs ``(a, b, odds)``.

    ``odds`` are a pair's prior odds.  An entity's factor allows one pair or
    none: what it tells a pair is 1 / (1 + the others' odds as the other side
    sees them).  Messages have settled when none moves by ``settled`` in its
    logarithm, as a strong pair's probability hardly moves while they are far
    off; an error is raised if they don't.  Connected graphs share no message:
    each is settled in one task, a larger one than ``in_one_task`` by joins,
    whose sums are combined before the shuffle, so an entity with very many
    candidates is no large group.
    """
    state, n = counted(pairs.select("a", "b", "odds"), "messages")
    roots = components(state.select(F.concat(F.lit("a:"), "a").alias("a"), F.concat(F.lit("b:"), "b").alias("b")))
    state = state.withColumn("node", F.concat(F.lit("a:"), "a")).join(roots, "node").drop("node")
    out, by_joins = state, None
    if n > in_one_task:  # else no graph can have more
        state = written(state, "graphs")
        large = state.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > in_one_task).select("root")
        out = state.join(large, "root", "left_anti")
        by_joins, held = counted(state.join(large, "root", "left_semi").select("a", "b", "odds", F.lit(1.0).alias("from_a"), F.lit(1.0).alias("from_b")), "messages")
        by_joins = by_joins if held else None
    kind = state.schema["a"].dataType.simpleString()
    out = out.select("a", "b", "odds", "root").repartition("root").sortWithinPartitions("root")
    out = out.mapInPandas(_settle(most_rounds, settled, damping), f"a {kind}, b {kind}, odds double, from_a double, from_b double")
    if by_joins is not None:
        out = out.unionByName(_settle_by_joins(by_joins, most_rounds, settled, damping))
    belief = F.col("odds") * F.col("from_a") * F.col("from_b")
    return out.select("a", "b", (belief / (1 + belief)).alias("confidence"))


def _token(url: Column) -> Column:
    """The board's token in a posting's address."""
    path = F.regexp_extract(url, r"(?i)^https?://boards\.[^/]+/([^/?#]+)", 1)
    host = F.regexp_extract(url, r"(?i)^https?://careers\.([^./]+)\.", 1)
    return F.lower(F.when(path != "", path).otherwise(host))


def _after(token: Column, proper: Column) -> Column:
    """The letters that a token has after the proper name."""
    return F.when(F.startswith(token, F.lower(proper)), F.regexp_extract(F.substring(token, F.length(proper) + 1, F.length(token)), "^[a-z]+", 0))


def _trade_in(letters: Column) -> Column:
    """The trade that the letters write out or begin."""
    return F.coalesce(*[F.when(F.startswith(F.lit(t.lower()), letters), t) for t in TRADES])


def _states(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{2})\b"), 1), lambda s: ~s.isin("US", "HQ", "EU")))


#: How a pair may agree: in name by edits, and in trade, legal form and state: both say the same, one side or both say nothing, they differ.
LEVELS = {"name": ("same", "one", "two"), "trade": ("same", "silent", "one", "differ"), "form": ("same", "one", "differ"), "state": ("same", "one", "differ")}

#: Where the fit starts, as rates among matches and among others, and how many pairs of each these stand for, so that few pairs leave them nearly as they are.
START = {
    "name": ((0.88, 0.1, 0.02), (0.4, 0.3, 0.3)),
    "trade": ((0.7, 0.1, 0.19999, 0.00001), (0.02, 0.05, 0.23, 0.7)),
    "form": ((0.5, 0.4, 0.1), (0.25, 0.4, 0.35)),
    "state": ((0.6, 0.2, 0.2), (0.35, 0.2, 0.45)),
}
STANDS_FOR = 200.0


def fit_log_odds(counts: dict[tuple[str, ...], int], rounds: int = 2000, settled: float = 1e-9) -> dict[tuple[str, ...], float]:
    """The log odds of a match for every pattern of agreement, by expectation and maximisation over the patterns' counts.

    Agreements count as independent among matches and among others.  Patterns
    are in the order of ``LEVELS``; there is no more of them than combinations of
    levels, however many pairs.
    """
    fields = list(LEVELS)
    every = list(itertools.product(*LEVELS.values()))
    n = np.array([counts.get(p, 0) for p in every], dtype=float)
    at = np.array([[LEVELS[f].index(x) for f, x in zip(fields, p)] for p in every])
    start = [np.array([START[f][side] for side in (0, 1)]) for f in fields]
    rates, share, odds = [r.copy() for r in start], 0.5, np.zeros(len(every))
    for _ in range(rounds):
        now = np.log(share / (1 - share)) + sum(np.log(r[0][at[:, i]] / r[1][at[:, i]]) for i, r in enumerate(rates))
        moved, odds = np.abs(now - odds).max(), now
        if moved < settled:
            break
        match = 1 / (1 + np.exp(-odds))
        for i, r in enumerate(rates):
            for side, weight in ((0, n * match), (1, n * (1 - match))):
                seen = np.bincount(at[:, i], weight, minlength=r.shape[1]) + STANDS_FOR * start[i][side]
                r[side] = seen / seen.sum()
        share = (float((n * match).sum()) + STANDS_FOR / 2) / (n.sum() + STANDS_FOR)
    else:
        raise RuntimeError("the rates did not settle")
    return dict(zip(every, odds.tolist()))


def entity_links(boards: DataFrame, postings: DataFrame, employers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links ``a, b, confidence``, the records ``kind, record_id, a`` and the employers ``employer_id, b``.

    Names without a proper name (null, blank, an undisclosed client) have no
    record.  A bare name takes the trade that its board's other names or token
    give it, as a name alone may be that of several firms.
    """
    employers = employers.select("employer_id", "display_name", "states", "certified")
    rows = boards.select(F.lit("board").alias("kind"), F.col("board_id").alias("record_id"), F.col("company").alias("text"), F.lower("token").alias("token"), F.lit(None).cast("string").alias("place"))
    rows = rows.unionByName(postings.select(F.lit("posting").alias("kind"), F.col("posting_id").alias("record_id"), F.col("company_name").alias("text"), _token(F.col("url")).alias("token"), F.col("location_raw").alias("place")))
    rows = written(rows.filter((F.trim("text") != "") & F.col("record_id").isNotNull()).dropDuplicates(["kind", "record_id", "text"]), "rows")
    texts = rows.groupBy("text").agg(F.count("*").alias("l")).join(employers.filter(F.trim("display_name") != "").groupBy(F.col("display_name").alias("text")).agg(F.count("*").alias("r")), "text", "full_outer")
    read = written(name_nodes(texts.withColumn("weight", F.struct("l", "r"))), "read")
    # the trade that most names of a board with this proper name have
    here = rows.groupBy("text", "token").agg(F.count("*").alias("n"), F.max((F.col("kind") == "board").cast("int")).alias("own")).join(read.drop("weight", "node"), "text")
    most = here.filter("trade <> ''").groupBy("token", "proper", "trade").agg((F.sum("n") + 1000 * F.max("own")).alias("n")).groupBy("token", "proper").agg(F.max_by("trade", F.struct("n", "trade")).alias("most"))
    here = here.join(most, ["token", "proper"], "left")
    here = here.withColumn("after", _after(F.col("token"), F.col("proper")))
    bare = (F.col("kind") == "FIRM") & (F.col("trade") == "")
    hint = F.when(F.length("after") >= 3, _trade_in(F.col("after")))
    here = here.withColumn("trade", F.when(bare, F.coalesce(hint, "most", F.lit(""))).otherwise(F.col("trade")))
    parts = ["text", "token", "kind", "proper", "trade", "legal", "second", "initials"]
    left = here.select(F.lit("l").alias("scope"), *parts, F.col("n").alias("weight"))
    right = read.filter("weight.r > 0").withColumn("token", F.lit(None).cast("string")).select(F.lit("r").alias("scope"), *parts, F.col("weight.r").alias("weight"))
    form = F.when((F.col("kind") == "FIRM") & (F.col("trade") == ""), F.col("legal")).otherwise("")
    named = written(left.unionByName(right).withColumn("node", F.concat_ws("|", "scope", "kind", "proper", "trade", form, "second")), "named")
    entities = named.join(resolve(name_records(named)), "node")
    entities = written(entities.select("scope", "root", "text", "token", "kind", "proper", "trade", "legal", "second"), "entities")
    side = lambda scope, name: entities.filter(F.col("scope") == scope).withColumnRenamed("root", name)
    records = written(rows.join(side("l", "a").select("text", "token", "a").distinct(), ["text", "token"]).select("kind", "record_id", "a", "place"), "records")
    owned = employers.join(side("r", "b").select(F.col("text").alias("display_name"), "b").distinct(), "display_name").select("employer_id", "b", "states", (F.coalesce("certified", F.lit(0)) + 1).alias("size"))

    def keys(scope: str, name: str) -> DataFrame:
        """Blocks of an entity's names: with a letter left out, or two where the trade is given."""
        names = side(scope, name).select(name, "kind", "trade", F.explode(F.array_distinct(F.array("proper", "second"))).alias("proper")).filter("proper <> ''").distinct()
        any_ = F.transform(without_one(F.col("proper")), lambda v: F.xxhash64("kind", v))
        same = F.transform(without_two(F.col("proper")), lambda v: F.xxhash64("kind", "trade", v))
        parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return names.repartition(parts).select(name, F.col("proper").alias(f"p{name}"), F.explode(F.array_union(any_, same)).alias("key"))

    met = keys("l", "a").join(keys("r", "b").hint("merge"), "key")  # a planner that knows the sizes before the explode would broadcast
    met = met.select("a", "b", "pa", "pb").distinct()
    near = met.withColumn("edits", edits(F.col("pa"), F.col("pb"))).groupBy("a", "b").agg(F.min("edits").alias("edits")).filter("edits is not null")

    def said(scope: str, name: str) -> DataFrame:
        """What an entity's records say of it."""
        return side(scope, name).groupBy(name, "kind").agg(F.array_remove(F.collect_set("trade"), "").alias(f"t{name}"), F.array_remove(F.collect_set("legal"), "").alias(f"f{name}"))

    area_a = records.select("a", F.explode(_states(F.col("place"))).alias("s")).distinct().groupBy("a").agg(F.collect_set("s").alias("sa"))
    area_b = owned.groupBy("b").agg(F.flatten(F.collect_set(_states(F.col("states")))).alias("sb"), F.sum("size").alias("size"))
    about = near.join(said("l", "a"), "a").join(said("r", "b"), ["b", "kind"]).join(area_a, "a", "left").join(area_b, "b", "left")

    def level(x: str, y: str, silent: bool = False) -> Column:
        x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in (x, y))
        none = (F.size(x) == 0) | (F.size(y) == 0)
        first = F.when((F.size(x) == 0) & (F.size(y) == 0), "silent") if silent else F
        return first.when(none, "one").when(F.arrays_overlap(x, y), "same").otherwise("differ")

    name = F.when(F.col("edits") == 0, "same").when(F.col("edits") == 1, "one").otherwise("two")
    pattern = F.struct(name.alias("name"), level("ta", "tb", True).alias("trade"), level("fa", "fb").alias("form"), level("sa", "sb").alias("state"))
    pairs = written(about.select("a", "b", pattern.alias("p"), F.coalesce("size", F.lit(1)).alias("size")), "pairs")
    # a row for each pattern, of which there are no more than combinations of levels
    odds = fit_log_odds({tuple(r["p"]): r["n"] for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()})
    fitted = pairs.sparkSession.createDataFrame([(p, x) for p, x in odds.items()], f"p {pairs.schema['p'].dataType.simpleString()}, fitted double")
    # of rivals that agree alike, the one with more filings is likelier
    pairs = pairs.join(F.broadcast(fitted), "p").select(F.col("a").cast("string"), F.col("b").cast("string"), F.exp(F.col("fitted") + 0.1 * F.log(F.col("size") + 1)).alias("odds"))
    return match_marginals(pairs), records.select("kind", "record_id", F.col("a").cast("string").alias("a")).distinct(), owned.select("employer_id", F.col("b").cast("string").alias("b")).distinct()


def found_links(boards: DataFrame, postings: DataFrame, employers: DataFrame, least: float = 0.5) -> DataFrame:
    """``kind, record_id, employer_id`` of the pairs that are more likely a match than not."""
    links, records, owned = entity_links(boards, postings, employers)
    return records.join(links.filter(F.col("confidence") >= least), "a").join(owned, "b").select("kind", "record_id", "employer_id").distinct()


def link_confidence(boards: DataFrame, postings: DataFrame, employers: DataFrame) -> DataFrame:
    """``kind, record_id, employer_id, confidence`` of every candidate, the unlikely ones too."""
    links, records, owned = entity_links(boards, postings, employers)
    return records.join(links, "a").join(owned, "b").groupBy("kind", "record_id", "employer_id").agg(F.round(F.max("confidence"), 4).alias("confidence"))
