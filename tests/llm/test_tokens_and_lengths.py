import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.llm.mixing import mix, route
from quern.llm.packing import pack, plan_containers
from quern.llm.splitting import split_long, split_text
from quern.llm.tokens import token_count, tokenizer


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_pieces_are_the_text_and_sizes_are_exact(text):
    tok = tokenizer()
    assert "".join(tok.pieces(text)) == text
    assert tok.count(text) == len(tok.encoding.encode_ordinary(text))


@pytest.mark.parametrize("text", ["½ cup ²", "a\x1cb\x1d", "don't WE'LL", "  x \n\n y", "１２३", "ß’s", "é a"])
def test_odd_characters(text):
    tok = tokenizer()
    assert tok.count(text) == len(tok.encoding.encode_ordinary(text))


def test_token_count(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [2, 0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_item_and_wastes_little(seed):
    rng = random.Random(seed)
    sizes = {rng.randrange(1, 500): rng.randrange(1, 60) for _ in range(60)}
    plan = plan_containers(sizes, 512)
    used = {}
    for copies, pattern in plan.runs:
        assert sum(s * k for s, k in pattern.items()) <= 512
        for s, k in pattern.items():
            used[s] = used.get(s, 0) + copies * k
    assert used == sizes
    assert plan.containers >= plan.lower_bound
    # no worse than first fit decreasing by more than a hundredth
    bins = []
    for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
        for i, room in enumerate(bins):
            if room >= s:
                bins[i] -= s
                break
        else:
            bins.append(512 - s)
    assert plan.containers <= 1.01 * len(bins) + 1


def test_plan_edges():
    assert plan_containers({}, 10).containers == 0
    assert plan_containers({10: 3}, 10).containers == 3
    assert plan_containers({6: 5}, 10).containers == 5
    assert plan_containers({1: 1_000_000_000}, 10).containers == 100_000_000
    with pytest.raises(ValueError):
        plan_containers({11: 1}, 10)


def test_pack(spark):
    rows = [(i, 1 + i % 90) for i in range(1000)] + [(2000, 250), (2001, 0), (2002, None), (5, 6), (None, 7), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n int").withColumn("container_id", F.lit("clash"))
    out = pack(df, "doc_id", "n", 100).collect()
    held = {}
    for r in out:
        if r.container_id is not None:
            held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
    assert max(held.values()) <= 100
    assert sum(held.values()) == sum(1 + i % 90 for i in range(1000)) + 250 + 14
    assert [(r.piece_no, r.n_tokens) for r in sorted(out, key=lambda r: r.piece_no) if r.doc_id == 2000] == [(1, 100), (2, 100), (3, 50)]
    assert {r.doc_id for r in out if r.container_id is None} == {2001, 2002}
    assert len([r for r in out if r.doc_id is not None and r.doc_id < 1000]) == 1000
    assert sorted(held) == list(range(len(held)))
    assert pack(df.limit(0), "doc_id", "n", 100).count() == 0


def test_route_shares_and_repeats():
    f = frozenset
    patterns = {f({"a"}): 1000, f({"b"}): 100, f({"a", "b"}): 50, f({"x"}): 9}
    got = route(patterns, {"a": 0.5, "b": 0.5, "z": 0.2}, {"a": 1, "b": 3, "z": 1})
    by = {}
    for (p, r, s), n in got.amounts.items():
        assert n <= patterns[p] and r <= min({"a": 1, "b": 3}[m] for m in p)
        by[s] = by.get(s, 0) + n
    assert by["a"] == by["b"] == 350  # b: three times 100, and the shared 50 once
    # a first use is cheaper than a repeat
    got = route({f({"a"}): 100, f({"b"}): 100, f({"a", "b"}): 100}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}, total=300)
    assert all(r == 1 for _, r, _ in got.amounts)
    assert route({}, {"a": 1.0}, {"a": 1}).amounts == {}


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.choice(["A", "a ", "b"]) if i % 7 else "c", 1 + rng.randrange(40)) for i in range(3000)]
    rows += [(5000 + i, "same", rng.choice("ab"), 10) for i in range(400)] + [(9000, None, "a", 5), (9001, "u", None, 5), (9002, "v", "q", 5), (9003, "w", "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, c string, source string, n int").withColumn("repeat_no", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("C", 0.3, 4), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix(df, "doc_id", "c", "source", "n", targets)
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].actual_share - 1 / 3) < 0.01 and abs(got["c"].actual_share - 1 / 3) < 0.01
    assert got["none"].actual_share == 0 and got["c"].most_repeats <= 4 and got["a"].most_repeats == 1
    used = mixture.collect()
    assert len({(r.source, r.doc_id, r.repeat_no) for r in used}) == len(used)
    assert sum(r.n_tokens for r in used) == sum(r.n_tokens for r in got.values())
    assert {r.doc_id for r in used} <= {r[0] for r in rows[:3400]}
    empty, none = mix(df.limit(0), "doc_id", "c", "source", "n", targets)
    assert empty.count() == 0 and {r.actual_share for r in none.collect()} == {0.0}


def _texts():
    rng = random.Random(2)
    words = ["alpha", "beta", "reconcile", "x", "überprüfen", "日本語テキスト", "e-mail"]
    yield "x" * 9000
    yield "日" * 4000
    yield "".join(rng.choice(["a", "é", "😀", "z"]) for _ in range(5000))
    yield "\r\n".join(" ".join(rng.choice(words) for _ in range(30)) + "." for _ in range(60))
    yield "\n\n".join(" ".join(rng.choice(words) for _ in range(80)) for _ in range(30))
    yield " " * 3000 + "\n" * 900 + "end"
    yield "a, b; c: d" * 900


@pytest.mark.parametrize("text", list(_texts()))
@pytest.mark.parametrize("limit, overlap", [(512, 64), (40, 0), (30, 20)])
def test_pieces_of_long_texts(text, limit, overlap):
    tok = tokenizer()
    pieces = split_text(tok, text, limit, overlap)
    assert "".join(p[3][p[4] :] for p in pieces) == text
    for i, (first, own, end, piece, _) in enumerate(pieces):
        assert end - first <= limit and len(tok.encoding.encode_ordinary(piece)) <= limit
        if i:
            assert own == pieces[i - 1][2]
            assert overlap <= own - first <= overlap + 3 or first == 0


def test_cuts_are_at_natural_boundaries():
    tok = tokenizer()
    text = "\n\n".join(f"Paragraph {i} has words in it. " * 6 for i in range(40))
    pieces = split_text(tok, text, 200, 10)
    assert all(p[3].endswith("\n\n") for p in pieces[:-1])


def test_split_long(spark):
    rows = [(1, "word " * 400), (2, "short"), (3, None), (4, ""), (1, "word " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit(1))
    out = split_long(df, "doc_id", "text", 100, 10).collect()
    assert {r.doc_id for r in out} == {1}
    assert len(out) == 2 * len({r.piece_no for r in out})
    assert split_long(df.limit(0), "doc_id", "text", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_long(df, "doc_id", "text", 20, 18)
