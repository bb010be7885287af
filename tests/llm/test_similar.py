import collections
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import linking, neardup
from quern.llm.canonical import found_canonical, near_spellings
from quern.llm.linking import found_links, link_confidence, match_marginals
from quern.llm.names import found_names, read_name, resolve
from quern.llm.neardup import found_duplicates, near_duplicates, shingles, sketches, visible_text


@pytest.mark.parametrize(
    "markup, text",
    [("<p>A &amp; B</p><!-- x --><ul><li>c</li></ul>", "A & B c"), ("&lt;p&gt;A &amp;amp; B&lt;/p&gt;", "A & B"), ("5 &lt; 6", "5 < 6"), ("wo<b>rd</b>", "word"), ("a<br>b<script>x()</script>", "a b"), (None, ""), ("", "")],
)
def test_visible_text(markup, text):
    assert visible_text(markup).split() == text.split()


def test_sketch_is_full_and_estimates():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7, 0.9):
        base = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        a, b = np.unique(base), np.unique(np.concatenate([base[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)]))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = sketches([a, b], 2000)
        assert abs((x == y).mean() - exact) < 0.04
    small = sketches([np.array([5], dtype=np.uint64), np.array([], dtype=np.uint64)], 64)
    assert (small[0] != np.uint64(2**64 - 1)).all()


def _docs(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs, i = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(rng.choice([1, 1, 3, 6])):
            text = list(base)
            for _ in range(rng.randrange(0, 9)):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((i, "head", None, " ".join(text)))
            i += 1
    return docs + [(i + j, "head", None, docs[0][3]) for j in range(200)] + [(9000, None, None, None), (9001, "t", "", "x"), (9002, "t", "<p>", None)]


def _classes(docs, size, share, least):
    sets = {}
    for i, h, m, p in docs:
        body = neardup._WORD.findall((visible_text(m) if m is not None else p or "").lower())
        if len(body) >= least:
            sets[i] = frozenset(shingles(neardup._WORD.findall((h or "").lower()) + body, size).tolist())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    return {frozenset(g) for g in _groups({i: root(i) for i in sets})}


def _groups(of):
    by = collections.defaultdict(set)
    for i, c in of.items():
        by[c].add(i)
    return by.values()


@pytest.mark.parametrize("hot", [5000, 0])
def test_near_duplicates_equal_brute_force(spark, hot):
    docs = _docs()
    df = spark.createDataFrame(docs, "id long, head string, markup string, plain string").repartition(5)
    got = near_duplicates(df, 3, 0.75, 40, hot=hot).collect()
    assert len(got) == len(docs)
    of = {r.id: r.text_class for r in got if r.text_class is not None}
    assert {frozenset(g) for g in _groups(of)} == _classes(docs, 3, 0.75, 40)
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_crowded_band_loses_no_link(spark, monkeypatch):
    # one band for all texts: much boilerplate, few alike
    monkeypatch.setattr(neardup, "_bands", lambda sketch, bands, rows: np.tile(np.arange(1, bands + 1), (len(sketch), 1)))
    monkeypatch.setattr(neardup, "SALTS", 4)
    docs = [d for d in _docs(3) if d[0] < 150]
    df = spark.createDataFrame(docs, "id long, head string, markup string, plain string").repartition(3)
    got = {r.id: r.text_class for r in near_duplicates(df, 3, 0.75, 40, hot=0).collect() if r.text_class is not None}
    assert {frozenset(g) for g in _groups(got)} == _classes(docs, 3, 0.75, 40)


def test_spanning_links_connect_a_class(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, "head", None, " ".join([*base, f"x{i}"])) for i in range(6)]
    got = near_duplicates(spark.createDataFrame(docs, "id long, head string, markup string, plain string"), 3, 0.75, 40).collect()
    assert len({r.text_class for r in got}) == 1
    # each at least one, and together at least what a tree has
    assert all(r.spanning_links >= 1 for r in got) and sum(r.spanning_links for r in got) >= 2 * 5


def test_found_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(80))
    posts = [(1, "T", f"<p>{long}</p>", None, "https://a.example/x/jobs/1"), (2, "T", None, long + " more", "https://a.example/x/jobs/2"), (3, "T", "<p>short</p>", None, "https://a.example/x/jobs/3"), (1, "T", f"<p>{long}</p>", None, "https://a.example/x/jobs/1"), (4, None, None, None, None)]
    queue = [(1, "HTTP://A.example/x/jobs/1?utm=1", "AB"), (2, "https://a.example/x/jobs/2/", "cd"), (3, " ", "ab"), (4, None, None), (5, "https://a.example/x/jobs/3#a", None), (6, "https://a.example/x/jobs/3", "ef"), (7, None, "zz"), (8, "", "ZZ"), (1, "HTTP://A.example/x/jobs/1?utm=1", "AB")]
    p = spark.createDataFrame(posts, "posting_id long, title string, description_html string, description_text string, url string").withColumn("g", F.lit(1))
    q = spark.createDataFrame(queue, "entry_id long, url string, dedupe_key string").withColumn("id", F.lit(1))
    got = {tuple(r) for r in found_duplicates(p, q).collect()}
    assert got == {("posting", 1, 2), ("queue", 1, 2), ("queue", 1, 3), ("queue", 2, 3), ("queue", 5, 6), ("queue", 7, 8)}
    assert found_duplicates(p.limit(0), q.limit(0)).count() == 0


def test_canonical(spark):
    titles = spark.createDataFrame([(1, "yield analyst"), (2, "fare planner"), (3, "outage insight manager"), (4, "freight measurement scientist"), (5, "freight cost measurement scientist"), (6, None), (7, "fleet data steward")], "term_id int, term string")
    skills = spark.createDataFrame([(1, "Quillbase", 'quill.base|"quillbase & quilkit"'), (2, "text labelling", None), (3, "Cobaltrank", "coba ltrank")], "skill_id int, canonical string, aliases string")
    cases = {
        "Sr. Yield Analyst II": 1, "Yieldanalyst": 1, "Anlyst, Yield (Remote)": 1, "yeild analyst #REQ-123": 1, "Yield Anlst - Night Desk": 1, "Planner, Fare, West Desk": 2, "Now hiring: FARE PLNNR": 2,
        "Outage Mgr": 3, "Insightmanager, Outage": 3, "Stage Manager": 0, "Freight Scientist": 4, "freight cost scientist": 5, "Garden Tutor": 0, "Steward, Theatre": 0, "Fleet Stewrad": 7, "Fleet Dta Steward | Full Time": 7, "x" * 3000: 0,
    }
    posts = [(i, t) for i, t in enumerate(cases)] + [(0, next(iter(cases))), (900, None), (901, "  ")]
    entered = {"strong Quillbase (2+ years)": 1, "QUILLBASE & QUILKIT": 1, "quillbaes v2.1": 1, "labelling of text": 2, "text-labelling": 2, "Coab-ltrank": 3, "tree felling": 0, "": 0, None: 0}
    rows = [(i, t) for i, t in enumerate(entered)]
    p = spark.createDataFrame(posts, "posting_id long, title string").withColumn("value", F.lit("clash"))
    e = spark.createDataFrame(rows, "entry_id long, skill_text string").withColumn("ref_id", F.lit(5))
    got = {(r.kind, r.record_id): r.ref_id for r in found_canonical(p, e, titles, skills).collect()}
    assert {t: got["title", i] for i, t in enumerate(cases)} == cases
    assert {t: got["skill", i] for i, t in enumerate(entered)} == entered
    assert len(got) == len(cases) + len(entered)
    assert found_canonical(p.limit(0), e.limit(0), titles, skills).count() == 0
    assert {r.ref_id for r in found_canonical(p, e, titles.limit(0), skills.limit(0)).collect()} == {0}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_segments_find_what_all_pairs_find(spark):
    rng = random.Random(9)
    ways = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(2, 13))), rng.randrange(0, 5)) for i in range(80)]
    ways = list({s: (i, s, c) for i, s, c in ways}.values())
    keys = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {s for _, s, _ in ways[:20]} | {s[1:] + s[0] for _, s, _ in ways} | {s[:-1] for _, s, _ in ways}
    got = {(r.key, r.ref_id): r.dist for r in near_spellings(spark.createDataFrame([(k,) for k in keys if k], "key string"), spark.createDataFrame(ways, "ref_id int, spelling string, cost int")).collect()}
    want = {}
    for k in keys:
        for i, s, c in ways:
            allowed = 2 if len(s) >= 5 and (c < 2 or (c <= 3 and len(s) >= 6 + 2 * c)) else 0
            d = _distance(k, s)
            if k and d <= allowed and (d <= 1 or sorted(k) == sorted(s) or (c == 0 and len(s) >= 9)):
                want[k, i] = d
    assert got == want and set(want.values()) == {0, 1, 2}


@pytest.mark.parametrize(
    "name, parts",
    [
        ("Optics Services, Sihujezack Limited Liability Co", ("FIRM", "SIHUJEZACK", "OPTICS", "LLC", "")),
        ("TRIMEDRUGORFORESTRY SOLUTIONS CO.", ("FIRM", "TRIMEDRUGOR", "FORESTRY", "CO", "")),
        ("Krimitrëfor Aviation a/k/a Howebovult", ("FIRM", "KRIMITREFOR", "AVIATION", "", "HOWEBOVULT")),
        ("Tilicobun Medical Center, University of", ("MEDICAL", "TILICOBUN", "", "", "")),
        ("Stemejudren Children's Hoospital, Ostwick", ("CHILDRENS HOSPITAL", "STEMEJUDREN", "", "", "")),
        ("Client: Guzizifum - Virginia Ltd.", ("FIRM", "GUZIZIFUM", "", "LTD", "")),
        ("Undisclosed client", ("",) * 5), ("", ("",) * 5), (None, ("",) * 5), ("Inc.", ("",) * 5),
    ],
)
def test_read_name(name, parts):
    assert read_name(name) == parts


def test_found_names(spark):
    groups = [
        ["Sedebromis Mapping Solutions Corp.", "SEDEBRÖMIS MAPPING", "Mapping, Sedebromis Corp.", "SedebromisMapping Solutions", "Sedebromsi Mapping", "Sedebromis Corp."],
        ["Sedebromis Energy LLC", "Sedebromis Energy - Ohio LLC"],
        ["Mutrepratas Biolabs d/b/a Flanicozo", "Mutrepratas Biolabs Partners", "Flanicozo"],
        ["University of Kotisukru", "Kotisukru, University of", "Univ of Kotisukru (Dunton)"],
        ["University of Kotisukru Medical Center"],
        ["Kotisukru State University", "Kotisukru St University"],
        ["Brgurigrucol Dental International Inc.", "Brugrigrrucol Dental Inc."],
    ]
    texts = [t for g in groups for t in g]
    e = spark.createDataFrame([(t,) for t in texts[::3]] + [(None,), ("  ",), (texts[0],)], "display_name string").withColumn("root", F.lit(1))
    a = spark.createDataFrame([(t,) for t in texts[1::3]], "display_name string")
    c = spark.createDataFrame([(t,) for t in texts[2::3]], "institution string")
    got = {tuple(r) for r in found_names(e, a, c).collect()}
    assert got == {p for g in groups for p in itertools.combinations(sorted(g), 2)}
    assert found_names(e.limit(0), a.limit(0), c.limit(0)).count() == 0


def _roots(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "node string, kind string, proper string, trade string, legal string, second string, initials array<string>, weight int")
    return {r.node: r.root for r in resolve(df).collect()}


def test_a_richer_profile_merges_in_a_second_round(spark):
    # the bare record joins the firm of its first name and so gives that firm's trade to its second name, which only then meets another spelling of it
    rows = [("1", "FIRM", "SEDEBROMIS", "FOODS", "", "", []), ("2", "FIRM", "SEDEBROMIS", "", "", "FLANICOZOVAR", []), ("3", "FIRM", "FLANCIOZVAR", "FOODS", "", "", []), ("4", "FIRM", "FLANICOZOVAR", "ENERGY", "", "", [])]
    got = _roots(spark, rows)
    assert got["1"] == got["2"] == got["3"] != got["4"]
    without = _roots(spark, [r for r in rows if r[0] != "2"])
    assert len({without[n] for n in "134"}) == 3


def test_initials_lead_to_the_one_profile_that_has_them(spark):
    firms = [("1", "FIRM", "SEDEBROMIS", "MAPPING", "LLC", "", ["SMS"]), ("2", "FIRM", "SEDEBROMSI", "MAPPING", "LLC", "", ["SM"]), ("3", "FIRM", "KOTISUKRU", "FOODS", "INC", "", ["KF"])]
    got = _roots(spark, firms + [("4", "FIRM", "SMS", "", "", "", ["=SMS"]), ("5", "FIRM", "SM", "", "LLC", "", ["=SM"]), ("6", "FIRM", "KF", "", "LLC", "", ["=KF"])])
    assert got["1"] == got["2"] == got["4"] == got["5"]  # both spellings' initials are the profile's
    assert got["6"] != got["3"]  # another legal form
    two = _roots(spark, [*firms, ("7", "FIRM", "MOLDEBRIX", "SHIPPING", "", "", ["SMS"]), ("4", "FIRM", "SMS", "", "", "", ["=SMS"])])
    assert two["4"] not in (two["1"], two["7"])  # two firms have them


def test_a_shared_block_is_no_match(spark):
    # each is two letters from what they share, and four edits from the other
    rows = [("1", "FIRM", "ABSEDEBROMIS", "FOODS", "", "", []), ("2", "FIRM", "SEDEBROMISXY", "FOODS", "", "", [])]
    got = _roots(spark, rows)
    assert got["1"] != got["2"]


def test_messages_change_who_is_matched(spark):
    # a is rather b's by its own agreement, but b has a better one: without messages both of b's pairs would stand and c would stay alone
    pairs = [("a", "b", 3.0), ("a", "c", 2.0), ("x", "b", 60.0)]
    got = {(r.a, r.b): r.confidence >= 0.5 for r in match_marginals(spark.createDataFrame(pairs, "a string, b string, odds double")).collect()}
    assert got == {("a", "b"): False, ("a", "c"): True, ("x", "b"): True}
    assert all(odds / (1 + odds) >= 0.5 for _, _, odds in pairs)


def test_graphs_of_a_task_are_settled_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(linking, "AT_ONCE", 2)
    pairs = [(f"a{i}", f"b{i}{j}", float(1 + j)) for i in range(30) for j in range(3)]
    rows = pd.DataFrame([(a, b, o, a) for a, b, o in pairs], columns=["a", "b", "odds", "root"])
    out = pd.concat(linking._settle(1000, 1e-9, 0.1)(iter([rows.iloc[i : i + 4] for i in range(0, len(rows), 4)])))
    want = {k: v for i in range(30) for k, v in _exact_marginals(pairs[3 * i : 3 * i + 3]).items()}
    for r in out.itertuples():
        belief = r.odds * r.from_a * r.from_b
        assert abs(belief / (1 + belief) - want[r.a, r.b]) < 1e-6
    assert len(out) == len(pairs)


def test_rates_are_fitted():
    rng = random.Random(5)
    counts = collections.Counter()
    for _ in range(20_000):
        match = rng.random() < 0.6
        draw = lambda rates: rng.choices(range(len(rates)), rates)[0]
        truth = {"name": ((0.95, 0.04, 0.01), (0.2, 0.4, 0.4)), "trade": ((0.8, 0.1, 0.0999, 0.0001), (0.05, 0.05, 0.1, 0.8)), "form": ((0.7, 0.2, 0.1), (0.2, 0.2, 0.6)), "state": ((0.3, 0.3, 0.4), (0.3, 0.3, 0.4))}
        counts[tuple(linking.LEVELS[f][draw(truth[f][0 if match else 1])] for f in linking.LEVELS)] += 1
    odds = linking.fit_log_odds(counts)
    # a field that says nothing of matches gets hardly any weight, whatever the fit began with
    assert abs(odds["same", "same", "same", "same"] - odds["same", "same", "same", "differ"]) < 0.3
    assert abs((odds["same", "same", "same", "one"] - odds["same", "same", "differ", "one"]) - np.log(0.7 / 0.2 / (0.1 / 0.6))) < 0.5
    few = linking.fit_log_odds({("same", "same", "same", "same"): 2})
    assert few["same", "same", "same", "same"] > 0 > few["same", "differ", "same", "same"]


def _exact_marginals(pairs):
    total, part = 0.0, collections.Counter()
    for n in range(len(pairs) + 1):
        for chosen in itertools.combinations(pairs, n):
            if len({p[0] for p in chosen}) == len({p[1] for p in chosen}) == n:
                w = np.prod([p[2] for p in chosen]) if chosen else 1.0
                total += w
                for p in chosen:
                    part[p[:2]] += w
    return {k: v / total for k, v in part.items()}


def test_marginals_on_a_tree_are_exact(spark):
    pairs = [("a1", "b1", 8.0), ("a1", "b2", 2.0), ("a2", "b2", 5.0), ("a3", "b3", 0.5)]
    got = {(r.a, r.b): r.confidence for r in match_marginals(spark.createDataFrame(pairs, "a string, b string, odds double"), settled=1e-7).collect()}
    want = _exact_marginals(pairs)
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_marginals_with_a_loop_choose_the_assignment(spark):
    pairs = [("a1", "b1", 50.0), ("a1", "b2", 40.0), ("a2", "b1", 40.0), ("a2", "b2", 1.0)]
    got = {(r.a, r.b): r.confidence for r in match_marginals(spark.createDataFrame(pairs, "a string, b string, odds double")).collect()}
    want = _exact_marginals(pairs)
    assert (got["a1", "b2"] > 0.5) == (want["a1", "b2"] > 0.5) and (got["a1", "b1"] > 0.5) == (want["a1", "b1"] > 0.5)
    assert match_marginals(spark.createDataFrame([], "a string, b string, odds double")).count() == 0


@pytest.mark.parametrize("in_one_task", [0, 500_000])
def test_marginals_of_strong_rivals_settle(spark, in_one_task):
    strong = float(np.exp(8.7))
    pairs = [("a", "x", strong), ("a", "y", strong / 2), ("c", "z", 3.0)]
    got = {(r.a, r.b): r.confidence for r in match_marginals(spark.createDataFrame(pairs, "a string, b string, odds double"), in_one_task=in_one_task).collect()}
    want = _exact_marginals(pairs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_marginals_that_do_not_settle_fail(spark):
    pairs = spark.createDataFrame([("a", "x", 6000.0), ("a", "y", 3000.0)], "a string, b string, odds double")
    for in_one_task in (0, 500_000):
        with pytest.raises(Exception, match="did not settle"):
            match_marginals(pairs, most_rounds=2, in_one_task=in_one_task).collect()


def test_found_links(spark):
    boards = spark.createDataFrame([(1, "Acmevol Foods", "acmevolfoods"), (2, "Zubolejux", "zubolejuxdental"), (3, None, "x"), (4, "Nobodyhere Media", "nobodyhere")], "board_id long, company string, token string").withColumn("kind", F.lit(1))
    posts = spark.createDataFrame(
        [(10, "Acmevol", "https://boards.lever.example/acmevolfoods/jobs/1", "Amber, FL"), (11, "on behalf of Zubolejux Dental LLC", "https://boards.lever.example/agency/jobs/2", None), (12, "", "u", None), (13, "Undisclosed client", None, None), (10, "Acmevol", "https://boards.lever.example/acmevolfoods/jobs/1", "Amber, FL")],
        "posting_id long, company_name string, url string, location_raw string",
    )
    firms = spark.createDataFrame([(100, "ACMEVOL FOODS INC.", "FL,OH", 5), (101, "Foods, Acmevol Inc.", None, None), (102, "Acmevol Shipping LLC", "NY", 9), (103, "Zubolejux Dental", "", 0), (104, None, None, None)], "employer_id long, display_name string, states string, certified int").withColumn("node", F.lit(1))
    got = {tuple(r) for r in found_links(boards, posts, firms).collect()}
    assert got == {("board", 1, 100), ("board", 1, 101), ("board", 2, 103), ("posting", 10, 100), ("posting", 10, 101), ("posting", 11, 103)}
    assert all(0 <= r.confidence <= 1 for r in link_confidence(boards, posts, firms).collect())
    assert found_links(boards.limit(0), posts.limit(0), firms.limit(0)).count() == 0
