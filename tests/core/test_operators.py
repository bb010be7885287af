import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.udf import flat_text, token_set_ratio
from quern.operators import dedupe, employers as em, lexicon, listing
from quern.operators.components import components
from quern.plans import catalog
from quern.sources import landed, store


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "name, norm",
    [("Acme Holdings Inc LLC", "ACME HOLDINGS"), ("The Acme Data Solutions, Inc.", "ACME DATA"), ("Technology Solutions Group", "TECHNOLOGY SOLUTIONS"), ("Café & Co.", "CAFE AND"), ("INC", "INC"), ("The", ""), (None, ""), ("ACME USA Inc", "ACME")],
)
def test_employer_norm(spark, name, norm):
    assert one(spark, tx.employer_norm, name) == norm


def test_titles(spark):
    assert one(spark, tx.title_key, "Analyst, Business Intelligence (Remote) II") == one(spark, tx.title_key, "Business Intelligence Analyst")
    assert one(spark, tx.title_level, "Data Analyst - III") == "III"
    assert one(spark, tx.title_level, "Data Analyst") is None
    assert one(spark, tx.title_key, None) == ""


def test_texts(spark):
    assert one(spark, tx.sentences, "Based in the U.S. now. Apply!\n- one\n\n- two") == ["Based in the U.S. now.", "Apply!", "- one", "- two"]
    assert one(spark, tx.collapse, " a  b \n\n\n\n c ") == "a b\n\nc"
    assert one(spark, tx.numbers, "1,200 of 3.50 and 4.0") == ["1200", "3.50", "4"]
    assert one(spark, tx.iso_instant, "2026-09-09T10:50:29-04:00") == "2026-09-09T14:50:29Z"
    assert one(spark, tx.iso_instant, "nonsense") is None
    assert one(spark, lambda a, b: tx.camel_slug((a, 3), (b, 5)), "north data co", "senior analyst") == "NorthDataCoSeniorAnalyst"
    assert one(spark, tx.place_key, "Austin, Texas") == "austin|TX"
    assert one(spark, tx.institution_variants, "The Mill University (Main), Dunton")[0] == "Mill University (Main), Dunton"
    assert "Acme" in one(spark, tx.institution_variants, "Acme USA Inc")


def test_flat_text():
    assert flat_text("<p>A</p><ul><li>b</li></ul><script>x</script>") == "A\n\n- b"
    assert flat_text("&lt;p&gt;A &amp;amp; B&lt;/p&gt;", True) == "A & B"
    assert flat_text("<p>broken <b>markup") == "broken markup"
    assert flat_text(None) == ""


def test_similarity():
    assert token_set_ratio("ACME DATA", "DATA ACME CORP") == 100
    assert token_set_ratio("", "A") == 0
    assert 0 < token_set_ratio("ACME DATA", "ACNE DATE") < 100


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 2, "w")], "k string, o int, v string")
    assert sorted(map(tuple, dedupe.first_wins(df, ["k"], [F.col("o")]).collect()), key=str) == sorted([("a", 1, "y"), (None, 1, "z")], key=str)
    assert {r.v for r in dedupe.last_wins(df, ["k"], [F.col("o")]).collect()} == {"x", "w"}
    placed = dedupe.number_rows(spark.range(1000).repartition(7), [dedupe.desc(F.col("id"))], "place")
    assert all(r.place == 1000 - r.id for r in placed.collect())
    assert dedupe.number_rows(spark.range(0), [F.col("id")], "place").count() == 0
    got = dedupe.spread(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, o int"), F.col("g"), [F.col("o")], 2)
    assert [r.o for r in got.orderBy("place").collect()] == [1, 2, 4, 3]


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components(spark, at_once):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), in_one_task=at_once).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), in_one_task=at_once).count() == 0


def test_components_hub(spark):
    got = components(spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), in_one_task=0)
    assert got.filter("root = 0").count() == 3000


def _mergeable(a, b):
    if a == b:
        return True
    short, long_ = sorted((a, b), key=len)
    if len(short) < 2 or len(short) == len(long_) or all(t in em.GENERIC_WORDS for t in short):
        return False
    return long_[: len(short)] == short or (long_[-len(short) :] == short and all(t in em.GENERIC_WORDS for t in long_[: -len(short)]))


def test_affix_siblings_equal_brute_force(spark):
    names = ["Mill University", "Mill University in St Louis", "Trustees of the Mill University", "Kutz Mill University", "Medical Center", "Dunton Medical Center", "Duke 65", "Duke Energy", "Mill University", "Duke"]
    rows = [(f"N{i}", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "norm_name string, display_name string")
    words = {r.norm_name: tuple(r.w) for r in df.select("norm_name", tx.stem_words(tx.employer_norm(F.col("display_name"))).alias("w")).collect()}
    want = {(a, b) for a in words for b in words if a != b and _mergeable(words[a], words[b])}
    assert {(r.norm_name, r.sibling) for r in em.affix_siblings(df).collect()} == want and want


def test_match_names(spark):
    e = spark.createDataFrame([(n,) for n in ("ACME DATA", "CALM COM", "NORTH WIND U S", "NORTH WIND U S 2", "BLUE LAKE FOODS", "BLUE LAKE FARMS", "ABC ONE", "ABC TWO")], "norm_name string")
    n = spark.createDataFrame([(x,) for x in ("ACME DATA", "CALM", "NORTH WIND", "BLUE LAKE", "ZEBRA WORKS", "ABC")], "norm string")
    got = {r.norm: (r.method, r.names) for r in em.match_names(n, e).collect()}
    assert got["ACME DATA"] == ("exact", ["ACME DATA"])
    assert got["CALM"] == ("short-name", ["CALM COM"])
    assert got["NORTH WIND"] == ("sibling-entities", ["NORTH WIND U S", "NORTH WIND U S 2"])
    assert got["BLUE LAKE"] == ("ambiguous", [])
    assert got["ZEBRA WORKS"] == ("none", [])
    assert got["ABC"] == ("too-short", [])


def test_match_names_by_alias(spark):
    e = spark.createDataFrame([(n,) for n in ("ACME DATA", "CALM COM", "BLUE LAKE FOODS", "BLUE LAKE FARMS", "ORCHARD HOLDINGS")], "norm_name string")
    n = spark.createDataFrame([(x,) for x in ("ACME DATA", "CALM", "BLUE LAKE", "PEAR", "FIG WORKS")], "norm string")
    a = spark.createDataFrame([("ACME DATA", "CALM COM"), ("CALM", "ORCHARD HOLDINGS"), ("BLUE LAKE", "BLUE LAKE FARMS"), ("PEAR", "ORCHARD HOLDINGS"), ("FIG WORKS", "NO SUCH"), ("", "CALM COM")], "norm string, alias string")
    got = {r.norm: (r.method, r.names) for r in em.match_names(n, e, aliases=a).collect()}
    assert got == {"ACME DATA": ("exact", ["ACME DATA"]), "CALM": ("alias", ["ORCHARD HOLDINGS"]), "BLUE LAKE": ("alias", ["BLUE LAKE FARMS"]), "PEAR": ("alias", ["ORCHARD HOLDINGS"]), "FIG WORKS": ("none", [])}


def test_store_life(spark):
    held = spark.createDataFrame([("a", "b1", 1, 1, None), ("b", "b1", 1, 1, None), ("c", "b2", 1, 1, None), ("d", "b1", 1, 1, 1)], "id string, g string, first_seen int, last_seen int, closed_at int")
    fresh = spark.createDataFrame([("a", "b1"), ("d", "b1"), ("e", "b1")], "id string, g string")
    merged = listing.merge_runs(held, fresh, "id", F.lit(2))
    well = spark.createDataFrame([("b1",)], "g string")
    out = listing.close_missing(merged, fresh, well, "id", "g", F.lit(True), F.lit(2), F.lit(0))
    got = {r.id: (r.first_seen, r.last_seen, r.closed_at) for r in out.collect()}
    # b is gone, c's board failed, d is back, e is new
    assert got == {"a": (1, 2, None), "b": (1, 1, 2), "c": (1, 1, None), "d": (1, 2, None), "e": (2, 2, None)}
    again = listing.merge_runs(out, fresh, "id", F.lit(2))
    assert {r.id: r.closed_at for r in again.collect()}["b"] == 2
    stale = listing.close_missing(merged, fresh, well, "id", "g", F.lit(False), F.lit(2), F.lit(2))
    assert {r.id for r in stale.filter("closed_at is not null").collect()} == {"b", "c"}


def _folded(rows, ok, days, stale):
    """The store by merging and closing run by run."""
    store, reopened = {}, {}
    for r in sorted(days):
        fetched = {(g, k) for g, k, n in rows if n == r and (g, r) in ok and k is not None}
        for i in fetched:
            first, _, closed = store.get(i, (days[r], None, None))
            reopened[i] = reopened.get(i, 0) + (closed is not None)
            store[i] = (first, days[r], None)
        for i, (first, last, closed) in store.items():
            gone = last < days[r] - datetime.timedelta(stale) if i[0].startswith("workday:") else (i[0], r) in ok
            if i not in fetched and closed is None and gone:
                store[i] = (first, last, days[r])
    return {(*i, *v, reopened[i]) for i, v in store.items()}


def test_store_over_runs_equals_folding(spark):
    rng = random.Random(6)
    boards = ("lever:a", "ashby:b", "workday:c", "workday:d")
    days = {r: datetime.date(2026, 3, 2) + datetime.timedelta(7 * r) for r in range(1, 13)}
    ok = {(g, r) for g in boards for r in days if rng.random() < 0.8}
    rows = [(g, f"k{k}", r) for g in boards for k in range(40) for r in days if rng.random() < (0.1, 0.3, 0.7)[k % 3]]
    rows += rows[:50] + [(None, "k1", 1), ("lever:a", None, 1)]
    df = spark.createDataFrame(rows, "g string, k string, r int")
    well = spark.createDataFrame(sorted(ok), "g string, r int")
    runs = spark.createDataFrame([*days.items(), *days.items()], "r int, d date")
    got = [tuple(x) for x in listing.store_over_runs(df, well, runs, "g", "k", "r", "d", ~F.startswith("g", F.lit("workday:")), 21).collect()]
    want = _folded(rows, ok, days, 21)
    assert len(got) == len(want) and set(got) == want
    assert {x[0].split(":")[0] for x in want if x[4] is not None} == {x[0].split(":")[0] for x in want if x[5]} == {"lever", "ashby", "workday"}


def test_store_after_runs_takes_all_runs(spark):
    folder = "/root/testdata/sf0.01"
    r = spark.read.parquet(f"{folder}/run_reports.parquet").collect()
    s = spark.read.parquet(f"{folder}/posting_snapshots.parquet").select("source", "token", "site", "external_id", "run_no").collect()
    rows = {(":".join(p.strip().lower() for p in (x.source, x.token, x.site) if p and p.strip()), x.external_id.strip(" ") if x.external_id is not None else None, x.run_no) for x in s}
    want = _folded(rows, {(x.board_key.lower(), x.run_no) for x in r if x.status == "ok"}, {x.run_no: x.run_date for x in r}, 21)
    got = [tuple(x) for x in catalog.QUERIES["store_after_runs"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(x[5] for x in want) and any(x[0].startswith("workday:") and x[4] for x in want)


def test_lexicon(spark):
    lex = [("SQL", ["sql"], 3), ("R", ["r"], 1), ("C++", ["c++"], 2)]
    got = one(spark, lambda t: lexicon.terms_in(F.lower(t), lex), "Our SQL, C++ and postgresql")
    assert (got["names"], got["weight"]) == (["SQL", "C++"], 5)
    assert one(spark, lambda t: lexicon.term_hits(F.lower(t), ["sql"]), "sql sql nosql") == 2
    assert one(spark, lambda t: lexicon.first_term(t, ["b", "a"]), "ab") == "b"
    assert one(spark, lambda t: lexicon.term_hits(t, ["sql"]), None) == 0


def test_one_pass_finds_every_form(spark):
    lex = [("SQL", ["sql", "my-sql server"], 3), ("R", ["r"], 1), ("C++", ["c++", "++"], 2), ("Server", ["sql server", "server"], 5), ("My", ["my"], 7), ("None", [], 1)]
    for text in ("Our SQL, C++ and postgresql", "a ++ b", "(R)", "My-SQL Server", "mysql serverr", "", "é-r-é", "sql server", "my sql", None):
        low = (text or "").lower()
        want = [n for n, forms, _ in lex if any(re.search(rf"(?<![a-z0-9]){re.escape(f)}(?![a-z0-9])", low) for f in forms)]
        got = one(spark, lambda t: lexicon.terms_in(F.lower(t), lex), text)
        assert (got["names"], got["weight"]) == (want, sum(w for n, _, w in lex if n in want)), text


def test_skills_in_texts_by_alias(spark, tmp_path):
    spark.createDataFrame([(1, "Quillbase", 'quill.base|"quillbase & quilkit"', 3), (2, "Cobaltrank", None, 2)], "skill_id int, canonical string, aliases string, weight int").write.parquet(f"{tmp_path}/skills.parquet")
    spark.createDataFrame([(1, "knows Quill.Base"), (2, "cobaltrank and QUILLBASE"), (3, "quillxbase")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.names, r.weight) for r in catalog.QUERIES["skills_in_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: ("Quillbase", 3), 2: ("Quillbase; Cobaltrank", 5), 3: ("", 0)}


def test_landed_payloads(spark):
    def land(body):
        return spark.createDataFrame([("tok", "Acme", json.dumps(body)), ("bad", "B", "not json")], landed.LANDED)

    rows = landed.postings(land({"jobs": [{"id": 5, "title": "T", "content": "&lt;p&gt;", "location": {"name": "X"}, "updated_at": "2026-09-09T10:50:29-04:00", "departments": [{"name": "D"}]}]}), "greenhouse").collect()
    assert [(r.external_id, r.department, r.posted_at, r.posted_at_source, r.double_escaped) for r in rows] == [("5", "D", "2026-09-09T14:50:29Z", "updated_at", True)]
    rows = landed.postings(land([{"id": "x", "text": "T", "createdAt": 0, "descriptionPlain": "", "description": "<p>h</p>", "categories": {"team": "", "department": "D"}}]), "lever").collect()
    assert [(r.description_html, r.description_text, r.department, r.posted_at) for r in rows] == [("<p>h</p>", None, "D", "1970-01-01T00:00:00Z")]
    rows = landed.postings(land({"jobs": [{"id": "a", "isListed": False}, {"id": "b"}]}), "ashby").collect()
    assert [(r.external_id, r.url) for r in rows] == [("b", "https://jobs.ashbyhq.com/tok/b")]
    listed = landed.postings(land({"content": [{"id": "1", "name": "N", "location": {"city": "C", "country": "co"}}], "totalFound": 1}), "smartrecruiters")
    details = spark.createDataFrame([("tok", "1", json.dumps({"jobAd": {"sections": {"jobDescription": {"text": "J"}, "qualifications": {"text": "Q"}}}}))], "token string, external_id string, body string")
    got = landed.with_details(listed, details, "smartrecruiters").first()
    assert (got.location_raw, got.description_html) == ("C, co", "J\n\nQ")
    listed = landed.postings(land({"jobPostings": [{"externalPath": "/p"}, {"externalPath": "/p"}, {"title": "none"}], "total": 2}), "workday")
    assert listed.count() == 1
    assert [r.token for r in landed.unreadable(land({"jobs": []}), "greenhouse").collect()] == ["bad"]
    assert {r.token: r.verdict for r in landed.probes(land({"jobs": []}), "greenhouse").collect()}["tok"] == "empty"


def test_store_files(spark, tmp_path):
    path = str(tmp_path / "jobs.json")
    schema = "id string, v int"
    assert store.read_store(spark, path, schema).count() == 0
    store.write_store(spark.createDataFrame([("b", 1), ("a", 2)], schema), path)
    store.write_store(spark.createDataFrame([("b", 3), ("a", 4)], schema), path)
    assert [tuple(r) for r in store.read_store(spark, path, schema).orderBy("id").collect()] == [("a", 4), ("b", 3)]
    line = tmp_path / "dup.json"
    line.write_text('{"id":"a","v":1}\n\n{"id":"a","v":2}\n')
    assert [tuple(r) for r in store.read_store(spark, str(line), schema).collect()] == [("a", 2)]
    line.write_text('{"id":"a"\n')
    with pytest.raises(Exception):
        store.read_store(spark, str(line), schema).collect()
    csv = str(tmp_path / "t.csv")
    store.write_csv(spark.createDataFrame([('q"x\ny', 1)], "a string, b int"), csv, all_quoted=True)
    assert [tuple(r) for r in store.read_csv(spark, csv, "a string, b int, c string").collect()] == [('q"x\ny', 1, None)]
