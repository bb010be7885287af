import datetime
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import places, text as tx
from quern.functions.udf import flat_text
from quern.operators import dedupe, employers as em, lexicon, people as pe, tracking as tr
from quern.plans import tracking as plans
from quern.sources import landed, store


def each(spark, f, *texts):
    """The results of a column builder for several texts."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_entities_and_accents(spark):
    assert each(spark, tx.unescape, "a &amp; b", "&#8217;x&#xE9;", "&eacute;t&eacute;", "R&D", "&nosuch; &amp", None, "&#0;&#99999999;", "&amp;lt;") == ["a & b", "’xé", "été", "R&D", "&nosuch; &amp", None, "&#0;&#99999999;", "&lt;"]
    assert each(spark, tx.simple_key, "Việt Nam Foods, Inc", "Ｌabs", "ﬁne Œuvre", "Łódź") == ["VIET NAM FOODS INC", "LABS", "FINE UVRE", "ODZ"]
    assert each(spark, tx.title_norm, "Analyst&#8217;s &ndash; R&amp;D", "  A B ") == ["analyst's - r&d", "a b"]
    assert each(spark, tx.title_level, "Analyst I", "Analyst 1", "Analyst II", "Analyst, IV", "Analyst") == [None, None, "II", "IV", None]
    assert each(spark, tx.level_penalty, "Analyst I", "Analyst 2", "Analyst III", None) == [0, -4, -8, 0]
    assert flat_text("<p>a &amp;lt; b</p>") == "a < b"
    assert flat_text("<p>a &amp;amp; b</p>") == "a & b"


TERMS = [("security analyst", "N"), ("chemist", "N"), ("operations analyst", "A"), ("data analyst", "A"), ("new grad", "C"), ("coordinator", "B")]


@pytest.mark.parametrize(
    "title, want",
    [
        ("security operations analyst", ("N", "security operations analyst")), ("biochemistry lab chemist", ("N", "chemist")), ("data analyst", ("A", "data analyst")), ("data analyst, claims", ("A", "data analyst")),
        ("senior data analyst", ("A-partial", "data analyst")), ("business operations analyst", ("A-partial", "operations analyst")), ("new grad data analyst", ("A-partial", "data analyst")), ("new grad, reporting", ("C", "new grad")),
        ("new grad nurse", (None, None)), ("office coordinator", ("B", "coordinator")), ("plumber", (None, None)), ("", (None, None)),
    ],
)
def test_title_tier(spark, title, want):
    assert tuple(each(spark, lambda t: lexicon.title_tier(t, TERMS), title)[0]) == want


def test_no_terms(spark):
    assert tuple(each(spark, lambda t: lexicon.title_tier(t, []), "x")[0]) == (None, None)


def _years(text):
    low, best = (text or "").lower(), None
    for m in re.finditer(r"(\d{1,2})\s*\+?\s*(?:-\s*(\d{1,2})\s*)?(?:years?|yrs?)", low):
        near = low[max(0, m.start() - 80) : m.end() + 80]
        if "experience" in near and not re.search("years? of (education|schooling)", near) and int(m[1]) <= 20:
            best = int(m[1]) if best is None else min(best, int(m[1]))
    return best


def test_years_required(spark):
    texts = ["3+ years of SQL experience, 5+ years preferred", "the last 10 years of data" + " x" * 60 + " experience", "5 years of schooling and experience", "3 - 5 yrs experience", "100 years of experience", "25 years experience", "2 years " * 40 + "experience", "", None]
    assert each(spark, tx.years_required, *texts) == [_years(t) for t in texts]


FOREIGN = ["canada", "australia", "georgia", "melbourne", "mexico"]


@pytest.mark.parametrize(
    "place, want",
    [
        ("Melbourne, Florida, United States", "us"), ("Melbourne", "foreign"), ("Georgia - Atlanta", "us"), ("Tbilisi, Georgia", "foreign"), ("Atlanta, GA", "us"), ("Wuxi, Jiangsu, cn", "foreign"), ("Charleston, SC", "us"),
        ("3 Locations", "unknown"), ("Austin HQ", "us"), ("austin", "us"), ("Nowhere", "unknown"), ("", "unknown"), ("Remote (US)", "us"), ("Albuquerque, New Mexico", "foreign"),
    ],
)
def test_classify_place(spark, place, want):
    assert each(spark, lambda p: places.classify_place(p, FOREIGN, ["cn", "ga", "ca"], ["austin", "atlanta"]), place) == [want]


@pytest.mark.parametrize("place, want", [("Austin, TX", "austin|TX"), ("Washington, DC", "washington|WA"), ("Remote - US", "remote-us"), ("US-Remote", "remote-us"), ("Remote, Texas", "remote-tx"), ("Austin (Hybrid)", "austin"), ("Kansas City, Missouri", "kansas city|KS")])
def test_canonical_place(spark, place, want):
    assert each(spark, places.canonical_place, place) == [want]


def test_parse_places(spark):
    df = spark.createDataFrame([("Remote", None, "We are in the USA"), ("Toronto, Canada; Austin, TX | Hybrid", ["Austin, TX"], None), (None, None, None), ("Remote", [], "nothing")], "l string, x array<string>, d string")
    got = [r[0] for r in df.select(places.parse_places(F.col("l"), F.col("x"), F.col("d"), ["austin"], foreign=FOREIGN)).collect()]
    assert (got[0].is_us, got[0].primary, got[0].confidence, got[0].is_remote) == (True, "remote-us", "low", True)
    assert (got[1].is_us, got[1].primary, got[1].is_hybrid, got[1].preferred, got[1].locations) == (True, "austin|TX", True, True, ["Toronto, Canada", "Austin, TX", "Hybrid"])
    assert (got[2].is_us, got[2].primary, got[2].confidence, got[2].locations) == (False, "unknown", "low", [])
    assert not got[3].is_us
    names, codes = places.country_words(spark)
    assert "canada" in names and "ca" in codes and "us" not in codes and len(names) == len(codes) > 200
    assert each(spark, places.place_text, "austin|TX", "remote-us", "new york|", None) == ["Austin, TX", "Remote-us", "New York", ""]


def test_names_of_boards(spark):
    assert each(spark, tx.slug_candidates, "Global Data Solutions LLC", "Acme Data, Inc.", "ABC", None)[1:] == [["acmedata", "acme-data", "acme"], [], []]
    assert each(spark, lambda t: tx.site_names(t, ("External", "{T}_{t}{U}")), "acme") == [["External", "Acme_acmeACME"]]
    assert each(spark, tx.plain_company, "Gusto, Inc.", "Amazon (United States)") == ["Gusto", "Amazon"]
    assert each(spark, tx.occupation_base, " 15-2051.01 ", "15-2051", None, "x.y") == ["15-2051", "15-2051", "", "X"]
    assert each(spark, lambda t: tx.pick_name(t, F.lit("Acme")), "unknown", "Real", "", None) == ["Acme", "Real", "Acme", "Acme"]
    assert each(spark, tx.is_slug, "Ab-1", "../x", "", None) == [True, False, False, False]
    with pytest.raises(ValueError):
        landed.require_tokens(landed.crawl_tokens(spark.createDataFrame([("https://x/robots.txt",)], "url string"), "lever"))


def test_filings(spark):
    files = spark.createDataFrame([("D_FY2024_Q1.xlsx", "a"), ("D_FY2024_Q4.xlsx", "b"), ("D_FY2025_Q2.xlsx", "c"), ("D_FY2023.xlsx", "d"), ("other", "e")], "name string, url string")
    assert [(r.fiscal_year, r.quarter, r.url) for r in em.latest_files(files).collect()] == [(2025, 2, "c"), (2024, 4, "b")]
    rows = spark.createDataFrame([("Certified - Withdrawn", "15-2051.00"), ("CERTIFIED", "11-1111"), ("Denied", "15-2051"), (None, None)], "s string, o string")
    got = rows.select(*[c.alias(k) for k, c in em.filing_counts(F.col("s"), F.col("o"), ("15-2051",)).items()]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_paste(spark):
    text = "Name\tTitle\tCompany\nAda Low\tAnalyst\tAcme\t2012\nBo Ray bo@x.org HR Analyst at Large at ABB\nconnect\nshowing 1-20 of 312 results\nCy Dee, Manager at Acme\n\n"
    df = spark.createDataFrame([(1, text, "clash"), (2, None, "c"), (3, "", "c")], "id int, text string, name string")
    got = [tuple(r) for r in pe.parse_paste(df).orderBy("line_no").collect()]
    assert got == [(1, 2, "Ada Low", "Analyst", "Acme", "2012", ""), (1, 3, "Bo Ray", "HR Analyst at Large", "ABB", "", "bo@x.org"), (1, 6, "Cy Dee", "Manager", "Acme", "", "")]
    assert each(spark, pe.column_for, "First Name", "E-mail Address", "Job_Title", "Class Of", "shoe") == ["first_name", "email", "job_title", "grad_year", ""]
    assert tuple(each(spark, pe.split_role, "Manager at Large at Acme")[0]) == ("Manager at Large", "Acme")
    assert pe.missing_columns(["a"], ["b", "a"]) == ["b"]


def test_mark_known(spark):
    rows = spark.createDataFrame([(1, "a", ""), (2, "a", None), (3, "b", ""), (4, "c", "status is sent"), (5, "c", ""), (6, None, "")], "i int, k string, skip string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    got = {r.i: r.skip for r in pe.mark_known(rows, "k", [F.col("i")], keys("b", "b"), keys("c")).collect()}
    assert got == {1: "", 2: "listed twice", 3: "in the ledger", 4: "status is sent", 5: "in the backup", 6: ""}


def test_with_openings(spark):
    people = spark.createDataFrame([(1, "Acme Data Inc"), (2, "The Mill University (Main)"), (3, None), (4, "Nobody")], "id int, org string")
    openings = spark.createDataFrame([("ACME DATA", f"t{i}", i) for i in range(9)], "company string, title string, rank int")
    index = spark.createDataFrame([("MILL UNIVERSITY", 5, 2)], "form string, certified int, analyst_certified int")
    got = {r.id: (r.roles, r.certified) for r in pe.with_openings(people, "id", "org", openings, index).collect()}
    assert got == {1: (["t0", "t1", "t2", "t3"], None), 2: ([], 5), 3: ([], None), 4: ([], None)}


def test_trackers(spark):
    held = spark.createDataFrame([("a", "x", None), ("b", "y", "p")], "k string, status string, process string")
    new = spark.createDataFrame([("b", "z", "q"), ("c", "w", None)], "k string, status string, process string")
    assert {tuple(r) for r in tr.merge_backup(held, new, "k").collect()} == {("a", "x", None), ("b", "y", "p"), ("c", "w", None)}
    changes = spark.createDataFrame([("a", ""), ("d", "new")], "k string, status string")
    assert {tuple(r) for r in tr.patch(held, changes, "k", ["status", "process"]).collect()} == {("b", "y", "p"), ("d", "new", None)}
    left = spark.createDataFrame([(1, "u1", "s1"), (2, "", "s1"), (3, None, None)], "id int, u string, s string")
    right = spark.createDataFrame([("u1", "s9", 7), ("u1", "s9", 5), ("u2", "s1", 6)], "ru string, rs string, v int")
    got = {r.id: r.v for r in tr.joined_by_any(left, right, "id", [("u", F.col("u"), F.col("ru")), ("s", F.col("s"), F.col("rs"))], "v").collect()}
    assert got == {1: 5, 2: 6, 3: None}
    assert sorted(r.k for r in tr.without(held, new, key="k").collect()) == ["a"]
    assert each(spark, lambda t: tr.fallback_key(("id", F.lit("")), ("url", t)), "u", " ") == ["url:u", None]
    assert each(spark, lambda t: tr.search_score(F.lower(t), F.lit("Data team")), "A data TEAM", "data", "") == [100.0, 50.0, 0.0]


def test_times_and_rates(spark):
    now = F.lit("2026-05-10T12:00:00Z").cast("timestamp")
    assert each(spark, lambda t: tr.age_days(F.try_to_timestamp(t), now), "2026-05-09T12:00:01Z", "2026-05-01T12:00:00Z", "2027-01-01T00:00:00Z", "soon") == [0, 9, 0, None]
    rows = spark.createDataFrame([("p", i < 3, i == 0) for i in range(4)] + [("q", True, True)] * 2 + [("r", True, False)] * 3, "pool string, sent boolean, replied boolean")
    got = {r.pool: (r.sent, r.replied, r.rate, r.best) for r in tr.reply_rates(rows, "pool", F.col("sent"), F.col("replied")).collect()}
    assert got == {"p": (3, 1, 33, True), "q": (2, 2, 100, False), "r": (3, 0, 0, False)}
    day = datetime.date(2026, 5, 1)
    got = {r.i: (str(r.followup), r.due) for r in tr.followups(spark.createDataFrame([(1, day), (2, None)], "i int, sent date"), "sent", F.lit(False), 7, F.lit("2026-05-08").cast("date")).collect()}
    assert got == {1: ("2026-05-08", True), 2: ("None", False)}


@pytest.mark.parametrize("salts", [1, 5])
def test_spread_of_a_hot_group(spark, salts):
    rows = [("hot", i) for i in range(200)] + [(None, 300 + i) for i in range(5)] + [("x", 400)]
    got = [r.o for r in dedupe.spread(spark.createDataFrame(rows, "g string, o int"), F.col("g"), [F.col("o")], 2, salts).orderBy("place").collect()]
    first = [0, 1, 300, 301, 400]
    assert got == first + [o for _, o in rows if o not in first]


def test_sinks(spark, tmp_path):
    cards = spark.createDataFrame([("1", "open", "lever", "x"), ("2", "closed", "ashby", "y"), ("3", None, "lever", "z")], "id string, status string, source string, text string")
    store.publish(cards, str(tmp_path / "pub"), slim=("text",))
    read = lambda n: spark.read.json(str(tmp_path / "pub" / n)).collect()
    assert [r.id for r in read("open")] == ["1"] and sorted(r.asDict().keys() for r in read("filtered"))[0] == {"id", "source"}.union({"status"})
    assert (read("meta")[0].total, read("meta")[0].closed, read("meta")[0].sources) == (3, 1, ["ashby", "lever"])
    store.write_top(spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "k string, n int"), str(tmp_path / "top"), "n", "k", 2)
    assert sorted(r.k for r in store.read_csv(spark, str(tmp_path / "top"), "k string, n int").collect()) == ["b", "c"]
    for name, rows in (("one", [("i1", "Ada", "X"), (None, "Bo", "Y"), ("i3", " ", "Z")]), ("two", [("i1", "Ada L", "X")])):
        store.write_csv(spark.createDataFrame(rows, "id string, person string, org string"), str(tmp_path / name), compressed=False)
    import os

    os.utime(tmp_path / "one", (1, 1))
    got = store.read_contacts(spark, [str(tmp_path / n) for n in ("one", "two", "missing")], "id string, person string, org string", "id", "person", "org").collect()
    assert sorted((r.id, r.person) for r in got) == [("Bo|Y", "Bo"), ("i1", "Ada L")]


def test_queries_on_empty_tables(spark, tmp_path):
    for name in ("postings_raw", "titles", "queue_entries", "contacts", "employers", "employer_aggs", "boards", "skill_entries", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("run_reports", "skills"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, f in plans.QUERIES.items():
        rows = f(spark, str(tmp_path)).collect()
        if name == "queue_counts":  # a total over all rows: one row of zeros
            assert [set(r) for r in rows] == [{0}]
        else:
            assert rows == [], name


def test_ledgers_and_sheets(spark, tmp_path):
    from quern.sources import ledger

    at = lambda n: str(tmp_path / n)
    assert ledger.read_aliases(spark, at("none")).count() == 0 and ledger.read_ledger(spark, at("none")).count() == 0 and ledger.read_backup(spark, [at("none")]).count() == 0
    (tmp_path / "aliases.csv").write_text("company,employer\nAcme Inc.,Orchard Holdings LLC\n,x\n")
    assert [tuple(r) for r in ledger.read_aliases(spark, at("aliases.csv")).collect()] == [("ACME", "ORCHARD HOLDINGS")]
    people = spark.createDataFrame([("Ada, L", "Acme", "A@x.org"), ("Bo", "ABB", None)], "name string, company string, email string")
    ledger.append_ledger(people, at("ledger"), "2026-05-01")
    ledger.append_ledger(people.limit(1), at("ledger"), "2026-05-09")
    assert {(r.key, r.name, r.sent) for r in ledger.read_ledger(spark, at("ledger")).collect()} == {("a@x.org", "Ada, L", "2026-05-09"), ("bo|abb", "Bo", "2026-05-01")}
    (tmp_path / "b.json").write_text('{"sent": [{"name": "Cy", "company": "X"}], "dead": null}')
    assert [r.key for r in ledger.read_backup(spark, [at("b.json"), at("none")]).collect()] == ["cy|x"]
    (tmp_path / "sheet.csv").write_text('My list,,\nFirst Name,Employer,Status\nAda,"Acme, Inc",sent\n,,\nBo,ABB,\n')
    assert [(r.row, r.first_name, r.company, r.skip) for r in ledger.read_sheet(spark, at("sheet.csv")).orderBy("row").collect()] == [(3, "Ada", "Acme, Inc", "status is sent"), (5, "Bo", "ABB", "")]
    (tmp_path / "bad.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        ledger.read_sheet(spark, at("bad.csv"))
    text = ledger.batch_text(people, ("company", "email"))
    got = ledger.read_batch(text.select(F.concat("text", F.lit("Dear friend,\n\nhello")).alias("text")), ("company", "email")).collect()
    assert sorted(tuple(r) for r in got) == [("Ada, L", "Acme", "A@x.org", "Dear friend,\n\nhello"), ("Bo", "ABB", "", "Dear friend,\n\nhello")]
    ledger.write_template(spark, at("t"))
    assert spark.read.csv(at("t")).first()[0] == "first_name"


def test_probes_and_works(spark):
    import json

    from quern.sources import ledger

    wanted = spark.createDataFrame([("Acme", "lever", "acme", 1), ("Acme", "ashby", "acme", 1), ("Bolt", "lever", "bolt", 1)], "company string, source string, slug string, slug_no int")
    held = spark.createDataFrame([("Acme", "lever", "acme", "confirmed", 3, "Zebra Works", ""), ("Acme", "ashby", "acme", "confirmed", 3, None, "")], ledger.PROBES)
    known, todo = ledger.split_probes(wanted, held)
    assert [r.company for r in todo.collect()] == ["Bolt"]
    named = ledger.named_probes(known)
    assert {(r.source, r.verdict) for r in named.collect()} == {("lever", "name-mismatch"), ("ashby", "confirmed")}
    assert [tuple(r) for r in ledger.first_confirmed(named, ("lever", "ashby")).collect()] == [("Acme", "ashby", "acme")]
    body = {"results": [{"id": "w", "title": "t", "publication_date": "2026-01-01", "authorships": [{"author_position": p, "author": {"id": p, "display_name": p.upper(), "orcid": None}, "institutions": [{"display_name": "I", "country_code": c, "type": "education"}]} for p, c in (("first", "US"), ("middle", "US"), ("last", "DE"))]}]}
    df = spark.createDataFrame([("t", "c", json.dumps(body)), ("t", "c", "bad")], landed.LANDED)
    assert [(r.author, r.institution) for r in landed.authorships(df).collect()] == [("first", "I")]
    assert landed.types_for("academic, nonprofit") == ("education", "healthcare", "nonprofit") and landed.types_for("any") == () and landed.types_for("x") == ("company", "nonprofit")
    rows = spark.createDataFrame([("acme", "7"), ("acme", "8")], "token string, external_id string")
    assert [r.external_id for r in landed.one_posting(rows, "https://boards.lever.example/Acme/jobs/8?x=1").collect()] == ["8"]
