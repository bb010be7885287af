import pytest
from pyspark.sql import functions as F

from quern.operators.packed import AND_COUNTRIES, found_packed, split_packed, unpack

PLACES = {
    "Amber, FL": ["Amber, FL"],
    "Amber, FL;": ["Amber, FL"],
    "Amber, FL; ; Brack, OH": ["Amber, FL", "Brack, OH"],
    "Amber, FL; and Brack, OH": ["Amber, FL", "Brack, OH"],
    "Amber, FL, Brack, OH, and Coble, WI": ["Amber, FL", "Brack, OH", "Coble, WI"],
    "Amber, OR or Brack, OR & Coble, WI + Dun, OR": ["Amber, OR", "Brack, OR", "Coble, WI", "Dun, OR"],
    "Bosnia and Herzegovina and Amber, FL": ["Bosnia and Herzegovina", "Amber, FL"],
    "Remote (TX; OK; UT)|Amber, FL": ["Remote (TX; OK; UT)", "Amber, FL"],
    "Amber, FL (2 days/week) / Remote (US / Canada)": ["Amber, FL (2 days/week)", "Remote (US / Canada)"],
    '["Amber, FL", "Brack, OH"]': ["Amber, FL", "Brack, OH"],
    '"Amber ""Old Mill"", FL";"Brack, OH"': ['Amber "Old Mill", FL', "Brack, OH"],
    "'Amber, FL', 'Brack, OH'": ["Amber, FL", "Brack, OH"],
    "O'Penn Hills, UT|Amber, FL": ["O'Penn Hills, UT", "Amber, FL"],
    "Coble-on-Wick, CO": ["Coble-on-Wick, CO"],
    "US-AL-Amber\tBrack, OH": ["US-AL-Amber", "Brack, OH"],
    'Suite "B, FL': ['Suite "B, FL'],
    "   ": [],
    "": [],
    None: [],
}


@pytest.mark.parametrize("text", PLACES)
def test_places(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(unpack(F.col("t"))).first()[0] == PLACES[text]


def test_lists(spark):
    df = spark.createDataFrame([('a; "b; c" | d,e/f\n"g/h"',), ("x",)], "t string")
    assert [r[0] for r in df.select(unpack(F.col("t"), "list")).collect()] == [["a", "b; c", "d", "e", "f", "g/h"], ["x"]]


@pytest.mark.parametrize("country", AND_COUNTRIES)
def test_countries_stay_whole(spark, country):
    df = spark.createDataFrame([(f"{country}; Amber, FL",)], "t string")
    assert df.select(unpack(F.col("t"))).first()[0] == [country, "Amber, FL"]


def test_long_text(spark):
    text = "; ".join(f"City{i}, FL" for i in range(5000))
    df = spark.createDataFrame([(text,)], "t string")
    assert len(df.select(unpack(F.col("t"))).first()[0]) == 5000


def test_rows_keep_columns_and_clashes(spark):
    df = spark.createDataFrame([(1, "a|b", 9, "old"), (1, "a|b", 9, "old")], "id int, v string, pos int, item string")
    out = split_packed(df, "v", "list")
    assert out.columns == ["id", "v", "pos", "item"]
    assert sorted((r.pos, r.item) for r in out.collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]


def test_found_has_packed_fields_once(spark):
    posts = spark.createDataFrame([(1, "A, FL|B, OH"), (1, "A, FL|B, OH"), (2, "A, FL"), (3, None)], "posting_id long, location_raw string")
    skills = spark.createDataFrame([(7, "x; y"), (8, "z"), (9, None)], "skill_id int, aliases string")
    got = sorted(tuple(r) for r in found_packed(posts, skills).collect())
    assert got == [("alias", 7, 1, "x"), ("alias", 7, 2, "y"), ("location", 1, 1, "A, FL"), ("location", 1, 2, "B, OH")]
    assert found_packed(posts.limit(0), skills.limit(0)).count() == 0
