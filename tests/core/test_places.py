import re

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.plans import catalog

from tests.core.test_packed import PLACES


def _key(place):
    low = place.strip(" ").lower()
    city = re.match(r"([^,]+),", low)
    city = city[1].strip(" ") if city else ""
    dashed = re.match(r"US-([A-Z]{2})-(.*)$", place.strip(" "))
    code = re.search(r",\s*([A-Z]{2})\b", place)
    rest = re.search(r",\s*([a-z ]+)", low)
    if re.match(r"remote\b", low):
        return "remote-us"
    if dashed and dashed[1] in tx.STATES.values():
        return f"{dashed[2].lower().replace('-', ' ')}|{dashed[1]}"
    if code and code[1] in tx.STATES.values():
        return f"{city}|{code[1]}"
    named = [n for n in tx.STATES if rest and rest[1].strip(" ").startswith(n)]
    return f"{city}|{tx.STATES[max(named, key=len)]}" if named else low


def test_place_values_have_every_value(spark, tmp_path):
    cases = PLACES | {"O'Penn Hills, TX": ["O'Penn Hills, TX"], "Remote;": ["Remote"], "Remote - US |": ["Remote - US"], "Amber, Texas and Brack, OH": ["Amber, Texas", "Brack, OH"], "Amber": ["Amber"], " ": [], None: []}
    rows = [(i, c) for i, c in enumerate(cases)]
    spark.createDataFrame(rows + rows[:3], "posting_id long, location_raw string").write.parquet(f"{tmp_path}/postings_raw.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["place_values"](spark, str(tmp_path)).collect())
    assert got == sorted((i, n, v, _key(v)) for i, values in enumerate(cases.values()) for n, v in enumerate(values, 1))


def test_place_values_leave_no_posting_out(spark):
    folder = "/root/testdata/sf0.01"
    got = catalog.QUERIES["place_values"](spark, folder).collect()
    said = spark.read.parquet(f"{folder}/postings_raw.parquet").filter(F.col("location_raw").rlike(r"\w")).select("posting_id").distinct().collect()
    assert {r.posting_id for r in said} == {r.posting_id for r in got}
    assert all(r.place == _key(r.item) for r in got)
