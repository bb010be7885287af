"""Column builders for places: what country a place is in, its canonical name, and all places of a listing.

The words that make a place foreign or domestic are parameters; the names and
codes of all countries come from the Java runtime's own table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession, functions as F

from quern.functions.text import STATES

# What marks a place as domestic, as saying nothing, as remote or hybrid, and a company's word for its own site.
US_MARKER = r"(?:u\.?s\.?a?|united states|america)"
UNINFORMATIVE = r"(?i)^\d+\s+locations?$|^multiple locations?$|^various"
REMOTE = r"(?i)\bremote\b|\bwork from home\b|\banywhere\b|\bdistributed\b"
HYBRID = r"(?i)\bhybrid\b"
SITE = r"\s+(?:office|hq|headquarters|campus|site|hub|center|centre)$"
#: Names of a country and a state.
AMBIGUOUS = ("georgia",)


def country_words(spark: SparkSession) -> tuple[list[str], list[str]]:
    """Names and two-letter codes, in lower case, of all countries but the United States."""
    locale = spark.sparkContext._jvm.java.util.Locale
    codes = [c for c in locale.getISOCountries() if c != "US"]
    return [locale("", c).getDisplayCountry(locale.ENGLISH).lower() for c in codes], [c.lower() for c in codes]


def _any(words: Iterable[str], edge: str = "a-z") -> str:
    body = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return rf"(?<![{edge}])(?:{body})(?![{edge}])" if body else r"(?!)"


def split_places(text: Column) -> Column:
    """The places of a text by its delimiters, trimmed, without empty ones."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\s*[;|]\s*|\s+/\s+|\s+and\s+|\s*•\s*")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def classify_place(place: Column, foreign: Iterable[str], codes: Iterable[str] = (), cities: Iterable[str] = ()) -> Column:
    """'us', 'foreign' or 'unknown'.

    In order: a text that says nothing; a mark of the United States; a foreign
    name, unless it is also a state's and something else is domestic; a country's
    code at the end that is no state's; a state's name or code; a known city.
    """
    low = F.regexp_replace(F.regexp_replace(F.lower(place), r"(?U)^\s+|\s+$", ""), r"^[,.]+|[,.]+$", "")
    cities = list(cities)
    state = place.rlike(_any(STATES.values(), "A-Za-z"))
    american = low.rlike(_any(cities)) | state
    both = [w for w in foreign if w in AMBIGUOUS]
    tail = F.trim(F.element_at(F.split(low, ","), -1))
    head = F.trim(F.split(low, ",")[0])
    known = lambda c: c.isin(cities) if cities else F.lit(False)
    return (
        F.when((low == "") | low.rlike(UNINFORMATIVE), "unknown")
        .when(low.rlike(rf"(?<![a-z]){US_MARKER}(?![a-z])"), "us")
        .when(low.rlike(_any(w for w in foreign if w not in AMBIGUOUS)), "foreign")
        .when(low.rlike(_any(both)), F.when(american, "us").otherwise("foreign"))
        .when(tail.isin([c for c in codes if c.upper() not in STATES.values()]), "foreign")
        .when(low.rlike(_any(STATES)) | state | known(head) | known(F.regexp_replace(head, SITE, "")), "us")
        .otherwise("unknown")
    )


def canonical_place(place: Column) -> Column:
    """``city|ST``, ``city``, ``remote-us`` or ``remote-st``; a state's name goes before a code, and names in the order of the list."""
    low = F.regexp_replace(F.lower(place), r"(?U)^\s+|\s+$", "")
    named = F.coalesce(*[F.when(low.rlike(_any([n])), code) for n, code in STATES.items()])
    code = F.regexp_extract(place, r"(?<![A-Za-z])([A-Z]{2})(?![A-Za-z])", 1)
    code = F.coalesce(named, F.when(code.isin(sorted(STATES.values())), code))
    city = F.lower(F.trim(F.split(place, r"[,(]")[0]))
    city = F.regexp_replace(F.regexp_replace(city, r"\bremote\b|\bhybrid\b", ""), r"^[ \-,]+|[ \-,]+$", "")
    city = F.when(city.rlike(rf"^{US_MARKER}$"), "").otherwise(city)
    return F.when(city == "", F.concat(F.lit("remote-"), F.coalesce(F.lower(code), F.lit("us")))).when(code.isNotNull(), F.concat(city, F.lit("|"), code)).otherwise(city)


def parse_places(raw: Column, extra: Column | None = None, description: Column | None = None, preferred: Iterable[str] = (), **words) -> Column:
    """``locations, is_us, is_remote, is_hybrid, primary, confidence, preferred`` of a listing's places.

    A remote listing without any country is domestic, of low confidence, if its
    description's first 4,000 characters name the United States or a state's code.
    """
    parts = split_places(raw)
    if extra is not None:
        parts = F.concat(parts, F.flatten(F.transform(F.coalesce(extra, F.array().cast("array<string>")), split_places)))
    joined = F.array_join(parts, " ; ")
    kinds = F.transform(parts, lambda p: F.struct(p.alias("p"), classify_place(p, **words).alias("k")))
    ours = F.filter(kinds, lambda x: x["k"] == "us")
    has_us, has_foreign, remote = F.size(ours) > 0, F.exists(kinds, lambda x: x["k"] == "foreign"), joined.rlike(REMOTE)
    said = F.lit(False)
    if description is not None:
        head = F.substring(F.coalesce(description, F.lit("")), 1, 4000)
        said = ~has_us & ~has_foreign & remote & (head.rlike(r"\b(?:United States|U\.S\.|USA)\b") | head.rlike(rf"\b(?:{'|'.join(sorted(STATES.values()))})\b"))
    first = F.get(ours, F.lit(0))["p"]
    primary = F.when(has_us, canonical_place(first)).when(said, "remote-us").otherwise("unknown")
    wanted = F.lower(first).rlike("|".join(re.escape(c.lower()) for c in preferred)) if preferred else F.lit(False)
    return F.struct(
        F.array_distinct(parts).alias("locations"),
        (has_us | said).alias("is_us"),
        remote.alias("is_remote"),
        joined.rlike(HYBRID).alias("is_hybrid"),
        primary.alias("primary"),
        F.when(said | (~has_us & ~has_foreign), "low").otherwise("high").alias("confidence"),
        F.coalesce(wanted, F.lit(False)).alias("preferred"),
    )


def place_text(primary: Column) -> Column:
    """A canonical place as people read it: 'austin|TX' becomes 'Austin, TX'."""
    text = F.coalesce(primary, F.lit(""))
    parts = F.array(F.initcap(F.trim(F.split_part(text, F.lit("|"), F.lit(1)))), F.upper(F.regexp_replace(text, r"^[^|]*\|?", "")))
    return F.array_join(F.filter(parts, lambda x: x != ""), ", ")
