"""People from pasted text and sheets, and what is known of them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.text import institution_variants, simple_key

# A sheet's columns, and what people write for them.
COLUMNS = ("first_name", "last_name", "job_title", "company", "email", "grad_year", "linkedin", "location", "status", "sent", "followup", "notes")
HEADINGS = {
    "first": "first_name", "firstname": "first_name", "fname": "first_name", "last": "last_name", "lastname": "last_name", "surname": "last_name", "lname": "last_name",
    "name": "first_name", "fullname": "first_name", "title": "job_title", "jobtitle": "job_title", "role": "job_title", "position": "job_title",
    "organisation": "company", "organization": "company", "employer": "company", "org": "company", "emailaddress": "email", "mail": "email", "e": "email",
    "class": "grad_year", "year": "grad_year", "gradyear": "grad_year", "graduationyear": "grad_year", "classof": "grad_year",
    "linkedinurl": "linkedin", "profile": "linkedin", "followupdue": "followup", "followupdate": "followup", "datesent": "sent", "sentdate": "sent",
}
# Statuses of a sheet's row that has been dealt with.
DONE = ("sent", "replied", "dead", "drafted")
# Lines of a directory page that are nobody, words of a table's heading, and the forms of an address and a year.
NOISE = re.compile(
    r"(?:\d+(?:st|nd|rd|th)(?:\s*degree)?|connect|message|follow|view profile|shared connections?|[·•|]|see more|load more|results?|next|previous|"
    r"showing\b.*|page \d+(?:\s+of\s+\d+)?|\d+\s+results?(?:\s+found)?|sort by\b.*|filters?|clear all)",
    re.I,
)
HEADING_WORDS = frozenset(
    "name names fullname full first last firstname lastname title titles role roles position job company companies employer organisation organization org "
    "class year grad graduation email emails address contact phone location city state country degree degrees program major industry function level".split()
)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
YEAR = re.compile(r"19[5-9]\d|20[0-4]\d")


def heading_key(heading: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), "[^a-z0-9]", "")


def column_for(heading: Column) -> Column:
    """The sheet column that a heading means, empty if none."""
    known = {c.replace("_", ""): c for c in COLUMNS}
    names = HEADINGS | known
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), heading_key(heading)), F.lit(""))


def missing_columns(have: Sequence[str], needed: Sequence[str]) -> list[str]:
    """The needed columns that a header lacks."""
    return sorted(set(needed) - set(have))


def split_role(text: Column) -> Column:
    """``title, company`` of "Role at Company", cut at the last "at"."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    role = r"(?is)^(.+) at (.*)$"
    return F.struct(F.when(plain.rlike(role), F.trim(F.regexp_extract(plain, role, 1))).otherwise(plain).alias("title"), F.trim(F.regexp_extract(plain, role, 2)).alias("company"))


def person_key(email: Column, name: Column, company: Column) -> Column:
    """The address in lower case, or name and company where there is none."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low(email) != "", low(email)).otherwise(F.concat(low(name), F.lit("|"), low(company)))


PERSON = "name string, title string, company string, grad_year string, email string"


def _role(text: str) -> tuple[str, str]:
    head, at, tail = text.rpartition(" at ") if " at " in text else (text, "", "")
    if not at:
        i = text.lower().rfind(" at ")
        head, tail = (text[:i], text[i + 4 :]) if i > 0 else (text, "")
    return head.strip(), tail.strip()


def read_person(cells: Sequence[str]) -> tuple[str, str, str, str, str] | None:
    """``name, title, company, grad_year, email`` of a row's cells, each told by its shape: an address, a bare year, and of the rest the name first."""
    cells = [" ".join(str(c or "").split()).strip(" ,;|") for c in cells]
    cells = [c for c in cells if c and not NOISE.fullmatch(c)]
    if not cells or (len(cells) > 1 and all((w := re.findall("[a-z]+", c.lower())) and HEADING_WORDS.issuperset(w) for c in cells)):
        return None
    whole = [c for c in cells if ADDRESS.fullmatch(c)]
    inside = [m[0] for c in cells if (m := ADDRESS.search(c))]
    email = (whole or inside or [""])[0]
    year = next((c for c in cells if YEAR.fullmatch(c)), "")
    rest = [c for c in cells if c != year and not (email and email in c)]
    if not rest:
        return None
    name, *others = rest
    title, company = ("", others[0]) if len(others) == 1 else (others + ["", ""])[:2]
    if " at " in (company if not title else title).lower() and not (title and company):
        title, company = _role(company or title)
    return name, title, company, year, email


def parse_paste(pastes: DataFrame, text: str = "text") -> DataFrame:
    """The people of pasted text, a line each, beside the other columns of ``pastes``, with ``line_no`` from 1.

    Cells are apart by tabs, bars or commas; a line with an address inside is
    the name before it and the role behind.  Headings, page furniture and lines
    without a name give nobody; null and empty texts give none.
    """
    schema = f"array<struct<line_no:int,{PERSON.replace(' ', ':').replace(',:', ',')}>>"

    def cells(line: str) -> list[str]:
        for sep in ("\t", "|", ";", ","):
            if sep in line:
                return line.split(sep)
        if (m := ADDRESS.search(line)) and (before := line[: m.start()].strip(" ,;|")):
            return [before, m[0], *[c for c in _role(line[m.end() :].strip(" ,;|–-")) if c]]
        return [line]

    @F.pandas_udf(schema)
    def people(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("line_no", "name", "title", "company", "grad_year", "email")
        for batch in batches:
            yield pd.Series([[dict(zip(names, (i, *p))) for i, line in enumerate((t or "").splitlines(), 1) if (p := read_person(cells(line)))] for t in batch])

    keep = [c for c in pastes.columns if c not in (text, *[f.split()[0] for f in PERSON.split(", ")], "line_no")]
    return pastes.select(*keep, F.explode(people(F.col(text))).alias("__p")).select(*keep, "__p.*")


def mark_known(people: DataFrame, key: str, order: Sequence[Column], ledger: DataFrame, backup: DataFrame, skip: str = "skip") -> DataFrame:
    """Fills ``skip`` with why a person is passed over: what it says already, 'listed twice' behind the first such key that isn't passed over, or that ledger or backup (``key``) have it."""
    said = F.coalesce(F.nullif(F.col(skip), F.lit("")), F.lit("")) if skip in people.columns else F.lit("")
    rows = people.withColumn("__said", said)
    # the first is an aggregate, so a key that very many rows have is no large group
    first = rows.filter("__said = ''").groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    rows = rows.join(first, key, "left").join(ledger.select(key).distinct().withColumn("__l", F.lit(True)), key, "left").join(backup.select(key).distinct().withColumn("__b", F.lit(True)), key, "left")
    why = F.when(F.col("__said") != "", F.col("__said")).when(F.col("__first") != F.struct(*order), "listed twice").when(F.col("__l"), "in the ledger").when(F.col("__b"), "in the backup").otherwise("")
    return rows.withColumn(skip, why).drop("__said", "__first", "__l", "__b")


def with_openings(people: DataFrame, key: str, company: str, openings: DataFrame, index: DataFrame, top: int = 4) -> DataFrame:
    """Adds ``roles`` and the filings of each person's company.

    ``openings`` has ``company, title, rank``; the first of the company's
    spellings that has any gives its first ``top`` titles by rank.  ``index`` has
    ``form, certified, analyst_certified``; likewise.
    """
    names = people.select(company).distinct().filter(F.trim(company) != "")
    spelled = names.select(company, F.posexplode(institution_variants(F.col(company))).alias("pos", "v")).withColumn("form", simple_key(F.col("v")))
    # at most `top` of a company are kept before any are collected
    ranked = openings.withColumn("form", simple_key(F.col("company"))).filter("form <> ''")
    roles = spelled.join(_first(ranked, top), "form").groupBy(company).agg(F.min_by("roles", "pos").alias("roles"))
    filed = spelled.join(index, "form").groupBy(company).agg(F.min_by(F.struct("certified", "analyst_certified"), "pos").alias("__f"))
    out = people.join(roles, company, "left").join(filed, company, "left")
    return out.withColumns({"roles": F.coalesce("roles", F.array().cast("array<string>")), "certified": F.col("__f.certified"), "analyst_certified": F.col("__f.analyst_certified")}).drop("__f")


def _first(rows: DataFrame, top: int, salts: int = 32) -> DataFrame:
    """``form, roles``: the first titles of each form, ranked within salts and then among what these kept."""
    salted = Window.partitionBy("form", F.pmod(F.xxhash64("title", "rank"), F.lit(salts))).orderBy("rank", "title")
    kept = rows.select("form", "title", "rank").distinct().withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= top)
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("form").orderBy("rank", "title"))).filter(F.col("n") <= top)
    return kept.groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("roles"))
