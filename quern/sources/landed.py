"""Listings from landed payloads of five job-board systems.

Fetching is left to whatever lands the payloads, a line of JSON per response:
``token STRING, company STRING, body STRING``.  A payload is parsed by an
explicit schema and exploded; all five come out with the same columns.  A body
that isn't JSON of its form gives no rows, see ``unreadable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions.text import iso_instant, millis_instant

LANDED = "token STRING, company STRING, body STRING"

#: Of each system: whether a listing is complete, so that absence closes a posting, and whether details are apart.
SYSTEMS = {"greenhouse": (True, False), "lever": (True, False), "ashby": (True, False), "smartrecruiters": (True, True), "workday": (False, True)}

_SCHEMAS = {
    "greenhouse": "jobs ARRAY<STRUCT<id: BIGINT, absolute_url: STRING, title: STRING, location: STRUCT<name: STRING>, offices: ARRAY<STRUCT<name: STRING>>, departments: ARRAY<STRUCT<name: STRING>>, first_published: STRING, updated_at: STRING, content: STRING, company_name: STRING>>",
    "lever": "ARRAY<STRUCT<id: STRING, hostedUrl: STRING, applyUrl: STRING, text: STRING, categories: STRUCT<location: STRING, allLocations: ARRAY<STRING>, team: STRING, department: STRING, commitment: STRING>, createdAt: BIGINT, descriptionPlain: STRING, additionalPlain: STRING, description: STRING, additional: STRING>>",
    "ashby": "jobs ARRAY<STRUCT<id: STRING, jobUrl: STRING, title: STRING, location: STRING, secondaryLocations: ARRAY<STRUCT<location: STRING>>, department: STRING, team: STRING, employmentType: STRING, publishedAt: STRING, descriptionHtml: STRING, isListed: BOOLEAN>>",
    "smartrecruiters": "content ARRAY<STRUCT<id: STRING, ref: STRING, name: STRING, location: STRUCT<fullLocation: STRING, city: STRING, region: STRING, country: STRING>, department: STRUCT<label: STRING>, typeOfEmployment: STRUCT<label: STRING>, releasedDate: STRING, createdOn: STRING>>, totalFound INT",
    "workday": "jobPostings ARRAY<STRUCT<externalPath: STRING, title: STRING, locationsText: STRING>>, total INT",
}
_DETAILS = {
    "smartrecruiters": "jobAd STRUCT<sections: MAP<STRING, STRUCT<text: STRING>>>, applyUrl STRING, postingUrl STRING",
    "workday": "jobPostingInfo STRUCT<title: STRING, jobDescription: STRING, externalUrl: STRING, location: STRING, startDate: STRING, timeType: STRING>",
}


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SYSTEMS.items()], "source STRING, closes_by_absence BOOLEAN, needs_details BOOLEAN")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED).json(path)


def _joined(sep: str, *parts: Column) -> Column:
    """The parts that aren't null or empty, null if none is."""
    return F.nullif(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep), F.lit(""))


def _or(*parts: Column) -> Column:
    """The first part that isn't null or empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def _names(items: Column, field: str) -> Column:
    none = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(items, F.array()), lambda o: o[field]), lambda x: x.isNotNull() & (x != "")) if field else F.coalesce(items, none)


def postings(landed: DataFrame, source: str) -> DataFrame:
    """The postings of one system's payloads."""
    parsed = landed.select("token", "company", F.from_json("body", _SCHEMAS[source]).alias("p"))
    listed = {"greenhouse": "p.jobs", "lever": "p", "ashby": "p.jobs", "smartrecruiters": "p.content", "workday": "p.jobPostings"}[source]
    j = parsed.select("token", "company", F.explode(listed).alias("j"))
    col, none, text = F.col, F.lit(None).cast("string"), lambda c: F.coalesce(F.col(c), F.lit(""))
    if source == "greenhouse":
        first = F.nullif(col("j.first_published"), F.lit(""))
        fields = {
            "external_id": col("j.id").cast("string"), "url": text("j.absolute_url"), "title": text("j.title"), "location_raw": text("j.location.name"), "locations": _names(col("j.offices"), "name"),
            "department": F.get(_names(col("j.departments"), "name"), F.lit(0)), "employment_type": none, "posted_at": iso_instant(F.coalesce(first, col("j.updated_at"))),
            "posted_at_source": F.when(first.isNotNull(), "first_published").otherwise("updated_at"), "description_html": col("j.content"), "description_text": none, "company_name": col("j.company_name"), "double_escaped": F.lit(True),
        }
    elif source == "lever":
        plain = _joined("\n\n", col("j.descriptionPlain"), col("j.additionalPlain"))
        fields = {
            "external_id": col("j.id"), "url": F.coalesce(_or(col("j.hostedUrl"), col("j.applyUrl")), F.lit("")), "title": text("j.text"), "location_raw": text("j.categories.location"),
            "locations": F.coalesce(col("j.categories.allLocations"), F.array().cast("array<string>")), "department": _or(col("j.categories.team"), col("j.categories.department")), "employment_type": col("j.categories.commitment"),
            "posted_at": millis_instant(col("j.createdAt")), "posted_at_source": F.lit("createdAt"), "description_html": F.when(plain.isNull(), _joined("\n\n", col("j.description"), col("j.additional"))),
            "description_text": plain, "company_name": col("company"), "double_escaped": F.lit(False),
        }
    elif source == "ashby":
        j = j.filter(F.coalesce(col("j.isListed"), F.lit(True)))
        fields = {
            "external_id": col("j.id"), "url": F.coalesce(F.nullif(col("j.jobUrl"), F.lit("")), F.concat(F.lit("https://jobs.ashbyhq.com/"), "token", F.lit("/"), "j.id")), "title": text("j.title"),
            "location_raw": text("j.location"), "locations": _names(col("j.secondaryLocations"), "location"), "department": _or(col("j.department"), col("j.team")), "employment_type": col("j.employmentType"),
            "posted_at": iso_instant(col("j.publishedAt")), "posted_at_source": F.lit("publishedAt"), "description_html": col("j.descriptionHtml"), "description_text": none, "company_name": col("company"), "double_escaped": F.lit(False),
        }
    elif source == "smartrecruiters":
        place = F.coalesce(F.nullif(col("j.location.fullLocation"), F.lit("")), _joined(", ", col("j.location.city"), col("j.location.region"), col("j.location.country")), F.lit(""))
        full = F.filter(F.array("j.location.fullLocation"), lambda x: x.isNotNull() & (x != ""))
        fields = {
            "external_id": col("j.id"), "url": F.coalesce(F.nullif(col("j.ref"), F.lit("")), F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), "j.id")), "title": text("j.name"),
            "location_raw": place, "locations": full, "department": col("j.department.label"), "employment_type": col("j.typeOfEmployment.label"), "posted_at": iso_instant(_or(col("j.releasedDate"), col("j.createdOn"))),
            "posted_at_source": F.lit("releasedDate"), "description_html": none, "description_text": none, "company_name": col("company"), "double_escaped": F.lit(False),
        }
    else:
        j = j.filter(F.coalesce(col("j.externalPath"), F.lit("")) != "")
        fields = {
            "external_id": col("j.externalPath"), "url": col("j.externalPath"), "title": text("j.title"), "location_raw": text("j.locationsText"), "locations": F.array().cast("array<string>"), "department": none,
            "employment_type": none, "posted_at": none, "posted_at_source": F.lit("startDate"), "description_html": none, "description_text": none, "company_name": col("company"), "double_escaped": F.lit(False),
        }
    out = j.select(F.lit(source).alias("source"), "token", *[c.alias(k) for k, c in fields.items()])
    # a search may bring a posting for several terms, and pages may overlap
    return out.dropDuplicates(["token", "external_id"]) if source in ("workday", "smartrecruiters") else out


def with_details(listed: DataFrame, details: DataFrame, source: str) -> DataFrame:
    """Postings with what their detail payloads add; ``details`` has ``token, external_id, body``.

    Filter the listing first: only what is left needs its details landed and joined.
    """
    d = details.select("token", "external_id", F.from_json("body", _DETAILS[source]).alias("d"))
    both = listed.join(d, ["token", "external_id"], "left")
    if source == "smartrecruiters":
        parts = [F.col("d.jobAd.sections")[k]["text"] for k in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")]
        new = {"description_html": F.coalesce(_joined("\n\n", *parts), F.col("description_html")), "url": F.coalesce(_or(F.col("d.applyUrl"), F.col("d.postingUrl")), F.col("url"))}
    else:
        info = lambda f: F.col(f"d.jobPostingInfo.{f}")
        start = F.nullif(info("startDate"), F.lit(""))
        new = {
            "title": F.coalesce(_or(F.col("title"), info("title")), F.lit("")),
            "description_html": F.coalesce(info("jobDescription"), F.col("description_html")),
            "url": F.coalesce(F.nullif(info("externalUrl"), F.lit("")), F.col("url")),
            "location_raw": F.coalesce(F.nullif(info("location"), F.lit("")), F.col("location_raw")),
            "posted_at": F.when(start.isNotNull(), F.concat(start, F.lit("T00:00:00Z"))).otherwise(F.col("posted_at")),
            "employment_type": F.coalesce(info("timeType"), F.col("employment_type")),
        }
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in listed.columns])


def unreadable(landed: DataFrame, source: str) -> DataFrame:
    """The payloads of which nothing could be read; their boards failed and close nothing."""
    field = {"greenhouse": "jobs", "ashby": "jobs", "smartrecruiters": "content", "workday": "jobPostings"}.get(source)
    parsed = F.from_json("body", _SCHEMAS[source])
    bad = parsed.isNull() if field is None else parsed[field].isNull() & (F.get_json_object("body", f"$.{field}").isNull())
    return landed.filter(bad)


def probes(landed: DataFrame, source: str) -> DataFrame:
    """``token, verdict, postings, reported``: whether a token is a board, by its payload; a null body was not found."""
    count = {"greenhouse": "$.jobs", "lever": "$", "ashby": "$.jobs", "smartrecruiters": "$.content", "workday": "$.jobPostings"}[source]
    n = F.coalesce(F.json_array_length(F.get_json_object("body", count)), F.lit(0))
    verdict = F.when(F.col("body").isNull(), "notfound").when(n == 0, "empty").otherwise("confirmed")
    reported = F.get_json_object("body", "$.jobs[0].company_name") if source == "greenhouse" else F.lit(None).cast("string")
    return landed.select("token", verdict.alias("verdict"), n.alias("postings"), reported.alias("reported"))


# First steps of an address that are no board.
NO_BOARD = (
    "embed static assets images img css js favicon.ico "
    "robots.txt sitemap.xml api app login signup search "
    "jobs job careers privacy terms error 404 index.html"
).split()


def crawl_tokens(urls: DataFrame, source: str, stop: tuple[str, ...] = tuple(NO_BOARD)) -> DataFrame:
    """``source, token`` of a URL index: the first step of each address, lower case but for a system that tells case apart."""
    token = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
    token = token if source == "ashby" else F.lower(token)
    out = urls.select(F.lit(source).alias("source"), token.alias("token"))
    return out.filter(F.col("token").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{1,60}$") & ~F.lower("token").isin(*stop)).distinct()


def require_tokens(tokens: DataFrame) -> DataFrame:
    """The tokens of a crawl, or an error if it brought none, which means that the index couldn't be read."""
    if tokens.isEmpty():
        raise ValueError("the crawl brought no token")
    return tokens


WORKS = "results ARRAY<STRUCT<id: STRING, title: STRING, publication_date: STRING, authorships: ARRAY<STRUCT<author_position: STRING, author: STRUCT<id: STRING, display_name: STRING, orcid: STRING>, institutions: ARRAY<STRUCT<display_name: STRING, country_code: STRING, type: STRING>>>>>>"


def authorships(landed: DataFrame, country: str = "US", positions: tuple[str, ...] = ("first", "last"), types: tuple[str, ...] = ()) -> DataFrame:
    """A row per author and institution of landed publications: of a country, of some positions, and of some types of institution if any are named."""
    work = landed.select(F.explode(F.from_json("body", WORKS)["results"]).alias("w"))
    author = work.select("w.id", "w.title", "w.publication_date", F.posexplode("w.authorships").alias("author_no", "a"))
    rows = author.select("*", F.explode("a.institutions").alias("i")).filter((F.col("i.country_code") == country) & F.col("a.author_position").isin(*positions))
    rows = rows.filter(F.col("i.type").isin(*types)) if types else rows
    return rows.select(F.col("id").alias("work"), "title", "publication_date", "author_no", "a.author_position", F.col("a.author.id").alias("author"), F.col("a.author.display_name").alias("person"), "a.author.orcid", F.col("i.display_name").alias("institution"), "i.type")


# Types of institution by sector, and the sectors where none is asked for.
SECTORS = {"industry": ("company",), "nonprofit": ("nonprofit",), "academic": ("education", "healthcare"), "government": ("government", "facility")}
DEFAULT_SECTORS = ("industry", "nonprofit")


def types_for(sectors: str) -> tuple[str, ...]:
    """The types of institution of a comma list of sectors: none, which is all, for 'any'; the default's where no sector is known."""
    asked = [s.strip().lower() for s in (sectors or "").split(",")]
    if "any" in asked:
        return ()
    known = [s for s in asked if s in SECTORS] or list(DEFAULT_SECTORS)
    return tuple(dict.fromkeys(t for s in known for t in SECTORS[s]))


def one_posting(postings: DataFrame, url: str) -> DataFrame:
    """The posting that an address leads to, with the board and number read from it; its details need no other posting's."""
    from quern.functions.text import posting_address

    at = posting_address(F.lit(url))
    return postings.filter((F.lower("token") == at["token"]) & (F.col("external_id") == at["id"]))
