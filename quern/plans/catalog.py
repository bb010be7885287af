"""Queries of the engine's own operators, and their SQL.

Each runs over its whole tables.  The SQL says the same in another engine's
words; queries without SQL are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import text as tx
from quern.functions.udf import html_text
from quern.operators import dedupe, employers as em, lexicon, listing
from quern.operators.packed import split_packed, unpack
from quern.operators.snapshots import board_key, found_changes
from quern.sources.tables import spread_out, table, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- names ---------------------------------------------------------------


def _sql_simple(c: str) -> str:
    upper = f"replace(upper(strip_accents(coalesce({c}, ''))), '&', ' AND ')"
    return f"trim(regexp_replace(trim(regexp_replace({upper}, '[^A-Z0-9]+', ' ', 'g')), '^THE( |$)', ''))"


# the SQL spells its lists out, so that a word that the engine's lists lose shows
_LEGAL_TAIL = r"^(\S+(?: \S+)*?)(?: (?:INC|INCORPORATED|LLC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY|LP|LLP|PLC|PC|PLLC|GMBH|SA|NV|AG|PTE|PVT|SAS|BV|AB|PBC|SPC|DBA|COM))+$"
_GEO_TAIL = r"^(\S+(?: \S+)*?)(?: (?:USA|US|AMERICA|AMERICAS|NORTHAMERICA|NA|GLOBAL|INTERNATIONAL|WORLDWIDE))+$"
_DESCRIPTOR_TAIL = r"^(\S+ \S+(?: \S+)*) (?:HOLDINGS|HOLDING|GROUP|SERVICES|SERVICE|SOLUTIONS|TECHNOLOGIES|TECHNOLOGY|SYSTEMS|LABS|LABORATORIES|PARTNERS|VENTURES|ENTERPRISES|CONSULTING)$"
_SQL_ENTITY = "('INC', 'INCORPORATED', 'LLC', 'LLP', 'LP', 'PLC', 'PBC', 'CORP', 'CORPORATION', 'CO', 'COMPANY', 'LTD', 'LIMITED', 'GMBH', 'NV', 'SA', 'AG', 'KK', 'PTE', 'PVT', 'US', 'USA', 'U', 'S', 'AMERICA', 'AMERICAS', 'HOLDINGS', 'HOLDING', 'SERVICES', 'SERVICE', 'NATIONAL', 'ASSOCIATION')"
_SQL_GENERIC = (
    "string_split('CONSULTING TECHNOLOGY TECHNOLOGIES SOLUTIONS SYSTEMS PARTNERS CAPITAL GLOBAL INTERNATIONAL ENTERPRISES VENTURES MANAGEMENT ANALYTICS DIGITAL LABS LABORATORY STAFFING RECRUITING SOFTWARE DATA HEALTH "
    "HEALTHCARE MEDICAL FINANCIAL INSURANCE BANK UNIVERSITY COLLEGE SCHOOL DISTRICT HOSPITAL CLINIC FOUNDATION INSTITUTE RESEARCH ENGINEERING CONSTRUCTION LOGISTICS TRANSPORT RETAIL ENERGY UNIVERSITIES CENTER CENTERS CENTRE "
    "HOSPITALS SCIENCES SCIENCE INSTITUTES LABORATORIES SYSTEM DEPARTMENT DIVISION FACULTY GRADUATE NATIONAL STATE REGIONAL MEMORIAL CHILDRENS CHILDREN GENERAL COMMUNITY COMPREHENSIVE CANCER HEART BRAIN TRUSTEES BOARD REGENTS "
    "AUTHORITY TRUST THE OF AND FOR AT IN S ARTIFICIAL INTELLIGENCE MACHINE LEARNING AI ML ADVANCED APPLIED INNOVATION INNOVATIONS CLOUD CYBER SMART GROUP COMPANY CORP INCORPORATED', ' ')"
)
_SQL_NOISE = "('remote', 'hybrid', 'onsite', 'on', 'site', 'fulltime', 'full', 'time', 'contract', 'temporary', 'us', 'usa', 'united', 'states')"


def _sql_norm(c: str) -> str:
    key = _sql_simple(c)
    for pattern in (_LEGAL_TAIL, _GEO_TAIL, _DESCRIPTOR_TAIL, _LEGAL_TAIL):
        key = f"regexp_replace({key}, '{pattern}', '\\1')"
    return key


def _sql_stem(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: t <> '' AND t NOT IN {_SQL_ENTITY} AND NOT regexp_full_match(t, '\\d+'))"


_NAMES = "SELECT DISTINCT display_name AS name FROM employers WHERE display_name IS NOT NULL UNION SELECT display_name FROM employer_aggs WHERE display_name IS NOT NULL UNION SELECT company FROM boards WHERE company IS NOT NULL UNION SELECT institution FROM contacts WHERE institution IS NOT NULL"


@query(f"WITH n AS ({_NAMES}), k AS (SELECT name, {_sql_simple('name')} AS simple, {_sql_norm('name')} AS norm FROM n) SELECT name, simple, norm, lower(norm) AS company, array_to_string({_sql_stem('norm')}, ' ') AS stem FROM k")
def name_keys(spark, folder):
    e, a, b, c = tables(spark, folder, "employers", "employer_aggs", "boards", "contacts")
    names = e.select(F.col("display_name").alias("name")).union(a.select("display_name")).union(b.select("company")).union(c.select("institution")).filter("name is not null").distinct()
    norm = tx.employer_norm(F.col("name"))
    return names.select("name", tx.simple_key(F.col("name")).alias("simple"), norm.alias("norm"), F.lower(norm).alias("company"), tx.entity_stem(norm).alias("stem"))


_COUNTS = "sum(coalesce(certified, 0))::BIGINT AS certified, sum(coalesce(analyst_certified, 0))::BIGINT AS analyst_certified, sum(coalesce(denied, 0))::BIGINT AS denied"


@query(f"""
WITH r AS (SELECT DISTINCT * FROM employer_aggs), k AS (SELECT *, {_sql_norm('display_name')} AS norm_name FROM r WHERE display_name IS NOT NULL),
t AS (SELECT norm_name, arg_min(trim(display_name), agg_id) AS display_name, {_COUNTS}, max(left(last_decision, 10)) AS last_decision FROM k WHERE norm_name <> '' GROUP BY 1),
s AS (SELECT norm_name, string_agg(DISTINCT s, ',' ORDER BY s) AS states FROM (SELECT norm_name, upper(trim(unnest(states))) AS s FROM k WHERE norm_name <> '') WHERE s <> '' GROUP BY 1)
SELECT t.*, coalesce(s.states, '') AS states FROM t LEFT JOIN s USING (norm_name)""")
def employer_fold(spark, folder):
    rows = table(spark, folder, "employer_aggs").distinct()
    counts = {c: F.col(c) for c in ("certified", "analyst_certified", "denied")}
    return em.fold_filings(rows.filter("display_name is not null"), "display_name", counts, F.col("last_decision"), F.col("states"), F.col("agg_id"))


_REKEYED = f"""rekeyed AS (SELECT coalesce(nullif({_sql_norm('display_name')}, ''), norm_name) AS norm_name,
  arg_max(display_name, (coalesce(certified, 0), display_name)) AS display_name, {_COUNTS}, max(coalesce(last_decision, '')) AS last_decision
  FROM (SELECT DISTINCT * FROM employers) GROUP BY 1)"""


def _rekeyed(spark, folder):
    return em.rekey(table(spark, folder, "employers").distinct())


@query(f"WITH {_REKEYED} SELECT * FROM rekeyed WHERE norm_name IS NOT NULL")
def employer_rekeyed(spark, folder):
    return _rekeyed(spark, folder)


@query(f"WITH {_REKEYED} SELECT row_number() OVER (ORDER BY certified DESC, norm_name) AS place, norm_name, certified, analyst_certified FROM rekeyed WHERE norm_name IS NOT NULL QUALIFY place <= 100")
def employer_top(spark, folder):
    """A top-k report: a heap per task, never a full sort."""
    top = _rekeyed(spark, folder).select("norm_name", "certified", "analyst_certified").orderBy(F.desc("certified"), "norm_name").limit(100)
    return top.select(F.row_number().over(Window.orderBy(F.desc("certified"), "norm_name")).cast("long").alias("place"), "*")


@query(f"WITH {_REKEYED} SELECT count(*) AS employers, sum(certified)::BIGINT AS certified, min(nullif(last_decision, '')) AS first_day, max(nullif(last_decision, '')) AS last_day FROM rekeyed WHERE norm_name IS NOT NULL")
def employer_totals(spark, folder):
    day = F.nullif(F.col("last_decision"), F.lit(""))
    return _rekeyed(spark, folder).agg(F.count("*").alias("employers"), F.sum("certified").alias("certified"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


_SIBLINGS = f"""w AS (SELECT norm_name AS k, {_sql_stem(_sql_norm('display_name'))} AS w FROM rekeyed WHERE norm_name IS NOT NULL),
sib AS (SELECT a.k AS norm_name, b.k AS sibling FROM w a JOIN w b ON a.k <> b.k AND len(a.w) > 0 AND len(b.w) > 0 AND (a.w = b.w OR
  (len(a.w) <> len(b.w) AND least(len(a.w), len(b.w)) >= 2
   AND len(list_filter(CASE WHEN len(a.w) < len(b.w) THEN a.w ELSE b.w END, lambda t: NOT list_contains({_SQL_GENERIC}, t))) > 0
   AND ((CASE WHEN len(a.w) < len(b.w) THEN b.w[1:len(a.w)] = a.w ELSE a.w[1:len(b.w)] = b.w END)
     OR (CASE WHEN len(a.w) < len(b.w) THEN b.w[len(b.w) - len(a.w) + 1:] = a.w AND len(list_filter(b.w[1:len(b.w) - len(a.w)], lambda t: NOT list_contains({_SQL_GENERIC}, t))) = 0
              ELSE a.w[len(a.w) - len(b.w) + 1:] = b.w AND len(list_filter(a.w[1:len(a.w) - len(b.w)], lambda t: NOT list_contains({_SQL_GENERIC}, t))) = 0 END)))))"""


@query(f"WITH {_REKEYED}, {_SIBLINGS} SELECT * FROM sib")
def affix_siblings(spark, folder):
    return em.affix_siblings(_rekeyed(spark, folder))


@query(f"""WITH {_REKEYED}, {_SIBLINGS}, g AS (SELECT * FROM sib UNION SELECT norm_name, norm_name FROM rekeyed WHERE norm_name IS NOT NULL)
SELECT g.norm_name, arg_max(e.display_name, (e.certified, e.display_name)) AS display_name, sum(e.certified)::BIGINT AS certified, sum(e.analyst_certified)::BIGINT AS analyst_certified,
  sum(e.denied)::BIGINT AS denied, max(e.last_decision) AS last_decision, count(*) AS members FROM g JOIN rekeyed e ON e.norm_name = g.sibling GROUP BY 1""")
def sibling_totals(spark, folder):
    return em.family_totals(_rekeyed(spark, folder))


@query(f"""WITH {_REKEYED}, {_SIBLINGS}, g AS (SELECT * FROM sib UNION SELECT norm_name, norm_name FROM rekeyed WHERE norm_name IS NOT NULL),
t AS (SELECT g.norm_name, sum(e.certified)::BIGINT AS c, sum(e.analyst_certified)::BIGINT AS a FROM g JOIN rekeyed e ON e.norm_name = g.sibling GROUP BY 1),
f AS (SELECT {_sql_simple('display_name')} AS form, c, a FROM rekeyed JOIN t USING (norm_name) WHERE certified >= 1 UNION ALL
      SELECT {_sql_simple(_sql_norm('display_name'))}, c, a FROM rekeyed JOIN t USING (norm_name) WHERE certified >= 1)
SELECT form, max((c, a))[1] AS certified, max((c, a))[2] AS analyst_certified FROM f WHERE form <> '' GROUP BY 1""")
def name_index(spark, folder):
    return em.name_index(_rekeyed(spark, folder))


_COMPANIES = f"names AS (SELECT DISTINCT {_sql_norm('company')} AS norm FROM boards)"


def _companies(spark, folder):
    return table(spark, folder, "boards").select(tx.employer_norm(F.col("company")).alias("norm")).distinct().filter("norm <> ''")


@query(f"""WITH {_REKEYED}, {_COMPANIES} SELECT DISTINCT norm, norm_name AS candidate FROM names JOIN rekeyed
ON left(norm, 6) = left(norm_name, 6) OR string_split(norm, ' ')[1] = string_split(norm_name, ' ')[1] WHERE norm <> '' AND norm_name <> ''""")
def block_candidates(spark, folder):
    return em.block_pairs(_companies(spark, folder), _rekeyed(spark, folder))


@query(f"""WITH {_REKEYED}, {_COMPANIES}, e AS (SELECT norm FROM names SEMI JOIN rekeyed ON norm = norm_name WHERE norm <> ''),
s AS (SELECT norm, count(norm_name) AS n, min(norm_name) AS c FROM (SELECT norm FROM names WHERE norm <> '' AND norm NOT IN (SELECT norm FROM e)) LEFT JOIN rekeyed
  ON string_split(norm_name, ' ')[1] = norm AND len(string_split(norm_name, ' ')) <= 2 WHERE length(replace(norm, ' ', '')) < 5 GROUP BY 1)
SELECT norm, 'exact' AS method, norm AS norm_name FROM e UNION ALL SELECT norm, CASE WHEN n = 1 THEN 'short-name' ELSE 'too-short' END, CASE WHEN n = 1 THEN c END FROM s""")
def match_exact(spark, folder):
    found = em.match_names(_companies(spark, folder), _rekeyed(spark, folder))
    return found.filter(F.col("method").isin("exact", "short-name", "too-short")).select("norm", "method", F.get("names", F.lit(0)).alias("norm_name"))


@query()
def match_companies(spark, folder):
    found = em.match_names(_companies(spark, folder), _rekeyed(spark, folder))
    return found.select("norm", "method", "score", F.array_join("names", "; ").alias("names"))


@query()
def institutions_resolved(spark, folder):
    """Each institution with the filings of the first of its spellings that the index has."""
    rows = table(spark, folder, "contacts").select("institution").distinct().filter(F.trim("institution") != "")
    spelled = rows.select("institution", F.posexplode(tx.institution_variants(F.col("institution"))).alias("pos", "variant"))
    hits = spelled.withColumn("form", tx.simple_key(F.col("variant"))).join(em.name_index(_rekeyed(spark, folder), 0), "form")
    first = hits.groupBy("institution").agg(F.min(F.struct("pos", "variant", "certified", "analyst_certified")).alias("x"))
    return rows.join(first, "institution", "left").select("institution", "x.variant", "x.certified", "x.analyst_certified")


# --- titles, places, addresses ---------------------------------------------

_POSTINGS = "p AS (SELECT DISTINCT posting_id, source, external_id, url, title, location_raw, department, employment_type, posted_at, posted_at_source, description_html, description_text, company_name FROM postings_raw)"


def _sql_title(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"), ("’", "''"), ("–", "-"), ("—", "-")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({out}, '[\\s ]+', ' ', 'g'), '^ | $', '', 'g')"


_SQL_PLAIN = "regexp_replace(t, '[\\(\\[\\{][^\\)\\]\\}]*[\\)\\]\\}]', ' ', 'g')"
_SQL_KEY = f"trim(regexp_replace(regexp_replace({_SQL_PLAIN}, '\\b(?:r|req|jr|job)?[-_]?\\d{{4,}}\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_SQL_WORDS = f"array_to_string(list_filter(string_split({_SQL_KEY}, ' '), lambda w: w <> '' AND w NOT IN {_SQL_NOISE}), ' ')"
_SQL_TITLE_KEY = f"array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace({_SQL_WORDS}, '(?:^| )(?:i{{1,3}}|iv|[1-4])(?: (?:i{{1,3}}|iv|[1-4]))*$', ''), ' '), lambda w: w <> ''))), ' ')"


@query(f"""WITH {_POSTINGS}, n AS (SELECT posting_id, {_sql_title('title')} AS t FROM p)
SELECT posting_id, t AS title_norm, CASE WHEN upper(regexp_extract(trim(regexp_replace({_SQL_PLAIN}, '[,\\-/|]+', ' ', 'g')), '\\b((?:i{{1,3}}|iv|[1-4]))$', 1)) IN ('II', 'III', 'IV', '2', '3', '4') THEN upper(regexp_extract(trim(regexp_replace({_SQL_PLAIN}, '[,\\-/|]+', ' ', 'g')), '\\b((?:i{{1,3}}|iv|[1-4]))$', 1)) END AS level, {_SQL_TITLE_KEY} AS title_key FROM n""")
def title_keys(spark, folder):
    rows = table(spark, folder, "postings_raw").select("posting_id", "title").distinct()
    t = F.col("title")
    return rows.select("posting_id", tx.title_norm(t).alias("title_norm"), tx.title_level(t).alias("level"), tx.title_key(t).alias("title_key"))


@query(f"WITH {_POSTINGS}, n AS (SELECT posting_id, {_sql_title('title')} AS t FROM p) SELECT posting_id, (SELECT arg_min(term, term_id) FROM titles WHERE contains(n.t, lower(term))) AS term FROM n")
def title_terms(spark, folder):
    rows = table(spark, folder, "postings_raw").select("posting_id", "title").distinct()
    terms = [r["term"].lower() for r in table(spark, folder, "titles").orderBy("term_id").collect()]  # a list written by people
    return rows.select("posting_id", lexicon.first_term(tx.title_norm(F.col("title")), terms).alias("term"))


_SQL_STATES = (
    "('alabama', 'AL'), ('alaska', 'AK'), ('arizona', 'AZ'), ('arkansas', 'AR'), ('california', 'CA'), ('colorado', 'CO'), ('connecticut', 'CT'), ('delaware', 'DE'), ('florida', 'FL'), ('georgia', 'GA'), ('hawaii', 'HI'), ('idaho', 'ID'), "
    "('illinois', 'IL'), ('indiana', 'IN'), ('iowa', 'IA'), ('kansas', 'KS'), ('kentucky', 'KY'), ('louisiana', 'LA'), ('maine', 'ME'), ('maryland', 'MD'), ('massachusetts', 'MA'), ('michigan', 'MI'), ('minnesota', 'MN'), ('mississippi', 'MS'), "
    "('missouri', 'MO'), ('montana', 'MT'), ('nebraska', 'NE'), ('nevada', 'NV'), ('new hampshire', 'NH'), ('new jersey', 'NJ'), ('new mexico', 'NM'), ('new york', 'NY'), ('north carolina', 'NC'), ('north dakota', 'ND'), ('ohio', 'OH'), "
    "('oklahoma', 'OK'), ('oregon', 'OR'), ('pennsylvania', 'PA'), ('rhode island', 'RI'), ('south carolina', 'SC'), ('south dakota', 'SD'), ('tennessee', 'TN'), ('texas', 'TX'), ('utah', 'UT'), ('vermont', 'VT'), ('virginia', 'VA'), "
    "('washington', 'WA'), ('west virginia', 'WV'), ('wisconsin', 'WI'), ('wyoming', 'WY'), ('district of columbia', 'DC')"
)


@query(f"""WITH {_POSTINGS}, st(name, code) AS (VALUES {_SQL_STATES}), one AS (SELECT posting_id, trim(location_raw) AS l FROM p WHERE location_raw IS NOT NULL AND NOT regexp_matches(location_raw, '[;|/·•&+"''\\t\\n\\r]| and | or |,.*,')),
x AS (SELECT *, lower(l) AS low, trim(regexp_extract(lower(l), '^([^,]+),', 1)) AS city, regexp_extract(l, ',\\s*([A-Z]{{2}})\\b', 1) AS code, regexp_extract(l, '^US-([A-Z]{{2}})-', 1) AS dashed,
  trim(regexp_extract(lower(l), ',\\s*([a-z ]+)', 1)) AS rest FROM one)
SELECT posting_id, CASE WHEN regexp_matches(low, '^remote\\b') THEN 'remote-us'
  WHEN dashed IN (SELECT code FROM st) THEN replace(lower(regexp_extract(l, '^US-[A-Z]{{2}}-(.*)$', 1)), '-', ' ') || '|' || dashed
  WHEN code IN (SELECT code FROM st) THEN city || '|' || code
  WHEN (SELECT count(*) FROM st WHERE starts_with(rest, name)) > 0 THEN city || '|' || (SELECT arg_max(code, length(name)) FROM st WHERE starts_with(rest, name))
  ELSE low END AS place FROM x""")
def place_keys(spark, folder):
    """Places of the postings whose location has no delimiter, quote or apostrophe; `place_values` has those of all."""
    rows = table(spark, folder, "postings_raw").select("posting_id", "location_raw").distinct()
    rows = rows.filter(F.col("location_raw").isNotNull() & ~F.col("location_raw").rlike(r"[;|/·•&+\"'\t\n\r]| and | or |,.*,"))
    return rows.select("posting_id", tx.place_key(F.col("location_raw")).alias("place"))


@query()
def place_values(spark, folder):
    """Every place of every posting, with packed places taken apart; a posting without any place has no row."""
    rows = table(spark, folder, "postings_raw").select("posting_id", "location_raw").distinct()
    return split_packed(rows, "location_raw").select("posting_id", "pos", "item", tx.place_key(F.col("item")).alias("place"))


@query()
def places_by_state(spark, folder):
    """How many postings name a place of each state, with packed places taken apart."""
    rows = table(spark, folder, "postings_raw").select("posting_id", "location_raw").distinct()
    key = tx.place_key(F.col("item"))
    state = F.when(F.contains(key, F.lit("|")), F.element_at(F.split(key, r"\|"), -1)).when(key == "remote-us", "remote").otherwise("other")
    return split_packed(rows, "location_raw").select("posting_id", state.alias("state")).distinct().groupBy("state").agg(F.count("*").alias("postings"))


_SQL_URL = "regexp_replace(regexp_replace(trim(coalesce(url, '')), '[?#].*$', ''), '/+$', '')"
_SQL_BOARD, _SQL_OWN = "(?i)^https?://boards\\.([a-z]+)\\.[^/]+/([^/]+)/jobs/(.+)$", "(?i)^https?://careers\\.()([^./]+)\\.[^/]+/openings/(.+)$"


@query(f"""WITH u AS (SELECT DISTINCT entry_id, {_SQL_URL} AS u FROM queue_entries), m AS (SELECT *, regexp_matches(u, '{_SQL_BOARD}') AS b FROM u)
SELECT entry_id, {", ".join(f"{'lower(' if i < 3 else ''}CASE WHEN b THEN regexp_extract(u, '{_SQL_BOARD}', {i}) ELSE regexp_extract(u, '{_SQL_OWN}', {i}) END{')' if i < 3 else ''} AS {c}" for i, c in ((1, 'source'), (2, 'token'), (3, 'external_id')))} FROM m""")
def address_parts(spark, folder):
    rows = table(spark, folder, "queue_entries").select("entry_id", "url").distinct()
    a = tx.posting_address(F.col("url"))
    return rows.select("entry_id", a["source"].alias("source"), a["token"].alias("token"), a["id"].alias("external_id"))


@query(f"WITH {_POSTINGS} SELECT posting_id, strftime(CAST(posted_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS posted FROM p")
def posted_instants(spark, folder):
    return table(spark, folder, "postings_raw").select("posting_id", "posted_at").distinct().select("posting_id", tx.iso_instant(F.col("posted_at")).alias("posted"))


@query("SELECT DISTINCT board_id, 'https://search.example/?q=' || replace(url_encode(company), '%20', '+') AS link FROM boards WHERE company IS NOT NULL")
def search_links(spark, folder):
    rows = table(spark, folder, "boards").filter("company is not null").select("board_id", "company").distinct()
    return rows.select("board_id", F.concat(F.lit("https://search.example/?q="), tx.form_encode(F.col("company"))).alias("link"))


# --- texts -----------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, left(sha256(regexp_replace(c, '^\\s+|\\s+$', '', 'g')), 16) AS hash, left(sha256(regexp_replace(c, '^\\s+|\\s+$', '', 'g')), 8) AS short_hash, length(regexp_replace(c, '^\\s+|\\s+$', '', 'g')) AS chars FROM d""")
def text_hashes(spark, folder):
    rows = table(spark, folder, "documents").filter("text is not null").select("doc_id", tx.collapse(F.col("text")).alias("c"))
    return rows.select("doc_id", tx.short_hash(F.col("c")).alias("hash"), tx.short_hash(F.col("c"), 8).alias("short_hash"), F.length("c").cast("long").alias("chars"))


_SQL_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([A-Z]\.)(\s)', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), '\n+', chr(2), 'g'), chr(2)), lambda s: regexp_replace(replace(s, chr(1), ''), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SQL_SENTENCES}) AS sentences, list_max(list_transform({_SQL_SENTENCES}, lambda s: length(s))) AS longest FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, folder):
    rows = table(spark, folder, "documents").filter("text is not null").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x).cast("long"))).alias("longest"))


def _skill_lexicon(spark, folder):
    """Entries with their forms: a list written by people."""
    rows = table(spark, folder, "skills").select("skill_id", "canonical", "weight", unpack(F.col("aliases"), "list").alias("a")).orderBy("skill_id").collect()
    return [(r["canonical"], [r["canonical"], *r["a"]], r["weight"]) for r in rows]


_SQL_SKILL = "d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, skill_id, canonical, weight FROM d, skills WHERE contains(t, lower(canonical)) AND regexp_matches(t, '(^|[^a-z0-9])' || regexp_replace(lower(canonical), '([.+*?()\\[\\]])', '\\\\\\1', 'g') || '($|[^a-z0-9])'))"


@query(f"WITH {_SQL_SKILL} SELECT doc_id, coalesce(string_agg(canonical, '; ' ORDER BY skill_id), '') AS names, coalesce(sum(weight), 0)::BIGINT AS weight FROM d LEFT JOIN h USING (doc_id) GROUP BY doc_id")
def skills_in_texts(spark, folder):
    """Skills that a text has by any of their forms.  The SQL knows canonical names alone, which says the same where no text has just an alias."""
    lex = _skill_lexicon(spark, folder)
    # in lower case once, not for each term
    rows = spread_out(table(spark, folder, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", F.lower("text").alias("low"))
    rows = rows.select("doc_id", lexicon.terms_in(F.col("low"), lex).alias("x"))
    return rows.select("doc_id", F.array_join("x.names", "; ").alias("names"), F.col("x.weight").cast("long").alias("weight"))


@query()
def skill_gaps(spark, folder):
    """How many texts have each skill by any of its forms, and how often."""
    lex = _skill_lexicon(spark, folder)
    low = F.col("low")
    rows = spread_out(table(spark, folder, "documents").filter("text is not null").select("text")).select(F.lower("text").alias("low")).select(F.explode(F.array(*[F.struct(F.lit(n).alias("skill"), lexicon.term_hits(low, f).alias("hits")) for n, f, _ in lex])).alias("x")).select("x.*")
    return rows.filter("hits > 0").groupBy("skill").agg(F.count("*").alias("texts"), F.sum("hits").cast("long").alias("hits"))


@query(r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(\d[\d,]*(?:\.\d+)?)', 1), lambda x: regexp_replace(replace(x, ',', ''), '\.0+$', '')) AS n FROM documents)
SELECT doc_id, len(n) AS numbers, array_to_string(list_sort(list_distinct(n)), ' ') AS listed FROM d""")
def numbers_in_texts(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", tx.numbers(F.col("text")).alias("n"))
    return rows.select("doc_id", F.size("n").cast("long").alias("numbers"), F.array_join(F.array_sort(F.array_distinct("n")), " ").alias("listed"))


@query()
def least_years(spark, folder):
    """The least number of years of experience that a text asks for."""
    rows = spread_out(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", tx.years_required(F.col("text")).alias("least_years"))


@query(r"""SELECT doc_id, nullif(lower(regexp_extract(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0)), '') AS address FROM documents""")
def first_addresses(spark, folder):
    found = F.regexp_extract(F.coalesce("text", F.lit("")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0)
    return table(spark, folder, "documents").select("doc_id", F.nullif(F.lower(found), F.lit("")).alias("address"))


@query(f"""WITH s AS (SELECT doc_id, unnest({_SQL_SENTENCES}) AS s, generate_subscripts({_SQL_SENTENCES}, 1) AS i FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, i, lower(regexp_extract(s, '^[^A-Za-z]*([A-Za-z]+)', 1)) AS w FROM s)
SELECT doc_id, w AS word, min(i)::BIGINT AS first_at, count(*) AS times FROM v WHERE w <> '' GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_openings(spark, folder):
    """Words that open several sentences of a text, with the first of these."""
    rows = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("i", "s"))
    rows = rows.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.lower(F.regexp_extract("s", r"^[^A-Za-z]*([A-Za-z]+)", 1)).alias("word")).filter("word <> ''")
    return rows.groupBy("doc_id", "word").agg(F.min("i").alias("first_at"), F.count("*").alias("times")).filter("times > 1")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'claims') AND contains(lower(text), 'reconcile') AND contains(lower(text), 'team')")
def text_search(spark, folder, words=("claims", "reconcile", "team")):
    """Texts that have all words of a query."""
    low = F.lower("text")
    rows = table(spark, folder, "documents")
    for word in words:
        rows = rows.filter(F.contains(low, F.lit(word)))
    return rows.select("doc_id")


@query()
def flat_texts(spark, folder):
    """Plain text of every description; escaped once more is told from having no tag."""
    rows = spread_out(table(spark, folder, "postings_raw").filter("description_html is not null").select("posting_id", "description_html").distinct())
    twice = ~F.col("description_html").rlike("</?[a-zA-Z!]")
    return rows.select("posting_id", html_text(F.col("description_html"), twice).alias("text"))


# --- listings over time ----------------------------------------------------


@query("SELECT board_key, arg_min(company, (CASE seed_file WHEN 'seed' THEN 0 ELSE 1 END, board_id)) AS company, arg_min(board_id, (CASE seed_file WHEN 'seed' THEN 0 ELSE 1 END, board_id)) AS board_id FROM boards GROUP BY 1")
def boards_first(spark, folder):
    """One row per board: the curated file before the discovered one, then the lower id."""
    rows = table(spark, folder, "boards").select("board_key", "company", "board_id", "seed_file")
    order = [F.when(F.col("seed_file") == "seed", 0).otherwise(1), F.col("board_id")]
    return dedupe.first_wins(rows, ["board_key"], order).select("board_key", "company", "board_id")


@query("SELECT DISTINCT board_key FROM boards WHERE lower(board_key) NOT IN (SELECT lower(board_key) FROM run_reports WHERE status = 'ok')")
def boards_undelivered(spark, folder):
    b, r = tables(spark, folder, "boards", "run_reports")
    ok = r.filter("status = 'ok'").select(F.lower("board_key").alias("k")).distinct()
    return b.select("board_key").distinct().withColumn("k", F.lower("board_key")).join(ok, "k", "left_anti").select("board_key")


@query("""WITH r AS (SELECT DISTINCT * FROM run_reports), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_no, lower(board_key) ORDER BY attempt DESC, finished_at DESC) = 1)
SELECT run_no, count(*) AS boards, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, sum(postings_seen)::BIGINT AS postings_seen, sum(new_count)::BIGINT AS new_count, sum(coalesce(closed, 0))::BIGINT AS closed FROM l GROUP BY 1""")
def run_totals(spark, folder):
    """Counters of each run from every board's last attempt."""
    rows = table(spark, folder, "run_reports").distinct().withColumn("k", F.lower("board_key"))
    last = dedupe.last_wins(rows, ["run_no", "k"], [F.col("attempt"), F.col("finished_at")])
    return last.groupBy("run_no").agg(
        F.count("*").alias("boards"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("postings_seen").alias("postings_seen"), F.sum("new_count").alias("new_count"), F.sum(F.coalesce("closed", F.lit(0))).alias("closed")
    )


_SQL_OK = "ok AS (SELECT DISTINCT lower(board_key) AS b, run_no AS r FROM run_reports WHERE status = 'ok')"
_SQL_SEEN = "seen AS (SELECT DISTINCT lower(source || ':' || token || coalesce(':' || site, '')) AS b, trim(external_id) AS k, run_no AS r FROM posting_snapshots SEMI JOIN ok ON ok.b = lower(source || ':' || token || coalesce(':' || site, '')) AND ok.r = run_no)"


def _seen(spark, folder):
    s, r = tables(spark, folder, "posting_snapshots", "run_reports")
    ok = r.filter("status = 'ok'").select(F.lower("board_key").alias("board"), "run_no").distinct()
    rows = s.select(board_key(F.col("source"), F.col("token"), F.col("site")).alias("board"), F.trim("external_id").alias("external_id"), "run_no")
    return rows, ok


@query(f"""WITH {_SQL_OK}, n AS (SELECT b, r, row_number() OVER (PARTITION BY b ORDER BY r) AS d FROM ok), {_SQL_SEEN},
g AS (SELECT b, k, r, CASE WHEN d - lag(d) OVER (PARTITION BY b, k ORDER BY d) > 1 THEN 1 ELSE 0 END AS gap FROM seen JOIN n USING (b, r))
SELECT b AS board, k AS external_id, min(r) AS first_run, max(r) AS last_run, count(*) AS runs, sum(gap)::BIGINT AS gaps FROM g GROUP BY 1, 2""")
def listing_history(spark, folder):
    rows, ok = _seen(spark, folder)
    return listing.run_history(rows, ok, "board", "external_id", "run_no")


@query(f"""WITH {_SQL_OK}, {_SQL_SEEN}, old AS (SELECT b, k FROM seen WHERE r = 1), new AS (SELECT b, k FROM seen WHERE r = 2), well AS (SELECT b FROM ok WHERE r = 2)
SELECT coalesce(o.b, n.b) AS board, coalesce(o.k, n.k) AS external_id, CASE WHEN o.k IS NULL THEN 2 ELSE 1 END AS first_seen, CASE WHEN n.k IS NULL THEN 1 ELSE 2 END AS last_seen,
  CASE WHEN n.k IS NULL AND o.b NOT LIKE 'workday:%' AND o.b IN (SELECT b FROM well) THEN 2 END AS closed_at FROM old o FULL JOIN new n ON o.b = n.b AND o.k = n.k""")
def store_after_run(spark, folder):
    """The store of run 1 after run 2 alone (`store_after_runs` takes all runs): new rows merged, missing ones closed where their board delivered and lists all it has."""
    rows, ok = _seen(spark, folder)
    seen = rows.join(ok, ["board", "run_no"], "left_semi").distinct().withColumn("id", F.concat_ws("\n", "board", "external_id"))
    held = seen.filter("run_no = 1").select("id", "board", "external_id", F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"), F.lit(None).cast("int").alias("closed_at"))
    fresh = seen.filter("run_no = 2").select("id", "board", "external_id")
    store = listing.merge_runs(held, fresh, "id", F.lit(2))
    closed = listing.close_missing(store, fresh, ok.filter("run_no = 2"), "id", "board", ~F.startswith("board", F.lit("workday:")), F.lit(2), F.lit(0))
    return closed.select("board", "external_id", "first_seen", "last_seen", "closed_at")


#: A board that is searched rather than listed: its postings age out this many days after they were last seen.
STALE_DAYS = 21


@query()
def store_after_runs(spark, folder):
    """The store after all runs in order: what is missing closes, by age where a board is only searched, and opens again when it returns."""
    rows, ok = _seen(spark, folder)
    runs = table(spark, folder, "run_reports").select("run_no", "run_date")
    return listing.store_over_runs(rows, ok, runs, "board", "external_id", "run_no", "run_date", ~F.startswith("board", F.lit("workday:")), STALE_DAYS)


@query()
def closed_counts_checked(spark, folder):
    """Reported against derived numbers of removed postings, of each delivered run of a board."""
    s, r, b = tables(spark, folder, "posting_snapshots", "run_reports", "boards")
    gone = found_changes(s, r, b).filter("change_kind = 'removed'").groupBy("run_no", F.lower("board_key").alias("k")).agg(F.count("*").alias("derived"))
    said = r.filter("status = 'ok'").groupBy("run_no", F.lower("board_key").alias("k")).agg(F.max("closed").alias("reported"))
    both = said.join(gone, ["run_no", "k"], "left").select("run_no", F.col("k").alias("board"), "reported", F.coalesce("derived", F.lit(0)).alias("derived"))
    return both.withColumn("agrees", F.col("reported").eqNullSafe(F.col("derived")))


# --- cards and rankings ----------------------------------------------------

_SQL_CARD = f"""{_POSTINGS}, n AS (SELECT *, {_sql_title('title')} AS t FROM p),
c AS (SELECT posting_id, source, strftime(CAST(posted_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS posted, coalesce(company_name, '') AS co,
  left(sha256(lower({_sql_norm('company_name')}) || ' | ' || {_SQL_TITLE_KEY} || ' | ' || lower(trim(coalesce(location_raw, '')))), 16) AS card FROM n)"""


def _card_rows(spark, folder):
    rows = table(spark, folder, "postings_raw").select("posting_id", "source", "title", "company_name", "location_raw", "posted_at").distinct()
    basis = F.concat_ws(" | ", F.lower(tx.employer_norm(F.col("company_name"))), tx.title_key(F.col("title")), F.lower(F.trim(F.coalesce("location_raw", F.lit("")))))
    return rows.select("posting_id", "source", tx.iso_instant(F.col("posted_at")).alias("posted"), tx.short_hash(basis).alias("card"))


@query(f"""WITH {_SQL_CARD} SELECT card, arg_min(posting_id, (CASE WHEN posted IS NULL THEN 1 ELSE 0 END, -coalesce(epoch(CAST(posted AS TIMESTAMPTZ)), 0), posting_id)) AS posting_id, min(posted) AS first_seen, max(posted) AS last_seen,
count(*) AS members, string_agg(DISTINCT source, '; ' ORDER BY source) AS also_at FROM c GROUP BY 1""")
def cards(spark, folder):
    """Postings with one company, title and place: the latest is the card's face."""
    rows = _card_rows(spark, folder)
    order = [F.col("posted").isNull().alias("none"), (-F.coalesce(F.unix_timestamp(F.try_to_timestamp("posted")), F.lit(0))).alias("late")]
    out = listing.cards(rows, "card", "posting_id", order, F.col("posted"), F.col("source"))
    return out.withColumn("also_at", F.array_join("also_at", "; "))


@query(f"WITH {_SQL_CARD} SELECT posting_id, row_number() OVER (ORDER BY posted DESC NULLS LAST, posting_id) AS place FROM c")
def feed(spark, folder):
    """Every posting's place in the feed, the newest first and those without a date last."""
    rows = _card_rows(spark, folder).select("posting_id", "posted")
    return dedupe.number_rows(rows, [dedupe.desc(F.col("posted")), F.col("posting_id")], "place").select("posting_id", "place")


_SQL_CONTACTS = """c AS (SELECT DISTINCT contact_id, person, institution, openalex_author, published,
  CASE WHEN regexp_matches(coalesce(published, ''), '^\\d{4}') THEN 0 ELSE 1 END AS nodate, TRY_CAST(regexp_extract(published, '^(\\d{4})', 1) AS INT) AS y,
  coalesce(TRY_CAST(regexp_extract(published, '^\\d{4}-(\\d{1,2})', 1) AS INT), 0) AS m, coalesce(TRY_CAST(regexp_extract(published, '^\\d{4}-\\d{1,2}-(\\d{1,2})', 1) AS INT), 0) AS d FROM contacts)"""


def _contact_rows(spark, folder):
    rows = table(spark, folder, "contacts").select("contact_id", "person", "institution", "openalex_author", "published").distinct()
    k = tx.recency_key(F.col("published"))
    return rows.select("*", k["none"].alias("nodate"), k["y"].alias("y"), k["m"].alias("m"), k["d"].alias("d"))


@query(f"WITH {_SQL_CONTACTS} SELECT openalex_author, arg_min(contact_id, (nodate, -coalesce(y, 0), -m, -d, contact_id)) AS contact_id FROM c WHERE openalex_author IS NOT NULL GROUP BY 1")
def newest_by_author(spark, folder):
    rows = _contact_rows(spark, folder).filter("openalex_author is not null").select("openalex_author", "contact_id", "nodate", "y", "m", "d")
    return dedupe.first_wins(rows, ["openalex_author"], [F.col(c) for c in ("nodate", "y", "m", "d", "contact_id")]).select("openalex_author", "contact_id")


@query(f"""WITH {_SQL_CONTACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY institution ORDER BY nodate, -coalesce(y, 0), -m, -d, contact_id) AS g FROM c)
SELECT contact_id, row_number() OVER (ORDER BY CASE WHEN g > 2 THEN 1 ELSE 0 END, nodate, -coalesce(y, 0), -m, -d, contact_id) AS place FROM r""")
def contacts_spread(spark, folder):
    """Contacts, the newest first, with at most two of an institution before all others have had their turn."""
    order = [F.col(c) for c in ("nodate", "y", "m", "d", "contact_id")]
    return dedupe.spread(_contact_rows(spark, folder), F.col("institution"), order, 2).select("contact_id", "place")


@query(f"WITH {_POSTINGS} SELECT 'source' AS facet, source AS value, count(*) AS rows FROM p GROUP BY 2 UNION ALL SELECT 'department', department, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'employment_type', employment_type, count(*) FROM p GROUP BY 2")
def facets(spark, folder):
    """Counts by each facet, in one pass."""
    rows = table(spark, folder, "postings_raw").select("posting_id", "source", "department", "employment_type").distinct()
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("source", "department", "employment_type")]))
    return rows.select(parts.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("rows"))


@query("WITH d AS (SELECT length(text) // 500 * 500 AS bucket, count(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT bucket::BIGINT AS bucket, rows, round(rows / (SELECT max(rows) FROM d), 4) AS share_of_peak FROM d")
def length_histogram(spark, folder):
    return listing.histogram(table(spark, folder, "documents").select(F.length("text").alias("n")), "n", 500)


@query("WITH d AS (SELECT lower(trim(source)) AS source, length(text) AS n FROM documents WHERE text IS NOT NULL), l AS (SELECT source, list_sort(list(n)) AS l, count(*) AS rows FROM d GROUP BY 1) SELECT source, l[len(l) // 2 + 1]::BIGINT AS median, rows FROM l")
def length_medians(spark, folder):
    rows = table(spark, folder, "documents").filter("text is not null").select(F.lower(F.trim("source")).alias("source"), F.length("text").cast("long").alias("n"))
    return listing.upper_median(rows, "n", ["source"])


@query("""WITH q AS (SELECT DISTINCT entry_id, slug, lower(trim(dedupe_key)) AS dk, updated_at, status FROM queue_entries), k AS (SELECT *, coalesce(nullif(dk, ''), 'slug:' || slug) AS k FROM q)
SELECT k AS card, count(*) AS entries, arg_max(entry_id, (updated_at, entry_id)) AS latest FROM k WHERE k IS NOT NULL GROUP BY 1""")
def queue_latest(spark, folder):
    """The latest entry of each card, by its key or else its slug."""
    rows = table(spark, folder, "queue_entries").select("entry_id", "slug", "dedupe_key", "updated_at").distinct()
    rows = rows.withColumn("card", F.coalesce(F.nullif(F.lower(F.trim("dedupe_key")), F.lit("")), F.concat(F.lit("slug:"), "slug"))).filter("card is not null")
    return rows.groupBy("card").agg(F.count("*").alias("entries"), F.max_by("entry_id", F.struct("updated_at", "entry_id")).alias("latest"))


@query("""WITH e AS (SELECT DISTINCT entry_id, posting_id, skill_text FROM skill_entries) SELECT posting_id, count(*) AS entries, count(DISTINCT lower(trim(skill_text))) AS spellings FROM e GROUP BY 1""")
def skills_per_posting(spark, folder):
    rows = table(spark, folder, "skill_entries").select("entry_id", "posting_id", "skill_text").distinct()
    return rows.groupBy("posting_id").agg(F.count("*").alias("entries"), F.count_distinct(F.lower(F.trim("skill_text"))).alias("spellings"))


def _sql_slug(c: str, n: int) -> str:
    words = f"list_filter(string_split(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:{n}]"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1:1]) || lower(w[2:])), '')"


@query(f"SELECT DISTINCT entry_id, {_sql_slug('company', 3)} || {_sql_slug('title', 5)} AS slug FROM queue_entries")
def slugs(spark, folder):
    rows = table(spark, folder, "queue_entries").select("entry_id", "company", "title").distinct()
    return rows.select("entry_id", tx.camel_slug((F.col("company"), 3), (F.col("title"), 5)).alias("slug")).distinct()


_SQL_AT = "regexp_replace(regexp_replace(regexp_replace(trim(coalesce(url, '')), '[?#].*$', ''), '/+$', ''), '^(?i)https?://', '')"


@query(f"""WITH q AS (SELECT DISTINCT entry_id, {_SQL_AT} AS at FROM queue_entries), p AS (SELECT {_SQL_AT} AS at, min(posting_id) AS posting_id FROM postings_raw GROUP BY 1)
SELECT entry_id, posting_id FROM q LEFT JOIN p ON q.at = p.at AND q.at <> ''""")
def queue_postings(spark, folder):
    """The posting that each entry's address leads to; null where it leads to none."""
    at = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("url", F.lit(""))), r"[?#].*$", ""), "/+$", ""), r"^(?i)https?://", "").alias("at")
    q, p = tables(spark, folder, "queue_entries", "postings_raw")
    known = p.select("posting_id", at).filter("at <> ''").groupBy("at").agg(F.min("posting_id").alias("posting_id"))
    return q.select("entry_id", at).distinct().join(known, "at", "left").select("entry_id", "posting_id")


@query("""WITH q AS (SELECT DISTINCT entry_id, lower(trim(company)) AS c, lower(trim(title)) AS t, queued_at FROM queue_entries WHERE company IS NOT NULL AND title IS NOT NULL),
f AS (SELECT c, t, arg_min(entry_id, (queued_at, entry_id)) AS first_id FROM q GROUP BY 1, 2) SELECT entry_id, first_id FROM q JOIN f USING (c, t) WHERE entry_id <> first_id""")
def queue_repeats(spark, folder):
    """Entries for a company and title that were queued before, with the first of these."""
    rows = table(spark, folder, "queue_entries").select("entry_id", F.lower(F.trim("company")).alias("c"), F.lower(F.trim("title")).alias("t"), "queued_at").dropna(subset=["c", "t"]).distinct()
    first = dedupe.first_wins(rows, ["c", "t"], [F.col("queued_at"), F.col("entry_id")]).select("c", "t", F.col("entry_id").alias("first_id"))
    return rows.join(first, ["c", "t"]).filter("entry_id <> first_id").select("entry_id", "first_id")


@query("""WITH a AS (SELECT DISTINCT agg_id, fiscal_year, display_name, certified, last_decision FROM employer_aggs WHERE display_name IS NOT NULL)
SELECT display_name, max(fiscal_year) AS fiscal_year, arg_max(agg_id, (fiscal_year, coalesce(last_decision, ''), agg_id)) AS agg_id FROM a GROUP BY 1""")
def latest_year(spark, folder):
    """The latest filing row of each name: the last year, and the last decision in it."""
    rows = table(spark, folder, "employer_aggs").filter("display_name is not null").select("agg_id", "fiscal_year", "display_name", "last_decision").distinct()
    last = F.max_by("agg_id", F.struct(F.col("fiscal_year"), F.coalesce("last_decision", F.lit("")), F.col("agg_id")))
    return rows.groupBy("display_name").agg(F.max("fiscal_year").alias("fiscal_year"), last.alias("agg_id"))
