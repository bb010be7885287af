"""Queries of titles' tiers, places, people and what is tracked, and their SQL, which spells its own lists out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import places, text as tx
from quern.operators import dedupe, lexicon, people as pe, tracking as tr
from quern.sources.tables import table, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- titles and places -------------------------------------------------------

_T = "list_reduce(list_concat([lower(coalesce(title, ''))], ['&lt;|<', '&gt;|>', '&quot;|\"', '&#39;|''', '&nbsp;| ', '&amp;|&', '’|''', '–|-', '—|-']), lambda a, b: replace(a, split_part(b, '|', 1), split_part(b, '|', 2)))"
_TITLES = f"t AS (SELECT DISTINCT posting_id, url, company_name, trim(regexp_replace({_T}, '[\\s ]+', ' ', 'g')) AS t FROM postings_raw)"
_TIERS = rf"""{_TITLES},
w AS (SELECT term_id, lower(trim(term)) AS term, trim(tier) AS tier, CASE WHEN regexp_matches(lower(trim(term)), ' (analyst|analysts|administrator|engineer|specialist)$')
  THEN regexp_replace(lower(trim(term)), ' [a-z]+$', '') || '\b[\w\s/&,-]{{0,26}}?\b' || regexp_extract(lower(trim(term)), '[a-z]+$') ELSE lower(trim(term)) END AS pat FROM titles),
h AS (SELECT posting_id, tier AS k, term_id, CASE tier WHEN 'N' THEN regexp_extract(t, '(^|[^a-z])(' || pat || ')($|[^a-z])', 2) ELSE term END AS term,
  CASE tier WHEN 'A' THEN CASE WHEN trim(regexp_replace(t, '[,\-–|/(].*$', '')) = term OR t = term THEN 'A' ELSE 'A-partial' END ELSE tier END AS tier,
  CASE tier WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'C' THEN 2 ELSE 3 END AS o
  FROM t, w WHERE CASE tier WHEN 'N' THEN regexp_matches(t, '(^|[^a-z])(' || pat || ')($|[^a-z])')
    WHEN 'C' THEN contains(t, term) AND regexp_matches(t, '\b(analyst|analytics|analysis|data|business intelligence|bi|insights|reporting|quantitative|statistic)\w*\b') ELSE contains(t, term) END),
tiers AS (SELECT posting_id, arg_min(tier, o * 100000 + term_id) AS tier, arg_min(term, o * 100000 + term_id) AS term FROM h GROUP BY 1)"""


def _tiered(spark, folder):
    rows = table(spark, folder, "postings_raw").select("posting_id", "title", "url", "company_name").distinct()
    terms = [(r["term"], r["tier"]) for r in table(spark, folder, "titles").orderBy("term_id").collect()]  # a list written by people
    return rows.withColumn("x", lexicon.title_tier(tx.title_norm(F.col("title")), terms)).select("*", "x.*").drop("x")


@query(f"WITH {_TIERS} SELECT posting_id, tiers.tier, tiers.term FROM t LEFT JOIN tiers USING (posting_id)")
def title_tiers(spark, folder):
    """Every posting's tier by the list of titles: what is no such post first, then exact, partial, early-career and other terms."""
    return _tiered(spark, folder).select("posting_id", "tier", "term")


_ADDRESS = r"regexp_replace(regexp_replace(trim(coalesce(url, '')), '[?#].*$', ''), '/+$', '')"
_TOKEN = rf"lower(CASE WHEN regexp_matches({_ADDRESS}, '(?i)^https?://boards\.[a-z]+\.[^/]+/[^/]+/jobs/.+$') THEN regexp_extract({_ADDRESS}, '(?i)^https?://boards\.[a-z]+\.[^/]+/([^/]+)/', 1) ELSE regexp_extract({_ADDRESS}, '(?i)^https?://careers\.([^./]+)\.[^/]+/openings/.+$', 1) END)"


@query(f"""WITH {_TIERS}, g AS (SELECT {_TOKEN} AS token, count(*) FILTER (tiers.tier <> 'N') AS hits, count(*) AS total, min(company_name) AS reported FROM t LEFT JOIN tiers USING (posting_id) GROUP BY 1)
SELECT row_number() OVER (ORDER BY hits DESC, token) AS place, token, hits, total, reported FROM g WHERE hits > 0""")
def board_hits(spark, folder):
    """Boards by the number of their postings whose title is wanted."""
    rows = _tiered(spark, folder).withColumn("token", tx.posting_address(F.col("url"))["token"])
    hits = tr.hit_ratio(rows, ["token"], F.col("tier") != "N", F.col("company_name"))
    return dedupe.number_rows(hits, [dedupe.desc(F.col("hits")), F.col("token")], "place").select("place", "token", "hits", "total", "reported")


# Countries other than the United States that places are told by here.
COUNTRIES = (
    "argentina australia austria belgium brazil bulgaria canada chile china colombia croatia cyprus czechia denmark egypt estonia finland france germany greece hungary iceland india indonesia "
    "ireland israel italy japan kenya latvia lithuania luxembourg malaysia malta mexico morocco netherlands nigeria norway pakistan peru philippines poland portugal romania serbia singapore slovakia "
    "slovenia spain sweden switzerland taiwan thailand turkey ukraine uruguay vietnam"
).split() + ["costa rica", "new zealand", "south africa", "united kingdom", "georgia"]

_STATES = (
    "alabama AL|alaska AK|arizona AZ|arkansas AR|california CA|colorado CO|connecticut CT|delaware DE|florida FL|georgia GA|hawaii HI|idaho ID|illinois IL|indiana IN|iowa IA|kansas KS|kentucky KY|"
    "louisiana LA|maine ME|maryland MD|massachusetts MA|michigan MI|minnesota MN|mississippi MS|missouri MO|montana MT|nebraska NE|nevada NV|new hampshire NH|new jersey NJ|new mexico NM|new york NY|"
    "north carolina NC|north dakota ND|ohio OH|oklahoma OK|oregon OR|pennsylvania PA|rhode island RI|south carolina SC|south dakota SD|tennessee TN|texas TX|utah UT|vermont VT|virginia VA|washington WA|"
    "west virginia WV|wisconsin WI|wyoming WY|district of columbia DC"
)
_ST = f"st AS (SELECT u[:len(u) - 3] AS name, u[len(u) - 1:] AS code, o FROM (SELECT unnest(string_split('{_STATES}', '|')) AS u, generate_subscripts(string_split('{_STATES}', '|'), 1) AS o))"
_ABROAD = (
    "costa rica|new zealand|south africa|united kingdom|argentina|australia|austria|belgium|brazil|bulgaria|canada|chile|china|colombia|croatia|cyprus|czechia|denmark|egypt|estonia|finland|france|germany|greece|"
    "hungary|iceland|india|indonesia|ireland|israel|italy|japan|kenya|latvia|lithuania|luxembourg|malaysia|malta|mexico|morocco|netherlands|nigeria|norway|pakistan|peru|philippines|poland|portugal|romania|"
    "serbia|singapore|slovakia|slovenia|spain|sweden|switzerland|taiwan|thailand|turkey|ukraine|uruguay|vietnam"
)
_CUT = r"'\s*[;|]\s*|\s+/\s+|\s+and\s+|\s*•\s*'"
_ITEMS = "list_filter(list_transform(regexp_split_to_array(coalesce({}, ''), " + _CUT + r"), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(rf"""WITH {_ST}, p AS (SELECT DISTINCT posting_id, list_concat({_ITEMS.format("location_raw")}, flatten(list_transform(coalesce(locations, []), lambda y: {_ITEMS.format("y")}))) AS parts FROM postings_raw),
x AS (SELECT posting_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
l AS (SELECT *, regexp_replace(lower(part), '^[,.]+|[,.]+$', '', 'g') AS low FROM x),
s AS (SELECT l.posting_id, l.i, arg_min(st.code, st.o) FILTER (regexp_matches(lower(part), '(^|[^a-z])' || st.name || '([^a-z]|$)')) AS named, bool_or(regexp_matches(part, '(^|[^A-Za-z])' || st.code || '([^A-Za-z]|$)')) AS coded FROM l, st GROUP BY 1, 2),
c AS (SELECT l.*, named, CASE WHEN low = '' OR regexp_matches(low, '^\d+\s+locations?$|^multiple locations?$|^various') THEN 'unknown' WHEN regexp_matches(low, '(^|[^a-z])(u\.?s\.?a?|united states|america)([^a-z]|$)') THEN 'us'
  WHEN regexp_matches(low, '(^|[^a-z])({_ABROAD})([^a-z]|$)') THEN 'foreign' WHEN regexp_matches(low, '(^|[^a-z])georgia([^a-z]|$)') THEN CASE WHEN coded THEN 'us' ELSE 'foreign' END
  WHEN named IS NOT NULL OR coded THEN 'us' ELSE 'unknown' END AS k FROM l JOIN s USING (posting_id, i)),
f AS (SELECT posting_id, part, named FROM c WHERE k = 'us' QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY i) = 1),
n AS (SELECT posting_id, coalesce(named, CASE WHEN regexp_extract(part, '(?:^|[^A-Za-z])([A-Z]{{2}})(?:[^A-Za-z]|$)', 1) IN (SELECT code FROM st) THEN regexp_extract(part, '(?:^|[^A-Za-z])([A-Z]{{2}})(?:[^A-Za-z]|$)', 1) END) AS code,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(part, '[,(].*$', '', 's'))), '\bremote\b|\bhybrid\b', '', 'g'), '^[ \-,]+|[ \-,]+$', '', 'g'), '^(u\.?s\.?a?|united states|america)$', '') AS city FROM f),
a AS (SELECT p.posting_id, coalesce(bool_or(k = 'us'), false) AS is_us, coalesce(bool_or(k = 'foreign'), false) AS abroad, coalesce(bool_or(regexp_matches(part, '(?i)\bremote\b|\bwork from home\b|\banywhere\b|\bdistributed\b')), false) AS is_remote,
  coalesce(bool_or(regexp_matches(part, '(?i)\bhybrid\b')), false) AS is_hybrid FROM p LEFT JOIN c USING (posting_id) GROUP BY 1)
SELECT posting_id, is_us, is_remote, is_hybrid, CASE WHEN is_us OR abroad THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN NOT is_us THEN 'unknown' WHEN city = '' THEN 'remote-' || coalesce(lower(code), 'us') WHEN code IS NOT NULL THEN city || '|' || code ELSE city END AS place FROM a LEFT JOIN n USING (posting_id)""")
def place_parses(spark, folder):
    """What every posting's places say: whether domestic, remote or hybrid, and the first domestic place."""
    rows = table(spark, folder, "postings_raw").select("posting_id", "location_raw", "locations").distinct()
    x = places.parse_places(F.col("location_raw"), F.col("locations"), foreign=COUNTRIES)
    return rows.select("posting_id", x.alias("x")).select("posting_id", "x.is_us", "x.is_remote", "x.is_hybrid", "x.confidence", F.col("x.primary").alias("place"))


@query("SELECT DISTINCT posting_id, CASE WHEN posted_at IS NOT NULL THEN CAST(greatest(0, floor((epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00') - floor(epoch(CAST(posted_at AS TIMESTAMPTZ)))) / 86400)) AS BIGINT) END AS days FROM postings_raw")
def posting_ages(spark, folder):
    """Whole days from posting to the first of June 2026."""
    rows = table(spark, folder, "postings_raw").select("posting_id", "posted_at").distinct()
    return rows.select("posting_id", tr.age_days(F.try_to_timestamp(F.col("posted_at")), F.lit("2026-06-01T00:00:00Z").cast("timestamp")).alias("days")).distinct()


# --- queues and trackers -----------------------------------------------------

_QUEUE = "q AS (SELECT DISTINCT entry_id, slug, url, company, title, dedupe_key, status, CAST(queued_at AS TIMESTAMPTZ) AS queued, CAST(updated_at AS TIMESTAMPTZ) AS updated FROM queue_entries)"


def _queue(spark, folder):
    rows = table(spark, folder, "queue_entries").select("entry_id", "slug", "url", "company", "title", "dedupe_key", "status", "queued_at", "updated_at").distinct()
    return rows.withColumns({"queued": F.try_to_timestamp("queued_at"), "updated": F.try_to_timestamp("updated_at")}).drop("queued_at", "updated_at")


@query(f"WITH {_QUEUE} SELECT entry_id, status = 'writing' AS stalled FROM q WHERE status IN ('queued', 'briefed') OR (status = 'writing' AND epoch(TIMESTAMPTZ '2026-04-20 12:00:00+00') - epoch(updated) > 1800)")
def queue_pending(spark, folder):
    """Entries that wait, or have been written for more than half an hour."""
    now = F.lit("2026-04-20T12:00:00Z").cast("timestamp")
    return tr.pending(_queue(spark, folder), "status", "updated", now, ("queued", "briefed"), "writing", 30).select("entry_id", "stalled")


@query(f"WITH {_QUEUE} SELECT entry_id, strftime(CAST(updated AT TIME ZONE 'UTC' AS DATE) + 7, '%Y-%m-%d') AS followup, CAST(updated AT TIME ZONE 'UTC' AS DATE) + 7 <= DATE '2026-05-01' AND status <> 'ready' AS due FROM q WHERE updated IS NOT NULL AND status IS NOT NULL")
def followups_due(spark, folder):
    """A week after its last change an entry that isn't ready is due."""
    rows = _queue(spark, folder).filter("updated is not null and status is not null").withColumn("day", F.to_date("updated"))
    out = tr.followups(rows, "day", F.col("status") == "ready", 7, F.lit("2026-05-01").cast("date"))
    return out.select("entry_id", F.date_format("followup", "yyyy-MM-dd").alias("followup"), "due")


_HOST = r"lower(regexp_extract(url, '(?i)^\s*https?://([a-z]+)\.', 1))"


@query(f"""WITH {_QUEUE}, r AS (SELECT {_HOST} AS pool, count(*) FILTER (status IN ('ready', 'failed', 'briefed')) AS sent, count(*) FILTER (status = 'ready') AS replied FROM q GROUP BY 1),
s AS (SELECT *, CASE WHEN sent > 0 THEN CAST(floor(replied * 100 / sent + 0.5) AS BIGINT) ELSE 0 END AS rate FROM r)
SELECT pool, sent, replied, rate, coalesce(sent >= 3 AND rate > 0 AND rate = max(CASE WHEN sent >= 3 AND rate > 0 THEN rate END) OVER (), false) AS best FROM s""")
def reply_rates(spark, folder):
    """Of the entries that were sent, how many came back ready, by the sort of their host."""
    rows = _queue(spark, folder).withColumn("host", F.lower(F.regexp_extract("url", r"(?i)^\s*https?://([a-z]+)\.", 1)))
    return tr.reply_rates(rows, "host", F.col("status").isin("ready", "failed", "briefed"), F.col("status") == "ready")


_AT = r"regexp_replace(regexp_replace(regexp_replace(trim(coalesce(url, '')), '[?#].*$', ''), '/+$', ''), '^(?i)https?://', '')"
_SLUG = "array_to_string(list_transform(list_filter(string_split(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:{1}], lambda w: upper(w[1:1]) || lower(w[2:])), '')"


@query(f"""WITH {_QUEUE}, p AS (SELECT {_AT} AS ad, {_SLUG.format("company_name", 3)} || {_SLUG.format("title", 5)} AS slug, posting_id FROM postings_raw),
u AS (SELECT ad, min(posting_id) AS v FROM p WHERE ad <> '' GROUP BY 1), s AS (SELECT slug, min(posting_id) AS v FROM p WHERE slug <> '' GROUP BY 1)
SELECT entry_id, coalesce(u.v, s.v) AS posting_id FROM (SELECT entry_id, {_AT} AS ad, slug FROM q) q LEFT JOIN u ON u.ad = q.ad LEFT JOIN s ON s.slug = q.slug""")
def tracker_postings(spark, folder):
    """The posting of each entry by its address, or else by its slug."""
    at = lambda: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("url", F.lit(""))), r"[?#].*$", ""), "/+$", ""), r"^(?i)https?://", "")
    posts = table(spark, folder, "postings_raw").select("posting_id", "url", "company_name", "title")
    slug = tx.camel_slug((F.col("company_name"), 3), (F.col("title"), 5))
    out = tr.joined_by_any(_queue(spark, folder).withColumn("at", at()), posts, "entry_id", [("url", F.col("at"), at()), ("slug", F.col("slug"), slug)], "posting_id")
    return out.select("entry_id", "posting_id")


@query(f"""WITH {_QUEUE} SELECT row_number() OVER (ORDER BY queued DESC, entry_id) AS place, entry_id FROM q WHERE queued IS NOT NULL QUALIFY place <= 50""")
def queue_newest(spark, folder):
    """A top-k report: the fifty entries queued last."""
    top = _queue(spark, folder).filter("queued is not null").orderBy(F.desc("queued"), "entry_id").limit(50)
    return top.select(F.row_number().over(Window.orderBy(F.desc("queued"), "entry_id")).cast("long").alias("place"), "entry_id")


@query("WITH d AS (SELECT DISTINCT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT row_number() OVER (ORDER BY n DESC, doc_id) AS place, doc_id, n AS chars FROM d QUALIFY place <= 5")
def longest_texts(spark, folder):
    """A top-k report: the five longest texts."""
    top = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.length("text").cast("long").alias("chars")).distinct().orderBy(F.desc("chars"), "doc_id").limit(5)
    return top.select(F.row_number().over(Window.orderBy(F.desc("chars"), "doc_id")).cast("long").alias("place"), "*")


# --- people and companies ----------------------------------------------------

_PEOPLE = "c AS (SELECT DISTINCT contact_id, lower(trim(coalesce(person, ''))) || '|' || lower(trim(coalesce(institution, ''))) AS k, merged_from, openalex_author, published FROM contacts)"


@query(f"""WITH {_PEOPLE}, f AS (SELECT k, min(contact_id) AS first FROM c GROUP BY 1), l AS (SELECT DISTINCT k FROM c WHERE merged_from IS NOT NULL)
SELECT contact_id, CASE WHEN contact_id <> first THEN 'listed twice' WHEN k IN (SELECT k FROM l) THEN 'in the ledger' ELSE '' END AS skip FROM c JOIN f USING (k)""")
def people_known(spark, folder):
    """Contacts that were listed before, or whose key a merged contact has."""
    rows = table(spark, folder, "contacts").select("contact_id", "person", "institution", "merged_from").distinct()
    rows = rows.withColumn("k", pe.person_key(F.lit(None).cast("string"), F.col("person"), F.col("institution")))
    ledger = rows.filter("merged_from is not null")
    return pe.mark_known(rows, "k", [F.col("contact_id")], ledger, ledger.limit(0)).select("contact_id", "skip")


@query("""WITH c AS (SELECT DISTINCT contact_id, coalesce(nullif(trim(openalex_author), ''), trim(person) || '|' || trim(coalesce(institution, ''))) AS k, coalesce(published, '') AS d FROM contacts)
SELECT k AS key, arg_max(contact_id, (d, contact_id)) AS contact_id FROM c WHERE k IS NOT NULL GROUP BY 1""")
def contacts_newest(spark, folder):
    """One contact for each author, or person and institution where no author is given: the one published last."""
    rows = table(spark, folder, "contacts").select("contact_id", "openalex_author", "person", "institution", "published").distinct()
    other = F.concat(F.trim("person"), F.lit("|"), F.trim(F.coalesce("institution", F.lit(""))))
    return tr.newest_load(rows, [F.col("openalex_author"), other], [F.coalesce("published", F.lit("")), F.col("contact_id")]).select("key", "contact_id")


@query()
def people_openings(spark, folder):
    """The open posts and filings of every contact's institution, by the first of its spellings that has any."""
    from quern.operators.employers import name_index, rekey

    rows = table(spark, folder, "contacts").select("contact_id", "institution").distinct()
    posts = table(spark, folder, "postings_raw").select(F.col("company_name").alias("company"), "title", F.col("posting_id").alias("rank")).distinct()
    out = pe.with_openings(rows, "contact_id", "institution", posts, name_index(rekey(table(spark, folder, "employers").distinct()), 0))
    return out.select("contact_id", F.array_join("roles", "; ").alias("roles"), "certified", "analyst_certified")


@query("""WITH s AS (SELECT posting_id, count(*) AS n FROM (SELECT DISTINCT entry_id, posting_id FROM skill_entries) GROUP BY 1),
o AS (SELECT DISTINCT p.posting_id, lower(trim(company_name)) AS company, title, n FROM postings_raw p JOIN s ON s.posting_id = p.posting_id WHERE n >= 2 AND trim(company_name) <> '' AND title IS NOT NULL),
r AS (SELECT company, title, n, row_number() OVER (PARTITION BY company ORDER BY n DESC, title) AS k FROM (SELECT DISTINCT company, title, n FROM o)),
t AS (SELECT company, string_agg(title, '; ' ORDER BY k) AS titles FROM r WHERE k <= 2 GROUP BY 1)
SELECT row_number() OVER (ORDER BY count(*) DESC, max(n) DESC, company) AS place, company, count(*) AS open_roles, max(n) AS best_score, any_value(titles) AS titles FROM o JOIN t USING (company) GROUP BY company""")
def company_targets(spark, folder):
    """Companies by their postings of two skills or more, with the titles of those that ask most."""
    skills = table(spark, folder, "skill_entries").select("entry_id", "posting_id").distinct().groupBy("posting_id").agg(F.count("*").alias("score"))
    posts = table(spark, folder, "postings_raw").select("posting_id", F.lower(F.trim("company_name")).alias("company"), "title").distinct().filter("company <> '' and title is not null")
    out = tr.targets(posts.join(skills, "posting_id"), "company", "score", "title", 2)
    return dedupe.number_rows(out, [dedupe.desc(F.col("open_roles")), dedupe.desc(F.col("best_score")), F.col("company")], "place").select("place", "company", "open_roles", "best_score", "titles")


@query("""WITH h AS (SELECT display_name, max(coalesce(certified, 0)) AS certified FROM employers WHERE display_name IS NOT NULL GROUP BY 1), b AS (SELECT display_name, sum(coalesce(certified, 0)) AS certified FROM (SELECT DISTINCT * FROM employer_aggs) WHERE display_name IS NOT NULL GROUP BY 1)
SELECT display_name, certified::BIGINT AS certified FROM h UNION ALL SELECT display_name, certified::BIGINT FROM b WHERE display_name NOT IN (SELECT display_name FROM h)""")
def filings_merged(spark, folder):
    """Employers by name, and from the yearly rows the names that they lack."""
    e, a = tables(spark, folder, "employers", "employer_aggs")
    n = F.coalesce("certified", F.lit(0))
    held = e.filter("display_name is not null").groupBy("display_name").agg(F.max(n).cast("long").alias("certified"))
    brought = a.distinct().filter("display_name is not null").groupBy("display_name").agg(F.sum(n).cast("long").alias("certified"))
    return tr.merge_backup(held, brought, "display_name")


_SITES = ("External", "Careers", "ExternalCareerSite", "{T}_Careers", "{t}careers", "{U}Careers", "{T}External", "{t}jobs")


@query("""WITH b AS (SELECT DISTINCT lower(trim(token)) AS token FROM boards WHERE source = 'workday' AND trim(token) <> ''),
s AS (SELECT * FROM (VALUES (1, 'External'), (2, 'Careers'), (3, 'ExternalCareerSite'), (4, '{T}_Careers'), (5, '{t}careers'), (6, '{U}Careers'), (7, '{T}External'), (8, '{t}jobs')) v(pos, s))
SELECT token, pos, replace(replace(replace(s, '{t}', token), '{T}', upper(token[1:1]) || token[2:]), '{U}', upper(token)) AS site FROM b, s""")
def workday_sites(spark, folder):
    """The names that a tenant's site may have, in the order of trying."""
    rows = table(spark, folder, "boards").filter("source = 'workday'").select(F.lower(F.trim("token")).alias("token")).filter("token <> ''").distinct()
    return rows.select("token", F.posexplode(tx.site_names(F.col("token"), _SITES)).alias("pos", "site")).select("token", (F.col("pos") + 1).alias("pos"), "site")


@query(r"""WITH n AS (SELECT DISTINCT company, trim(regexp_replace(trim(regexp_replace(replace(upper(strip_accents(company)), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), '^THE( |$)', '')) AS k FROM boards WHERE company IS NOT NULL),
a AS (SELECT company, regexp_replace(k, '^(\S+(?: \S+)*?)(?: (?:INC|INCORPORATED|LLC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY|LP|LLP|PLC|PC|PLLC|GMBH|SA|NV|AG|PTE|PVT|SAS|BV|AB|PBC|SPC|DBA|COM))+$', '\1') AS k FROM n),
b AS (SELECT company, regexp_replace(k, '^(\S+(?: \S+)*?)(?: (?:USA|US|AMERICA|AMERICAS|NORTHAMERICA|NA|GLOBAL|INTERNATIONAL|WORLDWIDE))+$', '\1') AS k FROM a),
c AS (SELECT company, regexp_replace(k, '^(\S+ \S+(?: \S+)*) (?:HOLDINGS|HOLDING|GROUP|SERVICES|SERVICE|SOLUTIONS|TECHNOLOGIES|TECHNOLOGY|SYSTEMS|LABS|LABORATORIES|PARTNERS|VENTURES|ENTERPRISES|CONSULTING)$', '\1') AS k FROM b),
d AS (SELECT company, string_split(lower(regexp_replace(k, '^(\S+(?: \S+)*?)(?: (?:INC|INCORPORATED|LLC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY|LP|LLP|PLC|PC|PLLC|GMBH|SA|NV|AG|PTE|PVT|SAS|BV|AB|PBC|SPC|DBA|COM))+$', '\1')), ' ') AS w FROM c WHERE k <> ''),
e AS (SELECT company, [array_to_string(w, ''), array_to_string(w, '-'), CASE WHEN len(w) >= 2 THEN array_to_string(w[1:2], '') END, CASE WHEN len(w) >= 2 THEN array_to_string(w[1:2], '-') END, w[1]] AS s FROM d),
f AS (SELECT company, list_filter(s, lambda x: x IS NOT NULL AND length(x) >= 4 AND x NOT IN ('data', 'tech', 'group', 'global', 'us', 'usa', 'inc', 'the', 'american', 'national', 'international', 'first', 'general', 'united', 'new', 'one', 'advanced', 'premier', 'systems', 'solutions', 'services', 'technologies')) AS s FROM e)
SELECT company, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' ') AS slugs FROM f""")
def slug_candidates(spark, folder):
    """The names that a company's board may have, the likeliest first."""
    rows = table(spark, folder, "boards").filter("company is not null").select("company").distinct().filter(tx.employer_norm(F.col("company")) != "")
    return rows.select("company", F.array_join(tx.slug_candidates(F.col("company")), " ").alias("slugs"))


@query(f"""WITH p AS (SELECT DISTINCT posting_id, source, {_TOKEN} AS token FROM postings_raw), b AS (SELECT lower(source) AS source, lower(token) AS token, min(board_key) AS board_key FROM boards GROUP BY 1, 2),
s AS (SELECT * FROM (VALUES ('greenhouse', true, false), ('lever', true, false), ('ashby', true, false), ('smartrecruiters', true, true), ('workday', false, true)) v(source, closes_by_absence, needs_details))
SELECT posting_id, board_key, closes_by_absence, needs_details FROM p LEFT JOIN b USING (source, token) LEFT JOIN s USING (source)""")
def posting_boards(spark, folder):
    """Every posting with its board and what its system can do."""
    from quern.sources.landed import systems

    p, b = tables(spark, folder, "postings_raw", "boards")
    rows = p.select("posting_id", "source", "url").distinct().select("posting_id", "source", tx.posting_address(F.col("url"))["token"].alias("token"))
    keys = b.groupBy(F.lower("source").alias("source"), F.lower("token").alias("token")).agg(F.min("board_key").alias("board_key"))
    # a row per system
    return rows.join(keys, ["source", "token"], "left").join(F.broadcast(systems(spark)), "source", "left").select("posting_id", "board_key", "closes_by_absence", "needs_details")


@query(f"""WITH p AS (SELECT DISTINCT posting_id, source, title, company_name, {_AT} AS ad, CAST(posted_at AS TIMESTAMPTZ) AS posted FROM postings_raw), q AS (SELECT DISTINCT {_AT} AS ad FROM queue_entries)
SELECT posting_id, p.ad IN (SELECT ad FROM q) AS tracked FROM p WHERE source IN ('lever', 'ashby', 'workday') AND posted IS NOT NULL AND greatest(0, floor((epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00') - floor(epoch(posted))) / 86400)) <= 90
AND contains(lower(coalesce(title, '') || ' ' || coalesce(company_name, '')), 'analyst')""")
def feed_filtered(spark, folder, sources=("lever", "ashby", "workday"), days=90, words="analyst"):
    """Dated postings of some systems, of the last days, that have all words of a query, and whether an entry tracks them."""
    at = lambda: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("url", F.lit(""))), r"[?#].*$", ""), "/+$", ""), r"^(?i)https?://", "")
    p, q = tables(spark, folder, "postings_raw", "queue_entries")
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("company_name", F.lit(""))))
    age = tr.age_days(F.try_to_timestamp("posted_at"), F.lit("2026-06-01T00:00:00Z").cast("timestamp"))
    rows = p.select("posting_id", "source", "title", "company_name", "url", "posted_at").distinct().filter(F.col("source").isin(*sources) & (age <= days) & (tr.search_score(low, F.lit(words)) == 100))
    tracked = q.select(at().alias("at")).distinct().withColumn("tracked", F.lit(True))
    return rows.select("posting_id", at().alias("at")).join(tracked, "at", "left").select("posting_id", F.coalesce("tracked", F.lit(False)).alias("tracked"))


@query(f"WITH {_QUEUE} SELECT entry_id, row_number() OVER (ORDER BY CASE WHEN status = 'failed' THEN 1 ELSE 0 END, CASE WHEN coalesce(trim(company), '') = '' THEN 1 ELSE 0 END, lower(trim(coalesce(company, ''))), entry_id) AS place FROM q")
def queue_ordered(spark, folder):
    """Entries by company, those without one and then the failed ones last."""
    low = F.lower(F.trim(F.coalesce("company", F.lit(""))))
    order = [(F.coalesce(F.col("status") == "failed", F.lit(False))).cast("int"), (low == "").cast("int"), low, F.col("entry_id")]
    return dedupe.number_rows(_queue(spark, folder).select("entry_id", "status", "company"), order, "place").select("entry_id", "place")


@query("WITH c AS (SELECT DISTINCT contact_id, certified, institution FROM contacts) SELECT contact_id, row_number() OVER (ORDER BY certified DESC NULLS LAST, institution NULLS LAST, contact_id) AS place FROM c")
def contacts_ordered(spark, folder):
    """Contacts by filings, most first, then by institution."""
    rows = table(spark, folder, "contacts").select("contact_id", "certified", "institution").distinct()
    return dedupe.number_rows(rows, [dedupe.desc(F.col("certified")), F.col("institution"), F.col("contact_id")], "place").select("contact_id", "place")


@query(f"WITH {_QUEUE} SELECT count(*) AS entries, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'briefed') AS briefed, count(*) FILTER (status = 'writing') AS writing, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed FROM q")
def queue_counts(spark, folder):
    """Entries by status, in one pass."""
    states = ("queued", "briefed", "writing", "ready", "failed")
    return _queue(spark, folder).agg(F.count("*").alias("entries"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


@query("WITH r AS (SELECT DISTINCT run_no, lower(board_key) AS b, attempt, error FROM run_reports) SELECT run_no, trim(split_part(error, ':', 1)) AS reason, count(*) AS times FROM r WHERE trim(error) <> '' GROUP BY 1, 2")
def errors_by_reason(spark, folder):
    """How often each run failed for what reason, the part of the error before a colon."""
    rows = table(spark, folder, "run_reports").select("run_no", F.lower("board_key").alias("b"), "attempt", "error").distinct().filter(F.trim("error") != "")
    return rows.groupBy("run_no", F.trim(F.split_part("error", F.lit(":"), F.lit(1))).alias("reason")).agg(F.count("*").alias("times"))


@query("WITH c AS (SELECT DISTINCT contact_id, author_position, sector, certified FROM contacts) SELECT contact_id FROM c WHERE author_position IN ('first author', 'PI') AND sector IN ('education', 'healthcare') AND coalesce(certified, 0) >= 1")
def academic_authors(spark, folder, sectors="academic", least=1):
    """First and last authors at schools and hospitals with filings."""
    from quern.sources.landed import types_for

    rows = table(spark, folder, "contacts").select("contact_id", "author_position", "sector", "certified").distinct()
    return rows.filter(F.col("author_position").isin("first author", "PI") & F.col("sector").isin(*types_for(sectors)) & (F.coalesce("certified", F.lit(0)) >= least)).select("contact_id")


@query("""WITH b AS (SELECT DISTINCT board_id, company FROM boards), e AS (SELECT display_name, max(coalesce(certified, 0)) AS n FROM employers GROUP BY 1), a AS (SELECT display_name, max(coalesce(certified, 0)) AS n FROM employer_aggs GROUP BY 1)
SELECT board_id, coalesce(e.n, a.n)::BIGINT AS certified, CASE WHEN e.n IS NOT NULL THEN 'employers' WHEN a.n IS NOT NULL THEN 'years' END AS said_by FROM b LEFT JOIN e ON e.display_name = b.company LEFT JOIN a ON a.display_name = b.company""")
def company_facts(spark, folder):
    """The filings of every board's company as it stands: from the employers, else from the yearly rows."""
    b, e, a = tables(spark, folder, "boards", "employers", "employer_aggs")
    most = lambda t, n: t.groupBy(F.col("display_name").alias("company")).agg(F.max(F.coalesce("certified", F.lit(0))).cast("long").alias(n))
    rows = b.select("board_id", "company").distinct().join(most(e, "e"), "company", "left").join(most(a, "a"), "company", "left")
    return rows.select("board_id", F.coalesce("e", "a").alias("certified"), F.when(F.col("e").isNotNull(), "employers").when(F.col("a").isNotNull(), "years").alias("said_by"))


@query("""WITH e AS (SELECT posting_id, list_distinct(list(lower(trim(skill_text)))) AS s FROM skill_entries WHERE skill_text IS NOT NULL GROUP BY 1), k AS (SELECT list(lower(canonical)) AS k FROM skills)
SELECT posting_id, array_to_string(list_sort(list_filter(s, lambda x: list_contains(k, x) AND x NOT IN ('gridwright', 'lumenchart', 'route costing'))), '; ') AS missing FROM e, k""")
def skills_missing(spark, folder, profile=("gridwright", "lumenchart", "route costing")):
    """The known skills that a posting asks for and a profile lacks, in order."""
    known = [r[0].lower() for r in table(spark, folder, "skills").select("canonical").collect()]  # a list written by people
    rows = table(spark, folder, "skill_entries").filter("skill_text is not null").select("posting_id", F.lower(F.trim("skill_text")).alias("s")).distinct()
    # only known skills are kept, so a posting's set is bounded by the list
    asked = rows.groupBy("posting_id").agg(F.collect_set(F.when(F.col("s").isin(known), F.col("s"))).alias("s"))
    return asked.select("posting_id", F.array_join(F.array_sort(F.array_except("s", F.array(*map(F.lit, profile)))), "; ").alias("missing"))


@query("""WITH c AS (SELECT DISTINCT contact_id, nullif(trim(orcid), '') AS o, lower(trim(person)) || '|' || lower(trim(institution)) AS k, author_position = 'PI' AS own FROM contacts WHERE author_position IS NOT NULL), m AS (SELECT * FROM c WHERE NOT own)
SELECT contact_id, coalesce(o IN (SELECT o FROM m WHERE o IS NOT NULL), false) OR coalesce(k IN (SELECT k FROM m WHERE k IS NOT NULL), false) AS known FROM c WHERE own""")
def people_either(spark, folder):
    """Last authors that are first authors too, by number or by name and institution: two equality joins."""
    rows = table(spark, folder, "contacts").select("contact_id", F.trim("orcid").alias("o"), F.concat(F.lower(F.trim("person")), F.lit("|"), F.lower(F.trim("institution"))).alias("k"), (F.col("author_position") == "PI").alias("own")).filter("own is not null").distinct()
    merged = rows.filter("not own").select(F.col("o").alias("ro"), F.col("k").alias("rk"), F.col("contact_id").alias("other"))
    out = tr.joined_by_any(rows.filter("own"), merged, "contact_id", [("orcid", F.col("o"), F.col("ro")), ("name", F.col("k"), F.col("rk"))], "other")
    return out.select("contact_id", F.col("other").isNotNull().alias("known"))
