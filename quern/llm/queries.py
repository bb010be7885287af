"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.llm.canonical import found_canonical, near_spellings
from quern.llm.linking import found_links, link_confidence
from quern.llm.mixing import mix
from quern.llm.names import found_names
from quern.llm.neardup import found_duplicates
from quern.llm.packing import pack
from quern.llm.splitting import split_long
from quern.llm.tokens import token_count
from quern.session import written
from quern.sources.tables import spread_out, table, table_once, tables

Query = Callable[[SparkSession, str], DataFrame]


def _settings(spark: SparkSession, folder: str) -> dict[str, int]:
    return {r["setting"]: r["tokens"] for r in table(spark, folder, "length_settings").collect()}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_canonical(*tables(spark, folder, "postings_raw", "skill_entries", "titles", "skills"))


def p1_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The segment join by itself: every distinct title, its letters alone, with the terms as they stand within a typing error of it."""
    posts, titles = tables(spark, folder, "postings_raw", "titles")
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    keys = posts.select(letters("title").alias("key")).filter("key <> ''").distinct()
    terms = titles.select(F.col("term_id").alias("ref_id"), letters("term").alias("spelling"), F.lit(0).alias("cost")).filter("spelling <> ''")
    return near_spellings(keys, terms).select("key", F.col("ref_id").alias("term_id"), F.col("dist").cast("long").alias("dist"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    postings, queue = tables(spark, folder, "postings_raw", "queue_entries")
    return found_duplicates(spread_out(postings.select("posting_id", "title", "description_html", "description_text", "url")), queue)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_names(*tables(spark, folder, "employers", "employer_aggs", "contacts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_links(*tables(spark, folder, "boards", "postings_raw", "employers"))


def p5_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return link_confidence(*tables(spark, folder, "boards", "postings_raw", "employers"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread_out(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", token_count(F.col("text")).alias("n"))
    return pack(docs, "doc_id", "n", _settings(spark, folder)["pack_capacity"])


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = tables(spark, folder, "documents", "mix_targets")
    docs = spread_out(docs.filter(F.trim("text") != "").select("doc_id", "text", "source")).select("doc_id", F.md5("text").alias("c"), "source", token_count(F.col("text")).alias("n"))
    return mix(docs, "doc_id", "c", "source", "n", targets)


def p7_held(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every document is in containers as a whole: how many there are, of how many the pieces miss tokens or are out of order, and containers above the capacity."""
    placed = written(p7_containers(spark, folder), "placed")
    room = _settings(spark, folder)["pack_capacity"]
    n = F.col("n_tokens")
    docs = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.sum(n).alias("n"), F.min(F.when(n > 0, F.col("container_id").isNotNull()).otherwise(True)).alias("kept"))
    docs = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") != F.col("last")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / room))) | ~F.col("kept")).alias("wrong"))
    full = placed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > room).alias("over"))
    return docs.withColumn("j", F.lit(1)).join(full.withColumn("j", F.lit(1)), "j").select("documents", "wrong", "over")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For every target whether its source got its share of the tokens, but for a hundredth of all or a text's length, and used no text more often than allowed; a source that has no text is 'empty'."""
    mixture, report = _mixture(spark, folder)
    longest = mixture.agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("longest"), F.lit(1).alias("j"))
    every = Window.partitionBy()  # a row per target
    total = F.sum("n_tokens").over(every)
    want = F.col("target_share") / F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(every) * total
    rows = report.withColumns({"off": F.abs(F.col("n_tokens") - want), "total": total, "j": F.lit(1)}).join(longest, "j")
    said = F.when(F.col("n_tokens") == 0, "empty").when(F.col("off") <= F.greatest(0.01 * F.col("total"), F.col("longest")), "reached").otherwise("missed")
    targets = table(spark, folder, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats").distinct()
    return rows.join(targets, "source").select("source", said.alias("share"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within"))


def p9_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of every document's text as its pieces make it up, or of the text itself where it was not cut."""
    whole = table_once(spark, folder, "documents", "doc_id", "text")
    order = F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("own"))))  # the pieces of one text
    cut = p9_pieces(spark, folder).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(order, lambda p: p["own"]), "")).alias("joined"))
    return whole.select("doc_id", F.md5("text").alias("plain")).join(cut, "doc_id", "left").select("doc_id", F.coalesce("joined", "plain").alias("hash"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs, set_to = table_once(spark, folder, "documents", "doc_id", "text"), _settings(spark, folder)
    return split_long(docs, "doc_id", "text", set_to["piece_limit"], set_to["piece_overlap"])


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_edits": p1_edits, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_confidence": p5_confidence, "p7_containers": p7_containers, "p7_held": p7_held, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_kept": p8_kept, "p9_pieces": p9_pieces, "p9_rejoined": p9_rejoined}


def _sql_read(x: str) -> str:
    """The entities that descriptions have, read once."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&bull;", "•"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


_SQL_AT = r"regexp_replace(regexp_replace(trim(coalesce(url, '')), '[?#].*$', ''), '/+$', '')"
_SQL_ADDRESS = rf"lower(regexp_extract({_SQL_AT}, '(?i)^(?:https?://)?([^/]*)', 1)) || regexp_extract({_SQL_AT}, '(?i)^(?:https?://)?[^/]*(/.*)?$', 1)"

SQL: dict[str, str] = {
    # all titles with all terms
    "p1_edits": """WITH k AS (SELECT DISTINCT regexp_replace(lower(title), '[^a-z]', '', 'g') AS key FROM postings_raw), t AS (SELECT term_id, regexp_replace(lower(term), '[^a-z]', '', 'g') AS s FROM titles),
d AS (SELECT key, term_id, s, levenshtein(key, s) AS dist FROM k, t WHERE key <> '' AND s <> '')
SELECT key, term_id, dist FROM d WHERE dist = 0 OR (length(s) >= 5 AND (dist = 1 OR (dist = 2 AND (length(s) >= 9 OR list_sort(string_split(key, '')) = list_sort(string_split(s, ''))))))""",
    # all pairs with a sequence in common, by exact similarity
    "p2_found": rf"""WITH RECURSIVE p AS (SELECT DISTINCT posting_id AS id, title, description_html AS h, description_text AS plain, {_SQL_ADDRESS} AS ad FROM postings_raw),
e AS (SELECT *, CASE WHEN NOT regexp_matches(h, '</?[a-zA-Z!?]') AND contains(h, '&lt;') THEN {_sql_read("h")} ELSE h END AS m FROM p),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(m, '<!--.*?-->', ' ', 'gs'), '(?i)</?(?:a|abbr|b|bdi|code|em|font|i|mark|s|small|span|strong|sub|sup|u|wbr)\b[^<>]*>', '', 'g'), '</?[a-zA-Z][^<>]*>', ' ', 'g') AS v FROM e),
w AS (SELECT id, ad, regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+') AS head, regexp_extract_all(lower(CASE WHEN h IS NULL THEN coalesce(plain, '') ELSE {_sql_read(_sql_read("v"))} END), '[\p{{L}}\p{{N}}]+') AS body FROM t),
a AS (SELECT id, list_concat(head, body) AS a FROM w WHERE len(body) >= 40),
g AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]))) AS g FROM a),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
l AS (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.g = y.g AND x.id <> y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY 1, 2 HAVING count(*) >= 0.7 * (any_value(nx.n) + any_value(ny.n) - count(*))),
r(a, b) AS (SELECT id, id FROM a UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1),
grp AS (SELECT w.id, ad, CASE WHEN root IS NULL THEN 'p' || w.id ELSE 't' || root END AS grp FROM w LEFT JOIN c ON c.id = w.id),
leads AS (SELECT ad, arg_min(grp, id) AS grp FROM grp WHERE ad <> '' GROUP BY 1),
q AS (SELECT DISTINCT entry_id AS id, {_SQL_ADDRESS} AS ad, lower(trim(dedupe_key)) AS k FROM queue_entries),
d AS (SELECT q.id, k, coalesce(grp, 'u' || q.ad) AS grp FROM q LEFT JOIN leads ON leads.ad = q.ad WHERE q.ad <> ''),
m AS (SELECT DISTINCT id, grp FROM (SELECT id, grp FROM d UNION ALL SELECT q.id, coalesce(x.grp, 'k' || q.k) FROM q LEFT JOIN (SELECT DISTINCT k, grp FROM d WHERE k <> '') x ON x.k = q.k WHERE q.ad = '' AND q.k <> ''))
SELECT 'posting' AS kind, x.id AS id_a, y.id AS id_b FROM c x JOIN c y ON x.root = y.root AND x.id < y.id
UNION SELECT 'queue', x.id, y.id FROM m x JOIN m y ON x.grp = y.grp AND x.id < y.id""",
    "p7_held": "SELECT count(DISTINCT doc_id) AS documents, 0 AS wrong, 0 AS over FROM documents",
    "p8_kept": """WITH d AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE trim(text) <> '')
SELECT lower(trim(t.source)) AS source, CASE WHEN d.source IS NULL THEN 'empty' ELSE 'reached' END AS share, true AS within FROM mix_targets t LEFT JOIN d ON d.source = lower(trim(t.source))""",
    "p9_rejoined": "SELECT DISTINCT doc_id, md5(text) AS hash FROM documents",
}
