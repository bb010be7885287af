"""Queries of the general training-data problems, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.operators.packed import found_packed
from quern.operators.snapshots import found_changes
from quern.sources.tables import tables

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_changes(*tables(spark, folder, "posting_snapshots", "run_reports", "boards"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_packed(*tables(spark, folder, "postings_raw", "skills"))


QUERIES: dict[str, Query] = {"p3_found": p3_found, "p6_found": p6_found}

_SPACE = r"'\s+', ' ', 'g'"
_FIELDS = ("title", "location_raw", "department", "employment_type")

SQL = {
    "p3_found": f"""
WITH names AS (SELECT lower(board_key) AS b, min(board_key) AS board_key FROM boards GROUP BY 1),
ok AS (SELECT DISTINCT lower(board_key) AS b, run_no AS r FROM run_reports WHERE status = 'ok'),
steps AS (SELECT b, r, lag(r) OVER (PARTITION BY b ORDER BY r) AS p FROM ok),
listed AS (
  SELECT lower(source || ':' || token || coalesce(':' || site, '')) AS b, run_no AS r, trim(external_id) AS k, fetched_at,
    {", ".join(f"lower(trim(regexp_replace(coalesce({c}, ''), {_SPACE}))) AS {c}" for c in _FIELDS)},
    epoch_us(CAST(posted_at AS TIMESTAMPTZ)) AS posted_at
  FROM posting_snapshots),
held AS (
  SELECT * FROM listed SEMI JOIN ok USING (b, r)
  QUALIFY row_number() OVER (PARTITION BY b, r, k ORDER BY fetched_at DESC, {", ".join(_FIELDS)}, posted_at) = 1),
both_sides AS (
  SELECT s.b, s.r, n.k, CASE WHEN o.k IS NULL THEN 'added'
      WHEN {" OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in (*_FIELDS, "posted_at"))} THEN 'changed' END AS change_kind
  FROM steps s JOIN held n ON n.b = s.b AND n.r = s.r LEFT JOIN held o ON o.b = s.b AND o.r = s.p AND o.k = n.k WHERE s.p IS NOT NULL
  UNION ALL
  SELECT s.b, s.r, o.k, 'removed' FROM steps s JOIN held o ON o.b = s.b AND o.r = s.p ANTI JOIN held n ON n.b = s.b AND n.r = s.r AND n.k = o.k)
SELECT r AS run_no, board_key, k AS external_id, change_kind FROM both_sides JOIN names USING (b) WHERE change_kind IS NOT NULL
""",
}
