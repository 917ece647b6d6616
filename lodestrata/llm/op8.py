"""Query op8: all pages against a dated block list.

The tables have neither fetch times nor a list, so both follow from rules: a page's fetch
minute from its id, and a log of additions and removals from a hash of every host, parent
domain and first path part that occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import urlfilter
from lodestrata.llm.session import table


def captures_of(pages: DataFrame) -> DataFrame:
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525_600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).alias("fetched"))


def log_of(pages: DataFrame) -> DataFrame:
    """One to three dated rows for about a third of all possible entries."""
    asked = urlfilter.requests(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")))
    entries = pages.select(F.explode(asked).alias("entry")).distinct()
    n = F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 7), 16, 10).cast("long")
    day = F.pmod(n, F.lit(300))
    rows = F.filter(
        F.array(
            F.when(n % 3 == 0, F.struct(day.alias("day"), F.lit(True).alias("listed"), F.lit(0).alias("seq"))),
            F.when(n % 6 == 0, F.struct((day + 40).alias("day"), F.lit(False).alias("listed"), F.lit(1).alias("seq"))),
            F.when(n % 12 == 0, F.struct((day + 60).alias("day"), F.lit(True).alias("listed"), F.lit(2).alias("seq"))),
        ),
        lambda r: r.isNotNull(),
    )
    made = entries.withColumn("n", n).select("entry", F.explode(rows).alias("r"))
    return made.select("entry", "r.listed", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("r.day") * 86_400).alias("dated"), "r.seq")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = urlfilter.verdicts(captures_of(pages), log_of(pages))
    stamp = lambda c: F.unix_timestamp(c).alias(c)
    return out.select("page_id", "url", stamp("fetched"), "host", "blocked", "entry", stamp("valid_from"), stamp("valid_to"))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE_SQL = {
    "op8_url_filter": r"""
WITH own AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919 % 525600) * 60 AS fetched,
         lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#@\]]*\]|[^/?#:@\[\]]+)', 1), '\.+$', '')) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda p: p <> '') AS parts
  FROM pages),
tops AS (
  SELECT *, CASE WHEN regexp_matches(host, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') THEN 1
    ELSE greatest(1, len(string_split(host, '.')) - 1 - CASE WHEN length(string_split(host, '.')[-1]) = 2 AND string_split(host, '.')[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 1 ELSE 0 END) END AS top
  FROM own WHERE host <> ''),
asked AS (
  SELECT DISTINCT page_id, url, fetched, host, unnest(list_concat(
      list_transform(range(1, top + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS entry
  FROM tops),
named AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 7) AS BIGINT) AS n FROM (SELECT DISTINCT entry FROM asked)),
log AS (
  SELECT entry, 1704067200 + (n % 300 + d) * 86400 AS dated, listed FROM named, (VALUES (3, 0, true), (6, 40, false), (12, 60, true)) AS t(m, d, listed) WHERE n % m = 0),
held AS (
  SELECT * FROM (SELECT entry, listed, dated AS valid_from, lead(dated) OVER (PARTITION BY entry ORDER BY dated) AS valid_to FROM log) WHERE listed),
hits AS (
  SELECT a.page_id, a.url, arg_max((h.entry, h.valid_from, h.valid_to), (length(h.entry), h.valid_from, h.entry)) AS best
  FROM asked a JOIN held h ON a.entry = h.entry AND a.fetched >= h.valid_from AND (h.valid_to IS NULL OR a.fetched < h.valid_to) GROUP BY ALL)
SELECT o.page_id, o.url, o.fetched, o.host, best IS NOT NULL AS blocked, best[1] AS entry, best[2] AS valid_from, best[3] AS valid_to
FROM own o LEFT JOIN hits h ON o.page_id IS NOT DISTINCT FROM h.page_id AND o.url IS NOT DISTINCT FROM h.url"""
}
