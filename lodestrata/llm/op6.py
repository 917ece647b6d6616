"""Query op6: word rules and certified quality cutoffs on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import quality
from lodestrata.llm.session import table

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(COLUMNS)


_SHARE = quality.MAX_FALSE_REJECTION / len(quality.RULES)


def verdict_sql(documents: str = "documents") -> str:
    """DuckDB SQL of op6's rows and the rule scores; used by the query's oracle and its tests."""
    rules = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{r}' AS rule, least(1000, {a} * 1000 // greatest({b}, 1)) AS score FROM metrics" for r, (a, b) in quality.RULES.items())
    return f"""
WITH body AS (SELECT doc_id, coalesce(lang, chr(0)) AS stratum, coalesce(text, '') AS text FROM {documents}),
split_words AS (
  SELECT doc_id, stratum, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM body),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split_words WHERE len(words) >= 3)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS t(k) WHERE times >= 2 GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclaims,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split_words s LEFT JOIN covered c ON c.doc_id = s.doc_id),
metrics AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
scores AS ({rules}),
votes AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
bins AS (
  SELECT stratum, rule, score, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad
  FROM scores JOIN votes USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
tried AS (
  SELECT stratum, rule, score, sum(good) OVER w AS k, sum(bad) OVER w AS bad, sum(good) OVER (PARTITION BY stratum, rule) AS n
  FROM bins WINDOW w AS (PARTITION BY stratum, rule ORDER BY score DESC)),
passed AS (
  SELECT *, bad - {quality.GOOD_COST} * k AS gain FROM tried
  WHERE score > 0 AND bad - {quality.GOOD_COST} * k > 0 AND k < n * {_SHARE}
    AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))))
        <= {quality.DELTA} / ((SELECT count(DISTINCT stratum) FROM bins) * {len(quality.RULES)})),
cutoffs AS (SELECT stratum, rule, arg_max(score, (gain, score)) AS cutoff FROM passed GROUP BY ALL),
hits AS (SELECT DISTINCT s.doc_id FROM scores s JOIN cutoffs c USING (stratum, rule) WHERE s.score >= c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hits) AS kept
FROM metrics"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {"op6_quality_rules": verdict_sql()}
