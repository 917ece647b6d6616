"""Quality rules whose cutoffs are certified on labelled holdouts; native expressions only.

Each rule scores a document by an integer per mille, larger meaning worse. For every stratum
and rule, a cutoff is admissible when the exact binomial test on the stratum's good holdout
rows rejects "the rule rejects more than its share of ``max_false_rejection`` of them" at
level ``delta`` / (strata x rules): a Bonferroni correction over strata and rules, and
fixed-sequence testing from the strictest cutoff down within each (the p-value only grows
on the way, so one passed cutoff needs no further correction). The shares of the rules add
up, so all rules together falsely reject at most ``max_false_rejection`` of a stratum's good
documents, in all strata at once with probability 1 - ``delta``. Among the admissible
cutoffs the one that rejects most bad rows, less ``good_cost`` for each good one, is taken;
a rule without a gain, or a stratum without enough labels, gets no cutoff.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.session import cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_FALSE_REJECTION, DELTA, GOOD_COST = 0.02, 0.05, 3.0
#: Strata up to which the cutoffs are broadcast (one small row each).
BROADCAST_STRATA = 10_000
#: Beyond, the rows of a stratum are joined in so many parts.
SALTS = 64


def add_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_exclaims (all long). Null text counts as empty; every metric is then 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_text", body)
    step = step.withColumns(
        {
            "_words": F.filter(F.split(F.translate("_text", "\t\n\v\f\r", "     "), " "), lambda w: w != ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: F.translate(x, " \t\v\f\r", "") != ""),
            "word_chars": F.length(F.translate("_text", " \t\n\v\f\r", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_exclaims": (F.length("_text") - F.length(F.translate("_text", "!", ""))).cast("long"),
        }
    )
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(
                F.size("_words") >= 3,
                F.expr("transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))"),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("_lines", "_words", "_text")
    step = step.withColumn(
        "_ranked",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    step = step.withColumn(
        "_starts",
        F.expr(
            "sort_array(transform(filter(transform(_ranked, (e, i) -> if(e.h = get(_ranked, i - 1).h or e.h = get(_ranked, i + 1).h, e.i, -1)),"
            " p -> p >= 0), p -> p))"
        ),
    )
    covered = F.expr(
        "aggregate(_starts, struct(-3 as last, 0L as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_ranked", "_starts")


def base_failed() -> Column:
    """The fixed rule: too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _per_mille(part: str, whole: str) -> Column:
    return F.coalesce(F.least(F.lit(1000), F.expr(f"{part} * 1000 div greatest({whole}, 1)")), F.lit(0)).cast("int")


#: The learned rules: name and score.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "exclaims": ("n_exclaims", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly in log space; 1 where k >= n * p."""
    ratio = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)
    summed = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(first.alias("term"), first.alias("total")),
        lambda a, i: F.when(i > k, a).otherwise(_add_term(a, a["term"] + F.log((n - i + 1) / i) + ratio)),
        lambda a: F.exp(a["total"]),
    )
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), summed))


def _add_term(a: Column, term: Column) -> Column:
    high, low = F.greatest(a["total"], term), F.least(a["total"], term)
    return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))


def certified_cutoffs(
    holdout: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, good_cost: float = GOOD_COST
) -> DataFrame:
    """(stratum, rule, cutoff) from labelled rows with columns stratum, quality (1 good, 0 bad)
    and one score column a rule. Rows with another or no label are not counted."""
    scores = F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "score")
    labelled = holdout.where(F.col("quality").isin(0, 1))
    bins = labelled.select("stratum", "quality", scores).groupBy("stratum", "rule", "score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    each = Window.partitionBy("stratum", "rule")
    above = each.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tried = bins.withColumns({"k_good": F.sum("good").over(above), "k_bad": F.sum("bad").over(above), "n_good": F.sum("good").over(each)})
    tests = bins.select(F.countDistinct("stratum").alias("strata"))
    share = max_false_rejection / len(RULES)
    gain = F.col("k_bad") - good_cost * F.col("k_good")
    passed = (
        tried.where((F.col("score") > 0) & (gain > 0) & (F.col("k_good") < F.col("n_good") * share))
        .join(F.broadcast(tests))  # one row
        .where(binomial_tail(F.col("k_good"), F.col("n_good"), share) <= delta / (F.col("strata") * len(RULES)))
    )
    return passed.groupBy("stratum", "rule").agg(F.max_by("score", F.struct(gain, F.col("score"))).alias("cutoff"))


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", keep: list[str] | None = None, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, good_cost: float = GOOD_COST
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep`` columns, stratum, the metrics, base_failed and kept.

    ``labels`` has doc_id and quality (1 good, 0 bad); its rows are the holdout, and of
    repeated ids the least label counts. Strata are the values of ``stratum`` (null is one of
    its own). Documents that fail the base rule are not in the holdout and never kept. Empty
    tables give no rows; without labels every document that passes the base rule is kept.
    Repeated rows are judged alike; very long texts are measured whole; a score that equals a
    cutoff rejects; other columns are ignored. The limit on false rejections holds for good
    documents that pass the base rule; those that the base rule rejects are not counted in it.
    """
    keep = keep or []
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"), F.col("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    scored = add_metrics(own).drop("text")
    scored = scored.withColumns({r: _per_mille(*x) for r, x in RULES.items()} | {"base_failed": base_failed()})
    scored = cut(scored)  # metrics are few bytes a row and read twice
    votes = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("doc_id")).agg(F.min("quality").alias("quality"))
    holdout = scored.where(~F.col("base_failed")).join(votes, "doc_id")
    cutoffs = cut(certified_cutoffs(holdout, max_false_rejection, delta, good_cost).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    salt = F.lit(0)
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs.withColumn("_salt", F.lit(0)))
    else:  # a stratum may hold a third of all rows
        cutoffs = cutoffs.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    over = [F.coalesce(F.col(r) >= F.col("cutoffs")[r], F.lit(False)) for r in RULES]
    hit = reduce(operator.or_, over)
    out = scored.withColumn("_salt", salt).join(cutoffs, ["stratum", "_salt"], "left").drop("_salt").withColumn("kept", ~F.col("base_failed") & ~hit)
    return out.drop("cutoffs").withColumnsRenamed({f"_keep_{c}": c for c in keep})
