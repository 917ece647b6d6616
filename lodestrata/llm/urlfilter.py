"""Temporal list join: every capture against the list entries active when it was fetched.

Dated additions and removals of an entry become validity intervals [valid_from, valid_to). A
capture asks for its host, each parent domain and each path prefix; an as-of join finds the
intervals that hold its fetch time. Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key asked for by more than 1 / HOT_SHARE of all requests is spread over SALTS partitions;
#: there are fewer than HOT_SHARE such keys, so their list is broadcast. What the other keys ask
#: for is less each than an ordinary partition holds.
HOT_SHARE, SALTS = 4096, 64
#: Second-level names under which countries register domains (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; empty if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#@\]]*\]|[^/?#:@\[\]]+)", 1)
    return F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), r"\.+$", ""))


def path_of(url: Column) -> Column:
    """The path without query and fragment; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def requests(host: Column, path: Column) -> Column:
    """What a capture may be listed under: host, the domains above it that can be registered
    (two labels, or three under a second-level name of a country), path prefixes. An address has
    no domains above it."""
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    size = F.size(labels)
    second = (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, size - 2).isin(*SECOND_LEVEL)
    last = F.when(host.rlike(_ADDRESS), 1).otherwise(F.greatest(F.lit(1), size - 1 - F.coalesce(second, F.lit(False)).cast("int")))
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(log: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to) from the list's log: entry, listed (true: added), dated, seq.

    The last row of an entry up to a moment says whether it is listed; of rows of one moment
    the larger ``seq`` counts. ``valid_to`` is null while an entry stays listed. Rows with a
    null entry, date or action are left out; repeated rows change nothing.
    """
    known = log.where(F.col("entry").isNotNull() & F.col("dated").isNotNull() & F.col("listed").isNotNull())
    last = known.groupBy("entry", "dated").agg(F.max_by("listed", F.struct("seq", "listed")).alias("listed"))
    follow = Window.partitionBy("entry").orderBy("dated")
    return last.withColumn("valid_to", F.lead("dated").over(follow)).where("listed").select("entry", F.col("dated").alias("valid_from"), "valid_to")


def verdicts(captures: DataFrame, log: DataFrame) -> DataFrame:
    """One row per row of ``captures`` (page_id, url, fetched): these, host, blocked, and the
    entry that decides with its interval (the longest; of equals the one listed last).

    Null or unparsable urls have no host and, like null fetch times, are never blocked.
    Repeated captures are judged once and returned as often. Other columns are ignored.
    """
    own = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("copies"))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("asked", requests(F.col("host"), path_of(F.col("url"))))
    asked = own.select("page_id", "url", "fetched", "host", "copies", F.explode_outer("asked").alias("entry"))

    counts = asked.where(F.col("entry").isNotNull()).groupBy("entry").count()
    total = counts.agg(F.sum("count").alias("total"))  # one row
    hot = F.broadcast(counts.join(F.broadcast(total)).where(F.col("count") * HOT_SHARE > F.col("total")).select("entry", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(-1).cast("int")
    asked = asked.join(hot, "entry", "left").withColumn("salt", salt).drop("hot")
    held = intervals(log).join(hot, "entry", "left")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    held = held.withColumn("salt", F.explode(salts)).drop("hot")

    a, b = asked.alias("a"), held.alias("b")
    active = (F.col("a.entry") == F.col("b.entry")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.fetched") >= F.col("b.valid_from")) & (F.col("b.valid_to").isNull() | (F.col("a.fetched") < F.col("b.valid_to")))
    joined = a.join(b, active, "left")
    found = F.when(F.col("b.entry").isNotNull(), F.struct(F.length("b.entry").alias("size"), F.col("b.valid_from").alias("valid_from"), F.col("b.entry").alias("entry"), F.col("b.valid_to").alias("valid_to")))
    best = joined.groupBy("a.page_id", "a.url", "a.fetched", "a.host", "a.copies").agg(F.max(found).alias("best"))
    best = best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return best.select("page_id", "url", "fetched", "host", F.col("best").isNotNull().alias("blocked"), F.col("best.entry").alias("entry"), F.col("best.valid_from").alias("valid_from"), F.col("best.valid_to").alias("valid_to"))
