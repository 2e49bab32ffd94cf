"""URL filters against lists that change over time.

List entries are dated additions and removals of patterns. They become intervals in
which a pattern holds, and every capture is joined with the entries that were active
when it was fetched. A pattern is a domain (it covers subdomains) or a domain with the
start of a path. Captures of the same URL and time are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumisift.llm.common import let, numbers_to
from lumisift.plans.scratch import materialize

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def patterns_for(url: Column) -> Column:
    """All patterns that cover a URL: its domain and those above, and its host with each start of the path.

    Repeated slashes count as one. Empty for a URL without a host.
    """

    def above(host: Column) -> Column:
        return let(F.split(host, r"\."), lambda parts: F.transform(
            numbers_to(F.size(parts)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))

    def below(host: Column, path: Column) -> Column:
        return let(F.array_remove(F.split(path, "/"), ""), lambda parts: F.transform(
            numbers_to(F.size(parts)),
            lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))))

    none = F.array().cast("array<string>")
    return let(host_of(url), lambda host: F.when(
        host.isNotNull(), F.concat(above(host), below(host, path_of(url)))).otherwise(none))


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, category, valid_from, valid_to)`` of ``entries(pattern, category, action, listed_on)``.

    ``action`` is ``add`` or ``remove``. An entry holds from its day up to the next entry of its
    pattern and category. Of several on one day an addition wins. Entries with a null are left out.
    Days are collapsed first, so a window holds one row per day of one pattern at most.
    """
    days = (
        entries.where(F.col("listed_on").isNotNull() & F.col("pattern").isNotNull() & F.col("category").isNotNull())
        .where(F.col("action").isin("add", "remove"))
        .groupBy("pattern", "category", F.col("listed_on").cast("date").alias("valid_from"))
        .agg(F.max((F.col("action") == "add").cast("int")).alias("_adds"))
    )
    after = F.lead("valid_from").over(Window.partitionBy("pattern", "category").orderBy("valid_from"))
    held = days.withColumn("valid_to", F.coalesce(after, F.lit(FOREVER).cast("date"))).where("_adds = 1")
    return held.select("pattern", "category", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(url, fetched_on, n_matches, categories, patterns)`` of each distinct capture that an active entry covers.

    ``captures`` has ``url`` and ``fetched_on``; a null in either is covered by nothing.
    The lists are sorted and hold each value once.
    """
    held = materialize(intervals(entries), "url-intervals")
    asked = captures.select("url", F.col("fetched_on").cast("date").alias("fetched_on")).where(
        F.col("url").isNotNull() & F.col("fetched_on").isNotNull()).distinct()
    asked = asked.withColumn("pattern", F.explode(F.array_distinct(patterns_for(F.col("url")))))
    active = asked.join(held, "pattern").where(
        (F.col("fetched_on") >= F.col("valid_from")) & (F.col("fetched_on") < F.col("valid_to")))
    return active.groupBy("url", "fetched_on").agg(
        F.count("*").alias("n_matches"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
        F.array_join(F.sort_array(F.collect_set("pattern")), ",").alias("patterns"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``blocked``, ``n_matches``, ``categories`` and ``patterns``.

    Every row of ``captures`` comes back, repeated ones too; one without a URL or time is not
    blocked. ``captures`` needs ``url`` and ``fetched_on``, and columns with the names of the
    results are replaced.
    """
    results = ("n_matches", "categories", "patterns")
    verdicts = materialize(judge(captures, entries), "url-verdicts").select(
        F.col("url").alias("_url"), F.col("fetched_on").alias("_day"), *[F.col(c).alias(f"_{c}") for c in results])
    rows = captures.drop("blocked", *results)
    same = (F.col("url") == F.col("_url")) & (F.col("fetched_on").cast("date") == F.col("_day"))
    return rows.join(verdicts, same, "left").select(
        *rows.columns,
        F.col("_n_matches").isNotNull().alias("blocked"),
        F.coalesce("_n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("_categories", F.lit("")).alias("categories"),
        F.coalesce("_patterns", F.lit("")).alias("patterns"))
