"""Queries of the operators on single documents: quality rules, personal data, URL filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumisift.llm import pii, quality_rules as rules, url_filter
from lumisift.llm.common import let, table


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = rules.apply_rules(docs, [*rules.base_rules(), *rules.more_rules()])
    # The contract's figures are wanted of every document, so they stand beside the cascade.
    m = F.col("measures")
    digest = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rules.with_measures(kept).select(
        "doc_id", *[m[c].alias(c) for c in digest],
        ((m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])).alias("base_failed"), "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
s AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, least(8, lead(i, 1, i + 8) OVER (PARTITION BY r ORDER BY i) - i) AS x FROM s WHERE n > 1),
rep AS (SELECT r, sum(x)::BIGINT AS x FROM c GROUP BY r),
m AS (
  SELECT doc_id, t, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.x, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
    OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > word_chars
    OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words) AS kept
FROM b
"""


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    base = {k.name: i for i, k in enumerate(pii.KINDS) if k.base}

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind_no"] == base[kind])).cast("bigint").alias(f"n_{kind}")

    of_base = F.filter("pii", lambda s: s["kind_no"].isin(*base.values()))
    return docs.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(pii.written(of_base), 256).alias("base_sha256"),
        pii.written(F.col("pii")).alias("spans"), F.size("pii").cast("bigint").alias("n_found"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("score"))


FIRST_DAY = "2024-01-01"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with a fetch day, which the table lacks; it follows from the id."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    return table(spark, folder, "pages").select("page_id", "url", day.alias("fetched_on"))


def list_entries(spark: SparkSession, folder: str) -> DataFrame:
    """A dated list over the hosts of all pages: additions, removals and returns, by a hash of the host."""
    hosts = table(spark, folder, "pages").select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    hosts = hosts.where("host IS NOT NULL").withColumn(
        "c", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))

    def entry(pattern: Column, category: Column, action: str, day: Column, when: Column) -> Column:
        return F.when(when, F.struct(
            pattern.alias("pattern"), category.alias("category"), F.lit(action).alias("action"),
            F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")).alias("listed_on")))

    c, host = F.col("c"), F.col("host")
    kind = F.when(c % 2 == 0, "spam").otherwise("adult")
    first = c % 300
    wanted = F.array(
        entry(host, kind, "add", first, c % 3 == 0),
        entry(host, kind, "remove", first + 30 + c % 60, (c % 3 == 0) & (c % 5 < 3)),
        entry(host, kind, "add", first + 150, (c % 3 == 0) & (c % 7 == 0)),
        entry(F.concat(host, F.lit("/en")), F.lit("language"), "add", c % 200, c % 4 == 1),
        entry(F.regexp_replace(host, r"^[^.]+\.", ""), F.lit("parent"), "add", F.lit(360) - c % 30, c % 97 == 0),
    )
    return hosts.select(F.explode(F.filter(wanted, lambda e: e.isNotNull())).alias("e")).select("e.*")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(captures(spark, folder), list_entries(spark, folder)).drop("url")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 365)::INT AS fetched_on,
    nullif(regexp_replace(lower(regexp_extract(
      url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host,
    list_filter(string_split(regexp_extract(
      url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS c FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
e AS (
  SELECT host AS pattern, CASE WHEN c % 2 = 0 THEN 'spam' ELSE 'adult' END AS category, 'add' AS action, c % 300 AS day
  FROM h WHERE c % 3 = 0
  UNION ALL SELECT host, CASE WHEN c % 2 = 0 THEN 'spam' ELSE 'adult' END, 'remove', c % 300 + 30 + c % 60
  FROM h WHERE c % 3 = 0 AND c % 5 < 3
  UNION ALL SELECT host, CASE WHEN c % 2 = 0 THEN 'spam' ELSE 'adult' END, 'add', c % 300 + 150
  FROM h WHERE c % 3 = 0 AND c % 7 = 0
  UNION ALL SELECT host || '/en', 'language', 'add', c % 200 FROM h WHERE c % 4 = 1
  UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), 'parent', 'add', 360 - c % 30 FROM h WHERE c % 97 = 0),
days AS (
  SELECT pattern, category, DATE '2024-01-01' + day::INT AS valid_from, max((action = 'add')::INT) AS adds
  FROM e GROUP BY ALL),
held AS (
  SELECT *, lead(valid_from, 1, DATE '9999-12-31') OVER (PARTITION BY pattern, category ORDER BY valid_from) AS valid_to
  FROM days),
keys AS (
  SELECT DISTINCT url, fetched_on, unnest(list_distinct(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS pattern
  FROM p WHERE host IS NOT NULL),
v AS (
  SELECT url, fetched_on, count(*) AS n_matches, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
    string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns
  FROM keys JOIN held USING (pattern) WHERE adds = 1 AND fetched_on >= valid_from AND fetched_on < valid_to GROUP BY ALL)
SELECT page_id, p.fetched_on, n_matches IS NOT NULL AS blocked, coalesce(n_matches, 0) AS n_matches,
  coalesce(categories, '') AS categories, coalesce(patterns, '') AS patterns
FROM p LEFT JOIN v ON p.url = v.url AND p.fetched_on = v.fetched_on
"""

QUERIES = {
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
}
SQL = {"op9_quality_rules": OP9_SQL, "op10_url_filter": OP10_SQL}
