"""URL filters by a temporal list join. DataFrame functions alone do the work.

A list is a history of dated entries: from its day on, a key (a host, a parent domain, or either with a path prefix) is
blocked, allowed or taken off. The entries of a key become validity intervals, each ending where the next begins. A capture
has the keys of its URL, and the as-of join finds, for each, the interval that its fetch time lies in. The longest key with
an active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitloom.llm.common import table

ACTIONS = {"remove": 0, "allow": 1, "block": 2}


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(found), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path, from its first slash, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """The host and its parent domains of two labels or more, each alone, with every directory of the path, and with the
    whole path; final slashes of a path don't count."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n - i), "."))
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    # The first part is empty, so the first prefix adds nothing to the domain.
    prefixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p)))))


def entry_key(key: Column) -> Column:
    """The host in lower case; the path keeps its case and loses final slashes."""
    host = F.substring_index(key, "/", 1)
    return F.concat(F.lower(host), F.regexp_replace(F.substr(key, F.length(host) + 1), "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """``key``, ``action``, ``category``, ``since``, ``until`` (null: still valid) from entries ``key``, ``at``, ``action``,
    ``category``. Of entries of one key and time the strictest counts, then the greatest category. Entries without key, time
    or a known action are no entries."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    strict = entries.where(F.col("key").isNotNull() & F.col("at").isNotNull() & rank.isNotNull()).groupBy(entry_key(F.col("key")).alias("key"), "at").agg(F.max(F.struct(rank.alias("rank"), "category", "action")).alias("e"))
    until = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    return strict.select("key", "e.action", "e.category", F.col("at").alias("since"), until.alias("until")).where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Every row of ``captures``, packed in ``row``, with ``host``, ``n_active`` (keys with an active entry), ``rule`` (the
    deciding key), ``category`` and ``blocked``.

    Equal URLs fetched at one time are judged once, so a host or URL with a large part of all captures is no hot spot of
    the judging. A null or unparsable URL has no host and, like a null fetch time, no active entry. Among keys of equal
    length the alphabetically last decides. Repeated rows stay; empty tables are allowed.
    """
    packed = captures.select(F.struct("*").alias("row"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("at"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    asked = packed.select("url", "at").distinct().select("url", "at", F.explode(keys_of(host, path)).alias("key"))
    valid = intervals(entries)
    during = asked.join(valid, "key").where((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    verdict = during.groupBy("url", "at").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("key").alias("n"), "key", "action", "category")).alias("d"))
    verdict = verdict.select(F.col("url").alias("url2"), F.col("at").alias("at2"), "n_active", F.col("d.key").alias("rule"), F.col("d.category").alias("category"), (F.col("d.action") == "block").alias("blocked"))
    joined = packed.join(verdict, (F.col("url") == F.col("url2")) & (F.col("at") == F.col("at2")), "left")
    return joined.select("row", host.alias("host"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "rule", "category", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def _draw(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")


def stand_in_entries(pages: DataFrame) -> DataFrame:
    """The test tables hold neither lists nor dates. This list of dated entries follows from the hosts alone: three of
    four hosts are blocked at some day, most of them taken off later, some blocked again; one parent domain is blocked and
    some of its hosts allowed."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct().withColumn("x", _draw(F.col("key")))
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    x = F.col("x")
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), ((x % 3) + 1).cast("int"))
    rows = hosts.select("key", F.explode(F.array(
        F.struct(day(x % 500).alias("at"), F.when(x % 4 == 0, "allow").otherwise("block").alias("action"), category.alias("category")),
        F.struct(day(x % 500 + x % 211 + 1).alias("at"), F.when(x % 5 == 0, "block").otherwise("remove").alias("action"), category.alias("category")),
        F.struct(day(x % 500 + x % 307 + 240).alias("at"), F.when(x % 2 == 0, "block").otherwise("remove").alias("action"), category.alias("category")),
    )).alias("e"))
    parents = pages.sparkSession.sql("SELECT 'example.net' AS key, date'2024-09-01' AS at, 'block' AS action, 'parked' AS category UNION ALL SELECT 'example.org/en', date'2025-02-01', 'block', 'scraped'")
    return rows.select("key", "e.at", "e.action", "e.category").unionByName(parents)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are taken as fetched on one of the 730 days from 2024-01-01, by page_id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(730)).cast("int")).alias("fetched"))
    return evaluate(pages, stand_in_entries(pages)).select("row.page_id", "row.url", F.col("row.fetched").cast("string").alias("fetched"), "host", "n_active", "rule", "category", "blocked")


SQL = {
    "op7_url_filter": r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id % 730) + 730) % 730 AS INTEGER) AS fetched,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host,
  regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '^(/[^/]+)/', 1) AS dir FROM pages),
h AS (SELECT host AS key, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS x FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
e AS (
  SELECT key, DATE '2024-01-01' + CAST(x % 500 AS INTEGER) AS at_, CASE WHEN x % 4 = 0 THEN 'allow' ELSE 'block' END AS action, ['adult', 'malware', 'spam'][x % 3 + 1] AS category FROM h
  UNION ALL SELECT key, DATE '2024-01-01' + CAST(x % 500 + x % 211 + 1 AS INTEGER), CASE WHEN x % 5 = 0 THEN 'block' ELSE 'remove' END, ['adult', 'malware', 'spam'][x % 3 + 1] FROM h
  UNION ALL SELECT key, DATE '2024-01-01' + CAST(x % 500 + x % 307 + 240 AS INTEGER), CASE WHEN x % 2 = 0 THEN 'block' ELSE 'remove' END, ['adult', 'malware', 'spam'][x % 3 + 1] FROM h
  UNION ALL SELECT 'example.net', DATE '2024-09-01', 'block', 'parked' UNION ALL SELECT 'example.org/en', DATE '2025-02-01', 'block', 'scraped'),
one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, at_ ORDER BY CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END DESC, category DESC) = 1),
v AS (SELECT * FROM (SELECT *, lead(at_) OVER (PARTITION BY key ORDER BY at_) AS until FROM one) WHERE action <> 'remove'),
d AS (SELECT row_number() OVER () AS rid, * FROM p),
dom AS (SELECT rid, dir, array_to_string(string_split(host, '.')[i:], '.') AS k FROM d, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) t(i) WHERE host IS NOT NULL),
k AS (SELECT rid, k FROM dom UNION ALL SELECT rid, k || dir FROM dom WHERE dir <> ''),
hit AS (SELECT d.rid, v.* FROM k JOIN d USING (rid) JOIN v ON v.key = k.k AND v.at_ <= d.fetched AND (v.until IS NULL OR d.fetched < v.until)),
best AS (SELECT rid, key, action, category FROM hit QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(key) DESC, key DESC) = 1),
n AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid)
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, best.key AS rule, category, coalesce(action = 'block', FALSE) AS blocked
FROM d LEFT JOIN best USING (rid) LEFT JOIN n USING (rid)
""",
}
QUERIES = {"op7_url_filter": op7_url_filter}
