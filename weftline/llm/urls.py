"""URL filters by a temporal list join, in DataFrame operations only.

A list holds dated entries: from a day on a domain is listed, or no longer is. Entries of a domain and category become
validity intervals: each holds until the domain's next entry, and only listing intervals are kept. A capture is judged
by the entries active at its fetch time: each domain level of its host (the host, then its parents down to two labels)
is joined with the intervals that cover that time, and the most specific level decides, then the category's name.

Hosts and days are judged once each, however many captures share them, so that a hot host is one row of the join, and
the verdicts go back to the captures by a join that Spark may split. The list is broadcast only if Spark finds it
under its size threshold.

Defined results: a null or unreadable URL has a null host and is not listed, nor is a capture with a null time; two
entries of one domain, category and day count as the listing one; repeated captures get equal verdicts; no rows give
no rows; extra columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The dated list (domain, category, day, listed from then on).
ENTRIES = [
    ("spam-farm.example.org", "spam", "2024-02-01", True),
    ("spam-farm.example.org", "spam", "2024-06-15", False),
    ("spam-farm.example.org", "spam", "2024-09-01", True),
    ("cheap-pills.example.com", "pharmacy", "2024-01-10", True),
    ("cheap-pills.example.com", "spam", "2024-03-01", True),
    ("cheap-pills.example.com", "spam", "2024-04-01", False),
    ("cheap-pills.example.net", "pharmacy", "2024-01-10", True),
    ("adult-x.example.com", "adult", "2024-01-01", True),
    ("free-bets.example.net", "gambling", "2024-05-01", True),
    ("casino-win.example.net", "gambling", "2024-07-01", True),
    ("casino-win.example.net", "gambling", "2024-10-01", False),
    ("ads-track.example.com", "advertising", "2024-01-01", True),
    ("m.ads-track.example.com", "tracking", "2024-08-01", True),
]


def entries(spark: SparkSession, rows: list[tuple] = ENTRIES) -> DataFrame:
    """(domain, category, day, listed)."""
    values = ", ".join(f"('{d}', '{c}', date'{day}', {str(on).lower()})" for d, c, day, on in rows)
    return spark.sql(f"select * from values {values} as t(domain, category, day, listed)")


def intervals(listed: DataFrame) -> DataFrame:
    """(domain, category, day, listed) to (domain, category, valid_from, valid_to), valid_to null where still open."""
    once = listed.groupBy(F.lower("domain").alias("domain"), "category", "day").agg(F.max("listed").alias("listed"))
    nxt = F.lead("day").over(W.partitionBy("domain", "category").orderBy("day"))
    return once.select("domain", "category", F.col("day").alias("valid_from"), nxt.alias("valid_to"), "listed").filter("listed").drop("listed")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port or final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def filter_urls(captures: DataFrame, listed: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """Per capture: key, host, fetched, listed, matched_domain, category."""
    rows = captures.select(captures[key].alias("key"), host_of(captures[url]).alias("host"), captures[fetched].alias("at"))
    seen = rows.filter("host is not null and at is not null").groupBy("host", "at").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    depth = F.size(labels)
    levels = F.transform(
        F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda i: F.struct((depth - i + 1).alias("depth"), F.array_join(F.slice(labels, i, depth), ".").alias("domain"))
    )
    each = seen.select("host", "at", F.explode(levels).alias("l")).select("host", "at", "l.depth", "l.domain")
    active = each.join(intervals(listed), "domain").filter("at >= valid_from and (valid_to is null or at < valid_to)")
    best = active.groupBy("host", "at").agg(F.min(F.struct((-F.col("depth")).alias("d"), "category", "domain")).alias("m"))
    out = rows.join(best, ["host", "at"], "left")
    return out.select(
        F.col("key").alias(key), "host", F.col("at").alias(fetched), F.col("m").isNotNull().alias("listed"), F.col("m.domain").alias("matched_domain"), F.col("m.category").alias("category")
    )


def _values() -> str:
    return ", ".join(f"('{d}', '{c}', DATE '{day}', {str(on).upper()})" for d, c, day, on in ENTRIES)


#: The query's captures: pages carry no fetch time, so that their ids stand for days of 2024.
ORACLE = f"""
WITH entry(domain, category, day, listed) AS (VALUES {_values()}),
span AS (SELECT domain, category, day AS valid_from, lead(day) OVER (PARTITION BY domain, category ORDER BY day) AS valid_to, listed FROM entry),
page AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^\\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\\.+$', ''), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched FROM pages),
hit AS (
  SELECT p.page_id, s.domain, s.category, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.domain) DESC, s.category) AS r
  FROM page p JOIN span s ON (p.host = s.domain OR p.host LIKE '%.' || s.domain)
   AND s.listed AND p.fetched >= s.valid_from AND (s.valid_to IS NULL OR p.fetched < s.valid_to))
SELECT p.page_id, p.host, p.fetched, h.page_id IS NOT NULL AS listed, h.domain AS matched_domain, h.category
FROM page p LEFT JOIN hit h ON h.page_id = p.page_id AND h.r = 1
"""
