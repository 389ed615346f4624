"""URL filters by lists whose entries come and go.

A list is a table of dated entries (pattern, category, action, dated). Per
pattern and category the entries, in order of date, become validity intervals:
an 'add' holds until the next entry. Every capture is joined, as of its fetch
time, with the intervals that hold then, for each pattern that covers its URL: the
host, each parent domain, and the host with the first part of the path.

Scale: captures are first reduced to distinct (host, first part, fetch time),
on the map side. A parent domain that covers a third of them is dealt over
``SALTS`` parts, with the (few) intervals of each pattern in every part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.common import read

SALTS = 16
SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
HOST = SCHEME + r"(?>[^/?#]*@)?+(\[[^\]/?#]*\]|[^/:?#\[][^/:?#]*)"
PART = SCHEME + r"[^/?#]+/([^/?#]+)"
ADDRESS = r"^\[|^[0-9]+(\.[0-9]+){3}$"


def host(url: Column) -> Column:
    """The host of a URL in lower case, without final dots; an IPv6 address
    keeps its brackets. The scheme may be left out before '//'. '' where there is none."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def first_part(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PART, 1), F.lit(""))


def patterns(site: Column, part: Column) -> Column:
    """All patterns that cover a site: the host and its parent domains of two
    labels or more (an address has none), and host/part."""
    labels = F.split(site, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = F.when(site.rlike(ADDRESS), F.array(site)).otherwise(parents)
    return F.array_distinct(F.when(part == "", parents).otherwise(F.concat(parents, F.array(F.concat(site, F.lit("/"), part)))))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, since, until (exclusive; null: still listed).

    Of entries with one date a 'remove' counts last. Entries without a
    pattern or a date never hold, repeated ones change nothing."""
    order = Window.partitionBy("pattern", "category").orderBy("dated", "action")
    kept = entries.filter("pattern is not null and dated is not null").select("pattern", "category", "action", "dated").distinct()
    return (kept.withColumn("until", F.lead("dated").over(order)).filter((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("dated"))))
            .select("pattern", "category", F.col("dated").alias("since"), "until"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds host, n_active (entries that hold), pattern and category (of the
    longest pattern that holds; of equals the first by name) and blocked to
    captures with ``url`` and ``fetched``.

    A null or malformed URL has host '' and is never blocked, nor is a capture
    without a fetch time. Repeated captures come out as often; empty tables
    give no rows or no blocks; columns of the added names are replaced."""
    rows = captures.drop("host", "n_active", "pattern", "category", "blocked").withColumn("host", host(F.col("url"))).withColumn("_part", first_part(F.col("url")))
    sites = rows.filter("host <> '' and fetched is not null").select("host", "_part", "fetched").distinct()
    asked = (sites.withColumn("salt", F.pmod(F.xxhash64("host", "_part", "fetched"), F.lit(SALTS)).cast("int"))
             .withColumn("pattern", F.explode(patterns(F.col("host"), F.col("_part")))))
    held = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = asked.join(held, ["pattern", "salt"]).filter("fetched >= since and (until is null or fetched < until)")
    best = F.min(F.struct((-F.length("pattern")).alias("n"), F.col("pattern"), F.col("category")))
    found = hits.groupBy("host", "_part", "fetched").agg(F.count("*").alias("n_active"), best.alias("best"))
    own = [c for c in captures.columns if c not in ("host", "n_active", "pattern", "category", "blocked")]
    known = F.coalesce((F.col("host") != "") & F.col("fetched").isNotNull(), F.lit(False))
    added = ["host", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("best.pattern").alias("pattern"), F.col("best.category").alias("category"), F.col("best").isNotNull().alias("blocked")]
    out = rows.filter(known).join(found, ["host", "_part", "fetched"], "left").select(*own, *added)
    null = F.lit(None).cast("string")
    rest = rows.filter(~known).select(*own, "host", F.lit(0).cast("bigint").alias("n_active"), null.alias("pattern"), null.alias("category"), F.lit(False).alias("blocked"))
    return out.unionByName(rest)                     # captures that no entry can meet stay out of the join


def _digits(text: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, n), 16, 10).cast("int")


def list_from_pages(pages: DataFrame) -> DataFrame:
    """Dated entries for the sites of ``pages``: a stand-in for published
    lists, of which the tables have none. By the digits of a site's MD5 some
    are listed on a day of 2024, some of those are removed later, and some of
    these come back."""
    sites = pages.select(F.explode(patterns(host(F.col("url")), first_part(F.col("url")))).alias("pattern")).filter("pattern <> ''").distinct()
    key = F.col("pattern")
    listed = F.date_add(F.lit("2024-01-01").cast("date"), _digits(key, 2, 3) % 366)
    removed = F.date_add(listed, 1 + _digits(key, 5, 2))
    back = F.date_add(removed, 1 + _digits(key, 7, 2))
    category = F.element_at(F.array(*[F.lit(c) for c in ("adult", "gambling", "malware", "spam")]), 1 + _digits(key, 9, 1) % 4)
    step = lambda action, dated: F.struct(F.lit(action).alias("action"), dated.alias("dated"))
    steps = F.when(_digits(key, 10, 1) < 4, F.array(step("add", listed))).when(_digits(key, 10, 1) < 10, F.array(step("add", listed), step("remove", removed)))
    steps = steps.otherwise(F.array(step("add", listed), step("remove", removed), step("add", back)))
    return sites.filter(_digits(key, 1, 1) < 5).select("pattern", category.alias("category"), F.explode(steps).alias("s")).select("pattern", "category", "s.action", "s.dated")


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched: the tables have no fetch time, so a page's MD5 gives a day of 2024 or 2025."""
    day = _digits(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 1, 4) % 731
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_urls(captures_from_pages(pages), list_from_pages(pages))
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "n_active", "pattern", "category", "blocked")


OP5_SQL = r"""
WITH authorities AS (
  SELECT page_id, regexp_replace(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', '') AS a,
         regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([^/?#]+)', 1) AS part
  FROM pages
), p AS (
  SELECT page_id, part, rtrim(lower(CASE WHEN starts_with(a, '[') THEN regexp_extract(a, '^\[[^\]]*\]') ELSE split_part(a, ':', 1) END), '.') AS host,
         DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 4) AS INTEGER) % 731 AS INTEGER) AS fetched
  FROM authorities
), labels AS (
  SELECT *, string_split(host, '.') AS l, starts_with(host, '[') OR regexp_full_match(host, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS address FROM p
), covering AS (
  SELECT page_id, host, fetched, unnest(list_distinct(list_concat(
           list_transform(range(1, CASE WHEN address THEN 1 ELSE greatest(len(l) - 1, 1) END + 1), lambda i: array_to_string(l[i:], '.')),
           CASE WHEN part = '' THEN [] ELSE [host || '/' || part] END))) AS pattern
  FROM labels
), sites AS (
  SELECT pattern, md5(pattern) AS m FROM (SELECT DISTINCT pattern FROM covering WHERE pattern <> '') WHERE CAST('0x' || substr(md5(pattern), 1, 1) AS INTEGER) < 5
), steps AS (
  SELECT pattern, ['adult', 'gambling', 'malware', 'spam'][1 + CAST('0x' || substr(m, 9, 1) AS INTEGER) % 4] AS category,
         DATE '2024-01-01' + CAST(CAST('0x' || substr(m, 2, 3) AS INTEGER) % 366 AS INTEGER) AS listed,
         1 + CAST('0x' || substr(m, 5, 2) AS INTEGER) AS stay, 1 + CAST('0x' || substr(m, 7, 2) AS INTEGER) AS away, CAST('0x' || substr(m, 10, 1) AS INTEGER) AS kind
  FROM sites
), held AS (
  SELECT pattern, category, listed AS since, CASE WHEN kind < 4 THEN NULL ELSE listed + stay END AS until FROM steps
  UNION ALL
  SELECT pattern, category, listed + stay + away, NULL FROM steps WHERE kind >= 10
), hits AS (
  SELECT c.page_id, c.pattern, h.category FROM covering c JOIN held h ON c.pattern = h.pattern AND c.fetched >= h.since AND (h.until IS NULL OR c.fetched < h.until)
), best AS (
  SELECT page_id, count(*) AS n_active, first(pattern ORDER BY length(pattern) DESC, pattern, category) AS pattern,
         first(category ORDER BY length(pattern) DESC, pattern, category) AS category
  FROM hits GROUP BY page_id
)
SELECT p.page_id, p.host, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(b.n_active, 0) AS n_active, b.pattern, b.category, b.page_id IS NOT NULL AS blocked
FROM p LEFT JOIN best b ON p.page_id = b.page_id
"""
