"""URL filters with dated lists.

List entries carry a pattern (a host, a parent domain, or a host with the first path segments), an action and a date;
they become validity intervals: an entry holds from its date until the next entry of its pattern. A capture is joined to
the entries of all patterns that its URL has, and the as-of condition leaves those active when it was fetched. The
longest active pattern decides; without one, or where it was removed, the capture is allowed.

All steps are equi-joins, windows and aggregates. Patterns of the list are first reduced to one entry a day, so a window
holds days and not entries. The intervals of a pattern are gathered by calendar year, 366 at most in a row, so a capture
meets one row for each of its patterns, however many dated entries they have, and looks its interval up in it; a host
with very many captures is on the splittable side of its join.

Defined cases: a null or unparsable URL has no pattern and is allowed; a null fetch time is allowed; entries with a null
pattern or date are ignored; of several entries for one pattern and day the last sequence number counts, then the
greatest action; repeated captures keep their rows; an empty list allows all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import read_table, unclash

_REST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port or a closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _REST + r"([^/?#:]+)", 1)), r"\.$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _REST + r"[^/?#]+([^?#]*)", 1)


def url_patterns(url: Column, depth: int) -> Column:
    """Patterns of a URL: its host, every parent domain of two labels or more, and its host with up to ``depth`` path segments."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.slice(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), 1, depth) if depth else F.array().cast("array<string>")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>")))))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) from entries (pattern, action, entry_date, seq); ``remove`` ends an interval."""
    days = entries.where("pattern IS NOT NULL AND entry_date IS NOT NULL").groupBy("pattern", F.to_date("entry_date").alias("entry_date")).agg(F.max(F.struct("seq", "action")).alias("_last"))
    order = Window.partitionBy("pattern").orderBy("entry_date")
    spans = days.select("pattern", F.col("_last.action").alias("action"), F.col("entry_date").alias("valid_from"), F.lead("entry_date").over(order).alias("valid_to"))
    return spans.where("action <> 'remove'")


def by_year(spans: DataFrame, first: int, last: int) -> DataFrame:
    """(pattern, year, spans): the intervals that reach into each year from ``first`` to ``last``."""
    start = F.greatest(F.year("valid_from"), F.lit(first))
    end = F.least(F.coalesce(F.year("valid_to"), F.lit(last)), F.lit(last))
    each = spans.where(start <= end).select("pattern", F.struct("valid_from", "valid_to", "action").alias("span"), F.explode(F.sequence(start, end)).alias("year"))
    return each.groupBy("pattern", "year").agg(F.collect_list("span").alias("spans"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched_on) with the deciding pattern, its action and ``blocked``."""
    spans = validity(entries)
    depth = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    own = unclash(captures, ["page_id", "url", "fetched_on"])
    asked = own.select("url", "fetched_on").where("url IS NOT NULL AND fetched_on IS NOT NULL").distinct()
    years = own.where("url IS NOT NULL").agg(F.min(F.year("fetched_on")), F.max(F.year("fetched_on"))).first()
    keyed = asked.select("url", "fetched_on", F.year("fetched_on").alias("year"), F.explode(url_patterns(F.col("url"), depth)).alias("pattern"))
    met = keyed.join(by_year(spans, years[0] or 0, years[1] or 0), ["pattern", "year"])
    holds = F.filter("spans", lambda s: (s["valid_from"] <= F.col("fetched_on")) & (s["valid_to"].isNull() | (F.col("fetched_on") < s["valid_to"])))
    active = met.select("url", "fetched_on", "pattern", F.get(holds, F.lit(0)).alias("_span")).where("_span IS NOT NULL").select("url", "fetched_on", "pattern", "_span.action", "_span.valid_from")
    # Patterns of one URL are nested or are suffixes of its host, so length orders them; a path pattern beats any host.
    best = active.groupBy("url", "fetched_on").agg(F.max(F.struct(F.contains("pattern", F.lit("/")).alias("deep"), F.length("pattern").alias("size"), "pattern", "action", "valid_from")).alias("_best"))
    out = own.join(best, ["url", "fetched_on"], "left")
    return out.select("page_id", "url", "fetched_on", F.col("_best.pattern").alias("pattern"), F.coalesce("_best.action", F.lit("allow")).alias("action"), F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day that follows from the page id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")).alias("fetched_on"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts, domains and first path segments by the digits of their hashes."""
    hosts = pages.select(url_host(F.col("url")).alias("host"), F.element_at(F.split(url_path(F.col("url")), "/"), 2).alias("part")).where("host <> ''")
    # Path patterns come first, so that hosts and domains can be told from them by the slash.
    named = hosts.select(F.explode(F.array("host", F.substring_index("host", ".", -2), F.concat("host", F.lit("/"), F.coalesce("part", F.lit("")))))).select(F.col("col").alias("pattern")).distinct()
    named = named.where("pattern NOT LIKE '%/'").withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    h = F.col("h")
    first = named.where("h % 3 = 0").select("pattern", F.when(F.col("pattern").contains("/"), "allow").otherwise("block").alias("action"), day(h % 200).alias("entry_date"), F.lit(1).alias("seq"))
    gone = named.where("h % 6 = 0").select("pattern", F.lit("remove").alias("action"), day(h % 200 + 20 + h % 50).alias("entry_date"), F.lit(2).alias("seq"))
    again = named.where("h % 12 = 0").select("pattern", F.lit("block").alias("action"), day(h % 200 + 100 + h % 30).alias("entry_date"), F.lit(3).alias("seq"))
    return first.unionByName(gone).unionByName(again)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return filter_urls(sample_captures(pages), sample_entries(pages))


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched_on,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#]+([^?#]*)', 1) AS path FROM pages),
named AS (
  SELECT DISTINCT pattern FROM (
    SELECT host AS pattern FROM captures WHERE host <> ''
    UNION ALL SELECT CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE host END FROM captures WHERE host <> ''
    UNION ALL SELECT host || '/' || string_split(path, '/')[2] FROM captures WHERE host <> '' AND string_split(path, '/')[2] <> '')),
hashed AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS h FROM named),
entries AS (
  SELECT pattern, CASE WHEN contains(pattern, '/') THEN 'allow' ELSE 'block' END AS action, DATE '2024-01-01' + CAST(h % 200 AS INTEGER) AS d, 1 AS seq FROM hashed WHERE h % 3 = 0
  UNION ALL SELECT pattern, 'remove', DATE '2024-01-01' + CAST(h % 200 + 20 + h % 50 AS INTEGER), 2 FROM hashed WHERE h % 6 = 0
  UNION ALL SELECT pattern, 'block', DATE '2024-01-01' + CAST(h % 200 + 100 + h % 30 AS INTEGER), 3 FROM hashed WHERE h % 12 = 0),
days AS (SELECT pattern, d, arg_max(action, seq) AS action FROM entries GROUP BY pattern, d),
spans AS (SELECT pattern, action, d AS a, lead(d) OVER (PARTITION BY pattern ORDER BY d) AS b FROM days),
keyed AS (
  SELECT page_id, fetched_on, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS pattern
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS k FROM captures WHERE host <> '')
  UNION SELECT page_id, fetched_on, host || '/' || list_filter(string_split(path, '/'), lambda s : s <> '')[1] FROM captures WHERE host <> '' AND len(list_filter(string_split(path, '/'), lambda s : s <> '')) > 0),
active AS (
  SELECT page_id, pattern, action, row_number() OVER (PARTITION BY page_id ORDER BY contains(pattern, '/') DESC, length(pattern) DESC, pattern DESC) AS r
  FROM keyed JOIN spans USING (pattern) WHERE action <> 'remove' AND a <= fetched_on AND (b IS NULL OR fetched_on < b))
SELECT c.page_id, c.url, c.fetched_on, a.pattern, coalesce(a.action, 'allow') AS action, coalesce(a.action = 'block', false) AS blocked
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.r = 1
"""
