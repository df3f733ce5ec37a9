import datetime as dt

import duckdb
from pyspark.sql import functions as F

from skyframe.llm import url_filters as u


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(str, con.execute(u.OP7_SQL).fetchall()))
    got = u.op7_url_filters(spark, sf)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(str, rows)) == want and any(r[5] for r in rows) and {r[4] for r in rows} == {"allow", "block"}


def test_intervals_and_precedence(spark):
    day = lambda d: dt.date(2024, 1, d)
    entries = [("example.com", "block", day(5), 1), ("example.com", "remove", day(10), 1), ("a.example.com/ok", "allow", day(6), 1), ("a.example.com", "block", day(7), 2), ("a.example.com", "allow", day(7), 1), (None, "block", day(1), 1), ("x", "block", None, 1)]
    urls = [(1, "http://A.example.com:80/ok/1?x", day(8)), (2, "https://u@a.example.com./no", day(8)), (3, "http://b.example.com", day(4)), (4, "http://b.example.com", day(5)), (5, "http://b.example.com/", day(10)), (6, None, day(8)), (7, "nonsense", day(8)), (8, "http://a.example.com/ok", None), (2, "https://u@a.example.com./no", day(8))]
    caps = spark.createDataFrame(urls, "page_id long, url string, fetched_on date").withColumn("pattern", F.lit(1)).withColumn("action", F.lit("x"))
    ent = spark.createDataFrame(entries, "pattern string, action string, entry_date date, seq int")
    out = sorted((r["page_id"], r["pattern"], r["blocked"]) for r in u.filter_urls(caps, ent).collect())
    assert out == [(1, "a.example.com/ok", False), (2, "a.example.com", True), (2, "a.example.com", True), (3, None, False), (4, "example.com", True), (5, None, False), (6, None, False), (7, None, False), (8, None, False)]
    assert not any(r["blocked"] for r in u.filter_urls(caps, ent.limit(0)).collect())
    assert u.filter_urls(caps.limit(0), ent).count() == 0


def test_busy_pattern_against_brute_force(spark):
    """A hot host with an entry on most days of four years: as-of by the last entry up to the fetch day."""
    start = dt.date(2020, 11, 3)
    day = lambda n: start + dt.timedelta(days=n)
    entries = [("hot.org", ("block", "allow", "remove")[n * n % 3], day(n), 1) for n in range(0, 1400) if n % 5] + [("hot.org/a", "allow", day(700), 1), ("hot.org/a", "remove", day(900), 1)]
    caps = [(n, "http://hot.org/" + ("a" if n % 2 else "b"), day(n - 60)) for n in range(0, 2400, 3)]
    state = {p: sorted((d, a) for q, a, d, _ in entries if q == p) for p in ("hot.org", "hot.org/a")}

    def active(pattern, at):
        past = [a for d, a in state[pattern] if d <= at]
        return past[-1] if past and past[-1] != "remove" else None

    want = []
    for n, url, at in caps:
        found = [(p, active(p, at)) for p in (["hot.org/a"] if url.endswith("a") else []) + ["hot.org"]]
        want.append((n, *next(((p, a) for p, a in found if a), (None, "allow"))))
    got = u.filter_urls(spark.createDataFrame(caps, "page_id long, url string, fetched_on date"), spark.createDataFrame(entries, "pattern string, action string, entry_date date, seq int"))
    assert sorted((r["page_id"], r["pattern"], r["action"]) for r in got.collect()) == want and len({r[1:] for r in want}) == 4
