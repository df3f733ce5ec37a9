import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from skyframe.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=10, min_docs=2):
    """Plain Python over (doc_id, text) rows."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACES).translate(low)
    holders = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    gone = {k: min(d) for k, d in holders.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or gone.get(key(x), doc) >= doc]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=str)


ODD = [
    (1, "Shared line here\nown line number one\nshared LINE here  \n"),
    (2, "\tshared line here\r\nshort\nÀ la carte menus"),
    (2, "a second row of two\nshared line here"),
    (3, "short\nà la carte menus\n\nÀ la carte menus\x0b"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (None, "shared line here\nonly without an id"),
    (None, None),
    (-7, "shared line here"),
    (8, "only without an id\n" + "very long text\n" * 20_000 + "x" * 300_000),
    (9, "very long text"),
    (9, "very long text"),
    (10, "nine charé\nten charac\nnine charé"),
    (11, "nine charé\nten charac"),
]


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_odd_rows(spark, monkeypatch, hot):
    """With hot and other digests in any mixture."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("keeper", F.lit("k")).withColumn("n_lines", F.lit(0))
    assert collected(line_dedup.drop_shared_lines(docs)) == brute(ODD)
    assert collected(line_dedup.drop_shared_lines(docs, min_chars=3, min_docs=3)) == brute(ODD, 3, 3)
    kept = line_dedup.drop_shared_lines(docs, keep=("digest", "n_lines"))
    assert kept.columns == ["doc_id", "n_lines", "n_dropped", "kept", "_other_digest", "_other_n_lines"] and kept.count() == len(ODD)
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_ties_and_nothing_shared(spark):
    rows = [(k, "the very same line") for k in range(50)] + [(99, "another line of text")]
    assert collected(line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    rows = [(1, "just this line"), (2, "and that line")]
    assert collected(line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_documents(spark, sf):
    """The whole table by brute force and by SQL."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in line_dedup.op12_line_dedup(spark, sf).collect()), key=str)
    want = sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(rows)), key=str)
    assert got == want and sum(r[2] for r in got) > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(line_dedup.OP12_SQL).fetchall(), key=str) == want
