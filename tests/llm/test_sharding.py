import functools
import math
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from skyframe.llm import sharding


def test_permutation_and_inverse(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000):
        p = sharding.permuted(F.col("id"), n, 5)
        shard, slot = sharding.shard_and_slot(F.col("id"), n, 4, 5)
        rows = spark.range(n).select("id", p.alias("p"), shard.alias("shard"), slot.alias("slot")).withColumn("back", sharding.row_behind(F.col("shard"), F.col("slot"), n, 4, 5)).collect()
        assert sorted(r["p"] for r in rows) == list(range(n))
        assert all(r["back"] == r["id"] for r in rows)
    assert [r["p"] for r in rows] != list(range(n))


def test_documents(spark, sf):
    out = sharding.op6_sharding(spark, sf).toPandas()
    counts = out.groupby("shard").size()
    assert out.doc_id.is_unique and counts.max() - counts.min() <= 1 and set(out.shard) <= set(range(24))
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_odd_rows(spark):
    rows = [(1, None), (None, "a"), (2, ""), (2, ""), (3, "x" * 100_000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("row_number", F.lit(9))
    out = sharding.shard_documents(docs, shards=4).collect()
    assert len(out) == 6 and sorted(r["row_number"] for r in out) == list(range(6))
    assert {r["size"] for r in out} == {8, 9, 100_008}
    assert sharding.shard_documents(docs.limit(0), shards=4).count() == 0


def brute(rows, shards=24, seed=20240607, buckets=4096):
    """The query's figures in plain Python: numbers by bucket and id, the network written out, walking while outside."""
    hashed = lambda *raw: functools.reduce(lambda h, x: xxhash.xxh64_intdigest(x, seed=h), raw, 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long, n = lambda v: struct.pack("<q", v), len(rows)
    facts = []
    for doc, text in rows:
        raw = (text or "").encode()
        bucket = signed(42 if doc is None else hashed(long(doc))) % buckets
        facts.append((bucket, doc is not None, doc or 0, len(raw) + 8, zlib.crc32(raw)))
    a = max(1, math.isqrt(n))
    b = max(1, -(-n // a))
    out = []
    for at, (_, known, doc, size, crc) in enumerate(sorted(facts)):
        x = at
        while True:
            left, right = x % a, x // a
            for k in range(1, 8):
                m = a if k % 2 else b
                left, right = right, (left + signed(hashed(long(right), struct.pack("<i", seed), long(k))) % m) % m
            x = a * left + right
            if x < n:
                break
        out.append((doc if known else None, size, crc, "rows", x % shards, x // shards, None))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf):
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r[c] for c in names) for r in sharding.op6_sharding(spark, sf).collect()), key=str) == brute(rows)


def test_odd_rows_against_brute_force(spark):
    rows = [(1, None), (2, ""), (None, "x"), (None, "y"), (3, "é"), (3, "é"), (3, "longer"), (-7, "z" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot", "3 AS row_number", "4 AS size")
    got = sharding.shard_documents(docs, shards=3).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], "rows", r["shard"], r["slot"], None) for r in got), key=str) == brute(rows, shards=3)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
