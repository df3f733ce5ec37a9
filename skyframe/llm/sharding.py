"""Sharding by a keyed permutation of global row numbers.

Every document gets a global row number, a Feistel network permutes the numbers 0..n-1, and the permuted number p gives
shard ``p % shards`` and slot ``p // shards``. So shards differ by one row at most, slots have no gaps, and where a row
number goes can be computed without a table (:func:`shard_and_slot`), as can the row number behind a shard and slot
(:func:`row_behind`). All of it is Column expressions.

Row numbers: documents are dealt into ``buckets`` by a hash of their id; a bucket's first number is the sum of the
buckets before it (a table of ``buckets`` rows at most), and inside a bucket rows are ordered by id, size and checksum.
No step needs all rows in one task.

Defined cases: a null text has size 8 and checksum 0; a null id is numbered like any other value; repeated rows get
numbers of their own (equal rows are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import read_table, unclash

ROUNDS = 7


def _sides(n: int) -> tuple[int, int]:
    """Two factors whose product is n or little more."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def _noise(value: Column, seed: int, k: Column, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed), k), modulus)


def _once(x: Column, n: int, seed: int, forward: bool) -> Column:
    """One pass of the network over 0..a*b-1, or its inverse."""
    a, b = _sides(n)
    mod = lambda k: F.when(k % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("long")
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")
    whole = lambda p, q: F.call_function("div", p, q)
    odd = ROUNDS % 2 == 1
    if forward:
        start = F.struct((x % la).alias("l"), whole(x, la).alias("r"))
        step = lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + _noise(s["r"], seed, k, mod(k))) % mod(k)).alias("r"))
        done = (lambda s: la * s["l"] + s["r"]) if odd else (lambda s: la * s["r"] + s["l"])
        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), start, step, done)
    first, second = (x % la, whole(x, la))
    start = F.struct((second if odd else first).alias("l"), (first if odd else second).alias("r"))
    back = lambda s, k: F.struct(F.pmod(s["r"] - _noise(s["l"], seed, k, mod(k)), mod(k)).alias("l"), s["l"].alias("r"))
    return F.aggregate(F.sequence(F.lit(ROUNDS).cast("long"), F.lit(1).cast("long")), start, back, lambda s: la * s["r"] + s["l"])


def _walk(x: Column, n: int, seed: int, forward: bool) -> Column:
    """Cycle walking: the pass is repeated until it is back inside 0..n-1.

    The network's domain has ``a * b - n`` numbers outside, so that many further passes always suffice; a pass is
    outside with a chance of about 1 / sqrt(n).
    """
    a, b = _sides(n)
    outside = a * b - n
    once = _once(x, n, seed, forward)
    if not outside:
        return once
    again = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), once, lambda s, _: F.when(s >= n, _once(s, n, seed, forward)).otherwise(s))
    return F.when(once < n, once).otherwise(again)


def permuted(row: Column, n: int, seed: int) -> Column:
    """The permuted number of row numbers 0..n-1."""
    return _walk(row.cast("long"), n, seed, True)


def shard_and_slot(row: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    p = permuted(row, n, seed)
    return (p % shards).cast("int"), F.call_function("div", p, F.lit(shards).cast("long"))


def row_behind(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number at a place: the inverse of :func:`shard_and_slot`."""
    return _walk(slot.cast("long") * shards + shard.cast("long"), n, seed, False)


def numbered(rows: DataFrame, key: str, ties: list[str], buckets: int = 4096) -> tuple[DataFrame, int]:
    """``rows`` with a column ``row_number`` from 0, and their count."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"), "_n")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    order = Window.partitionBy("_bucket").orderBy(key, *ties)
    # The table of bucket sizes has at most `buckets` rows, whatever the input.
    placed = dealt.join(F.broadcast(before.drop("_n")), "_bucket").withColumn("row_number", F.col("_before") + F.row_number().over(order) - 1)
    return placed.drop("_bucket", "_before"), total


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20240607, buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every document."""
    docs = unclash(docs, ["doc_id", "text"])
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, total = numbered(rows, "doc_id", ["size", "text_crc32"], buckets)
    shard, slot = shard_and_slot(F.col("row_number"), max(total, 1), shards, seed)
    return rows.withColumn("shard", shard).withColumn("slot", slot)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
