"""Registration of queries and inputs derived from the driver's tables.

An input is one SELECT in the words that Spark SQL and DuckDB share; tables and other inputs stand in braces. Spark
reads it as a view, and the oracle gets it as a common table expression, so both sides start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INPUTS: dict[str, str] = {}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or an input derived from tables."""
    if name not in INPUTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = INPUTS[name]
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in names_in(sql)})


def plain(sql: str) -> str:
    """DuckDB text of a query over inputs: each input becomes a common table expression ahead of its users."""
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for n in names_in(text):
            if n in INPUTS and n not in ctes:
                need(INPUTS[n])
                ctes[n] = re.sub(r"\{(\w+)\}", r"\1", INPUTS[n])

    need(sql)
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    if not ctes:
        return body
    head = ", ".join(f"{n} AS ({s})" for n, s in ctes.items())
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def query(name: str, *inputs: str, sql: str | None = None):
    """Register ``fn(*frames)`` under a name; ``inputs`` are tables or derived inputs."""

    def add(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(*[frame(spark, sf_dir, i) for i in inputs])
        if sql:
            ORACLES[name] = plain(sql)
        return fn

    return add


INPUTS["catalog_a"] = """
SELECT CAST(c_custkey AS STRING) AS object_id, (c_custkey * 7919 % 360000) / 1e3 AS ra, (c_custkey * 104729 % 160000) / 1e3 - 80 AS dec,
  c_mktsegment AS survey, (c_custkey * 31 % 1000) / 1e3 AS dist, c_custkey AS seq FROM {customer}"""
INPUTS["catalog_b"] = """
SELECT concat('b', CAST(c_custkey AS STRING)) AS object_id,
  CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 7919 % 360000) / 1e3 + (c_custkey % 5) * 1e-4 ELSE (c_custkey * 6007 % 360000) / 1e3 END AS ra,
  CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 104729 % 160000) / 1e3 - 80 ELSE (c_custkey * 15487 % 160000) / 1e3 - 80 END AS dec,
  CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS vote, (c_custkey % 7 = 0) AS vote_mask FROM {customer}"""
INPUTS["objects"] = """
SELECT CAST(d.doc_id AS STRING) AS object_id, true AS has_text, CASE WHEN l.doc_id IS NOT NULL THEN true END AS has_label,
  CASE WHEN e.vec_id IS NOT NULL THEN true END AS has_vector, CASE WHEN d.doc_id % 11 <> 0 THEN d.lang END AS survey, d.source, l.quality,
  CASE WHEN d.doc_id % 5 = 0 THEN 'test' WHEN d.doc_id % 7 = 0 THEN 'train' END AS split_upstream
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id"""
INPUTS["spellings"] = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('b''   ', CAST(o_custkey AS STRING), '''') WHEN o_orderkey % 3 = 1 THEN concat('  ', CAST(o_custkey AS STRING)) ELSE CAST(o_custkey AS STRING) END AS object_id,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 37 % 1009) / 1e3 END AS dist, o_orderkey AS src_rank,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority END AS split_label, o_totalprice AS price, o_orderstatus AS status FROM {orders}"""
INPUTS["points"] = """
SELECT CAST(user_id AS STRING) AS object_id, event_id AS pos, (event_id * 7919 % 100003) / 1e2 AS mjd, value - 100 AS flux,
  CAST(1 + event_id % 9 AS DOUBLE) AS err, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS band_id, event_type <> 'error' AS used
FROM {events}"""
INPUTS["quotes"] = """
SELECT concat('c', CAST(conv_id AS STRING)) AS object_id, turn AS pos, text, role, conv_id, concat('2401.', CAST(conv_id AS STRING)) AS arxiv_id FROM {conversations}"""
INPUTS["predictions"] = """
SELECT CAST(o_orderkey AS STRING) AS sample_id, o_orderpriority AS truth, CASE WHEN o_orderkey % 13 = 0 THEN NULL
  WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_totalprice < 60000 THEN '1-URGENT' WHEN o_totalprice < 150000 THEN '3-MEDIUM' ELSE '5-LOW' END AS predicted,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '2-HIGH' END AS predicted_b, o_orderstatus AS regime FROM {orders}"""
INPUTS["multi"] = """
SELECT l_orderkey AS sample_id, concat(l_returnflag, l_linestatus) AS label, CASE WHEN l_linenumber % 3 = 0 THEN 'XX' ELSE concat(l_returnflag, l_linestatus) END AS guess,
  l_linenumber AS k, CAST(floor(l_extendedprice) AS DOUBLE) AS snr FROM {lineitem}"""
INPUTS["ledger"] = """
SELECT CAST(conv_id AS STRING) AS object_id, turn AS seq, role AS status, CASE WHEN role = 'user' THEN NULL ELSE text END AS answer,
  (conv_id * 7 + turn) % 50 + 1 AS tokens FROM {conversations}"""
INPUTS["clean_ids"] = "SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN concat('  ', c_name, ' ') WHEN c_custkey % 5 = 0 THEN '   ' ELSE c_name END AS raw, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS maybe, c_acctbal AS v, c_nationkey AS nation FROM {customer}"
INPUTS["arr"] = "SELECT l_orderkey AS object_id, l_linenumber AS pos, CASE WHEN l_linenumber % 5 = 4 THEN -1e0 ELSE 1000 + (l_partkey * 37 % 8000) / 1e0 END AS wave, floor(l_extendedprice) / 1e3 AS flux, l_discount AS ivar, (l_linenumber % 4 = 0) AS masked FROM {lineitem}"
