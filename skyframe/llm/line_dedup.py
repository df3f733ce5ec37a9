"""Lines that several documents share: hash normalised lines, count documents per hash, drop, reassemble by position.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. A key of at least
``min_chars`` code points that is found in at least ``min_docs`` documents keeps its lines in the smallest doc_id that
holds it and loses all others; other lines stay in place. Keys are told apart by 128 bits of their SHA-256 digest.

Work: digests are exploded where texts are read and counted by distinct (digest, document), so no key is one task's
load. Digests with 1/4096 or more of the documents counted for all shared digests are hot: there are at most 4096 of
them whatever the input, so they reach every task, and no hot line is shuffled again. The rest is joined by digest, in
which a key holds less than 1/4096 of that; what a document loses is gathered by document (its own lines at most), and its text is put
together again in one pass over its lines.

Defined cases: a null or empty text is one empty line; a null id keeps all its lines and is no document that counts;
rows with the same id are one document and don't drop each other's lines, each row stays a row; an empty table gives an
empty result; of other columns those named in ``keep`` come through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import lean, read_table, stored, unclash

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest is hot with a HOT-th or more of what all shared digests hold; so at most HOT digests are.
HOT = 4096


def line_key(line: Column) -> Column:
    """The normalised line; :func:`_digest` does the same on bytes."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _digest(line: bytes) -> bytes:
    return hashlib.sha256(line.strip(SPACES.encode()).lower()).digest()[:16]


def keyed_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, digest) of every line whose key is long enough; rows without an id have none."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("_line"))
    keys = lines.select("doc_id", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return keys.select("doc_id", F.unhex(F.substring(F.sha2("_key", 256), 1, 32)).alias("digest"))


def shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(digest, n_docs, keeper) of keys in at least ``min_docs`` documents; keeper is the smallest doc_id."""
    each = keyed_lines(unclash(docs, ["doc_id", "text"]), min_chars).distinct()
    return each.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def _reassemble(hot: dict[bytes, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept, n_lines, n_dropped = batch.column(1), [], [], []
            for k, (doc, lost) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = bytes(memoryview(texts[k].as_buffer())) if texts[k].is_valid else b""
                lines = raw.split(b"\n")
                n_lines.append(len(lines))
                if doc is not None and (lost or hot):
                    own = set(lost or ())
                    stay = [x for x in lines if (d := _digest(x)) not in own and hot.get(d, doc) >= doc]
                    n_dropped.append(len(lines) - len(stay))
                    raw = b"\n".join(stay) if len(stay) < len(lines) else raw
                else:
                    n_dropped.append(0)
                kept.append(raw)
            new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new, *batch.columns[3:]], ["doc_id", "n_lines", "n_dropped", "kept", *batch.schema.names[3:]])

    return run


def drop_shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text without its dropped lines) of every row, then ``keep`` as ``_other_<name>``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_other_{c}") for c in keep])
    shared = stored(shared_lines(docs, min_chars, min_docs), "shared-lines")
    total = shared.agg(F.sum("n_docs")).first()[0] or 0
    hot_rows = shared.where(F.col("n_docs") * HOT >= total)
    # At most HOT rows, by their definition.
    hot = {bytes(r["digest"]): r["keeper"] for r in hot_rows.select("digest", "keeper").collect()}
    rest = shared.where(F.col("n_docs") * HOT < total)
    lines = keyed_lines(docs, min_chars).join(F.broadcast(hot_rows.select("digest")), "digest", "left_anti")
    lost = lines.join(rest, "digest").where(F.col("doc_id") > F.col("keeper")).groupBy("doc_id").agg(F.collect_set("digest").alias("_lost"))
    known = docs.where("doc_id IS NOT NULL").join(lost, "doc_id", "left")
    unknown = docs.where("doc_id IS NULL").withColumn("_lost", F.lit(None).cast("array<binary>"))
    others = [f"_other_{c}" for c in keep]
    rows = known.select("doc_id", "text", "_lost", *others).unionByName(unknown.select("doc_id", "text", "_lost", *others))
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(lean(_reassemble(hot)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string{kinds}")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, coalesce(doc_id > keeper, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
