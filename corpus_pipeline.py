"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, benchmark items, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``. A stage's result is written as Parquet and read again as the next one's input.

Defined cases, in every stage: other columns than those of ``documents`` are left out, whatever their names; an empty
table gives an empty result; very long texts are handled whole; what a stage does with nulls, empty texts, ties and
repeated rows is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import bpe_stream, decontamination, near_dedup, quality_rules, substring_dedup
from skyframe.llm.common import read_table, small_side, stored

#: Ids of near copies that may be broadcast, some 10 MB in the driver; with more, that join shuffles.
MAX_GONE = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text is rejected; a null id is judged by its text like others; repeated rows share one judgement.
    """
    docs = docs.select(*COLUMNS)
    return quality_rules.filter_documents(docs, quality_rules.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies.

    Null and empty texts are copies of nothing and stay, as do rows with a null id; rows with the same id are one
    document and stay or go together.
    """
    docs = docs.select(*COLUMNS)
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(small_side(stored(gone, "near-copies"), MAX_GONE), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that documents with a smaller id have; n_chars follows the text.

    A null text becomes empty; rows with a null id keep their text and are never a source; rows with the same id cut
    nothing from each other.
    """
    docs = docs.select(*COLUMNS)
    cut = substring_dedup.cut_documents(docs, substring_dedup.find_repeated(docs))
    return cut.select("doc_id", F.col("kept").alias("text"), F.col("_other_lang").alias("lang"), F.col("_other_source").alias("source"), F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold no item; rows are judged by id and text, so repeated rows go together and a null id like others.
    """
    docs = docs.select(*COLUMNS)
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit integers), their count, and digests of ids and decoded text.

    A null or empty text has no ids; null ids and repeated rows keep a row each.
    """
    out = bpe_stream.encode_and_decode(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("benchmark items", drop_contaminated),
    ("BPE", encode),
]

#: Trees, signatures and merges can't be expressed in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
