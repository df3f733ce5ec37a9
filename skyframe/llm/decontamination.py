"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects from consecutive words; the words it leaves out may differ.
Benchmark items and training texts give seeds at every position. Equal seeds give a diagonal (document position minus
item position), and along it the words of both texts are compared: a document is contaminated if, on some
diagonal, ``OVERLAP`` consecutive positions (or the whole item, if shorter) agree in at least ``PERCENT`` per cent. The
masks lose no such overlap: whichever words are changed, up to that share, a mask fits between them (the tests try all
cases). Items of ``HARD`` lengths need one mask more, which texts are only searched with if there are such items.

Everything is DataFrame expressions: words are split and hashed once, positions are exploded, and a seed is one hash of
words that generated code picks from the array, in one stage with the join on it. Seeds of items are broadcast only if a
count shows that they are few, and their words only if all of them together are; else they meet in a shuffled join.
Diagonals of seeds that met are made distinct, and only documents that have one are read again, as pieces twice as long
as the longest item that overlap by half: a diagonal is compared inside the piece that it begins in, so its cost is that
of an item, however long the document and however many diagonals it has. Items shorter than ``SPAN`` words are looked for as a
whole and unchanged, at every position, through a seed of their own length.

Defined cases: words are runs of ASCII letters and digits and of all other characters above ASCII, in lower case; null or empty texts and
items match nothing; items of equal words are found together; repeated rows are judged alike; rows with a null id are judged like others by their text; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import read_table, small_side, stored, unclash

#: Fixed masks over SPAN consecutive words at most: 1 selects a word, 0 leaves it out. The last is for items of HARD lengths.
MASKS = ["111011", "11111", "11010011"]
HARD = [10, 11]
SPAN, OVERLAP, PERCENT, MAX_SEEDS = 8, 16, 80, 200_000
#: Items are broadcast up to so many words in all (8 bytes each); a document's pieces begin so many words apart at least.
MAX_ITEM_WORDS, LEAST_PIECE = 2_000_000, 512


#: What parts words, after letters are in lower case: all other ASCII characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _run_hash(k: int, offsets: list[int]) -> Column:
    """Hash of the words at some offsets from position ``at``."""
    return F.xxhash64(F.lit(k), *[F.get("words", F.col("at") + j) for j in offsets])


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """``rows`` (with words and n) for each seed: at every position where a mask fits; the HARD mask where ``hard`` holds."""
    # Outer explodes: for others, a test of the array's size would be inferred, which hashes all words once more.
    places = F.when(F.col("n") >= SPAN, F.sequence(F.lit(0), F.col("n") - min(map(len, masks))))
    placed = rows.select("*", F.explode_outer(places).alias("at"))
    picked = [[j for j, bit in enumerate(mask) if bit == "1"] for mask in masks]
    fits = [(F.col("at") <= F.col("n") - len(mask)) & (F.col("hard") if k == 2 else F.lit(True)) for k, mask in enumerate(masks)]
    seeds = F.array(*[F.when(fit, _run_hash(k, offsets)) for k, (fit, offsets) in enumerate(zip(fits, picked, strict=True))])
    return placed.select("*", F.explode_outer(seeds).alias("seed")).where("seed IS NOT NULL")


def _agreement(doc: Column, item: Column, size: Column, diagonal: Column) -> Column:
    """Greatest number of agreeing positions in any window of ``size`` item positions along a diagonal, in one pass."""
    low, high = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal)
    agree = lambda p: F.coalesce((F.get(item, p) == F.get(doc, p + diagonal)).cast("int"), F.lit(0))

    def step(s: Column, p: Column) -> Column:
        inside = s["inside"] + agree(p) - F.when(p - size >= low, agree(p - size)).otherwise(0)
        return F.struct(inside.alias("inside"), F.greatest(s["most"], F.when(p - low + 1 >= size, inside)).alias("most"))

    start = F.struct(F.lit(0).alias("inside"), F.lit(0).alias("most"))
    return F.when(high - low >= size, F.aggregate(F.sequence(low, high - 1), start, step, lambda s: s["most"])).otherwise(F.lit(0))


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_key", word_hashes(F.col("text")).alias("words")).withColumn("n", F.size("words"))


def _pieces(words: Column, step: int) -> Column:
    """Overlapping pieces of 2 * step words that begin every ``step`` words; whatever begins in a piece's first half ends in it."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / step).cast("int")), lambda k: F.slice(words, k * step + 1, F.lit(2 * step)))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(doc_key, item_id, agreeing): documents and the items found in them, by a fingerprint of the text.

    ``docs`` needs doc_key and text.
    """
    named = unclash(benchmark, ["item_id", "text"]).select("item_id", word_hashes(F.col("text")).alias("item"))
    named = named.withColumn("m", F.size("item")).where("m > 0").withColumn("item_key", F.struct(F.xxhash64("item"), F.hash("item")))
    items = named.select("item_key", "item", "m").dropDuplicates(["item_key"])
    texts = _words(docs)

    lengths = [r[0] for r in items.where(F.col("m") < OVERLAP).select("m").distinct().collect()]  # fewer than OVERLAP values
    item_rows = items.where(F.col("m") >= SPAN).select("item_key", "item", F.col("item").alias("words"), F.col("m").alias("n"), F.col("m").isin(HARD).alias("hard"))
    item_seeds = _seeds(item_rows, MASKS).select("item_key", "seed", F.col("at").alias("item_at"))
    doc_seeds = _seeds(texts.withColumn("hard", F.lit(True)), MASKS if set(HARD) & set(lengths) else MASKS[:2])
    met = doc_seeds.select("doc_key", "seed", "at").join(small_side(item_seeds, max_seeds), "seed")
    diagonals = stored(met.select("doc_key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "diagonals")
    longest, item_words = items.agg(F.max("m"), F.sum("m")).first()
    step = max(LEAST_PIECE, longest or 0)
    again = _words(docs.join(small_side(diagonals.select("doc_key").distinct()), "doc_key", "left_semi"))
    pieces = again.select("doc_key", F.posexplode(_pieces(F.col("words"), step)).alias("piece", "words"))
    texts_of = items.select("item_key", "item")
    begun = diagonals.withColumn("piece", F.floor(F.greatest(F.col("diagonal"), F.lit(0)) / step).cast("int"))
    hits = begun.join(pieces, ["doc_key", "piece"]).join(F.broadcast(texts_of) if (item_words or 0) <= MAX_ITEM_WORDS else texts_of, "item_key")
    size = F.least(F.size("item"), F.lit(OVERLAP))
    scored = hits.select("doc_key", "item_key", _agreement(F.col("words"), F.col("item"), size, F.col("diagonal") - F.col("piece") * step).alias("agreeing"), size.alias("_size"))
    found = scored.where(100 * F.col("agreeing") >= PERCENT * F.col("_size")).groupBy("doc_key", "item_key").agg(F.max("agreeing").alias("agreeing"))

    for m in [m for m in lengths if m < SPAN]:
        words = F.col("item").alias("words")
        own = items.where(F.col("m") == m).select("item_key", words, F.lit(0).alias("at")).select("item_key", _run_hash(m, range(m)).alias("whole"))
        placed = texts.select("doc_key", "words", F.explode_outer(F.when(F.col("n") >= m, F.sequence(F.lit(0), F.col("n") - m))).alias("at"))
        wholes = placed.select("doc_key", F.when(F.col("at").isNotNull(), _run_hash(m, range(m))).alias("whole"))
        found = found.unionByName(wholes.join(small_side(own), "whole").select("doc_key", "item_key", F.lit(m).alias("agreeing")).distinct())
    return found.join(small_side(named.select("item_key", "item_id")), "item_key").groupBy("doc_key", "item_id").agg(F.max("agreeing").alias("agreeing"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, max_agreeing, item_ids (sorted), contaminated of every document."""
    docs = unclash(docs, ["doc_id", "text"])
    key = F.struct("doc_id", F.xxhash64("text"))
    found = contaminated_pairs(docs.select(key.alias("doc_key"), "text"), benchmark)
    per_doc = found.groupBy(F.col("doc_key.doc_id").alias("_id"), F.col("doc_key.col2").alias("_print")).agg(F.count("*").alias("n_items"), F.max("agreeing").alias("max_agreeing"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_own"))
    out = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["_id"]) & (rows["_own"] == per_doc["_print"]), "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("max_agreeing", F.lit(0)).cast("long").alias("max_agreeing"), "item_ids", F.col("n_items").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    key = F.struct("doc_id", F.xxhash64("text"))
    found = contaminated_pairs(unclash(docs, ["doc_id", "text"]).select(key.alias("doc_key"), "text"), benchmark).select(F.col("doc_key.doc_id").alias("_id"), F.col("doc_key.col2").alias("_print")).distinct()
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_print"])
    return docs.join(small_side(found), same, "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
