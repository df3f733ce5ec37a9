"""Groups of spelling variants by pairs of trie nodes.

Two words are near if one inserted, deleted or replaced code point makes one the other. Every prefix of a word is a node
of the trie of all words, every suffix one of the trie of all words reversed, and both tries' nodes are numbered. A word
w of length L then has pairs of integers (node of w[:i], node of w[j:]):

    j = i + 1, the word skipping position i; words that share such a pair differ by a replaced code point;
    j = i, the word split at i; a word with such a pair is another one's word less a code point, where that one skips i.

So near words are exactly the words that meet in a pair. Deleting any of a run of equal code points gives the same word,
so just the last one of a run counts as deleted, and each near word is met once. A pair holds at most one split word and
one skipping word for each letter of the alphabet, whatever the corpus.

Numbering: words are sorted into ranges, and each range is walked in order with the last word's path in hand; a node
gets the next number of its range where the words leave the last path. The first path of a range may begin with
nodes of the range before it; these are renamed by the ranges' last words and paths, MAX_RANGES rows at most. Numbers
of words follow code-point order. Work is a few rows for each letter of each distinct word; texts are read once.

A word's form is its near word with the largest count (at a tie the least in code-point order), if that is at least
``ratio`` times its own. Counts grow along forms, so chains end; roots are found by pointer doubling, in as many rounds
as the longest chain has binary digits.

Defined cases: null and empty texts have no words; a row without an id counts with its runs as they are; repeated rows
count each; words of any length are handled in one pass over their letters; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import lean, read_table, stored, unclash
from skyframe.llm.line_dedup import LOWER, UPPER

RUNS = "([A-Za-zÀ-ÿ]+)"
WORDS_A_RANGE, MAX_RANGES = 50_000, 4096
#: A number is the range's number and that many bits for the place in it.
PLACE = 40


def count_words(docs: DataFrame, min_chars: int = 5, min_n: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case that have min_chars code points and occur min_n times.

    With ``slip``, a run whose checksum together with its doc_id is a multiple of it first loses the code point at that
    checksum modulo its length: a fixed source of spelling errors.
    """
    runs = unclash(docs, ["doc_id", "text"]).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(1))).alias("_run"))
    ascii_only = F.octet_length("_run") == F.length("_run")
    word = runs.select("doc_id", F.when(ascii_only, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)).alias("word"))
    if slip:
        checked = word.withColumn("_h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary")))
        at = (F.col("_h") % F.length("word")).cast("int")
        less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        word = checked.select(F.when(F.col("_h") % slip == 0, less).otherwise(F.col("word")).alias("word"))
    return word.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the words of one sorted range: (spelling, part) become (spelling, part, id, path)."""
    last, path, made, place = "", [0], 1, 0
    for batch in batches:
        for first in range(0, len(batch), 500):
            some = batch.slice(first, 500)
            paths, ids = [], []
            for word, part in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                keep = _shared(last, word)
                path = path[: keep + 1] + list(range(made, made + len(word) - keep))
                made, last, base = made + len(word) - keep, word, part << PLACE
                paths.append([base + x for x in path])
                ids.append(base + place)
                place += 1
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], ["spelling", "part", "id", "path"])


def trie_paths(words: DataFrame, spelling: str, ranges: int) -> DataFrame:
    """(spelling, id, path): nodes of all prefixes of each distinct word, the empty one first.

    ``id`` numbers the words in code-point order.
    """
    spark = words.sparkSession
    dealt = words.select(F.col(spelling).alias("spelling")).repartitionByRange(ranges, "spelling").sortWithinPartitions("spelling")
    walked = stored(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(lean(_walk), "spelling string, part int, id long, path array<long>"), "trie")
    # At most MAX_RANGES rows: the ends of the ranges.
    ends = walked.groupBy("part").agg(F.min("spelling").alias("first"), F.max("spelling").alias("last"), F.max_by("path", "spelling").alias("path")).orderBy("part").collect()
    renamed, last, path = [], None, []
    for end in ends:
        names = path[: _shared(last, end["first"]) + 1] if last is not None else []
        renamed.append((end["part"], names))
        # The first word of a range has its nodes numbered by their depth.
        place = (1 << PLACE) - 1
        last, path = end["last"], [names[x & place] if x & place < len(names) else x for x in end["path"]]
    names = spark.createDataFrame(renamed, "part int, _names array<long>")
    local = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1))
    found = F.transform("path", lambda x: F.coalesce(F.get("_names", local(x).cast("int")), x))
    touched = F.exists("path", lambda x: local(x) < F.size("_names"))
    return walked.join(names, "part").select("spelling", "id", F.when(touched, found).otherwise(F.col("path")).alias("path"))


def node_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p, s, id, n, kind) of words (word, n), and (word, id).

    kind is 0 for a split word, 2 for a skip that counts as a deletion, 1 for another skip.
    """
    ranges = min(MAX_RANGES, words.count() // WORDS_A_RANGE + 1)
    forward = trie_paths(words, "word", ranges).withColumnsRenamed({"spelling": "word", "path": "_f"})
    back = trie_paths(words.select(F.reverse("word").alias("_turned")), "_turned", ranges)
    back = back.select(F.reverse("spelling").alias("word"), F.reverse("path").alias("_r"))
    both = words.join(forward, "word").join(back, "word").withColumn("_c", F.split("word", ""))
    size = F.size("_f") - 1
    # A letter is the last of its run if the next one differs; past the end there is none.
    pairs = F.arrays_zip(F.slice("_f", F.lit(1), size).alias("p"), F.slice("_r", F.lit(2), size).alias("s"), F.slice("_c", F.lit(1), size).alias("c"), F.slice("_c", F.lit(2), size).alias("d"))
    skips = both.select("id", "n", F.explode(pairs).alias("_x")).select("_x.p", "_x.s", "id", "n", F.when(F.col("_x.c").eqNullSafe(F.col("_x.d")), 1).otherwise(2).alias("kind"))
    splits = both.select("id", "n", F.explode(F.arrays_zip(F.col("_f").alias("p"), F.col("_r").alias("s"))).alias("_x")).select("_x.p", "_x.s", "id", "n", F.lit(0).alias("kind"))
    return skips.unionByName(splits), forward.select("word", "id")


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near, and the one of largest count as a struct (n, minus id)."""
    member = F.struct("n", (-F.col("id")).alias("minus"), "kind")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("_all")).where(F.size("_all") > 1)
    meets = lambda x, y: (y["minus"] != x["minus"]) & (((x["kind"] > 0) & (y["kind"] > 0)) | (x["kind"] + y["kind"] == 2) & (x["kind"] != y["kind"]))
    met = F.transform("_all", lambda x: F.struct((-x["minus"]).alias("id"), F.filter("_all", lambda y: meets(x, y)).alias("near")))
    each = groups.select(F.explode(met).alias("_m")).where(F.size("_m.near") > 0)
    best = F.array_max("_m.near")
    return each.select("_m.id", F.size("_m.near").alias("_k"), F.struct(best["n"].alias("n"), best["minus"].alias("minus")).alias("_b")).groupBy("id").agg(F.sum("_k").alias("n_near"), F.max("_b").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, form_id, root_id) of (id, form_id): each root is the end of the chain of forms, by pointer doubling."""
    now = stored(forms.select("id", "form_id", F.col("form_id").alias("root_id")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("_next"))
        nxt = stored(now.join(ahead, "root_id", "left").select("id", "form_id", F.coalesce("_next", "root_id").alias("root_id"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not nxt.where("moved").limit(1).count():
            return nxt.drop("moved")
        now = nxt.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the distinct words (word, n)."""
    words = stored(unclash(words, ["word", "n"]).where("word IS NOT NULL"), "words")
    pairs, ids = node_pairs(words)
    near = stored(near_words(pairs), "near-words")
    known = words.join(ids, "word").join(near, "id", "left")
    known = stored(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best")), "known-words")
    roots = _roots(known.where("best IS NOT NULL").select("id", (-F.col("best.minus")).alias("form_id")))
    named = known.select(F.col("id").alias("_i"), F.col("word").alias("_w"))
    forms = roots.join(named.withColumnsRenamed({"_i": "form_id", "_w": "form"}), "form_id").join(named.withColumnsRenamed({"_i": "root_id", "_w": "root"}), "root_id")
    out = known.join(forms.select("id", "form", "root"), "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("best.n").alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(read_table(spark, sf_dir, "documents"), slip=97))
