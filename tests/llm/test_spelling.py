import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyframe.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, slip=97, min_chars=5, min_n=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_n}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, ratio=2):
    """All words against all others of nearly the same length that share a half."""
    found = defaultdict(set)
    halves = defaultdict(set)
    for w in words:
        for cut in {len(w) // 2, (len(w) - 1) // 2, (len(w) + 1) // 2}:
            halves["head", w[:cut]].add(w)
            halves["tail", w[cut:]].add(w)
    for group in halves.values():
        group = sorted(group)
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                if abs(len(a) - len(b)) < 2 and near(a, b):
                    found[a].add(b)
                    found[b].add(a)
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x))
        if words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(found[w]), words.get(form.get(w))))
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_brute_halves_lose_nothing():
    pick = random.Random(3)
    words = {"".join(pick.choice("ab") for _ in range(pick.randint(1, 7))): pick.randint(1, 9) for _ in range(150)}
    slow = {w: sum(near(w, x) for x in words if x != w) for w in words}
    assert {r[0]: r[4] for r in brute(words)} == slow


@pytest.mark.parametrize("seed,letters,longest,ranges", [(1, "ab", 8, 1), (2, "abcé", 6, 30), (3, "aÿ", 12, 7), (4, "abcdefgh", 3, 200)])
def test_random_words(spark, monkeypatch, seed, letters, longest, ranges):
    """Small alphabets: runs of equal letters, words that are others' prefixes, ties, ranges that begin inside a path."""
    pick = random.Random(seed)
    words = {"".join(pick.choice(letters) for _ in range(pick.randint(1, longest))): pick.randint(1, 40) for _ in range(600)}
    monkeypatch.setattr(spelling, "WORDS_A_RANGE", max(1, len(words) // ranges))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert collected(spelling.spelling_variants(df)) == brute(words)


def test_long_chain_and_long_words(spark):
    words = {"chain" + "x" * k: 3 * 2**k for k in range(12)} | {"q" * 40_000: 5, "q" * 39_999: 10, "q" * 20_000 + "r" + "q" * 19_999: 2, "alone": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("id", F.lit(1)).withColumn("part", F.lit("x"))
    got = {r[0]: r for r in collected(spelling.spelling_variants(df))}
    assert got["chain"][2] == "chain" + "x" * 11 and got["chain"][1] == "chainx" and got["chain"][4] == 1
    assert got["q" * 40_000][1] == "q" * 39_999 and got["q" * 40_000][4] == 2
    assert got["q" * 20_000 + "r" + "q" * 19_999][1:3] == ("q" * 39_999, "q" * 39_999)
    assert got["alone"] == ("alone", None, "alone", 3, 0, None)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Grüße grüße GRÜßE grüssen"), (3, "größe größe größe GRÖßE"), (3, "größe größe größe GRÖßE"), (4, "größen größen größen größer größer größer"), (5, "x" * 50_000 + " " + "abcdef " * 5_000), (6, "a1b2c3 ×÷×÷× " * 3), (7, "Éclair éclair Éclair éclair Éclair éclair")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("n"))
    for slip in (97, 3, None):
        words = brute_words(rows, slip)
        counted = spelling.count_words(docs, slip=slip)
        assert {r["word"]: r["n"] for r in counted.collect()} == words
    assert collected(spelling.spelling_variants(counted)) == brute(words)
    assert spelling.spelling_variants(spelling.count_words(docs.limit(0))).count() == 0


def test_documents(spark, sf):
    """The whole table by brute force."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = collected(spelling.op13_spelling_variants(spark, sf))
    assert got == brute(brute_words(rows)) and sum(r[1] is not None for r in got) > 10
