import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from skyframe.llm import decontamination as d


def words(text):
    return [w for w in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", (text or "").lower()) if w]


def brute(docs, items):
    """All windows on all diagonals of every document with every item, with numpy, whatever their length."""
    number, out = {}, {}
    ids = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    asked = [(item, ids(words(text))) for item, text in items]
    for key, text in docs:
        w = ids(words(text))
        n = len(w)
        for item, v in asked:
            m = len(v)
            size = min(m, d.OVERLAP)
            if not m or n < size:
                continue
            need = size if m < d.SPAN else d.PERCENT * size / 100
            if np.isin(v, w).sum() < need:
                continue
            diagonals = np.arange(-m, n)
            at = diagonals[None, :] + np.arange(m)[:, None]
            inside = (at >= 0) & (at < n)
            same = np.vstack([np.zeros(len(diagonals), int), np.cumsum(inside & (w[np.clip(at, 0, n - 1)] == v[:, None]), 0)])
            full = np.vstack([np.zeros(len(diagonals), int), np.cumsum(inside, 0)])
            if (((same[size:] - same[:-size]) >= need) & ((full[size:] - full[:-size]) == size)).any():
                out.setdefault(key, set()).add(item)
    return out


def test_documents(spark):
    """300 documents whole, the longest of them too."""
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in table.limit(290).union(table.orderBy(F.length("text").desc()).limit(10)).distinct().collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(got) == len(docs) and want and max(len(t) for _, t in docs) > 20_000
    assert {r["doc_id"]: set(r["item_ids"]) for r in got if r["contaminated"]} == want


def test_long_texts_with_many_diagonals(spark, monkeypatch):
    """One word over and over gives a diagonal at every position; hits lie at the ends of texts and across pieces."""
    rng = random.Random(5)
    item = [f"w{k}" for k in range(30)]
    texts, hit = ["same " * 9_000, " ".join(rng.choice(["same", "other"]) for _ in range(6_000))], []
    for at in (0, 7, 63, 64, 65, 100, 127, 128, 1_000, 4_970):
        body = [rng.choice("abcdefgh") * 3 for _ in range(5_000)]
        body[at : at + 30] = item[: 5_000 - at]
        body[at + 3] = "changed"
        hit.append(len(texts))
        texts.append(" ".join(body))
    docs, items = list(enumerate(texts)), [(1, " ".join(item)), (2, "same " * 20), (3, "same other " * 9), (4, " ".join(f"x{k}" for k in range(9)))]
    for step in (64, 512):
        monkeypatch.setattr(d, "LEAST_PIECE", step)
        monkeypatch.setattr(d, "MAX_ITEM_WORDS", 0 if step == 64 else 2_000_000)
        got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        found = {r["doc_id"]: set(r["item_ids"]) for r in got if r["contaminated"]}
        assert found == brute(docs, items) and all(1 in found[k] for k in hit)


def test_substitutions(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    docs, hit = [], set()
    for k in range(200):
        at, size = rng.randrange(20), rng.choice([16, 20, 30])
        part = item[at : at + size]
        for _ in range(rng.choice([0, 1, 2])):
            part[rng.randrange(len(part))] = word()
        docs.append((k, " ".join([word() for _ in range(rng.randrange(30))] + part + [word() for _ in range(9)]).title()))
    docs += [(1000 + k, " ".join(word() for _ in range(50))) for k in range(30)]
    items = [(1, " ".join(item)), (2, "one two three, four"), (3, None), (4, "")]
    docs.append((2000, "zero One TWO three four. five"))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for limit in (d.MAX_SEEDS, 3):
        found = d.contaminated_pairs(frames[0].withColumnRenamed("doc_id", "doc_key"), frames[1], limit).collect()
        hit = {(r["doc_key"], r["item_id"]) for r in found}
        all_ = {(k, i) for k, v in want.items() for i in v}
        assert hit <= all_ and len(hit) >= 0.97 * len(all_) and (2000, 2) in hit


def test_masks_lose_nothing():
    """Every overlap of 8 to 16 words with up to 20 per cent of them changed leaves room for a mask."""
    for m in range(d.SPAN, d.OVERLAP + 1):
        masks = d.MASKS if m in d.HARD else d.MASKS[:2]
        places = [{at + j for j, bit in enumerate(k) if bit == "1"} for k in masks for at in range(m - len(k) + 1)]
        for changed in itertools.combinations(range(m), m * (100 - d.PERCENT) // 100):
            assert any(p.isdisjoint(changed) for p in places), (m, changed)


def test_short_items_at_both_parities(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, items = [], []
    for m in range(8, 17):
        item = [word() for _ in range(m)]
        items += [(m, " ".join(item)), (100 + m, " ".join(item).upper())]
        for k in range(24):
            part = list(item)
            for p in rng.sample(range(m), k % (m // 5 + 2)):
                part[p] = word()
            docs.append((1000 * m + k, " ".join([word() for _ in range(k)] + part + [word() for _ in range(k // 2 % 3)])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i) for k, v in brute(docs, items).items() for i in v}
    for limit in (d.MAX_SEEDS, 3):
        found = d.contaminated_pairs(frames[0].withColumnRenamed("doc_id", "doc_key"), frames[1], limit).collect()
        assert {(r["doc_key"], r["item_id"]) for r in found} == want
    rows = d.decontaminate(*frames).collect()
    assert {(r["doc_id"], i) for r in rows for i in r["item_ids"] or []} == want and all(r["n_items"] in (0, 2) for r in rows)


def test_odd_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, None), (2, ""), (None, item), (3, item), (3, item), (4, "x " * 50_000)], "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("n", F.lit(1))
    bench = spark.createDataFrame([(9, item)], "item_id long, text string").withColumn("words", F.lit(0))
    rows = d.decontaminate(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in rows) == [("1", False), ("2", False), ("3", True), ("3", True), ("4", False), ("None", True)]
    assert sorted(r["doc_id"] for r in d.clean_documents(docs, bench).collect()) == [1, 2, 4]
    assert not any(r["contaminated"] for r in d.decontaminate(docs, bench.limit(0)).collect())
    assert d.decontaminate(docs.limit(0), bench).count() == 0
