import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyframe.llm import context_tree as c
from skyframe.llm.textkernel import Words, chunks


def canon(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return (" ".join(re.findall(r"[^\x20\x09-\x0D]+", low)) + "\n").encode()


class Brute:
    """The textbook recursion, one bit at a time."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, Counter()
        for t in texts:
            for bit, node, ctx in self.bits(canon(t)):
                for d in range(depth + 1):
                    self.n[(ctx[len(ctx) - d :], node, bit)] += 1
        self.contexts = {}
        for ctx, node, _ in self.n:
            if ctx:
                self.contexts.setdefault((ctx[1:], node), set()).add(ctx)
        self.memo = {}

    def bits(self, raw):
        raw = b"\n" * self.depth + raw
        for i in range(self.depth, len(raw)):
            node = 1
            for b in range(7, -1, -1):
                bit = raw[i] >> b & 1
                yield bit, node, raw[i - self.depth : i]
                node = node * 2 + bit

    def own(self, ctx, node):
        a, b = self.n[(ctx, node, 0)], self.n[(ctx, node, 1)]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, ctx, node):
        if (ctx, node) not in self.memo:
            own = self.own(ctx, node)
            if len(ctx) < self.depth:
                below = sum(self.weighted(x, node) for x in self.contexts.get((ctx, node), ()))
                own = np.logaddexp(own, below) + math.log(0.5)
            self.memo[(ctx, node)] = own
        return self.memo[(ctx, node)]

    def one(self, ctx, node, d=0):
        at = ctx[len(ctx) - d :]
        a, b = self.n[(at, node, 0)], self.n[(at, node, 1)]
        kt = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        stay = math.exp(math.log(0.5) + self.own(at, node) - self.weighted(at, node)) if a + b else 0.5
        return stay * kt + (1 - stay) * self.one(ctx, node, d + 1)

    def score(self, text):
        return sum(math.log10(q if bit else 1 - q) for bit, node, ctx in self.bits(canon(text)) for q in [self.one(ctx, node)])


def test_canonical_and_keys():
    texts = ["Ab  cd", "", None, "é\nx ", "   "]
    for _, _, data, offs in chunks(pa.array(texts, pa.string())):
        words = Words(data, offs)
        out, begins = c.canonical(words)
        keys, firsts = c.gram_keys(out, begins)
        for k, t in enumerate(texts):
            assert bytes(out[begins[k] + c.DEPTH : begins[k + 1]]) == canon(t)
            raw = b"\n" * c.DEPTH + canon(t)
            want = [int.from_bytes(raw[i : i + c.DEPTH + 1], "big") for i in range(len(canon(t)))]
            assert keys[firsts[k] : firsts[k + 1]].tolist() == want


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.5, 100.5, 1e6])
    assert np.allclose(c.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def check(spark, rows, unit_keys):
    """Every row's figures against the textbook recursion."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("key", F.lit("x")).withColumn("unit", F.lit(2))
    train = [t for k, t in rows if k is None or k % 3 != 2]
    brute = Brute(train, c.DEPTH)
    counts = Counter(w for t in train for w in [*canon(t).decode()[:-1].split(" "), None] if w != "")
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for k, t in rows:
        toks = [w for w in canon(t).decode()[:-1].split(" ") if w] + [None]
        want.append((k is None, k or 0, k is not None and k % 3 == 2, len(toks), sum(w in counts for w in toks), total, len(canon(t)), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in toks), brute.score(t)))
    out = c.score_documents(docs, F.expr(HELD), unit_keys).collect()
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["n_bytes"], r["base_score"], r["score"]) for r in out]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:7] == b[:7] and math.isclose(a[7], b[7], rel_tol=1e-9) and math.isclose(a[8], b[8], rel_tol=1e-7), (a, b)


HELD = "doc_id % 3 = 2"
FEW = ["the cat sat on the mat", "The Cat ate", "", None, "a rat sat", "zebra \u00e9 quick", "the cat"]


def test_against_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(FEW * 2)]
    for unit_keys in (1 << 21, 1):
        check(spark, rows, unit_keys)


def test_many_units_repeated_rows_null_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(c, "GROUP_ROWS", 50)
    odd = ["\u00f8\u00f8", "\u00f8\u00f8\u00f8\u00f8", "\u00f8\u00f8", "aaaa", "q" * 3000, "the  cat\n" * 400]
    rows = [(k, t) for k, t in enumerate([*FEW, *odd] * 3)] + [(None, "a null id"), (None, "a null id"), (None, None), (5, odd[0]), (5, odd[0]), (5, odd[0]), (5, "other"), (7, FEW[0]), (7, FEW[0])]
    check(spark, rows, 40)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = c.op4_lm_score(spark, sf).collect()
    docs = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == docs and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    # Two megabytes to learn from: the words' own counts are as good; with more text the trees are better.
    assert sum(r["score"] for r in held) > 1.03 * sum(r["base_score"] for r in held)
    assert sum(r["bits_per_byte"] for r in held) / len(held) < 2.7
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in rows)


def test_expressions(spark):
    x = [0.5, 1.0, 1.5, 7.5, 100.5, 1e6, 1e12]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(c._log_gamma(F.col("x")).alias("y")).collect()
    assert np.allclose([r["y"] for r in got], [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = c.score_documents(docs, F.lit(True)).first()
    assert math.isclose(r["score"], 3 * 8 * math.log10(0.5), rel_tol=1e-9) and r["base_score"] == 0
    assert c.score_documents(docs.limit(0), F.lit(False)).count() == 0


def test_lookup_takes_little_besides_its_table():
    """A full unit's lookups: right values, and less than 120 MB while they are filled."""
    import tracemalloc

    keys = np.random.default_rng(3).permutation(np.arange(1, (1 << 21) + 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = np.arange(len(keys), dtype=float)
    tracemalloc.start()
    table = c.Lookup(keys, values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (table.get(keys[::7]) == values[::7]).all() and (table.get(keys[:1000] + np.uint64(1)) == 0).all()
    assert peak < 120e6
