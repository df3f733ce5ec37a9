import hashlib
import random
import re

from pyspark.sql import functions as F

from skyframe.llm import substring_dedup as s


def brute(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept))
    return sorted(out, key=str)


def result(docs, **how):
    runs = s.find_repeated(docs, **how)
    out = s.cut_documents(docs, runs, how.get("window", s.WINDOW), layout=False)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=str)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = [(a, b, c, hashlib.sha256(k.encode()).hexdigest()) for a, b, c, k in brute(rows, 50)]
    got = sorted((tuple(r) for r in s.op10_substring_dedup(spark, d).collect()), key=str)
    assert got == sorted(want, key=str) and sum(r[2] for r in got) > 0


def test_random_passages(spark):
    rng = random.Random(4)
    for vocabulary, batches in ((2, 1), (5, 3), (400, 5)):
        word = lambda: f"w{rng.randrange(vocabulary)}"
        passages = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(5)]
        rows = []
        for k in range(60):
            parts = [rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(12))] for _ in range(rng.randrange(6))]
            rows.append((k, "  ".join(x for p in parts for x in p)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(docs, batches=batches, window=8, gram=3, fanout=2) == brute(rows, 8)


def test_index_grows_and_compacts(spark):
    text = " ".join(f"a{k}" for k in range(30))
    docs = spark.createDataFrame([(k, f"x{k} {text} y{k}") for k in range(10)], "doc_id long, text string")
    index = s.FingerprintIndex(spark, fanout=2)
    for k in range(0, 10, 2):
        runs = s.repeated_runs(index, docs.where(f"doc_id IN ({k}, {k + 1})"), docs.where(f"doc_id <= {k + 1}"), 8, 3)
        out = s.cut_documents(docs.where(f"doc_id IN ({k}, {k + 1})"), runs, 8, layout=False).collect()
        assert {r["doc_id"]: r["n_removed"] for r in out} == {k: 30 if k else 0, k + 1: 30}
        index.compact()
    assert {n for n, _ in s.FingerprintIndex(spark, index.path).tables()} == {0, 2}


def test_default_batches_meet_a_merged_table(spark):
    text = " ".join(f"a{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"x{k} {text} y{k % 3}") for k in range(12)], "doc_id long, text string")
    index = s.FingerprintIndex(spark, fanout=s.FANOUT)
    out = s.cut_documents(docs, s.find_repeated(docs, index=index), layout=False).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out) == sorted(brute([tuple(r) for r in docs.collect()], 50))
    assert {n for n, _ in index.tables()} == {0, 1}


def test_digests_are_of_the_words():
    import pyarrow as pa

    texts = ["ab  c\nd", "e f", "", " g ", "h\u00e9 i"]
    for _, _, data, offsets in s.chunks(pa.array(texts)):
        words = s.Words(data, offsets)
        every = [w for t in texts for w in t.split()]
        spans = [(a, b) for d in range(len(texts)) for a in range(words.bounds[d], words.bounds[d + 1]) for b in range(a + 1, words.bounds[d + 1] + 1)]
        one, two = s.Digests(words).of(*map(s.np.array, zip(*spans, strict=True)))
        for (a, b), x, y in zip(spans, one.to_pylist(), two.to_pylist(), strict=True):
            assert hashlib.sha256(" ".join(every[a:b]).encode()).digest()[:16] == x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, text), (4, "\n" + text + "  end\n"), (4, text + " other"), (None, text), (5, "a " * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("print", F.lit("x"))
    assert result(docs) == brute(rows, 50)
    cut = {(r["doc_id"], r["_other_print"]): r["kept"] for r in s.cut_documents(docs.where("doc_id <> 4 OR text LIKE '%end%'"), s.find_repeated(docs)).collect()}
    assert cut[(4, "x")] == "\nend\n"
    assert result(docs.limit(0)) == []
