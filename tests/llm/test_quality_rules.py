import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skyframe.llm import quality_rules as q
from skyframe.llm.textkernel import chunks


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = Counter(zip(words, words[1:], words[2:]))
    cover = set()
    for i in range(len(words) - 2):
        if three[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)]


def counted(texts):
    return [r[:5].tolist() for _, _, data, offs in chunks(pa.array(texts, pa.string())) for r in q.count_statistics(data, offs)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#|é漢\x0b\x1f", max_size=30)), max_size=6))
def test_counts(texts):
    assert counted(texts) == [brute(t) for t in texts]


def test_counts_long():
    texts = ["a b c " * 1000, "", "x\n" * 50, None, " \n \n", "wörd " * 3]
    assert counted(texts) == [brute(t) for t in texts]


def test_monotonic_and_useful():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=3000) < 0.5).astype(float)
    model = q.fit(x, y, [-1, 0, 0])
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(rng.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_documents(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in q.op8_quality_rules(spark, sf).collect():
        want = brute(texts[r["doc_id"]])
        assert [r[c] for c in q.COUNTS] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = q.train(docs, labels.where("doc_id % 2 = 0"))
    rows = q.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "a " * 60), (2, "w%d " * 3)], "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS kept")
    labels = spark.createDataFrame([(1, None), (5, 1)], "doc_id long, quality int")
    assert q.train(docs, labels) is None
    out = q.judge(docs, None).collect()
    assert sorted(r["n_words"] for r in out) == [0, 3, 60] and all(r["base_failed"] for r in out)
    assert q.judge(docs.limit(0), None).count() == 0
    good = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(60)), None)], "doc_id long, text string, extra int")
    assert [r["doc_id"] for r in q.filter_documents(good.unionByName(docs.selectExpr("doc_id", "text", "1 AS extra")), None).collect()] == [7]
