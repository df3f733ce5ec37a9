"""Every stage of the pipeline against a brute-force version on its own input."""

import hashlib
import struct

import corpus_pipeline as cp
from skyframe.llm import quality_rules
from tests.llm import test_bpe_stream, test_decontamination, test_near_dedup, test_quality_rules, test_substring_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-duplicates", "repeated passages", "benchmark items", "BPE"]
    for k, (_, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        rows = [(i, r["text"]) for i, r in before.items()]
        out = stage(spark, docs, sf)
        out = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == cp.COLUMNS and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if k == 0:
            model = quality_rules.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            judged = {r["doc_id"]: r for r in quality_rules.judge(docs, model).collect()}
            for i, t in rows:
                n, _, _, _, repeat = test_quality_rules.brute(t)
                failed = n < 50 or 100 * repeat > 50 * n
                assert (i in after) == (not failed and judged[i]["score"] >= quality_rules.KEEP_AT)
        elif k == 1:
            groups = test_near_dedup.brute(rows)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        elif k == 2:
            want = {i: kept for i, _, _, kept in test_substring_dedup.brute(rows, 50)}
            assert {i: " ".join(r["text"].split()) for i, r in after.items()} == {i: " ".join(t.split()) for i, t in want.items()}
        elif k == 3:
            dirty = set(test_decontamination.brute([r for r in rows if len(r[1]) < 6000], items))
            assert dirty and not dirty & set(after)
            assert all(i in after for i, t in rows if len(t) < 6000 and i not in dirty)
        else:
            for i, t in rows:
                ids = test_bpe_stream.TOK.encode(t, add_special_tokens=False).ids
                raw = struct.pack(f"<{len(ids)}I", *ids)
                assert bytes(after[i]["ids"]) == raw and after[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
                assert after[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        docs = out


def test_odd_rows_in_every_stage(spark, sf):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, stage by stage on the same rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = next(r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect() if len(r[0].split()) >= 8)
    passage = " ".join(f"p{k}" for k in range(60))
    first = " ".join(f"a{k}" for k in range(60)) + " " + passage
    near = " ".join(f"n{k}" for k in range(40))
    rows = [(1, None), (2, ""), (None, "no id " + passage), (3, first), (4, passage + " second"), (4, passage + " second"), (5, near), (6, near + " more"), (7, "leak " + item), (7, "leak " + item), (8, "long " * 30_000), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], schema)
    docs = docs.selectExpr("*", "1 AS kept", "2 AS bands", "3 AS ids", "4 AS words", "'x' AS _print", "5 AS item_id", "6 AS component_id")
    got = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        got.append(sorted(((r["doc_id"], r["text"]) if k < 4 else (r["doc_id"], r["n_tokens"]) for r in out.collect()), key=str))
        assert k == 4 or out.columns == cp.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0
    by_id = lambda found: sorted((i for i, _ in found), key=str)
    ids = [i for i, _ in rows]
    assert set(got[0]) <= set(rows) and not {1, 2} & set(by_id(got[0]))
    assert got[1] == sorted((r for r in rows if r[0] != 6), key=str)
    text = dict(got[2])
    assert by_id(got[2]) == sorted(ids, key=str) and text[1] == "" and text[3] == first and text[4] == "second"
    assert (None, "no id " + passage) in got[2] and (8, rows[10][1]) in got[2]
    assert by_id(got[3]) == sorted((i for i in ids if i != 7), key=str)
    assert by_id(got[4]) == sorted(ids, key=str) and dict(got[4])[1] == 0 and dict(got[4])[8] > 30_000
