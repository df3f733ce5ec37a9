"""The embedding cache: reruns, two encoders, a crash before publishing, two writers, old versions."""

import glob

import pytest
from pyspark.sql import functions as F

from skyframe.operators.checks import ValidationError
from skyframe.sources.cache import EmbeddingCache, spec_hash

KINDS = "object_id string, embedding array<array<double>>, n_tokens int"


def rows(ids, value=1.0, tokens=2, width=3):
    return [(str(i), [[value + k] * width for k in range(tokens)], tokens) for i in ids]


def held(cache):
    return {r["object_id"]: r["embedding"][0][0] for r in cache.read().collect()}


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    cache = EmbeddingCache(spark, root, "image", {"impl": "a", "width": 3}, buckets=4)
    with pytest.raises(FileNotFoundError):
        cache.read()
    index, bad = cache.write(spark.createDataFrame([*rows(range(20)), ("nan", [[1.0, float("nan"), 1.0]], 1), ("inf", [[float("-inf"), 1.0, 1.0]], 1), ("null", None, 0)], KINDS))
    assert sorted(r[0] for r in bad.collect()) == ["inf", "nan", "null"]
    got = index.collect()
    assert len(got) == 20 and {r["out_dim"] for r in got} == {3} and {r["n_tokens"] for r in got} == {2}
    assert {r["spec_impl"] for r in got} == {"a"} and {r["spec_width"] for r in got} == {"3"} and {r["modality"] for r in got} == {"image"}
    # The place in the file is where the row is.
    by_file = {}
    for r in got:
        by_file.setdefault(r["shard_file"], {})[r["row_in_shard"]] = r["object_id"]
    for path, places in by_file.items():
        import pyarrow.parquet as pq

        ids = pq.read_table(path.removeprefix("file://")).column("object_id").to_pylist()
        assert {k: ids[k] for k in places} == places

    # The same objects again, some others, and one that is no longer finite: replaced, not repeated.
    again = spark.createDataFrame([*rows([0, 1, 30], 5.0), ("2", [[float("nan")] * 3], 1)], KINDS)
    cache.write(again)
    now = held(cache)
    assert now == {str(k): 1.0 for k in range(3, 20)} | {"0": 5.0, "1": 5.0, "30": 5.0}
    # An encoder of another description has a cache of its own.
    other = EmbeddingCache(spark, root, "image", {"impl": "b", "width": 3}, buckets=4)
    assert spec_hash({"impl": "b", "width": 3}) != spec_hash({"width": 3, "impl": "a"}) == spec_hash({"impl": "a", "width": 3})
    index, _ = other.write(spark.createDataFrame(rows([0, 7], 9.0), KINDS))
    assert {r["object_id"] for r in index.collect()} == {"0", "7"} and held(cache) == now
    # Replacing leaves nothing else, and old folders can go.
    cache.write(spark.createDataFrame(rows([3], 2.0), KINDS), replace=True)
    assert held(cache) == {"3": 2.0} and cache.current()[0] == 3
    assert len(cache.collect_garbage()) == 3 and held(cache) == {"3": 2.0} and cache.collect_garbage() == []
    assert held(other) == {"0": 9.0, "7": 9.0}


def test_crash_before_publishing(spark, tmp_path, monkeypatch):
    cache = EmbeddingCache(spark, f"file://{tmp_path}", "image", {"impl": "a"}, buckets=2)
    cache.write(spark.createDataFrame(rows(range(6)), KINDS))
    with monkeypatch.context() as m:
        m.setattr(EmbeddingCache, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            cache.write(spark.createDataFrame(rows(range(6), 7.0), KINDS))
    assert set(held(cache).values()) == {1.0} and cache.current()[0] == 1
    assert len(glob.glob(f"{tmp_path}/image/*/data/*")) == 3
    cache.write(spark.createDataFrame(rows(range(3), 8.0), KINDS))
    assert sorted(held(cache).values()) == [1.0] * 3 + [8.0] * 3
    assert cache.collect_garbage() and sorted(held(cache).values()) == [1.0] * 3 + [8.0] * 3


def test_refusals(spark, tmp_path, monkeypatch):
    cache = EmbeddingCache(spark, f"file://{tmp_path}", "image", {"impl": "a"}, buckets=2)
    with pytest.raises(ValidationError, match="two embeddings"):
        cache.write(spark.createDataFrame(rows([1, 1]), KINDS))
    assert cache.current() == (0, {})
    cache.write(spark.createDataFrame(rows([1]), KINDS))
    with pytest.raises(ValidationError, match="buckets"):
        EmbeddingCache(spark, f"file://{tmp_path}", "image", {"impl": "a"}, buckets=3).write(spark.createDataFrame(rows([1]), KINDS))
    # A writer that began from a version which another one has replaced meanwhile.
    monkeypatch.setattr(EmbeddingCache, "current", lambda self: (0, {}))
    with pytest.raises(ValidationError, match="another writer"):
        cache.write(spark.createDataFrame(rows([2]), KINDS))
    monkeypatch.undo()
    assert held(cache) == {"1": 1.0}
    # Nothing finite at all.
    empty = EmbeddingCache(spark, f"file://{tmp_path}", "image", {"impl": "c"}, buckets=2)
    index, bad = empty.write(spark.createDataFrame([("x", [[float("nan")]], 1)], KINDS))
    assert index.count() == 0 and bad.count() == 1 and empty.write(spark.createDataFrame(rows([]), KINDS))[0].count() == 0
    assert empty.write(spark.createDataFrame(rows([4]), KINDS).withColumn("n_tokens", F.col("n_tokens")))[0].count() == 1
