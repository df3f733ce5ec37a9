"""A versioned cache of token embeddings for each modality and encoder.

    <root>/<modality>/<spec hash>/data/<version>/bucket=<n>/...   embeddings, dealt by a hash of the id
    <root>/<modality>/<spec hash>/published/<number>              which folder holds each bucket, as JSON

A write makes new folders and then one file in ``published``, which names the folders of all buckets; the file with the
largest number is the cache. So a write that dies before that leaves the cache as it was, readers see one version as a
whole, and of two writers that start from the same version one is refused. A repeated run replaces objects instead of
adding them again: only buckets with objects of that run are written anew. Encoders don't meet: the folder is the
encoder's.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.operators.checks import ValidationError


def spec_hash(spec: dict) -> str:
    """Hash of an encoder's description."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:16]


class EmbeddingCache:
    """The cache of one modality by one encoder. ``spec`` describes the encoder; its fields are columns of the index."""

    def __init__(self, spark: SparkSession, root: str, modality: str, spec: dict, key: str = "object_id", buckets: int = 16, shard_rows: int = 100_000):
        self.spark, self.modality, self.spec, self.key = spark, modality, spec, key
        self.buckets, self.shard_rows = buckets, shard_rows
        self.path = f"{root.rstrip('/')}/{modality}/{spec_hash(spec)}"
        self.jvm = spark.sparkContext._jvm
        self.store = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        p = self._p(folder)
        return sorted(s.getPath().getName() for s in self.store.listStatus(p)) if self.store.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("published") if n.isdigit())

    def _published(self, number: int) -> dict:
        p = self._p(f"published/{number:08d}")
        stream = self.store.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, str]]:
        """(number, folder by bucket) of the published version; number 0 and no folders before the first."""
        numbers = self._numbers()
        return (numbers[-1], self._published(numbers[-1])["folders"]) if numbers else (0, {})

    def _publish(self, number: int, folders: dict[str, str]) -> None:
        """One new file, which another writer of that number finds taken."""
        text = json.dumps({"spec": {k: str(v) for k, v in self.spec.items()}, "buckets": self.buckets, "folders": folders}, sort_keys=True)
        waiting = self._p(f"published/.{uuid.uuid4().hex}")
        out = self.store.create(waiting, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        # A rename to a name that exists fails, so the file appears whole or not at all.
        taken = self._p(f"published/{number:08d}")
        if self.store.exists(taken) or not self.store.rename(waiting, taken):
            self.store.delete(waiting, False)
            raise ValidationError(f"another writer has published version {number} of {self.path}")

    def _read(self, folders) -> DataFrame:
        """Embeddings of some folders, with the place of each row in its file."""
        schema = self.spark.read.parquet(folders[0]).schema
        rows = self.spark.read.schema(schema).parquet(*folders)
        return rows.withColumns({"shard_file": F.col("_metadata.file_path"), "row_in_shard": F.col("_metadata.row_index")})

    def _check_buckets(self, number: int) -> None:
        if number and (had := self._published(number)["buckets"]) != self.buckets:
            raise ValidationError(f"{self.path} has {had} buckets, not {self.buckets}")

    def write(self, embeddings: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
        """(index, ids left out) after writing (key, embedding, n_tokens).

        Objects that the cache holds already are replaced; with ``replace`` the cache then holds these objects only.
        Embeddings with a value that isn't finite are left out, with the object's earlier one. Each embedding is computed
        once. An object that comes twice is an error.
        """
        number, folders = self.current()
        self._check_buckets(number)
        bad = F.exists(F.flatten("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        dealt = embeddings.select(self.key, "embedding", "n_tokens").withColumns({"bad": F.coalesce(bad, F.lit(True)).cast("int"), "bucket": F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")})
        fresh = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt.repartition(self.buckets, "bucket").write.partitionBy("bad", "bucket").option("maxRecordsPerFile", self.shard_rows).parquet(fresh)
        all_rows = self.spark.read.schema(dealt.schema).parquet(fresh)
        twice = all_rows.groupBy(self.key).count().where("count > 1").limit(3).collect()
        if twice:
            raise ValidationError(f"objects with two embeddings: {[r[0] for r in twice]}")
        touched = [r[0] for r in all_rows.select("bucket").distinct().collect()]  # a number for each bucket
        good = {str(r[0]): f"{fresh}/bad=0/bucket={r[0]}" for r in all_rows.where("bad = 0").select("bucket").distinct().collect()}
        kept = {} if replace else {b: f for b, f in folders.items() if int(b) not in touched}
        mixed = [] if replace else [b for b in folders if int(b) in touched]
        if mixed:
            merged = f"{self.path}/data/{uuid.uuid4().hex}"
            old = self._read([folders[b] for b in mixed]).select(self.key, "embedding", "n_tokens").join(all_rows.select(self.key), self.key, "left_anti")
            old = old.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            new = all_rows.where("bad = 0").where(F.col("bucket").isin([int(b) for b in mixed])).select(*old.columns)
            old.unionByName(new).repartition(self.buckets, "bucket").write.partitionBy("bucket").option("maxRecordsPerFile", self.shard_rows).parquet(merged)
            there = {n.split("=")[1] for n in self._names(merged[len(self.path) + 1 :]) if n.startswith("bucket=")}
            good = {b: f for b, f in good.items() if b not in mixed} | {b: f"{merged}/bucket={b}" for b in mixed if b in there}
        self._publish(number + 1, kept | good)
        return self.index(), all_rows.where("bad = 1").select(self.key)

    def read(self) -> DataFrame:
        """(key, embedding, n_tokens, shard_file, row_in_shard) of the published version."""
        number, folders = self.current()
        if not number:
            raise FileNotFoundError(f"no cache of {self.modality} at {self.path}")
        if not folders:
            return self.spark.createDataFrame([], f"`{self.key}` string, embedding array<array<double>>, n_tokens int, shard_file string, row_in_shard long")
        return self._read([folders[b] for b in sorted(folders, key=int)])

    def index(self) -> DataFrame:
        """(key, shard_file, row_in_shard, n_tokens, out_dim, modality, spec_...) of the published version."""
        width = F.coalesce(F.size(F.get("embedding", F.lit(0))), F.lit(0))
        spec = [F.lit(str(v)).alias(f"spec_{k}") for k, v in sorted(self.spec.items())]
        return self.read().select(self.key, "shard_file", "row_in_shard", "n_tokens", width.alias("out_dim"), F.lit(self.modality).alias("modality"), *spec)

    def collect_garbage(self, keep: int = 1) -> list[str]:
        """Remove folders that none of the last ``keep`` versions names, those of broken writes too, and older versions; returns them.

        Nothing may be writing meanwhile.
        """
        numbers = self._numbers()
        named = {f[len(self.path) :].split("/")[2] for n in numbers[-keep:] for f in self._published(n)["folders"].values()}
        gone = [name for name in self._names("data") if name not in named]
        for number in numbers[:-keep]:
            self.store.delete(self._p(f"published/{number:08d}"), False)
        for name in gone:
            self.store.delete(self._p(f"data/{name}"), True)
        return gone
