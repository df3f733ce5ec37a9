"""Ledgers as streams of JSON files: the latest record per object, and running scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyframe.operators.splits import latest_record


def _files(spark: SparkSession, path: str, schema: str, per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)


def stream_ledger(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, key: str = "object_id", seq: str = "seq", per_trigger: int | None = None, parts: int = 64) -> StreamingQuery:
    """Fold new lines into a table of the latest record per object below ``out``.

    Objects are dealt by hash to ``parts``. A batch reads and rewrites only the parts that its objects are in, as
    ``out/batch=<id>/part=<k>``; the version of a part with the greatest batch is current. A batch that runs again starts
    from the versions before it and replaces its own folder. Superseded versions are deleted when the next batch starts,
    as only then the batch that superseded them is known to be committed. Versions below the part count as one: keep
    ``parts`` the same for one ``out``.
    """

    def fold(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        current, superseded = _versions(own, out, number)
        for old in superseded:
            _delete(own, old)
        dealt = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in dealt.select("part").distinct().collect()]  # at most ``parts``
        before = [current[p] for p in touched if p in current]
        rows = batch
        if before:
            rows = own.read.schema(batch.schema).parquet(*before).unionByName(batch)
        latest = latest_record(rows, key, seq).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        latest.repartition(max(1, len(touched)), "part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch={number}")

    stream = _files(spark, path, schema, per_trigger)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _filesystem(spark, path)
    fs.delete(at, True)


def _versions(spark: SparkSession, out: str, upto: int | None = None) -> tuple[dict[int, str], list[str]]:
    """The current folder of each part from complete batches (before ``upto``), and the folders that these supersede."""
    at, fs = _filesystem(spark, out)
    if not fs.exists(at):
        return {}, []
    found: dict[int, list[tuple[int, str]]] = {}
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if not name.startswith("batch=") or (upto is not None and int(name[6:]) >= upto):
            continue
        inside = [(x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(s.getPath())]
        if "_SUCCESS" in (n for n, _ in inside):
            for n, folder in inside:
                if n.startswith("part="):
                    found.setdefault(int(n[5:]), []).append((int(name[6:]), folder))
    ordered = {p: sorted(v) for p, v in found.items()}
    return {p: v[-1][1] for p, v in ordered.items()}, [f for v in ordered.values() for _, f in v[:-1]]


def current_table(spark: SparkSession, out: str) -> DataFrame | None:
    """The folded table, or None before anything was folded."""
    current, _ = _versions(spark, out)
    return spark.read.parquet(*current.values()) if current else None


def stream_scores(spark: SparkSession, path: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], per_trigger: int | None = None) -> StreamingQuery:
    """Running (route, n, accuracy, parse_rate) as records land; ``sink`` gets the complete table after each batch."""
    ok = F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)).cast("int")
    rows = _files(spark, path, schema, per_trigger)
    scores = rows.groupBy("route").agg(F.count("*").alias("n"), F.avg(ok).alias("accuracy"), F.avg(F.col("answer").isNotNull().cast("int")).alias("parse_rate"))
    return scores.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
