"""A ledger of records that are kept while a run goes on.

Each task writes its records itself, a file for every few records or seconds, so whatever ends a run (a lost executor,
a killed driver) costs no more than the records of an unwritten file. Layout below the ledger's path:

    _schema                         the record's schema, as JSON
    loose/<run>/part-<n>/*.json     files of running or broken runs; a file has its final name only when it is whole
    kept/*.json                     records of finished runs, rewritten into few files

A task that runs again reads what its earlier attempts wrote and doesn't repeat it. A record is identified by key, run
number and attempt, so records that two folders hold for a moment count once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ["seq", "attempt"]
#: A file of a finished run has about so many bytes at most; one task reads and writes it.
KEPT_BYTES = 1 << 26


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class RecordSink:
    """Where the tasks of one run write; travels to them in closures."""

    path: str
    run: str
    seq: int
    key: str
    flush_rows: int = 1
    flush_seconds: float = 10.0

    def prepare(self, schema: T.StructType | str) -> None:
        """Fix the records' schema, before tasks write; a ledger of another schema is an error."""
        write_schema(self.path, T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def open(self) -> Recorder:
        """For the task that this is called in."""
        return Recorder(self)

    def record(self, rows: DataFrame) -> DataFrame:
        """``rows`` as JSON text (key, record), written by the tasks that make them; nothing happens before an action.

        Spark hands rows over in Arrow batches, so use it for steps that cost little; a step that makes paid calls takes
        the sink and appends each result itself.
        """

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with self.open() as out:
                for batch in batches:
                    for line in batch["record"]:
                        out.append(json.loads(line))
                    yield batch

        self.prepare(rows.schema)
        kind = rows.schema[self.key].dataType.simpleString()
        whole = rows.select(self.key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
        return whole.mapInPandas(run, f"`{self.key}` {kind}, record string")


class Recorder:
    """The files of one task attempt. ``known`` holds the records of its earlier attempts by key."""

    def __init__(self, sink: RecordSink):
        from pyspark import TaskContext

        task = TaskContext.get()
        self.sink, self.attempt = sink, task.taskAttemptId()
        self.store, root = pafs.FileSystem.from_uri(sink.path)
        self.folder = f"{root}/loose/{sink.run}/part-{task.partitionId():06d}"
        self.store.create_dir(self.folder, recursive=True)
        self.known: dict = {}
        for info in self.store.get_file_info(pafs.FileSelector(self.folder)):
            if info.base_name.endswith(".json"):
                with self.store.open_input_file(info.path) as f:
                    for line in f.read().decode().splitlines():
                        old = json.loads(line)
                        self.known[old[sink.key]] = old
        self.waiting: list[str] = []
        self.since = time.monotonic()

    def append(self, record: dict) -> None:
        line = record | {"seq": self.sink.seq, "attempt": self.attempt}
        self.waiting.append(json.dumps(line, ensure_ascii=False, default=str))
        if len(self.waiting) >= self.sink.flush_rows or time.monotonic() - self.since >= self.sink.flush_seconds:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            name = f"{self.attempt:012d}-{uuid.uuid4().hex}"
            with self.store.open_output_stream(f"{self.folder}/_{name}", compression=None) as f:
                f.write(("\n".join(self.waiting) + "\n").encode())
            self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}.json")
        self.waiting, self.since = [], time.monotonic()

    def __enter__(self) -> Recorder:
        return self

    def __exit__(self, *error) -> None:
        self.flush()


def write_schema(path: str, schema: T.StructType) -> None:
    full = T.StructType([f for f in schema.fields if f.name not in IDENTITY] + [T.StructField("seq", T.LongType()), T.StructField("attempt", T.LongType())])
    store, root = pafs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    if store.get_file_info(f"{root}/_schema").type != pafs.FileType.NotFound:
        old = ledger_schema(path)
        if {(f.name, f.dataType) for f in old} != {(f.name, f.dataType) for f in full}:
            raise ValueError(f"{path} holds records of another schema: {old.simpleString()}")
        return
    with store.open_output_stream(f"{root}/_schema.new", compression=None) as f:
        f.write(full.json().encode())
    store.move(f"{root}/_schema.new", f"{root}/_schema")


def ledger_schema(path: str) -> T.StructType | None:
    """The schema of the ledger at a path; None where there is no ledger."""
    store, root = pafs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/_schema").type == pafs.FileType.NotFound:
        return None
    with store.open_input_file(f"{root}/_schema") as f:
        return T.StructType.fromJson(json.loads(f.read()))


def read_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All records of a ledger, of broken runs too; each once."""
    schema = ledger_schema(path)
    if schema is None:
        raise FileNotFoundError(f"no ledger at {path}")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return rows.dropDuplicates([key, *IDENTITY])


def latest_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last record of each object: the latest run's, and of several attempts the last one's."""
    last = Window.partitionBy(key).orderBy(F.desc("seq"), F.desc("attempt"))
    return read_records(spark, path, key).withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at")


def keep_run(spark: SparkSession, path: str, run: str, files: int = 8, file_bytes: int = KEPT_BYTES) -> None:
    """Rewrite a finished run's records into few files: ``files``, or more where these would be larger than ``file_bytes``.

    A crash between writing and removal leaves repeats, which readers drop.
    """
    folder, store = _store(spark, f"{path}/loose/{run}")
    if not store.exists(folder):
        return
    files = max(files, -(-store.getContentSummary(folder).getLength() // file_bytes))
    rows = spark.read.schema(ledger_schema(path)).option("recursiveFileLookup", "true").json(f"{path}/loose/{run}")
    rows.coalesce(files).write.mode("append").json(f"{path}/kept")
    store.delete(folder, True)
