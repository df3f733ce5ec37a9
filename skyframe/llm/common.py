"""What the operators of this folder share: reading inputs, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these ASCII spaces.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: A side is broadcast only if it has been counted and has no more rows than this; beyond it, joins shuffle.
MAX_BROADCAST_ROWS = 400_000


#: Rows of an Arrow batch. Texts are long; small batches bound the off-heap and Python memory of a task.
BATCH_ROWS = 1000


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], done: Callable[[], None] | None = None):
    """A function for mapInArrow that gives memory back at the end of a task: Python workers live on between tasks."""

    def leaner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if done:
            done()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass

    return leaner


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is higher."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset in a local session, as in tests, a fresh
    temporary folder takes its place and is remembered in the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("skyframe.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skyframe-")
        spark.conf.set("skyframe.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables made by :func:`stored` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark).replace("file://", "").replace("file:", "")
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if root in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def small_side(side: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if a count shows at most ``limit`` rows; otherwise unchanged, so joins shuffle."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def big_side(side: DataFrame) -> DataFrame:
    """``side`` with a hint that joins shuffle and sort it, however small it looks: no copy of it goes through the driver."""
    return side.hint("merge")


def unclash(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the columns an operator needs, so that extra columns can't clash with its own names."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in keep])
