"""Removal of long repeated passages with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers it also starts in an
earlier document (one with a smaller doc_id). Windows are judged on the input, not on what is left of it.

Fingerprints. Every window has a least 10-word hash; consecutive windows with the same one form a run, about one run for
21 words, and equal windows lie in runs with the same least hash, wherever they are. So the index holds runs instead of
windows and still misses none: (least hash, digest of the words of the run's whole span, document, first and last
window). Hashes only bring candidates together; equality is judged on the words themselves, by 128 bits of the SHA-256
digest of the words joined by one space, computed from each text.

Index. Each batch is written as an immutable table sorted by least hash; when ``fanout`` tables of a level are there,
they are merged into one of the next level that keeps the earliest document of each span. A corpus comes in ``BATCHES``
batches, so that the later ones meet merged tables.

Matching a batch against itself and the history, on the least hash:

* runs with the words of a whole run of an earlier document go entirely;
* where spans with one least hash differ, as at the ends of a passage, the earliest document of each span is looked at
  window by window: their windows are read from the texts and compared by the digests of their words.

Copies of one passage therefore cost one row a run and never meet each other in pairs; every step is a partial aggregate
or an equi-join, and hot hashes are split by skew-aware joins.

Defined cases: a null or empty text has no words; documents with fewer than ``WINDOW`` words lose nothing; rows with a
null id are kept whole and never a source; rows with the same id never remove each other, even with different texts; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import drop_stored, fresh_path, lean, read_table, small_side, stored, unclash
from skyframe.llm.textkernel import IS_SPACE, Words, as_long, chunks, grams, sliding_min

WINDOW, GRAM, BATCHES, FANOUT = 50, 10, 3, 2
RUN_SCHEMA = "least long, span long, check long, doc_id long, print long, first int, last int"
SPAN = ["least", "span", "check"]


class Digests:
    """Digests of runs of words of a chunk, the words joined by one space."""

    def __init__(self, words: Words):
        kept = ~IS_SPACE[words.data]
        inner = np.ones(len(words.ends), bool)
        last = words.bounds[1:][np.diff(words.bounds) > 0] - 1
        inner[last] = False  # the byte after a document's last word may be another document's
        kept[words.ends[inner]] = True
        joined = words.data.copy()
        joined[words.ends[inner]] = 32
        before = np.cumsum(kept) - kept
        self.raw = memoryview(joined[kept])
        self.starts = before[words.starts]
        self.ends = self.starts + words.ends - words.starts

    def of(self, firsts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Two longs for the words from each of ``firsts`` up to before ``ends``."""
        digest, raw = hashlib.sha256, self.raw
        found = b"".join([digest(raw[a:b]).digest()[:16] for a, b in zip(self.starts[firsts].tolist(), self.ends[ends - 1].tolist(), strict=True)])
        both = np.frombuffer(found, "<i8").reshape(-1, 2)
        return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _run_batches(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in chunks(batch.column(2)):
                words = Words(data, offsets)
                hashes = words.hashes()
                least = sliding_min(grams(hashes, gram), window - gram + 1)
                if not len(least):
                    continue
                doc = np.repeat(np.arange(end - start), np.diff(words.bounds))
                inside = doc[: len(least)] == doc[window - 1 :]
                fresh = np.ones(len(least), bool)
                fresh[1:] = ~inside[:-1] | (least[1:] != least[:-1])
                firsts = np.flatnonzero(inside & fresh)
                closing = np.ones(len(least), bool)
                closing[:-1] = ~inside[1:] | (least[1:] != least[:-1])
                lasts = np.flatnonzero(inside & closing)
                span, check = Digests(words).of(firsts, lasts + window)
                rows = pa.array(doc[firsts] + start)
                at = words.bounds[doc[firsts]]
                yield pa.RecordBatch.from_arrays([as_long(least[firsts]), span, check, batch.column(0).take(rows), batch.column(1).take(rows), pa.array((firsts - at).astype(np.int32)), pa.array((lasts - at).astype(np.int32))], ["least", "span", "check", "doc_id", "print", "first", "last"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a fingerprint of the text (rows with one id may differ), and the text."""
    return unclash(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("print"), "text")


def window_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The runs of all documents with an id."""
    return _keyed(docs.where("doc_id IS NOT NULL")).mapInArrow(lean(_run_batches(window, gram)), RUN_SCHEMA)


class FingerprintIndex:
    """Immutable sorted tables of runs below a path, by level."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path or fresh_path(spark, "fingerprints"), fanout

    def tables(self) -> list[tuple[int, str]]:
        """(level, path) of the tables that were written completely, oldest first."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [p.getPath() for p in files.listStatus(root)]
        done = [p for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return [(int(p.getName().split("-")[1]), p.toString()) for p in sorted(done, key=lambda p: p.getName())]

    def _write(self, rows: DataFrame, level: int) -> str:
        number = 1 + max([int(p.rsplit("-", 2)[1]) for _, p in self.tables()], default=0)
        path = f"{self.path}/run-{level:02d}-{number:06d}-{uuid.uuid4().hex[:8]}"
        # Rebalancing deals by hash and splits what is hot; inside each file rows are sorted.
        rows.hint("rebalance", "least").sortWithinPartitions("least").write.parquet(path)
        return path

    def read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else None

    def add(self, runs: DataFrame) -> str:
        return self._write(runs, 0)

    def compact(self) -> None:
        """Merge every level that has ``fanout`` tables; the merged tables are deleted once the new one is complete."""
        level = 0
        while len(now := [p for n, p in self.tables() if n == level]) or any(n > level for n, _ in self.tables()):
            if len(now) >= self.fanout:
                rows = self.read(now)
                earliest = rows.groupBy(*SPAN).agg(F.min("doc_id").alias("doc_id"))
                self._write(rows.join(earliest, [*SPAN, "doc_id"], "left_semi").dropDuplicates([*SPAN, "doc_id"]), level + 1)
                jvm = self.spark.sparkContext._jvm
                for p in map(jvm.org.apache.hadoop.fs.Path, now):
                    p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            level += 1


def _window_batches(window: int):
    """Windows of the listed runs: (least, digest, document, window)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, fresh = batch.column(2), batch.column(3)
            for start, end, data, offsets in chunks(batch.column(4)):
                words, out = Words(data, offsets), []
                for k in range(start, end):
                    runs = wanted[k].values
                    leasts, firsts, lasts = (runs.field(i).to_numpy() for i in range(3))
                    sizes = lasts - firsts + 1
                    at = np.repeat(firsts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    out.append((np.full(len(at), k), np.repeat(leasts, sizes), at, at + words.bounds[k - start]))
                rows, leasts, at, place = (np.concatenate(x) for x in zip(*out, strict=True))
                span, check = Digests(words).of(place, place + window)
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(leasts), span, check, batch.column(0).take(rows), batch.column(1).take(rows), fresh.take(rows), pa.array(at.astype(np.int32))], [*SPAN, "doc_id", "print", "fresh", "first"])

    return run


def repeated_runs(index: FingerprintIndex, batch: DataFrame, texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add a batch to the index; returns (doc_id, print, first, last) of its windows that earlier documents have.

    ``texts`` must hold the texts of all documents in the index and in the batch.
    """
    spark = batch.sparkSession
    history = index.read([p for _, p in index.tables()])
    own = index.read([index.add(window_runs(batch, window, gram))]).withColumn("fresh", F.lit(True))
    rows = own if history is None else own.unionByName(history.withColumn("fresh", F.lit(False)))
    shared = rows.groupBy("least").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("fresh").alias("fresh")).where("a <> b AND fresh")
    rows = shared_runs = stored(rows.join(shared.select("least"), "least", "left_semi"), "shared-runs")
    spans = rows.groupBy(*SPAN).agg(F.min("doc_id").alias("earliest"), F.max("fresh").alias("_any"))
    matched = stored(rows.join(spans.drop("_any"), SPAN), "matched-runs")
    whole = matched.where("fresh AND doc_id > earliest").select("doc_id", "print", "first", "last")

    mixed = spans.groupBy("least").agg(F.count("*").alias("n"), F.max("_any").alias("_any")).where("n > 1 AND _any").select("least")
    heads = matched.where("doc_id = earliest").join(mixed, "least", "left_semi")
    wanted = stored(heads.groupBy("doc_id", "print", "fresh").agg(F.collect_list(F.struct("least", "first", "last")).alias("runs")), "wanted-runs")
    ids = wanted.select("doc_id").distinct()
    some = _keyed(texts).join(small_side(ids), "doc_id", "left_semi")
    looked = wanted.join(some, ["doc_id", "print"]).select("doc_id", "print", "runs", "fresh", "text")
    windows = stored(looked.mapInArrow(lean(_window_batches(window)), "least long, span long, check long, doc_id long, print long, fresh boolean, first int"), "windows")
    # Written, so that the join below has an exchange of its own on either side and its hot windows can be split.
    earliest = stored(windows.groupBy(*SPAN).agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a <> _b").select(*SPAN, "_a"), "earliest")
    single = windows.where("fresh").join(earliest, SPAN).where("doc_id > _a").select("doc_id", "print", "first", F.col("first").alias("last"))
    found = stored(whole.unionByName(single), "repeated-runs")
    drop_stored(spark, shared_runs, matched, wanted, windows, earliest)
    return found


def _cut_batches(window: int, layout: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts, runs, out = part.column(1), part.column(2), []
                for i in range(len(texts)):
                    raw = (texts[i].as_py() or "").encode()
                    out.append(_cut(raw, runs[i].values if runs[i].is_valid else None, window, layout))
                counts, removed, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *part.columns[3:]], ["doc_id", "n_words", "n_removed", "kept", *part.schema.names[3:]])

    return run


def _cut(raw: bytes, runs, window: int, layout: bool) -> tuple[int, int, str]:
    if runs is None:
        words = raw.split()
        return len(words), 0, (raw if layout else b" ".join(words)).decode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    n = len(words.starts)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs.field(0).to_numpy(), 1)
    np.add.at(edge, runs.field(1).to_numpy() + window, -1)
    gone = np.cumsum(edge[:n]) > 0
    if layout:  # a removed word takes the space after it along
        until = np.append(words.starts[1:], len(raw))
        keep = b"".join(raw[a:b] for a, b, g in zip(words.starts.tolist(), until.tolist(), gone.tolist(), strict=True) if not g)
        keep = raw[: words.starts[0]] + keep
    else:
        keep = b" ".join(raw[a:b] for a, b, g in zip(words.starts.tolist(), words.ends.tolist(), gone.tolist(), strict=True) if not g)
    return n, int(gone.sum()), keep.decode()


def cut_documents(docs: DataFrame, repeated: DataFrame, window: int = WINDOW, layout: bool = True) -> DataFrame:
    """All documents with n_words, n_removed and ``kept``, the text without repeated windows, besides their other columns.

    With ``layout`` the kept words keep the white space around them; without, they are joined by one space.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    runs = repeated.distinct().groupBy("doc_id", "print").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    runs = runs.withColumnRenamed("doc_id", "_id").withColumnRenamed("print", "_print")
    keyed = docs.withColumn("_text_print", F.xxhash64("text"))
    joined = keyed.join(runs, (keyed["doc_id"] == runs["_id"]) & (keyed["_text_print"] == runs["_print"]), "left").select(docs["doc_id"], docs["text"], "_runs", *[docs[c].alias(f"_other_{c}") for c in others])
    kinds = ", ".join(["doc_id long, n_words long, n_removed long, kept string", *[f"`_other_{c}` {docs.schema[c].dataType.simpleString()}" for c in others]])
    return joined.mapInArrow(lean(_cut_batches(window, layout)), kinds)


def find_repeated(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, index: FingerprintIndex | None = None) -> DataFrame:
    """Feed documents in ascending id order, in batches of about equal size, to an index; returns their repeated runs."""
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark, fanout=fanout)
    cuts = (docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000).alias("b")).first()["b"] if batches > 1 else None) or []
    found, low = None, None
    for high in [*sorted(set(cuts)), None]:
        upto = docs if high is None else docs.where(F.col("doc_id") <= high)
        part = upto if low is None else upto.where(F.col("doc_id") > low)
        runs = repeated_runs(index, part, upto, window, gram)
        found = runs if found is None else found.unionByName(runs)
        index.compact()
        low = high
    return found


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = unclash(read_table(spark, sf_dir, "documents"), ["doc_id", "text"])
    out = cut_documents(docs, find_repeated(docs), layout=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
