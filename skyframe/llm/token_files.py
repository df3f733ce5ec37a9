"""Token ids in binary files: independent zstandard frames with a trailing seek table.

A file holds consecutive documents in ascending doc_id order. Each frame is one document's token ids as little-endian
unsigned 32-bit integers; the last frame lists the documents (validity bytes, then ids as 64-bit integers). The file ends with
a skippable frame that gives each frame's compressed size, size and xxHash64 checksum (low 32 bits), as in the public
zstandard seekable format, so a reader finds, decompresses and checks just the documents asked for.

Work: texts are encoded where they are read; only compressed frames are shuffled, to the range that their id falls in
(bounds are quantiles of the id, so ranges are about equal). There are MAX_RANGES ranges at most, whatever the input,
and a task writes its range as files of ``docs_per_file`` documents, so neither bounds nor shuffle partitions grow with
the number of files. An id that many rows share takes several ranges, as do rows without an id. Each task writes its
files under names of its own, so a retried task leaves nothing wrong, and the manifest lists the files of the attempts
that counted. Frames are written as they come; a writer holds the sizes of one file's frames. Files are read back by
as many tasks as there are files, up to 20,000.

Defined cases: a null or empty text gives just the end id; null doc_ids come first; rows with equal doc_ids are all
kept, one after another; an empty table gives no file and an empty result; other columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.bpe_tables import default_vocabulary
from skyframe.llm.common import fresh_path, read_table, stored, unclash

#: Ranges of ids, so also the shuffle's partitions and the bounds in each task.
MAX_RANGES = 4096
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenWriter:
    """Writes one file frame by frame."""

    def __init__(self, uri: str, level: int = 3):
        where, path = pafs.FileSystem.from_uri(uri)
        self.out, self.level = where.open_output_stream(path, compression=None), level
        self.doc_ids: list[int | None] = []
        self.table: list[bytes] = []

    def add(self, doc_id: int | None, frame: bytes, size: int, checksum: int) -> None:
        self.doc_ids.append(doc_id)
        self._frame(frame, size, checksum)

    def _frame(self, frame: bytes, size: int, checksum: int) -> None:
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), size, checksum))

    def close(self) -> None:
        names = bytes(d is not None for d in self.doc_ids) + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
        self._frame(zstandard.ZstdCompressor(level=self.level).compress(names), len(names), _checksum(names))
        table = b"".join(self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE))
        self.out.close()


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        where, path = pafs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError(f"{uri} has no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        raw, docs = self.frame(n - 1), n - 1
        ids = np.frombuffer(raw[docs:], "<i8").tolist()
        self.doc_ids = [d if ok else None for d, ok in zip(ids, raw[:docs], strict=True)]
        self.lengths = self.table[:-1, 1] // 4

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.table[k, 0]), int(self.at[k])), max_output_size=int(self.table[k, 1]))
        if _checksum(raw) != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def ids(self, position: int) -> np.ndarray:
        """Token ids of the document at a position of this file."""
        return np.frombuffer(self.frame(position), "<u4")


def ranges_of(ids: np.ndarray, known: np.ndarray, bounds: np.ndarray, n_null: int, row: int) -> np.ndarray:
    """The range of each row; ``row`` is the first row's number in its task.

    Ranges 0 to n_null - 1 hold rows without an id. A bound that comes k times is an id with many rows, which takes k
    ranges in turn: the first of them also holds smaller ids, the others nothing else.
    """
    first, last = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    at = row + np.arange(len(ids))
    return np.where(known, n_null + first + at % np.maximum(last - first, 1), at % max(n_null, 1))


def _encode(vocabulary: str, end_id: int, bounds: list[int], n_null: int, level: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skyframe.llm.pretokens import worker_encoder

        encoder, packer, limits, row = worker_encoder(vocabulary), zstandard.ZstdCompressor(level=level), np.array(bounds, np.int64), 0
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, offsets in encoder.encode(batch.column(1)):
                ids = ids.astype("<u4")
                frames, sizes, sums, crcs = [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    raw = ids[a:b].tobytes() + struct.pack("<I", end_id)
                    frames.append(packer.compress(raw))
                    sizes.append(len(raw))
                    sums.append(_checksum(raw))
                    crcs.append(zlib.crc32(raw))
                own = doc_ids.slice(first, len(frames))
                part = ranges_of(own.fill_null(0).to_numpy(False), own.is_valid().to_numpy(False), limits, n_null, row)
                row += len(frames)
                yield pa.RecordBatch.from_arrays([own, pa.array(part, pa.int32()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(crcs, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "part", "size", "sum", "crc", "frame"])

    return run


def _write(folder: str, docs_per_file: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        part, place, file, uri, n_ids = None, 0, None, "", 0

        def close():
            file.close()
            done.append((part, place, uri, len(file.doc_ids), n_ids))

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for doc, p, size, total, _, frame in zip(*cols, strict=True):
                if p != part or len(file.doc_ids) >= docs_per_file:
                    if file:
                        close()
                    part, place = p, place + 1 if p == part else 0
                    uri = f"{folder}/part-{p:08d}-{place:08d}-{uuid.uuid4().hex}.ids.zst"
                    file, n_ids = TokenWriter(uri), 0
                file.add(doc, frame, size, total)
                n_ids += size // 4
        if file:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else [[]] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "place", "uri", "n_docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, docs_per_file: int = 2048, level: int = 3) -> DataFrame:
    """Write token files; returns their manifest (part, place, uri, n_docs, n_ids, start), one row per file.

    Files in order of part and place hold the documents in ascending doc_id order; ``start`` counts the ids before a file.
    """
    spark = docs.sparkSession
    docs = unclash(docs, ["doc_id", "text"])
    n, n_known = docs.agg(F.count("*"), F.count("doc_id")).first()
    ranges = min(MAX_RANGES, n // docs_per_file + 1)
    n_null = -(-ranges * (n - n_known) // max(n, 1))
    cuts = [k / (ranges - n_null) for k in range(1, ranges - n_null)]
    bounds = sorted((docs.agg(F.percentile_approx("doc_id", cuts, 100 * ranges).alias("b")).first()["b"] if cuts else None) or [])
    folder = fresh_path(spark, "token-files")
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1])
    encoded = docs.mapInArrow(_encode(vocabulary or default_vocabulary(), end_id, bounds, n_null, level), "doc_id long, part int, size long, sum long, crc long, frame binary")
    dealt = encoded.repartition(ranges, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "size", "crc")
    manifest = stored(dealt.mapInArrow(_write(folder, docs_per_file), "part int, place int, uri string, n_docs long, n_ids long"), "token-manifest")
    # A row for each range, of which there are MAX_RANGES and one at most; then files within their range.
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("_sum"))
    before = sums.select("part", (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("place")) - F.col("n_ids")
    return manifest.withColumn("_within", within).join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("_within")).drop("_before", "_within")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = TokenFile(uri)
            crcs = [zlib.crc32(file.ids(k)) for k in range(len(file.doc_ids))]
            n = file.lengths.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    files = manifest.select("uri", "start")
    # An explicit count, so that adaptive execution doesn't merge these few and small rows, each a whole file, into one task.
    return files.repartition(max(1, min(manifest.count(), 20_000)), "uri").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents")))
