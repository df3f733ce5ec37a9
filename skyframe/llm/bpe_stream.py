"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

Encoding. Text arrives in blocks. The split into pieces needs three characters of lookahead; within a piece, tokens are
emitted once no text to come can change them. How far ahead that is follows from the merge list alone: text to come can
undo or add a merge m only if it undoes or adds an earlier merge s that starts where m ends (m's right part is s's left
part or s's result), so the reach of a change is the heaviest chain of such merges, which :func:`lookahead` computes in
one pass over the list in rank order. A cut at a token boundary never changes what follows it, so the encoder keeps just
the bytes after the last stable token. Every piece goes this way: whole pieces of a block are closed at once, with the
transducer's output for pieces that come again held in a bounded memo, and the piece that a block ends in is fed as far
as it is settled. Memory is constant besides the ids put out: a block, a window of a few lookaheads, the memo. Texts are
read from Arrow's bytes block by block.

Decoding. Ids become bytes by table, bytes become text by a state machine that holds at most three bytes of an
unfinished character; wrong bytes become U+FFFD, one for each longest wrong prefix.

Defined cases: a null or empty text has no ids and decodes to the empty text; strings of special tokens become their id
wherever they stand; repeated rows and null ids are kept as they are; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import bpe_tables
from skyframe.llm.common import lean, read_table, unclash

#: Fixed value: the pattern that splits text into pieces for byte-level vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Classes of characters that one piece can run over, as patterns.
RUNS = {"letter": r"\p{L}+", "number": r"\p{N}+", "other": r"[^\s\p{L}\p{N}]+", "space": r"\s+"}
MARGIN, BLOCK, MAX_CACHED, MAX_CACHED_PIECE = 3, 1 << 16, 1 << 17, 64


def lookahead(tables: dict) -> int:
    """Bytes after a token's end within which text to come can still change it."""
    size = {i: len(b) for i, b in tables["by_id"].items()}
    reach_of: dict[int, int] = {}  # by token: the heaviest chain among earlier merges that begin with it or result in it
    most = 0
    for left, right, result in tables["merges"]:
        reach = size[left] + reach_of.get(right, 0)
        most = max(most, reach)
        for token in (left, result):
            if reach > reach_of.get(token, 0):
                reach_of[token] = reach
    return most + max(size.values())


NEVER = 1 << 60


class Merger:
    """Merges of a window of bytes; :meth:`short` and :meth:`long` give the same, each for the sizes where it is fast."""

    def __init__(self, tables: dict):
        self.single = tables["bytes"]
        self.rank = {(a << 20) | b: (k << 20) | c for k, (a, b, c) in enumerate(tables["merges"])}

    def merge(self, piece: bytes) -> list[int]:
        return self.short(piece) if len(piece) <= MAX_CACHED_PIECE else self.long(piece)

    def short(self, piece: bytes) -> list[int]:
        """Least rank first, leftmost at a tie; for pieces of a few dozen bytes."""
        ids, rank = [self.single[b] for b in piece], self.rank.get
        ranks = [rank((a << 20) | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            k = ranks.index(best)
            ids[k] = best & 0xFFFFF
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank((ids[k] << 20) | ids[k + 1], NEVER)
            if k:
                ranks[k - 1] = rank((ids[k - 1] << 20) | ids[k], NEVER)
        return ids

    def long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list: n log n."""
        ids, rank, n = [self.single[b] for b in piece], self.rank.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r >> 20, k, ids[k], ids[k + 1], r & 0xFFFFF) for k in range(n - 1) if (r := rank((ids[k] << 20) | ids[k + 1])) is not None]
        heapify(heap)
        while heap:
            _, k, a, b, result = heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = result, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := rank((ids[x] << 20) | ids[y])) is not None:
                    heappush(heap, (r >> 20, x, ids[x], ids[y], r & 0xFFFFF))
        return [i for i in ids if i >= 0]


class StreamEncoder:
    """Feed text in blocks of any size; get ids, as packed little-endian unsigned 32-bit integers, once stable."""

    def __init__(self, tables: dict):
        self.tables, self.merger = tables, Merger(tables)
        self.size = {i: len(b) for i, b in tables["by_id"].items()}
        self.ahead = lookahead(tables)
        self.window = max(4 * self.ahead, 4096)
        self.split = regex.compile(PIECES).findall
        self.runs = {k: regex.compile(v) for k, v in RUNS.items()}
        special = sorted(tables["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.held = max(map(len, special), default=1) - 1
        self.known: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.waiting, self.text, self.run, self.tail = "", "", "", b""

    # Special tokens: their strings cut the text; what lies between is encoded on its own.
    def feed(self, block: str) -> bytes:
        if not self.special:
            return self._ordinary(block)
        self.waiting += block
        out = []
        while found := self.special.search(self.waiting):
            out += [self._ordinary(self.waiting[: found.start()]), self._finish_text(), self._pack([self.tables["special"][found[0]]])]
            self.waiting = self.waiting[found.end() :]
        ready = max(0, len(self.waiting) - self.held)
        out.append(self._ordinary(self.waiting[:ready]))
        self.waiting = self.waiting[ready:]
        return b"".join(out)

    def finish(self) -> bytes:
        out = self._ordinary(self.waiting) + self._finish_text()
        self.reset()
        return out

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, pieces: list[str]) -> bytes:
        got = list(map(self.known.get, pieces))
        for k in [k for k, packed in enumerate(got) if packed is None]:
            got[k] = self._piece(pieces[k])
        return b"".join(got)

    def _piece(self, piece: str) -> bytes:
        """A whole piece: the transducer's output, closed at the piece's end."""
        packed = self.known.get(piece)
        if packed is None:
            packed = self._run_bytes(piece.encode(), True)
            if len(piece) <= MAX_CACHED_PIECE:
                if len(self.known) >= MAX_CACHED:
                    self.known.clear()
                self.known[piece] = packed
        return packed

    def _ordinary(self, block: str) -> bytes:
        """Stable ids of ordinary text."""
        self.text += block
        out = self._go_on_with_run() if self.run else b""
        if self.run or len(self.text) <= MARGIN:
            return out
        pieces, kept = self.split(self.text), 0
        while pieces and kept < MARGIN:
            kept += len(pieces.pop())
        out += self._pieces(pieces)
        self.text = self.text[len(self.text) - kept :]
        if len(self.text) > MARGIN + 2:  # the kind of the open piece is settled: it is encoded as it comes
            self.run = next((k for k, p in self.runs.items() if p.fullmatch(self.text[1:-MARGIN])), "")
            if self.run:
                out += self._go_on_with_run(first=1)
        return out

    def _go_on_with_run(self, first: int = 0) -> bytes:
        found = self.runs[self.run].match(self.text, first)
        end = found.end() if found else first
        over = end < len(self.text)
        if self.run == "space":
            end = max(0, end - 1)  # the last space of a run may belong to the next piece
        out = self._run_bytes(self.text[:end].encode(), False)
        self.text = self.text[end:]
        if over:
            out += self._run_bytes(b"", True)
            self.run = ""
        return out

    def _run_bytes(self, raw: bytes, last: bool) -> bytes:
        """Stable tokens of the open piece so far: those that end more than the lookahead before its end, or all at its end."""
        self.tail += raw
        out = []
        while len(self.tail) >= self.window or last and self.tail:
            part = self.tail[: self.window]
            closing = last and len(part) == len(self.tail)
            ids, at = self.merger.merge(part), 0
            if closing:
                out += ids
                self.tail = b""
                break
            for i in ids:
                if at + self.size[i] > len(part) - self.ahead:
                    break
                at += self.size[i]
                out.append(i)
            self.tail = self.tail[at:]
        return self._pack(out)

    def _finish_text(self) -> bytes:
        out = b""
        if self.run:
            out = self._run_bytes(self.text.encode() if self.run == "space" else b"", True)
            self.text = "" if self.run == "space" else self.text
            self.run = ""
        out += self._pieces(self.split(self.text))
        self.text = ""
        return out

    def encode(self, raw: memoryview | bytes) -> bytes:
        """Ids of a text given as UTF-8, block by block."""
        letters = codecs.getincrementaldecoder("utf-8")()
        out = [self.feed(letters.decode(raw[k : k + BLOCK])) for k in range(0, len(raw), BLOCK)]
        return b"".join([*out, self.finish()])


class StreamDecoder:
    """Ids in, text out; an unfinished character waits for its bytes."""

    def __init__(self, tables: dict):
        most = max([*tables["by_id"], *tables["special"].values()])
        self.bytes = [tables["by_id"].get(i, b"") for i in range(most + 1)]
        for text, i in tables["special"].items():
            self.bytes[i] = text.encode()
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)), last)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        out = [self.feed(ids[k : k + BLOCK].tolist()) for k in range(0, len(ids), BLOCK)]
        out.append(self.feed([], True))
        self.state.reset()
        return "".join(out)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> StreamEncoder:
    return StreamEncoder(bpe_tables.load(vocabulary))


@lru_cache(maxsize=1)
def _decoder(vocabulary: str) -> StreamDecoder:
    return StreamDecoder(bpe_tables.load(vocabulary))


OUT_BYTES = 1 << 22


def _encode_batches(vocabulary: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode
        for batch in batches:
            docs, texts, first, out, size = batch.column(0), batch.column(1), 0, [], 0
            for k in range(len(texts)):
                out.append(encode(memoryview(texts[k].as_buffer()) if texts[k].is_valid else b""))
                size += len(out[-1])
                if size > OUT_BYTES or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([docs.slice(first, len(out)), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])
                    first, out, size = k + 1, [], 0

    return run


def _decode_batches(vocabulary: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(vocabulary).decode
        for batch in batches:
            ids = batch.column(2)
            for first in range(0, len(ids), 256):
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([decode(x.as_py() or b"") for x in part.column(2)], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian unsigned 32-bit integers) of every document."""
    vocabulary = vocabulary or bpe_tables.default_vocabulary()
    return unclash(docs, ["doc_id", "text"]).mapInArrow(lean(_encode_batches(vocabulary), lambda: _encoder(vocabulary).known.clear()), "doc_id long, n_tokens long, ids binary")


def decode_documents(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The encoded documents with their text as ``decoded``."""
    return unclash(tokens, ["doc_id", "n_tokens", "ids"]).mapInArrow(lean(_decode_batches(vocabulary or bpe_tables.default_vocabulary())), "doc_id long, n_tokens long, ids binary, decoded string")


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every document, both ways in the same Python worker."""
    vocabulary = vocabulary or bpe_tables.default_vocabulary()
    encode, decode = _encode_batches(vocabulary), _decode_batches(vocabulary)
    both = lean(lambda batches: decode(encode(batches)), lambda: _encoder(vocabulary).known.clear())
    return unclash(docs, ["doc_id", "text"]).mapInArrow(both, "doc_id long, n_tokens long, ids binary, decoded string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
