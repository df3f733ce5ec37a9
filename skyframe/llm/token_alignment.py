"""Which tokens of one tokenizer cover which of another: merge_asof on byte offsets, in both directions.

Both sides' tokens of a batch of documents are laid out by byte offset. ``pandas.merge_asof``, keyed by document, gives
each token the other side's token that covers its first byte; what either direction finds is exactly the pairs of tokens
whose byte ranges overlap. Pairs that end together are links; they cut a document into groups, the smallest pieces that
both sides cover with whole tokens.

Work: each text is encoded once on each side, in Arrow batches; within a batch in chunks of about half a megabyte or
one document. A document's links are stored as numbers of id pairs. Tokens that end together are such that one's bytes
end in the other's, so all pairs that can be linked follow from the vocabularies (:func:`linkable`): about half a million
for vocabularies of 82,000 entries, whatever the corpus. Their counts are therefore small enough for every task, and each
task adds up its own before they are shuffled.

Defined cases: a null or empty text, and one whose tokens' bytes on either side aren't the text with a space before
it, has no tokens, hence zeros and an empty text of groups; special tokens' strings in a text are plain text; null ids
and repeated rows are documents of their own, each counted; an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import bpe_tables
from skyframe.llm.common import lean, read_table, stored, unclash
from skyframe.llm.pretokens import PieceEncoder, PrefixedEncoder
from skyframe.llm.textkernel import chunks

#: A pair of ids is one number: the first side's id, this many bits up, and the second side's.
SECOND = 24


def default_model() -> str:
    """Path of the sentencepiece model of 32,000 pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level_entries(vocabulary: str) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary, by id."""
    tables = bpe_tables.load(vocabulary)
    found = tables["by_id"] | {i: text.encode() for text, i in tables["special"].items()}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def piece_entries(names: list[str]) -> list[bytes]:
    """Bytes of sentencepiece pieces: U+2581 is a space, <0xHH> a byte."""
    one = re.compile("<0x([0-9A-Fa-f]{2})>")
    return [bytes([int(m[1], 16)]) if (m := one.fullmatch(name)) else name.replace("▁", " ").encode() for name in names]


def linkable(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Sorted pairs of ids, as numbers, of which one's bytes end in the other's."""
    by_first, by_second, out = defaultdict(list), defaultdict(list), []
    for known, entries in ((by_first, first), (by_second, second)):
        for i, raw in enumerate(entries):
            known[raw].append(i)
    for i, raw in enumerate(first):
        out += [(i << SECOND) | j for k in range(len(raw)) for j in by_second.get(raw[k:], ())]
    for j, raw in enumerate(second):
        out += [(i << SECOND) | j for k in range(1, len(raw)) for i in by_first.get(raw[k:], ())]
    return np.array(sorted(out), np.int64)


class Side:
    """One tokenizer's tokens of a chunk."""

    def __init__(self, encoder: PieceEncoder, entries: list[bytes]):
        self.encoder, self.entries = encoder, entries
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bounds of documents among them, whether a document's joined bytes are its text)."""
        ids, bounds = self.encoder._chunk(data, offsets)
        joined = b"".join(map(self.entries.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds].tolist()
        raw, at = data.tobytes(), offsets.tolist()
        same = [raw[at[k] : at[k + 1]] == joined[ends[k] : ends[k + 1]] for k in range(len(at) - 1)]
        return ids, bounds, np.array(same, bool)


def overlaps(first: pd.DataFrame, second: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of overlapping tokens of two tables (doc, start), in order of start, without gaps in a document."""
    near = lambda a, b: pd.merge_asof(a, b.assign(other=np.arange(len(b))), on="start", by="doc")["other"].to_numpy(np.int64)
    over_first, over_second = near(first, second), near(second, first)
    # Pairs with equal starts are found in both directions and taken from one.
    late = second["start"].to_numpy() > first["start"].to_numpy()[over_second]
    return np.concatenate([np.arange(len(first)), over_second[late]]), np.concatenate([over_first, np.flatnonzero(late)])


class Alignment:
    """Tokens of both sides of a chunk, the overlapping pairs and those that end together."""

    def __init__(self, a: Side, b: Side, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        # An empty text is a lone space here.
        full = size > 1
        (ids_a, bounds_a, same_a), (ids_b, bounds_b, same_b) = a.tokens(data, offsets), b.tokens(data, offsets)
        self.good = full & same_a & same_b
        self.ids, self.docs, self.starts, self.ends = [], [], [], []
        for side, ids, bounds in ((a, ids_a, bounds_a), (b, ids_b, bounds_b)):
            doc = np.repeat(np.arange(len(size)), np.diff(bounds))
            stay = self.good[doc]
            ids, doc = ids[stay], doc[stay]
            # Documents that stay are laid end to end, on both sides alike.
            end = np.cumsum(side.sizes[ids])
            self.ids.append(ids.astype(np.int64))
            self.docs.append(doc)
            self.ends.append(end)
            self.starts.append(end - side.sizes[ids])
        self.pairs = overlaps(*[pd.DataFrame({"start": s, "doc": d}) for s, d in zip(self.starts, self.docs, strict=True)])
        i, j = self.pairs
        together = self.ends[0][i] == self.ends[1][j]
        order = np.argsort(i[together], kind="stable")
        self.links = i[together][order], j[together][order]

    def counts(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=len(self.good))


class Aligner:
    """Both tokenizers; keep one per Python worker."""

    def __init__(self, vocabulary: str, model: str):
        pieces = PrefixedEncoder(model)
        self.a = Side(PieceEncoder(vocabulary, plain_special=True), byte_level_entries(vocabulary))
        self.b = Side(pieces, piece_entries(pieces.names))
        self.linkable = linkable(self.a.entries, self.b.entries)
        shown = lambda side, end: [b"%d%s" % (i, end) for i in range(len(side.entries))]
        self.shown = np.array([*shown(self.a, b","), *shown(self.a, b"|"), *shown(self.b, b","), *shown(self.b, b";")], object)

    def clear(self) -> None:
        self.a.encoder.clear()
        self.b.encoder.clear()

    def align(self, column: pa.Array) -> Iterator[tuple[int, Alignment]]:
        for first, _, data, offsets in chunks(column):
            yield first, Alignment(self.a, self.b, data, offsets)

    def groups(self, found: Alignment) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``: ids of both sides in order."""
        i, j = found.links
        na, nb = len(found.ids[0]), len(found.ids[1])
        last_a, last_b = np.zeros(na, bool), np.zeros(nb, bool)
        last_a[i], last_b[j] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate([[0], j + 1])  # tokens of the second side in earlier groups
        stream = np.empty(na + nb, np.int64)
        wide_a, wide_b = len(self.a.entries), len(self.b.entries)
        stream[np.arange(na) + before_b[group_a]] = found.ids[0] + wide_a * last_a
        stream[np.arange(nb) + (i + 1)[group_b]] = found.ids[1] + wide_b * last_b + 2 * wide_a
        shown, at = self.shown[stream].tolist(), np.concatenate([[0], np.cumsum(found.counts(found.docs[0]) + found.counts(found.docs[1]))]).tolist()
        return [b"".join(shown[x:y])[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]

    def codes(self, found: Alignment) -> np.ndarray:
        """Places in ``linkable`` of the links."""
        i, j = found.links
        return np.searchsorted(self.linkable, (found.ids[0][i] << SECOND) | found.ids[1][j]).astype("<i4")


@lru_cache(maxsize=1)
def _aligner(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


def _align(vocabulary: str, model: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary, model)
        for batch in batches:
            for first, found in aligner.align(batch.column(1)):
                n = len(found.good)
                n_links = found.counts(found.docs[0][found.links[0]])
                codes, at = aligner.codes(found), np.concatenate([[0], np.cumsum(n_links)]).tolist()
                links = [codes[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                counts = [pa.array(x, pa.int64()) for x in (found.counts(found.docs[0]), found.counts(found.docs[1]), n_links)]
                groups = pa.array(aligner.groups(found), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *counts, groups, pa.array(links, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return run


def _spaced(docs: DataFrame) -> DataFrame:
    return unclash(docs, ["doc_id", "text"]).select("doc_id", F.concat(F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def align_documents(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (as text) and links (packed numbers of linked id pairs) of every document."""
    vocabulary, model = vocabulary or bpe_tables.default_vocabulary(), model or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _spaced(docs).mapInArrow(lean(_align(vocabulary, model), lambda: _aligner(vocabulary, model).clear()), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links binary")


def overlapping_tokens(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """(doc_id, a_pos, a_id, b_pos, b_id, linked) of all pairs of tokens whose bytes overlap; linked ones end together."""
    vocabulary, model = vocabulary or bpe_tables.default_vocabulary(), model or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary, model)
        for batch in batches:
            for first, found in aligner.align(batch.column(1)):
                (i, j), (docs_a, docs_b) = found.pairs, found.docs
                begin = [np.concatenate([[0], np.cumsum(found.counts(d))]) for d in (docs_a, docs_b)]
                doc = docs_a[i]
                columns = [i - begin[0][doc], found.ids[0][i], j - begin[1][doc], found.ids[1][j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first).take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in columns], pa.array(found.ends[0][i] == found.ends[1][j])], ["doc_id", "a_pos", "a_id", "b_pos", "b_id", "linked"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _spaced(docs).mapInArrow(lean(run, lambda: _aligner(vocabulary, model).clear()), f"doc_id {kind}, a_pos long, a_id long, b_pos long, b_id long, linked boolean")


def _count(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            packed = b"".join(x for x in batch.column(0).to_pylist() if x)
            total += np.bincount(np.frombuffer(packed, "<i4"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["code", "n"])

    return run


def link_counts(aligned: DataFrame, pairs: np.ndarray) -> np.ndarray:
    """How many links of the corpus hold each linkable pair: one number for each, at most len(pairs) rows reach the driver."""
    found = aligned.select("links").mapInArrow(lean(_count(len(pairs))), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[found["code"].to_numpy()] = found["n"].to_numpy()
    return counts


def with_link_counts(aligned: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Aligned documents with n_best (links whose pair's count is the highest of its second id) and count_sum for ``links``."""
    spark = aligned.sparkSession
    pieces = PrefixedEncoder(model or default_model())
    pairs = linkable(byte_level_entries(vocabulary or bpe_tables.default_vocabulary()), piece_entries(pieces.names))
    counts, second = link_counts(aligned, pairs), pairs & ((1 << SECOND) - 1)
    highest = np.zeros(len(pieces.names), np.int64)
    np.maximum.at(highest, second, counts)
    # One count and one flag for each linkable pair: a size that the vocabularies bound.
    known = spark.sparkContext.broadcast((counts, counts == highest[second]))
    kept = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = known.value
        for batch in batches:
            codes = [np.frombuffer(x.as_py() or b"", "<i4") for x in batch.column("links")]
            figures = [[int(best[c].sum()) for c in codes], [int(counts[c].sum()) for c in codes]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(x, pa.int64()) for x in figures]], [*kept, "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    return aligned.mapInArrow(lean(run), f"{kinds}, n_best long, count_sum long")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(read_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    aligned = stored(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"), "aligned")
    return with_link_counts(aligned).select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
