"""Scores by context-tree weighting over bytes.

A text is scored as its words, A-Z in lower case, joined by one space and closed by a line feed. Each byte is eight binary decisions
(high bit first); each decision has a tree over the preceding bytes, up to ``DEPTH``. A node of the tree holds the
Krichevsky-Trofimov estimate from its counts of zeros and ones; the weighted probability of a node is half its own
estimate plus half the product of its children's, so all depths are mixed, and the code length of a byte given the
training counts is the sum over its decisions of the mixed estimate along its path. Nodes never seen give one half.

At scale. Texts are dealt into units of bounded size where they are read; a unit's distinct words and (context, byte) runs
are its lookups, with their counts in training documents (0 in the others). Counts are summed over units. Trees are
built from runs with the same last ``SPLIT`` context bytes, bottom-up; the levels above are aggregates, and the way down
is one join a level. So every run that any text has gets its log probability, also those without a training count: their
nodes weigh nothing and change no other. Lookups meet these values in a join on the run, go back to their unit, and the
unit's texts are scored behind them. Each text is read twice however large the model is, a task holds one unit's table
or one group of runs, and the rows that share a key are one a unit at most.

Defined cases: a null text counts as empty; an empty text has its end token only; a document with a null id is scored and
trained on like others; repeated rows are scored alike and each keeps a row; a null condition counts as false; without
training documents every byte costs eight bits and the base score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import lean, read_table, stored, unclash
from skyframe.llm.textkernel import Words, chunks

DEPTH, SPLIT = 5, 3
#: A unit of texts ends with its task, or where it has so many distinct runs and words or so many bytes.
UNIT_KEYS, UNIT_BYTES = 1 << 21, 1 << 28
#: Runs that are made into trees together, unless one context of SPLIT bytes alone has more.
GROUP_ROWS = 1 << 17
END = 10
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that are scored, each document preceded by DEPTH ends, and where documents start in them."""
    docs = len(words.offsets) - 1
    sizes = words.ends - words.starts
    n_words = np.diff(words.bounds)
    # Each word takes a separator; a document without words still has its end.
    ahead = np.concatenate([[0], np.cumsum(sizes + 1)])
    length = ahead[words.bounds[1:]] - ahead[words.bounds[:-1]] + (n_words == 0)
    begins = np.concatenate([[0], np.cumsum(length + DEPTH)])
    out = np.full(begins[-1], END, np.uint8)
    doc = np.repeat(np.arange(docs), n_words)
    at = begins[:-1][doc] + DEPTH + ahead[:-1] - ahead[words.bounds[:-1]][doc]
    total = int(sizes.sum())
    step = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(at, sizes) + step] = _LOWER[words.data[np.repeat(words.starts, sizes) + step]]
    inner = np.ones(len(at), bool)
    inner[words.bounds[1:][n_words > 0] - 1] = False
    out[(at + sizes)[inner]] = 32
    return out, begins


def gram_keys(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DEPTH context bytes and the byte, packed, for every scored position; and the first position of each document."""
    key = np.zeros(max(0, len(data) - DEPTH), _U)
    for k in range(DEPTH + 1):
        key <<= _U(8)
        key |= data[k : len(data) - DEPTH + k]
    keep = np.ones(len(key), bool)
    for k in range(DEPTH):  # positions whose byte is padding
        pad = begins[1:-1] - DEPTH + k
        keep[pad[pad < len(key)]] = False
    return key[keep], begins - DEPTH * np.arange(len(begins))


def word_keys(words: Words) -> np.ndarray:
    """Hashes of words, with the highest bit set: runs of bytes don't have it."""
    return (words.hashes(lower=True) >> _U(1)) | _U(1 << 63)


class Tally:
    """Distinct keys with their counts, merged whenever as many again have come in."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held, self.waiting = np.empty(0, _U), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, training: bool) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.held.append((found, counts if training else np.zeros(len(found), np.int64)))
        self.waiting += len(found)
        if self.waiting > max(500_000, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.held]])
        counts = np.concatenate([self.counts, *[n for _, n in self.held]])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
        self.keys, self.counts = keys[fresh], np.add.reduceat(counts, fresh) if len(keys) else counts
        self.held, self.waiting = [], 0


_UNIT_NAMES = ["unit", "doc_id", "held_out", "text", "keys", "counts"]
_UNIT_KINDS = "unit long, doc_id long, held_out boolean, text string, keys array<long>, counts array<long>"


def _unit_batches(unit_keys: int):
    """The documents with the number of their unit, and behind them the unit's keys and counts in lists."""

    def lists(unit: int, tally: Tally) -> Iterator[pa.RecordBatch]:
        tally.merge()
        for k in range(0, len(tally.keys), 1 << 18):
            keys, counts = tally.keys[k : k + (1 << 18)].view(np.int64), tally.counts[k : k + (1 << 18)]
            offsets = pa.array(np.append(np.arange(0, len(keys), 4096), len(keys)).astype(np.int32))
            n = len(offsets) - 1
            none = [pa.nulls(n, kind) for kind in (pa.int64(), pa.bool_(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, unit)), *none, pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(counts))], _UNIT_NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, tally, size = uuid.uuid4().int >> 65, Tally(), 0
        for one in batches:
            held_out = one.column(1).to_numpy(zero_copy_only=False)
            for start, end, data, offsets in chunks(one.column(2)):
                words = Words(data, offsets)
                scored, begins = canonical(words)
                grams, firsts = gram_keys(scored, begins)
                held = held_out[start:end]
                of_words, of_grams = np.repeat(held, np.diff(words.bounds)), np.repeat(held, np.diff(firsts))
                every = word_keys(words)
                for out in (False, True):
                    if (held == out).any():
                        tally.add(np.concatenate([every[of_words == out], grams[of_grams == out]]), not out)
                size += len(data)
            n = one.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, unit)), *one.columns, *[pa.nulls(n, pa.list_(pa.int64()))] * 2], _UNIT_NAMES)
            if size >= UNIT_BYTES or len(tally.keys) + tally.waiting >= unit_keys:
                tally.merge()
                if size >= UNIT_BYTES or len(tally.keys) >= unit_keys:
                    yield from lists(unit, tally)
                    unit, tally, size = uuid.uuid4().int >> 65, Tally(), 0
        yield from lists(unit, tally)

    return run


# --- the weighted trees -------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series after a shift."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _mask(nbytes: int) -> np.uint64:
    return _U((1 << (8 * nbytes)) - 1)


def decisions(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context of ``depth`` bytes, then the bits so far behind a leading one), sorted, with their zeros and ones."""
    short = keys & _mask(depth + 1)
    byte, context = short & _U(255), short >> _U(8)
    node, bit = [], []
    for b in range(8):
        node.append((context << _U(8)) | _U(1 << b) | (byte >> _U(8 - b)))
        bit.append((byte >> _U(7 - b)) & _U(1))
    nodes, inverse = np.unique(np.concatenate(node), return_inverse=True)
    ones = np.bincount(inverse, weights=np.concatenate(bit) * np.tile(counts, 8), minlength=len(nodes))
    return nodes, np.bincount(inverse, weights=np.tile(counts, 8), minlength=len(nodes)) - ones, ones


def parents(nodes: np.ndarray, depth: int, above: np.ndarray) -> np.ndarray:
    """Index in ``above`` of each node's parent, one context byte shorter."""
    return np.searchsorted(above, (((nodes >> _U(8)) & _mask(depth - 1)) << _U(8)) | (nodes & _U(255)))


class Level:
    """Nodes of one depth: counts, own log estimate and log weighted probability."""

    def __init__(self, depth: int, nodes, zeros, ones, weighted=None):
        self.depth, self.nodes, self.zeros, self.ones = depth, nodes, zeros, ones
        self.own = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)
        self.weighted = self.own if weighted is None else weighted

    def weigh(self, below: Level) -> None:
        self.up = parents(below.nodes, below.depth, self.nodes)
        children = np.bincount(self.up, weights=below.weighted, minlength=len(self.nodes))
        self.weighted = np.logaddexp(self.own, children) + np.log(0.5)

    def mix(self, sure: np.ndarray, rest: np.ndarray, deepest: bool) -> tuple[np.ndarray, np.ndarray]:
        """From the parents' mixed probability of a one and the weight left for deeper nodes to this depth's."""
        stay = np.ones(len(self.nodes)) if deepest else np.exp(np.log(0.5) + self.own - self.weighted)
        return sure + rest * stay * (self.ones + 0.5) / (self.zeros + self.ones + 1), rest * (1 - stay)


def build_levels(keys: np.ndarray, counts: np.ndarray, top: int) -> list[Level]:
    """Levels ``top``..DEPTH, weighed bottom-up."""
    levels = [Level(d, *decisions(keys, counts, d)) for d in range(top, DEPTH + 1)]
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        upper.weigh(lower)
    return levels


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``part``, several whole parts at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < GROUP_ROWS:
            continue
        table = pa.Table.from_batches(held)
        part = table["part"].to_numpy()
        cut = int(np.searchsorted(part, part[-1]))
        if cut:
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), len(part) - cut
    if n:
        yield pa.Table.from_batches(held)


def _weigh_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth SPLIT with their counts and log weighted probability."""
    for table in _groups(batches):
        low = build_levels(table["key"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(float), SPLIT)[0]
        yield pa.RecordBatch.from_arrays([pa.array(low.nodes.view(np.int64)), pa.array(low.zeros), pa.array(low.ones), pa.array(low.weighted)], ["node", "zeros", "ones", "weighted"])


def _value_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 probability of each run, from the mixture at depth SPLIT (rows with ``sure``) and the runs below it."""
    for table in _groups(batches):
        key, sure = table["key"].to_numpy().view(np.uint64), table["sure"].to_numpy()
        run = np.isnan(sure)
        order = np.flatnonzero(~run)[np.argsort(key[~run])]
        above, sure, rest = key[order], sure[order], table["rest"].to_numpy()[order]
        keys, counts = key[run], table["n"].to_numpy()[run].astype(float)
        for level in build_levels(keys, counts, SPLIT + 1):
            up = parents(level.nodes, level.depth, above)
            sure, rest = level.mix(sure[up], rest[up], level.depth == DEPTH)
            above = level.nodes
        byte, total = keys & _U(255), np.zeros(len(keys))
        for b in range(8):
            q = sure[np.searchsorted(above, ((keys >> _U(8)) << _U(8)) | _U(1 << b) | (byte >> _U(8 - b)))]
            total += np.log10(np.where((byte >> _U(7 - b)) & _U(1), q, 1 - q))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["key", "value"])


def _log_gamma(x: Column) -> Column:
    """:func:`log_gamma` as an expression."""
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - F.log(product)


def _own() -> Column:
    zeros, ones = F.col("zeros"), F.col("ones")
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - float(np.log(np.pi))


def _parent(depth: int) -> Column:
    """The node one context byte shorter than ``node`` of a depth."""
    return F.shiftleft(F.shiftright("node", 8).bitwiseAND((1 << (8 * (depth - 1))) - 1), 8).bitwiseOR(F.col("node").bitwiseAND(255))


def _weigh_above(level: DataFrame, depth: int) -> DataFrame:
    """The level above one of a depth. A node has 256 children at most."""
    sums = level.groupBy(_parent(depth).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("_below"))
    own = sums.withColumn("_own", _own())
    both = F.greatest("_own", "_below") + F.log1p(F.exp(-F.abs(F.col("_own") - F.col("_below"))))
    return own.select("node", "zeros", "ones", (both + float(np.log(0.5))).alias("weighted"))


def _mix_below(above: DataFrame | None, level: DataFrame, depth: int) -> DataFrame:
    """(node, sure, rest): the mixed probability of a one down to this depth, and the weight left for deeper nodes."""
    stay = F.exp(float(np.log(0.5)) + _own() - F.col("weighted"))
    rows = level.select("node", stay.alias("_stay"), ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("_one"))
    if above is None:
        return rows.select("node", (F.col("_stay") * F.col("_one")).alias("sure"), (1 - F.col("_stay")).alias("rest"))
    joined = rows.withColumn("_up", _parent(depth)).join(above.select(F.col("node").alias("_up"), "sure", "rest"), "_up")
    return joined.select("node", (F.col("sure") + F.col("rest") * F.col("_stay") * F.col("_one")).alias("sure"), (F.col("rest") * (1 - F.col("_stay"))).alias("rest"))


def run_values(grams: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of each run of ``grams`` (key, n) by its byte, under the tree of all of them."""
    part = lambda column: F.shiftright(column, 8).bitwiseAND((1 << (8 * SPLIT)) - 1).cast("int").alias("part")
    rows = grams.select(part("key"), "key", "n")
    levels = {SPLIT: stored(rows.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_weigh_batches), "node long, zeros double, ones double, weighted double"), "tree-level")}
    for depth in range(SPLIT, 0, -1):
        above = _weigh_above(levels[depth], depth)
        levels[depth - 1] = stored(above, "tree-level")
    mixed = None
    for depth in range(SPLIT + 1):
        mixed = _mix_below(mixed, levels[depth], depth)
    tops = mixed.select(part("node"), F.col("node").alias("key"), F.lit(0).cast("long").alias("n"), "sure", "rest")
    nan = F.lit(float("nan"))
    both = tops.unionByName(rows.withColumn("sure", nan).withColumn("rest", nan))
    return both.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_value_batches), "key long, value double")


class Lookup:
    """Open addressing in numpy: keys to values, at most three quarters full. Keys go in by slices, so filling takes little besides the table."""

    SLICE = 1 << 18

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 // 3 + 1).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, values.dtype)
        self.used = np.zeros(1 << self.bits, bool)
        for k in range(0, len(keys), self.SLICE):
            self._put(keys[k : k + self.SLICE], values[k : k + self.SLICE])

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[slot[left]]]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.used[slot[put]] = True
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where there is none."""
        slot = self._slot(keys)
        found = self.used[slot] & (self.keys[slot] == keys)
        out = np.where(found, self.values[slot], 0)
        left = np.flatnonzero(~found & self.used[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            hit = self.used[slot[left]] & (self.keys[slot[left]] == keys[left])
            out[left[hit]], found[left[hit]] = self.values[slot[left[hit]]], True
            left = left[~hit & self.used[slot[left]]]
        return out


def _score_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of documents; of each unit, all lookups come before its documents."""
    current, held, table = None, [], None
    for batch in batches:
        units = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, units[1:] != units[:-1])) if len(units) else []
        for a, b in zip(edges, [*edges[1:], len(units)], strict=True):
            part = batch.slice(a, b - a)
            if units[a] != current:
                current, held, table = units[a], [], None
            n = len(part) - part.column(1).null_count
            if n:
                # Copies: a view would keep the whole batch.
                held.append((part.column(1).slice(0, n).to_numpy().view(np.uint64).copy(), part.column(2).slice(0, n).to_numpy().copy()))
            if n == len(part):
                continue
            if table is None:
                keys, values = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, _U), np.empty(0))
                held = []
                table = Lookup(keys, values)
                del keys, values
            docs = part.slice(n)
            for start, end, data, offsets in chunks(docs.column(5)):
                words, size = Words(data, offsets), end - start
                keys, firsts = gram_keys(*canonical(words))
                score = np.bincount(np.repeat(np.arange(size), np.diff(firsts)), weights=table.get(keys), minlength=size).astype(float)
                of = np.repeat(np.arange(size), np.diff(words.bounds))
                value = table.get(word_keys(words))
                base, known = np.bincount(of, weights=value, minlength=size).astype(float), np.bincount(of[value > 0], minlength=size)
                yield pa.RecordBatch.from_arrays([docs.column(3).slice(start, size), docs.column(4).slice(start, size), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(np.diff(firsts).astype(np.int64))], ["doc_id", "held_out", "words", "known", "base", "score", "n_bytes"])


def score_documents(docs: DataFrame, held_out: Column, unit_keys: int = UNIT_KEYS) -> DataFrame:
    """Scores of all documents by a model of those that ``held_out`` (a condition) leaves in.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte.
    """
    spark = docs.sparkSession
    docs = unclash(docs, ["doc_id", "text"]).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    # The more text a unit has, the fewer lookups a text needs: four tasks' splits are read as one while all cores stay busy.
    tasks = max(2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 4)
    units = stored(docs.coalesce(tasks).mapInArrow(lean(_unit_batches(unit_keys)), _UNIT_KINDS), "units")
    lookups = units.where("keys IS NOT NULL").select("unit", F.explode(F.arrays_zip("keys", "counts")).alias("k")).select("unit", F.col("k.keys").alias("key"), F.col("k.counts").alias("n"))
    counts = stored(lookups.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("key < 0")
    texts = units.where("keys IS NULL").select("unit", "doc_id", "held_out", "text")
    n_docs = texts.where("NOT held_out").count()
    seen = words.agg(F.count_if(F.col("n") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tokens, distinct = seen["n"] + n_docs, seen["v"] + (n_docs > 0)

    values = run_values(counts.where("key >= 0")).unionByName(words.select("key", F.log10(F.col("n") + 1).alias("value")))
    found = lookups.select("unit", "key").join(values, "key").select("unit", "key", "value")
    none = lambda kind: F.lit(None).cast(kind)
    rows = found.select("unit", "key", "value", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    rows = rows.unionByName(texts.select("unit", none("long").alias("key"), none("double").alias("value"), "doc_id", "held_out", "text"))
    dealt = rows.repartition("unit").sortWithinPartitions("unit", F.asc_nulls_last("key"))
    out = dealt.mapInArrow(lean(_score_batches), "doc_id long, held_out boolean, words long, known long, base double, score double, n_bytes long")
    each, end = float(np.log10(tokens + distinct + 1)), float(np.log10(n_docs + 1))
    n_tokens = F.col("words") + 1
    return out.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + F.lit(int(n_docs > 0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + end - each * n_tokens).alias("base_score"), "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    out = score_documents(read_table(spark, sf_dir, "documents"), held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
