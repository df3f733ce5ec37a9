"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are counted with numpy over Arrow buffers. Trees are fitted on a bounded sample of
labelled documents (the ``max_labelled`` with the least hash of their id), with monotonic constraints: more symbols,
repeated lines, repeated words, exclamation marks or capitals never raise a score. The fitted trees are flattened into
node arrays, and all rows of a batch walk all trees together.

A document fails the base rule with fewer than ``MIN_WORDS`` words or with more than half of its words inside 3-word
windows that occur twice or more; it is kept if it passes the base rule and its score reaches ``KEEP_AT``.

Defined cases: a null or empty text has zero statistics and fails the base rule; labels that are null are left out of
the fit; without labels of both classes every document that passes the base rule is kept; repeated rows are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import lean, read_table, unclash
from skyframe.llm.textkernel import Words, byte_range_hashes, chunks, grams, mix

MIN_WORDS, KEEP_AT, MAX_LABELLED = 50, 0.5, 6000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_bytes", "n_capitals", "n_marks", "n_digits", "n_distinct", "n_short", "n_wide"]
#: Features and the sign that the score must follow along each (0: free).
FEATURES = {"log_words": 0, "mean_chars": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "marks": -1, "digits": 0, "distinct": 0, "words_a_line": 0, "short": 0, "wide": 0}


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_SYMBOL, _CAPITAL, _MARK, _DIGIT = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("!?"), _table("0123456789")


def count_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of COUNTS + MORE for each document of a chunk."""
    docs = len(offsets) - 1
    words = Words(data, offsets)
    n_words = np.diff(words.bounds)
    word_doc = np.repeat(np.arange(docs), n_words)
    salt = mix(np.arange(1, docs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    spaces = len(data) and np.bincount(word_doc, weights=words.ends - words.starts, minlength=docs)
    follow = (data & 0xC0) == 0x80
    word_chars = (spaces if len(data) else np.zeros(docs)) - per_doc(follow)

    hashes = words.hashes()
    distinct = np.unique(hashes + salt[word_doc], return_index=True)[1]
    repeats = np.zeros(docs, np.int64)
    three = grams(hashes, 3)
    if len(three):
        ok = np.flatnonzero(word_doc[: len(three)] == word_doc[2:])
        keys = three[ok] + salt[word_doc[ok]]
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[ok[twice] + k] = True
        repeats = np.bincount(word_doc[covered], minlength=docs)

    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.unique(np.concatenate([offsets[:-1][full], breaks + 1]))
    starts = starts[starts < len(data)]
    starts = starts[data[starts] != 10]  # empty lines have no word
    cuts = np.unique(np.concatenate([breaks, offsets[1:]]))
    ends = cuts[np.searchsorted(cuts, starts, "right")] if len(starts) else starts
    wordy = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[wordy], ends[wordy]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.unique(byte_range_hashes(data, starts, ends) + salt[line_doc], return_index=True)[1] if len(starts) else starts
    lines = np.bincount(line_doc, minlength=docs)
    dup = lines - np.bincount(line_doc[first], minlength=docs)
    short = np.bincount(word_doc[(words.ends - words.starts) <= 3], minlength=docs)
    return np.column_stack([n_words, word_chars, per_doc(_SYMBOL[data]), dup, repeats, lines, np.diff(offsets), per_doc(_CAPITAL[data]), per_doc(_MARK[data]), per_doc(_DIGIT[data]), np.bincount(word_doc[distinct], minlength=docs), short, per_doc(data >= 128)]).astype(np.int64)


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from the counts: logarithms and rates, so that length alone changes little."""
    c = dict(zip(COUNTS + MORE, counts.T.astype(float), strict=True))
    words, size, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_capitals"] / size, c["n_marks"] / words, c["n_digits"] / size, c["n_distinct"] / words, c["n_words"] / lines, c["n_short"] / words, c["n_wide"] / size])


@dataclass
class Trees:
    """All trees as flat node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality for each row."""
        out = np.empty(len(x))
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            at = np.repeat(self.roots[None, :], len(part), axis=0)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            out[k : k + 4096] = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 target by histograms of gradients; splits that break a sign are refused.

    A child inherits its parent's bounds, tightened at the midpoint of the two values along a signed feature, so the
    whole tree is monotonic and not just each split.
    """
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)])
    rate0 = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(rate0 / (1 - rate0)))
    margin, nodes, roots = np.full(n, base), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        open_ = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while open_:
            at, rows, low, high, level = open_.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            own = float(np.clip(-g / (h + ridge), low, high))
            nodes[at][4] = rate * own
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j in range(k):
                    m = len(edges[j]) + 1
                    gl, hl, cl = (np.cumsum(np.bincount(code[rows, j], weights=w, minlength=m))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                    if not len(gl):
                        continue
                    wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
                    gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - ((g - gl) * wr + 0.5 * (h - hl + ridge) * wr**2) + (g * own + 0.5 * (h + ridge) * own**2)
                    gain[(cl < least) | (len(rows) - cl < least) | (signs[j] * (wr - wl) < 0)] = -np.inf
                    b = int(np.argmax(gain))
                    if gain[b] > 1e-6 and (best is None or gain[b] > best[0]):
                        best = (gain[b], j, b, wl[b], wr[b])
            if best is None:
                margin[rows] += nodes[at][4]
                continue
            _, j, b, wl, wr = best
            middle, go = (wl + wr) / 2, code[rows, j] <= b
            left, right = len(nodes), len(nodes) + 1
            nodes[at][:4] = [j, float(edges[j][b]), left, right]
            nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
            open_ += [(left, rows[go], *bounds[0], level + 1), (right, rows[~go], *bounds[1], level + 1)]
    cols = list(zip(*nodes, strict=True))
    return Trees(np.array(roots), np.array(cols[0]), np.array(cols[1], float), np.array(cols[2]), np.array(cols[3]), np.array(cols[4], float), depth, base)


def _batches(model: Trees | None, keep_at: float, carry: int):
    names = [*COUNTS, *MORE]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                counts = count_statistics(data, offsets)
                passed = (counts[:, 0] >= MIN_WORDS) & (100 * counts[:, 4] <= 50 * counts[:, 0])
                score = model.score(features(counts)) if model else np.ones(len(counts))
                cols = [*[c.slice(first, end - first) for c in batch.columns[:carry]], *[pa.array(c) for c in counts.T], pa.array(~passed), pa.array(score), pa.array(passed & (score >= keep_at))]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:carry], *names, "base_failed", "score", "kept"])

    return run


_COLUMNS = ", ".join(f"{c} long" for c in COUNTS + MORE) + ", base_failed boolean, score double, kept boolean"


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees | None:
    """Fit on at most ``max_labelled`` labelled documents; None without both classes."""
    some = unclash(labels, ["doc_id", "quality"]).where("doc_id IS NOT NULL AND quality IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    # At most max_labelled rows by the limit.
    joined = unclash(docs, ["doc_id", "text"]).join(F.broadcast(some), "doc_id").select("quality", "text")
    rows = np.array([list(r) for r in joined.mapInArrow(_batches(None, KEEP_AT, 1), f"quality int, {_COLUMNS}").select("quality", *COUNTS, *MORE).orderBy(*COUNTS, *MORE, "quality").collect()], float)
    if not len(rows) or len(np.unique(rows[:, 0])) < 2:
        return None
    return fit(features(rows[:, 1:]), rows[:, 0], list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every document."""
    return unclash(docs, ["doc_id", "text"]).mapInArrow(lean(_batches(model, keep_at, 1)), f"doc_id long, {_COLUMNS}")


def filter_documents(docs: DataFrame, model: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that are kept, with all their columns as they were: each row is judged where it is read."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _batches(model, keep_at, 0)
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(names.index("text"))], ["text"])
            marks = [b.column("kept") for b in judged([text])]
            if marks:
                yield batch.filter(pa.concat_arrays(marks))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = judge(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
