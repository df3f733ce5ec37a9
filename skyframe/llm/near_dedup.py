"""Near-duplicate groups by MinHash.

Signatures. The words of a whole text (A-Z in lower case) give its set of distinct 5-word shingles; ``BANDS * ROWS``
universal hashes keep their minima over the set, and the minima of a band make one key. Documents at the threshold of
0.75 share a given band with a chance of 0.75 ** 5 = 0.24, and miss all 45 with a chance of 5e-6.

Links. Documents with equal sets form classes first, by the SHA-256 digest of the whole sorted set; only the least
document of a class goes on. Candidate pairs are confirmed on the full sets of both whole texts. They come in passes, and components are formed
between passes, so that pairs already connected aren't looked at again:

1. every document with the bucket leader (least id) that it shares most bands with;
2. every document with its other leaders; and in buckets that still hold several components, with ``FEW`` rows or less
   outside the largest one, those rows with all the others;
3. documents that meet in crowded buckets, with more such rows, that still hold several components form crowds; those
   outside a crowd's largest component are compared with all of it, ``ASKERS`` by ``MEMBERS`` at a time, where they
   share a band.

Components after a pass are made from those before it and the new links, not from all links again; a pass without links
leaves them as they are. A pass is a dozen small jobs, whose bookkeeping is what fills the driver. The texts of all
documents that share a band are looked for once and stored; passes read only these. All joins shuffle, none is a
broadcast, so that no table in the driver grows with the input.

The rule is one and the same everywhere: two documents that share a band, and aren't connected yet, are compared in full.
``FEW`` only decides whether such pairs are listed or met inside blocks, which is cheaper where they are many.

No group is collected: leaders come from partial aggregates and joins, pairs within a bucket
from joins of a few of its rows with the rest or inside blocks of bounded size.

Defined cases: a text without words has no shingles, is linked with nothing and is its own component; with fewer words
than a shingle, the whole sequence is its one shingle; rows with a null id are kept and never linked; rows with the same
id count as one document, which has the links of each of its texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import big_side, lean, read_table, stored, unclash
from skyframe.llm.components import connected_components, stars
from skyframe.llm.textkernel import Words, as_long, chunks, grams, mix, word_range_hashes

SHINGLE, BANDS, ROWS, FEW, ASKERS, MEMBERS = 5, 45, 5, 8, 64, 256
_RNG = np.random.default_rng(75)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_WIDTH = 1024


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row's whole text."""
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets)
        hashes = words.hashes(lower=True)
        found = grams(hashes, size)
        bounds = words.bounds.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(found[a : b - size + 1])
            elif b > a:
                yield word_range_hashes(hashes[a:b], np.array([0]), np.array([b - a]))
            else:
                yield np.empty(0, np.uint64)


class Signer:
    """Minima of all hashes over a set, and band keys of the minima."""

    def __init__(self) -> None:
        self.work = np.empty((BANDS * ROWS, _WIDTH), np.uint32)

    def bands(self, items: np.ndarray) -> np.ndarray:
        x = (items >> np.uint64(32)).astype(np.uint32)
        low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), _WIDTH):
            part = x[k : k + _WIDTH]
            work = self.work[:, : len(part)]
            np.multiply(_A[:, None], part[None, :], out=work)
            work += _B[:, None]
            np.minimum(low, work.min(axis=1), out=low)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS].astype(np.uint64))
        return key


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = Signer()

    def out(ids, sizes, digests, keys):
        flat = as_long(np.concatenate(keys)) if keys else pa.array([], pa.int64())
        offs = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offs), flat)], ["doc_id", "n_shingles", "digest", "bands"])

    for batch in batches:
        first, sizes, digests, keys = 0, [], [], []
        for items in shingle_sets(batch.column(1)):
            sizes.append(len(items))
            digests.append(hashlib.sha256(items).digest())
            keys.append(signer.bands(items) if len(items) else np.empty(0, np.uint64))
            if len(sizes) == 2000:
                yield out(batch.column(0).slice(first, 2000), sizes, digests, keys)
                first, sizes, digests, keys = first + 2000, [], [], []
        if sizes:
            yield out(batch.column(0).slice(first), sizes, digests, keys)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the digest of the set, and its band keys."""
    return unclash(docs, ["doc_id", "text"]).mapInArrow(lean(_sign), "doc_id long, n_shingles long, digest binary, bands array<long>")


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keep = []
                left = part.column(2)
                fresh = [True, *[not left[i].equals(left[i - 1]) for i in range(1, len(left))]]
                sets = shingle_sets(left.filter(pa.array(fresh)))
                for other, new in zip(shingle_sets(part.column(3)), fresh, strict=True):
                    if new:
                        own = next(sets)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents; repeated rows give one row. Texts are shuffled to the ids, and not sorted for it."""
    found = unclash(docs, ["doc_id", "text"]).join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    return found.groupBy("doc_id", F.xxhash64("text").alias("_print")).agg(F.max("text").alias("text")).select("doc_id", "text")


def confirm_pairs(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """Those of the pairs (u, v) whose full shingle sets reach the similarity; texts has doc_id and text of their ends."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("_left"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("_right"))
    joined = pairs.select("u", "v").join(big_side(left), "u").join(big_side(right), "v").select("u", "v", "_left", "_right")
    return joined.mapInArrow(lean(_confirm(percent)), "u long, v long")


class _Linker:
    """Passes of candidate pairs: tested pairs, and the components that the links found so far make."""

    def __init__(self, texts: DataFrame, percent: int):
        self.texts, self.percent, self.tested, self.fresh, self._component = texts, percent, None, None, None

    def edges(self) -> DataFrame | None:
        """Edges (u, v) that give the components of all links so far: earlier components and newer links."""
        known = self._component.select(F.col("node").alias("u"), F.col("component").alias("v")) if self._component is not None else None
        return self.fresh if known is None else known if self.fresh is None else known.unionByName(self.fresh)

    @property
    def component(self) -> DataFrame | None:
        """(node, component) of nodes that aren't the least of theirs; formed when they are first asked for."""
        if self.fresh is not None:
            self._component, self.fresh = stars(self.edges()), None
        return self._component

    def across(self, pairs: DataFrame) -> DataFrame:
        """Distinct untested pairs whose ends aren't connected yet."""
        pairs = pairs.select("u", "v").distinct()
        if self.tested is not None:
            pairs = pairs.join(big_side(self.tested), ["u", "v"], "left_anti")
        if self.component is not None:
            of = self.component
            of_u, of_v = (of.select(F.col("node").alias(x), F.col("component").alias(f"_c{x}")) for x in "uv")
            pairs = pairs.join(big_side(of_u), "u", "left").join(big_side(of_v), "v", "left")
            pairs = pairs.where(F.coalesce("_cu", "u") != F.coalesce("_cv", "v")).select("u", "v")
        return pairs

    def test(self, pairs: DataFrame) -> bool:
        """Confirm pairs and update components; False if there were none."""
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return False
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        self.add(confirm_pairs(pairs, self.texts, self.percent))
        return True

    def add(self, links: DataFrame) -> None:
        links = stored(links, "links")
        if not links.isEmpty():
            self.fresh = links if self.fresh is None else self.fresh.unionByName(links)

    def with_component(self, rows: DataFrame) -> DataFrame:
        """Rows with ``_c``, the component of their document."""
        if self.component is None:
            return rows.withColumn("_c", F.col("doc_id"))
        of = self.component.select(F.col("node").alias("doc_id"), "component")
        return rows.join(big_side(of), "doc_id", "left").withColumn("_c", F.coalesce("component", "doc_id")).drop("component")


def _unsettled(linker: _Linker, rows: DataFrame) -> DataFrame:
    """Rows of buckets with several components: with the row's component ``_c``, the bucket's largest one, and ``others``, the rows outside it."""
    rows = linker.with_component(rows)
    sizes = rows.groupBy("key", "_c").agg(F.count("*").alias("_k"))
    per = sizes.groupBy("key").agg(F.sum("_k").alias("_n"), F.max("_k").alias("_most"), F.max_by("_c", "_k").alias("_main")).where("_n > _most")
    return rows.join(big_side(per.select("key", "_main", (F.col("_n") - F.col("_most")).alias("others"))), "key")


def _across_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of the rows outside a bucket's largest component with all its rows of another component."""
    few = rows.where("_c <> _main").select("key", F.col("doc_id").alias("_a"), F.col("_c").alias("_ca"))
    both = few.join(big_side(rows.select("key", F.col("doc_id").alias("_b"), F.col("_c").alias("_cb"))), "key").where("_ca <> _cb AND _a <> _b")
    return both.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))


def _compare_blocks(percent: int):
    """Links between the askers and the members of one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ask = table["ask"].to_numpy()
        ids, comp = table["doc_id"].to_numpy(), table["_c"].to_numpy()
        bands = np.asarray(table["bands"].combine_chunks().values).reshape(len(ids), -1)
        sets = list(shingle_sets(table["text"].combine_chunks()))
        members = np.flatnonzero(~ask)
        out_u, out_v = [], []
        for i in np.flatnonzero(ask):
            near = members[(bands[members] == bands[i]).any(axis=1) & (comp[members] != comp[i])]
            if not len(near):
                continue
            own, sizes = sets[i], np.array([len(sets[m]) for m in near])
            every = np.concatenate([sets[m] for m in near])
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            for m in near[100 * both >= percent * (len(own) + sizes - both)]:
                out_u.append(min(ids[i], ids[m]))
                out_v.append(max(ids[i], ids[m]))
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})

    return run


def _crowd_links(linker: _Linker, crowded: DataFrame, signed: DataFrame) -> DataFrame:
    """Links across components inside crowded buckets.

    Documents that meet in crowded buckets form crowds. In a crowd, the documents outside its largest component are
    compared with all of it, in blocks of bounded size, and only links leave a block.
    """
    heads = crowded.groupBy("key").agg(F.min("doc_id").alias("_head"))
    edges = crowded.join(big_side(heads), "key").select(F.col("_head").alias("u"), F.col("doc_id").alias("v")).distinct()
    crowds = connected_components(stored(edges, "crowd-edges")).select(F.col("node").alias("doc_id"), F.col("component").alias("crowd"))
    rows = linker.with_component(crowds)
    sizes = rows.groupBy("crowd", "_c").agg(F.count("*").alias("_k"))
    per = sizes.groupBy("crowd").agg(F.sum("_k").alias("_n"), F.max("_k").alias("_most"), F.max_by("_c", "_k").alias("_main")).where("_n > _most")
    rows = stored(rows.join(big_side(per), "crowd").withColumn("ask", F.col("_c") != F.col("_main")), "crowds")
    n_ask, n_all = F.ceil((F.col("_n") - F.col("_most")) / ASKERS), F.ceil(F.col("_n") / MEMBERS)
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), n)
    asking = rows.where("ask").withColumn("_a", spot(n_ask)).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), n_all - 1)))
    asked = rows.withColumn("ask", F.lit(False)).withColumn("_b", spot(n_all)).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), n_ask - 1)))
    blocks = asking.unionByName(asked).select("crowd", "_a", "_b", "ask", "doc_id", "_c")
    loaded = blocks.join(big_side(signed.select("doc_id", "bands")), "doc_id").join(big_side(linker.texts), "doc_id")
    return loaded.groupBy("crowd", "_a", "_b").applyInArrow(_compare_blocks(linker.percent), "u long, v long").distinct()


def link(signed: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """Edges (u, v) with the components that all confirmed links among the least documents of each class make.

    signed is a stored table.
    """
    keys = signed.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1")
    members = stored(keys.join(big_side(shared), "key").select("key", "doc_id", "leader"), "buckets")
    linker = _Linker(stored(_texts(docs, members.select("doc_id").distinct()), "texts"), percent)
    led = members.where("doc_id <> leader").groupBy(F.col("leader").alias("u"), F.col("doc_id").alias("v")).agg(F.count("*").alias("times"))
    led = stored(led, "led")
    best = led.groupBy("v").agg(F.max_by("u", F.struct("times", -F.col("u"))).alias("u"))
    linker.test(best.select("u", "v"))

    thin, crowded = F.col("others") <= FEW, F.col("others") > FEW
    rows = stored(_unsettled(linker, members.select("key", "doc_id")), "unsettled")
    linker.test(linker.across(led.select("u", "v").unionByName(_across_pairs(rows.where(thin)))))
    # Pass 2 has compared the pairs of thin buckets only; what it left in the crowded ones is compared as crowds.
    rows = stored(_unsettled(linker, rows.where(crowded).select("key", "doc_id")).select("key", "doc_id"), "crowded")
    if not rows.isEmpty():
        linker.add(_crowd_links(linker, rows, signed))
    edges = linker.edges()
    return edges if edges is not None else led.select("u", "v").where("false")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = stored(signatures(docs), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("least"))
    of_class = stored(known.select("doc_id", "digest").join(big_side(classes), "digest").select("doc_id", "digest", "least"), "classes")
    least = of_class.where("doc_id = least").select("doc_id", "digest").distinct()
    leaders = known.join(big_side(least), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    links = link(stored(leaders.select("doc_id", "bands"), "leaders"), docs, percent)
    edges = links.unionByName(of_class.where("doc_id <> least").select(F.col("least").alias("u"), F.col("doc_id").alias("v")))
    # The least document of a component has no row here: it is its own component.
    found = stars(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(big_side(found), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
