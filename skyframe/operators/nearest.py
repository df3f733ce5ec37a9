"""Nearest neighbours on the sphere, exact and without a limit of distance, by cells that divide where rows are many.

Positions become unit vectors, so poles and the wrap of right ascension are no special cases: distances along straight
lines order pairs as distances on the sphere do. Space is divided into cubes, of edge 2 / 2**level. A pair of cells, one of
each catalog, is dropped if even the nearest corners of the boxes around their rows are farther apart than the farthest
corners of another pair of the same cell of ``a``: such a pair can't hold a nearest neighbour. What is left is divided
again, on both sides, until a cell of ``a`` meets few rows of ``b``; then rows meet rows.

The first level has at most some six thousand cells, whatever the catalogs, because a sphere crosses no more cubes of
that size; those pairs are found on the driver. Deeper levels are joins on cells, keyed by their parents; a field with
nearly all rows just divides further than others, so no task gets a dense field whole. Rows of one position are one
row of the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.columns import haversine_arcsec
from skyframe.operators.lineage import settled

FIRST, STEP, DEEPEST = 5, 2, 19
#: A cell of ``a`` is divided further while it holds more rows than the first or meets more of ``b`` than the second.
MAX_OWN, MAX_MET = 20_000, 256
AXES = ("x", "y", "z")


def _positions(df: DataFrame, id_: str, ra: str, dec: str) -> DataFrame:
    """(ra, dec, x, y, z, three grid numbers, id): one row for each position, with its least id."""
    known = df.where(f"`{ra}` IS NOT NULL AND `{dec}` IS NOT NULL AND NOT isnan(`{ra}`) AND NOT isnan(`{dec}`)")
    spots = known.groupBy(F.col(ra).alias("ra"), F.col(dec).alias("dec")).agg(F.min(id_).alias("id"))
    across = F.cos(F.radians("dec"))
    out = spots.withColumns({"x": across * F.cos(F.radians("ra")), "y": across * F.sin(F.radians("ra")), "z": F.sin(F.radians("dec"))})
    top = (1 << DEEPEST) - 1
    return out.withColumns({f"g{c}": F.least(F.floor((F.col(c) + 1) * float(1 << (DEEPEST - 1))), F.lit(top)).cast("long") for c in AXES})


def _cell(level: int) -> Column:
    """The cell of a position at a level: three grid numbers in one."""
    part = [F.shiftright(f"g{c}", DEEPEST - level) for c in AXES]
    return F.shiftleft(part[0], 40).bitwiseOR(F.shiftleft(part[1], 20)).bitwiseOR(part[2])


def _parent(cell: Column, steps: int) -> Column:
    """The cell ``steps`` levels up that holds a cell."""
    mask = (1 << 20) - 1
    part = [F.shiftright(F.shiftright(cell, s).bitwiseAND(F.lit(mask)), steps) for s in (40, 20, 0)]
    return F.shiftleft(part[0], 40).bitwiseOR(F.shiftleft(part[1], 20)).bitwiseOR(part[2])


def _cells(rows: DataFrame, level: int, side: str) -> DataFrame:
    """Cells with their number of rows and the box around them; column names begin with ``side``."""
    box = [f(c).alias(f"{side}{c}_{n}") for c in AXES for n, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(_cell(level).alias(f"{side}cell")).agg(F.count("*").alias(f"{side}n"), *box)


def _slack(d: Column) -> Column:
    """Squared distances with room for rounding."""
    return d + 1e-14 * (d + F.sqrt(d)) + 1e-28


def _first_pairs(a: pd.DataFrame, b: pd.DataFrame, most: float | None) -> pd.DataFrame:
    """Pairs of cells of the first level that can hold a nearest neighbour."""
    low = {s: np.stack([t[f"{s}{c}_low"].to_numpy(float) for c in AXES], 1) for s, t in (("a", a), ("b", b))}
    high = {s: np.stack([t[f"{s}{c}_high"].to_numpy(float) for c in AXES], 1) for s, t in (("a", a), ("b", b))}
    out = []
    for k in range(0, len(a) if len(b) else 0, 128):
        la, ha = low["a"][k : k + 128, None], high["a"][k : k + 128, None]
        near = (np.maximum(0, np.maximum(la - high["b"], low["b"] - ha)) ** 2).sum(2)
        far = (np.maximum(np.abs(ha - low["b"]), np.abs(high["b"] - la)) ** 2).sum(2)
        bound = far.min(1, keepdims=True) if most is None else np.minimum(far.min(1, keepdims=True), most)
        i, j = np.nonzero(near <= bound + 1e-14 * (bound + np.sqrt(bound)) + 1e-28)
        met = np.bincount(i, b["bn"].to_numpy(float)[j], minlength=len(la))
        out.append(pd.DataFrame({"acell": a["acell"].to_numpy()[k + i], "bcell": b["bcell"].to_numpy()[j], "an": a["an"].to_numpy()[k + i], "met": met[i]}))
    return pd.concat(out) if out else pd.DataFrame({"acell": [], "bcell": [], "an": [], "met": []})


def leaves(pa: DataFrame, pb: DataFrame, chord: float | None) -> Iterator[tuple[int, DataFrame]]:
    """(level, pairs of cells acell, bcell with an rows of the first and met rows of ``b`` in all) whose rows are to be compared.

    A cell of ``a`` is in the pairs of one level; ``chord`` is a limit of the squared distance.
    """
    divide = (F.col("an") > MAX_OWN) | (F.col("met") > MAX_MET)
    # A sphere crosses some six thousand cells of the first level at most.
    first = _first_pairs(_cells(pa, FIRST, "a").toPandas(), _cells(pb, FIRST, "b").toPandas(), chord)
    pairs = pa.sparkSession.createDataFrame(first.astype({"acell": "int64", "bcell": "int64", "an": "int64", "met": "float64"}), "acell long, bcell long, an long, met double")
    for level in range(FIRST, DEEPEST + 1, STEP):
        if level > FIRST:
            pairs = settled(_divided(pairs.where(divide), pa, pb, level, chord))
        whole = level + STEP > DEEPEST or not pairs.where(divide).limit(1).count()
        yield level, pairs if whole else pairs.where(~divide)
        if whole:
            return


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, ra: str = "ra", dec: str = "dec", radius_arcsec: float | None = None) -> DataFrame:
    """(a_id, b_id, sep_arcsec): for each a its nearest b, at a tie the least b_id; with a radius only if b is within it.

    Positions that are null or NaN take no part. Where both ids have one name, b's gets the suffix ``_right``.
    """
    spark = a.sparkSession
    pa, pb = settled(_positions(a, a_id, ra, dec)), settled(_positions(b, b_id, ra, dec))
    chord = None if radius_arcsec is None else 4 * float(np.sin(np.radians(min(radius_arcsec / 3600, 180.0)) / 2)) ** 2 * (1 + 1e-9) + 1e-28
    met = None
    for level, pairs in leaves(pa, pb, chord):
        rows_b = pb.select(_cell(level).alias("bcell"), F.col("id").alias("_b"), F.col("ra").alias("_bra"), F.col("dec").alias("_bdec"))
        rows_a = pa.select(_cell(level).alias("acell"), F.col("ra").alias("_ara"), F.col("dec").alias("_adec"))
        found = pairs.select("acell", "bcell").join(rows_b, "bcell").join(rows_a, "acell").withColumn("_sep", haversine_arcsec(F.col("_ara"), F.col("_adec"), F.col("_bra"), F.col("_bdec")))
        if radius_arcsec is not None:
            found = found.where(F.col("_sep") <= radius_arcsec)
        best = found.groupBy("_ara", "_adec").agg(F.min(F.struct("_sep", "_b")).alias("_best"))
        met = best if met is None else met.unionByName(best)
    same = (F.col(ra) == F.col("_ara")) & (F.col(dec) == F.col("_adec"))
    name = b_id if b_id != a_id else f"{b_id}_right"
    return a.select(a_id, ra, dec).join(met, same).select(F.col(a_id), F.col("_best._b").alias(name), F.col("_best._sep").alias("sep_arcsec"))


def _divided(pairs: DataFrame, pa: DataFrame, pb: DataFrame, level: int, chord: float | None) -> DataFrame:
    """Pairs of cells of ``level`` below the pairs given, less those that can't hold a nearest neighbour."""
    below_a = _cells(pa, level, "a").withColumn("_up_a", _parent(F.col("acell"), STEP))
    below_b = _cells(pb, level, "b").withColumn("_up_b", _parent(F.col("bcell"), STEP))
    parents = pairs.select(F.col("acell").alias("_up_a"), F.col("bcell").alias("_up_b"))
    each = parents.join(below_b, "_up_b").join(below_a, "_up_a")
    zero = F.lit(0.0)
    near = sum((F.pow(F.greatest(zero, F.col(f"a{c}_low") - F.col(f"b{c}_high"), F.col(f"b{c}_low") - F.col(f"a{c}_high")), 2) for c in AXES), zero)
    far = sum((F.pow(F.greatest(F.abs(F.col(f"a{c}_high") - F.col(f"b{c}_low")), F.abs(F.col(f"b{c}_high") - F.col(f"a{c}_low"))), 2) for c in AXES), zero)
    own = Window.partitionBy("acell")
    bound = F.min(far).over(own) if chord is None else F.least(F.min(far).over(own), F.lit(chord))
    kept = each.withColumn("_near", near).withColumn("_bound", bound).where(F.col("_near") <= _slack(F.col("_bound")))
    return kept.select("acell", "bcell", "an", F.sum("bn").over(own).cast("double").alias("met"))
