"""The object manifest: catalogs to one table with flags, tiers and splits, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.operators import clean, joins
from skyframe.operators.captions import split_balance
from skyframe.operators.checks import in_two_splits, not_unique, require_empty
from skyframe.operators.splits import assign_splits


def build_manifest(spectra: DataFrame, images: DataFrame, transients: DataFrame | None = None, order: str = "seq", distance: str = "dist", required: tuple[str, ...] = ("spectra", "image", "lightcurve"), seed: int = 42, strict: bool = True, **split) -> DataFrame:
    """Canonical ids, one row per object, outer join on the id, appended transients, flags, tiers, splits.

    ``strict`` checks that ids are unique and splits disjoint before the plan goes on.
    """
    left = clean.dedup_closest(clean.canonicalize_ids(spectra), "object_id", distance, order).drop(distance, order)
    right = images.withColumn("object_id", F.col("object_id").cast("string"))
    if strict:
        require_empty(not_unique(right, "object_id"), "repeated image ids")
    both = joins.outer_on_object(clean.standardize(left, {}, ["spectra"]), clean.standardize(right, {}, ["image"]))
    if transients is not None:
        both = joins.append_disjoint(both, clean.standardize(transients, {}, ["lightcurve"]))
    manifest = assign_splits(clean.with_tier(clean.availability_flags(both, required)), seed, **split)
    if strict:
        require_empty(in_two_splits(manifest, "object_id"), "objects in two splits")
    return manifest


def manifest_balance(manifest: DataFrame, by: str = "survey") -> DataFrame:
    return split_balance(manifest, by)
