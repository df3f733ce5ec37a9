"""Joins between catalogs, captions, predictions and claims.

Everything is an equi-join in the end, the sky cross-match too: see :mod:`skyframe.operators.nearest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.columns import draw_key
from skyframe.operators.checks import ValidationError, overlap, require_empty
from skyframe.operators.nearest import nearest
from skyframe.operators.splits import ranked


def _suffixed(df: DataFrame, other: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Columns that both tables have get a suffix, keys excepted."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c in other.columns and c not in keys})


def outer_on_cell(a: DataFrame, b: DataFrame, cell: str, match_nulls: bool = True) -> DataFrame:
    """Full outer join on a precomputed cell; with ``match_nulls`` a null cell meets null cells."""
    right = _suffixed(b, a, [cell], "_right").withColumnRenamed(cell, "_cell")
    same = a[cell].eqNullSafe(right["_cell"]) if match_nulls else a[cell] == right["_cell"]
    return a.join(right, same, "full_outer").withColumn(cell, F.coalesce(cell, "_cell")).drop("_cell")


def outer_on_object(a: DataFrame, b: DataFrame, key: str = "object_id") -> DataFrame:
    """Full outer join on ids as text."""
    a, b = a.withColumn(key, F.col(key).cast("string")), b.withColumn(key, F.col(key).cast("string"))
    return a.join(_suffixed(b, a, [key], "_right"), key, "full_outer")


def overlap_rate(a: DataFrame, b: DataFrame, key: str = "object_id") -> DataFrame:
    """One row: keys of b, those found in a, their share, and whether it is below a half."""
    keys = b.select(F.col(key).cast("string").alias(key)).distinct()
    found = a.select(F.col(key).cast("string").alias(key)).distinct().withColumn("_in", F.lit(1))
    out = keys.join(found, key, "left").agg(F.count("*").alias("n_keys"), F.count("_in").alias("n_found"))
    rate = F.try_divide("n_found", "n_keys")
    return out.select("n_keys", "n_found", rate.alias("rate"), F.coalesce(rate < 0.5, F.lit(True)).alias("low"))


# --- sky cross-match ----------------------------------------------------------------------------------------------------


def crossmatch(a: DataFrame, b: DataFrame, radius_arcsec: float = 1.0, key: str = "object_id", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Joint, a-only and b-only rows: each a with its nearest b within the radius, and every b that no a took.

    Columns of b get the suffix ``_right`` where they clash.
    """
    matched = nearest(a, b, key, key, ra, dec, radius_arcsec)
    right = _suffixed(b.withColumnRenamed(key, f"{key}_right"), a, [], "_right")
    joint = a.join(matched, key, "left").join(right, f"{key}_right", "left")
    rest = right.join(matched.select(f"{key}_right").distinct(), f"{key}_right", "left_anti")
    return joint.unionByName(rest, allowMissingColumns=True)


def attach_nearest(sample: DataFrame, votes: DataFrame, radius_arcsec: float, values: list[str], masks: list[str], key: str = "object_id") -> DataFrame:
    """Sample with the values of the nearest vote row if it is within the radius; else values are null and masks true.

    The separation from the nearest vote row is reported however far it is; it is null only for a row without a position,
    or if no vote row has one.
    """
    near = nearest(sample, votes, key, key)
    out = sample.select(key).join(near, key, "left")
    ok = F.coalesce(F.col("sep_arcsec") <= radius_arcsec, F.lit(False))
    out = out.withColumn("crossmatched", ok).withColumn("_hit", F.when(ok, F.col(f"{key}_right")))
    right = votes.select(F.col(key).alias("_hit"), *values, *masks)
    joined = out.join(right, "_hit", "left")
    return joined.select(key, "sep_arcsec", "crossmatched", *values, *[F.coalesce(m, F.lit(True)).alias(m) for m in masks])


# --- other joins --------------------------------------------------------------------------------------------------------


def append_disjoint(a: DataFrame, b: DataFrame, key: str = "object_id") -> DataFrame:
    """Union by name with a source that has ids of its own; a collision is an error."""
    a, b = a.withColumn(key, F.col(key).cast("string")), b.withColumn(key, F.col(key).cast("string"))
    require_empty(overlap(a, b, key), "ids in both sources")
    return a.unionByName(b, allowMissingColumns=True)


def translate_ids(captions: DataFrame, mapping: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """Captions with the target id; of repeated source ids the last mapping counts, unmatched captions are left out."""
    last = mapping.groupBy(source).agg(F.max_by(target, order).alias(target))
    return captions.join(last, source).drop(source)


def translation_report(captions: DataFrame, mapping: DataFrame, source: str) -> DataFrame:
    """One row: captions, those whose id the mapping has, and those that :func:`translate_ids` leaves out."""
    known = mapping.select(source).where(F.col(source).isNotNull()).distinct().withColumn("_known", F.lit(1))
    out = captions.select(source).join(known, source, "left").agg(F.count("*").alias("n_captions"), F.count("_known").alias("n_matched"))
    return out.withColumn("n_unmatched", F.col("n_captions") - F.col("n_matched"))


def lookup_caption(manifest: DataFrame, captions: DataFrame, legacy: str, key: str = "object_id") -> DataFrame:
    """Manifest rows with the caption of their legacy id or, without one, of their id."""
    keyed = manifest.withColumn("_key", F.coalesce(legacy, key))
    return keyed.join(captions.withColumnRenamed(key, "_key"), "_key").drop("_key")


def attach_captions(benchmark: DataFrame, captions: DataFrame, key: str = "sample_id") -> DataFrame:
    """Benchmark rows that have a caption; none is no error (see :func:`skyframe.operators.infer.evaluation_summary`)."""
    return benchmark.join(captions.select(key, "caption"), key)


def pair_predictions(base: DataFrame, treatment: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Samples of both runs, with each column once per run; runs without a common sample are an error."""
    a = base.select(key, *[F.col(c).alias(f"{c}_base") for c in columns])
    out = a.join(treatment.select(key, *[F.col(c).alias(f"{c}_treatment") for c in columns]), key)
    if out.isEmpty():
        raise ValidationError("the runs have no sample in common")
    return out


def join_modalities(a: DataFrame, b: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return a.join(_suffixed(b, a, keys, suffix), keys)


def align_to(sample: DataFrame, table: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of ``table`` for the sample's ids, with the sample's position; a missing id is an error."""
    require_empty(sample.select(key).join(table.select(key), key, "left_anti"), "ids without a row")
    return sample.select(key, position).join(table, key)


def pending(worklist: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return worklist.join(done.select(key).distinct(), key, "left_anti")


def match_gap(claims: DataFrame, gaps: DataFrame, key: str = "object_id") -> DataFrame:
    """Claimed gaps (key, claim_pos, start_days, end_days, duration_days) with the nearest actual gap (key, gap_pos, start, end)."""
    near = claims.where("start_days IS NOT NULL AND end_days IS NOT NULL").join(gaps, key)
    off = F.abs(F.col("start") - F.col("start_days")) + F.abs(F.col("end") - F.col("end_days"))
    best = near.groupBy(key, "claim_pos").agg(F.min(F.struct(off.alias("off"), "gap_pos", "start", "end")).alias("_g"))
    out = claims.join(best, [key, "claim_pos"], "left")
    both = F.col("start_days").isNotNull() & F.col("end_days").isNotNull()
    status = F.when(F.col("_g").isNotNull(), "matched").when(both, "no_gap").when(F.col("duration_days").isNotNull(), "duration_only").otherwise("no_numbers")
    return out.select(key, "claim_pos", status.alias("status"), F.col("_g.gap_pos").alias("gap_pos"), (F.col("start_days") - F.col("_g.start")).alias("start_error"), (F.col("end_days") - F.col("_g.end")).alias("end_error"))


def match_peak(claims: DataFrame, facts: DataFrame, key: str = "object_id") -> DataFrame:
    """Claimed peaks (key, claim_pos, band, time_days, magnitude) with the brightest point of their band (key, band, peak_time, peak_mag)."""
    out = claims.join(facts, [key, "band"], "left")
    mag = F.when(~F.isnan("peak_mag") & (F.abs("peak_mag") != float("inf")), F.col("peak_mag"))
    status = F.when(F.col("peak_time").isNull(), "band_absent").otherwise("matched")
    return out.select(key, "claim_pos", "band", status.alias("status"), (F.col("time_days") - F.col("peak_time")).alias("time_error"), (F.col("magnitude") - mag).alias("magnitude_error"))


def closest_observation(df: DataFrame, key: str, distance: str, order: str) -> DataFrame:
    rank = Window.partitionBy(key).orderBy(F.asc_nulls_last(distance), F.asc(order))
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def swap_donors(df: DataFrame, key: str, group: str, seed: int, has: str | None = None) -> DataFrame:
    """(key, donor): another object of the same group for each object, in a seeded circle; never itself.

    With ``has``, pairs whose donor lacks that modality are left out.
    """
    place = ranked(df.select(key, group, *([has] if has else [])), [group], draw_key(seed, F.col(key)), key, "_at").withColumn("_at", F.col("_at") - 1)
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    shift = F.lit(1) + F.pmod(F.lit(seed), F.greatest(F.col("_n") - 1, F.lit(1)))
    placed = place.join(sizes, group).where("_n > 1").withColumn("_to", F.pmod(F.col("_at") + shift, F.col("_n")))
    donors = place.select(group, F.col("_at").alias("_to"), F.col(key).alias("donor"), *([F.col(has).alias("_has")] if has else []))
    out = placed.join(donors, [group, "_to"])
    return (out.where("_has") if has else out).select(key, "donor")


#: Rest wavelengths in angstrom.
REST_LINES = [
    ("Lyalpha", 1215.67),
    ("Hdelta", 4101.74),
    ("Hgamma", 4340.47),
    ("Hbeta", 4861.33),
    ("Halpha", 6562.82),
    ("OII 3727", 3727.09),
    ("OIII 4959", 4958.91),
    ("OIII 5007", 5006.84),
    ("OI 6300", 6300.30),
    ("NII 6583", 6583.45),
    ("SII 6716", 6716.44),
    ("SII 6731", 6730.82),
    ("CIV", 1549.06),
    ("CIII", 1908.73),
    ("MgII", 2798.75),
    ("HeII", 4685.70),
    ("CaII K", 3933.66),
    ("CaII H", 3968.47),
    ("G band", 4304.40),
    ("MgI b", 5175.40),
    ("NaI D", 5892.94),
]


def line_coverage(spectra: DataFrame, key: str, z: str, low: str, high: str, lines: list[tuple[str, float]] = REST_LINES) -> DataFrame:
    """(key, line, observed): lines whose redshifted wavelength lies in the object's range.

    ``lines`` is a fixed list of rest wavelengths, so it is carried as an array with each object and not joined.
    """
    table = F.array(*[F.struct(F.lit(name).alias("line"), F.lit(float(rest)).alias("rest")) for name, rest in lines])
    ok = spectra.where((F.col(z) > -0.01) & ~F.isnan(z))
    each = ok.select(key, z, low, high, F.explode(table).alias("l")).withColumn("observed", F.col("l.rest") * (1 + F.col(z)))
    return each.where(F.col("observed").between(F.col(low), F.col(high))).select(key, "l.line", "observed")


def attach_ground_truth(df: DataFrame, types: DataFrame, lines: DataFrame, key: str, survey: str = "survey") -> DataFrame:
    """Class (QSO as Quasar) and subclass for all, and for DESI objects the line labels by falling SNR.

    ``types`` has one row per key; ``lines`` has (key, label, snr).
    """
    listed = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("snr")).alias("s"), "label"))).alias("_l")).select(key, F.transform("_l", lambda x: x["label"]).alias("_labels"))
    out = df.join(types.select(key, F.when(F.col("class") == "QSO", "Quasar").otherwise(F.col("class")).alias("class"), "subclass"), key, "left").join(listed, key, "left")
    return out.withColumn("lines", F.when(F.lower(survey) == "desi", F.coalesce("_labels", F.array().cast("array<string>")))).drop("_labels")


def combine_sides(base: DataFrame, equipped: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One record per object with the answers of both sides as structs."""
    a = base.select(key, F.struct(*columns).alias("base"))
    return a.join(equipped.select(key, F.struct(*columns).alias("equipped")), key)
