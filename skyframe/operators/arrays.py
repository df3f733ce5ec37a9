"""Nested arrays of spectra, images and tokens as higher-order expressions: no row leaves its task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.columns import canonical_band


def select_bands(images: Column, bands: list[str]) -> Column:
    """Images of the requested bands in that order; of several of a band the last one. A missing band stops the job."""

    def of(name: str) -> Column:
        key = canonical_band(F.lit(name))
        found = F.filter(images, lambda x: canonical_band(x["band"]) == key)
        present = F.array_join(F.array_sort(F.array_distinct(F.transform(images, lambda x: canonical_band(x["band"])))), ", ")
        why = F.concat(F.lit(f"band {name} is not available; bands present: "), F.when(F.size(images) > 0, present).otherwise("none"))
        return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.try_element_at(found, F.lit(-1))).otherwise(F.raise_error(why))

    return F.array(*[of(b) for b in bands])


def image_stack(images: Column, bands: list[str]) -> Column:
    """Repaired pixels (band, row, column) of the requested bands; bands of unequal shape stop the job."""
    stack = F.transform(select_bands(images, bands), lambda x: repair_rows(x["flux"]))
    shapes = F.array_distinct(F.transform(stack, lambda b: F.concat(F.size(b).cast("string"), F.lit("x"), F.size(F.get(b, F.lit(0))).cast("string"))))
    return F.when(F.size(shapes) == 1, stack).otherwise(F.raise_error(F.concat(F.lit("bands of unequal shapes: "), F.array_join(shapes, ", "))))


def select_positions(images: Column, places: list[int]) -> Column:
    return F.array(*[F.get(images, F.lit(p)) for p in places])


def ragged(flux: Column) -> Column:
    """True if an image's rows differ in length or there is none."""
    sizes = F.array_distinct(F.transform(F.filter(flux, lambda r: r.isNotNull()), F.size))
    return F.coalesce(F.size(sizes) != 1, F.lit(True))


def repair_rows(flux: Column) -> Column:
    """Missing pixel rows become NaN rows of the common width. An image without any row, or with rows of several widths, stops the job."""
    widths = F.array_distinct(F.transform(F.filter(flux, lambda r: r.isNotNull()), F.size))
    filled = F.transform(flux, lambda r: F.coalesce(r, F.array_repeat(F.lit(float("nan")).cast("double"), F.get(widths, F.lit(0)))))
    told = F.array_join(F.transform(F.array_sort(widths), lambda w: w.cast("string")), ", ")
    none = F.coalesce(F.size(widths), F.lit(0)) <= 0
    return F.when(F.size(widths) == 1, filled).when(none, F.raise_error(F.lit("an image has no usable rows"))).otherwise(F.raise_error(F.concat(F.lit("an image has rows of different widths: "), told)))


def trim_spectrum(wave: Column, *others: Column) -> Column:
    """Array of structs (wave, pos, v0, v1, ...) without bad wavelengths, sorted by wavelength; equal ones keep their order."""
    zipped = F.transform(wave, lambda w, i: F.struct(w.cast("double").alias("wave"), i.alias("pos"), *[F.get(o, i).alias(f"v{k}") for k, o in enumerate(others)]))
    good = F.filter(zipped, lambda p: p["wave"].isNotNull() & ~F.isnan(p["wave"]) & (p["wave"] > 0) & (p["wave"] != float("inf")))
    return F.array_sort(good)


def length_bucket(wave: Column) -> Column:
    """Length after trimming; rows of equal length can be dealt together with ``repartition``."""
    return F.size(trim_spectrum(wave))


def length_grid(longest: int, ratio: float = 1.125) -> list[int]:
    """Widths that lengths are rounded up to, each at most ``ratio`` times (or one more than) the one before."""
    widths = [1]
    while widths[-1] < longest:
        widths.append(max(widths[-1] + 1, int(widths[-1] * ratio)))
    return widths


def token_batches(df: DataFrame, length: Column, budget: int, key: str, ratio: float = 1.125, salts: int = 1024) -> DataFrame:
    """``df`` with ``width`` and ``batch``: rows of nearly equal length together, so many that a padded batch fits the budget.

    Lengths are rounded up to a grid of widths; a batch holds rows of one width, ``budget // width`` of them, so padding is at
    most the grid's ratio. Batches are numbered from 0 without gaps and without a sort of all rows: rows are counted by
    width and by a hash of the key, the sums of these counts (a row for each width and one of ``salts`` hashes) say where
    a hash's rows begin, and only rows of one width and hash are put in order, by key. A length of zero or null counts
    as one; a length over the budget stops the job.
    """
    size = F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long")
    longest = df.agg(F.max(size)).first()[0]
    if longest is None:
        return df.withColumns({"width": F.lit(None).cast("int"), "batch": F.lit(None).cast("long")})
    if longest > budget:
        raise ValueError(f"a row of length {longest} is over the budget of {budget}")
    # The last width may pass the longest row, and the budget with it.
    grid = [min(w, longest) for w in length_grid(longest, ratio)]
    wide = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in grid]), lambda w: w >= size), F.lit(1))
    dealt = df.withColumn("width", wide).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    counts = dealt.groupBy("width", "_salt").agg(F.count("*").alias("_n"))
    begin = F.sum("_n").over(Window.partitionBy("width").orderBy("_salt")) - F.col("_n")
    holds = F.floor(F.lit(budget) / F.col("width")).cast("long")
    sizes = counts.groupBy("width").agg(F.sum("_n").alias("_all")).withColumn("_batches", F.ceil(F.col("_all") / holds))
    # A row for each width.
    earlier = F.sum("_batches").over(Window.orderBy("width")) - F.col("_batches")
    places = counts.select("width", "_salt", begin.alias("_begin")).join(sizes.select("width", earlier.cast("long").alias("_earlier")), "width")
    at = F.col("_begin") + F.row_number().over(Window.partitionBy("width", "_salt").orderBy(key)) - 1
    out = dealt.join(places, ["width", "_salt"]).withColumn("batch", F.col("_earlier") + F.floor(at / holds).cast("long"))
    return out.drop("_salt", "_begin", "_earlier")


def padding_report(batches: DataFrame, length: Column, budget: int) -> DataFrame:
    """One row: rows, batches, elements, elements with padding to each batch's longest row, the share of padding, the largest batch, batches over the budget."""
    size = F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long")
    each = batches.groupBy("batch").agg(F.count("*").alias("n"), F.sum(size).alias("used"), F.max(size).alias("most")).withColumn("padded", F.col("n") * F.col("most"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_batches"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_used"), F.coalesce(F.sum("padded"), F.lit(0)).alias("n_padded"), F.coalesce(F.max("padded"), F.lit(0)).alias("largest"), F.count_if(F.col("padded") > budget).alias("n_over"))
    return out.withColumn("padding_share", F.round(F.coalesce(1 - F.try_divide("n_used", "n_padded"), F.lit(0.0)), 6))


def pad_values(values: Column, length: Column, fill) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def pad_wave(wave: Column, length: Column, step: float = 0.8) -> Column:
    """Wavelengths go on in equal steps behind the last one."""
    more = length - F.size(wave)
    tail = F.when(more > 0, F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda k: F.element_at(wave, -1) + k * step)).otherwise(F.array().cast("array<double>"))
    return F.concat(wave, tail)


def pad_spectra(df: DataFrame, batch: str, wave: str, flux: str, ivar: str, mask: str) -> DataFrame:
    """Arrays of each batch padded to its longest spectrum: zero flux and ivar, true mask, wavelengths going on."""
    longest = df.groupBy(batch).agg(F.max(F.size(wave)).alias("_n"))
    out, n = df.join(longest, batch), F.col("_n")
    return out.withColumns({wave: pad_wave(F.col(wave), n), flux: pad_values(F.col(flux), n, 0.0), ivar: pad_values(F.col(ivar), n, 0.0), mask: pad_values(F.col(mask), n, True)}).drop("_n")


def subsample_linspace(values: Column, n: int = 100) -> Column:
    """n evenly spaced values, both ends included, at truncated places; the array itself if it is no longer."""
    last = F.size(values) - 1
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, F.floor(i * last / (n - 1)).cast("int")))
    return F.when(F.size(values) <= n, values).otherwise(picked)


def spectrum_text(wave: Column, flux: Column, n: int = 100) -> Column:
    """wave:flux pairs with fixed decimals."""
    pairs = F.zip_with(subsample_linspace(wave, n), subsample_linspace(flux, n), lambda w, f: F.format_string("%.1f:%.3f", w, f))
    return F.concat_ws(" ", pairs)


def plot_bounds(points: DataFrame, key: str, wave: str, flux: str, masked: str, least: int = 10, below: float = 0.08, above: float = 0.35, least_range: float = 1e-4) -> DataFrame:
    """(key, n_points, low, high): flux range between the 0.5 and 99.5 percentiles of valid points, with room below and, for labels, above.

    Valid points have a positive finite wavelength and a finite flux and aren't masked.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = points.where((F.col(wave) > 0) & finite(wave) & finite(flux) & ~F.col(masked))
    q = ok.groupBy(key).agg(F.count("*").alias("n_points"), F.percentile(flux, F.array(F.lit(0.005), F.lit(0.995))).alias("_q")).where(F.col("n_points") >= least)
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    size = F.greatest(high - low, F.lit(least_range))
    return q.select(key, "n_points", (low - below * size).alias("low"), (high + above * size).alias("high"))


def pad_tokens(tokens: Column, length: int, width: int) -> Column:
    """Struct of ``tokens`` with exactly ``length`` rows (cut or filled with zeros) and a ``mask`` that is true on absent ones."""
    have = F.slice(F.coalesce(tokens, F.array().cast("array<array<double>>")), 1, length)
    room = F.lit(length) - F.size(have)
    zero = F.array_repeat(F.lit(0.0), width)
    return F.struct(F.concat(have, F.array_repeat(zero, room)).alias("tokens"), F.concat(F.array_repeat(F.lit(False), F.size(have)), F.array_repeat(F.lit(True), room)).alias("mask"))


def flatten_tokens(tokens: Column) -> Column:
    return F.flatten(tokens)


def spectrum_extent(df: DataFrame, key: str, z: str, wave: str, distance: str, order: str) -> DataFrame:
    """(key, z, low, high) of the closest observation; z is null if it isn't a number."""
    from skyframe.operators.clean import dedup_closest

    return dedup_closest(df, key, distance, order).select(key, F.col(z).try_cast("double").alias("z"), F.array_min(wave).alias("low"), F.array_max(wave).alias("high"))


def fp16_error(df: DataFrame, values: str) -> DataFrame:
    """One row: greatest absolute error of a half-precision round trip."""
    import pandas as pd

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            flat = np.concatenate([np.asarray(v, float) for v in b[values]]) if len(b) else np.empty(0)
            yield pd.DataFrame({"e": [float(np.abs(flat - flat.astype(np.float16).astype(float)).max(initial=0))]})

    return df.select(values).mapInPandas(run, "e double").agg(F.max("e").alias("max_error"))
