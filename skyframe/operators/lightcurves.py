"""Light curves in long form: one row per point (object, pos, mjd, flux, err, band_id, used)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.columns import band_name, draw_key, magnitude, magnitude_error, snr
from skyframe.operators.checks import require_empty
from skyframe.operators.quantiles import exact_quantiles

ARRAYS = ["mjd", "flux", "err", "band_id", "used"]


def to_points(df: DataFrame, key: str = "object_id", arrays: list[str] = ARRAYS) -> DataFrame:
    """Long form of aligned arrays. Arrays of unequal length, a null beside others too, stop the job that reads them."""
    sizes = [F.coalesce(F.size(a), F.lit(-1)) for a in arrays]
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{a}: "), s.cast("string")) for a, s in zip(arrays, sizes, strict=True)])
    unequal = F.greatest(*sizes) != F.least(*sizes) if len(arrays) > 1 else F.lit(False)
    wrong = F.raise_error(F.concat(F.lit("arrays of "), F.col(key).cast("string"), F.lit(" disagree on length: "), told))
    zipped = F.posexplode(F.when(unequal, wrong).otherwise(F.arrays_zip(*arrays))).alias("pos", "_p")
    return df.select(key, zipped).select(key, "pos", *[F.col(f"_p.{a}").alias(a) for a in arrays])


def retained(points: DataFrame) -> DataFrame:
    """Accepted points, without window or cap."""
    return points.where("used")


def detection_window(points: DataFrame, key: str = "object_id", limit: float = 5.0, before: float = 30.0) -> DataFrame:
    """Accepted points from ``before`` days ahead of the first detection to the last one; all where there is none."""
    ratio = snr(F.col("flux"), F.col("err"))
    finite = ~F.isnan(ratio) & (F.abs(ratio) != float("inf"))
    seen = points.where("used").withColumn("_hit", F.when(finite & (ratio > limit), F.col("mjd")))
    whole = Window.partitionBy(key)
    marked = seen.withColumn("_first", F.min("_hit").over(whole)).withColumn("_last", F.max("_hit").over(whole))
    keep = F.col("_first").isNull() | F.col("mjd").between(F.col("_first") - before, F.col("_last"))
    return marked.where(keep).drop("_hit", "_first", "_last")


def prepare_points(points: DataFrame, cap: int = 243, seed: int = 42, key: str = "object_id") -> DataFrame:
    """Windowed points, at most ``cap`` per object drawn by hash, with time since the first kept point and their rank in time.

    An object without an accepted point is an error.
    """
    none = points.groupBy(key).agg(F.count_if("used").alias("n_accepted")).where("n_accepted = 0")
    require_empty(none, "objects without accepted points")
    draw = Window.partitionBy(key).orderBy(draw_key(seed, F.col(key), F.col("pos")), "pos")
    kept = detection_window(points, key).withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") <= cap).drop("_draw")
    order = Window.partitionBy(key).orderBy("mjd", "pos")
    return kept.withColumn("rank", F.row_number().over(order)).withColumn("t", F.col("mjd") - F.first("mjd").over(order))


def pad_points(prepared: DataFrame, length: int, key: str = "object_id") -> DataFrame:
    """Arrays of a fixed length per object in time order, and a mask that is true on padding."""
    fields = ["t", "flux", "err", "band_id"]
    rows = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    out = prepared.where(F.col("rank") <= length).groupBy(key).agg(rows.alias("_r"))
    room = F.lit(length) - F.size("_r")
    arrays = [F.concat(F.col(f"_r.{f}").cast("array<double>"), F.array_repeat(F.lit(0.0), room)).alias(f) for f in fields]
    return out.select(key, *arrays, F.concat(F.array_repeat(F.lit(False), F.size("_r")), F.array_repeat(F.lit(True), room)).alias("mask"), F.size("_r").alias("n_points"))


def table_facts(points: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, n, span) of accepted points."""
    return points.where("used").groupBy(key).agg(F.count("*").alias("n"), (F.max("mjd") - F.min("mjd")).alias("span"))


def peak_facts(points: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, band, peak_time, peak_mag): point of greatest signed flux per band, the earlier at a tie, time from the first point."""
    zero = points.where("used").groupBy(key).agg(F.min("mjd").alias("_t0"))
    best = points.where("used").groupBy(key, band_name(F.col("band_id")).alias("band")).agg(F.max(F.struct("flux", (-F.col("mjd")).alias("t"), (-F.col("pos")).alias("p"))).alias("_b"))
    return best.join(zero, key).select(key, "band", (-F.col("_b.t") - F.col("_t0")).alias("peak_time"), magnitude(F.col("_b.flux")).alias("peak_mag"))


def photometry_summary(points: DataFrame, key: str = "object_id") -> DataFrame:
    """Per object: baseline, counts per band, the largest gap with its ends, and per band the brightest point.

    Times are days from the first accepted point. A brightest point has positive flux; magnitude, then time, orders
    them; its magnitude, error and time are null in a band without one. The gap of a single point is 0 from 0 to 0.
    """
    order = Window.partitionBy(key).orderBy("mjd", "pos")
    since = F.col("mjd") - F.first("mjd").over(order)
    used = points.where("used").withColumn("_t", since).withColumn("_before", F.lag("_t").over(order)).withColumn("_band", band_name(F.col("band_id")))
    bright = F.struct(magnitude(F.col("flux")).alias("mag"), F.col("_t").alias("day"), magnitude_error(F.col("flux"), F.col("err")).alias("error"))
    best = lambda band: F.min(F.when((F.col("flux") > 0) & ~F.isnan("flux") & (F.col("_band") == band), bright)).alias(f"_{band}")
    zero = F.lit(0.0)
    return used.groupBy(key).agg(
        F.max("_t").alias("baseline"),
        F.count_if(F.col("_band") == "g").alias("n_g"),
        F.count_if(F.col("_band") == "r").alias("n_r"),
        F.max(F.when(F.col("_before").isNotNull(), F.struct((F.col("_t") - F.col("_before")).alias("size"), F.col("_before").alias("start"), F.col("_t").alias("end")))).alias("_gap"),
        best("g"),
        best("r"),
    ).select(
        key, "baseline", "n_g", "n_r", F.coalesce("_gap.size", zero).alias("largest_gap"), F.coalesce("_gap.start", zero).alias("gap_start"), F.coalesce("_gap.end", zero).alias("gap_end"),
        *[F.col(f"_{band}.{field}").alias(f"{field}_{band}") for band in ("g", "r") for field in ("mag", "error", "day")],
    )


HEADER = "TIME_DAYS BAND FLUXCAL FLUXCAL_ERR DIFF_MAG DIFF_MAG_ERR"


def table_lines(t: Column, band: Column, flux: Column, err: Column, decimals: int = 5, absent: str = "nan") -> Column:
    """One line of a photometry table with fixed decimals."""
    number = lambda c: F.coalesce(F.format_string(f"%.{decimals}f", c.cast("double")), F.lit(absent)) if c is not None else F.lit(absent)
    shown = lambda c: F.when(c.isNull(), F.lit(absent)).otherwise(number(c))
    return F.concat_ws(" ", number(t), band, number(flux), number(err), shown(magnitude(flux)), shown(magnitude_error(flux, err)))


def render_table(points: DataFrame, key: str = "object_id", decimals: int = 5, absent: str = "nan", header: bool = True) -> DataFrame:
    """(key, table): a header and one line per accepted point in time order."""
    order = Window.partitionBy(key).orderBy("mjd", "pos")
    rows = points.where("used").withColumn("_n", F.row_number().over(order)).withColumn("_t", F.col("mjd") - F.first("mjd").over(order))
    line = table_lines(F.col("_t"), band_name(F.col("band_id")), F.col("flux"), F.col("err"), decimals, absent)
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]))
    return rows.groupBy(key).agg((F.concat(F.lit(HEADER + "\n"), body) if header else body).alias("table"))


def parse_table(df: DataFrame, key: str, table: str) -> DataFrame:
    """(key, pos, time, band, flux, err, mag, mag_err) of rendered tables; rows without six fields have ``ok`` false."""
    lines = df.select(key, F.posexplode(F.split(F.regexp_replace(table, f"^{HEADER}\n", ""), "\n")).alias("pos", "_l"))
    parts = lines.withColumn("_f", F.split("_l", " "))
    number = lambda i: F.when(F.get("_f", F.lit(i)).isin("nan", "NA"), None).otherwise(F.try_element_at("_f", F.lit(i + 1)).try_cast("double"))
    return parts.select(key, "pos", number(0).alias("time"), F.get("_f", F.lit(1)).alias("band"), number(2).alias("flux"), number(3).alias("err"), number(4).alias("mag"), number(5).alias("mag_err"), (F.size("_f") == 6).alias("ok"))


def score_spans(claims: DataFrame, facts: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, abs_error, rel_error) of claimed durations (key, duration) against spans; relative error is null where the span is 0."""
    out = claims.join(facts, key)
    off = F.abs(F.col("duration") - F.col("span"))
    return out.select(key, off.alias("abs_error"), F.try_divide(off, "span").alias("rel_error"))


def claim_error_summary(errors: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n, mean, median, p90) of error columns without their sign, quantiles exact by linear interpolation."""
    long = errors.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.abs(F.col(c)).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*").where("v IS NOT NULL")
    spans = exact_quantiles(long, "metric", "v", [0.5, 0.9]).groupBy("metric").pivot("quantile", [0.5, 0.9]).agg(F.first("value"))
    means = long.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    return means.join(spans, "metric").select("metric", "n", "mean", F.round("`0.5`", 6).alias("median"), F.round("`0.9`", 6).alias("p90"))


def claim_validation_totals(extracted: DataFrame, reviewed: DataFrame, key: str = "object_id") -> DataFrame:
    """(kind, n_extracted, n_reviewed, n_equal): claim counts of both tables (key, kind, n) and objects where they agree."""
    both = extracted.select(key, "kind", F.col("n").alias("e")).join(reviewed.select(key, "kind", F.col("n").alias("r")), [key, "kind"], "full_outer")
    e, r = F.coalesce("e", F.lit(0)), F.coalesce("r", F.lit(0))
    return both.groupBy("kind").agg(F.sum(e).cast("long").alias("n_extracted"), F.sum(r).cast("long").alias("n_reviewed"), F.count_if(e == r).alias("n_equal"))
