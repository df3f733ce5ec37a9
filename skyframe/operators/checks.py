"""Validators: each returns the rows that break a rule, so that they can be counted, kept or turned into an error.

:func:`require_empty` is the strict form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """A table breaks a rule."""


def require_empty(violations: DataFrame, rule: str, show: int = 5) -> None:
    """Raise with a few examples if there are violations."""
    found = violations.limit(show).collect()
    if found:
        raise ValidationError(f"{rule}: {[tuple(r) for r in found]}")


def not_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row, and their row counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both tables."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def wrong_accepted_counts(df: DataFrame, use: str, length: str, key: str = "object_id") -> DataFrame:
    """Objects whose number of accepted points isn't the stored length."""
    n = F.size(F.filter(use, lambda x: x))
    return df.select(key, n.alias("n_accepted"), F.col(length).alias("n_stored")).where("n_accepted <> n_stored OR n_stored IS NULL")


def misaligned(df: DataFrame, arrays: list[str], use: str, key: str = "object_id") -> DataFrame:
    """Objects whose arrays differ in length or that have no accepted point."""
    sizes = F.array_distinct(F.array(*[F.size(a) for a in arrays]))
    none = ~F.exists(use, lambda x: x)
    return df.select(key, (F.size(sizes) > 1).alias("uneven"), F.coalesce(none, F.lit(True)).alias("no_point")).where("uneven OR no_point")


def bad_texts(df: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """Blank, too long or repeated: (key, problem)."""
    blank = F.coalesce(F.regexp_replace(text, r"\s", ""), F.lit("")) == ""
    n = F.count("*").over(Window.partitionBy(key))
    marks = F.array_compact(F.array(F.when(blank, "blank"), F.when(F.length(text) > longest, "too_long"), F.when(n > 1, "duplicate")))
    return df.select(key, marks.alias("_marks")).select(key, F.explode("_marks").alias("problem"))


def wrong_class_counts(df: DataFrame, label: str, expected: dict[str, int]) -> DataFrame:
    """Classes whose row count isn't the expected one, missing and unexpected classes included."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{label} string, expected long")
    have = df.groupBy(label).agg(F.count("*").alias("found"))
    both = want.join(have, label, "full_outer")
    return both.select(label, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).where("expected <> found")


def unknown_labels(df: DataFrame, label: str, vocabulary: list[str]) -> DataFrame:
    """Rows whose label isn't in the vocabulary; null labels are unknown too."""
    return df.where(F.coalesce(~F.col(label).isin(vocabulary), F.lit(True)))


def incomplete(expected: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Keys that are missing from a ledger or extra in it: (key, problem)."""
    a, b = expected.select(key).distinct(), ledger.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("extra")))


def stale_records(ledger: DataFrame, expected: DataFrame, key: str, fields: list[str], failed: Column, print_field: str | None = None) -> DataFrame:
    """Records whose fields differ from the contract: (key, stale fields).

    Failed attempts with an old fingerprint in ``print_field`` are skipped: they will be made again.
    """
    joined = ledger.alias("l").join(expected.alias("e"), key)
    marks = [F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"e.{f}")), f) for f in fields]
    rows = joined.select(F.col(key), F.array_compact(F.array(*marks)).alias("stale"), failed.alias("_failed"))
    if print_field:
        rows = rows.where(~(F.coalesce("_failed", F.lit(False)) & F.array_contains("stale", print_field)))
    return rows.where("size(stale) > 0").select(key, F.array_join("stale", ",").alias("stale"))


def in_two_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def not_increasing(df: DataFrame, grid: str, key: str = "object_id") -> DataFrame:
    """Objects whose grid isn't strictly increasing, with the first place where it isn't."""
    steps = F.zip_with(F.slice(grid, 1, F.greatest(F.size(grid) - 1, F.lit(0))), F.slice(grid, 2, F.greatest(F.size(grid), F.lit(1))), lambda a, b: a < b)
    return df.select(key, (F.array_position(steps, False)).alias("first_bad")).where("first_bad > 0")


def leaking_claims(captions: DataFrame, key: str, subset: str, claims: str) -> DataFrame:
    """Claims supported by a modality that the caption's subset doesn't have."""
    each = captions.select(key, subset, F.explode(claims).alias("claim"))
    outside = F.array_except(F.col("claim.supporting"), F.col(subset))
    return each.where(F.size(outside) > 0).select(key, F.col("claim.text").alias("text"), F.array_join(F.array_sort(outside), "+").alias("outside"))


CLAIM_FIELDS = {"duration_days": ["value", "quote"], "peaks": ["band", "time_days", "magnitude", "quote"], "gaps": ["start_days", "end_days", "duration_days", "quote"]}


def bad_claims_json(df: DataFrame, key: str, col: str) -> DataFrame:
    """Breaches of the claims schema: (key, problem).

    Problems: not an object, unknown top field, unknown item field, value not a finite number, band not g or r, empty quote.
    """
    top = F.from_json(col, "map<string,string>")
    keys = F.map_keys(top)
    items = F.from_json(F.get_json_object(col, "$.peaks"), "array<map<string,string>>")
    gaps = F.from_json(F.get_json_object(col, "$.gaps"), "array<map<string,string>>")
    span = F.from_json(F.get_json_object(col, "$.duration_days"), "map<string,string>")
    # Numbers are told from quoted strings and booleans by their JSON text.
    number = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
    raw = {"peaks": F.from_json(F.get_json_object(col, "$.peaks"), "array<string>"), "gaps": F.from_json(F.get_json_object(col, "$.gaps"), "array<string>")}
    numeric = {"peaks": ["time_days", "magnitude"], "gaps": ["start_days", "end_days", "duration_days"]}

    def wrong_number(text: Column, field: str) -> Column:
        quoted = text.rlike(rf'"{field}"\s*:\s*"')
        value = F.get_json_object(text, f"$.{field}")
        return quoted | (value.isNotNull() & ~value.rlike(number))

    def any_wrong(name: str) -> Column:
        return F.exists(raw[name], lambda t: reduce(lambda a, b: a | b, [wrong_number(t, f) for f in numeric[name]]))

    def extra(rows: Column, name: str) -> Column:
        return F.exists(rows, lambda m: F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(f) for f in CLAIM_FIELDS[name]]))) > 0)

    def no_quote(rows: Column) -> Column:
        return F.exists(rows, lambda m: F.coalesce(F.trim(m["quote"]), F.lit("")) == "")

    span_text = F.get_json_object(col, "$.duration_days")
    tests = {
        "not_an_object": F.col(col).isNull() | top.isNull(),
        "unknown_field": F.size(F.array_except(keys, F.array(*[F.lit(k) for k in CLAIM_FIELDS]))) > 0,
        "unknown_item_field": extra(items, "peaks") | extra(gaps, "gaps") | (F.size(F.array_except(F.map_keys(span), F.array(F.lit("value"), F.lit("quote")))) > 0),
        "bad_number": any_wrong("peaks") | any_wrong("gaps") | wrong_number(span_text, "value"),
        "bad_band": F.exists(items, lambda m: ~F.coalesce(m["band"].isin("g", "r"), F.lit(False))),
        "empty_quote": no_quote(items) | no_quote(gaps) | (F.coalesce(F.trim(span["quote"]), F.lit("")) == "") & span.isNotNull(),
    }
    marks = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()]))
    return df.select(key, F.explode(marks).alias("problem"))


def unfounded_quotes(df: DataFrame, key: str, caption: str, quotes: str) -> DataFrame:
    """Quotes that aren't an exact part of the caption."""
    return df.select(key, caption, F.explode(quotes).alias("quote")).where(~F.contains(caption, F.col("quote"))).select(key, "quote")


def bad_table_rows(points: DataFrame, key: str, pos: str, time: str, band: str) -> DataFrame:
    """Rows of a photometry table with a wrong band or out of time order."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(pos))
    bad_band = ~F.coalesce(F.col(band).isin("g", "r"), F.lit(False))
    return points.select(key, pos, bad_band.alias("bad_band"), F.coalesce(F.col(time) < before, F.lit(False)).alias("out_of_order")).where("bad_band OR out_of_order")


def stale_cache_specs(index: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Encoder specs in an index that differ from the current one; an empty index has none."""
    wrong = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lit(v)) for k, v in spec.items()])
    return index.select(*spec).distinct().where(wrong)


def non_finite(df: DataFrame, emb: str, key: str = "object_id") -> DataFrame:
    """Rows with a NaN or an infinite value in a token array."""
    bad = F.exists(F.flatten(emb), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.coalesce(bad, F.lit(False))).select(key)
