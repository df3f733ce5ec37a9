"""Cleansing of object tables: identifiers, duplicates, labels, availability flags, groups.

Order matters wherever "first" or "last" is meant, so every such operator takes its tie-break column explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.columns import canonical_id, clean_quotes, refuse, strip


def canonicalize_ids(df: DataFrame, key: str = "object_id") -> DataFrame:
    """Canonical ids; a row without an id stops the job that reads it (see :func:`id_report` for counts)."""
    return df.withColumn(key, F.when(F.col(key).isNull(), refuse("a row has no " + key)).otherwise(canonical_id(F.col(key))))


def id_report(df: DataFrame, key: str = "object_id") -> DataFrame:
    """One row: rows, null ids, rows rewritten, spellings and objects."""
    clean = canonical_id(F.col(key))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(key).isNull()).alias("n_null"),
        F.count_if(clean != F.col(key).cast("string")).alias("n_rewritten"),
        F.count_distinct(F.col(key).cast("string")).alias("n_spellings"),
        F.count_distinct(clean).alias("n_objects"),
    )


def propagate_first(df: DataFrame, key: str, col: str, order: str) -> DataFrame:
    """Every row of an object gets the first non-null value of ``col`` among its rows."""
    first = df.where(F.col(col).isNotNull()).groupBy(key).agg(F.min_by(col, order).alias("_first"))
    return df.join(first, key, "left").withColumn(col, F.coalesce(col, "_first")).drop("_first")


def dedup_closest(df: DataFrame, key: str, distance: str, order: str) -> DataFrame:
    """One row per object: least distance, nulls last, then ``order``."""
    rank = Window.partitionBy(key).orderBy(F.asc_nulls_last(distance), F.asc(order))
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """One row: objects with several rows, and rows that deduplication would drop."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") > 1).alias("n_duplicated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_dropped"))


def standardize(df: DataFrame, renames: dict[str, str], flags: list[str]) -> DataFrame:
    """Common column names, and a true flag for each modality of the source."""
    return df.withColumnsRenamed(renames).withColumns({f"has_{f}": F.lit(True) for f in flags})


def modalities(df: DataFrame) -> list[str]:
    return [c[4:] for c in df.columns if c.startswith("has_")]


def availability_flags(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """All has_ columns exist and are never null."""
    names = dict.fromkeys([*modalities(df), *required])
    present = set(df.columns)
    return df.withColumns({f"has_{m}": F.coalesce(F.col(f"has_{m}"), F.lit(False)) if f"has_{m}" in present else F.lit(False) for m in names})


def with_tier(df: DataFrame) -> DataFrame:
    """joint with two modalities or more, else single."""
    have = sum((F.col(f"has_{m}").cast("int") for m in modalities(df)), F.lit(0))
    return df.withColumn("tier", F.when(have >= 2, "joint").otherwise("single"))


def exclude_modality(manifest: DataFrame, bad: DataFrame, modality: str, key: str = "object_id") -> DataFrame:
    """Objects in ``bad`` lose a modality; tiers follow."""
    marked = manifest.join(bad.select(key).distinct().withColumn("_bad", F.lit(True)), key, "left")
    flag = f"has_{modality}"
    return with_tier(marked.withColumn(flag, F.col(flag) & F.col("_bad").isNull()).drop("_bad"))


def light_columns(df: DataFrame, heavy: tuple[str, ...], key: str = "object_id") -> DataFrame:
    """Without heavy array columns; id, flags and tier come first."""
    lead = [key, *[f"has_{m}" for m in modalities(df)], *[c for c in ("tier", "split") if c in df.columns]]
    return df.select(*lead, *[c for c in df.columns if c not in lead and c not in heavy])


def clean_captions(df: DataFrame, col: str, key: str, order: str) -> DataFrame:
    """(key, caption): trimmed, not empty, the first per object."""
    text = df.select(key, order, strip(F.col(col)).alias("caption")).where("caption <> ''")
    return text.groupBy(key).agg(F.min_by("caption", order).alias("caption"))


def extract_quotes(df: DataFrame, key: str, order: str, quote: Column, least: int = 20) -> DataFrame:
    """(key, quotes): clean quotes of all rows of an object in row order, equal ones once.

    ``quote`` is a text, an array of texts, or an array of structs with a field ``quote``.
    """
    kind = df.select(quote.alias("q")).schema["q"].dataType.simpleString()
    if kind.startswith("array<struct"):
        quote = F.transform(quote, lambda q: q["quote"])
    elif not kind.startswith("array"):
        quote = F.array(quote)
    long = df.select(key, order, F.posexplode(clean_quotes(F.filter(quote, lambda q: q.isNotNull()), least)).alias("_at", "quote"))
    first = long.groupBy(key, "quote").agg(F.min(F.struct(order, "_at")).alias("_where"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_where", "quote"))).alias("_q")).select(key, F.transform("_q", lambda q: q["quote"]).alias("quotes"))


def prepare_groups(df: DataFrame, key: str, surveys: list[str], limit: int = 0, ids: list[str] | None = None, survey: str = "survey") -> DataFrame:
    """Rows of whole objects, up to ``limit`` objects in key order (0: all), with canonical keys and known surveys.

    A null or empty key and a null or unknown survey stop the job that reads the row, whether it is asked for or not.
    Requested ids are made canonical; unknown ones are an error, and so is a selection of nothing.
    """
    if limit < 0:
        raise ValueError("limit can't be negative")
    lost = [c for c in (key, survey) if c not in df.columns]
    if lost:
        raise ValueError(f"columns {lost} are missing")
    rows = canonicalize_ids(df, key)
    name = F.lower(strip(F.col(survey)))
    checked = F.when(F.col(key) == "", refuse("a row has an empty " + key)).otherwise(F.col(key))
    # Both checks are in the key, which every use reads.
    checked = F.when(name.isNull() | ~name.isin(surveys), refuse(f"a row's {survey} is none of {surveys}")).otherwise(checked)
    rows = rows.withColumn(key, checked).withColumn(survey, name)
    if ids is not None:
        wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` string").select(canonical_id(F.col(key)).alias(key)).distinct()
        unknown = [r[0] for r in wanted.join(rows, key, "left_anti").limit(5).collect()]
        if unknown:
            raise ValueError(f"unknown ids: {unknown}")
        rows = rows.join(wanted, key, "left_semi")
    if limit:
        rows = rows.join(rows.select(key).distinct().orderBy(key).limit(limit), key, "left_semi")
    if rows.isEmpty():
        raise ValueError("no objects selected")
    return rows


def group_digest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest): SHA-256 over the sorted digests of an object's rows, so that row order doesn't matter.

    Numbers that aren't finite count as null, in arrays too.
    """
    kinds = dict(df.dtypes)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    plain = {"double": finite, "float": finite, "array<double>": lambda c: F.transform(c, finite), "array<float>": lambda c: F.transform(c, finite)}
    names = [plain.get(kinds[n], lambda c: c)(F.col(n)).alias(n) for n in sorted(columns)]
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    return df.select(key, row.alias("_row")).groupBy(key).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("_row"))), 256).alias("digest"))


def caption_eligibility(df: DataFrame, quotes: str, n_observations: str, n_points: str, least: int = 10) -> Column:
    """Why an object gets no caption, or ``eligible``."""
    del df
    return (
        F.when(F.coalesce(F.size(quotes), F.lit(0)) <= 0, "no_quotes")
        .when(F.coalesce(n_observations, F.lit(0)) == 0, "no_observation")
        .when(F.col(n_points).isNull(), "invalid_spectrum")
        .when(F.col(n_points) < least, "too_few_points")
        .otherwise("eligible")
    )
