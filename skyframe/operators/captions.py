"""Captions from claims, and the gates that they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.checks import leaking_claims


def compose_captions(claims: DataFrame, available: DataFrame, key: str = "object_id", order: str = "claim_pos") -> DataFrame:
    """(key, subset, text, n_claims, claims): a caption for each single modality, and one for the full set.

    A single-modality caption takes the claims supported by exactly it; the full-set caption of an object with two
    modalities or more takes every claim whose support lies inside the set. Partial sets get none. ``available`` has
    (key, subset): the sorted modalities of each object.
    """
    sets = available.where(F.size("subset") > 1).groupBy(key).agg(F.collect_list("subset").alias("_sets"))
    alone = F.when(F.size("supporting") == 1, F.array("supporting")).otherwise(F.array().cast("array<array<string>>"))
    inside = F.filter(F.coalesce("_sets", F.array().cast("array<array<string>>")), lambda s: F.size(F.array_except("supporting", s)) == 0)
    both = claims.join(sets, key, "left").withColumn("subset", F.explode(F.concat(alone, inside)))
    parts = F.array_sort(F.collect_list(F.struct(order, "text", "supporting")))
    return both.groupBy(key, "subset").agg(F.concat_ws(" ", F.transform(parts, lambda p: p["text"])).alias("text"), F.count("*").alias("n_claims"), F.transform(parts, lambda p: F.struct(p["text"].alias("text"), p["supporting"].alias("supporting"))).alias("claims"))


def assemble_captions(text_claims: DataFrame, vetted: list[tuple[str, DataFrame]], available: DataFrame, key: str = "object_id") -> DataFrame:
    """Relational claims from text plus one vetted caption per modality as a claim of its own, then composed.

    ``vetted`` lists (modality, table of (key, caption)).
    """
    relations = text_claims.where("kind = 'relation'").select(key, F.col("claim_pos").cast("long").alias("claim_pos"), "text", "supporting")
    every = relations
    for place, (modality, table) in enumerate(vetted):
        own = table.select(key, F.lit(place - 1_000_000).cast("long").alias("claim_pos"), F.col("caption").alias("text"), F.array(F.lit(modality)).alias("supporting"))
        every = every.unionByName(own)
    return compose_captions(every, available, key)


def caption_report(captions: DataFrame, claims: DataFrame, sentences: DataFrame, objects: DataFrame, key: str = "object_id") -> DataFrame:
    """One row: captions, captioned objects, leaking claims, sentences, surviving claims and their share, claims by kind, objects without text.

    ``sentences`` has a row for each sentence of the source texts, ``claims`` one for each that became a claim; without
    sentences the share is 0. ``captions`` have key, subset and claims (an array with ``text`` and ``supporting``).
    """
    outside = F.filter("claims", lambda c: F.size(F.array_except(c["supporting"], F.col("subset"))) > 0)
    # Leaking claims as leaking_claims lists them, counted in the same pass as the captions.
    per = captions.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.size(outside), F.lit(0))).alias("_leaks"))
    a = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_captions"), F.count(key).alias("n_captioned"), F.coalesce(F.sum("_leaks"), F.lit(0)).alias("n_leakage_violations"))
    b = claims.agg(F.count("*").alias("n_claims"), F.count_if(F.col("kind") == "relation").alias("n_relations"), F.count_if(F.col("kind") == "observation").alias("n_observations"))
    c = objects.agg(F.count_distinct(key).alias("n_objects"))
    d = sentences.agg(F.count("*").alias("n_sentences"))
    out = a.join(b, how="cross").join(c, how="cross").join(d, how="cross")  # single rows
    out = out.select(*[x for x in out.columns if x != "n_leakage_violations"], "n_leakage_violations")
    share = F.coalesce(F.round(F.try_divide("n_claims", "n_sentences"), 6), F.lit(0.0))
    return out.withColumn("n_without_text", F.col("n_objects") - F.col("n_captioned")).withColumn("survival_rate", share)


def match_rates(available: DataFrame, captioned: DataFrame, key: str = "object_id") -> DataFrame:
    """(modality, n_available, n_matched, n_unmatched, match_rate, n_foreign): captions of a modality against the objects that have it.

    Both tables have (key, modality). ``n_foreign`` counts captions of objects that don't have the modality.
    """
    have = available.select(key, "modality").distinct().withColumn("_have", F.lit(1))
    both = have.join(captioned.select(key, "modality").distinct().withColumn("_cap", F.lit(1)), [key, "modality"], "full_outer")
    out = both.groupBy("modality").agg(F.count("_have").alias("n_available"), F.count(F.when(F.col("_have").isNotNull(), F.col("_cap"))).alias("n_matched"), F.count_if(F.col("_have").isNull()).alias("n_foreign"))
    return out.select("modality", "n_available", "n_matched", (F.col("n_available") - F.col("n_matched")).alias("n_unmatched"), F.round(F.try_divide("n_matched", "n_available"), 6).alias("match_rate"), "n_foreign")


def joint_claim_fraction(claims: DataFrame) -> DataFrame:
    """One row: share of claims with more than one supporting modality."""
    return claims.agg(F.round(F.avg((F.size("supporting") > 1).cast("int")), 6).alias("joint_fraction"))


def diversity_gate(captions: DataFrame, text: str = "text", least: float = 0.8, most_common: float = 0.05) -> DataFrame:
    """One row: captions, distinct ones, their share, the share and start of the most common caption, and ``passed``."""
    counts = captions.groupBy(text).agg(F.count("*").alias("n"))
    top = counts.agg(F.sum("n").alias("n_captions"), F.count("*").alias("n_distinct"), F.max(F.struct("n", F.col(text).alias("t"))).alias("_top"))
    share, common = F.col("n_distinct") / F.col("n_captions"), F.col("_top.n") / F.col("n_captions")
    allowed = F.greatest(F.lit(most_common), 1.5 / F.col("n_captions"))
    return top.select("n_captions", "n_distinct", F.round(share, 6).alias("distinct_share"), F.round(common, 6).alias("top_share"), F.substring("_top.t", 1, 200).alias("top_text"), ((share >= least) & (common <= allowed)).alias("passed"))


def change_gate(pairs: DataFrame, a: str, b: str, least_distance: float = 3.0, least_changed: float = 0.1) -> DataFrame:
    """One row: mean edit distance and share of changed outputs, and whether each is a null result."""
    out = pairs.agg(F.avg(F.levenshtein(a, b)).alias("_d"), F.avg((F.col(a) != F.col(b)).cast("int")).alias("_c"))
    return out.select(F.round("_d", 6).alias("mean_distance"), F.round("_c", 6).alias("changed_share"), (F.col("_d") < least_distance).alias("null_distance"), (F.col("_c") < least_changed).alias("null_changed"))


def usable_captions(captions: DataFrame, key: str, subset: str, claims: str) -> DataFrame:
    """Captions without leaking claims."""
    bad = leaking_claims(captions, key, subset, claims).select(key).distinct()
    return captions.join(bad, key, "left_anti")


def mentions_summary(df: DataFrame, key: str, mention: str, quotes: str) -> DataFrame:
    """(key, n_mentions, n_quotes)."""
    return df.groupBy(key).agg(F.count_distinct(mention).alias("n_mentions"), F.sum(F.size(quotes)).alias("n_quotes"))


def build_record(df: DataFrame, sentinel: str, key: str = "object_id") -> DataFrame:
    """Nested output record of a caption job: coordinates with fallbacks, survey, input summary, output, usage.

    Needs key, ra, dec, ra_fallback, dec_fallback, survey, n_quotes, n_mentions, caption, input_tokens, output_tokens.
    """
    blank = F.coalesce(F.trim("caption"), F.lit("")) == ""
    insufficient = blank | (F.trim("caption") == sentinel)
    return df.select(
        key,
        F.struct(F.coalesce("ra", "ra_fallback").alias("ra"), F.coalesce("dec", "dec_fallback").alias("dec"), F.lower("survey").alias("survey")).alias("object"),
        F.struct("n_quotes", "n_mentions").alias("input"),
        F.struct(F.when(~blank, F.col("caption")).alias("caption"), insufficient.alias("is_insufficient")).alias("output"),
        F.struct("input_tokens", "output_tokens").alias("usage"),
    )


def tier_histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def availability_histogram(df: DataFrame) -> DataFrame:
    """(combination, n): objects per set of modalities, a+b or none."""
    from skyframe.operators.clean import modalities

    names = sorted(modalities(df))
    joined = F.concat_ws("+", *[F.when(F.col(f"has_{m}"), m) for m in names])
    return df.groupBy(F.when(joined == "", "none").otherwise(joined).alias("combination")).agg(F.count("*").alias("n"))


def only_counts(df: DataFrame) -> DataFrame:
    """(modality, n): objects that have exactly this one."""
    from skyframe.operators.clean import modalities

    names = sorted(modalities(df))
    have = sum((F.col(f"has_{m}").cast("int") for m in names), F.lit(0))
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), (F.col(f"has_{m}") & (have == 1)).cast("int").alias("one")) for m in names]))
    return df.select(stacked.alias("m")).groupBy("m.modality").agg(F.sum("m.one").cast("long").alias("n"))


def split_balance(df: DataFrame, by: str = "survey", splits: tuple[str, ...] = ("train", "val", "test"), least: int = 50) -> DataFrame:
    """Counts per group and split, the train share, and a flag for large groups with less than half in train."""
    out = df.groupBy(by).pivot("split", list(splits)).count().na.fill(0, list(splits))
    total = sum((F.col(s) for s in splits), F.lit(0))
    share = F.try_divide(F.col("train"), total)
    return out.select(by, *[F.col(s).cast("long").alias(s) for s in splits], F.round(share, 6).alias("train_share"), ((total >= least) & (share < 0.5)).alias("unbalanced"))


def class_weights(df: DataFrame, label: str, vocabulary: list[str]) -> DataFrame:
    """(label, weight): n / (k * count); a class without rows is an error."""
    from skyframe.operators.checks import ValidationError

    counts = df.where(F.col(label).isin(vocabulary)).groupBy(label).agg(F.count("*").alias("n"))
    if counts.count() != len(vocabulary):
        raise ValidationError("a class has no rows")
    total = F.sum("n").over(Window.partitionBy())  # one row for each class
    return counts.select(label, "n", (total / (len(vocabulary) * F.col("n"))).alias("weight"))
