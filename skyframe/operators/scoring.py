"""Scores of predictions: confusion, F1, groups, soft votes, sets of labels.

Vocabularies are parameters of a few labels, so tables of label pairs stay small whatever the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNPARSED = "(unparsed)"


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[str], fold_case: bool = False) -> DataFrame:
    """One row per true label, a column of counts per predicted label, and one for unparsed predictions.

    Rows whose true label isn't known are left out.
    """
    t, p = F.col(truth), F.col(predicted)
    if fold_case:
        back = F.create_map(*[F.lit(x) for v in labels for x in (v.lower(), v)])
        t, p = F.try_element_at(back, F.lower(F.trim(t))), F.try_element_at(back, F.lower(F.trim(p)))
    rows = df.select(t.alias("truth"), F.when(p.isin(labels), p).otherwise(UNPARSED).alias("_p")).where(F.col("truth").isin(labels))
    counts = rows.groupBy("truth").pivot("_p", [*labels, UNPARSED]).count()
    spine = df.sparkSession.createDataFrame([(v,) for v in labels], "truth string")
    return spine.join(counts, "truth", "left").na.fill(0, [*labels, UNPARSED])


def accuracy(df: DataFrame, truth: str, predicted: str, fold_case: bool = False) -> DataFrame:
    """One row: rows, correct ones and their share; unparsed is wrong."""
    t, p = F.col(truth), F.col(predicted)
    same = F.lower(F.trim(t)) == F.lower(F.trim(p)) if fold_case else t == p
    ok = F.coalesce(same, F.lit(False)).cast("int")
    return df.agg(F.count("*").alias("n"), F.sum(ok).cast("long").alias("n_correct"), F.round(F.avg(ok), 6).alias("accuracy"))


def classification_report(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """(label, precision, recall, f1, support) of every label of the vocabulary; 0 where a rate is 0/0."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.lit(v) for v in labels])).alias("label")
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = pairs.select("*", each).groupBy("label").agg(
        hit((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"),
        hit(F.col("p") == F.col("label")).alias("n_predicted"),
        hit(F.col("t") == F.col("label")).alias("support"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.select("label", rate(F.col("tp"), F.col("n_predicted")).alias("precision"), rate(F.col("tp"), F.col("support")).alias("recall"), "support", "n_predicted")
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def benchmark_metrics(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row: n, accuracy, macro F1 over the vocabulary, balanced accuracy, parse rate, unparsed."""
    per = classification_report(df, truth, predicted, labels).agg(F.avg("f1").alias("f"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("b"))
    parsed = F.coalesce(F.col(predicted).isin(labels), F.lit(False)).cast("int")
    ok = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)).cast("int")
    whole = df.agg(F.count("*").alias("n"), F.avg(ok).alias("a"), F.avg(parsed).alias("p"), F.sum(1 - parsed).cast("long").alias("n_unparsed"))
    out = whole.join(per, how="cross")  # single rows
    return out.select("n", F.round("a", 6).alias("accuracy"), F.round("f", 6).alias("macro_f1"), F.round("b", 6).alias("balanced_accuracy"), F.round("p", 6).alias("parse_rate"), "n_unparsed")


def group_report(df: DataFrame, truth: str, predicted: str, groups: dict[str, str]) -> DataFrame:
    """(group, n, score): 1 for the label, 0.5 for its group, else 0; group ``all`` is the whole."""
    of = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    t, p = F.try_element_at(of, F.col(truth)), F.try_element_at(of, F.col(predicted))
    score = F.when(F.col(truth) == F.col(predicted), 1.0).when(t == p, 0.5).otherwise(0.0)
    rows = df.select(t.alias("group"), score.alias("score"))
    spine = df.sparkSession.createDataFrame([(g,) for g in [*sorted(set(groups.values())), "all"]], "group string")
    both = rows.where("group IS NOT NULL").unionByName(rows.withColumn("group", F.lit("all"))).groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))
    return spine.join(both, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("n"), "score")


def condition_margin(value: Column, mask: Column, op: str, limit: float) -> Column:
    """How far a vote fraction is beyond a limit, from 0 to 1; null if masked or missing."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if op == ">":
        raw = value if limit >= 1 else (value - limit) / (1 - limit)
    else:
        raw = (limit - value) / limit if limit > 0 else -value
    known = value.isNotNull() & ~F.isnan(value) & ~F.coalesce(mask, F.lit(True))
    return F.when(known, clip(raw))


def class_margin(terms: list[list[Column]]) -> Column:
    """Least over terms of the greatest known margin in each; null if a term has none."""
    best = [F.greatest(*t) if len(t) > 1 else t[0] for t in terms]
    unknown = reduce(lambda a, b: a | b, [b.isNull() for b in best])
    return F.when(~unknown, F.least(*best) if len(best) > 1 else best[0])


def soft_score(margins: dict[str, Column], truth: Column, predicted: Column) -> Column:
    """Margin of the predicted class over that of the true class, clipped to 1; null where excluded."""
    table = F.create_map(*[x for k, v in margins.items() for x in (F.lit(k), v)])
    own, got = F.try_element_at(table, truth), F.try_element_at(table, predicted)
    ok = own.isNotNull() & (own > 0) & predicted.isNotNull()
    return F.when(ok & (truth == predicted), 1.0).when(ok, F.least(F.lit(1.0), got / own))


def soft_status(margins: dict[str, Column], truth: Column, predicted: Column, matched: Column) -> Column:
    """Why a row is left out of the soft score, exclusively, or ``scored``."""
    table = F.create_map(*[x for k, v in margins.items() for x in (F.lit(k), v)])
    own, got = F.try_element_at(table, truth), F.try_element_at(table, predicted)
    return F.when(~F.coalesce(matched, F.lit(False)), "unmatched").when(predicted.isNull(), "unparsed").when(own.isNull() | (own <= 0), "true_margin").when((truth != predicted) & got.isNull(), "predicted_margin").otherwise("scored")


def soft_report(df: DataFrame, score: Column, status: Column) -> DataFrame:
    """One row: mean soft score, scored rows and four exclusion counts."""
    rows = df.select(score.alias("s"), status.alias("st"))
    counts = [F.count_if(F.col("st") == k).alias(f"n_{k}") for k in ("scored", "unmatched", "unparsed", "true_margin", "predicted_margin")]
    return rows.agg(F.round(F.avg(F.when(F.col("st") == "scored", F.col("s"))), 6).alias("mean_score"), *counts)


def margin_block(df: DataFrame, margins: Column, low: float = 0.5) -> DataFrame:
    """One row: mean margin between the two best answers and the number of narrow ones."""
    rows = df.select(margins.alias("m")).where("m IS NOT NULL")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean_margin"), F.count_if(F.col("m") < low).alias("n_narrow"))


def set_scores(truth: Column, predicted: Column) -> dict[str, Column]:
    """Jaccard, recall and perfect match of two label sets; a null prediction is the empty set."""
    p = F.coalesce(predicted, F.array().cast("array<string>"))
    both, either = F.size(F.array_intersect(truth, p)), F.size(F.array_union(truth, p))
    return {
        "jaccard": F.when(either == 0, 1.0).otherwise(F.try_divide(both, either)),
        "recall": F.when(F.size(truth) == 0, (F.size(p) == 0).cast("double")).otherwise(F.try_divide(both, F.size(F.array_distinct(truth)))),
        "perfect": ((both == either)).cast("double"),
    }


def multilabel_report(df: DataFrame, truth: str, predicted: str, by: str | None = None) -> DataFrame:
    """Mean Jaccard, recall and perfect-match rate, per group if asked."""
    scores = set_scores(F.col(truth), F.col(predicted))
    rows = df.select(*([by] if by else []), *[c.alias(n) for n, c in scores.items()])
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in scores]]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def regime_report(df: DataFrame, truth: str, predicted: str, regime: str = "regime") -> DataFrame:
    """Jaccard per regime, with the perfect rate for pure_negative and the recall for high_snr_positive."""
    out = multilabel_report(df, truth, predicted, regime)
    return out.select(regime, "n", "jaccard", F.when(F.col(regime) == "pure_negative", F.col("perfect")).alias("perfect"), F.when(F.col(regime) == "high_snr_positive", F.col("recall")).alias("recall"))


def caption_diagnostics(df: DataFrame, caption: str, parsed: str, forced: str) -> DataFrame:
    """One row: mean characters and words, parse-success and fallback rates."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(caption), F.lit("")), r"\s+"), lambda w: w != ""))
    return df.agg(F.round(F.avg(F.length(F.coalesce(F.col(caption), F.lit("")))), 6).alias("mean_chars"), F.round(F.avg(words), 6).alias("mean_words"), F.round(F.avg(F.coalesce(F.col(parsed), F.lit(False)).cast("int")), 6).alias("parse_rate"), F.round(F.avg(F.coalesce(F.col(forced), F.lit(False)).cast("int")), 6).alias("fallback_rate"))


def leaderboard(results: DataFrame, baseline: str) -> DataFrame:
    """(model, task, score, delta) with the difference to the baseline model."""
    base = results.where(F.col("model") == baseline).select("task", F.col("score").alias("_base"))
    return results.join(base, "task", "left").select("model", "task", "score", F.round(F.col("score") - F.col("_base"), 6).alias("delta"))


def regime_table(results: DataFrame, regimes: list[str]) -> DataFrame:
    """Wide: one row per model, a score column per regime."""
    return results.groupBy("model").pivot("regime", regimes).agg(F.first("score"))


def redshift_labels(df: DataFrame, bins: str, z: str) -> DataFrame:
    """(bin, mean_z, letter): bins in order of their mean redshift, lettered from A."""
    from pyspark.sql import Window

    means = df.groupBy(bins).agg(F.avg(z).alias("mean_z"))
    at = F.row_number().over(Window.partitionBy().orderBy("mean_z", bins))  # a few bins
    return means.select(bins, F.round("mean_z", 6).alias("mean_z"), F.chr(at + 64).alias("letter"))


def lines_by_snr(df: DataFrame, key: str, label: str, snr: str) -> DataFrame:
    """(key, lines): labels with their SNR, strongest first."""
    parts = F.array_sort(F.collect_list(F.struct((-F.col(snr)).alias("s"), F.col(label).alias("l"))))
    return df.groupBy(key).agg(F.transform(parts, lambda x: F.format_string("%s (SNR: %.1f)", x["l"], -x["s"])).alias("lines"))
