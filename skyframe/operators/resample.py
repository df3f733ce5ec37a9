"""Bootstrap by cells.

All metrics here depend on a row only through a small cell: its score, its (true, predicted) pair, or its pair of
scores. So rows are counted by cell once, and each replicate draws cell counts from a multinomial: the distribution of
index resampling at a cost that doesn't depend on the number of rows. Replicates are spread over tasks; each has a
generator of its own seed, so results don't depend on the layout.

Cells of a group are dealt into blocks, and a replicate's draws are split between blocks by a tree of binomial draws, which
is the same multinomial however many cells and blocks there are: one way for every size, with exact totals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.operators.checks import ValidationError

#: Cells of a block, about.
LEAF = 2048
#: Replicates that a block draws at a time.
BLOCK = 500


def _replicates(spark, n: int, seed: int, draw: Callable[[np.random.Generator], dict[str, float]], names: list[str]) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"replicate": r, **draw(np.random.default_rng([seed, r]))} for r in b["id"]], columns=["replicate", *names])

    return spark.range(n).mapInPandas(run, ", ".join(["replicate long", *[f"`{c}` double" for c in names]]))


def _interval(reps: DataFrame, names: list[str], points: dict[str, float], extra: dict[str, int]) -> DataFrame:
    """(metric, value, low, high, ...) from replicates."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    one = reps.agg(*[q(c).alias(c) for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(float(points[c])).alias("value"), F.get(c, F.lit(0)).alias("low"), F.get(c, F.lit(1)).alias("high")) for c in names])).alias("m")
    return one.select(each).select("m.*", *[F.lit(v).alias(k) for k, v in extra.items()])


def bootstrap_ci(df: DataFrame, score: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """(metric, value, low, high, n): mean score with its 95 per cent interval; zeros without rows, the value with one."""
    known = df.select(F.lit(0).alias("_all"), F.col(score).alias("_score")).where("_score IS NOT NULL")
    if known.isEmpty():
        return df.sparkSession.createDataFrame([("mean", 0.0, 0.0, 0.0, 0)], "metric string, value double, low double, high double, n int")
    return bootstrap_by(known, "_score", "_all", replicates, seed).drop("_all")


#: Linear metrics by name: the weights of the columns' means.
Linear = dict[str, list[float]]
PAIRED: Linear = {"base": [1.0, 0.0], "treatment": [0.0, 1.0], "delta": [-1.0, 1.0]}


def _blocks(cells: DataFrame, width: int) -> DataFrame:
    """Cells with ``_total``, ``_depth`` and ``_block``, and with ``_path``: how a group's draws are split on the way to the block.

    A group of k cells has 2**depth blocks of about LEAF cells, told by the first bits of the cells' hashes, so that
    blocks follow from the cells alone. An entry of the path is a node of the binary tree over the blocks: its level and
    number, its weight, that of its left half, and whether the way goes right.
    """
    known = cells.where("_x0 IS NOT NULL")
    sizes = known.groupBy("_by").agg(F.count("*").alias("_k"), F.sum("_n").alias("_total"))
    sizes = sizes.select(F.col("_by").alias("_g"), "_total", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_k") / LEAF))).cast("int").alias("_depth"))
    bits = F.xxhash64(*[f"_x{k}" for k in range(width)])
    dealt = known.join(sizes, (F.col("_by") == F.col("_g"))).drop("_g").withColumn("_h", bits)
    dealt = dealt.withColumn("_block", F.when(F.col("_depth") > 0, F.expr("shiftrightunsigned(_h, 64 - _depth)")).otherwise(F.lit(0)).cast("long")).drop("_h")
    weights = dealt.where("_depth > 0").groupBy("_by", "_depth", "_block").agg(F.sum("_n").alias("_w"))
    at = weights.select("*", F.explode(F.sequence(F.lit(1), "_depth")).alias("_level")).withColumn("_child", F.expr("shiftright(_block, _depth - _level)")).withColumn("_node", F.shiftright("_child", 1))
    left = F.sum(F.when(F.col("_child") % 2 == 0, F.col("_w")).otherwise(0))
    nodes = at.groupBy(F.col("_by").alias("_g"), F.col("_level").alias("_l"), F.col("_node").alias("_m")).agg(F.sum("_w").alias("_whole"), left.alias("_left"))
    steps = at.join(nodes, (F.col("_by") == F.col("_g")) & (F.col("_level") == F.col("_l")) & (F.col("_node") == F.col("_m")))
    step = F.struct(F.col("_level").alias("level"), F.col("_node").alias("node"), F.col("_whole").alias("whole"), F.col("_left").alias("left"), (F.col("_child") % 2 == 1).alias("right"))
    paths = steps.groupBy(F.col("_by").alias("_g"), F.col("_block").alias("_b")).agg(F.array_sort(F.collect_list(step)).alias("_path"))
    return dealt.join(paths, (F.col("_by") == F.col("_g")) & (F.col("_block") == F.col("_b")), "left").drop("_g", "_b")


def _drawn(cells: DataFrame, width: int, replicates: int, seed: int, metrics: Linear) -> DataFrame:
    """(_by, replicate, each metric with an underscore) of multinomial draws over all cells of a group, ``_by`` being text.

    A block finds its number of draws by binomial splits from the root of its group's tree; generators are seeded by
    node, so all blocks below a node see the same split and totals are exact. Then it draws its own cells. Replicates'
    sums of all blocks are added up by Spark.
    """
    columns, weights = [f"_x{k}" for k in range(width)], np.array(list(metrics.values()))

    def run(table: pa.Table) -> pa.Table:
        one = lambda c: table[c][0].as_py()
        rows = table.select([*columns, "_n"]).to_pandas().sort_values(columns)
        values, counts = rows[columns].to_numpy(float) @ weights.T, rows["_n"].to_numpy()
        draws = np.full(replicates, one("_total"), np.int64)
        for step in one("_path") or ():
            left = np.random.default_rng([seed, 1, step["level"], step["node"]]).binomial(draws, step["left"] / step["whole"])
            draws = draws - left if step["right"] else left
        own = np.random.default_rng([seed, 2, one("_depth"), one("_block")])
        share = counts / counts.sum()
        sums = np.concatenate([own.multinomial(draws[k : k + BLOCK], share) @ values for k in range(0, replicates, BLOCK)]) / one("_total")
        out = {"_by": pa.array([one("_by")] * replicates, pa.string()), "replicate": pa.array(range(replicates), pa.int64())}
        return pa.table(out | {f"_{c}": pa.array(sums[:, k], pa.float64()) for k, c in enumerate(metrics)})

    each = _blocks(cells, width).groupBy("_by", "_block").applyInArrow(run, ", ".join(["_by string", "replicate long", *[f"`_{c}` double" for c in metrics]]))
    return each.groupBy("_by", "replicate").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in metrics])


def _grouped(df: DataFrame, columns: list[str], by: str, replicates: int, seed: int, metrics: Linear, empty: bool) -> DataFrame:
    """Per group: ``n``, and for each metric its value (``name``) and its two quantiles (``_name``), besides all replicates' ``delta <= 0`` if there is a delta.

    Cells of all groups are counted at once. Rows with a null among the columns count only as members of their group; a
    group without other rows has zeros, or is an error unless ``empty``.
    """
    known = F.lit(True)
    for c in columns:
        known = known & F.col(f"`{c}`").isNotNull()
    cells = df.select(F.col(by).alias("_by"), *[F.when(known, F.col(f"`{c}`")).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    cells = cells.groupBy(*cells.columns).agg(F.count("*").alias("_n"))
    if not empty and cells.groupBy("_by").agg(F.count("_x0").alias("_k")).where("_k = 0").limit(1).count():
        raise ValidationError("no pairs")
    if not empty and cells.isEmpty():
        raise ValidationError("no pairs")
    count = F.sum(F.when(F.col("_x0").isNotNull(), F.col("_n")).otherwise(0))
    mean = lambda w: F.coalesce(sum((F.sum(F.col(f"_x{k}") * F.col("_n")) * w[k] for k in range(len(columns))), F.lit(0.0)) / F.nullif(count, F.lit(0)), F.lit(0.0))
    points = cells.groupBy("_by").agg(count.cast("int").alias("n"), *[mean(w).alias(c) for c, w in metrics.items()])
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    gains = [F.avg((F.col("_delta") <= 0).cast("int")).alias("p_value")] if "delta" in metrics else []
    # A group of any type by its JSON text, which is never null.
    name = F.to_json(F.struct("_by"))
    spans = _drawn(cells.withColumn("_by", name), len(columns), replicates, seed, metrics).groupBy(F.col("_by").alias("_g")).agg(*[q(f"_{c}").alias(f"_{c}") for c in metrics], *gains)
    out = points.join(spans, name == F.col("_g"), "left").drop("_g")
    none = F.array(F.lit(0.0), F.lit(0.0))
    return out.withColumns({f"_{c}": F.coalesce(f"_{c}", none) for c in metrics})


def bootstrap_by(df: DataFrame, score: str, by: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Interval of the mean score in each group."""
    out = _grouped(df, [score], by, replicates, seed, {"mean": [1.0]}, True)
    return out.select(F.lit("mean").alias("metric"), F.col("mean").alias("value"), F.get("_mean", F.lit(0)).alias("low"), F.get("_mean", F.lit(1)).alias("high"), "n", F.col("_by").alias(by))


def poisson_ci(df: DataFrame, score: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Interval for scores with very many values: each row gets a Poisson(1) weight per replicate, summed where rows are read.

    Generators are seeded by task and batch, so another layout draws other weights.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for k, b in enumerate(batches):
            v = b[score].to_numpy(float)
            w = np.random.default_rng([seed, TaskContext.get().partitionId(), k]).poisson(1.0, (replicates, len(v)))
            yield pd.DataFrame({"replicate": range(replicates), "s": w @ v, "w": w.sum(axis=1)})

    sums = df.select(score).where(F.col(score).isNotNull()).mapInPandas(run, "replicate long, s double, w double").groupBy("replicate").agg((F.sum("s") / F.sum("w")).alias("mean"))
    q = sums.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select(F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def _class_metrics(counts: np.ndarray, labels: list[str]) -> dict[str, float]:
    """Accuracy, macro F1, balanced accuracy and recalls of a table of true rows and predicted columns (the last: unparsed)."""
    hit, truth, predicted = np.diag(counts[:, :-1]), counts.sum(axis=1), counts[:, :-1].sum(axis=0)
    recall = np.divide(hit, truth, out=np.zeros(len(labels)), where=truth > 0)
    f1 = np.divide(2 * hit, truth + predicted, out=np.zeros(len(labels)), where=truth + predicted > 0)
    return {"accuracy": hit.sum() / counts.sum(), "macro_f1": f1.mean(), "balanced_accuracy": recall.mean(), **{f"recall_{v}": r for v, r in zip(labels, recall, strict=True)}}


def stratified_bootstrap(df: DataFrame, truth: str, predicted: str, labels: list[str], replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Intervals of class metrics, resampled inside each true class; a class without rows is an error."""
    # Answers that are no label count as one, so there are at most labels * (labels + 1) cells.
    answer = F.when(F.col(predicted).isin(labels), F.col(predicted))
    cells = df.where(F.col(truth).isin(labels)).groupBy(F.col(truth), answer).agg(F.count("*")).collect()
    table = np.zeros((len(labels), len(labels) + 1))
    for t, p, n in cells:
        table[labels.index(t), labels.index(p) if p in labels else len(labels)] += n
    sizes = table.sum(axis=1)
    if (sizes == 0).any():
        raise ValidationError("a class has no rows")
    rates, names = table / sizes[:, None], list(_class_metrics(table, labels))
    draw = lambda g: _class_metrics(np.array([g.multinomial(int(n), p) for n, p in zip(sizes, rates, strict=True)]), labels)
    return _interval(_replicates(df.sparkSession, replicates, seed, draw, names), names, _class_metrics(table, labels), {"n": int(sizes.sum())})


def paired_bootstrap(df: DataFrame, base: str, treatment: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: means of both runs and of their difference with intervals, and the share of replicates without a gain."""
    both = df.select(F.col(base).alias("_base"), F.col(treatment).alias("_treatment")).dropna()
    if both.isEmpty():
        raise ValidationError("no pairs")
    return paired_bootstrap_by(both.withColumn("_all", F.lit(0)), "_base", "_treatment", "_all", replicates, seed).drop("_all")


def paired_bootstrap_by(df: DataFrame, base: str, treatment: str, by: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """:func:`paired_bootstrap` of each group."""
    out = _grouped(df, [base, treatment], by, replicates, seed, PAIRED, False)
    cols = [x for c in PAIRED for x in (F.col(c), F.get(f"_{c}", F.lit(0)).alias(f"{c}_low"), F.get(f"_{c}", F.lit(1)).alias(f"{c}_high"))]
    return out.select(*cols, "p_value", "n", F.col("_by").alias(by))


def compare_all(scores: DataFrame, target: str, key: str = "sample_id", replicates: int = 10_000, seed: int = 42, regime_tasks: list[str] | None = None) -> DataFrame:
    """(model, task, regime, ..., significant): every model against the target model per task, over (model, task, key, score).

    The regime of these rows is ``all``. Tasks in ``regime_tasks`` also get a row for each regime of the samples that both
    models have (column ``regime`` of ``scores``, the compared model's where they differ).
    """
    own = scores.where(F.col("model") == target).select("task", key, F.col("score").alias("_target"))
    pairs = scores.where(F.col("model") != target).join(own, ["task", key])
    whole = pairs.withColumn("_regime", F.lit("all"))
    if regime_tasks:
        parts = pairs.where(F.col("task").isin(regime_tasks) & F.col("regime").isNotNull()).withColumn("_regime", F.col("regime").cast("string"))
        whole = whole.unionByName(parts)
    out = paired_bootstrap_by(whole.withColumn("_which", F.struct("model", "task", F.col("_regime").alias("regime"))), "score", "_target", "_which", replicates, seed)
    return out.select("_which.model", "_which.task", "_which.regime", *[c for c in out.columns if c != "_which"], (F.col("p_value") < 0.05).alias("significant"))
