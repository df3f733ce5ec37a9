"""Exact quantiles of columns of any size, by counting and refining.

Equal values are counted once. Then the values of a group are cut at approximate quantiles of its distinct values and
counted between the cuts, and what is between the two cuts around a wanted rank is cut again, until it holds few distinct
values: these are put in order and give the value at the rank. Each round reads the counts once, for all groups and
ranks together, and leaves some CUTS-th of the distinct values; no task gets more than FEW of them in order, and the
driver sees only cuts and their counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.lineage import settled

FEW, CUTS = 100_000, 256


def exact_quantiles(rows: DataFrame, group: str, value: str, quantiles: list[float]) -> DataFrame:
    """(group, quantile, value): quantiles of each group by linear interpolation between neighbouring ranks.

    Nulls don't count, NaN ranks above all numbers; groups are few, as they are metrics.
    """
    spark = rows.sparkSession
    counts = settled(rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.count_if(F.isnan("v")).alias("nan"), F.sum(F.when(F.isnan("v"), F.col("c")).otherwise(0)).alias("c_nan")).collect()
    kind = rows.schema[group].dataType.simpleString()
    finite = counts.where(~F.isnan("v"))
    found: dict[tuple, float] = {}
    # What is left to search: for a group and rank the bounds (above low, up to high), the count below and the distinct values.
    open_ = []
    for g, n, k, nan, c_nan in sizes:
        for rank in sorted({r for q in quantiles for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}):
            if rank >= n - c_nan:
                found[g, rank] = math.nan
            else:
                open_.append((g, rank, -math.inf, math.inf, 0, k - nan))
    while wide := [x for x in open_ if x[5] > FEW]:
        spans = spark.createDataFrame(sorted({(x[0], x[2], x[3]) for x in wide}, key=str), f"g {kind}, low double, high double")
        inside = finite.join(F.broadcast(spans), "g").where(_within())  # a row for each group and rank at most
        cut = inside.groupBy("g", "low", "high").agg(F.percentile_approx("v", [k / CUTS for k in range(1, CUTS)], 50 * CUTS).alias("cuts"))
        cuts = {(r["g"], r["low"], r["high"]): sorted({x for x in r["cuts"] if x < r["high"]}) for r in cut.collect()}
        table = spark.createDataFrame([(*key, x) for key, x in cuts.items()], f"g {kind}, low double, high double, cuts array<double>")
        place = F.size(F.filter("cuts", lambda e: e < F.col("v")))
        parts = finite.join(F.broadcast(table), "g").where(_within()).groupBy("g", "low", "high", place.alias("at")).agg(F.sum("c").alias("n"), F.count("*").alias("k"))
        got: dict[tuple, dict[int, tuple[int, int]]] = {}
        for r in parts.collect():
            got.setdefault((r["g"], r["low"], r["high"]), {})[r["at"]] = (r["n"], r["k"])
        after = [x for x in open_ if x[5] <= FEW]
        for g, rank, low, high, below, _ in wide:
            edges = [low, *cuts[g, low, high], high]
            for at, (n, k) in sorted(got[g, low, high].items()):
                if rank < below + n:
                    after.append((g, rank, edges[at], edges[at + 1], below, k))
                    break
                below += n
        open_ = after
    if open_:
        ranks = spark.createDataFrame([(g, rank, low, high, below) for g, rank, low, high, below, _ in open_], f"g {kind}, rank long, low double, high double, below long")
        # At most FEW rows for each group and rank.
        order = Window.partitionBy("g", "rank").orderBy("v")
        near = finite.join(F.broadcast(ranks), "g").where(_within()).withColumn("upto", F.col("below") + F.sum("c").over(order))
        hit = near.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        found |= {(r["g"], r["rank"]): r["v"] for r in hit.select("g", "rank", "v").collect()}
    counts.unpersist()
    out = []
    for g, n, *_ in sizes:
        for q in quantiles:
            at = q * (n - 1)
            low, high = found[g, math.floor(at)], found[g, math.ceil(at)]
            out.append((g, q, low if low == high else low + (high - low) * (at - math.floor(at))))
    return spark.createDataFrame(out, f"`{group}` {kind}, quantile double, value double")


def _within():
    return ((F.col("v") > F.col("low")) | (F.col("low") == -math.inf)) & (F.col("v") <= F.col("high"))
