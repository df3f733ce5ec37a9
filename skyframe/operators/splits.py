"""Splits, samples, folds and draws.

All draws order rows by a SHA-256 of seed and id, so they are the same on every run and layout, and can be repeated in
SQL. Counts and strata are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.columns import draw_key, hash_uniform
from skyframe.operators.checks import ValidationError


def ranked(df: DataFrame, by: list[str], draw: Column, key: str, name: str) -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group by draw key and id.

    Rows are counted by the first three hexadecimal digits of the draw key; a row's rank is the count of its group's
    earlier prefixes plus its place in its own, so a sort holds a 4096th of a group, however large the group is.
    """
    cut = df.withColumn("_draw", draw).withColumn("_group", F.struct(*by) if by else F.lit(0)).withColumn("_cut", F.substring("_draw", 1, 3))
    sizes = cut.groupBy("_group", "_cut").agg(F.count("*").alias("_n"))
    before = sizes.select("_group", "_cut", (F.sum("_n").over(Window.partitionBy("_group").orderBy("_cut")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_group", "_cut").orderBy("_draw", key))
    return cut.join(before, ["_group", "_cut"]).withColumn(name, (F.col("_before") + place).cast("long")).drop("_draw", "_group", "_cut", "_before")


def assign_splits(
    df: DataFrame,
    seed: int = 42,
    val: float = 0.1,
    test: float = 0.1,
    strata: tuple[str, ...] = ("tier",),
    policy: str = "stratified",
    upstream: str | None = None,
    overrides: dict[str, tuple[float, float]] | None = None,
    min_joint: int = 0,
    key: str = "object_id",
) -> DataFrame:
    """A ``split`` of train, val or test for every object.

    In each stratum the first round(n * val) objects in draw order are val and the next round(n * test) are test, halves to even; the
    rest, and objects that the policy leaves out, are train. Policies: ``stratified`` draws from all objects,
    ``joint_only`` from joint ones, ``auto`` from joint ones if there are at least ``min_joint`` (and any), else from
    all. With ``upstream``, its test objects are test, val is drawn among its train objects, and unlabelled eligible
    objects are drawn as usual. ``overrides`` gives (val, test) by the tier that comes first in a stratum.
    """
    if policy not in ("auto", "stratified", "joint_only"):
        raise ValueError(f"unknown policy {policy}")
    use_joint = policy == "joint_only"
    if policy != "stratified":
        n_joint = df.where("tier = 'joint'").count()
        if policy == "joint_only" and not n_joint and upstream is None:
            raise ValidationError("no joint objects to draw from")
        if policy == "auto":
            use_joint = n_joint > 0 and n_joint >= min_joint
    names = [c for c in strata if c in df.columns] or ["tier"]
    stratum = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(f"_s_{c}") for c in names]
    rows = df.select(key, "tier", *stratum, *([F.col(upstream).alias("_up")] if upstream else []))
    eligible = F.col("tier") == "joint" if use_joint else F.lit(True)
    # Upstream-train objects are a pool of their own: val only.
    pool = F.when(F.col("_up") == "train", "upstream").when(F.col("_up").isNull() & eligible, "draw") if upstream else F.when(eligible, "draw")
    rows = rows.withColumn("_pool", pool)
    keys = ["_pool", *[f"_s_{c}" for c in names]]
    sizes = rows.where("_pool IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by("tier", key).alias("_tier"))
    drawn = ranked(rows.where("_pool IS NOT NULL"), keys, draw_key(seed, F.col(key)), key, "_at").join(sizes, keys)
    fraction = lambda i, default: F.coalesce(*[F.when(F.col("_tier") == t, F.lit(f[i])) for t, f in (overrides or {}).items()], F.lit(default))
    n_val, n_test = F.bround(F.col("_n") * fraction(0, val)), F.bround(F.col("_n") * fraction(1, test))
    part = F.when(F.col("_at") <= n_val, "val").when((F.col("_at") <= n_val + n_test) & (F.col("_pool") == "draw"), "test").otherwise("train")
    out = df.join(drawn.select(key, part.alias("_part")), key, "left")
    split = F.coalesce("_part", F.lit("train"))
    if upstream:
        split = F.when(F.col(upstream) == "test", "test").otherwise(split)
    return out.withColumn("split", split).drop("_part")


def class_quotas(df: DataFrame, label: str, n: int, vocabulary: list[str], least: int = 0) -> DataFrame:
    """(label, size, quota): largest remainders with a floor of ``least`` and a cap at the class size.

    Steps that are too many or too few are taken pass by pass in rank order, written as ranked rows instead of a loop.
    """
    spark = df.sparkSession
    order = spark.createDataFrame([(v, i) for i, v in enumerate(vocabulary)], f"{label} string, _order int")
    sizes = order.join(df.groupBy(label).agg(F.count("*").alias("size")), label, "left").withColumn("size", F.coalesce("size", F.lit(0)))
    whole = Window.partitionBy()
    share = F.col("size") * n / F.sum("size").over(whole)
    base = sizes.withColumn("_share", share).withColumn("_floor", F.least(F.col("size"), F.greatest(F.lit(least), F.floor("_share"))))
    ranked = base.withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("_share") - F.floor("_share")), "_order"))).withColumn("_off", F.lit(n) - F.sum("_floor").over(whole))
    steps = F.when(F.col("_off") > 0, F.col("size") - F.col("_floor")).when(F.col("_off") < 0, F.col("_floor") - F.least(F.col("size"), F.lit(least))).otherwise(0)
    steps = F.least(steps, F.abs(F.col("_off")))  # no class takes more, so the rows below don't grow with the classes
    each = ranked.where(steps > 0).select(label, "_rank", "_off", F.explode(F.sequence(F.lit(1).cast("long"), steps.cast("long"))).alias("_pass"))
    turn = F.when(F.col("_off") > 0, F.col("_rank")).otherwise(-F.col("_rank"))
    taken = each.withColumn("_k", F.row_number().over(Window.partitionBy().orderBy("_pass", turn))).where("_k <= abs(_off)").groupBy(label).agg(F.count("*").alias("_steps"))
    out = ranked.join(taken, label, "left")
    return out.select(label, "size", (F.col("_floor") + F.signum("_off") * F.coalesce("_steps", F.lit(0))).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, label: str, n: int, vocabulary: list[str], least: int = 0, seed: int = 42, key: str = "object_id") -> DataFrame:
    """Exactly n rows by class quotas, in draw order; an error if there aren't that many."""
    quotas = class_quotas(df, label, n, vocabulary, least)
    got = quotas.agg(F.sum("quota")).first()[0]
    if got != n:
        raise ValidationError(f"a sample of {n} isn't possible, only {got}")
    # One row for each class.
    wanted = df.join(F.broadcast(quotas.select(label, "quota")), label)
    return ranked(wanted, [label], draw_key(seed, F.col(key)), key, "_at").where("_at <= quota").drop("_at", "quota")


def balanced_sample(df: DataFrame, label: str, per_class: int, seed: int = 42, key: str = "object_id") -> DataFrame:
    """The same number of rows of each class; a class with fewer is an error."""
    short = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < per_class).limit(5).collect()
    if short:
        raise ValidationError(f"classes with fewer than {per_class} rows: {[tuple(r) for r in short]}")
    return ranked(df, [label], draw_key(seed, F.col(key)), key, "_at").where(F.col("_at") <= per_class).drop("_at")


def cv_folds(df: DataFrame, label: str, folds: int, namespace: str, key: str = "object_id") -> DataFrame:
    """(key, label, fold): per class in order of SHA-256 of namespace, NUL and id, dealt to folds in turn."""
    digest = F.sha2(F.concat(F.lit(namespace), F.lit("\0"), F.col(key)), 256)
    return ranked(df.select(key, label), [label], digest, key, "_at").select(key, label, F.pmod(F.col("_at") - 1, F.lit(folds)).cast("int").alias("fold"))


def expand_sample(fixed: DataFrame, pool: DataFrame, label: str, targets: dict[str, int], seed: int = 42, key: str = "object_id") -> DataFrame:
    """The fixed rows topped up from the pool to the target of each class, with a position in draw order."""
    spark = pool.sparkSession
    want = spark.createDataFrame(list(targets.items()), f"{label} string, _target long")
    have = want.join(fixed.groupBy(label).agg(F.count("*").alias("_have")), label, "left").withColumn("_need", F.col("_target") - F.coalesce("_have", F.lit(0)))
    rest = ranked(pool.join(fixed.select(key), key, "left_anti"), [label], draw_key(seed, F.col(key)), key, "_at")
    possible = have.join(rest.groupBy(label).agg(F.count("*").alias("_rest")), label, "left").where("_need < 0 OR _need > coalesce(_rest, 0)")
    wrong = [tuple(r) for r in possible.select(label, "_need").collect()]
    if wrong:
        raise ValidationError(f"targets out of reach: {wrong}")
    # One row for each class.
    more = rest.join(F.broadcast(have.select(label, "_need")), label).where("_at <= _need").select(key, label)
    return fixed.select(key, label).unionByName(more).withColumn("draw", draw_key(seed, F.lit("order"), F.col(key)))


def review_sample(captions: DataFrame, kind: Column, n: int, seed: int = 42, key: str = "object_id") -> DataFrame:
    """n rows of each kind in draw order."""
    return ranked(captions.withColumn("_kind", kind), ["_kind"], draw_key(seed, F.col(key)), key, "_at").where(F.col("_at") <= n).drop("_at").withColumnRenamed("_kind", "kind")


def sample_subset(available: DataFrame, captioned: DataFrame, weights: DataFrame, epoch: int, seed: int = 42, key: str = "object_id") -> DataFrame:
    """(key, subset): one modality subset per object and epoch by weight, among available and captioned ones.

    ``available`` and ``captioned`` have (key, subset); ``weights`` has (subset, weight).
    """
    usable = available.select(key, "subset").join(captioned.select(key, "subset"), [key, "subset"], "left_semi").join(weights, "subset").where("weight > 0")
    by = Window.partitionBy(key).orderBy("subset")
    run = usable.withColumn("_cum", F.sum("weight").over(by)).withColumn("_all", F.sum("weight").over(Window.partitionBy(key)))
    hit = run.where(F.col("_cum") > hash_uniform(f"{seed}:{epoch}", F.col(key)) * F.col("_all"))
    return hit.groupBy(key).agg(F.min("subset").alias("subset"))


def subset_report(available: DataFrame, captioned: DataFrame, weights: DataFrame, key: str = "object_id") -> DataFrame:
    """One row: objects with an available subset, those that :func:`sample_subset` can draw for, and those it drops."""
    usable = available.select(key, "subset").join(captioned.select(key, "subset"), [key, "subset"], "left_semi").join(weights.where("weight > 0"), "subset", "left_semi")
    marked = available.select(key).distinct().join(usable.select(key).distinct().withColumn("_ok", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("n_objects"), F.count("_ok").alias("n_usable")).withColumn("n_dropped", F.col("n_objects") - F.col("n_usable"))


def sample_prompts(df: DataFrame, variants: list[str], epoch: int, modalities: Column, seed: int = 42, key: str = "object_id") -> DataFrame:
    """(key, prompt): one variant per object and epoch, with {modalities} filled."""
    at = F.floor(hash_uniform(f"{seed}:{epoch}:prompt", F.col(key)) * len(variants)).cast("int")
    chosen = F.get(F.array(*[F.lit(v) for v in variants]), at)
    return df.select(key, F.replace(chosen, F.lit("{modalities}"), modalities).alias("prompt"))


def gaps(points: DataFrame, key: str, time: str, pos: str) -> DataFrame:
    """(key, gap_pos, start, end, days): consecutive gaps in time order."""
    order = Window.partitionBy(key).orderBy(time, pos)
    rows = points.select(key, F.row_number().over(order).alias("_at"), F.lag(time).over(order).alias("start"), F.col(time).alias("end"))
    return rows.where("start IS NOT NULL").select(key, (F.col("_at") - 1).alias("gap_pos"), "start", "end", (F.col("end") - F.col("start")).alias("days"))


def first_objects(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first n objects in key order."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def latest_record(ledger: DataFrame, key: str, seq: str) -> DataFrame:
    """Last record of each object."""
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    return ledger.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at")


def completed(ledger: DataFrame, key: str, seq: str, success: Column) -> DataFrame:
    """Objects whose last record is a success."""
    return latest_record(ledger, key, seq).where(success).select(key)


def amortised_runtime(df: DataFrame, batch: str, seconds: str) -> DataFrame:
    """Each row's share of its batch's time."""
    sizes = df.groupBy(batch).agg(F.count("*").alias("_n"))
    return df.join(sizes, batch).withColumn("amortised", F.col(seconds) / F.col("_n")).drop("_n")
