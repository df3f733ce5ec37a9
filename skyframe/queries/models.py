"""Queries of scoring, resampling, inference, learning, ledgers, files and streams."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from skyframe.operators import checks, infer, probe, resample, scoring, splits
from skyframe.queries.base import INPUTS, ORACLES, QUERIES, frame, plain, query
from skyframe.sources import io
from skyframe.sources.cache import EmbeddingCache
from skyframe.sources.records import RecordSink, keep_run, read_records
from skyframe.streaming import ledger as streams

LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
IN = "('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, which only a local session may lack."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skyframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- scoring ------------------------------------------------------------------------------------------------------------


@query("d8_confusion", "predictions", sql="SELECT truth, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{v}') AS \"{v}\"" for v in LABELS) + ', count(*) FILTER (WHERE predicted IS NULL) AS "(unparsed)" FROM {predictions} GROUP BY truth')
def d8(rows: DataFrame) -> DataFrame:
    return scoring.confusion(rows, "truth", "predicted", LABELS)


@query("d9_accuracy", "predictions", sql="SELECT count(*) AS n, CAST(sum(CAST(coalesce(predicted = truth, false) AS INT)) AS BIGINT) AS n_correct, round(avg(CAST(coalesce(predicted = truth, false) AS INT)), 6) AS accuracy FROM {predictions}")
def d9(rows: DataFrame) -> DataFrame:
    return scoring.accuracy(rows.withColumn("predicted", F.lower("predicted")), "truth", "predicted", fold_case=True)


REPORT = f"""l AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS label),
s AS (SELECT label, (SELECT count(*) FROM {{predictions}} WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM {{predictions}} WHERE predicted = label) AS np, (SELECT count(*) FROM {{predictions}} WHERE truth = label) AS support FROM l),
r AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS rc FROM s), f AS (SELECT *, coalesce(2 * p * rc / nullif(p + rc, 0), 0) AS f1 FROM r)"""


@query("d10_classification_report", "predictions", sql=f"WITH {REPORT} SELECT label, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def d10(rows: DataFrame) -> DataFrame:
    out = scoring.classification_report(rows, "truth", "predicted", [*LABELS, "6-NEVER"])
    return out.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@query("d11_benchmark_metrics", "predictions", sql=f"""WITH {REPORT}
SELECT (SELECT count(*) FROM {{predictions}}) AS n, (SELECT round(avg(CAST(coalesce(predicted = truth, false) AS INT)), 6) FROM {{predictions}}) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(CASE WHEN support > 0 THEN rc END), 6) AS balanced_accuracy,
(SELECT round(avg(CAST(predicted IS NOT NULL AS INT)), 6) FROM {{predictions}}) AS parse_rate, (SELECT count(*) FROM {{predictions}} WHERE predicted IS NULL) AS n_unparsed FROM f""")
def d11(rows: DataFrame) -> DataFrame:
    return scoring.benchmark_metrics(rows, "truth", "predicted", [*LABELS, "6-NEVER"])


GROUPS = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow", "4-NOT SPECIFIED": "slow", "5-LOW": "slow"}


@query("d12_group_report", "predictions", sql="""
WITH s AS (SELECT CASE WHEN truth IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS g, CASE WHEN predicted = truth THEN 1.0 WHEN predicted IS NOT NULL AND (predicted IN ('1-URGENT', '2-HIGH')) = (truth IN ('1-URGENT', '2-HIGH')) THEN 0.5 ELSE 0 END AS score FROM {predictions})
SELECT g AS "group", count(*) AS n, round(avg(CAST(score AS DOUBLE)), 6) AS score FROM s GROUP BY g UNION ALL SELECT 'all', count(*), round(avg(CAST(score AS DOUBLE)), 6) FROM s""")
def d12(rows: DataFrame) -> DataFrame:
    return scoring.group_report(rows, "truth", "predicted", GROUPS)


INPUTS["votes"] = "SELECT vec_id, CAST(label % 3 AS STRING) AS truth, CASE WHEN vec_id % 7 <> 0 THEN CAST((label + vec_id) % 3 AS STRING) END AS predicted, (vec_id * 37 % 101) / 1e2 AS a, (vec_id * 53 % 97) / 1e2 AS b, vec_id % 6 = 0 AS a_mask, vec_id % 9 <> 0 AS matched FROM {embeddings}"
MARGINS = "CASE WHEN NOT a_mask THEN greatest(0, least(1, (a - 0.3) / 0.7)) END AS m0, CASE WHEN NOT a_mask THEN least(greatest(0, least(1, a)), greatest(0, least(1, (0.5 - b) / 0.5))) END AS m1, greatest(CASE WHEN NOT a_mask THEN greatest(0, least(1, (0.8 - a) / 0.8)) ELSE 0 END, greatest(0, least(1, (b - 0.2) / 0.8))) AS m2"


def _margins() -> dict:
    a = lambda op, v: scoring.condition_margin(F.col("a"), F.col("a_mask"), op, v)
    b = lambda op, v: scoring.condition_margin(F.col("b"), F.lit(False), op, v)
    return {"0": scoring.class_margin([[a(">", 0.3)]]), "1": scoring.class_margin([[a(">", 1.0)], [b("<", 0.5)]]), "2": scoring.class_margin([[a("<", 0.8), b(">", 0.2)]])}


@query("g24_class_margins", "votes", sql=f"SELECT vec_id, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2 FROM (SELECT *, {MARGINS} FROM {{votes}})")
def g24(votes: DataFrame) -> DataFrame:
    return votes.select("vec_id", *[F.round(m, 6).alias(f"m{k}") for k, m in _margins().items()])


SOFT = f"""m AS (SELECT *, {MARGINS} FROM {{votes}}), o AS (SELECT *, CASE truth WHEN '0' THEN m0 WHEN '1' THEN m1 ELSE m2 END AS own, CASE predicted WHEN '0' THEN m0 WHEN '1' THEN m1 WHEN '2' THEN m2 END AS got FROM m),
s AS (SELECT *, CASE WHEN own IS NOT NULL AND own > 0 AND predicted IS NOT NULL THEN CASE WHEN truth = predicted THEN 1.0 WHEN got IS NOT NULL THEN least(1.0, got / own) END END AS score,
CASE WHEN NOT matched THEN 'unmatched' WHEN predicted IS NULL THEN 'unparsed' WHEN own IS NULL OR own <= 0 THEN 'true_margin' WHEN truth <> predicted AND got IS NULL THEN 'predicted_margin' ELSE 'scored' END AS status FROM o)"""


@query("g25_soft_score", "votes", sql=f"WITH {SOFT} SELECT vec_id, round(CAST(score AS DOUBLE), 6) AS score, status FROM s")
def g25(votes: DataFrame) -> DataFrame:
    m, t, p = _margins(), F.col("truth"), F.col("predicted")
    score = scoring.soft_score(m, t, p)
    table = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)])
    known = (t == p) | F.try_element_at(table, p).isNotNull()
    return votes.select("vec_id", F.round(F.when(known, score), 6).alias("score"), scoring.soft_status(m, t, p, F.col("matched")).alias("status"))


@query("d13_soft_report", "votes", sql=f"""WITH {SOFT} SELECT round(avg(CASE WHEN status = 'scored' THEN CAST(score AS DOUBLE) END), 6) AS mean_score, """ + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS n_{k}" for k in ("scored", "unmatched", "unparsed", "true_margin", "predicted_margin")) + " FROM s")
def d13(votes: DataFrame) -> DataFrame:
    m, t, p = _margins(), F.col("truth"), F.col("predicted")
    return scoring.soft_report(votes, scoring.soft_score(m, t, p), scoring.soft_status(m, t, p, F.col("matched")))


SETS = """g AS (SELECT sample_id, list_distinct(list(label)) AS a, CASE WHEN sample_id % 17 <> 0 THEN list_distinct(list(guess) FILTER (WHERE guess <> 'XX')) END AS b, CASE sample_id % 3 WHEN 0 THEN 'pure_negative' WHEN 1 THEN 'high_snr_positive' ELSE 'mixed' END AS regime FROM {multi} GROUP BY sample_id),
t AS (SELECT regime, CASE WHEN regime = 'pure_negative' THEN [] ELSE a END AS a, coalesce(b, []) AS b FROM g),
s AS (SELECT regime, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard, CASE WHEN len(a) = 0 THEN CAST(len(b) = 0 AS INT) ELSE len(list_intersect(a, b)) / len(a) END AS recall, CAST(len(list_intersect(a, b)) = len(list_distinct(list_concat(a, b))) AS INT) AS perfect FROM t)"""


def _sets(multi: DataFrame) -> DataFrame:
    g = multi.groupBy("sample_id").agg(F.collect_set("label").alias("a"), F.collect_set(F.when(F.col("guess") != "XX", F.col("guess"))).alias("b"))
    regime = F.when(F.col("sample_id") % 3 == 0, "pure_negative").when(F.col("sample_id") % 3 == 1, "high_snr_positive").otherwise("mixed")
    none = F.array().cast("array<string>")
    return g.withColumn("regime", regime).withColumn("a", F.when(F.col("regime") == "pure_negative", none).otherwise(F.col("a"))).withColumn("b", F.when(F.col("sample_id") % 17 != 0, F.col("b")))


@query("d15_multilabel_report", "multi", sql=f"WITH {SETS} SELECT count(*) AS n, round(avg(jaccard), 6) AS jaccard, round(avg(recall), 6) AS recall, round(avg(perfect), 6) AS perfect FROM s")
def d15(multi: DataFrame) -> DataFrame:
    return scoring.multilabel_report(_sets(multi), "a", "b")


@query("d16_regime_report", "multi", sql=f"WITH {SETS} SELECT regime, count(*) AS n, round(avg(jaccard), 6) AS jaccard, CASE WHEN regime = 'pure_negative' THEN round(avg(perfect), 6) END AS perfect, CASE WHEN regime = 'high_snr_positive' THEN round(avg(recall), 6) END AS recall FROM s GROUP BY regime")
def d16(multi: DataFrame) -> DataFrame:
    return scoring.regime_report(_sets(multi), "a", "b")


@query("d17_caption_diagnostics", "ledger", sql="""
SELECT round(avg(length(coalesce(answer, ''))), 6) AS mean_chars, round(avg(len(list_filter(string_split_regex(coalesce(answer, ''), '\\s+'), lambda w : w <> ''))), 6) AS mean_words, round(avg(CAST(status = 'assistant' AS INT)), 6) AS parse_rate, round(avg(CAST(tokens % 2 = 0 AS INT)), 6) AS fallback_rate FROM {ledger}""")
def d17(ledger: DataFrame) -> DataFrame:
    rows = ledger.withColumn("ok", F.col("status") == "assistant").withColumn("forced", F.col("tokens") % 2 == 0)
    return scoring.caption_diagnostics(rows, "answer", "ok", "forced")


@query("d19_runtime_summary", "ledger", sql="SELECT CAST(sum(tokens) AS BIGINT) AS total_seconds, round(avg(tokens), 6) AS mean_seconds FROM {ledger}")
def d19(ledger: DataFrame) -> DataFrame:
    return infer.runtime_summary(ledger, "tokens")


@query("d20_budget_stop", "ledger", sql="""
WITH r AS (SELECT object_id, seq, concat(lpad(object_id, 12, '0'), lpad(CAST(seq AS VARCHAR), 12, '0')) AS o, tokens * 0.25 AS cost FROM {ledger}), s AS (SELECT *, sum(cost) OVER (ORDER BY o) AS running FROM r)
SELECT object_id, seq, CAST(running AS DOUBLE) AS running FROM s WHERE running <= 150""")
def d20(ledger: DataFrame) -> DataFrame:
    rows = ledger.withColumn("o", F.concat(F.lpad("object_id", 12, "0"), F.lpad(F.col("seq").cast("string"), 12, "0"))).withColumn("cost", F.col("tokens") * 0.25)
    return infer.within_budget(rows, "cost", 150.0, "o").select("object_id", "seq", F.col("running").cast("double").alias("running"))


@query("d20_usage_spend", "ledger", sql="SELECT status AS run, count(*) AS n_calls, round(CAST(sum(tokens * 0.5 + seq * 2) AS DOUBLE), 6) AS spend FROM {ledger} GROUP BY 1")
def d20_spend(ledger: DataFrame) -> DataFrame:
    return infer.usage_spend(ledger.withColumn("run", F.col("status")), "run", "tokens", "seq", 0.5, 2.0)


INPUTS["results"] = "SELECT o_orderstatus AS model, o_orderpriority AS task, round(avg(o_totalprice), 4) AS score FROM {orders} GROUP BY o_orderstatus, o_orderpriority"


@query("d26_leaderboard", "results", sql="SELECT r.model, r.task, r.score, round(r.score - b.score, 6) AS delta FROM {results} r LEFT JOIN {results} b ON b.task = r.task AND b.model = 'O'")
def d26(results: DataFrame) -> DataFrame:
    return scoring.leaderboard(results, "O")


@query("d27_regime_table", "results", sql="SELECT model, max(score) FILTER (WHERE task = '1-URGENT') AS \"1-URGENT\", max(score) FILTER (WHERE task = '5-LOW') AS \"5-LOW\" FROM {results} GROUP BY model")
def d27(results: DataFrame) -> DataFrame:
    return scoring.regime_table(results.withColumnRenamed("task", "regime"), ["1-URGENT", "5-LOW"])


# --- resampling ---------------------------------------------------------------------------------------------------------


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(x, 9).alias(x) if k == "double" else F.col(x) for x, k in df.dtypes])


@query("h1_bootstrap_ci", "predictions")
def h1(rows: DataFrame) -> DataFrame:
    return _round(resample.bootstrap_ci(rows.withColumn("s", F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)).cast("double")), "s"))


@query("h2_bootstrap_by_regime", "multi")
def h2(multi: DataFrame) -> DataFrame:
    s = _sets(multi)
    jaccard = scoring.set_scores(F.col("a"), F.col("b"))["jaccard"]
    return _round(resample.bootstrap_by(s.withColumn("s", F.round(jaccard, 9)), "s", "regime"))


@query("h3_stratified_bootstrap", "predictions")
def h3(rows: DataFrame) -> DataFrame:
    return _round(resample.stratified_bootstrap(rows, "truth", "predicted", LABELS))


def _paired(rows: DataFrame) -> DataFrame:
    ok = lambda x: F.coalesce(F.col("truth") == F.col(x), F.lit(False)).cast("double")
    return rows.select("sample_id", "regime", ok("predicted").alias("a"), ok("predicted_b").alias("b"))


@query("h4_paired_bootstrap", "predictions")
def h4(rows: DataFrame) -> DataFrame:
    return _round(resample.paired_bootstrap(_paired(rows), "a", "b"))


@query("h5_paired_by_regime", "predictions")
def h5(rows: DataFrame) -> DataFrame:
    return _round(resample.paired_bootstrap_by(_paired(rows), "a", "b", "regime"))


def _models(rows: DataFrame) -> DataFrame:
    """Scores of both models, as samples of one task."""
    return _paired(rows).select("sample_id", F.lit("lines").alias("task"), "regime", F.explode(F.create_map(F.lit("first"), "a", F.lit("target"), "b")).alias("model", "score"))


@query("h6_compare_all", "predictions")
def h6(rows: DataFrame) -> DataFrame:
    return _round(resample.compare_all(_models(rows), "target", regime_tasks=["lines"]))


#: Means are exact; an interval must hold its mean and be as wide as the scores' spread says, to a tenth.
@query("h6_points", "predictions", sql="""
WITH s AS (SELECT regime, CAST(coalesce(truth = predicted, false) AS DOUBLE) AS a, CAST(coalesce(truth = predicted_b, false) AS DOUBLE) AS b FROM {predictions}),
r AS (SELECT 'all' AS regime, a, b FROM s UNION ALL SELECT regime, a, b FROM s)
SELECT 'first' AS model, 'lines' AS task, regime, CAST(count(*) AS INT) AS n, round(avg(a), 9) AS base, round(avg(b), 9) AS treatment, round(avg(b - a), 9) AS delta, true AS plausible FROM r GROUP BY regime""")
def h6_points(rows: DataFrame) -> DataFrame:
    models = _models(rows)
    out = resample.compare_all(models, "target", regime_tasks=["lines"])
    wide = _paired(rows).select(F.explode(F.array(F.lit("all"), "regime")).alias("regime"), (F.col("b") - F.col("a")).alias("d")).groupBy("regime").agg((2 * 1.96 * F.stddev_pop("d") / F.sqrt(F.count("*"))).alias("_width"))
    joined = out.join(wide, "regime")
    holds = F.col("delta").between(F.col("delta_low"), F.col("delta_high"))
    fits = F.abs(F.col("delta_high") - F.col("delta_low") - F.col("_width")) < 0.1 * F.col("_width")
    return joined.select("model", "task", "regime", "n", F.round("base", 9).alias("base"), F.round("treatment", 9).alias("treatment"), F.round("delta", 9).alias("delta"), (holds & fits).alias("plausible"))


@query("h1_poisson_ci", "orders")
def h1_poisson(orders: DataFrame) -> DataFrame:
    return resample.poisson_ci(orders, "o_totalprice").select(F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


INPUTS["answers_prompts"] = "SELECT o_orderkey AS k, o_orderstatus AS o, concat('status ', o_orderstatus) AS prompt FROM {orders}"

# --- inference and learning ---------------------------------------------------------------------------------------------


#: The stand-in multiplies each token of four values by a fixed matrix: the total needs only the sums of its rows.
ROW_SUMS = np.random.default_rng(7).normal(size=(4, 4)).sum(axis=1).tolist()


@query("j1_encode", "embeddings", sql=f"SELECT vec_id AS object_id, CAST(ceil(len(embedding) / 4) AS INT) AS n_tokens, round(list_sum(list_transform(range(len(embedding)), lambda i : CAST(embedding[i + 1] AS DOUBLE) * (CASE i % 4 WHEN 0 THEN {ROW_SUMS[0]!r}e0 WHEN 1 THEN {ROW_SUMS[1]!r}e0 WHEN 2 THEN {ROW_SUMS[2]!r}e0 ELSE {ROW_SUMS[3]!r}e0 END))), 6) AS total FROM {{embeddings}}")
def j1(embeddings: DataFrame) -> DataFrame:
    out = infer.encode(embeddings.withColumnRenamed("vec_id", "object_id"), "embedding", infer.projection_encoder(4), 4, "spec1")
    return out.select("object_id", "n_tokens", F.round(F.aggregate(F.flatten("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _stand_in(answers: dict[str, str], default: str = "FINAL ANSWER: C", vague: str | None = None):
    """A factory of clients for queries: answers by what a prompt contains; ``vague`` prompts need a forced follow-up."""

    def client(prompt: str) -> str:
        if vague and vague in prompt and "FORCED" not in prompt:
            return "hard to say"
        return next((a for k, a in answers.items() if k in prompt), default)

    return lambda: client


@query("j2_generate", "answers_prompts", sql="SELECT k, CASE o WHEN 'O' THEN 'A' WHEN 'F' THEN 'B' ELSE 'C' END AS answer, o = 'F' AS forced, CAST(CASE WHEN o = 'F' THEN 2 ELSE 1 END AS INT) AS n_calls FROM {answers_prompts}")
def j2(rows: DataFrame) -> DataFrame:
    import re

    parse = lambda x: m[1] if (m := re.search(r"FINAL ANSWER: (\w)", x)) else None
    out = infer.generate(rows, "prompt", _stand_in({"status O": "FINAL ANSWER: A", "status F": "FINAL ANSWER: B"}, vague="status F"), "k", parse=parse, second=lambda p, a: f"FORCED {p}")
    return out.select("k", "answer", "forced", "n_calls")


@query("j3_mock_answers", "answers_prompts", sql="SELECT CASE WHEN o = 'O' THEN 'yes' ELSE 'FINAL ANSWER: C' END AS answer, count(*) AS n FROM {answers_prompts} GROUP BY 1")
def j3(rows: DataFrame) -> DataFrame:
    return infer.generate(rows, "prompt", _stand_in({"status O": "yes"}), "k").groupBy("answer").agg(F.count("*").alias("n"))


@query("j4_judge", "answers_prompts", sql="SELECT k, CASE WHEN k % 5 = 0 THEN NULL WHEN o = 'O' THEN 'open' ELSE 'other' END AS predicted, false AS failed FROM {answers_prompts}")
def j4(rows: DataFrame) -> DataFrame:
    df = rows.withColumn("caption", F.when(F.col("k") % 5 != 0, F.col("prompt")).otherwise("  "))
    return infer.judge(df, "caption", _stand_in({"status O": "0"}, "1"), ["open", "other"], "k")


@query("j5_evaluate_captions", "answers_prompts", sql="SELECT k AS sample_id, CASE WHEN o = 'O' THEN 'open' ELSE 'done' END AS predicted, (o = 'O') = (k % 2 = 0) AS correct FROM {answers_prompts} WHERE o <> 'P'")
def j5(rows: DataFrame) -> DataFrame:
    bench = rows.select(F.col("k").alias("sample_id"), F.when(F.col("k") % 2 == 0, "open").otherwise("done").alias("truth"))
    # Orders in progress have no caption yet.
    caps = rows.where("o <> 'P'").select(F.col("k").alias("sample_id"), F.col("prompt").alias("caption"))
    out = infer.evaluate_captions(bench, caps, _stand_in({"status O": "FINAL ANSWER: A"}, "FINAL ANSWER: B"), {"A": "open", "B": "done"}, "{caption}\n{options}")
    return out.select("sample_id", "predicted", "correct")


INPUTS["numbered_prompts"] = "SELECT o_orderkey AS k, concat('order ', CAST(o_orderkey AS STRING), ' costs ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) AS prompt FROM {orders}"


class Refused(Exception):
    """What a paid service answers with; it may cost something."""

    def __init__(self, cost: float):
        super().__init__("refused")
        self.cost = cost


def _paid(refuses: int):
    """A factory of clients that report a cost and refuse orders whose number is divisible by ``refuses`` (0: none)."""

    def client(prompt: str) -> str:
        order = int(prompt.split()[1])
        if refuses and order % refuses == 0:
            raise Refused(0.25)
        return infer.Reply(f"FINAL ANSWER: {'ABC'[order % 3]}", len(prompt) * 0.75)

    return lambda: client


@query("c8_zero_report", "answers_prompts", sql="SELECT 'priority' AS task_name, 0 AS total_samples, 0 AS n_answered, 0 AS n_correct, 0e0 AS accuracy UNION ALL SELECT 'status', count(*) FILTER (WHERE o <> 'P'), count(*) FILTER (WHERE o <> 'P'), count(*) FILTER (WHERE o <> 'P' AND (o = 'O') = (k % 2 = 0)), round(avg(CASE WHEN o <> 'P' THEN CAST((o = 'O') = (k % 2 = 0) AS INT) END), 6) FROM {answers_prompts}")
def c8_zero(rows: DataFrame) -> DataFrame:
    """A task whose captions are all of other samples, beside one that has some."""
    bench = rows.select(F.col("k").alias("sample_id"), F.when(F.col("k") % 2 == 0, "open").otherwise("done").alias("truth"))
    caps = rows.where("o <> 'P'").select(F.col("k").alias("sample_id"), F.col("prompt").alias("caption"))
    scored = lambda c: infer.evaluate_captions(bench, c, _stand_in({"status O": "FINAL ANSWER: A"}, "FINAL ANSWER: B"), {"A": "open", "B": "done"}, "{caption}\n{options}")
    return infer.evaluation_summary(scored(caps), "status").unionByName(infer.evaluation_summary(scored(caps.withColumn("sample_id", -1 - F.col("sample_id"))), "priority"))


@query("j6_resumable_run", "numbered_prompts", sql="SELECT k, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS seq, concat('FINAL ANSWER: ', substr('ABC', CAST(k % 3 AS INT) + 1, 1)) AS answer, length(prompt) * 0.75e0 AS cost FROM {numbered_prompts}")
def j6(rows: DataFrame) -> DataFrame:
    path, hashed = work_path(rows.sparkSession, "ledger"), F.sha2("prompt", 256)
    for refuses in (4, 0):
        step = lambda todo, sink, refuses=refuses: infer.generate(todo, "prompt", _paid(refuses), "k", retries=1, sink=sink, carry=infer.CONTRACT)
        out = infer.resumable_run(rows, step, path, "k", "s1", hashed, flush_rows=1000)
    return out.select("k", F.col("seq").cast("int").alias("seq"), "answer", "cost")


@query("j7_budget_guard", "numbered_prompts", sql="""
WITH r AS (SELECT k, row_number() OVER (ORDER BY k) AS place, length(prompt) + 4e0 AS reserve, length(prompt) * 0.75e0 AS cost, k % 13 = 0 AS lost FROM {numbered_prompts}),
c AS (SELECT 'reserve' AS rule, *, CASE WHEN lost THEN reserve ELSE cost END AS spend FROM r UNION ALL SELECT 'reported', *, CASE WHEN lost THEN 0.25e0 ELSE cost END FROM r),
s AS (SELECT *, coalesce(sum(spend) OVER (PARTITION BY rule ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM c),
f AS (SELECT rule, min(place) AS first FROM s WHERE before + reserve > 12000 GROUP BY rule)
SELECT rule, k, spend FROM s LEFT JOIN f USING (rule) WHERE place < coalesce(first, place + 1)""")
def j7(rows: DataFrame) -> DataFrame:
    out = None
    for rule in ("reserve", "reported"):
        path = work_path(rows.sparkSession, "paid")
        step = lambda todo, sink: infer.generate(todo, "prompt", _paid(13), "k", retries=1, sink=sink, carry=infer.BUDGETED)
        done = infer.budgeted_run(rows, step, path, "k", "s1", F.sha2("prompt", 256), F.length("prompt") + 4, "k", 12000.0, rule, flush_rows=1000)
        spend = F.when(F.col("failure_reason").isNull() | (F.lit(rule) == "reported"), F.col("cost")).otherwise(F.col("reserve"))
        one = done.select(F.lit(rule).alias("rule"), "k", spend.alias("spend"))
        out = one if out is None else out.unionByName(one)
    return out


@query("j7_within_budget", "answers_prompts", sql="""
WITH r AS (SELECT k, lpad(CAST(k AS VARCHAR), 24, '0') AS o, (length(prompt) + 10) * 0.5 + 100 * 2 AS cost FROM {answers_prompts}), s AS (SELECT *, sum(cost) OVER (ORDER BY o) AS running FROM r) SELECT k, CAST(cost AS DOUBLE) AS cost FROM s WHERE running <= 5000""")
def j7_prefix(rows: DataFrame) -> DataFrame:
    priced = rows.withColumn("o", F.lpad(F.col("k").cast("string"), 24, "0")).withColumn("cost", infer.reserve(F.col("prompt"), 100, 0.5, 2.0, 10))
    return infer.within_budget(priced, "cost", 5000.0, "o").select("k", F.col("cost").cast("double").alias("cost"))


@query("k1_linear_probe", "embeddings")
def k1(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").alias("object_id"), "embedding", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("cls"))
    out = probe.linear_probe(rows.where("object_id % 4 <> 0"), rows.where("object_id % 4 = 0"), "embedding", "cls", ["c0", "c1", "c2"], "object_id")
    return out.select("n", "accuracy", "macro_f1", "reg")


# --- after a write ------------------------------------------------------------------------------------------------------


def written(name: str, *inputs: str, sql: str | None = None):
    """Register ``fn(spark, *frames)``."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, *[frame(spark, sf_dir, i) for i in inputs])
        if sql:
            ORACLES[name] = plain(sql)
        return fn

    return add


@written("a1_projected_scan", "lineitem", sql="SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity > 45")
def a1(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    path = work_path(spark, "table")
    lineitem.write.parquet(path)
    return io.read_parquet_columns(spark, path, ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


@written("a2_union_of_files", "customer", "supplier", sql="""
SELECT CAST(c_custkey AS VARCHAR) AS object_id, c_acctbal AS acctbal, c_mktsegment AS segment, 0 AS src_rank FROM {customer}
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal, NULL, 1 FROM {supplier}""")
def a2(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    path = work_path(spark, "union")
    customer.select(F.col("c_custkey").alias("object_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")).write.parquet(f"{path}/a")
    supplier.select(F.col("s_suppkey").cast("string").alias("object_id"), F.col("s_acctbal").alias("acctbal")).write.parquet(f"{path}/b")
    return io.read_union(spark, [f"{path}/a", f"{path}/b"])


@written("a17_frozen_input_hashes", "orders", sql="""
SELECT o_orderkey, sha256(concat(o_orderpriority, '|', o_orderstatus)) AS input_sha256, 'v1' AS contract FROM {orders}""")
def a17(spark: SparkSession, orders: DataFrame) -> DataFrame:
    path = work_path(spark, "frozen")
    rendered = orders.select("o_orderkey", F.concat("o_orderpriority", F.lit("|"), "o_orderstatus").alias("rendered"))
    io.freeze_inputs(rendered, path, "v1", "o_orderkey", "rendered")
    # The second call finds the snapshot and reuses it.
    return io.freeze_inputs(rendered, path, "v1", "o_orderkey", "rendered").select("o_orderkey", "input_sha256", "contract")


@written("a3_discover", "orders", sql="SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY 1")
def a3(spark: SparkSession, orders: DataFrame) -> DataFrame:
    path = work_path(spark, "shards")
    orders.select("o_orderstatus").write.parquet(path)
    return spark.read.parquet(*io.discover(spark, f"{path}-none", path)).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


#: Lines of a caption file: by turn with a sentinel, a flag, no output, an empty caption or a usable one, all with blanks around keys and texts.
INPUTS["caption_lines"] = """
SELECT concat(object_id, '-', CAST(pos AS STRING)) AS k, CASE pos % 6 WHEN 1 THEN 'sentinel' WHEN 2 THEN 'flag' WHEN 3 THEN 'none' WHEN 4 THEN 'empty' ELSE 'usable' END AS kind, text FROM {quotes}"""


def _caption_lines(rows: DataFrame) -> DataFrame:
    text = F.when(F.col("kind") == "sentinel", " INSUFFICIENT_SPECTRAL_DATA ").when(F.col("kind") == "empty", "  ").otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    output = F.when(F.col("kind") != "none", F.struct(text.alias("caption"), F.when(F.col("kind") == "flag", True).alias("is_insufficient")))
    return rows.select(F.to_json(F.struct(F.concat(F.lit(" "), "k", F.lit(" ")).alias("object_key"), output.alias("output"))).alias("value"))


@written("a5_caption_jsonl", "caption_lines", sql=r"""
SELECT k AS object_key, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM {caption_lines} WHERE kind = 'usable'""")
def a5(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = work_path(spark, "captions")
    both = _caption_lines(rows)
    both.unionByName(both).write.text(path)
    usable, _ = io.read_caption_jsonl(spark, path)
    return usable.select("object_key", F.sha2("caption", 256).alias("digest"))


@written("a5_line_status", "caption_lines", sql="""
SELECT CASE kind WHEN 'sentinel' THEN 'insufficient' WHEN 'flag' THEN 'insufficient' WHEN 'none' THEN 'missing' WHEN 'empty' THEN 'missing' ELSE kind END AS status, CAST(count(*) * CASE WHEN any_value(kind) = 'usable' THEN 1 ELSE 2 END AS BIGINT) AS n FROM {caption_lines} GROUP BY 1
UNION ALL SELECT 'duplicate', count(*) FROM {caption_lines} WHERE kind = 'usable'""")
def a5_status(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = work_path(spark, "captions")
    both = _caption_lines(rows)
    both.unionByName(both).write.text(path)
    return io.read_caption_jsonl(spark, path)[1]


@written("a5_line_numbers", "quotes", sql="SELECT file, line, object_id, pos FROM (SELECT CAST(pos % 3 AS INT) AS file, row_number() OVER (PARTITION BY pos % 3 ORDER BY object_id, pos) AS line, object_id, pos FROM {quotes})")
def a5_numbers(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Three files in order, each read in many splits."""
    path = work_path(spark, "lines")
    for part in range(3):
        rows.where(F.col("pos") % 3 == part).orderBy("object_id", "pos").select(F.concat_ws("\t", "object_id", F.col("pos").cast("string"))).coalesce(1).write.text(f"{path}/part={part}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = io.text_lines(spark, f"{path}/*/*.txt")
        numbered = io.numbered_lines(lines, lines)
        parts = F.split("value", "\t")
        out = numbered.select(F.regexp_extract("file", "part=(\\d)", 1).cast("int").alias("file"), F.col("line").cast("long").alias("line"), F.get(parts, F.lit(0)).alias("object_id"), F.get(parts, F.lit(1)).cast(rows.schema["pos"].dataType).alias("pos"))
        stored = work_path(spark, "numbered")
        out.write.parquet(stored)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.read.parquet(stored)


@written("a6_predictions_jsonl", "predictions", sql="""
SELECT sample_id, CASE WHEN regime = 'F' THEN '["' || predicted || '"]' ELSE predicted END AS prediction, CASE WHEN regime = 'F' THEN 1 ELSE 0 END AS n_predicted,
CASE WHEN regime = 'F' THEN 3.5 END AS snr, CASE WHEN regime = 'O' THEN NULL ELSE 'text of ' || sample_id END AS caption FROM {predictions} WHERE predicted IS NOT NULL""")
def a6(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = work_path(spark, "predictions")
    rows.select("sample_id", F.lit("old").alias("prediction")).coalesce(1).write.json(f"{path}/a")
    flat = rows.where("regime = 'O'").select("sample_id", F.col("predicted").alias("prediction"), F.col("truth").alias("ground_truth"))
    nested = rows.where("regime <> 'O'").select("sample_id", F.struct(F.concat(F.lit("text of "), "sample_id").alias("text")).alias("caption"), "regime", "truth", "predicted")
    one = nested.where("regime <> 'F'").select("sample_id", "caption", F.col("truth").alias("ground_truth"), F.struct(F.col("predicted").alias("prediction")).alias("frontier_evaluation"))
    many = nested.where("regime = 'F'").select("sample_id", "caption", F.create_map("truth", F.lit(3.5)).alias("ground_truth"), F.struct(F.array("predicted").alias("prediction")).alias("frontier_evaluation"))
    for name, part in (("b", flat), ("c", one), ("d", many)):
        part.coalesce(1).write.json(f"{path}/{name}")
    found = io.read_predictions(spark, f"{path}/*", rows.where("predicted IS NOT NULL"))
    return found.select("sample_id", "prediction", F.coalesce(F.size(F.coalesce("predicted_lines", F.array().cast("array<string>"))), F.lit(0)).alias("n_predicted"), F.element_at(F.map_values("truth_lines"), 1).alias("snr"), F.col("caption.text").alias("caption"))


@written("a7_answers_document", "customer", sql="SELECT 'm' AS model, c_custkey AS id, c_mktsegment AS answer FROM {customer}")
def a7(spark: SparkSession, customer: DataFrame) -> DataFrame:
    path = work_path(spark, "answers")
    # A document for each market segment and block of numbers, as a job writes one for each run; each in a file of its own.
    made = customer.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 10_000)).agg(F.first(F.lit("m")).alias("model"), F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("answer"))).alias("objects"))
    made.select(F.monotonically_increasing_id().alias("run"), "model", "objects").write.partitionBy("run").json(path)
    return io.read_answers(spark, path, "model string, objects array<struct<id bigint, answer string>>").drop("run")


@written("a8_line_metadata", "orders", "lineitem", sql="""
WITH t AS (SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS class, arg_min(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END, o_orderkey) AS subclass FROM {orders} GROUP BY 1), l AS (SELECT l_suppkey AS k, count(*) AS n_lines, max(l_quantity) AS best FROM {lineitem} GROUP BY 1)
SELECT CAST(t.k AS VARCHAR) AS id, class, nullif(subclass, '') AS subclass, coalesce(n_lines, 0) AS n_lines, CAST(best AS DOUBLE) AS best FROM t LEFT JOIN l USING (k)""")
def a8(spark: SparkSession, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    path = work_path(spark, "csv")
    # Columns in another order, with one that isn't asked for; the first row of an id in the file counts, whole.
    types = orders.orderBy("o_orderkey").select(F.col("o_orderpriority").alias("class"), "o_comment" if "o_comment" in orders.columns else F.lit("x").alias("note"), F.col("o_custkey").alias("wiki_entity_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("subclass"))
    types.coalesce(1).write.csv(f"{path}/types", header=True)
    lineitem.select(F.col("l_quantity").alias("SNR"), F.col("l_suppkey").alias("wiki_entity_id"), F.col("l_returnflag").alias("LINE_NAME")).write.csv(f"{path}/lines", header=True)
    types, lines = io.read_line_metadata(spark, f"{path}/types", f"{path}/lines")
    n = lines.groupBy("wiki_entity_id").agg(F.count("*").alias("n_lines"), F.max("SNR").alias("best"))
    return types.join(n, "wiki_entity_id", "left").select(F.col("wiki_entity_id").alias("id"), "class", "subclass", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "best")


@written("a9_context_jsonl", "documents", sql="SELECT CAST(doc_id AS VARCHAR) AS object_id, length(text) AS n FROM {documents} WHERE trim(text) <> ''")
def a9(spark: SparkSession, documents: DataFrame) -> DataFrame:
    path = work_path(spark, "context")
    documents.select(F.col("doc_id").cast("string").alias("object_id"), F.col("text").alias("context")).where("trim(context) <> ''").write.json(path)
    return io.read_context_jsonl(spark, path, 10_000_000).select("object_id", F.length("context").cast("long").alias("n"))


@written("a10_load_benchmark", "orders", sql="SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS survey, CAST(o_totalprice AS DOUBLE) AS z, o_orderpriority AS redshift_bin FROM {orders}")
def a10(spark: SparkSession, orders: DataFrame) -> DataFrame:
    path = work_path(spark, "benchmark")
    truth = F.struct(F.col("o_totalprice").cast("double").alias("z"), F.col("o_orderpriority").alias("redshift_bin"))
    orders.select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("survey"), F.array("o_totalprice").alias("spectrum"), truth.alias("ground_truth")).write.parquet(path)
    return io.load_benchmark(spark, "redshift", path).select("sample_id", "survey", "ground_truth.z", "ground_truth.redshift_bin")


#: Splits drawn for all objects together, as the assignment of splits does it.
DRAWN = "SELECT object_id, split_upstream, CASE WHEN row_number() OVER (ORDER BY sha256(concat('42:', object_id))) <= round_even(count(*) OVER () * 0.1, 0) THEN 'val' WHEN row_number() OVER (ORDER BY sha256(concat('42:', object_id))) <= 2 * round_even(count(*) OVER () * 0.1, 0) THEN 'test' ELSE 'train' END AS split FROM {objects}"


@written("a12_write_manifest", "objects", sql=f"SELECT 'joint' AS tier, split, count(*) AS n FROM ({DRAWN}) GROUP BY split")
def a12(spark: SparkSession, objects: DataFrame) -> DataFrame:
    path = work_path(spark, "manifest")
    io.write_manifest(splits.assign_splits(objects.select("object_id").withColumn("tier", F.lit("joint"))), path)
    return spark.read.parquet(f"{path}/table").groupBy("tier", "split").agg(F.count("*").alias("n"))


@written("a12_manifest_stats", "objects", sql=f"""
WITH d AS ({DRAWN}), u AS (SELECT count(split_upstream) AS k FROM d)
SELECT 'n_objects' AS fact, CAST(count(*) AS VARCHAR) AS value FROM d UNION ALL SELECT 'split_' || split, CAST(count(*) AS VARCHAR) FROM d GROUP BY split UNION ALL SELECT 'tier_joint', CAST(count(*) AS VARCHAR) FROM d
UNION ALL SELECT 'given_' || split_upstream, CAST(count(*) AS VARCHAR) FROM d WHERE split_upstream IS NOT NULL GROUP BY split_upstream UNION ALL SELECT 'n_upstream', CAST(k AS VARCHAR) FROM u UNION ALL SELECT 'source', 'upstream+seeded_draw' UNION ALL SELECT 'thin', CASE WHEN count(*) < 100000 THEN 'joint' ELSE '' END FROM d""")
def a12_stats(spark: SparkSession, objects: DataFrame) -> DataFrame:
    path = work_path(spark, "manifest")
    drawn = splits.assign_splits(objects.select("object_id").withColumn("tier", F.lit("joint"))).join(objects.select("object_id", "split_upstream"), "object_id")
    io.write_manifest(drawn, path, least=100_000)
    stats = spark.read.schema("n_objects long, tier_histogram map<string,long>, split_histogram map<string,long>, split_source string, n_upstream_labelled_objects long, upstream_split_histogram map<string,long>, thin_tiers array<string>").json(f"{path}/stats")
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("fact"), value.cast("string").alias("value")))
    many = lambda prefix, c: F.transform(F.map_entries(c), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("fact"), e["value"].cast("string").alias("value")))
    facts = F.concat(one("n_objects", F.col("n_objects")), many("split_", "split_histogram"), many("tier_", "tier_histogram"), many("given_", "upstream_split_histogram"), one("n_upstream", F.col("n_upstream_labelled_objects")), one("source", F.col("split_source")), one("thin", F.array_join("thin_tiers", ",")))
    return stats.select(F.explode(facts).alias("f")).select("f.*")


def _captions(rows: DataFrame) -> DataFrame:
    claims = F.array(F.struct("text", F.array(F.lit("image")).alias("supporting")))
    wide = F.when(F.col("pos") % 2 == 0, F.array(F.lit("image"), F.lit("spectra"))).otherwise(F.array(F.lit("image")))
    return rows.select(F.concat_ws("-", "object_id", F.col("pos").cast("string")).alias("object_id"), "text", wide.alias("subset"), claims.alias("claims"))


@written("a13_write_captions", "quotes", sql="SELECT concat(object_id, '-', CAST(pos AS VARCHAR)) AS object_id, sha256(text) AS digest, CAST(CASE WHEN pos % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n FROM {quotes}")
def a13(spark: SparkSession, rows: DataFrame) -> DataFrame:
    out = io.write_captions(_captions(rows), work_path(spark, "captions"), rows.agg(F.count("*").alias("n_captions")))
    return out.select("object_id", F.sha2("text", 256).alias("digest"), F.size("subset").alias("n"))


@written("a13_review_and_report", "quotes", sql="""
WITH c AS (SELECT concat(object_id, '-', CAST(pos AS VARCHAR)) AS object_id, pos % 2 = 0 AS joint FROM {quotes}), r AS (SELECT object_id, row_number() OVER (PARTITION BY joint ORDER BY sha256(concat('0:', object_id)), object_id) AS k FROM c)
SELECT 'review' AS part, object_id AS value FROM r WHERE k <= 25 UNION ALL SELECT 'n_captions', CAST(count(*) AS VARCHAR) FROM c UNION ALL SELECT 'n_leakage_violations', '0'""")
def a13_review(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = work_path(spark, "captions")
    io.write_captions(_captions(rows), path, rows.agg(F.count("*").alias("n_captions")))
    review = spark.read.schema("object_id string").json(f"{path}/review").select(F.lit("review").alias("part"), F.col("object_id").alias("value"))
    report = spark.read.schema("n_captions long, n_leakage_violations long").json(f"{path}/report")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("value")) for c in report.columns])).alias("x")
    return review.unionByName(report.select(each).select("x.*"))


@written("a14_embedding_cache", "embeddings", sql="""
SELECT vec_id AS object_id, CASE WHEN vec_id % 4 = 1 THEN 8 ELSE 16 END AS n_tokens, 4 AS out_dim, 'image' AS modality, 'fixed' AS spec_impl,
round(CASE WHEN vec_id % 4 = 1 THEN 2 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 5) AS first FROM {embeddings} WHERE vec_id % 6 <> 0""")
def a14(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    path, nan = work_path(spark, "cache"), F.array(F.array(F.lit(float("nan"))))
    tokens = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.transform(F.slice("embedding", k * 4 + 1, 4), lambda x: x.cast("double")))
    rows = embeddings.select(F.col("vec_id").alias("object_id"), F.when(F.col("vec_id") % 6 == 0, nan).otherwise(tokens(16)).alias("embedding"), F.lit(16).alias("n_tokens"))
    cache = EmbeddingCache(spark, path, "image", {"impl": "fixed", "width": 4})
    cache.write(rows)
    # Another encoder's cache doesn't mix with it, and a second run of a part replaces that part.
    EmbeddingCache(spark, path, "image", {"impl": "other", "width": 4}).write(rows)
    again = embeddings.where("vec_id % 4 = 1 AND vec_id % 6 <> 0").select(F.col("vec_id").alias("object_id"), F.transform(tokens(8), lambda t: F.transform(t, lambda x: x * 2)).alias("embedding"), F.lit(8).alias("n_tokens"))
    index, _ = cache.write(again)
    held = cache.read().select("object_id", F.round(F.get(F.get("embedding", F.lit(0)), F.lit(0)), 5).alias("first"))
    return index.join(held, "object_id").select("object_id", "n_tokens", "out_dim", "modality", "spec_impl", "first")


@written("a15_append_ledger", "ledger", sql="SELECT object_id, max(seq) AS turn, count(*) AS n, count(DISTINCT seq % 2) AS n_runs FROM {ledger} GROUP BY 1")
def a15(spark: SparkSession, ledger: DataFrame) -> DataFrame:
    path = work_path(spark, "ledger")
    rows = ledger.select(F.concat_ws("-", "object_id", F.col("seq").cast("string")).alias("record_id"), "object_id", F.col("seq").alias("turn"), "status")
    # The first run is finished, the second leaves its tasks' files as they are.
    for run in (0, 1):
        sink = RecordSink(path, f"run-{run}", run, "record_id", flush_rows=500)
        sink.record(rows.where(F.col("turn") % 2 == run)).write.format("noop").mode("overwrite").save()
        if not run:
            keep_run(spark, path, sink.run)
    return read_records(spark, path, "record_id").groupBy("object_id").agg(F.max("turn").alias("turn"), F.count("*").alias("n"), F.count_distinct("seq").alias("n_runs"))


@written("a16_summary_csv", "results", sql="SELECT model, printf('%.4f', max(score) FILTER (WHERE task = '1-URGENT')) AS \"1-URGENT\", printf('%.4f', max(score) FILTER (WHERE task = '5-LOW')) AS \"5-LOW\" FROM {results} GROUP BY model")
def a16(spark: SparkSession, results: DataFrame) -> DataFrame:
    path = work_path(spark, "summary")
    io.export_summary_csv(results, ["1-URGENT", "5-LOW"], path)
    return spark.read.csv(path, header=True)


@written("a16_comparisons_csv", "predictions", sql="""
WITH s AS (SELECT regime, CAST(coalesce(truth = predicted, false) AS DOUBLE) AS a, CAST(coalesce(truth = predicted_b, false) AS DOUBLE) AS b FROM {predictions}), r AS (SELECT 'all' AS regime, a, b FROM s UNION ALL SELECT regime, a, b FROM s)
SELECT 'target' AS model_id, 'first' AS baseline_model, 'lines' AS task, regime, 'jaccard' AS metric, CAST(count(*) AS VARCHAR) AS num_samples, printf('%.4f', avg(a)) AS score_baseline, printf('%.4f', avg(b)) AS score_model, printf('%+.4f', avg(b - a)) AS delta_observed, true AS ordered FROM r GROUP BY regime""")
def a16_comparisons(spark: SparkSession, predictions: DataFrame) -> DataFrame:
    path = work_path(spark, "comparisons")
    io.export_comparisons_csv(resample.compare_all(_models(predictions), "target", regime_tasks=["lines"]), path, "target", {"lines": "jaccard"})
    back = spark.read.csv(path, header=True)
    number = lambda c: F.col(c).cast("double")
    ordered = number("delta_observed").between(number("ci_delta_lower"), number("ci_delta_upper")) & number("score_model").between(number("ci_model_lower"), number("ci_model_upper")) & ((number("p_value") < 0.05) == (F.col("is_significant") == "True"))
    return back.select("model_id", "baseline_model", "task", "regime", "metric", "num_samples", "score_baseline", "score_model", "delta_observed", ordered.alias("ordered"))


@written("v13_claims_json", "orders", sql="""
SELECT o_orderkey AS object_id, CASE o_orderkey % 7 WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'bad_band' WHEN 3 THEN 'bad_number' WHEN 4 THEN 'empty_quote' WHEN 5 THEN 'unknown_item_field' WHEN 6 THEN 'not_an_object' END AS problem FROM {orders} WHERE o_orderkey % 7 > 0""")
def v13(spark: SparkSession, orders: DataFrame) -> DataFrame:
    good = '{"peaks": [{"band": "g", "time_days": 1.5, "magnitude": 20, "quote": "x"}], "gaps": []}'
    bad = [good, good[:-1] + ', "colour": 1}', good.replace('"g"', '"z"'), good.replace("1.5", '"1.5"'), good.replace('"x"', '" "'), good.replace('"quote"', '"more": 1, "quote"'), "nothing"]
    rows = orders.select(F.col("o_orderkey").alias("object_id"), F.get(F.array(*[F.lit(b) for b in bad]), F.col("o_orderkey") % 7).alias("j"))
    return checks.bad_claims_json(rows, "object_id", "j")


@written("l1_stream_ledger", "ledger", sql="SELECT object_id, seq, status FROM {ledger} QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) = 1")
def l1(spark: SparkSession, ledger: DataFrame) -> DataFrame:
    path, out, at = (work_path(spark, n) for n in ("stream", "latest", "offsets"))
    rows = ledger.select("object_id", "seq", "status")
    for part in range(3):
        rows.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").json(path)
    streams.stream_ledger(spark, path, "object_id string, seq bigint, status string", out, at, per_trigger=1).awaitTermination()
    return streams.current_table(spark, out)


@written("l2_stream_scores", "predictions", sql="SELECT regime AS route, count(*) AS n, round(avg(CAST(coalesce(predicted = truth, false) AS INT)), 6) AS accuracy, round(avg(CAST(predicted IS NOT NULL AS INT)), 6) AS parse_rate FROM {predictions} GROUP BY 1")
def l2(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path, out, at = (work_path(spark, n) for n in ("stream", "scores", "offsets"))
    rows.select(F.col("regime").alias("route"), "truth", F.col("predicted").alias("answer")).repartition(3).write.json(path)
    sink = lambda df, _: df.write.mode("overwrite").parquet(out)
    streams.stream_scores(spark, path, "route string, truth string, answer string", at, sink, per_trigger=1).awaitTermination()
    done = spark.read.parquet(out)
    return done.select("route", "n", F.round("accuracy", 6).alias("accuracy"), F.round("parse_rate", 6).alias("parse_rate"))


