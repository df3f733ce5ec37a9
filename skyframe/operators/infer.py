"""Encoders, generators and judges over tables, with budgets and resumable ledgers.

Models are plug-ins: a factory is called once in each task's Python worker, and rows reach it in Arrow batches. What a call does
to a row is data (an answer, or a failure reason), never a crash of the job.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import nullcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.operators.checks import ValidationError, stale_records
from skyframe.operators.joins import pending
from skyframe.operators.lineage import settled
from skyframe.sources.records import RecordSink, keep_run, latest_records, ledger_schema, read_records


def encode(df: DataFrame, values: str, factory: Callable[[], Callable], width: int, spec_hash: str, key: str = "object_id") -> DataFrame:
    """(key, embedding, n_tokens, spec_hash): token arrays of width ``width`` by a plug-in that takes a list of arrays.

    A plug-in that returns another width is an error.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            out = [np.asarray(x, float) for x in model([np.asarray(v, float) for v in b[values]])]
            if any(x.ndim != 2 or x.shape[1] != width for x in out):
                raise ValidationError(f"encoder output isn't {width} wide")
            yield pd.DataFrame({key: b[key], "embedding": [x.tolist() for x in out], "n_tokens": [len(x) for x in out], "spec_hash": spec_hash})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, values).mapInPandas(run, f"{key} {kind}, embedding array<array<double>>, n_tokens int, spec_hash string")


def projection_encoder(width: int = 4, seed: int = 7) -> Callable[[], Callable]:
    """A deterministic stand-in: fixed random projections of the array, one token for each block of ``width`` values."""

    def factory():
        matrix = np.random.default_rng(seed).normal(size=(width, width))

        def run(arrays):
            for a in arrays:
                padded = np.resize(np.append(a, np.zeros((-len(a)) % width)), max(width, -(-len(a) // width) * width))
                yield padded.reshape(-1, width) @ matrix

        return run

    return factory


#: Lengths of the prefixes of an order by which costs are summed.
ORDER_PREFIXES = (6, 12, 18, 21)
RESULT = "answer string, raw string, n_calls int, forced boolean, failure_reason string, seconds double, cost double"


class Reply(str):
    """A client's answer with what the call cost. An exception may have a ``cost``, too."""

    def __new__(cls, text: str, cost: float = 0.0):
        out = super().__new__(cls, text)
        out.cost = cost
        return out


def generate(df: DataFrame, prompt: str, factory: Callable[[], Callable[[str], str]], key: str, retries: int = 3, delay: float = 0.0, parse: Callable[[str], str | None] | None = None, second: Callable[[str, str], str] | None = None, concurrency: int | None = None, sink: RecordSink | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Answers to prompts: ``factory`` gives a client, errors are retried with doubling delay.

    If ``parse`` finds nothing, ``second`` makes a forced follow-up prompt from prompt and answer. The number of
    partitions is the number of calls at a time. ``cost`` adds up what all calls of a row report. With a ``sink`` each
    answer is written as soon as it is there, with the columns ``carry``; a task that runs again takes the answers that
    its earlier attempts wrote.
    """
    fields = [x.split()[0] for x in RESULT.split(", ")]

    def call(client, text: str) -> tuple[str | None, int, str | None, float]:
        wait, why, cost = delay, None, 0.0
        for n in range(1, retries + 1):
            try:
                reply = client(text)
                return reply, n, None, cost + getattr(reply, "cost", 0.0)
            except Exception as e:  # the service's own errors, whatever they are, become data
                why, cost = f"{type(e).__name__}: {e}", cost + getattr(e, "cost", 0.0)
                if wait and n < retries:
                    time.sleep(wait)
                    wait *= 2
        return None, retries, why, cost

    def ask(client, text: str | None) -> dict:
        began = time.time()
        raw, n, why, cost = (None, 0, "no prompt", 0.0) if text is None else call(client, text)
        answer, forced = (parse(raw) if parse else raw) if raw is not None else None, False
        if raw is not None and answer is None and second:
            raw, more, why, extra = call(client, second(text, raw))
            n, forced, cost = n + more, True, cost + extra
            answer = parse(raw) if raw is not None else None
        plain = lambda x: None if x is None else str(x)
        return dict(zip(fields, (plain(answer), plain(raw), n, forced, why, time.time() - began, cost), strict=True))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        with sink.open() if sink else nullcontext() as out:
            for b in batches:
                lead, rows = [key, *carry], []
                for *own, text in b[[*lead, prompt]].itertuples(index=False, name=None):
                    own = dict(zip(lead, [x.item() if isinstance(x, np.generic) else x for x in own], strict=True))
                    done = out.known.get(own[key]) if out else None
                    row = done or own | ask(client, text)
                    if out and not done:
                        out.append(row)
                    rows.append([row[c] for c in [*lead, *fields]])
                yield pd.DataFrame(rows, columns=[*lead, *fields])

    lead = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *carry])
    if sink:
        sink.prepare(f"{lead}, {RESULT}")
    rows = df.select(*dict.fromkeys([key, *carry, prompt]))
    return (rows.repartition(concurrency, key) if concurrency else rows).mapInPandas(run, f"{lead}, {RESULT}")


def judge(captions: DataFrame, caption: str, factory, labels: list[str], key: str, template: str = "Classes: {classes}\nCaption: {caption}\nNumber:") -> DataFrame:
    """(key, predicted, failed): class of a caption by number; blank captions give null without a call."""
    from skyframe.functions.text import fill_template, predict_code

    blank = F.coalesce(F.trim(caption), F.lit("")) == ""
    classes = "; ".join(f"{i} {v}" for i, v in enumerate(labels))
    asked = captions.select(key, fill_template(template, classes=F.lit(classes), caption=F.col(caption)).alias("prompt"), blank.alias("_blank"))
    answers = generate(asked.where("NOT _blank"), "prompt", factory, key)
    out = captions.select(key).join(answers, key, "left")
    return out.select(key, predict_code(F.col("answer"), {str(i): v for i, v in enumerate(labels)}).alias("predicted"), F.coalesce(F.col("failure_reason").isNotNull(), F.lit(False)).alias("failed"))


def reserve(prompt: Column, output_tokens: int, input_price: float, output_price: float, extra_tokens: int = 0, by_bytes: bool = False) -> Column:
    """Greatest possible cost of a call: prompt length as a bound on input tokens, and the whole output allowance."""
    size = F.octet_length(prompt) if by_bytes else F.length(prompt)
    return (size + extra_tokens) * F.lit(input_price) + output_tokens * output_price


def within_budget(df: DataFrame, cost: str, limit: float, order: str, spent: float = 0.0) -> DataFrame:
    """Rows in order before the first one that would cross the limit; rows without an order are left out.

    Costs are summed by prefixes of the order of 21, 18, ... characters, each sum from the one below it. What lies before
    a prefix is what lies before its parent and its earlier siblings, so no task accumulates more than the siblings of
    one prefix. Numbers are compared as numbers (not negative), texts as texts.
    """
    from pyspark.sql import Window

    text = F.col(order) if df.schema[order].dataType.simpleString() == "string" else F.lpad(F.col(order).cast("string"), 24, "0")
    dealt = df.where(F.col(order).isNotNull()).withColumn("_bucket", F.substring(text, 1, ORDER_PREFIXES[-1]))
    sums = [dealt.groupBy("_bucket").agg(F.sum(cost).alias("_sum"))]
    for size in reversed(ORDER_PREFIXES[:-1]):
        sums.append(sums[-1].groupBy(F.substring("_bucket", 1, size).alias("_bucket")).agg(F.sum("_sum").alias("_sum")))
    before = None
    for level, parent in zip(reversed(sums), [0, *ORDER_PREFIXES[:-1]], strict=True):
        level = level.withColumn("_parent", F.substring("_bucket", 1, parent))
        earlier = F.sum("_sum").over(Window.partitionBy("_parent").orderBy("_bucket")) - F.col("_sum")
        level = level.select("_bucket", "_parent", earlier.alias("_earlier"))
        if before is None:
            before = level.select("_bucket", F.col("_earlier").alias("_before"))
        else:
            above = before.select(F.col("_bucket").alias("_parent"), F.col("_before").alias("_above"))
            before = level.join(above, "_parent").select("_bucket", (F.col("_above") + F.col("_earlier")).alias("_before"))
    run = F.sum(cost).over(Window.partitionBy("_bucket").orderBy(order))
    return dealt.join(before, "_bucket").withColumn("running", F.col("_before") + run + spent).where(F.col("running") <= limit).drop("_bucket", "_before")


def usage_spend(ledger: DataFrame, run: str, input_tokens: str, output_tokens: str, input_price: float, output_price: float) -> DataFrame:
    """(run, n_calls, spend)."""
    cost = F.coalesce(input_tokens, F.lit(0)) * F.lit(input_price) + F.coalesce(output_tokens, F.lit(0)) * F.lit(output_price)
    return ledger.groupBy(run).agg(F.count("*").alias("n_calls"), F.round(F.sum(cost), 6).alias("spend"))


def runtime_summary(df: DataFrame, seconds: str) -> DataFrame:
    return df.agg(F.round(F.sum(seconds), 6).alias("total_seconds"), F.round(F.avg(seconds), 6).alias("mean_seconds"))


def resumable_run(worklist: DataFrame, step: Step, path: str, key: str, settings_hash: str, input_hash: Column, resume: bool = True, success: Column | None = None, flush_rows: int = 1, flush_seconds: float = 10.0) -> DataFrame:
    """Run ``step`` on objects without a success in the ledger at ``path``; returns the latest record of each object.

    ``step(todo, sink)`` gives a DataFrame whose tasks write records to the sink: ``generate(todo, ..., sink=sink,
    carry=CONTRACT)``, or ``sink.record(df)`` for a DataFrame with the record's columns. Records carry ``input_hash`` and
    ``settings_hash`` of the worklist. What tasks have written before a run dies counts in the next one. An existing
    ledger is refused without ``resume``, and when its settings or an object's input have changed.
    """
    if ledger_schema(path) is not None and not resume:
        raise ValidationError(f"{path} exists")
    ok = success if success is not None else F.col("failure_reason").isNull()
    todo, seq = _todo(_contract(worklist, settings_hash, input_hash), path, key, ok)
    _run_once(todo, seq + 1, step, path, key, flush_rows, flush_seconds)
    return latest_records(worklist.sparkSession, path, key)


Step = Callable[[DataFrame, RecordSink], DataFrame]
CONTRACT = ("input_hash", "settings_hash")
BUDGETED = (*CONTRACT, "reserve")


def _contract(worklist: DataFrame, settings_hash: str, input_hash: Column) -> DataFrame:
    return worklist.withColumn("input_hash", input_hash).withColumn("settings_hash", F.lit(settings_hash))


def _todo(work: DataFrame, path: str, key: str, ok: Column) -> tuple[DataFrame, int]:
    """(work without a success in the ledger, number of the last run); a ledger of other settings or inputs is an error."""
    if ledger_schema(path) is None:
        return work, 0
    spark = work.sparkSession
    stale = stale_records(read_records(spark, path, key), work.select(key, *CONTRACT), key, ["settings_hash", "input_hash"], ~ok, "input_hash").limit(3).collect()
    if stale:
        raise ValidationError(f"ledger of other settings or inputs: {[tuple(r) for r in stale]}")
    last = latest_records(spark, path, key)
    return pending(work, last.where(ok).select(key), key), last.agg(F.max("seq")).first()[0] or 0


def _run_once(todo: DataFrame, seq: int, step: Step, path: str, key: str, flush_rows: int, flush_seconds: float) -> None:
    sink = RecordSink(path, f"run-{seq:06d}-{uuid.uuid4().hex}", seq, key, flush_rows, flush_seconds)
    step(todo, sink).write.format("noop").mode("overwrite").save()
    keep_run(todo.sparkSession, path, sink.run)


def true_spend(records: DataFrame, ok: Column, failed: str = "reserve") -> float:
    """What the calls of a ledger have cost: ``cost`` of a success, and of a failed call its ``reserve`` or its reported ``cost``."""
    if failed not in ("reserve", "reported"):
        raise ValueError(f"failed calls cost their reserve or what is reported, not {failed}")
    lost = F.col("reserve") if failed == "reserve" else F.coalesce("cost", F.lit(0.0))
    return float(records.agg(F.sum(F.when(ok, F.coalesce("cost", F.lit(0.0))).otherwise(lost))).first()[0] or 0.0)


def budgeted_run(worklist: DataFrame, step: Step, path: str, key: str, settings_hash: str, input_hash: Column, reserve: Column, order: str, limit: float, failed: str = "reserve", success: Column | None = None, flush_rows: int = 1, flush_seconds: float = 10.0) -> DataFrame:
    """A resumable run that stops before the first object, in ``order``, whose reserve would cross the limit.

    The objects are those that a loop over them would do which, before each call, adds its reserve to what the calls so
    far really cost. They are done in waves: a wave is all next objects whose reserves together fit what is left, so the
    loop would do each of them; then the ledger's true spend takes the reserves' place. Waves end when not even the next
    object fits. That is exact as long as no call costs more than its reserve. Each object is tried once, and spend
    counts every call in the ledger. Records must carry ``reserve`` besides the contract: ``carry=BUDGETED``.
    """
    spark, ok = worklist.sparkSession, success if success is not None else F.col("failure_reason").isNull()
    work = _contract(worklist, settings_hash, input_hash).withColumn("reserve", reserve.cast("double"))
    todo, seq = _todo(work, path, key, ok)
    # Reserves are summed in order once; a wave is what lies between two of these sums.
    line = settled(within_budget(todo, "reserve", float("inf"), order))
    low, after = 0.0, F.lit(True)
    while True:
        spent = true_spend(read_records(spark, path, key), ok, failed) if ledger_schema(path) is not None else 0.0
        wave = line.where(after & (F.col("running") - low + spent <= limit))
        last = wave.agg(F.max("running")).first()[0]
        if last is None:
            break
        seq += 1
        _run_once(wave.drop("running"), seq, step, path, key, flush_rows, flush_seconds)
        low, after = last, F.col("running") > last
    line.unpersist()
    if ledger_schema(path) is None:
        raise ValidationError("the limit is below the first object's reserve")
    return latest_records(spark, path, key)


def evaluate_captions(benchmark: DataFrame, captions: DataFrame, factory, letters: dict[str, str], template: str, key: str = "sample_id", classes: dict[str, str] | None = None) -> DataFrame:
    """(key, truth, predicted, correct, failed): benchmark with captions, prompts with lettered options, answers, scores."""
    from skyframe.functions.text import fill_template, is_correct, lettered, parse_task_answer
    from skyframe.operators.joins import attach_captions

    rows = attach_captions(benchmark, captions, key)
    options = lettered(F.array(*[F.lit(v) for v in letters.values()]))
    asked = rows.select(key, fill_template(template, options=options, caption=F.col("caption")).alias("prompt"))
    answers = generate(asked, "prompt", factory, key)
    out = rows.select(key, "truth").join(answers, key)
    predicted = parse_task_answer(F.col("answer"), letters, classes)
    return out.select(key, "truth", predicted.alias("predicted"), is_correct(predicted, F.col("truth")).alias("correct"), F.col("failure_reason").isNotNull().alias("failed"))


def evaluation_summary(scored: DataFrame, task: str) -> DataFrame:
    """One row for a task: samples, those answered, those right, accuracy; all zero where nothing was scored."""
    rate = F.coalesce(F.round(F.avg(F.col("correct").cast("int")), 6), F.lit(0.0))
    return scored.agg(F.count("*").alias("total_samples"), F.count("predicted").alias("n_answered"), F.count_if("correct").alias("n_correct"), rate.alias("accuracy")).withColumn("task_name", F.lit(task))
