"""Ledgers that survive the death of a run, and budgets that follow what calls really cost."""

import collections
import glob
import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from skyframe.operators import infer
from skyframe.sources import records


def logged_client(log, deadly=None, refuses=None):
    """A client that notes each call in a file and ends its process at a deadly prompt."""

    def factory():
        def client(prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            if deadly and deadly in prompt:
                os._exit(1)
            if refuses and refuses(prompt):
                raise ValueError("refused")
            return infer.Reply(prompt.upper(), 1.0)

        return client

    return factory


def calls(log):
    return collections.Counter(pathlib.Path(log).read_text().split("\n")[:-1])


def test_killed_run_keeps_its_calls(spark, tmp_path):
    """Workers die in the middle of tasks; the next run calls the model only for what has no record."""
    path, log = f"file://{tmp_path}/ledger", str(tmp_path / "log")
    work = spark.createDataFrame([(k, f"p{k}") for k in range(60)], "k long, prompt string")
    run = lambda deadly: infer.resumable_run(work, lambda todo, sink: infer.generate(todo, "prompt", logged_client(log, deadly), "k", sink=sink, carry=infer.CONTRACT, concurrency=4), path, "k", "s", F.sha2("prompt", 256))
    with pytest.raises(Exception, match="(?i)worker|python|abort"):
        run("p33")
    first = calls(log)
    kept = records.read_records(spark, path, "k").count()
    assert 0 < kept == sum(first.values()) - first["p33"] and kept < 60
    assert glob.glob(f"{tmp_path}/ledger/loose/*/*/*.json")
    out = {r["k"]: r for r in run(None).collect()}
    both = calls(log)
    assert sorted(out) == list(range(60)) and all(r["answer"] == f"P{k}" for k, r in out.items())
    assert all(n == 1 for p, n in both.items() if p != "p33") and both["p33"] == first["p33"] + 1
    assert {r["seq"] for r in out.values()} == {1, 2}
    # A finished run is in few files; a third run has nothing to do.
    assert len(glob.glob(f"{tmp_path}/ledger/kept/*.json")) <= 8
    assert run(None).count() == 60 and calls(log) == both


def test_task_that_runs_again_repeats_nothing(spark, tmp_path):
    """What an earlier attempt of a task wrote is taken, torn and unfinished files are not."""
    path, log = f"file://{tmp_path}/ledger", str(tmp_path / "log")
    work = spark.createDataFrame([(k, f"p{k}") for k in range(10)], "k long, prompt string").coalesce(1)
    sink = records.RecordSink(path, "run-1", 1, "k")
    folder = tmp_path / "ledger/loose/run-1/part-000000"
    folder.mkdir(parents=True)
    old = {"k": 3, "answer": "earlier", "raw": "earlier", "n_calls": 1, "forced": False, "failure_reason": None, "seconds": 0.1, "cost": 1.0, "seq": 1, "attempt": 0}
    (folder / "000000000000-x.json").write_text(json.dumps(old) + "\n")
    (folder / "_000000000000-y").write_text('{"k": 4, "ans')
    got = {r["k"]: r["answer"] for r in infer.generate(work, "prompt", logged_client(log), "k", sink=sink).collect()}
    assert got == {k: "earlier" if k == 3 else f"P{k}" for k in range(10)}
    assert "p3" not in calls(log) and sum(calls(log).values()) == 9
    assert records.read_records(spark, path, "k").count() == 10


def test_repeats_count_once_and_schemas_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "k int, answer string, score double")
    sink = records.RecordSink(path, "run-1", 1, "k", flush_rows=2)
    sink.record(rows).write.format("noop").mode("overwrite").save()
    before = sorted(map(tuple, records.read_records(spark, path, "k").select("k", "answer", "score").collect()))
    assert before == [(1, "a", None), (2, None, 0.5)]
    # As after a crash between writing the finished run and removing its loose files.
    spark.read.schema(records.ledger_schema(path)).option("recursiveFileLookup", "true").json(f"{path}/loose").write.mode("append").json(f"{path}/kept")
    assert records.read_records(spark, path, "k").count() == 2
    records.keep_run(spark, path, "run-1")
    assert records.read_records(spark, path, "k").count() == 2 and not glob.glob(f"{tmp_path}/ledger/loose/run-1/*")
    with pytest.raises(ValueError, match="schema"):
        records.RecordSink(path, "run-2", 2, "k").record(rows.withColumn("score", F.lit("x")))
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, f"file://{tmp_path}/none", "k")


@pytest.mark.parametrize("rule", ["reserve", "reported"])
@pytest.mark.parametrize("limit", [60.0, 1e6])
def test_budget_equals_a_loop(spark, tmp_path, rule, limit):
    """Which objects are tried and what is spent, against one call after another."""
    facts = [(k, 4.0 + k % 5, 3.0 + 0.5 * (k % 3)) for k in range(30)]

    def factory():
        def client(prompt):
            k, cost = prompt.split()
            if int(k) % 6 == 5:
                error = ValueError("refused")
                error.cost = float(cost)
                raise error
            return infer.Reply("fine", float(cost))

        return client

    def loop(spent, done):
        tried = []
        for k, reserve, cost in facts:
            if k in done:
                continue
            if spent + reserve > limit:
                break
            tried.append(k)
            failed = k % 6 == 5
            spent += reserve if failed and rule == "reserve" else cost
            if not failed:
                done.add(k)
        return spent, tried

    work = spark.createDataFrame([(k, f"{k} {cost}", reserve) for k, reserve, cost in facts], "k long, prompt string, r double")
    path, done, spent = f"file://{tmp_path}/ledger", set(), 0.0
    step = lambda todo, sink: infer.generate(todo, "prompt", factory, "k", retries=1, sink=sink, carry=infer.BUDGETED)
    for _ in range(2):  # the second time objects that failed are tried again
        before = {r["k"]: r["seq"] for r in records.latest_records(spark, path, "k").collect()} if done else {}
        last = max(before.values(), default=0)
        out = infer.budgeted_run(work, step, path, "k", "s", F.sha2("prompt", 256), F.col("r"), "k", limit, rule, flush_rows=50)
        spent, tried = loop(spent, done)
        assert sorted(r["k"] for r in out.collect() if r["seq"] > last) == tried
        assert infer.true_spend(records.read_records(spark, path, "k"), F.col("failure_reason").isNull(), rule) == spent <= limit


def test_budget_below_the_first_reserve(spark, tmp_path):
    work = spark.createDataFrame([(1, "a")], "k long, prompt string")
    step = lambda todo, sink: infer.generate(todo, "prompt", logged_client(str(tmp_path / "log")), "k", sink=sink, carry=infer.BUDGETED)
    with pytest.raises(infer.ValidationError):
        infer.budgeted_run(work, step, f"file://{tmp_path}/l", "k", "s", F.sha2("prompt", 256), F.lit(5), "k", 4.0)
    assert not (tmp_path / "log").exists()


def test_files_of_a_finished_run_grow_in_number(spark, tmp_path):
    """No file of a finished run, and so no task that rewrites it, gets much more than the bound, however long the run."""
    path, sink = f"file://{tmp_path}/ledger", None
    sink = records.RecordSink(path, "run-1", 1, "k", flush_rows=50)
    rows = spark.range(0, 4000, 1, 40).selectExpr("id AS k", "repeat('x', 200) AS answer")
    sink.record(rows).write.format("noop").mode("overwrite").save()
    total = sum(p.stat().st_size for p in tmp_path.rglob("*.json"))
    records.keep_run(spark, path, "run-1", files=2, file_bytes=total // 16)
    kept = [p.stat().st_size for p in (tmp_path / "ledger/kept").glob("*.json")]
    assert len(kept) >= 8 and max(kept) < total / 4
    assert sorted(r["k"] for r in records.read_records(spark, path, "k").collect()) == list(range(4000))
