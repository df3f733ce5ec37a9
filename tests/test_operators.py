"""Hand-made cases, properties and brute force for operators that SQL can't cover."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import columns as c
from skyframe.functions import text as t
from skyframe.operators import captions, checks, clean, infer, joins, lightcurves, resample, scoring, splits
from skyframe.sources import io
from skyframe.streaming import ledger as streams


def sep(a, b):
    (r1, d1), (r2, d2) = (map(math.radians, x) for x in (a, b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(h))) * 3600


def test_crossmatch_wraps_and_poles(spark):
    rng = random.Random(1)
    spots = [(0.0, 0.0), (359.9999, 10.0), (120.0, 89.9995), (10.0, -90.0), (200.0, 45.0), (0.0001, -30.0)]
    near = lambda p: ((p[0] + rng.uniform(-3e-3, 3e-3) / max(1e-3, math.cos(math.radians(p[1])))) % 360, max(-90.0, min(90.0, p[1] + rng.uniform(-3e-3, 3e-3))))
    a = [(f"a{i}", *near(rng.choice(spots))) for i in range(150)] + [("null", None, None)]
    b = [(f"b{i:03d}", *near(rng.choice(spots))) for i in range(150)]
    fa, fb = (spark.createDataFrame(x, "object_id string, ra double, dec double") for x in (a, b))
    for radius in (1.0, 5.0):
        want = {}
        for i, *p in a[:-1]:
            best = min((sep(p, q), j) for j, *q in b)
            if best[0] <= radius:
                want[i] = best[1]
        out = joins.crossmatch(fa, fb, radius).collect()
        got = {r["object_id"]: r["object_id_right"] for r in out if r["object_id"] and r["object_id_right"]}
        assert got == want
        assert sorted(r["object_id_right"] for r in out if r["object_id"] is None) == sorted(set(j for j, *_ in b) - set(want.values()))
        assert sum(r["object_id"] is not None for r in out) == len(a)


def quota_loop(sizes, n, least):
    share = [s * n / sum(sizes) for s in sizes]
    q = [min(s, max(least, math.floor(x))) for s, x in zip(sizes, share)]
    rank = sorted(range(len(sizes)), key=lambda i: (-(share[i] - math.floor(share[i])), i))
    while sum(q) != n:
        moved = False
        for i in rank if sum(q) < n else rank[::-1]:
            if sum(q) < n and q[i] < sizes[i]:
                q[i] += 1
                moved = True
            elif sum(q) > n and q[i] > min(sizes[i], least):
                q[i] -= 1
                moved = True
            if sum(q) == n:
                break
        if not moved:
            return None
    return q


def test_quotas_against_loop(spark):
    rng = random.Random(2)
    for _ in range(12):
        sizes = [rng.randrange(1, 40) for _ in range(4)]
        n, least = rng.randrange(1, sum(sizes) + 1), rng.randrange(6)
        want = quota_loop(sizes, n, least)
        if want is None:
            continue
        rows = [(f"{k}-{i}", "abcd"[k]) for k, s in enumerate(sizes) for i in range(s)]
        df = spark.createDataFrame(rows, "object_id string, label string")
        got = {r["label"]: r["quota"] for r in splits.class_quotas(df, "label", n, list("abcd"), least).collect()}
        assert [got[x] for x in "abcd"] == want


def test_splits(spark):
    rows = [(str(i), "joint" if i < 60 else "single", "test" if i % 9 == 0 else ("train" if i % 2 else None)) for i in range(200)]
    df = spark.createDataFrame(rows, "object_id string, tier string, up string")
    out = splits.assign_splits(df, policy="joint_only").collect()
    assert {r["split"] for r in out if r["tier"] == "single"} == {"train"}
    assert sum(r["split"] == "val" for r in out) == 6 and sum(r["split"] == "test" for r in out) == 6
    up = splits.assign_splits(df, upstream="up").collect()
    assert all(r["split"] == "test" for r in up if r["up"] == "test") and not any(r["split"] == "test" for r in up if r["up"] == "train")
    with pytest.raises(checks.ValidationError):
        splits.assign_splits(df.where("tier = 'single'"), policy="joint_only")
    over = splits.assign_splits(df, overrides={"joint": (0.5, 0.0)}).collect()
    assert sum(r["split"] == "val" for r in over if r["tier"] == "joint") == 30
    assert sorted(map(tuple, splits.assign_splits(df.repartition(7)).collect())) == sorted(map(tuple, splits.assign_splits(df).collect()))


def test_bootstrap_matches_binomial(spark):
    df = spark.createDataFrame([(float(i < 60),) for i in range(200)], "s double")
    r = resample.bootstrap_ci(df, "s", 4000).first()
    half = 1.96 * math.sqrt(0.3 * 0.7 / 200)
    assert r["value"] == pytest.approx(0.3) and r["low"] == pytest.approx(0.3 - half, abs=0.01) and r["high"] == pytest.approx(0.3 + half, abs=0.01)
    again = resample.bootstrap_ci(df.repartition(5), "s", 4000).first()
    assert tuple(again) == tuple(r)
    assert resample.bootstrap_ci(df.limit(0), "s").first()["value"] == 0.0 and resample.bootstrap_ci(df.limit(1), "s").first()["n"] == 1
    p = resample.poisson_ci(df, "s", 800).first()
    assert p["low"] == pytest.approx(r["low"], abs=0.02) and p["high"] == pytest.approx(r["high"], abs=0.02)


def test_paired_and_stratified(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", "a" if i % 3 else "b", float(i % 5 == 0), float(i % 4 == 0)) for i in range(300)], "truth string, predicted string, x double, y double")
    r = resample.paired_bootstrap(df, "x", "y", 1000).first()
    assert r["delta"] == pytest.approx(r["treatment"] - r["base"]) and 0 <= r["p_value"] <= 1
    same = resample.paired_bootstrap(df, "x", "x", 200).first()
    assert same["delta"] == 0 and same["p_value"] == 1
    out = {m["metric"]: m for m in resample.stratified_bootstrap(df, "truth", "predicted", ["a", "b"], 500).collect()}
    assert out["accuracy"]["low"] <= out["accuracy"]["value"] <= out["accuracy"]["high"]
    with pytest.raises(checks.ValidationError):
        resample.stratified_bootstrap(df, "truth", "predicted", ["a", "b", "z"], 10)


def test_ids_and_duplicates(spark):
    rows = [("b'  12'", 2.0, 1), (" 12 ", 1.0, 2), ("12", None, 3), ("b1234", 5.0, 4), (None, 1.0, 5)]
    df = spark.createDataFrame(rows, "object_id string, dist double, src int")
    with pytest.raises(Exception, match="no object_id"):
        clean.dedup_closest(clean.canonicalize_ids(df), "object_id", "dist", "src").collect()
    out = clean.dedup_closest(clean.canonicalize_ids(df.dropna(subset=["object_id"])), "object_id", "dist", "src").collect()
    assert sorted((r["object_id"], r["src"]) for r in out) == [("12", 2), ("b1234", 4)]
    assert tuple(clean.id_report(df).first()) == (5, 1, 2, 4, 2)


def test_prepare_groups_errors(spark):
    kinds = "object_id string, survey string"
    df = spark.createDataFrame([("1", "SDSS"), ("b'2'", " desi "), (" 3 ", "sdss"), ("2", "sdss")], kinds)
    assert sorted(map(tuple, clean.prepare_groups(df, "object_id", ["sdss", "desi"]).collect())) == [("1", "sdss"), ("2", "desi"), ("2", "sdss"), ("3", "sdss")]
    assert clean.prepare_groups(df, "object_id", ["sdss", "desi"], ids=["b'2'", " 3"]).count() == 3
    for bad, why in (((None, "sdss"), "no object_id"), (("  ", "sdss"), "empty object_id"), (("b''", "sdss"), "empty object_id"), (("9", "x"), "none of"), (("9", None), "none of")):
        with pytest.raises(Exception, match=why):
            clean.prepare_groups(df.unionByName(spark.createDataFrame([bad], kinds)), "object_id", ["sdss", "desi"]).collect()
    for wrong in ({"limit": -1}, {"ids": ["9"]}):
        with pytest.raises(ValueError):
            clean.prepare_groups(df, "object_id", ["sdss", "desi"], **wrong)
    with pytest.raises(ValueError, match="no objects"):
        clean.prepare_groups(df.limit(0), "object_id", ["sdss"])
    with pytest.raises(ValueError, match="missing"):
        clean.prepare_groups(df.drop("survey"), "object_id", ["sdss"])


def test_flagship_refuses_rows_without_an_id(spark):
    from skyframe.plans.manifest import build_manifest

    spectra = spark.createDataFrame([("1", 1, 0.1), (None, 2, 0.2)], "object_id string, seq int, dist double")
    images = spark.createDataFrame([("1",), ("2",)], "object_id string")
    with pytest.raises(Exception, match="no object_id"):
        build_manifest(spectra, images).collect()
    assert build_manifest(spectra.where("seq = 1"), images).count() == 2


def test_arrays_of_unequal_length(spark):
    kinds = "object_id string, mjd array<double>, flux array<double>, err array<double>, band_id array<int>, used array<boolean>"
    good = ("a", [1.0, 2.0], [1.0, 2.0], [0.1, 0.1], [1, 2], [True, False])
    assert lightcurves.to_points(spark.createDataFrame([good, ("empty", [], [], [], [], [])], kinds)).count() == 2
    for at in range(1, 6):
        for short in (good[at][:1], None):
            bad = [*good]
            bad[0], bad[at] = "b", short
            with pytest.raises(Exception, match="arrays of b disagree"):
                lightcurves.to_points(spark.createDataFrame([good, tuple(bad)], kinds)).collect()


def test_digest_ignores_row_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "x")], "k string, n int, s string")
    one = dict(map(tuple, clean.group_digest(df, "k", ["n", "s"]).collect()))
    two = dict(map(tuple, clean.group_digest(df.orderBy(F.desc("n")).repartition(3), "k", ["s", "n"]).collect()))
    assert one == two and one["a"] != one["b"]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_answer_parsers(spark):
    lit = F.lit
    assert one(spark, t.predict_code(lit("value 2.5 then 7"), {"2": "two", "7": "seven"})) == "two"
    assert one(spark, t.predict_code(lit("in 2019"), {"2": "two"})) is None
    words = {"SN Ia": ["type ia"], "SN II": [], "SN Ib/c": []}
    assert one(spark, t.last_mention(lit("SN II or SN Ia."), words)) == "SN Ia"
    assert one(spark, t.predict_free_text(lit("FINAL ANSWER: SN II\nnot SN Ia"), words)) == "SN II"
    assert one(spark, t.parse_final_sentence(lit("Hm. SN Ia, therefore SN Ia."), ["SN Ia", "SN II"])) is None
    assert one(spark, t.parse_final_sentence(lit("SN Ia?\nIt is SN II."), ["SN Ia", "SN II"])) == "SN II"
    assert one(spark, t.parse_single_choice(lit("FINAL ANSWER: (b)\nfinal answer: option [C]"), "ABC")) == "C"
    assert one(spark, t.parse_multi_choice(lit("FINAL ANSWER: NONE"), "ABC")) == []
    assert one(spark, t.parse_multi_choice(lit("FINAL ANSWER: NONE, but B and A, B"), "ABC")) == ["B", "A"]
    assert one(spark, t.parse_multi_choice(lit("A"), "ABC")) is None
    assert one(spark, t.parse_multi_choice(lit("FINAL ANSWER: A1, B"), "ABC")) == ["B"]
    assert one(spark, t.parse_multi_choice(lit("FINAL ANSWER: A_, éB, c."), "ABC")) == ["C"]
    assert one(spark, t.parse_multi_choice(lit("FINAL ANSWER: Z"), "ABC")) == []
    shapes = {"Round": ["disk"], "Merging": []}
    hedge = lit("resembles Merging, but is Round")
    assert one(spark, t.make_predictor("verbose_class", shapes)(lit("is Round, or Merging"), None)) == "Merging"
    assert one(spark, t.make_predictor("verbose_class", shapes)(hedge, None)) == "Round"
    assert one(spark, t.make_predictor("free_text", shapes)(lit("Merging, or a disk"), None)) == "Round"
    assert one(spark, t.make_predictor("older", {"Merging": [], "Round": []})(hedge, None)) == "Merging"
    with pytest.raises(ValueError):
        t.make_predictor("digit_code", shapes)
    task = {"A": "Galaxy", "B": "Quasar"}
    assert one(spark, t.parse_task_answer(lit("a Quasar, or a galaxy"), task)) == "Galaxy"
    assert one(spark, t.parse_task_answer(lit("galaxy. FINAL ANSWER: B"), task)) == "Quasar"
    assert one(spark, t.parse_task_answer(lit("a QSO"), task, {"QSO": "Quasar"})) == "Quasar"
    assert one(spark, t.parse_task_answer(lit("galaxies, QSOs"), task, {"QSO": "Quasar"})) is None
    assert one(spark, t.parse_lines_answer(lit("FINAL ANSWER: A, C"), {"A": "z", "B": "y", "C": "x"}, F.array(lit("x"), lit("q")))) == ["x"]
    assert one(spark, t.extract_caption(lit('CAPTION: no\nCaption: "yes"'))) == "yes"
    assert one(spark, t.caption_target(lit("a b c d e"), "end now", 4)) == "a b end now"
    assert one(spark, t.caption_target(lit("  "), "end", 4)) == ""
    assert one(spark, c.distance_regime(lit(0.5))) == "intermediate"
    assert one(spark, c.clean_quotes(F.array(lit(" x" * 12), lit("short"), lit("x" + " x" * 11)))) == ["x" + " x" * 11]


def test_sets(spark):
    s = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    got = lambda a, b: [one(spark, v) for v in scoring.set_scores(a, b).values()]
    assert got(s(), s()) == [1, 1, 1] and got(s(), s("a")) == [0, 0, 0] and got(s(), F.lit(None).cast("array<string>")) == [1, 1, 1]
    assert got(s("a", "b"), s("b", "c")) == [pytest.approx(1 / 3), 0.5, 0]


def test_light_curve(spark):
    rows = [("o", i, 100.0 + i, 60.0 if i in (40, 50) else 1.0, 10.0, 1, i != 45) for i in range(80)] + [("q", i, float(i), 1.0, 10.0, 2, True) for i in range(5)]
    df = spark.createDataFrame(rows, "object_id string, pos int, mjd double, flux double, err double, band_id int, used boolean")
    out = lightcurves.prepare_points(df, 10).collect()
    o = [r for r in out if r["object_id"] == "o"]
    assert len(o) == 10 and all(110 <= r["mjd"] <= 150 and r["mjd"] != 145 for r in o) and sum(r["object_id"] == "q" for r in out) == 5
    assert lightcurves.detection_window(df).where("object_id = 'o'").count() == 40
    padded = {r["object_id"]: r for r in lightcurves.pad_points(lightcurves.prepare_points(df, 10), 8).collect()}
    assert len(padded["q"]["flux"]) == 8 and sum(padded["q"]["mask"]) == 3 and padded["q"]["t"][0] == 0
    table = lightcurves.render_table(df)
    back = lightcurves.parse_table(table, "object_id", "table")
    assert back.where("ok").count() == 84 and back.where("NOT ok").count() == 0


def test_captions_and_leaks(spark):
    claims = spark.createDataFrame([("a", 0, "i", ["image"]), ("a", 1, "s", ["spectra"]), ("a", 2, "both", ["image", "spectra"]), ("b", 0, "i", ["image"]), ("b", 1, "l", ["lightcurve", "spectra"])], "object_id string, claim_pos int, text string, supporting array<string>")
    have = spark.createDataFrame([("a", ["image", "spectra"]), ("b", ["image"])], "object_id string, subset array<string>")
    out = {(r["object_id"], "+".join(r["subset"])): r["text"] for r in captions.compose_captions(claims, have).collect()}
    assert out == {("a", "image"): "i", ("a", "spectra"): "s", ("a", "image+spectra"): "i s both", ("b", "image"): "i"}
    assert captions.diversity_gate(spark.createDataFrame([("x",)] * 9 + [("y",)], "text string")).first()["passed"] is False


def test_swap_donors_never_self(spark):
    df = spark.createDataFrame([(str(i), "g" if i < 17 else "h", i % 3 > 0) for i in range(20)] + [("alone", "z", True)], "k string, g string, ok boolean")
    out = joins.swap_donors(df, "k", "g", 5).collect()
    assert len(out) == 20 and all(r["k"] != r["donor"] for r in out) and len({r["donor"] for r in out}) == 20
    assert all(int(r["donor"]) % 3 for r in joins.swap_donors(df, "k", "g", 5, "ok").collect())


def test_generate_retries_and_failures(spark):
    def factory():
        calls = {}

        def client(p):
            calls[p] = calls.get(p, 0) + 1
            if "bad" in p or ("once" in p and calls[p] < 2):
                raise RuntimeError("busy")
            return p.upper()

        return client

    df = spark.createDataFrame([(1, "fine"), (2, "once"), (3, "bad"), (4, None)], "k int, prompt string").coalesce(1)
    out = {r["k"]: r for r in infer.generate(df, "prompt", factory, "k", retries=2).collect()}
    assert out[1]["answer"] == "FINE" and out[2]["n_calls"] == 2 and out[3]["answer"] is None and "busy" in out[3]["failure_reason"] and out[4]["failure_reason"] == "no prompt"


def test_resume_refuses_changes(spark, tmp_path):
    work = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")
    step = lambda d, sink: sink.record(d.select("k", *infer.CONTRACT, F.lit("x").alias("answer"), F.lit("").alias("failure_reason")))
    run = lambda w, s, **o: infer.resumable_run(w, step, f"file://{tmp_path}/l", "k", s, F.sha2("prompt", 256), success=F.col("failure_reason") == "", **o)
    assert run(work, "s").count() == 2 and run(work, "s").count() == 2
    for bad in (lambda: run(work, "other"), lambda: run(work.withColumn("prompt", F.lit("new")), "s"), lambda: run(work, "s", resume=False)):
        with pytest.raises(checks.ValidationError):
            bad()


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        io.discover(spark, f"{root}/none")
    spark.createDataFrame([(1, "x")], "object_id long, a string").write.parquet(f"{root}/p1")
    spark.createDataFrame([("2", 3.0)], "object_id string, b double").write.parquet(f"{root}/p2")
    assert sorted(tuple(r) for r in io.read_union(spark, [f"{root}/p1", f"{root}/p2"]).select("object_id", "a", "b", "src_rank").collect()) == [("1", "x", None, 0), ("2", None, 3.0, 1)]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, rendered string")
    assert io.freeze_inputs(df, f"{root}/frozen", "v1", "id", "rendered").count() == 2
    assert io.freeze_inputs(df, f"{root}/frozen", "v1", "id", "rendered").count() == 2
    with pytest.raises(checks.ValidationError):
        io.freeze_inputs(df, f"{root}/frozen", "v2", "id", "rendered")
    with pytest.raises(checks.ValidationError):
        io.write_manifest(spark.createDataFrame([("a", "joint", "train")], "id string, tier string, split string"), f"{root}/m")


def test_caption_lines_are_named(spark, tmp_path):
    """Errors name file and line, in files of several splits."""
    import json as j

    line = lambda k, c, **o: j.dumps({"object_key": k, "output": {"caption": c, **o}})
    root = f"file://{tmp_path}"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        good = [line(f" k{i} ", f" caption {i} ") for i in range(60)] + ["", "   ", line("k1", "caption 1"), line("s", " INSUFFICIENT_SPECTRAL_DATA"), line("f", "x", is_insufficient=True), line("g", "kept", is_insufficient=False), line("  ", "x"), line("n", None), j.dumps({"object_key": "o"}), j.dumps({"object_key": 5, "output": {"caption": "x"}}), line("e", " "), j.dumps({"output": None, "object_key": "z"})]
        (tmp_path / "good.jsonl").write_text("\n".join(good))
        found, counts = io.read_caption_jsonl(spark, f"{root}/good.jsonl")
        assert {r["object_key"]: r["caption"] for r in found.collect()} == {f"k{i}": f"caption {i}" for i in range(60)} | {"g": "kept"}
        assert {r["status"]: r["n"] for r in counts.collect()} == {"usable": 61, "duplicate": 1, "insufficient": 2, "missing": 6}
        for k, (bad, why) in enumerate([("broken", "invalid JSON"), ("[1]", "no object"), ('{"object_key": "a", "output": 3}', "output is no object"), ('{"object_key": "a", "output": {"caption": 3}}', "caption is no text"), (line("k7", "another"), "second caption for k7")]):
            rows = [*good[:45], bad, *good[45:]]
            (tmp_path / f"bad{k}.jsonl").write_text("\n".join(rows))
            with pytest.raises(checks.ValidationError, match=f"bad{k}.jsonl:46: {why}"):
                io.read_caption_jsonl(spark, f"{root}/bad{k}.jsonl")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_metadata_by_name_and_file_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("wiki_entity_id,class,subclass\nb,GALAXY,AGN\na,STAR,\nb,QSO,BL\na,QSO,X\n")
    (tmp_path / "l.csv").write_text("SNR,LINE_NAME,wiki_entity_id\n2.5,OII,a\n")
    types, lines = io.read_line_metadata(spark, f"file://{tmp_path}/t.csv", f"file://{tmp_path}/l.csv")
    assert sorted(map(tuple, types.collect())) == [("a", "STAR", None), ("b", "GALAXY", "AGN")]
    assert list(map(tuple, lines.collect())) == [("a", "OII", 2.5)]
    (tmp_path / "w.csv").write_text("id,class,subclass\n")
    with pytest.raises(checks.ValidationError, match="wiki_entity_id"):
        io.read_line_metadata(spark, f"file://{tmp_path}/w.csv", f"file://{tmp_path}/l.csv")


def test_benchmark_registry(spark, tmp_path):
    root = f"file://{tmp_path}"
    good = spark.createDataFrame([("1", "sdss", [1.0], (0.5, "close"))], "sample_id string, survey string, spectrum array<double>, ground_truth struct<z: double, redshift_bin: string>")
    good.write.parquet(f"{root}/good")
    assert io.load_benchmark(spark, "redshift", f"{root}/good").count() == 1
    with pytest.raises(checks.ValidationError, match="source_class"):
        io.load_benchmark(spark, "source_class", f"{root}/good")
    with pytest.raises(checks.ValidationError, match="unknown"):
        io.load_benchmark(spark, "other", f"{root}/good")
    good.withColumn("ground_truth", F.create_map(F.lit("z"), F.lit(1.0))).write.parquet(f"{root}/map")
    with pytest.raises(checks.ValidationError, match="without a key"):
        io.load_benchmark(spark, "redshift", f"{root}/map")
    for column, why in (("spectrum", "spectrum"), ("sample_id", "neither")):
        good.drop(column).write.parquet(f"{root}/{column}")
        with pytest.raises(checks.ValidationError, match=why):
            io.load_benchmark(spark, "redshift", f"{root}/{column}")
    good.unionByName(good).write.parquet(f"{root}/twice")
    with pytest.raises(checks.ValidationError, match="repeated"):
        io.load_benchmark(spark, "redshift", f"{root}/twice")


def test_leaking_captions_are_written_and_refused(spark, tmp_path):
    kinds = "object_id string, subset array<string>, text string, claims array<struct<text: string, supporting: array<string>>>"
    rows = [(f"o{i}", ["image"] if i % 2 else ["image", "spectra"], f"text {i}", [(f"text {i}", ["spectra"] if i in (2, 5) else ["image"])]) for i in range(80)]
    root = f"file://{tmp_path}/out"
    with pytest.raises(checks.ValidationError, match="1 claims outside"):
        io.write_captions(spark.createDataFrame(rows, kinds), root, spark.createDataFrame([(80,)], "n_captions int"))
    assert spark.read.parquet(f"{root}/captions").count() == 80 and spark.read.json(f"{root}/review").count() == 50
    assert spark.read.json(f"{root}/report").first()["n_leakage_violations"] == 1


def test_images_that_can_not_be_used(spark):
    from skyframe.operators import arrays

    kinds = "id int, images array<struct<band: string, flux: array<array<double>>>>"
    square, wide, holes = [[1.0, 2.0], [3.0, 4.0]], [[1.0, 2.0, 3.0], [3.0, 4.0, 5.0]], [[1.0, 2.0], None]
    stack = lambda images: spark.createDataFrame([(1, images)], kinds).select(arrays.image_stack(F.col("images"), ["G", "des-r"]).alias("s")).first()["s"]
    out = stack([("des-g", square), ("R", holes)])
    assert out[0] == square and out[1][0] == [1.0, 2.0] and all(math.isnan(x) for x in out[1][1])
    assert stack([("g", wide), ("r", square), ("x_g", square)])[0] == square
    for images, why in (([("g", square)], "band des-r is not available; bands present: g"), ([], "bands present: none"), ([("g", square), ("r", [None, None])], "no usable rows"), ([("g", square), ("r", [[1.0], [1.0, 2.0]])], "different widths: 1, 2"), ([("g", square), ("r", wide)], "unequal shapes: 2x2, 2x3")):
        with pytest.raises(Exception, match=why):
            stack(images)


def test_runs_without_a_common_sample(spark):
    a = spark.createDataFrame([("1", "x")], "k string, p string")
    with pytest.raises(checks.ValidationError, match="no sample in common"):
        joins.pair_predictions(a, a.withColumn("k", F.lit("2")), "k", ["p"])
    report = captions.caption_report(spark.createDataFrame([], "object_id string, subset array<string>, claims array<struct<text: string, supporting: array<string>>>"), spark.createDataFrame([], "kind string"), spark.createDataFrame([], "s string"), a.withColumnRenamed("k", "object_id")).first()
    assert report["survival_rate"] == 0.0 and report["n_leakage_violations"] == 0 and report["n_without_text"] == 1


def test_crossmatch_result_does_not_depend_on_layout(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), float(rng.uniform(0, 360)), float(rng.uniform(-90, 90))) for i in range(300)]
    a = spark.createDataFrame(rows, "object_id string, ra double, dec double")
    b = a.withColumn("object_id", F.concat(F.lit("b"), "object_id")).withColumn("dec", F.col("dec") * 0.9999999)
    same = [sorted(map(str, joins.crossmatch(x, y, 2.0).collect())) for x, y in ((a, b), (a.repartition(9), b.coalesce(1)))]
    assert same[0] == same[1]


def test_bootstrap_of_many_groups(spark):
    rows = [(f"m{g:04d}", "t", str(k), float((g * 7 + k * k) % 5)) for g in range(1100) for k in range(4)]
    scores = spark.createDataFrame(rows, "model string, task string, sample_id string, score double")
    own = scores.where("model = 'm1090'")
    by = {r["model"]: r for r in resample.bootstrap_by(scores, "score", "model", 20).collect()}
    one = resample.bootstrap_ci(own, "score", 20).first()
    assert len(by) == 1100 and all(abs(by["m1090"][c] - one[c]) < 1e-9 for c in ("value", "low", "high", "n"))
    pairs = {r["model"]: r for r in resample.compare_all(scores, "m0000", replicates=20).collect()}
    target = scores.where("model = 'm0000'").select("sample_id", F.col("score").alias("target"))
    one = resample.paired_bootstrap(own.join(target, "sample_id"), "score", "target", 20).first()
    assert len(pairs) == 1099 and all(abs(pairs["m1090"][c] - one[c]) < 1e-9 for c in one.asDict())
    odd = spark.createDataFrame([(None, 1.0), (7, None), (8, 2.0), (8, 4.0)], "g long, s double")
    assert sorted((str(r["g"]), r["value"], r["n"]) for r in resample.bootstrap_by(odd, "s", "g", 20).collect()) == [("7", 0.0, 0), ("8", 3.0, 2), ("None", 1.0, 1)]
    with pytest.raises(checks.ValidationError):
        resample.paired_bootstrap_by(odd, "s", "s", "g", 20)


def test_prose_holds_whole_texts(spark, sf):
    from skyframe import registry

    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length("text")).collect())
    prose = dict(registry.base.frame(spark, sf, "prose").select("doc_id", F.length("text")).collect())
    assert prose == docs and max(n or 0 for n in docs.values()) > 400


def test_bootstrap_of_groups_with_many_cells(spark, monkeypatch):
    """Any number of blocks: the same values, the same distribution, on any layout."""
    rng = np.random.default_rng(5)
    rows = [(g, float(x), float(x + rng.normal(0.1, 1))) for g, n in (("big", 800), ("small", 50)) for x in np.round(rng.normal(size=n), 6)]
    df = spark.createDataFrame(rows, "g string, a double, b double").unionByName(spark.createDataFrame([(None, 1.0, 2.0), ("big", None, 1.0)], "g string, a double, b double"))
    exact = {r["g"]: r for r in resample.paired_bootstrap_by(df, "a", "b", "g", 4000).collect()}
    monkeypatch.setattr(resample, "LEAF", 60)
    drawn, again = ({r["g"]: r for r in resample.paired_bootstrap_by(x, "a", "b", "g", 4000).collect()} for x in (df, df.repartition(7)))
    assert set(drawn) == set(exact) == {"big", "small", None}
    for name in ("small", None):
        assert drawn[name] == exact[name]
    e, d = exact["big"], drawn["big"]
    assert d["n"] == e["n"] == 800
    for m in ("base", "treatment", "delta"):
        assert abs(d[m] - e[m]) < 1e-9 and d[f"{m}_low"] < d[m] < d[f"{m}_high"]
        assert all(abs(d[f"{m}_{end}"] - e[f"{m}_{end}"]) < 0.06 * (e[f"{m}_high"] - e[f"{m}_low"]) for end in ("low", "high"))
    assert all(abs(d[c] - again["big"][c]) < 1e-9 for c in d.asDict() if c != "g")
    one = resample.bootstrap_ci(df.where("g = 'big'"), "b", 300).first()
    assert one["n"] == 801 and one["low"] < one["value"] < one["high"]


def test_bootstrap_totals_are_exact(spark, monkeypatch):
    """With every score 1 a replicate's mean is its number of draws over n: exactly 1 in every tree."""
    rows = [(float(k), 1.0) for k in range(500)]
    df = spark.createDataFrame(rows, "x double, one double")
    for leaf in (2048, 64, 3):
        monkeypatch.setattr(resample, "LEAF", leaf)
        cells = df.select(F.lit("g").alias("_by"), F.col("x").alias("_x0"), F.col("one").alias("_x1"), F.lit(7).cast("long").alias("_n"))
        reps = resample._drawn(cells, 2, 200, 1, {"x": [1.0, 0.0], "one": [0.0, 1.0]})
        got = reps.toPandas()
        assert len(got) == 200 and np.allclose(got["_one"], 1.0, atol=1e-12)
        # Mean and variance of a bootstrap mean of 3500 rows.
        assert abs(got["_x"].mean() - 249.5) < 1.0 and abs(got["_x"].std() / (np.arange(500).std() / math.sqrt(3500)) - 1) < 0.2


def test_compare_all_by_regime(spark):
    rows = [(m, t, str(k), "r\t1" if k % 3 else "r2", float((k * w) % 7 < 3)) for m, w in (("target", 3), ("a\tb", 5), (None, 2)) for t in ("lines", "class") for k in range(60)]
    scores = spark.createDataFrame(rows, "model string, task string, sample_id string, regime string, score double")
    out = {(r["model"], r["task"], r["regime"]): r for r in resample.compare_all(scores, "target", replicates=100, regime_tasks=["lines"]).collect()}
    assert set(out) == {("a\tb", "class", "all"), ("a\tb", "lines", "all"), ("a\tb", "lines", "r\t1"), ("a\tb", "lines", "r2")}
    for (m, t, regime), r in out.items():
        own = [(x[4], y[4]) for x in rows for y in rows if x[0] == m and y[0] == "target" and x[1] == y[1] == t and x[2] == y[2] and regime in ("all", x[3])]
        assert r["n"] == len(own) and r["delta"] == pytest.approx(sum(b - a for a, b in own) / len(own))


def test_budget_by_prefixes(spark):
    def kept(rows, kind, limit):
        df = spark.createDataFrame(rows, f"o {kind}, cost double")
        return sorted((r["o"], r["running"]) for r in infer.within_budget(df, "cost", limit, "o").collect())

    rng = np.random.default_rng(2)
    numbers = [(int(k), float(rng.integers(1, 9))) for k in rng.choice(10**13, 300, replace=False)] + [(5, 1.0), (40, 2.0)]
    texts = [(f"{'ab' * int(n)}{n}{k}", float(rng.integers(1, 9))) for k, n in enumerate(rng.integers(0, 20, 300))] + [("", 1.0), ("a", 1.0)]
    for rows, kind in ((numbers, "long"), (texts, "string")):
        total, want = 0.0, []
        for o, cost in sorted(rows):
            total += cost
            want += [(o, total)] if total <= 500 else []
        assert kept([*rows, (None, 1.0)], kind, 500.0) == want and 10 < len(want) < len(rows)
    assert kept([(None, 1.0)], "long", 5.0) == []


def test_stream_ledger_rewrites_touched_parts(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "object_id string, seq long, status string"
    fold = lambda rows: (spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{root}/in"), streams.stream_ledger(spark, f"{root}/in", schema, f"{root}/out", f"{root}/at", parts=8).awaitTermination())
    versions = lambda: {b.name: {p.name for p in b.glob("part=*")} for b in (tmp_path / "out").glob("batch=*")}
    fold([(str(k), 1, "a") for k in range(100)])
    assert len(versions()["batch=0"]) == 8
    fold([("3", 2, "b"), ("new", 1, "c")])
    touched = versions()["batch=1"]
    assert 1 <= len(touched) <= 2 and len(versions()["batch=0"]) == 8
    # A batch that runs again starts from the versions before it.
    (tmp_path / "at" / "commits" / "1").unlink()
    (tmp_path / "at" / "commits" / ".1.crc").unlink(missing_ok=True)
    fold([("3", 1, "old")])
    assert versions()["batch=1"] == touched and versions()["batch=0"].isdisjoint(touched) and len(versions()["batch=0"]) == 8 - len(touched)
    got = {r["object_id"]: (r["seq"], r["status"]) for r in streams.current_table(spark, f"{root}/out").collect()}
    assert got == {str(k): (1, "a") for k in range(100)} | {"3": (2, "b"), "new": (1, "c")}
    assert streams.current_table(spark, f"{root}/none") is None


def test_batches_by_budget(spark):
    """Each row in one batch, batches within the budget and numbered without gaps, little padding; one length is very frequent."""
    from skyframe.operators import arrays

    rng = random.Random(6)
    rows = [(k, 40 if k % 3 == 0 else rng.choice([0, 1, 2, 3, 17, 100, 999, 1000])) for k in range(3000)] + [(3000, None)]
    df = spark.createDataFrame(rows, "k int, n int")
    for salts in (1, 7):
        out = arrays.token_batches(df, F.col("n"), 1000, "k", salts=salts)
        got = out.collect()
        assert sorted(r["k"] for r in got) == list(range(3001))
        by = {}
        for r in got:
            by.setdefault(r["batch"], []).append(max(r["n"] or 1, 1))
        assert sorted(by) == list(range(len(by))) and all(len(v) * max(v) <= 1000 for v in by.values())
        assert sum(len(v) * max(v) for v in by.values()) <= 1.125 * sum(map(sum, by.values()))
        report = arrays.padding_report(out, F.col("n"), 1000).first()
        assert (report["n_rows"], report["n_batches"], report["n_over"]) == (3001, len(by), 0)
        assert report["n_used"] == sum(map(sum, by.values())) and report["padding_share"] == pytest.approx(1 - report["n_used"] / report["n_padded"], abs=1e-6)
        # As few batches as the widths allow.
        widths = {}
        for r in got:
            widths.setdefault(r["width"], []).append(r["k"])
        assert len(by) == sum(-(-len(v) // (1000 // w)) for w, v in widths.items())
    with pytest.raises(ValueError, match="over the budget"):
        arrays.token_batches(df, F.col("n"), 999, "k")
    assert arrays.token_batches(df.limit(0), F.col("n"), 10, "k").count() == 0
    assert arrays.padding_report(arrays.token_batches(df.limit(0), F.col("n"), 10, "k"), F.col("n"), 10).first()["padding_share"] == 0.0


def test_answers_of_many_runs(spark):
    """A document for each run, none lost where there are more of them than tasks."""
    from skyframe.queries import models

    customer = spark.range(0, 60_000, 1, 6).selectExpr("id AS c_custkey", "IF(id % 41 = 40, NULL, concat('segment ', CAST(id % 41 AS STRING))) AS c_mktsegment")
    got = models.a7(spark, customer)
    assert got.columns == ["model", "id", "answer"]
    assert got.count() == 60_000 and got.subtract(customer.selectExpr("'m' AS model", "c_custkey AS id", "c_mktsegment AS answer")).isEmpty()


def test_caption_report_reads_claims_once(spark, sf):
    """Sentences are cut once for captions and leaks, once for claims and once for their number."""
    from skyframe import registry

    plan = registry.queries()["d4_caption_report"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(") == 2 and "regexp_replace" not in plan


def test_captions_of_objects_without_or_with_several_sets(spark):
    claims = spark.createDataFrame([("a", 0, "x", ["image"]), ("a", 1, "y", ["image", "spectra"]), ("b", 0, "z", ["image"]), (None, 0, "n", ["image"])], "object_id string, claim_pos int, text string, supporting array<string>")
    sets = spark.createDataFrame([("a", ["image", "spectra"]), ("a", ["image", "lightcurve"]), ("c", ["image", "spectra"])], "object_id string, subset array<string>")
    got = sorted((str(r["object_id"]), "+".join(r["subset"]), r["text"], r["n_claims"]) for r in captions.compose_captions(claims, sets).collect())
    assert got == [("None", "image", "n", 1), ("a", "image", "x", 1), ("a", "image+lightcurve", "x", 1), ("a", "image+spectra", "x y", 2), ("b", "image", "z", 1)]
