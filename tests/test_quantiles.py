"""Exact quantiles against numpy, with rounds forced by small limits."""

import math

import numpy as np
import pytest

from skyframe.operators import lightcurves, quantiles


@pytest.mark.parametrize("few", [5, 40, 100_000])
def test_against_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "CUTS", 8)
    rng = np.random.default_rng(4)
    groups = {
        "ties": rng.integers(0, 4, 999).astype(float),
        "wide": np.concatenate([-np.exp(rng.normal(size=400) * 50), np.exp(rng.normal(size=401) * 50), [0.0, -0.0]]),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "inf": np.array([-math.inf, -1.0, 2.0, 2.0, math.inf, math.inf, math.inf]),
        "tab\tname": rng.normal(size=500).round(2),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("ties", None), ("none", None)]
    qs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["quantile"]): r["value"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "g", "x", qs).collect()}
    assert len(got) == len(groups) * len(qs)
    for g, v in groups.items():
        v = np.sort(v)
        for q in qs:
            at = q * (len(v) - 1)
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert got[g, q] == pytest.approx(low if low == high else low + (high - low) * (at - math.floor(at)), rel=1e-12, nan_ok=True)


def test_nan_ranks_last(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 2)
    rows = [("a", float(k)) for k in range(8)] + [("a", math.nan)] * 3 + [("b", math.nan)]
    got = {(r["g"], r["quantile"]): r["value"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", [0.5, 0.9]).collect()}
    assert got["a", 0.5] == 5.0 and math.isnan(got["a", 0.9]) and math.isnan(got["b", 0.5])


def test_claim_errors(spark):
    df = spark.createDataFrame([(-1.0, None), (2.0, 3.0), (4.0, -5.0), (None, None)], "x double, y double")
    out = {r["metric"]: r for r in lightcurves.claim_error_summary(df, ["x", "y"]).collect()}
    assert (out["x"]["n"], out["x"]["mean"], out["x"]["median"], out["x"]["p90"]) == (3, 2.333333, 2.0, 3.6)
    assert (out["y"]["n"], out["y"]["mean"], out["y"]["median"], out["y"]["p90"]) == (2, 4.0, 4.0, 4.8)
