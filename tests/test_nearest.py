"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import joins, nearest


def all_pairs(a, b):
    """For each position of a: separations from all of b, in arcseconds."""
    (ra1, d1), (ra2, d2) = (np.radians(np.array([x[1:] for x in t], float)).T for t in (a, b))
    h = np.sin((d2[None] - d1[:, None]) / 2) ** 2 + np.cos(d1)[:, None] * np.cos(d2)[None] * np.sin((ra2[None] - ra1[:, None]) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(h, 1)))) * 3600


def check(spark, a, b, radius=None):
    fa, fb = (spark.createDataFrame(t, "object_id string, ra double, dec double") for t in (a, b))
    got = {r["object_id"]: r for r in nearest.nearest(fa, fb, "object_id", "object_id", radius_arcsec=radius).collect()}
    seps = all_pairs(a, b)
    names = np.array([x[0] for x in b])
    for k, (name, *_) in enumerate(a):
        least = seps[k].min()
        if radius is not None and least > radius:
            assert name not in got
            continue
        assert got[name]["sep_arcsec"] == pytest.approx(least, rel=1e-9, abs=1e-6)
        # Those as near as the nearest, but for rounding.
        near = set(names[seps[k] <= least * (1 + 1e-9) + 1e-6])
        assert got[name]["object_id_right"] in near and (len(near) > 1 or near == {got[name]["object_id_right"]})
    assert len(got) <= len(a)


def spread(rng, n, name):
    return [(f"{name}{i:04d}", float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Few rows a cell, so that cells divide many times."""
    monkeypatch.setattr(nearest, "MAX_MET", 30)
    monkeypatch.setattr(nearest, "MAX_OWN", 60)


EDGES = [("pole", 10.0, 90.0), ("pole2", 200.0, 90.0), ("south", 0.0, -90.0), ("zero", 0.0, 0.0), ("wrap", 359.9999, 0.0), ("over", 361.0, 5.0), ("minus", -1.0, 5.0), ("far", 180.0, -45.0)]


def test_whole_sky(spark, small):
    rng = np.random.default_rng(1)
    check(spark, spread(rng, 400, "a") + EDGES, spread(rng, 300, "b") + [("n" + n, r + 1e-4, d) for n, r, d in EDGES])


def test_far_away(spark, small):
    """All of b in a small field: distances up to 180 degrees."""
    rng = np.random.default_rng(2)
    b = [(f"b{i:04d}", float(40 + rng.normal() * 1e-2), float(20 + rng.normal() * 1e-2)) for i in range(200)]
    check(spark, spread(rng, 200, "a") + EDGES + [("anti", 220.0, -20.0)], b)
    check(spark, [("anti", 220.0, -20.0), ("same", 40.0, 20.0)], [("b", 40.0, 20.0)])


def test_dense_field(spark, small):
    """Nine rows in ten lie in one cell of the first level, and divide."""
    rng = np.random.default_rng(3)
    field = lambda n, name: [(f"{name}f{i:04d}", float(150 + rng.normal() * 2e-2), float(2 + rng.normal() * 2e-2)) for i in range(n)]
    a, b = field(900, "a") + spread(rng, 100, "a"), field(900, "b") + spread(rng, 100, "b")
    check(spark, a, b)
    check(spark, a, b, radius=15.0)
    fa, fb = (nearest._positions(spark.createDataFrame(t, "object_id string, ra double, dec double"), "object_id", "ra", "dec") for t in (a, b))
    compared = largest = 0
    for _, pairs in nearest.leaves(fa, fb, None):
        for r in pairs.select("acell", "an", "met").distinct().collect():
            compared, largest = compared + r["an"] * r["met"], max(largest, r["an"] * r["met"])
    assert compared < 0.06 * len(a) * len(b) and largest < 0.06 * compared, (compared, largest)


def test_one_position_and_ties(spark, small):
    a = [(f"a{i}", 10.0, 10.0) for i in range(300)] + [("x", 10.0, 10.5)]
    b = [(f"b{i:03d}", 10.0, 11.0) for i in range(300)] + [("c", 10.0, 9.0), ("a0", 50.0, 50.0)]
    fa, fb = (spark.createDataFrame(t, "object_id string, ra double, dec double") for t in (a, b))
    got = {r["object_id"]: r["object_id_right"] for r in nearest.nearest(fa, fb, "object_id", "object_id").collect()}
    assert len(got) == 301 and set(got.values()) <= {"b000", "c"} and got["x"] == "b000"


def test_nothing_to_find(spark):
    kinds = "object_id string, ra double, dec double, vote double, mask boolean"
    a = spark.createDataFrame([("a", 1.0, 2.0), ("null", None, None), ("nan", float("nan"), 0.0)], "object_id string, ra double, dec double")
    b = spark.createDataFrame([("b", 1.0, 2.0 + 1 / 3600, 0.5, False), ("n", None, 1.0, 0.7, False)], kinds)
    out = {r["object_id"]: r for r in joins.attach_nearest(a, b, 2.0, ["vote"], ["mask"]).collect()}
    assert out["a"]["crossmatched"] and out["a"]["vote"] == 0.5 and out["a"]["mask"] is False
    assert out["null"]["sep_arcsec"] is None and not out["nan"]["crossmatched"] and out["nan"]["mask"] is True
    far = {r["object_id"]: r for r in joins.attach_nearest(a, b.withColumn("dec", F.lit(-80.0)), 2.0, ["vote"], ["mask"]).collect()}
    assert far["a"]["sep_arcsec"] == pytest.approx(82 * 3600) and far["a"]["vote"] is None and far["a"]["mask"] is True
    assert nearest.nearest(a, b.limit(0), "object_id", "object_id").count() == 0
    assert nearest.nearest(a.limit(0), b, "object_id", "object_id").count() == 0
