"""Projections against published points, rates by session, smoothing splines and labels against brute force."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import coordinate, filters, kinematics, projections, segment
from trackspark.operators.projections import Ellipsoid, System, system
from trackspark.trace import Trace

KEYS = ("session_id",)


def local(spark, rows, **options):
    return Trace.from_dataframe(spark.createDataFrame(rows, "session_id string, unix_time double, x double, y double"), coord_system="local", **options)


# Projections ----------------------------------------------------------------------

FOOT = 12 / 39.37
TEXAS = System("lcc", Ellipsoid(6378206.4, 294.9786982), 27 + 50 / 60, -99.0, 2e6 * FOOT, 0.0, parallels=(28 + 23 / 60, 30 + 17 / 60))


@pytest.mark.parametrize(
    "what, lat, lng, east, north, within",
    [
        (system(3035), 50.0, 5.0, 3962799.45, 2999718.85, 0.01),
        (replace(system(27700), shift=None), 50.5, 0.5, 577274.99, 69740.50, 0.02),
        (TEXAS, 28.5, -96.0, 2963503.91 * FOOT, 254759.80 * FOOT, 0.01),
        (system(2154), 46.5, 3.0, 700000.0, 6600000.0, 1e-6),
        (system(2193), 0.0, 173.0, 1600000.0, 10000000.0, 1e-6),
        (system(32631), 0.0, 3.0, 500000.0, 0.0, 1e-6),
    ],
)
def test_published_points(spark, what, lat, lng, east, north, within):
    one = spark.createDataFrame([(lat, lng)], "lat double, lng double")
    x, y = projections.project(one, what).select(projections.EAST, projections.NORTH).first()
    assert abs(x - east) < within and abs(y - north) < within


def test_a_shift_and_its_reverse(spark):
    """The seven parameters applied to the local position give back the position on WGS 84."""
    s = system(27700)
    frame = spark.createDataFrame([(math.radians(a), math.radians(b)) for a, b in ((50.1, -5.5), (54.0, 0.2), (60.8, -0.9))], "__phi double, __lam double")
    for r in projections.shifted(frame.withColumns({"a": F.col("__phi"), "b": F.col("__lam")}), s.shift, s.ellipsoid).collect():

        def geocentric(phi, lam, ellipsoid, h=0.0):
            n = ellipsoid.a / math.sqrt(1 - ellipsoid.e2 * math.sin(phi) ** 2)
            return np.array([(n + h) * math.cos(phi) * math.cos(lam), (n + h) * math.cos(phi) * math.sin(lam), (n * (1 - ellipsoid.e2) + h) * math.sin(phi)])

        want = geocentric(r["a"], r["b"], projections.WGS84)
        k, sec = s.shift, math.pi / 648000
        turn = np.array([[1, -k.rz * sec, k.ry * sec], [k.rz * sec, 1, -k.rx * sec], [-k.ry * sec, k.rx * sec, 1]])

        def back(h):
            return (1 + k.ppm * 1e-6) * turn @ geocentric(r["__phi"], r["__lam"], s.ellipsoid, h) + [k.dx, k.dy, k.dz]

        up = want / np.linalg.norm(want)
        height = (want - back(0.0)) @ up  # a local ellipsoid lies above or below the other
        assert np.linalg.norm(want - back(height)) < 0.002


def test_every_system_is_true_to_scale_near_its_middle(spark):
    for crs, s in projections.SYSTEMS.items():
        lat, lng = (sum(s.parallels) / 2 if s.kind == "lcc" else s.lat0 or 30.0), s.lng0
        rows = [(lat, lng), (lat + 0.001, lng), (lat, lng + 0.001)]
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lat double, lng double")
        (a, b, c) = coordinate.positions(frame, crs).orderBy("i").select("x", "y").collect()
        if s.kind != "mercator":
            assert math.dist(a, b) == pytest.approx(111.1, rel=0.04), crs
        assert b["y"] > a["y"] and c["x"] > a["x"], crs


def test_unknown_systems_raise(spark):
    for crs in (4326, 2163, 32661, 1):
        with pytest.raises(ValueError):
            coordinate.positions(spark.createDataFrame([(1.0, 1.0)], "lat double, lng double"), crs)


def test_only_stretched_sessions_are_warned_of(spark):
    rows = [("equator", 3.0, 10.0), ("north", 50.0, 10.0), ("south", -40.0, 170.0), ("nowhere", None, None)]
    t = Trace.from_dataframe(spark.createDataFrame([(s, 0.0, a, b) for s, a, b in rows], "session_id string, unix_time double, lat double, lng double"))
    found = {r["session_id"]: r for r in t.coordinate().quality("crs").collect()}
    assert [found[s]["warning"] is not None for s, *_ in rows] == [False, True, True, False]
    assert "EPSG:32632" in found["north"]["warning"] and "EPSG:32759" in found["south"]["warning"]


# Rates ---------------------------------------------------------------------------------


def wandering(session, rate, n=40):
    rng = random.Random(session)
    return [(session, i / rate, rng.random() * 9, rng.random() * 9 if i % 11 else None) for i in range(n)]


RATES = {"a": 2, "b": 5, "c": 10, "d": 20, "e": 33}


@pytest.mark.parametrize("window", [None, {"acceleration": 3}])
def test_own_spans_are_those_of_each_session_alone(spark, window):
    everything = ["velocity", "acceleration", "angular_velocity", "jerk", "lateral_g"]
    both = local(spark, [r for s, hz in RATES.items() for r in wandering(s, hz)])
    both = both.transform(lambda d: d.withColumn("_hz", F.element_at(F.create_map(*[F.lit(v) for p in RATES.items() for v in p]), F.col("session_id")).cast("double")))
    out = both.derivate(window=window, speed_floor=0.1, derivatives=everything)
    columns = ["unix_time", "distance", "heading", *everything]
    for s, hz in RATES.items():
        alone = local(spark, wandering(s, hz)).set_metadata(hz=hz).derivate(window=window, speed_floor=0.1, derivatives=everything)
        want = alone.df.select(*columns).orderBy("unix_time").collect()
        assert out.df.filter(F.col("session_id") == s).select(*columns).orderBy("unix_time").collect() == want
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_stack_keeps_the_rates(spark):
    slow, fast = local(spark, wandering("a", 2)).interpolate(), local(spark, wandering("b", 5)).interpolate(hz=5)
    plain = local(spark, wandering("c", 10))
    both = slow.stack(fast, plain)
    assert {(r["session_id"], r["_hz"]) for r in both.df.select("session_id", "_hz").distinct().collect()} == {("a", 2.0), ("b", 5.0), ("c", None)}
    moved = both.derivate(use_filtered=False)
    for t, s in ((fast, "b"), (slow, "a"), (plain, "c")):
        alone = t.derivate(use_filtered=False).df.select("unix_time", "distance").orderBy("unix_time").collect()
        assert moved.df.filter(F.col("session_id") == s).select("unix_time", "distance").orderBy("unix_time").collect() == alone
    seconds = moved.quantitate(allocation=None, scope="session", s=moved.band_duration())
    assert {r["session_id"]: round(r["s"], 6) for r in seconds.collect()} == {"a": 20.0, "b": 8.0, "c": 4.0}
    same = fast.stack(local(spark, wandering("z", 5)).interpolate(hz=5))
    assert not same.own_rates() and same.rate(10) == 5


def test_cutoffs_of_a_fast_session(spark):
    t = local(spark, wandering("d", 50, 60)).transform(lambda d: d.withColumn("y", F.lit(0.0))).interpolate()
    curves, power, found = t.filtrate_cutoff("x", steps=8)
    assert max(r["cutoff"] for r in curves.collect()) == pytest.approx(23.75)
    assert max(r["freq"] for r in power.collect()) == pytest.approx(25.0)
    assert found.count() == 1


# Smoothing spline -------------------------------------------------------------------------


def brute_bending(x, y, penalty):
    """Second derivatives of the best natural spline, from dense matrices of the classic form."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    return np.concatenate([[0], np.linalg.solve(r + penalty * q.T @ q, q.T @ y), [0]])


@pytest.mark.parametrize("n", [4, 5, 9, 30, 49])
def test_bending_is_that_of_the_penalised_natural_spline(n):
    rng = np.random.default_rng(n)
    x, y = np.sort(rng.random(n)) * 7, rng.random(n)
    u = (x - x[0]) / (x[-1] - x[0])
    fit, knot = filters.b_splines(u, u), u
    assert np.allclose(fit.sum(1), 1)
    inner = slice(2, n + 2 - 3)
    rough = 0.0
    fine = np.concatenate([knot[:-1, None] + np.diff(knot)[:, None] * (np.arange(200) + 0.5) / 200])
    for i, w in enumerate(np.diff(knot)):
        bend = filters.b_splines(knot, fine[i], 2)
        rough = rough + bend.T @ bend * w / 200
    penalty = np.trace((fit.T @ fit)[inner, inner]) / np.trace(rough[inner, inner]) * 256**0.8
    got, want = filters.bending(tuple(x), 0.6) @ y, brute_bending(u, y, penalty)
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()


def test_elbow_of_few_points_and_of_many():
    assert filters.elbow(np.array([3.0, 1.0, 2.0]), np.array([0.5, 2.0, 0.1])) == 2.0
    x = np.linspace(0, 1, 300)
    assert len(filters.knots(x)) < 140
    assert filters.elbow(x, np.maximum(0.4 - x, 0)) == pytest.approx(0.4, abs=0.03)


# Labels ---------------------------------------------------------------------------------


@pytest.mark.parametrize("by_session, bound", [(True, 10_000), (False, 10_000), (True, 0), (False, 0)])
def test_labels_are_the_last_that_covers(spark, monkeypatch, by_session, bound):
    monkeypatch.setattr(segment, "BROADCAST_LABELS", bound)
    rng = random.Random(8)
    times = [float(rng.choice([rng.randrange(200), rng.random() * 200])) for _ in range(300)] + [None, float("nan"), -5.0, 1e12]
    rows = [(rng.choice("ab"), t, float(i), 0.0) for i, t in enumerate(times)]
    ranges = []
    for i in range(60):
        a = rng.choice([rng.randrange(200), rng.random() * 200])
        b = a + rng.choice([0, 0, rng.randrange(9), rng.random() * 80, -1])
        ranges.append((rng.choice("ab"), None if i % 17 == 5 else f"l{i % 13}", float(a), float(b), i))
    ranges += [("a", "open", float("-inf"), 20.0, 60), ("b", "none", None, 50.0, 61), ("b", "nan", float("nan"), 50.0, 62), ("a", "same", 30.0, 30.0, 63)]
    labels = spark.createDataFrame(ranges, "session_id string, designation string, unix_start double, unix_end double, _row long")
    labels = labels.repartition(3) if by_session else labels.drop("session_id").repartition(3)
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "session_id string, unix_time double, x double, y double, _row long")
    found = {r["_row"]: r["designation"] for r in segment.label(frame, KEYS, labels, bin_seconds=25).collect()}
    assert len(found) == len(rows)
    for i, (s, t, *_ ) in enumerate(rows):
        want = None
        for who, name, a, b, _ in ranges:
            if t is not None and a is not None and a <= t <= b and (not by_session or who == s):
                want = name
        assert found[i] == want, (i, s, t)


def test_labels_leave_rows_where_they_are(spark):
    frame = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0)], "session_id string, unix_time double, x double, y double, _row long")
    labels = spark.createDataFrame([("l", 0.0, 5.0)], "designation string, unix_start double, unix_end double")
    plan = segment.label(frame, KEYS, labels)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_no_labels_at_all(spark):
    frame = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0)], "session_id string, unix_time double, x double, y double, _row long")
    labels = spark.createDataFrame([], "designation string, unix_start double, unix_end double")
    assert [r["designation"] for r in segment.label(frame, KEYS, labels).collect()] == [None]
