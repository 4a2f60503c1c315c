import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import bands, coordinate, filters, resample, segment
from trackspark.trace import Trace

INF = float("inf")


def trace(spark, rows, columns="session_id string, unix_time double, x double, y double"):
    return Trace.from_dataframe(spark.createDataFrame(rows, columns), coord_system="local", order_by=None)


def test_a_right_angle_at_constant_speed(spark):
    points = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]
    t = trace(spark, [("a", float(i), float(x), float(y)) for i, (x, y) in enumerate(points)])
    out = t.derivate(window=1, derivatives=["velocity", "acceleration", "angular_velocity", "jerk", "lateral_g"])
    found = out.df.orderBy("unix_time").collect()
    assert [r["velocity"] for r in found] == [0, 1, 1, 1, 1]
    assert [r["heading"] for r in found] == [None, 0, 0, 90, 90]
    assert [r["angular_velocity"] for r in found] == [0, 0, 0, 90, 0]
    assert [r["acceleration"] for r in found] == [None, None, 0, 0, 0]
    assert found[3]["lateral_g"] == pytest.approx(math.pi / 2 / 9.80665)


def test_kinematics_take_one_shuffle(spark):
    t = trace(spark, [("a", 0.0, 0.0, 0.0)])
    out = t.derivate(window=1, derivatives=["jerk"]).df
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_gaps_of_the_limit_and_beyond(spark):
    t = trace(spark, [("a", 0.0, 0.0, 0.0), ("a", 3.0, 3.0, 6.0), ("a", 7.0, 7.0, 0.0)])
    found = t.interpolate("linear", hz=1, max_gap_frames=2).df.orderBy("unix_time").collect()
    assert [r["x"] for r in found] == [0, 1, 2, 3, None, None, None, 7]
    assert [r["is_interpolated"] for r in found] == [False, True, True, False, False, False, False, False]


def test_spline_follows_a_cubic(spark):
    k = np.array([0.0, 1, 2, 4, 7])
    at = np.arange(8.0)
    assert np.allclose(resample.cubic(k, k**3 - 2 * k, at), at**3 - 2 * at)


def test_sessions_do_not_meet(spark):
    one, two = [("a", float(i), float(i), 0.0) for i in range(5)], [("b", float(i), 9.0, float(i * i)) for i in range(5)]
    both = {tuple(r) for r in trace(spark, one + two).derivate(window=1).df.drop("_row").collect()}
    apart = {tuple(r) for part in (one, two) for r in trace(spark, part).derivate(window=1).df.drop("_row").collect()}
    assert repr(sorted(both, key=repr)) == repr(sorted(apart, key=repr))


def test_changepoints_are_the_best_partition():
    rng = np.random.default_rng(0)
    for v in (np.repeat([0.0, 5.0, 1.0], 8) + rng.normal(0, 0.3, 24), rng.normal(0, 1, 14)):
        n, penalty = len(v), 2 * math.log(len(v))

        def cost(cuts):
            ends = [0, *cuts, n]
            return sum(((v[a:b] - v[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:])) + penalty * len(cuts)

        best = min((cost(c) for k in range(3) for c in itertools.combinations(range(1, n), k)))
        assert cost(segment.changepoints(v)) <= best + 1e-9


def test_designation_of_steps(spark):
    v = [0.0] * 10 + [5.0] * 10 + [0.1] * 10
    t = trace(spark, [("a", float(i), 0.0, 0.0) for i in range(30)]).elaborate(
        velocity=F.when(F.col("unix_time") < 10, 0.0).when(F.col("unix_time") < 20, 5.0).otherwise(0.1)
    )
    labels = [r["designation"] for r in t.designate(v_threshold=1, min_pts=3).df.orderBy("unix_time").collect()]
    assert labels[0] == "relief_1" and labels[15] == "active_1" and labels[-1] == "relief_2" and len(labels) == len(v)


def test_smoothing():
    assert np.allclose(filters.savgol_weights(2, 5)[2], np.array([-3, 12, 17, 12, -3]) / 35)
    b, a = filters.butterworth_design(2, 0.2, "low")
    assert b.sum() / a.sum() == pytest.approx(1)
    assert abs(filters.zero_phase(b, a, np.full(200, 3.0))[100] - 3) < 1e-6
    freq, power = filters.spectrum(np.sin(2 * np.pi * 0.8 * np.arange(200) / 10), 10.0)
    assert freq[power.argmax()] == pytest.approx(0.8, abs=0.06)


def test_bands_at_their_edges(spark):
    values = [(-1.0,), (0.0,), (2.0,), (3.999,), (4.0,), (99.0,), (None,)]
    df = spark.createDataFrame(values, "velocity double")
    found = bands.allocate(df, {"velocity": (0, 2, 4, 6)}, "a").collect()
    assert [r["a_velocity_band"] for r in found] == [f"band_{k}" for k in (1, 1, 2, 2, 3, 3)] + [None]
    with pytest.raises(ValueError):
        row = {"profile_name": "p", "target_derivative": "velocity"}
        bands.profiles([row | {"profile_start": 0, "profile_end": 1}, row | {"profile_start": 2, "profile_end": INF}])


def test_utm_of_a_known_point(spark):
    df = spark.createDataFrame([(0.0, 3.0)], "lat double, lng double")
    assert tuple(coordinate.positions(df, 32631).select("x", "y").first()) == pytest.approx((500000.0, 0.0), abs=1e-3)
    with pytest.raises(ValueError):
        coordinate.positions(df, 4326)


def test_kept_traces_and_reports(spark, tmp_path):
    t = trace(spark, [("a", float(i), float(i), 0.0) for i in range(20)]).set_metadata(venue="north")
    t = t.interpolate("linear", hz=1).derivate(window=1).allocate()
    t.write(str(tmp_path / "t"))
    back = Trace.read(spark, str(tmp_path / "t"))
    assert back.metadata["venue"] == "north" and [s.step for s in back.log] == [s.step for s in t.log]
    assert back.df.count() == 20
    report = t.full_report()
    assert "interpolate" in report and "venue: north" in report
    with pytest.raises(ValueError):
        t.validate("lat")


def test_labels_and_their_export(spark):
    t = trace(spark, [("a", float(i), 0.0, 0.0) for i in range(6)])
    labels = spark.createDataFrame([("w", 0.0, 2.0, 0), ("d", 2.0, 3.0, 1), ("w", 5.0, 5.0, 2)], "label string, onset_s double, offset_s double, _row long")
    found = t.designate(labels=labels, cols="guess").export_designations().orderBy("unix_start").collect()
    assert [tuple(r)[1:] for r in found] == [("w", 0.0, 1.0), ("d", 2.0, 3.0), (None, 4.0, 4.0), ("w", 5.0, 5.0)]


def test_spline_of_a_long_session_takes_linear_memory():
    k = np.delete(np.arange(20_000.0), slice(9_000, 9_020))
    tracemalloc.start()
    try:
        found = resample.cubic(k, np.sin(k / 50), np.arange(20_000.0))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.allclose(found, np.sin(np.arange(20_000.0) / 50), atol=1e-3)
    assert most < 1000 * len(k)


def test_cutoffs_are_swept_over_the_range_of_the_method(spark):
    t = trace(spark, [("a", i / 10, math.sin(i / 3), 0.0) for i in range(150)])
    for method, low, high in (("butterworth", 0.1, 4.75), ("ema", 0.01, 0.5), ("sma", 0.01, 0.5), ("savgol", 0.01, 0.5)):
        curves = t.filtrate_cutoff("x", method)[0].orderBy("cutoff").collect()
        assert [r["cutoff"] for r in curves] == pytest.approx(list(np.linspace(low, high, 50)))
        assert all(r["residual"] is not None for r in curves)


@pytest.mark.parametrize("name", ["residual_sweep", "cutoff_elbow"])
def test_the_queries_sweep_as_the_verb_does(spark, name):
    from trackspark.plans import catalogue

    data = "/root/testdata/sf0.001"
    curves, _, suggested = catalogue.events(spark, data).filtrate_cutoff("x")
    found = catalogue.QUERIES[name](spark, data)
    if name == "residual_sweep":
        assert found.select("cutoff").distinct().count() == 50
    else:
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, suggested.collect()))


def test_every_session_keeps_its_own_rate_through_the_chain(spark):
    rows = [(s, 1e9 + i / hz, 2.0 * i / hz, 0.0, i) for s, hz in (("a", 10), ("b", 5), ("c", 4)) for i in range(12 * hz) if i % 7 != 3]
    frame = spark.createDataFrame(rows, "session_id string, unix_time double, x double, y double, n long")
    trace = Trace.from_dataframe(frame, coord_system="local", order_by="n").interpolate().derivate()
    late = trace.df.filter("unix_time >= 1e9 + 3").select("session_id", "velocity", "distance").collect()
    assert {r["session_id"] for r in late} == {"a", "b", "c"}
    # A window is a second, whatever the rate: 2 metres.
    assert all(r["velocity"] == pytest.approx(2, abs=1e-3) and r["distance"] == pytest.approx(2, abs=1e-3) for r in late)
    seconds = trace.df.groupBy("session_id").agg(trace.band_duration().alias("s")).collect()
    assert all(r["s"] == pytest.approx(12, abs=0.3) for r in seconds)
    smooth = trace.filtrate("butterworth", "x", cutoff=1).df.filter("f_x is not null")
    assert smooth.count() == trace.df.filter("x is not null").count()
    assert trace.designate(min_pts=0).log[-1].detail["min_pts"] == 0
    assert trace.designate().df.filter("designation is null").count() == 0


def test_the_grid_is_dealt_to_as_many_tasks_as_the_session_asks_for(spark):
    rows = [(f"s{s}", 100.0 * i, 1.0 * i, 0.0, i) for s in range(40) for i in range(5)]
    frame = spark.createDataFrame(rows, "session_id string, unix_time double, x double, y double, n long")
    grid = Trace.from_dataframe(frame, coord_system="local", order_by="n").interpolate(hz=1, max_gap_frames=200).df
    grid.collect()
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "REPARTITION_BY_NUM" in plan
    assert grid.select(F.spark_partition_id()).distinct().count() > 1


def test_grouped_expressions_mix_rows_and_aggregates(spark):
    rows = [("a", float(i), float(i), 0.0, i) for i in range(4)]
    frame = spark.createDataFrame(rows, "session_id string, unix_time double, x double, y double, n long")
    trace = Trace.from_dataframe(frame, coord_system="local", order_by="n")
    off = trace.elaborate(by=["y"], off="x - avg(x) over ()").df.orderBy("x")
    assert [r["off"] for r in off.collect()] == [-1.5, -0.5, 0.5, 1.5]


def test_names_go_by_their_order_and_labels_are_guessed(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "timestamp double, time double, x double, y double")
    assert Trace.from_dataframe(frame, coord_system="local").df.first()["unix_time"] == 2.0
    marks = spark.createDataFrame([("run", 0.0, 9.0)], "behaviour string, time_start double, time_end double")
    trace = Trace.from_dataframe(frame, coord_system="local").designate(labels=marks, cols="guess")
    assert trace.df.first()["designation"] == "run"


def test_splines_and_segments_against_dense_and_full_searches():
    import numpy as np

    from trackspark.operators.resample import cubic
    from trackspark.operators.segment import changepoints

    k = np.array([0.0, 1, 2, 4, 5, 7, 8, 11])
    at = np.arange(12.0)
    # A cubic's own points give the cubic back, whatever the ends' rule.
    assert np.allclose(cubic(k, k**3 - 4 * k**2 + k, at), at**3 - 4 * at**2 + at)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(m, 0.3, n) for m, n in ((0, 20), (3, 15), (1, 25))])

    def cost(a, b):
        return ((v[a:b] - v[a:b].mean()) ** 2).sum()

    best, came = [-2 * np.log(len(v))], [0]
    for t in range(1, len(v) + 1):
        total = [best[s] + cost(s, t) + 2 * np.log(len(v)) for s in range(t)]
        came.append(int(np.argmin(total)))
        best.append(min(total))
    want, t = [], came[len(v)]
    while t:
        want.append(t)
        t = came[t]
    assert changepoints(v) == want[::-1]
