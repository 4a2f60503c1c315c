"""Recursions by blocks, changepoints and Arrow pass-through against plain loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from trackspark.operators import filters, segment
from trackspark.operators.sessions import by_session


def plain(b, a, v, state):
    held, out = list(state), []
    for x in v:
        y = b[0] * x + held[0]
        held = [(held[j + 1] if j + 1 < len(held) else 0.0) + b[j + 1] * x - a[j + 1] * y for j in range(len(held))]
        out.append(y)
    return np.array(out), np.array(held)


@pytest.mark.parametrize("n", [0, 1, 5, filters.BLOCK - 1, filters.BLOCK, filters.BLOCK + 1, 3 * filters.BLOCK + 17])
@pytest.mark.parametrize("order, cutoff, kind", [(1, 0.3, "low"), (2, 0.02, "low"), (4, 0.6, "high")])
def test_blocks_are_the_recursion(n, order, cutoff, kind):
    rng = np.random.default_rng(n)
    b, a = filters.butterworth_design(order, cutoff, kind)
    v, state = rng.normal(0, 3, n), rng.normal(0, 1, order)
    found, last = filters.Recursion(b, a).run(v, state)
    want, end = plain(b, a, v, state)
    assert np.allclose(found, want, atol=1e-9) and np.allclose(last, end, atol=1e-9)
    # Cut anywhere, pieces joined by their states are the whole.
    for cut in {0, n // 3, n}:
        first, middle = filters.Recursion(b, a).run(v[:cut], state)
        second, end = filters.Recursion(b, a).run(v[cut:], middle)
        assert np.allclose(np.concatenate([first, second]), want, atol=1e-9) and np.allclose(end, last, atol=1e-9)


def test_average_of_a_series():
    v = np.random.default_rng(3).normal(0, 1, 500)
    at, want = v[0], [v[0]]
    for x in v[1:]:
        at = 0.3 * x + (1 - 0.3) * at
        want.append(at)
    assert (filters.ema(v, 0.3) == want).all()
    with pytest.raises(ValueError):
        filters.ema(v, 0)


def cost(v, ends):
    at = [0, *ends, len(v)]
    return sum(((v[i:j] - v[i:j].mean()) ** 2).sum() for i, j in zip(at, at[1:])) + 2 * np.log(len(v)) * len(ends)


def test_both_searches_find_the_least_cost():
    rng = np.random.default_rng(5)
    for k in range(60):
        n = int(rng.integers(2, 60))
        v = np.repeat(rng.normal(0, 3, n // 9 + 1), 9)[:n] + rng.normal(0, rng.choice([0, 0.5, 2]), n)
        v = np.round(v) if k % 4 == 0 else v
        best, came = np.zeros(n + 1), [0] * (n + 1)
        best[0] = -2 * np.log(n)
        for t in range(1, n + 1):  # every start at every step
            totals = [best[i] + ((v[i:t] - v[i:t].mean()) ** 2).sum() + 2 * np.log(n) for i in range(t)]
            best[t] = min(totals)
        want = best[n]
        centred, penalty = v - v.mean(), 2 * np.log(n)
        for came in (segment.starts_by_cost(centred, penalty), segment.starts_by_level(centred, penalty)):
            ends, t = [], int(came[n])
            while t > 0:
                ends.append(t)
                t = int(came[t])
            assert cost(v, ends[::-1]) == pytest.approx(want, abs=1e-6)
        assert cost(v, segment.changepoints(v)) == pytest.approx(want, abs=1e-6)


def test_a_level_session_is_searched_by_level(monkeypatch):
    v = np.random.default_rng(1).normal(0, 1, 12_000)
    monkeypatch.setattr(segment, "OPEN_STARTS", 500)
    assert segment.starts_by_cost(v, 20.0) is None  # nearly every row stays a possible start
    began = time.process_time()
    assert segment.changepoints(v) == []
    assert time.process_time() - began < 30


def test_other_columns_pass_as_they_are(spark):
    rows = [("b", 2.0, 1, None, "x", [1, 2]), ("a", 5.0, 2, 4.0, None, None), ("a", 1.0, 3, None, "é", []), ("a", 1.0, 1, 7.0, "z", [3]), ("a", None, 4, 9.0, "n", None)]
    frame = spark.createDataFrame(rows, "k string, t double, r long, v double, s string, l array<long>")

    def rule(read):
        return {"v": np.arange(len(read["v"]), dtype=float), "w": np.where(np.isnan(read["v"]), np.nan, 2 * read["v"])}

    out = by_session(frame, ["k"], ["t", "r"], ["v"], {"v": DoubleType(), "w": DoubleType()}, rule)
    assert out.columns == ["k", "t", "r", "s", "l", "v", "w"]
    found = {(r["k"], r["r"]): tuple(r)[3:] for r in out.collect()}
    assert found == {
        ("b", 1): ("x", [1, 2], 0.0, None),
        ("a", 1): ("z", [3], 0.0, 14.0),
        ("a", 3): ("é", [], 1.0, None),
        ("a", 2): (None, None, 2.0, 8.0),
        ("a", 4): ("n", None, 3.0, 18.0),
    }
    assert by_session(frame.limit(0), ["k"], ["t", "r"], ["v"], {"w": DoubleType()}, rule).count() == 0


@pytest.mark.parametrize("method", ["butterworth", "ema"])
@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_pieces_of_sessions_are_the_whole(spark, method, rows):
    rng = np.random.default_rng(rows)
    data = [(s, float(i), i, float(v) if i % 9 else None, float(v) if i > 300 else None, "n") for s, n in (("a", 400), ("b", 5), ("c", 3)) for i, v in enumerate(rng.normal(0, 9, n).cumsum())]
    frame = spark.createDataFrame(data, "session_id string, unix_time double, _row long, x double, y double, note string")
    whole = filters.filtrate(frame, ("session_id",), method, ("x", "y"))
    cut = filters.filtrate(frame, ("session_id",), method, ("x", "y"), rows_per_task=rows)
    assert cut.columns == whole.columns
    a, b = ({(r["session_id"], r["_row"]): (r["f_x"], r["f_y"], r["note"]) for r in f.collect()} for f in (whole, cut))
    assert a.keys() == b.keys() and len(a) == len(data)
    for k in a:
        for u, v in zip(a[k][:2], b[k][:2]):
            assert (u is None) == (v is None) and (u is None or abs(u - v) < 1e-9 * (1 + abs(u))), (k, u, v)


def test_a_session_without_velocity_has_no_label(spark):
    from trackspark.trace import Trace

    rows = [("a", float(i), 0.0, 0.0, 1.0 + i % 2) for i in range(30)] + [("b", float(i), 0.0, 0.0, None) for i in range(5)]
    frame = spark.createDataFrame(rows, "session_id string, unix_time double, x double, y double, velocity double")
    t = Trace.from_dataframe(frame, coord_system="local").designate(min_pts=10)
    assert {(r["session_id"], r["designation"]) for r in t.df.collect()} == {("a", "active_1"), ("b", None)}
    found = {r["session_id"]: r["issues"] for r in t.quality("designate").collect()}
    assert found["a"] == [] and len(found["b"]) == 3
    summary = t.quantitate(allocation=None, ordered=True, n=F.count("*")).collect()
    assert [r["session_id"] for r in summary] == ["a", "b"]


def test_changepoints_in_pieces_are_those_of_the_full_search(spark):
    rng = np.random.default_rng(11)
    series = {}
    for k in range(8):
        n = int(rng.integers(900, 2600))
        lengths = rng.integers(40, 400, 40)
        series[f"s{k}"] = np.repeat(rng.normal(0, 4, 40), lengths)[:n] + rng.normal(0, rng.choice([0.2, 1.0]), n)
    slow = np.concatenate([np.zeros(1500), np.full(1500, 0.25)]) + rng.normal(0, 1, 3000)
    series |= {"slow": slow, "short": rng.normal(0, 1, 30), "one": np.array([1.0])}
    rows = [(s, float(i), i, None if i % 50 == 7 and len(v) > 1 else float(x)) for s, v in series.items() for i, x in enumerate(v)]
    rows.append(("none", 0.0, 0, None))
    frame = spark.createDataFrame(rows, "session_id string, unix_time double, _row long, velocity double")
    whole = segment.with_blocks(frame, ("session_id",))
    cut = segment.with_blocks_in_pieces(frame, ("session_id",), rows_per_task=500)
    assert set(cut.columns) == set(whole.columns)
    a, b = ({(r["session_id"], r["_row"]): r["__block"] for r in f.collect()} for f in (whole, cut))
    assert a.keys() == b.keys() and len(a) == len(rows)
    for s in (*series, "none"):
        own = [k for k in a if k[0] == s]
        assert [a[k] for k in sorted(own)] == [b[k] for k in sorted(own)], s
    assert max(v for k, v in a.items() if k[0] == "slow" and v) >= 2
