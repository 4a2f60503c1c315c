"""Smoothing, and the choice of a cutoff.

Moving averages and Savitzky-Golay filters are window expressions. Recursive
filters and spectra run by session in Arrow: one session at a time is in a
worker's memory, and recursions take blocks of samples, not single ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from trackspark.functions.columns import RATE, ROW, TIME, clean, in_order
from trackspark.operators.sessions import by_session

METHODS = {"butterworth", "sma", "ema", "savgol"}
ALIASES = {"moving_average": "sma", "savitzky_golay": "savgol"}
#: Values that a series must have to be smoothed.
LEAST_VALUES = 4
DERIVED = ("velocity", "acceleration", "angular_velocity")


def targets(df: DataFrame, target: str | Sequence[str]) -> list[str]:
    names = [target] if isinstance(target, str) else list(target)
    found: list[str] = []
    for n in names:
        if n == "coordinates":
            found += [c for c in ("x", "y", "z") if c in df.columns]
        elif n in ("all_derivatives", "derivatives"):
            found += [c for c in DERIVED if c in df.columns]
        else:
            found.append(n)
    if missing := [n for n in found if n not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return list(dict.fromkeys(found))


def _valid(keys: Sequence[str], c: str):
    """The non-null values of a column as one unbroken series."""
    return Window.partitionBy(*keys, F.col(c).isNull()).orderBy(TIME, ROW)


def sma(c: str, keys: Sequence[str], n: int) -> Column:
    after = n // 2
    frame = _valid(keys, c).rowsBetween(-(n - 1 - after), after)
    return F.when(F.col(c).isNotNull() & (F.count(c).over(frame) == n), F.avg(c).over(frame))


def savgol_weights(order: int, n: int) -> np.ndarray:
    """Row i: the weights of a window's values for the polynomial's value at i."""
    a = np.vander(np.arange(n) - n // 2, order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(c: str, keys: Sequence[str], order: int, n: int) -> Column:
    if n % 2 == 0 or n <= order:
        raise ValueError("the window is odd and longer than the polynomial's order")
    weights, half, w = savgol_weights(order, n), n // 2, _valid(keys, c)
    back = Window.partitionBy(*keys, F.col(c).isNull()).orderBy(F.desc(TIME), F.desc(ROW))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back_whole = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def mix(row: np.ndarray, value: Callable[[int], Column]) -> Column:
        out = F.lit(0.0)
        for k, q in enumerate(row):
            out = out + F.lit(float(q)) * value(k)
        return out

    inner = mix(weights[half], lambda k: F.lag(c, half - k).over(w) if k <= half else F.lead(c, k - half).over(w))
    first, last = F.row_number().over(w) - 1, F.row_number().over(back) - 1
    out = F.when(F.col(c).isNull() | (F.count(c).over(whole) < n), F.lit(None).cast("double"))
    for i in range(half):
        out = out.when(first == i, mix(weights[i], lambda k: F.nth_value(c, k + 1).over(whole)))
        out = out.when(last == i, mix(weights[i], lambda k: F.nth_value(c, k + 1).over(back_whole)))
    return out.otherwise(inner)


#: Samples that a recursive filter takes in one matrix product.
BLOCK = 128


class Recursion:
    """A recursive filter as a linear map of its state, many samples at a time.

    After a block of samples x the state s is A^n s + G x, and what the filter
    gives is H x + O s: no sample waits for the one before it, only a block's
    state for that of the block before. States of blocks compose the same way,
    so a series may also be cut anywhere and its pieces joined by their states.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray):
        k = max(len(a), len(b)) - 1
        b, a = (np.pad(np.asarray(q, float) / a[0], (0, k + 1 - len(q))) for q in (b, a))
        self.step = np.eye(k, k=1)
        self.step[:, 0] -= a[1:]
        self.enter = b[1:] - a[1:] * b[0]
        self.powers = [np.eye(k)]  # of the step, by samples
        for _ in range(BLOCK):
            self.powers.append(self.powers[-1] @ self.step)
        self.out = np.array([p[0] for p in self.powers[:BLOCK]])  # row i: what comes out i samples after a state
        response = np.concatenate([[b[0]], self.out[: BLOCK - 1] @ self.enter])
        lags = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
        self.within = np.where(lags >= 0, response[np.maximum(lags, 0)], 0.0)
        # Row i: what sample i leaves in the block's last state.
        self.gather = np.array([p @ self.enter for p in self.powers[BLOCK - 1 :: -1]])

    def run(self, v: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The filtered series and the state after it; from rest, or from a state."""
        state = np.zeros(len(self.step)) if state is None else state
        many = len(v) // BLOCK
        blocks = v[: many * BLOCK].reshape(many, BLOCK)
        left, whole = blocks @ self.gather, self.powers[BLOCK]
        states = np.empty((many, len(state)))
        for i in range(many):
            states[i] = state
            state = whole @ state + left[i]
        rest = v[many * BLOCK :]
        n = len(rest)
        tail = self.within[:n, :n] @ rest + self.out[:n] @ state
        state = self.powers[n] @ state + rest @ self.gather[BLOCK - n :]
        if not many:
            return tail, state
        return np.concatenate([(blocks @ self.within.T + states @ self.out.T).ravel(), tail]), state


def ema(v: np.ndarray, alpha: float) -> np.ndarray:
    """An exponential average that begins with the first value."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha is above 0 and at most 1")
    return pd.Series(v).ewm(alpha=alpha, adjust=False).mean().to_numpy()


@lru_cache(maxsize=1024)
def butterworth_design(order: int, cutoff: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients by the bilinear transform; ``cutoff`` is a part of the Nyquist rate."""
    if not 0 < cutoff < 1:
        raise ValueError("the cutoff lies between 0 and half the frame rate")
    if kind not in ("low", "high"):
        raise ValueError("type is 'low' or 'high'")
    warped = math.tan(math.pi * cutoff / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    poles = warped * poles if kind == "low" else warped / poles
    z = (1 + poles) / (1 - poles)
    zeros = np.full(order, -1.0 if kind == "low" else 1.0)
    b, a = np.real(np.poly(zeros)), np.real(np.poly(z))
    at = 1.0 if kind == "low" else -1.0
    return b * np.polyval(a, at) / np.polyval(b, at), a


@lru_cache(maxsize=256)
def _recursion(b: tuple[float, ...], a: tuple[float, ...]) -> Recursion:
    return Recursion(b, a)


def zero_phase(b: np.ndarray, a: np.ndarray, v: np.ndarray, edge: str = "zero") -> np.ndarray:
    """Forward and backward, after padding the end with zeros (or by reflection of both ends)."""
    way = _recursion(tuple(b), tuple(a))

    def both(x: np.ndarray) -> np.ndarray:
        return way.run(way.run(x)[0][::-1])[0][::-1]

    if edge == "reflect":
        n = min(3 * max(len(a), len(b)), len(v) - 1)
        v = np.concatenate([2 * v[0] - v[n:0:-1], v, 2 * v[-1] - v[-2 : -n - 2 : -1]])
        return both(v)[n : len(v) - n]
    return both(np.concatenate([v, np.zeros(2 * max(len(a), len(b)))]))[: len(v)]


def by_valid(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], made: Callable[[float | None], Callable[[np.ndarray], np.ndarray]]
) -> DataFrame:
    """Apply a rule to each session's non-null values of a column, in order of time.

    ``columns`` are the new columns by their sources. ``made`` gives the rule for
    a session's own frame rate, or for none. Series of fewer than
    LEAST_VALUES values give nulls.
    """
    rated = RATE in df.columns

    def run(read: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own = float(read[RATE][0]) if rated else math.nan
        rule, out = made(None if math.isnan(own) else own), {}
        for source, name in columns.items():
            v = read[source].astype(float)
            ok = ~np.isnan(v)
            out[name] = np.full(len(v), np.nan)
            if ok.sum() >= LEAST_VALUES:
                out[name][ok] = rule(v[ok])
        return out

    needs = [*columns, *([RATE] if rated else [])]
    return by_session(df, keys, (TIME, ROW), needs, dict.fromkeys(columns.values(), DoubleType()), run)


def in_pieces(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], b: Sequence[float], a: Sequence[float], rows_per_task: int, both_ways: bool
) -> DataFrame:
    """A recursive filter over sessions that are cut into pieces, each in a task of its own.

    A piece's effect on the filter's state is linear: A^m s + z, of its m values.
    The first pass finds z of each piece, forwards from rest, and backwards what
    the forward result from rest (z0) and from a state (K) leave. These few
    numbers a piece are chained by session, which gives every piece its states
    at both ends; the second pass filters with them. A task holds a piece's
    rows; results are those of the whole session but for rounding. Forwards
    only, a series begins in the state of its first value (an average's start).
    """
    way = _recursion(tuple(map(float, b)), tuple(map(float, a)))
    k, sources = len(way.step), list(columns)
    cut = df.withColumn("__piece", F.floor((F.row_number().over(in_order(keys)) - 1) / rows_per_task))
    by = [*keys, "__piece"]

    def values(part: pd.DataFrame, c: str) -> np.ndarray:
        v = part[c].to_numpy(float)
        return v[~np.isnan(v)]

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part, rows = part.sort_values([TIME, ROW]), []
        for c in sources:
            v = values(part, c)
            y, z = way.run(v)
            z0, turn = np.zeros(k), np.zeros((k, k))
            if both_ways:
                z0 = way.run(y[::-1])[1]
                turn = np.array([way.run(way.run(np.zeros(len(v)), e)[0][::-1])[1] for e in np.eye(k)]).T
            rows.append((c, len(v), v[0] if len(v) else math.nan, [*z, *z0, *turn.ravel()]))
        out = pd.DataFrame(rows, columns=["__column", "__m", "__first", "__map"])
        for key in by:
            out[key] = part[key].iloc[0]
        return out[[*by, "__column", "__m", "__first", "__map"]]

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        out = part.drop_duplicates("__piece").sort_values("__piece")[by].reset_index(drop=True)
        for c in sources:
            own = part[part["__column"] == c].sort_values("__piece")
            counts, maps = own["__m"].to_numpy(), np.stack(own["__map"].to_numpy())
            powers = [np.linalg.matrix_power(way.step, int(m)) for m in counts]
            started = own["__first"].dropna()
            state = np.zeros(k)
            if not both_ways and len(started):  # an average before its first value is that value
                state = way.step[:, 0] * started.iloc[0]
            starts, ends = [], [np.zeros(k)] * len(counts)
            for p, power in enumerate(powers):
                starts.append(state)
                state = power @ state + maps[p, :k]
            if both_ways:
                # The zeros beyond the end, there and back.
                u = way.run(way.run(np.zeros(2 * max(len(a), len(b))), state)[0][::-1])[1]
                for p in range(len(counts) - 1, -1, -1):
                    ends[p] = u
                    u = powers[p] @ u + maps[p, k : 2 * k] + maps[p, 2 * k :].reshape(k, k) @ starts[p]
            out[f"__n_{c}"] = float(counts.sum())
            for j in range(k):
                out[f"__s{j}_{c}"], out[f"__u{j}_{c}"] = [s[j] for s in starts], [e[j] for e in ends]
        return out

    kinds = {f.name: f for f in cut.schema}
    fields = StructType([kinds[c] for c in by])
    parts = cut.select(*by, TIME, ROW, *sources).groupBy(*by).applyInPandas(
        summary, StructType([*fields]).add("__column", "string").add("__m", "long").add("__first", "double").add("__map", ArrayType(DoubleType()))
    )
    known = [f"__{x}_{c}" for c in sources for x in ("n", *[f"{w}{j}" for j in range(k) for w in "su"])]
    schema = StructType([*fields])
    for name in known:
        schema = schema.add(name, "double")
    states = parts.groupBy(*keys).applyInPandas(chained, schema)

    def run(read: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for c, name in columns.items():
            v = read[c].astype(float)
            ok = ~np.isnan(v)
            out[name] = np.full(len(v), np.nan)
            if read[f"__n_{c}"][0] >= LEAST_VALUES:
                s, u = (np.array([read[f"__{w}{j}_{c}"][0] for j in range(k)]) for w in "su")
                y = way.run(v[ok], s)[0]
                out[name][ok] = way.run(y[::-1], u)[0][::-1] if both_ways else y
        return out

    met = cut.join(states, by)
    made = dict.fromkeys(columns.values(), DoubleType())
    return by_session(met, by, (TIME, ROW), [*sources, *known], made, run).drop("__piece", *known)


def filtrate(
    df: DataFrame,
    keys: Sequence[str],
    method: str = "butterworth",
    target: str | Sequence[str] = "coordinates",
    n: int = 2,
    cutoff: float = 1,
    kind: str = "low",
    window: int = 5,
    alpha: float = 0.3,
    poly_order: int = 2,
    clamp: str | Sequence[str] | None = "velocity",
    rate: float = 10,
    edge: str = "zero",
    rows_per_task: int | None = None,
) -> DataFrame:
    """``f_<column>`` of each target; a second pass goes over the first one's result.

    With ``rows_per_task`` sessions that outgrow a task are cut into pieces of
    so many rows for the recursive filters (of one rate, without reflection).
    """
    method = ALIASES.get(method, method)
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(sorted(METHODS))}")
    columns = targets(df, target)
    source = {c: f"f_{c}" if f"f_{c}" in df.columns else c for c in columns}
    if method == "sma":
        out = df.withColumns({f"f_{c}": sma(source[c], keys, window) for c in columns})
    elif method == "savgol":
        out = df.withColumns({f"f_{c}": savgol(source[c], keys, poly_order, window) for c in columns})
    elif rows_per_task is not None:
        if method == "butterworth" and (RATE in df.columns or edge != "zero"):
            raise ValueError("pieces of sessions need one rate, and zeros beyond the end")
        b, a = butterworth_design(n, cutoff / (rate / 2), kind) if method == "butterworth" else ([alpha], [1.0, alpha - 1])
        out = in_pieces(df, keys, {source[c]: f"f_{c}" for c in columns}, b, a, rows_per_task, method == "butterworth")
    else:
        def made(own: float | None) -> Callable[[np.ndarray], np.ndarray]:
            if method == "ema":
                return partial(ema, alpha=alpha)
            return partial(zero_phase, *butterworth_design(n, cutoff / ((own or rate) / 2), kind), edge=edge)

        if RATE not in df.columns:
            made(None)  # a wrong cutoff fails here
        out = by_valid(df, keys, {source[c]: f"f_{c}" for c in columns}, made)
    clamped = [clamp] if isinstance(clamp, str) else list(clamp or [])
    return out.withColumns(
        {f"f_{c}": F.when(F.col(f"f_{c}") < 0, 0.0).otherwise(F.col(f"f_{c}")) for c in clamped if c in columns}
    )


def _signals(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rate: float) -> DataFrame:
    """keys, time, row, signal, value and ``__rate``: each session's own rate, or else ``rate``.

    Dealt by session and signal to as many tasks as the session asks for, as a
    sweep takes long for few bytes.
    """
    own = F.coalesce(RATE, F.lit(float(rate))) if RATE in df.columns else F.lit(float(rate))
    slim = df.select(*keys, TIME, ROW, own.alias("__rate"), *columns)
    long = slim.unpivot([*keys, TIME, ROW, "__rate"], list(columns), "signal", "value").filter("value is not null")
    return _dealt(long, keys)


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "signal")


def residual_sweep(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    cutoffs: Sequence[float] | Callable[[float], Sequence[float]],
    rate: float,
    method: str = "butterworth",
    n: int = 2,
    poly_order: int = 2,
) -> DataFrame:
    """session, signal, cutoff, residual: the RMS of what each cutoff takes away.

    ``cutoffs`` may be a function of a session's rate, which is its own where it
    has one. A session's signal is shuffled once and meets all cutoffs in its task.
    """
    cuts = cutoffs if callable(cutoffs) else lambda _: [float(c) for c in cutoffs]

    def residual(v: np.ndarray, cutoff: float, own: float) -> float:
        try:
            smooth = _smoothed(v, cutoff, own, method, n, poly_order)
        except ValueError:  # a cutoff beyond the rate has no filter
            return math.nan
        ok = ~np.isnan(smooth)
        return float(np.sqrt(np.mean((v[ok] - smooth[ok]) ** 2))) if ok.any() else math.nan

    def sweep(part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values([TIME, ROW])["value"].to_numpy(float)
        own = float(part["__rate"].iloc[0])
        out = pd.DataFrame({"cutoff": cuts(own), "residual": [residual(v, c, own) for c in cuts(own)]})
        for k in [*keys, "signal"]:
            out[k] = part[k].iloc[0]
        return out[[*keys, "signal", "cutoff", "residual"]]

    fields = [f for f in df.schema if f.name in keys]
    schema = StructType(fields).add("signal", "string").add("cutoff", "double").add("residual", "double")
    long = _signals(df, keys, columns, rate)
    return long.groupBy(*keys, "signal").applyInPandas(sweep, schema).withColumn("residual", clean(F.col("residual")))


def _smoothed(v: np.ndarray, cutoff: float, rate: float, method: str, n: int, order: int) -> np.ndarray:
    if method == "butterworth":
        return zero_phase(*butterworth_design(n, cutoff / (rate / 2), "low"), v)
    if method == "ema":
        return ema(v, min(1.0, cutoff))
    width = max(3 if method == "sma" else 5, round(1 / cutoff))
    if method == "sma":
        out = np.full(len(v), np.nan)
        if len(v) >= width:
            means = np.convolve(v, np.ones(width) / width, "valid")
            out[width - 1 - width // 2 :][: len(means)] = means
        return out
    width += 1 - width % 2
    if len(v) < width:
        raise ValueError("shorter than the window")
    weights, half = savgol_weights(order, width), width // 2
    out = np.concatenate([np.zeros(half), np.convolve(v, weights[half][::-1], "valid"), np.zeros(half)])
    out[:half], out[-half:] = weights[:half] @ v[:width], weights[-half:] @ v[-width:]
    return out


def spectrum(v: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Periodogram after a linear detrend, a 10 % cosine taper and padding to a fast length."""
    n = len(v)
    t = np.arange(n) - (n - 1) / 2
    v = v - v.mean() - t * (t @ v) / (t @ t)
    m = int(n * 0.1)
    taper = np.ones(n)
    edge = 0.5 * (1 - np.cos(np.pi * np.arange(1, 2 * m, 2) / (2 * m))) if m else np.zeros(0)
    taper[:m], taper[n - m :] = edge, edge[::-1]
    long = n
    while _rest(long) > 1:
        long += 1
    power = np.abs(np.fft.fft(v * taper, long)) ** 2 / (n * rate) / np.mean(taper**2)
    k = np.arange(1, long // 2 + 1)
    return k * rate / long, power[k]


def _rest(n: int) -> int:
    for p in (2, 3, 5):
        while n % p == 0:
            n //= p
    return n


def psd(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rate: float) -> DataFrame:
    """session, signal, freq, power."""
    long = _signals(df, keys, columns, rate)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values([TIME, ROW])["value"].to_numpy(float)
        freq, power = spectrum(v, float(part["__rate"].iloc[0])) if len(v) >= 4 else (np.zeros(0), np.zeros(0))
        out = pd.DataFrame({"freq": freq, "power": power})
        for k in [*keys, "signal"]:
            out[k] = part[k].iloc[0]
        return out[[*keys, "signal", "freq", "power"]]

    fields = [f for f in df.schema if f.name in keys]
    schema = StructType(fields).add("signal", "string").add("freq", "double").add("power", "double")
    return long.groupBy(*keys, "signal").applyInPandas(run, schema)


def knots(x: np.ndarray) -> np.ndarray:
    """Knots of a smoothing spline: all points, or a part of them that grows slower from 50 on."""
    n = len(x)
    size = {50: 50.0, 200: 100.0, 800: 140.0, 3200: 200.0}  # fixed values: knots at so many points
    if n < 50:
        return x
    if n >= 3200:
        many = 200 + (n - 3200) ** 0.2
    else:
        low = max(k for k in size if k <= n)
        high = min(k for k in size if k > n)
        many = 2 ** (math.log2(size[low]) + math.log2(size[high] / size[low]) * (n - low) / (high - low))
    return x[np.floor(np.linspace(0, n - 1, int(many + 1e-9)) + 1e-9).astype(int)]


def b_splines(knot: np.ndarray, x: np.ndarray, derivative: int = 0) -> np.ndarray:
    """Cubic B-splines over the knots (the outer ones fourfold) at x: a column for each."""
    t = np.concatenate([[knot[0]] * 3, knot, [knot[-1]] * 3])
    at = np.clip(np.searchsorted(knot, x, "right") - 1, 0, len(knot) - 2) + 3
    out = (np.arange(len(t) - 1) == at[:, None]).astype(float)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)

    for degree in range(1, 4):
        m = len(t) - 1 - degree
        left, right = t[degree : degree + m] - t[:m], t[degree + 1 : degree + 1 + m] - t[1 : 1 + m]
        if degree > 3 - derivative:
            out = degree * (ratio(out[:, :m], left) - ratio(out[:, 1 : m + 1], right))
        else:
            here = x[:, None]
            out = ratio((here - t[:m]) * out[:, :m], left) + ratio((t[degree + 1 : degree + 1 + m] - here) * out[:, 1 : m + 1], right)
    return out


@lru_cache(maxsize=64)
def bending(x: tuple[float, ...], spar: float) -> np.ndarray:
    """The matrix that takes values at x to the second derivatives there of their smoothing spline.

    The spline has the least sum of squared deviations plus a penalty times the
    integral of its squared second derivative. The penalty is
    256^(3 spar - 1) times the ratio of the traces of both parts, without the
    outer B-splines, over x scaled to 0 ... 1.
    """
    u = np.array(x)
    u = (u - u[0]) / (u[-1] - u[0])
    knot = knots(u)
    design = b_splines(knot, u)
    width = np.diff(knot)
    # Second derivatives are linear between knots: two points of Gauss are exact for their products.
    roughness = 0.0
    for g in (-1, 1):
        bend = b_splines(knot, knot[:-1] + width * (1 + g / math.sqrt(3)) / 2, 2)
        roughness = roughness + (bend * width[:, None] / 2).T @ bend
    fit, inner = design.T @ design, slice(2, design.shape[1] - 3)
    penalty = np.trace(fit[inner, inner]) / np.trace(roughness[inner, inner]) * 256 ** (3 * spar - 1)
    return b_splines(knot, u, 2) @ np.linalg.solve(fit + penalty * roughness, design.T)


def elbow(x: np.ndarray, y: np.ndarray, spar: float = 0.6) -> float:
    """Where the smoothing spline of a curve bends most; of fewer than four points the lowest."""
    order = np.argsort(x, kind="stable")
    x, first = np.unique(x[order], return_index=True)
    y = y[order][first]
    return float(x[y.argmin()] if len(x) < 4 else x[np.abs(bending(tuple(x), spar) @ y).argmax()])


def elbows(residuals: DataFrame, keys: Sequence[str], spar: float = 0.6) -> DataFrame:
    """session, signal, cutoff: where a residual curve bends most, by its smoothing spline.

    A curve has a point for each cutoff, so a group is small; curves over the
    same cutoffs share one factorised system in a worker.
    """

    def find(part: pd.DataFrame) -> pd.DataFrame:
        at = elbow(part["cutoff"].to_numpy(float), part["residual"].to_numpy(float), spar)
        return part[[*keys, "signal"]].head(1).assign(cutoff=at)

    fields = [f for f in residuals.schema if f.name in (*keys, "signal")]
    schema = StructType([f for k in (*keys, "signal") for f in fields if f.name == k]).add("cutoff", "double")
    there = residuals.filter("residual is not null").select(*keys, "signal", "cutoff", "residual")
    return _dealt(there, keys).groupBy(*keys, "signal").applyInPandas(find, schema)
