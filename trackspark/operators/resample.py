"""A regular frame rate, and short gaps filled."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from trackspark.functions.columns import RATE, ROW, TIME
from trackspark.operators.sessions import by_session

METHODS = ("linear", "constant", "spline")
FRAME = "__k"


def native_rate(keys: Sequence[str]) -> Column:
    """A session's frames per second: one over its median positive time step."""
    step = F.col("__step")
    median = F.percentile(F.when(step > 0, step), F.lit(0.5)).over(Window.partitionBy(*keys))
    return F.round(1 / median, 2)


def with_rate(df: DataFrame, keys: Sequence[str], hz: float | None) -> DataFrame:
    if hz is not None:
        return df.withColumn("__hz", F.lit(float(hz)))
    arrival = Window.partitionBy(*keys).orderBy(ROW)
    return (
        df.withColumn("__step", F.col(TIME) - F.lag(TIME).over(arrival))
        .withColumn("__hz", F.coalesce(native_rate(keys), F.lit(1.0)))
        .drop("__step")
    )


def snapped(df: DataFrame, keys: Sequence[str], hz: float | None) -> DataFrame:
    """Rows on a grid of frames, the first to arrive of each frame; no null times.

    The shuffle by session has as many partitions as the session asks for: the
    grid can have many times the rows, so few partitions for few rows would
    leave it to few tasks. All that follows keeps to this partitioning.
    """
    by_frame = Window.partitionBy(*keys).orderBy(FRAME, ROW)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.filter(F.col(TIME).isNotNull()).repartition(parts, *keys)
    return (
        with_rate(dealt, keys, hz)
        .withColumn(FRAME, F.rint(F.col(TIME) * F.col("__hz")).cast("long"))
        .withColumn("__before", F.lag(FRAME).over(by_frame))
        .filter(F.col("__before").isNull() | (F.col("__before") != F.col(FRAME)))
        .drop("__before")
    )


def on_grid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every frame from a session's first to its last; ``__new`` marks added ones.

    A row stands for the frames up to the next row, so there is no join, and
    all of it shares the partitioning by session.
    """
    by_frame = Window.partitionBy(*keys).orderBy(FRAME)
    kept = {*keys, FRAME, "__new", "__hz"}
    out = (
        df.withColumn("__next", F.coalesce(F.lead(FRAME).over(by_frame) - 1, F.col(FRAME)))
        .withColumn("__at", F.explode(F.sequence(FRAME, "__next")))
        .withColumn("__new", F.col("__at") != F.col(FRAME))
    )
    values = {c: F.when(~F.col("__new"), F.col(c)) for c in df.columns if c not in kept}
    return (
        out.withColumns(values)
        .withColumn(FRAME, F.col("__at"))
        .withColumn(TIME, F.col(FRAME) / F.col("__hz"))
        .drop("__at", "__next")
    )


def _neighbours(c: str, keys: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    """The nearest valid value and its frame, at or before and at or after a row.

    The later one is the earlier one of the reversed order: a frame that
    reaches to the session's end would be summed up anew for each row.
    """
    up = Window.partitionBy(*keys).orderBy(FRAME).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(FRAME)).rowsBetween(Window.unboundedPreceding, 0)
    pair = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(FRAME).alias("k")))
    before, after = (F.last(pair, ignorenulls=True).over(w) for w in (up, down))
    return before["v"], before["k"], after["v"], after["k"]


def linear(c: str, keys: Sequence[str], most: int) -> Column:
    v0, k0, v1, k1 = _neighbours(c, keys)
    between = v0 + (v1 - v0) * (F.col(FRAME) - k0) / F.nullif(k1 - k0, F.lit(0))
    return F.when(F.col(c).isNotNull(), F.col(c)).when(k1 - k0 - 1 <= most, between)


def constant(c: str, keys: Sequence[str], most: int | None) -> Column:
    v0, k0, _, k1 = _neighbours(c, keys)
    end = F.max(FRAME).over(Window.partitionBy(*keys)) + 1
    run = F.coalesce(k1, end) - k0 - 1
    return v0 if most is None else F.when(F.col(c).isNotNull(), F.col(c)).when(run <= most, v0)


def cubic(k: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic through all points whose ends follow the cubics of the outer four."""
    n, h, d = len(k), np.diff(k), np.diff(v) / np.diff(k)
    low, mid, up, b = h.copy(), np.zeros(n), h.copy(), np.zeros(n)
    mid[1:-1], b[1:-1] = 2 * (h[:-1] + h[1:]), np.diff(d)
    third = lambda i: ((d[i + 2] - d[i + 1]) / (k[i + 3] - k[i + 1]) - (d[i + 1] - d[i]) / (k[i + 2] - k[i])) / (k[i + 3] - k[i])
    mid[0], b[0] = -h[0], h[0] ** 2 * third(0)
    mid[-1], b[-1] = -h[-1], -(h[-1] ** 2) * third(n - 4)
    s = _tridiagonal(low, mid, up, b)
    i = np.clip(np.searchsorted(k, at, "right") - 1, 0, n - 2)
    x = at - k[i]
    slope = d[i] - h[i] * (s[i + 1] + 2 * s[i])
    return v[i] + x * (slope + x * (3 * s[i] + x * (s[i + 1] - s[i]) / h[i]))


def _tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of the system of three diagonals; memory is linear in its size."""
    mid, b = mid.copy(), b.copy()
    for i in range(1, len(b)):
        w = low[i - 1] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        b[i] -= w * b[i - 1]
    out = np.empty(len(b))
    out[-1] = b[-1] / mid[-1]
    for i in range(len(b) - 2, -1, -1):
        out[i] = (b[i] - up[i] * out[i + 1]) / mid[i]
    return out


def splined(df: DataFrame, keys: Sequence[str], columns: Sequence[str], most: int) -> DataFrame:
    """Cubic splines through each session's valid points (4 at least).

    Gaps of up to ``most`` frames are filled, at the ends as well. One session
    at a time is in a worker's memory.
    """

    def fill(read: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        k, out = (read[FRAME] - read[FRAME][0]).astype(float), {}
        for c in columns:
            v = read[c].astype(float)
            ok = ~np.isnan(v)
            if ok.sum() >= 4 and not ok.all():
                run = np.cumsum(np.concatenate([[True], ok[1:] != ok[:-1]]))
                short = np.bincount(run)[run] <= most
                v = np.where(~ok & short, cubic(k[ok], v[ok], k), v)
            out[c] = v
        return out

    return by_session(df, keys, (FRAME,), [*columns, FRAME], dict.fromkeys(columns, DoubleType()), fill)


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    hz: float | None = None,
    method: str = "linear",
    max_gap_frames: int = 5,
    passthrough: str = "none",
) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if passthrough not in ("none", "constant"):
        raise ValueError("fill_passthrough is 'none' or 'constant'")
    own = {*keys, TIME, ROW, RATE, "is_interpolated"}
    axes = [c for c in ("x", "y", "z") if c in df.columns]
    if "x" not in axes or "y" not in axes:
        raise ValueError("interpolate needs x and y; use coordinate first")
    numbers = [
        f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in own
    ]
    others = [c for c in df.columns if c not in own and c not in numbers]
    grid = on_grid(snapped(df.drop("is_interpolated", RATE), keys, hz), keys)
    whole = Window.partitionBy(*keys)
    # A z that a session has nowhere is no axis of it.
    has_z = F.coalesce(F.max(F.col("z").isNotNull()).over(whole), F.lit(False)) if "z" in axes else F.lit(False)

    def there(c: str) -> Column:
        return F.col(c).isNotNull() | (~F.col("__has_z") if c == "z" else F.lit(False))

    def every() -> Column:
        out = F.lit(True)
        for c in axes:
            out = out & there(c)
        return out

    grid = grid.withColumn("__has_z", has_z).withColumn("__was", every())
    if method == "spline":
        filled = splined(grid, keys, numbers, max_gap_frames)
    else:
        rule = linear if method == "linear" else constant
        filled = grid.withColumns({c: rule(c, keys, max_gap_frames) for c in numbers})
    if passthrough == "constant" and others:
        filled = filled.withColumns({c: constant(c, keys, None) for c in others})
    out = (
        filled.withColumn("is_interpolated", ~F.col("__was") & every())
        .withColumn(ROW, F.coalesce(ROW, F.lit(0).cast("long")))
        .drop("__new", "__was", "__has_z", FRAME)
    )
    return out.withColumnRenamed("__hz", RATE) if hz is None else out.drop("__hz")


def gap_runs(df: DataFrame, keys: Sequence[str], hz: float | None, max_gap_frames: int) -> DataFrame:
    """Per session, the runs of frames without x on the grid, before any filling."""
    grid = on_grid(snapped(df, keys, hz), keys)
    by_frame = Window.partitionBy(*keys).orderBy(FRAME)
    missing = F.col("x").isNull()
    marked = grid.withColumn("__missing", missing).withColumn(
        "__change", F.coalesce(F.col("__missing") != F.lag("__missing").over(by_frame), F.lit(True))
    )
    runs = (
        marked.withColumn(
            "__run",
            F.sum(F.col("__change").cast("long")).over(by_frame.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .groupBy(*keys, "__run")
        .agg(F.first("__missing").alias("missing"), F.count("*").alias("n"))
        .filter("missing")
    )
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_gaps"),
        F.sum("n").alias("total_frames"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
        F.avg("n").alias("mean_frames"),
        F.percentile("n", F.lit(0.5)).alias("median_frames"),
        F.count_if(F.col("n") > max_gap_frames).alias("n_exceeding"),
    )
