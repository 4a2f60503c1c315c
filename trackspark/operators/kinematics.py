"""Backward differences over a number of rows, all in one partitioning by session."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackspark.functions.columns import RATE, TIME, finite, in_order, session

OPTIONAL = ("velocity", "acceleration", "angular_velocity", "jerk", "lateral_g")
DEFAULT = ("velocity", "acceleration", "angular_velocity")
GRAVITY = 9.80665  # fixed value: standard gravity


def windows(given: int | Mapping[str, int] | None, rate: float) -> dict[str, int]:
    """Rows that each difference spans: one number, or one by derivative."""
    base = max(1, int(rate))
    names = ("velocity", "angular_velocity", "acceleration", "jerk")
    if given is None:
        return dict.fromkeys(names, base)
    found = {n: given.get(n, base) for n in names} if isinstance(given, Mapping) else dict.fromkeys(names, given)
    if any(int(w) != w or w < 1 for w in found.values()):
        raise ValueError("a window is a whole number of rows, at least 1")
    return {n: int(w) for n, w in found.items()}


#: What one span of rows is in the order that _key gives: any number from the largest span on.
UNIT = 1 << 20


@dataclass(frozen=True)
class Span:
    """A number of rows back: the same for all sessions, or each session's own.

    A session's own number w is a column, so ``lag`` can't take it. Rows are
    numbered n = 0, 1, 2 ..., and UNIT * n / w, rounded down, orders them as n
    does; w rows are exactly UNIT of it. A frame of that range begins with the
    row to be found, for all sessions in one window.
    """

    keys: tuple[str, ...]
    rows: int | None = None

    def before(self, c: str) -> Column:
        if self.rows is not None:
            return F.lag(c, self.rows).over(in_order(self.keys))
        return F.when(F.col("__n") >= F.col("__w"), F.first(c).over(self.frame()))

    def frame(self) -> WindowSpec:
        if self.rows is not None:
            return in_order(self.keys).rowsBetween(-self.rows, 0)
        return Window.partitionBy(*self.keys).orderBy("__key").rangeBetween(-UNIT, 0)

    def difference(self, c: str) -> Column:
        return F.col(c) - self.before(c)

    def elapsed(self) -> Column:
        dt = self.difference(TIME)
        return F.when(dt > 0, dt)

    def gapless(self, *columns: str) -> Column:
        """Whether none of the columns is null in the rows that the difference spans."""
        missing = F.lit(False)
        for c in columns:
            missing = missing | F.col(c).isNull()
        return ~F.max(missing).over(self.frame())


def with_spans(df: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """``__w``, rows of each session's own span (its whole rate), with what Span orders by."""
    width = F.greatest(F.floor(F.coalesce(RATE, F.lit(float(rate)))), F.lit(1)).cast("long")
    number = (F.row_number().over(in_order(keys)) - 1).cast("long")
    out = df.withColumns({"__w": width, "__n": number})
    return out.withColumn("__key", F.expr(f"__n * {UNIT} div __w"))


def derivate(
    df: DataFrame,
    keys: Sequence[str],
    use_filtered: bool = True,
    window: int | Mapping[str, int] | None = None,
    speed_floor: float = 0.5,
    signed_omega: bool = False,
    derivatives: Sequence[str] | None = None,
    rate: float = 5,
    own_rates: bool = False,
    marks: bool = False,
) -> DataFrame:
    """distance, heading and the asked-for derivatives; others of them are dropped.

    With ``own_rates`` a span that is not given is each session's own rate.
    Filtered coordinates are used in sessions that have any. With ``marks`` the
    columns __gap_velocity and __gap_acceleration tell what a gap has voided.
    """
    wanted = tuple(derivatives or DEFAULT)
    if unknown := set(wanted) - set(OPTIONAL):
        raise ValueError(f"unknown derivatives: {', '.join(sorted(unknown))}")
    rows = windows(window, rate)
    own = own_rates and not isinstance(window, int)
    given = window if isinstance(window, Mapping) else {}
    v, o, a, j = (
        Span(tuple(keys), None if own and n not in given else rows[n])
        for n in ("velocity", "angular_velocity", "acceleration", "jerk")
    )
    smooth = use_filtered and {"f_x", "f_y"} <= set(df.columns)
    x, y = ("__sx", "__sy") if smooth else ("x", "y")
    if smooth:
        there = F.max(F.col("f_x").isNotNull()).over(session(keys)) & F.max(F.col("f_y").isNotNull()).over(session(keys))
        df = df.withColumn("__smooth", there)
        df = df.withColumns({x: F.when(F.col("__smooth"), F.col("f_x")).otherwise(F.col("x")), y: F.when(F.col("__smooth"), F.col("f_y")).otherwise(F.col("y"))})

    dx, dy = v.difference(x), v.difference(y)
    out = with_spans(df, keys, rate) if own else df
    if marks:
        out = out.withColumn("__gap_velocity", ~v.gapless(x, y))
    out = out.withColumn("distance", F.when(v.gapless(x, y), F.sqrt(dx * dx + dy * dy)))
    out = out.withColumn("velocity", F.col("distance") / v.elapsed())
    heading = F.atan2(dy, dx) * F.lit(180.0 / math.pi)
    out = out.withColumn("heading", F.when(F.col("velocity") >= speed_floor, heading))

    turn = o.difference("heading") + 180.0
    omega = (turn - 360.0 * F.floor(turn / 360.0) - 180.0) / o.elapsed()
    out = out.withColumn("angular_velocity", omega if signed_omega else F.abs(omega))
    out = out.withColumn(
        "acceleration",
        F.when(a.gapless("velocity"), a.difference("velocity") / a.elapsed()),
    )
    if marks:
        out = out.withColumn("__gap_acceleration", ~a.gapless("velocity"))
    if "jerk" in wanted:
        out = out.withColumn(
            "jerk",
            F.when(j.gapless("acceleration"), j.difference("acceleration") / j.elapsed()),
        )
    zero = F.lit(0.0)
    omega = F.col("angular_velocity")
    out = out.withColumns(
        {
            "distance": F.coalesce("distance", zero),
            "velocity": F.coalesce("velocity", zero),
            "angular_velocity": F.when(finite(omega), omega).otherwise(zero),
        }
    )
    if "lateral_g" in wanted:
        force = F.col("velocity") * F.col("angular_velocity") * (math.pi / 180.0) / GRAVITY
        out = out.withColumn("lateral_g", F.when(F.col("velocity") >= speed_floor, force).otherwise(zero))
    return out.drop("__w", "__n", "__key", "__sx", "__sy", "__smooth", *[c for c in OPTIONAL if c not in wanted])
