"""Column helpers that the verbs share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

TIME, ROW = "unix_time", "_row"
#: Frames per second of a row's session, where an interpolation has found them.
RATE = "_hz"


def in_order(keys: Sequence[str], *first: str) -> WindowSpec:
    """A session's rows by time; rows of one time in their order of arrival."""
    return Window.partitionBy(*keys).orderBy(*(first or (TIME,)), ROW)


def backwards(keys: Sequence[str], *first: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (first or (TIME,))], F.desc(ROW))


def session(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clean(c: Column) -> Column:
    """NaN as null: Spark takes NaN for the largest number, equal to itself."""
    return F.when(~F.isnan(c), c)


def pmin(*columns: Column | str) -> Column:
    """The smallest of the columns, null if any is (least() skips nulls)."""
    return F.when(_all_there(columns), F.least(*columns))


def pmax(*columns: Column | str) -> Column:
    """The largest of the columns, null if any is (greatest() skips nulls)."""
    return F.when(_all_there(columns), F.greatest(*columns))


def _all_there(columns: Sequence[Column | str]) -> Column:
    every = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in every])


def rolling(c: Column, window: WindowSpec, before: int, after: int, whole: bool = True) -> Column:
    """The mean over a frame of rows; with ``whole``, null where the frame is cut."""
    frame = window.rowsBetween(-before, after)
    mean = F.avg(c).over(frame)
    return F.when(F.count(c).over(frame) == before + after + 1, mean) if whole else mean


def island(change: Column, window: WindowSpec) -> Column:
    """A number for each run of rows; ``change`` marks the rows that begin one."""
    return F.sum(change.cast("long")).over(window.rowsBetween(Window.unboundedPreceding, 0))


def filled_forward(c: Column, window: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def numeric_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, NumericType)]


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two names, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def match_names(
    columns: Sequence[str], wanted: dict[str, Sequence[str]], least: float = 0.8
) -> dict[str, str]:
    """For each wanted name the column that fits: one of its synonyms (whatever
    the case), in their order, or else the most similar one. No column twice."""
    found: dict[str, str] = {}
    for name, synonyms in wanted.items():
        free = {c.lower(): c for c in reversed(columns) if c not in found.values()}
        exact = next((free[s.lower()] for s in synonyms if s.lower() in free), None)
        if exact is None:
            scored = [(jaro(s.lower(), c), -i, c) for i, s in enumerate(synonyms) for c in free]
            best = max(scored, default=(0.0, 0, ""))
            exact = free[best[2]] if best[0] >= least else None
        if exact is not None:
            found[name] = exact
    return found
