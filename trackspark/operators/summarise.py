"""Grouped summaries, and new columns by expression."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPES = ("designation", "session", "active")


def band_duration(rate: float | Column = 10) -> Column:
    """Seconds that the rows of a group stand for, at one rate or that of each row."""
    return F.sum(1 / rate) if isinstance(rate, Column) else F.count("*") / F.lit(float(rate))


def quantitate(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    allocation: str | None = "allocation_1",
    derivative: str | Sequence[str] = "velocity",
    scope: str = "designation",
    active_only: bool = False,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """One row per session and the scope's groups: a partial aggregate before the shuffle."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {', '.join(SCOPES)}")
    names = [derivative] if isinstance(derivative, str) else list(derivative)
    bands = [f"{allocation}_{d}_band" for d in names] if allocation else []
    if missing := [b for b in bands if b not in df.columns]:
        raise ValueError(f"no such bands: {', '.join(missing)}; use allocate first")
    if scope != "session" and "designation" not in df.columns:
        raise ValueError(f"scope {scope!r} needs designations")
    if scope == "active" or (scope == "designation" and active_only):
        df = df.filter(F.col("designation").rlike("^active_"))
    by = [*extra_keys, *keys, *(["designation"] if scope == "designation" else []), *bands]
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])


def quantitate_rollup(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    allocation: str | None = "allocation_1",
    derivative: str | Sequence[str] = "velocity",
) -> DataFrame:
    """Summaries of segments, sessions and all sessions, with and without bands, in one pass.

    ``scope`` tells what a row sums up (designation, session or all), and
    ``all_bands`` whether it does so over the bands: a null among the other
    columns then stands for all, else for rows that have none. A task's rows are
    summed for every grouping set before the one shuffle.
    """
    names = [derivative] if isinstance(derivative, str) else list(derivative)
    bands = [f"{allocation}_{d}_band" for d in names] if allocation else []
    if missing := [c for c in (*bands, "designation") if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    levels = ([*keys, "designation"], [*keys], [])
    sets = [[*level, *extra] for level in levels for extra in ([bands, []] if bands else [[]])]
    sets = [[F.col(c) for c in s] for s in sets]
    scope = F.when(F.grouping("designation") == 0, "designation").when(F.grouping(keys[0]) == 0, "session").otherwise("all")
    whole = F.grouping(bands[0]) == 1 if bands else F.lit(True)
    by = [F.col(c) for c in (*keys, "designation", *bands)]
    return df.groupingSets(sets, *by).agg(
        scope.alias("scope"), whole.alias("all_bands"), *[c.alias(n) for n, c in measures.items()]
    )


def elaborate(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column | str], by: Sequence[str] = ()
) -> DataFrame:
    """New columns one after the other; with ``by``, aggregates are within session and ``by``.

    A value is a Column or a SQL expression; later ones see earlier ones. With
    ``by``, a Column is an aggregate, or an expression whose aggregates have
    their own ``over``. In a SQL expression, write OVER () after an aggregate
    that stands beside other terms: it then means the group
    (``x - avg(x) over ()``).
    """
    group = Window.partitionBy(*keys, *by)
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in (*keys, *by))})"
    for name, value in columns.items():
        mixed = isinstance(value, str) and re.search(r"\bover\s*\(\s*\)", value, re.I)
        if by and mixed:
            df = df.withColumn(name, F.expr(re.sub(r"\bover\s*\(\s*\)", over, value, flags=re.I)))
            continue
        c = F.expr(value) if isinstance(value, str) else value
        df = df.withColumn(name, c.over(group) if by else c)
    return df
