"""Running averages and gap flags of sessions as they arrive."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from trackspark.functions.columns import ROW, TIME

#: What a session's state holds: the last row given out, and the rows that wait for the watermark.
STATE = "last double, average double, times array<double>, places array<long>, values array<double>"


def running(
    stream: DataFrame,
    keys: Sequence[str] = ("session_id",),
    value: str = "x",
    alpha: float = 0.3,
    gap_seconds: float = 5.0,
    delay: str = "10 seconds",
) -> DataFrame:
    """keys, unix_time, _row, value, average, gap: of each row that the watermark has passed.

    ``stream`` has the keys, unix_time (seconds), _row and ``value``. Rows wait
    until the watermark, ``delay`` behind the latest time seen, has passed them,
    and are then given out in order of time and _row, so that rows that come
    late by less are where they belong: ``average`` is the exponential average of
    the session's values so far (of the first value it is that value; a null is
    skipped and has none), ``gap`` tells whether more than ``gap_seconds`` went by
    since the row before. Rows that come later than ``delay`` are dropped by
    Spark. A session's state is its rows within the delay, and nothing else of
    its past; rows without a time are left out.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is above 0 and at most 1")
    timed = (
        stream.filter(F.col(TIME).isNotNull() & ~F.isnan(TIME))
        .select(*keys, F.col(TIME), F.col(ROW).cast("long").alias(ROW), F.col(value).cast("double").alias("value"))
        .withColumn("__at", F.timestamp_micros(F.floor(F.col(TIME) * 1e6)))
        .withWatermark("__at", delay)
    )
    out = StructType([f for f in timed.schema if f.name in keys])
    for name, kind in ((TIME, DoubleType()), (ROW, LongType()), ("value", DoubleType()), ("average", DoubleType()), ("gap", BooleanType())):
        out = out.add(name, kind)
    names = [f.name for f in out]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, average, times, places, values = state.get if state.exists else (None, None, [], [], [])
        rows = list(zip(times, places, values))
        for part in parts:
            rows += zip(part[TIME], part[ROW], [None if pd.isna(v) else v for v in part["value"]])
        rows.sort(key=lambda r: r[:2])
        passed = state.getCurrentWatermarkMs()
        found, waiting = [], []
        for t, place, v in rows:
            if int(t * 1000) > passed:
                waiting.append((t, place, v))
                continue
            if v is not None:
                average = v if average is None else alpha * v + (1 - alpha) * average
            found.append((*key, t, place, v, None if v is None else average, last is not None and t - last > gap_seconds))
            last = t
        state.update((last, average, [r[0] for r in waiting], [r[1] for r in waiting], [r[2] for r in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(int(waiting[0][0] * 1000), passed + 1))
        yield pd.DataFrame(found, columns=names).astype({ROW: "int64", TIME: float, "value": float, "average": float, "gap": bool})

    return timed.groupBy(*keys).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def seconds(delay: str) -> float:
    """A delay such as "90 seconds" or "2 hours" in seconds."""
    number, unit = re.fullmatch(r"\s*([\d.]+)\s*(second|minute|hour|day)s?\s*", delay).groups()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
