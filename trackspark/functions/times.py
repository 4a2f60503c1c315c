"""Times as epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.columns import session

_DATES = ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy")
_CLOCKS = (" HH:mm:ss[.SSSSSS][.SSS]", " HH:mm", "")


def epoch(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp")) / F.lit(1e6)


def normalise_times(df: DataFrame, keys: Sequence[str], column: str = "unix_time") -> DataFrame:
    """Epoch seconds, by the number of digits of the session's median time.

    9 or 10 digits are seconds, 11 or 12 hundredths, 13 milliseconds and 16
    microseconds; other values stay as they are.
    """
    median = F.percentile(F.col(column), F.lit(0.5)).over(session(keys))
    return df.withColumn(column, F.col(column) / _scale(median))


def _scale(median: Column) -> Column:
    digits = F.floor(F.log10(F.abs(median))) + 1
    return F.when(digits == 16, 1e6).when(digits == 13, 1000.0).when(digits.isin(11, 12), 100.0).otherwise(1.0)


def parsed(text: Column, order: str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "[/.](?=\\d+[/.-]|\\d{2,4}\\b)", "-"), "[TZ]", " ")
    return F.try_to_timestamp(F.trim(plain), F.lit(order))


def text_to_epoch(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Epoch seconds from text: numbers where most are, else dates.

    Each session is judged by its own values, as files may differ. More than
    80 % numbers are taken as numbers, and brought to seconds only where their
    median is above 100,000 (frame numbers stay). Otherwise the first of nine
    orders (year, day or month first; seconds, minutes or no clock) that reads
    more than half of the session's values is used; if none does, its values
    are null.
    """
    c = F.col(column).cast("string")
    number = c.try_cast("double")
    formats = [d + k for k in _CLOCKS for d in _DATES]
    whole = session(keys)
    marked = df.withColumns(
        {
            "__n": F.count(c).over(whole),
            "__numbers": F.count(number).over(whole),
            "__median": F.percentile(number, F.lit(0.5)).over(whole),
            **{f"__f{i}": F.count(parsed(c, f)).over(whole) for i, f in enumerate(formats)},
        }
    )
    value = F.lit(None).cast("double")
    for i, f in reversed(list(enumerate(formats))):
        value = F.when(F.col(f"__f{i}") > 0.5 * F.col("__n"), epoch(parsed(c, f))).otherwise(value)
    seconds = number / F.when(F.col("__median") > 100_000, _scale(F.col("__median"))).otherwise(1.0)
    value = F.when(F.col("__numbers") > 0.8 * F.col("__n"), seconds).otherwise(value)
    return marked.withColumn(column, value).select(*df.columns)
