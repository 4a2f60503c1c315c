"""Metadata and quality by session, as lazy aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.columns import RATE, ROW, TIME, finite, in_order, island, session
from trackspark.operators import coordinate, filters, kinematics, resample

GPS_BOUNDS = {"lat": 90, "lng": 180}


def _steps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__dt``: the positive time step to each row, in order of arrival."""
    arrival = Window.partitionBy(*keys).orderBy(ROW)
    dt = F.col(TIME) - F.lag(TIME).over(arrival)
    return df.withColumn("__dt", F.when(dt > 0, dt))


def session_metadata(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """session, name, session_start, native_hz, median_dt, duration and row count."""
    label = F.lit(name) if name is not None else F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    out = _steps(df, keys).groupBy(*keys).agg(
        F.percentile("__dt", F.lit(0.5)).alias("median_dt"),
        (F.max(TIME) - F.min(TIME)).alias("session_duration_sec"),
        F.count("*").alias("n_rows"),
    )
    return out.select(
        *keys,
        label.alias("name"),
        date_in(label).alias("session_start"),
        F.round(1 / F.col("median_dt"), 2).alias("native_hz"),
        "median_dt",
        "session_duration_sec",
        "n_rows",
    )


def date_in(name: Column) -> Column:
    """A date in a name: year-month-day, eight digits, or day-month-year."""

    def pick(pattern: str, *formats: str) -> Column:
        text = F.regexp_extract(name, pattern, 0)
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])

    return F.coalesce(
        pick("\\d{4}-\\d{2}-\\d{2}", "yyyy-MM-dd"),
        pick("\\d{8}", "yyyyMMdd", "ddMMyyyy"),
        pick("\\d{2}-\\d{2}-\\d{4}", "dd-MM-yyyy"),
    )


def _flag(condition: Column, text: str, *values: Column) -> Column:
    return F.when(condition, F.format_string(text, *values) if values else F.lit(text))


def _listed(*flags: Column) -> Column:
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def initial_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per session: what a load looks like, with issues and warnings."""
    gps = {"lat", "lng"} <= set(df.columns)
    axes = ("lat", "lng") if gps else tuple(c for c in ("x", "y") if c in df.columns)
    valid = F.lit(True)
    for c in axes:
        valid = valid & F.col(c).isNotNull()
    session_dt = F.percentile("__dt", F.lit(0.5)).over(session(keys))
    spread = [F.max(c) - F.min(c) for c in axes] if gps else []
    stepped = _steps(df, keys).withColumn("__gap", F.when(F.col("__dt") > 3 * session_dt, F.col("__dt")))
    out = stepped.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        (F.count_if(valid) / F.count("*")).alias("completeness"),
        F.round(1 / F.percentile("__dt", F.lit(0.5)), 2).alias("native_hz"),
        F.count("__gap").alias("n_gaps"),
        F.coalesce(100.0 * F.count("__gap") / F.nullif(F.count("__dt"), F.lit(0)), F.lit(0.0)).alias("gap_percentage"),
        F.coalesce(F.max("__gap"), F.lit(0.0)).alias("largest_gap"),
        (F.max(TIME) - F.min(TIME)).alias("duration_sec"),
        (F.count("*") - F.count_distinct(TIME) - F.max(F.col(TIME).isNull().cast("int"))).alias("n_duplicates"),
        *([F.greatest(*spread).alias("spread")] if gps else [F.lit(None).cast("double").alias("spread")]),
        *[
            (F.count_if(F.abs(c) > GPS_BOUNDS[c]) if gps else F.lit(0).cast("long")).alias(f"bad_{c}")
            for c in GPS_BOUNDS
        ],
    )
    c = F.col
    share = 100.0 * c("n_duplicates") / c("n_rows")
    issues = _listed(
        _flag(c("completeness") < 0.90, "only %.1f%% of positions are there", 100 * c("completeness")),
        _flag(c("native_hz") < 1, "%.2f frames per second is very few", c("native_hz")),
        _flag(c("gap_percentage") > 5, "%d gaps, %.1f%% of the steps", c("n_gaps"), c("gap_percentage")),
        _flag(c("largest_gap") > 10, "a gap of %.1f s", c("largest_gap")),
        _flag((c("bad_lat") > 0) | (c("bad_lng") > 0), "%d latitudes and %d longitudes out of range", c("bad_lat"), c("bad_lng")),
        _flag((c("n_duplicates") > 0) & (share > 1), "%d repeated times (%.1f%%)", c("n_duplicates"), share),
    )
    warnings = _listed(
        _flag((c("completeness") >= 0.90) & (c("completeness") < 0.95), "%.1f%% of positions are missing", 100 - 100 * c("completeness")),
        _flag((c("native_hz") >= 1) & (c("native_hz") < 5), "%.2f frames per second is few", c("native_hz")),
        _flag((c("gap_percentage") > 2) & (c("gap_percentage") <= 5), "%d gaps", c("n_gaps")),
        _flag((c("largest_gap") > 5) & (c("largest_gap") <= 10), "a gap of %.1f s", c("largest_gap")),
        _flag(c("duration_sec") < 60, "a session of %.0f s is short", c("duration_sec")),
        _flag(c("duration_sec") > 7200, "a session of %.1f h is long", c("duration_sec") / 3600),
        _flag(c("spread") < 0.0001, "the positions hardly differ: indoors or at rest?"),
        _flag((c("n_duplicates") > 0) & (share <= 1), "%d repeated times", c("n_duplicates")),
    )
    return out.withColumns({"issues": issues, "warnings": warnings}).withColumn("qc_pass", F.size("issues") == 0)


def column_quality(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """session, column, n_valid, n_null, min, max, mean of numeric columns."""
    parts = [c for c in columns if c in df.columns]
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in parts]).unpivot(list(keys), parts, "column", "value")
    return long.groupBy(*keys, "column").agg(
        F.count("value").alias("n_valid"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
    )


def interpolation_quality(
    before: DataFrame,
    keys: Sequence[str],
    hz: float | None = None,
    method: str = "linear",
    max_gap_frames: int = 5,
) -> DataFrame:
    """One row per session: what an interpolation of ``before`` finds and leaves, with issues.

    Counted in one pass over the rows as they are made: repeated frames, added
    frames, runs of frames without x before filling, what is filled, what stays
    empty, and the rows that the duration asks for.
    """
    there = {f"__had_{c}": F.col(c).isNotNull().cast("string") for c in "xy"}
    marked = before.withColumns(there | {"__n_in": F.count(TIME).over(session(keys)).cast("string")})
    out = resample.interpolate(marked, keys, hz, method, max_gap_frames)
    rate = F.lit(float(hz)) if hz is not None else F.col(RATE)
    w = in_order(keys)
    new = F.col("__had_x").isNull()
    had = {c: F.coalesce(F.col(f"__had_{c}") == "true", F.lit(False)) for c in "xy"}
    rows = out.withColumns({"__rate": rate, "__new": new, "__gap": ~had["x"]})
    change = F.coalesce(F.col("__gap") != F.lag("__gap").over(w), F.lit(True))
    runs = rows.withColumn("__run", island(change, w)).groupBy(*keys, "__run").agg(
        F.first("__gap").alias("gap"),
        F.count("*").alias("n"),
        F.count_if("__new").alias("new"),
        F.max(F.col("__n_in").cast("long")).alias("n_in"),
        F.count_if("is_interpolated").alias("interpolated"),
        *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in "xy"],
        *[F.count_if(F.col(c).isNotNull() & ~had[c]).alias(f"filled_{c}") for c in "xy"],
        F.min(TIME).alias("first"),
        F.max(TIME).alias("last"),
        F.max("__rate").alias("rate"),
    )
    length = F.when(F.col("gap"), F.col("n"))
    found = runs.groupBy(*keys).agg(
        F.max("n_in").alias("n_input"),
        F.sum("n").alias("n_rows"),
        (F.max("n_in") - F.sum("n") + F.sum("new")).alias("n_duplicates"),
        F.sum("new").alias("n_time_gaps"),
        F.sum("interpolated").alias("n_interpolated"),
        *[F.sum(f"filled_{c}").alias(f"filled_{c}") for c in "xy"],
        *[F.sum(f"na_{c}").alias(f"na_{c}") for c in "xy"],
        F.count_if("gap").alias("n_gaps"),
        F.coalesce(F.sum(length), F.lit(0).cast("long")).alias("total_missing"),
        F.min(length).alias("min_gap"),
        F.max(length).alias("max_gap"),
        F.round(F.avg(length), 2).alias("mean_gap"),
        F.percentile(length, F.lit(0.5)).alias("median_gap"),
        F.count_if(length > max_gap_frames).alias("n_exceeding"),
        (F.floor((F.max("last") - F.min("first")) * F.max("rate")) + 1).alias("expected_rows"),
        F.max("rate").alias("rate"),
    )
    c = F.col
    share = F.round(100.0 * c("n_interpolated") / c("n_rows"), 2)
    own = {*keys, TIME, ROW, RATE, "is_interpolated", "x", "y", "z"}
    carried = [n for n in before.columns if n not in own]
    issues = _listed(
        _flag(share > 50, "%.2f%% of the rows are interpolated", share),
        _flag(c("n_exceeding") > 0, f"%d gaps are longer than {max_gap_frames} frames and stay empty", c("n_exceeding")),
        _flag((c("na_x") > 0) | (c("na_y") > 0), "%d rows have no x and %d no y", c("na_x"), c("na_y")),
        _flag(c("n_duplicates") > 0, "%d repeated times were dropped", c("n_duplicates")),
        _flag(F.abs(c("n_rows") - c("expected_rows")) > 1, "%d rows were expected at %.2f a second, there are %d", c("expected_rows"), c("rate"), c("n_rows")),
        F.when(
            (c("n_time_gaps") > 0) & F.lit(bool(carried)),
            F.concat(F.lit(f"{len(carried)} other columns are empty in added rows, "), c("n_time_gaps").cast("string"), F.lit(": " + ", ".join(carried))),
        ),
    )
    return found.withColumns({"share": share, "issues": issues}).drop("rate")


def coordinate_quality(
    df: DataFrame, keys: Sequence[str], before: DataFrame | None = None, most: int = 100
) -> DataFrame:
    """One row per session: ranges, and outliers by kind, each with its fences and the first ``most`` rows.

    ``before`` are the rows before the step, for positions at exactly 0, 0 of
    latitude and longitude. Lists have a bound; counts are whole.
    """
    axes = [c for c in "xy" if c in df.columns]
    zero = (F.col("lat") == 0) & (F.col("lng") == 0) if before is not None and {"lat", "lng"} <= set(before.columns) else F.lit(False)
    slim = df.select(*keys, ROW, *[c for c in "xyz" if c in df.columns])
    for c in axes:
        low, high = coordinate.fences(c, keys)
        slim = slim.withColumns({f"__low_{c}": low, f"__high_{c}": high})
        slim = slim.withColumn(f"__out_{c}", F.coalesce((F.col(c) < F.col(f"__low_{c}")) | (F.col(c) > F.col(f"__high_{c}")), F.lit(False)))
    for c in axes:  # a rank within the outliers, so that a list never holds more
        by = Window.partitionBy(*keys, f"__out_{c}").orderBy(ROW)
        slim = slim.withColumn(f"__at_{c}", F.row_number().over(by))
    anywhere = F.greatest(*[F.col(f"__out_{c}") for c in axes])
    z = F.coalesce(F.max(F.col("z") != 0), F.lit(False)) if "z" in df.columns else F.lit(False)
    found = slim.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *[(F.max(c) - F.min(c)).alias(f"{c}_range") for c in axes],
        z.alias("z_present"),
        *[F.count_if(f"__out_{c}").alias(f"n_out_{c}") for c in axes],
        *[F.max(f"__{side}_{c}").alias(f"{side}_{c}") for c in axes for side in ("low", "high")],
        *[
            F.array_sort(F.collect_list(F.when(F.col(f"__out_{c}") & (F.col(f"__at_{c}") <= most), F.col(ROW)))).alias(f"rows_{c}")
            for c in axes
        ],
        F.count_if(anywhere).alias("n_outlier_rows"),
    )
    if before is not None:
        zeros = before.select(*keys, zero.alias("__zero")).groupBy(*keys).agg(F.count_if("__zero").alias("n_zero_gps"))
        found = found.join(zeros, list(keys), "left")
    else:
        found = found.withColumn("n_zero_gps", F.lit(0).cast("long"))
    kinds = _listed(F.when(F.col("n_zero_gps") > 0, "zero_gps"), *[F.when(F.col(f"n_out_{c}") > 0, f"{c}_iqr") for c in axes])
    return found.withColumn("outlier_types", kinds)


def derivative_quality(before: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """One row per session: valid, empty, least and largest of each derivative, rows voided by gaps, issues.

    Worked out from the rows before the step, in the pass that makes the derivatives.
    """
    out = kinematics.derivate(before, keys, marks=True, **options)
    made = [c for c in ("distance", "velocity", "acceleration", "heading", "angular_velocity", "jerk", "lateral_g") if c in out.columns]
    found = out.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(finite(F.col(c))).alias(f"{c}_valid") for c in made],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in made],
        *[F.min(F.when(finite(F.col(c)), F.col(c))).alias(f"{c}_min") for c in made],
        *[F.max(F.when(finite(F.col(c)), F.col(c))).alias(f"{c}_max") for c in made],
        F.count_if("__gap_velocity").alias("gap_velocity"),
        F.count_if("__gap_acceleration").alias("gap_acceleration"),
    )
    raw = options.get("use_filtered", True) and not {"f_x", "f_y"} <= set(before.columns)
    issues = _listed(
        _flag(F.lit(raw), "there are no filtered coordinates; x and y are used"),
        _flag(F.col("gap_velocity") > 0, "%d rows have velocity 0 as their span has a gap", F.col("gap_velocity")),
    )
    return found.withColumn("issues", issues)


def filter_quality(before: DataFrame, keys: Sequence[str], method: str, target: str | Sequence[str], **options) -> DataFrame:
    """session, column: values filtered, nulls that the filter adds, values clamped at 0, and issues.

    Worked out from the rows before the step, filtered without the clamp.
    """
    columns = filters.targets(before, target)
    clamp = options.pop("clamp", "velocity")
    clamped = {clamp} if isinstance(clamp, str) else set(clamp or ())
    source = {c: f"f_{c}" if f"f_{c}" in before.columns else c for c in columns}
    work = before.withColumns({f"__was_{c}": F.col(source[c]) for c in columns})
    out = filters.filtrate(work, keys, method, target, clamp=None, **options)
    each = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"__was_{c}").alias("was"), F.col(f"f_{c}").alias("now"), F.lit(c in clamped).alias("clamped"))
            for c in columns
        ]
    )
    long = out.select(*keys, F.inline(each))
    found = long.groupBy(*keys, "column").agg(
        F.count("*").alias("n_rows"),
        F.count("was").alias("n_valid"),
        F.count_if(F.col("was").isNotNull() & F.col("now").isNull()).alias("n_lost"),
        F.count_if(F.col("clamped") & (F.col("now") < 0)).alias("n_clamped"),
    )
    few = _flag(F.col("n_valid") < filters.LEAST_VALUES, f"fewer than {filters.LEAST_VALUES} values: nothing is filtered")
    return found.withColumn("issues", _listed(few))


def designation_quality(df: DataFrame, keys: Sequence[str], min_points: int | Column | None = None) -> DataFrame:
    """session, rows, share of labelled rows, number of labels, and issues.

    With ``min_points``, of a search for changepoints: sessions shorter than
    twice that, and those without any finite velocity, which have no label.
    """
    searched = min_points is not None and "velocity" in df.columns
    points = min_points if isinstance(min_points, Column) else F.lit(min_points or 0)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        (F.count("designation") / F.count("*")).alias("coverage"),
        F.count_distinct("designation").alias("n_labels"),
        (F.count_if(finite(F.col("velocity"))) if searched else F.count("*")).alias("n_finite"),
        F.max(points).cast("long").alias("min_points"),
    )
    c = F.col
    issues = _listed(
        _flag(c("n_finite") == 0, "no finite velocity: nothing is labelled"),
        _flag(F.lit(searched) & (c("n_rows") < 2 * c("min_points")), "%d rows are fewer than twice %d, the least of a segment", c("n_rows"), c("min_points")),
        _flag(c("coverage") < 0.9, "%.1f%% of the rows are labelled", 100 * c("coverage")),
    )
    return out.withColumn("issues", issues)


def band_counts(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """session, allocation, band, n_rows."""
    long = df.select(*keys, *bands).unpivot(list(keys), list(bands), "allocation", "band")
    return long.groupBy(*keys, "allocation", "band").agg(F.count("*").alias("n_rows"))
