"""Device files: delimited text with preambles, comments and blank ends.

A file is read as one row of lines (a session's file is small), so files are
read in parallel and cut to their data without a shuffle.
"""

from __future__ import annotations

import csv
import posixpath
import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions.columns import ROW, match_names
from trackspark.functions.times import text_to_epoch
from trackspark.sources.templates import CsvTemplate, Ref

SESSION = "session_id"
#: Names by which a file's columns are guessed, the likeliest first.
GUESSES = {
    "gps": {
        "unix_time": ("unix", "timestamp", "unixtime", "time_ms", "utc", "epoch", "time", "datetime", "date", "frame", "frameid", "frame_id", "frame_number"),
        "lat": ("latitude", "lat", "y", "coord_y", "lat_deg"),
        "lng": ("longitude", "lon", "long", "lng", "x", "coord_x", "lon_deg", "long_deg"),
        "altitude": ("altitude", "elevation", "height", "alt", "elev", "z", "alt_m", "elevation_m"),
    },
    "local": {
        "unix_time": ("unix", "timestamp", "unixtime", "time_ms", "utc", "time", "datetime", "date", "epoch"),
        "x": ("x", "coord_x", "pos_x", "longitude", "lon", "long"),
        "y": ("y", "coord_y", "pos_y", "latitude", "lat"),
        "z": ("z", "coord_z", "pos_z", "height", "altitude", "elevation", "alt"),
    },
}
_MISSING = ("", "na", "n/a", "null", "nan")


def session_names(found: DataFrame) -> Column:
    """A file's name without its ending; its path below the common folder if names repeat."""
    paths = [re.sub(r"^[a-z0-9]+:/*", "/", f) for f in found.inputFiles()]
    stems = [f.rpartition("/")[2].partition(".")[0] for f in paths]
    if len(set(stems)) == len(stems):
        name = F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.[^.]*)?$", 1)
    else:
        folder = posixpath.commonpath(paths)
        name = F.regexp_extract(F.col("_metadata.file_path"), f"\\Q{folder}\\E/(.*?)(\\.[^./]*)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """session_id (from a file's name), lines."""
    paths = [path] if isinstance(path, str) else list(path)
    text = F.regexp_replace("value", "^\ufeff", "")
    found = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    return found.select(session_names(found).alias(SESSION), F.split(text, "\r?\n").alias("lines"))


def _data_lines(template: CsvTemplate) -> Column:
    """Header and rows: without preamble and comments, up to the first long run of blank lines."""
    lines = F.col("lines")
    if template.header_pattern:
        at = F.filter(
            F.transform(lines, lambda x, i: F.when(x.rlike(template.header_pattern), i)), lambda i: i.isNotNull()
        )
        start = F.coalesce(F.get(at, F.lit(0)), F.size(lines))
    else:
        start = F.lit(template.skip)
    body = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    if template.comment:
        body = F.filter(body, lambda x: ~F.startswith(F.ltrim(x), F.lit(template.comment)))
    most = template.max_empty_lines

    def step(s: Column, x: Column) -> Column:
        run = F.when(F.trim(x) == "", s["run"] + 1).otherwise(0)
        cut = F.when(s["cut"] >= 0, s["cut"]).when(run >= most, s["i"] - (most - 1)).otherwise(-1)
        return F.struct((s["i"] + 1).alias("i"), run.alias("run"), cut.alias("cut"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(-1).alias("cut"))
    cut = F.aggregate(body, zero, step)["cut"]
    kept = F.when(cut >= 0, F.slice(body, 1, cut)).otherwise(body)
    return F.filter(kept, lambda x: F.trim(x) != "")


def split_header(line: str, delimiter: str) -> list[str]:
    return [c.strip().strip('"').strip() for c in next(csv.reader([line], delimiter=delimiter))]


def position(header: Sequence[str], ref: Ref, duplicates: str = "return_error") -> int | None:
    """Where a column is, from 0; None if it isn't there."""
    if isinstance(ref, int):
        return ref - 1 if 0 < ref <= len(header) else None
    hits = [i for i, c in enumerate(header) if c.lower() == ref.lower()]
    if len(hits) > 1 and duplicates == "return_error":
        raise ValueError(f"the header has {ref!r} {len(hits)} times; choose use_first, use_second or a number")
    return None if not hits else hits[min(len(hits) - 1, 1 if duplicates == "use_second" else 0)]


def read_csv(
    spark: SparkSession, path: str | Sequence[str], template: CsvTemplate, lenient: bool = False
) -> tuple[DataFrame, list[str]]:
    """The rows of all files, a session each, and notes on columns that aren't there.

    A coordinate that a file doesn't have is null if ``lenient``, else an error.
    Files may differ in their headers. An extra column is numeric if every
    value of the load is, else text.
    """
    cut = files(spark, path).select(SESSION, _data_lines(template).alias("lines"))
    cut = cut.select(SESSION, F.get("lines", F.lit(0)).alias("header"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("rows"))
    headers = [r[0] for r in cut.select("header").distinct().collect() if r[0] is not None]  # kinds of file
    if not headers:
        raise ValueError(f"no data in {path}")
    wanted = template.targets
    notes, places = [], {}
    for h in headers:
        names = split_header(h, template.delimiter)
        own = {t: position(names, ref, template.duplicate_method) for t, ref in wanted.items()}
        needed = list(wanted)[: 1 if lenient else 3]
        if missing := [str(wanted[t]) for t in needed if own[t] is None]:
            raise ValueError(f"no column {', '.join(missing)} in the header {names}")
        for ref, name in template.extra.items():
            at = position(names, ref, template.duplicate_method)
            label = name or (ref if isinstance(ref, str) else f"col_{ref}")
            own[label] = at
        notes += [f"no column for {t}" for t, at in own.items() if at is None]
        places[h] = own
    return parsed_rows(cut, places, list(wanted), template), sorted(set(notes))


def parsed_rows(cut: DataFrame, places: dict[str, dict[str, int | None]], wanted: Sequence[str], template: CsvTemplate) -> DataFrame:
    """session_id, _row and values of the lines ``rows`` of each file.

    ``places`` tells for each ``header`` where each target is. Targets beyond
    ``wanted`` are numeric if every value of the load is, else text.
    """
    width = max(len(split_header(h, template.delimiter)) for h in places)
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = cut.select(SESSION, "header", F.posexplode("rows").alias("pos", "line"))
    if template.n_max is not None:
        rows = rows.filter(F.col("pos") < template.n_max)
    rows = rows.withColumn("f", F.from_csv("line", F.lit(schema), {"sep": template.delimiter, "mode": "PERMISSIVE"}))

    def value(target: str) -> Column:
        out = F.lit(None).cast("string")
        for h, own in places.items():
            if own.get(target) is not None:
                out = F.when(F.col("header") == h, F.trim(F.col(f"f.c{own[target]}"))).otherwise(out)
        return F.when(~F.lower(out).isin(*_MISSING), out)

    def number(c: Column) -> Column:
        return (F.replace(c, F.lit(","), F.lit(".")) if template.decimal == "," else c).try_cast("double")

    names = list(dict.fromkeys(t for own in places.values() for t in own))
    text = rows.select(SESSION, F.col("pos").cast("long").alias(ROW), *[value(t).alias(t) for t in names])
    extra = [t for t in names if t not in wanted]
    if extra:
        seen = text.agg(*[F.count_if(F.col(t).isNotNull() & number(F.col(t)).isNull()).alias(t) for t in extra]).first()
        extra = [t for t in extra if seen[t] == 0]
    time = F.col("unix_time")
    out = text.withColumns(
        {t: number(F.col(t)) for t in names if t in extra or t in wanted and t != "unix_time"}
        | ({"unix_time": F.coalesce(number(time).cast("string"), time)} if template.decimal == "," else {})
    )
    return text_to_epoch(out, "unix_time", [SESSION])


def with_layouts(found: DataFrame) -> DataFrame:
    """session_id, header, head, rows of :func:`files`, each file's layout by its own lines.

    A file's block of data are its lines of the commonest number of commas (of
    equals the least). The header is the block's first line if that begins with
    a letter (or has one, as the file's first line), or else the last line
    before it that has one; without one it is null.
    """
    counts = F.transform("lines", lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    out = found.withColumn("__counts", counts)
    out = out.withColumn("__kinds", F.array_distinct(F.filter("__counts", lambda n: n > 0)))
    votes = F.transform("__kinds", lambda k: F.struct(F.size(F.filter("__counts", lambda n: n == k)).alias("n"), (-k).alias("k")))
    out = out.withColumn("__commas", -F.array_max(votes)["k"])
    out = out.withColumn("__first", (F.array_position("__counts", F.col("__commas")) - 1).cast("int"))
    line, first = F.get("lines", F.col("__first")), F.col("__first")
    before = F.array_max(F.transform("lines", lambda x, i: F.when((i < first) & x.rlike("[A-Za-z]"), i)))
    own = line.rlike("^[A-Za-z_]") | ((first == 0) & line.rlike("[A-Za-z]"))
    out = out.withColumn("head", F.when(own, first).otherwise(before))
    rows = F.filter("lines", lambda x, i: (F.get("__counts", i) == F.col("__commas")) & (i > F.col("head")))
    return out.select(SESSION, F.get("lines", F.col("head")).alias("header"), "head", rows.alias("rows"))


def guessed(header: str, coord_system: str, least: float) -> tuple[list[str], dict[str, str], str]:
    """The names of a header, which of them the targets are, and the coordinate system."""
    names = split_header(header, ",")
    lower = [c.lower() for c in names]
    if coord_system == "auto":
        geo = any("lat" in c or "lon" in c for c in lower)
        flat = {"x", "y", "coord_x", "coord_y"} & set(lower)
        coord_system = "local" if flat and not geo else "gps"
    found = match_names(list(dict.fromkeys(c for c in names if c)), GUESSES[coord_system], least)
    if "unix_time" not in found:
        raise ValueError(f"no column for unix_time among {names}")
    return names, found, coord_system


def read_guessed(
    spark: SparkSession, path: str | Sequence[str], coord_system: str = "auto", least: float = 0.8
) -> tuple[DataFrame, list[str], str]:
    """The rows of all files, each by its own layout, notes, and the coordinate system.

    Layouts are told apart in Spark, by file; the driver gets each kind of
    header once. A coordinate that a layout doesn't have is null. Of repeated
    names the first counts. Files of both coordinate systems don't load together.
    """
    cut = with_layouts(files(spark, path))
    bad = [r[0] for r in cut.filter("header is null").select(SESSION).limit(3).collect()]
    if bad:
        raise ValueError(f"no commas or no header in {', '.join(bad)}")
    headers = [r[0] for r in cut.select("header").distinct().collect()]  # kinds of file
    kinds = {h: guessed(h, coord_system, least) for h in headers}
    systems = {system for *_, system in kinds.values()}
    if len(systems) != 1:
        raise ValueError("some files have latitudes and some x and y; load them apart" if systems else f"no data in {path}")
    system = systems.pop()
    targets = list(GUESSES[system])
    places = {h: {t: names.index(found[t]) if t in found else None for t in targets} for h, (names, found, _) in kinds.items()}
    notes = [f"no column for {t}" for own in places.values() for t, at in own.items() if at is None]
    if len(headers) > 1:
        notes.append(f"{len(headers)} layouts of files")
    template = CsvTemplate(targets[0], targets[1], targets[2], coord_system=system, comment=None)
    return parsed_rows(cut, places, targets, template), sorted(set(notes)), system


def guess_csv_template(spark: SparkSession, path: str, coord_system: str = "auto", least: float = 0.8, save_path: str | None = None) -> CsvTemplate:
    """A template for files like ``path``, by the layout of one of them (see :func:`with_layouts`)."""
    layout = with_layouts(files(spark, path)).select("header", "head").limit(1).first()
    if layout is None or layout["header"] is None:
        raise ValueError(f"no commas or no header in {path}")
    header, found, coord_system = guessed(layout["header"], coord_system, least)
    head, lower = layout["head"], [c.lower() for c in header]
    refs = {t: header.index(c) + 1 if lower.count(c.lower()) > 1 else c for t, c in found.items()}
    axes = list(GUESSES[coord_system])[1:]
    made = CsvTemplate(refs["unix_time"], *[refs.get(a, a if k < 2 else None) for k, a in enumerate(axes)], coord_system=coord_system, skip=head, comment=None)
    if save_path:
        made.save(save_path)
    return made


#: Exports of a replay tool: the header follows a free preamble, data end at a blank line.
REPLAY = CsvTemplate(1, 3, 4, header_pattern="^Time, Time, Latitude", max_empty_lines=1, comment=None)


def replay_start(spark: SparkSession, path: str) -> DataFrame:
    """session_id, session_start: the time that a replay export's preamble states."""
    line = F.filter("lines", lambda x: F.contains(x, F.lit("StartTimeSeconds")))
    text = F.regexp_extract(F.get(line, F.lit(0)), "(\\d{1,2}[-/.]\\d{1,2}[-/.]\\d{4} \\d{1,2}:\\d{2}:\\d{2})", 1)
    return files(spark, path).select(
        SESSION, F.try_to_timestamp(F.regexp_replace(text, "[/.]", "-"), F.lit("d-M-yyyy H:mm:ss")).alias("session_start")
    )


def manual_template(coord_system: str, col_unix: Ref, columns: Sequence[Ref], **options) -> CsvTemplate:
    return replace(CsvTemplate(col_unix, *columns, coord_system=coord_system), **options)
