"""The trace: many sessions in one DataFrame, with their metadata and log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions.columns import RATE, ROW, TIME, clean, numeric_columns
from trackspark.functions.times import epoch, normalise_times
from trackspark.operators import (
    bands,
    coordinate,
    filters,
    kinematics,
    provenance,
    resample,
    segment,
    summarise,
)

VERSION = "0.1.0"
CORE = {"gps": ("lat", "lng", "altitude"), "local": ("x", "y", "z")}
#: Names that sensor columns of a load should not have: verbs write them.
RESERVED = (
    "distance",
    "velocity",
    "heading",
    "angular_velocity",
    "acceleration",
    "jerk",
    "lateral_g",
    "designation",
    "is_interpolated",
)
#: The names by which from_dataframe finds columns, in order.
NAMES = {
    "unix_time": ("unix_time", "time", "timestamp", "t", "unix", "epoch"),
    "lat": ("lat", "latitude"),
    "lng": ("lng", "lon", "longitude"),
    "altitude": ("altitude", "alt", "elevation"),
    "x": ("x",),
    "y": ("y",),
    "z": ("z",),
}


@dataclass(frozen=True)
class Step:
    """One entry of the log."""

    step: str
    run_no: int
    detail: Mapping[str, object]
    columns_before: tuple[str, ...]
    columns_after: tuple[str, ...]
    notes: tuple[str, ...] = ()
    step_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    version: str = VERSION


@dataclass(frozen=True)
class Trace:
    """Sessions by ``keys``, rows by unix_time and _row. Verbs give a new trace.

    No verb runs a job (but designate, which counts a table of labels up to a bound); metadata, quality and reports are worked out when read.
    """

    df: DataFrame
    keys: tuple[str, ...] = ("session_id",)
    coord_system: str = "gps"
    metadata: Mapping[str, object] = field(default_factory=dict)
    log: tuple[Step, ...] = ()
    initial: DataFrame | None = None
    #: By step: the rows before it and its options, from which its quality is worked out.
    sources: Mapping[str, tuple[DataFrame, Mapping[str, object]]] = field(default_factory=dict, repr=False)

    # Making and keeping traces -------------------------------------------

    @classmethod
    def from_dataframe(
        cls,
        df: DataFrame,
        keys: Sequence[str] = ("session_id",),
        coord_system: str = "gps",
        order_by: str | None = None,
        columns: Mapping[str, str] | None = None,
        name: str | None = None,
        normalise: bool = False,
        **metadata,
    ) -> Trace:
        """Any table as a trace; columns are found by name or named in ``columns``.

        ``order_by`` is the order of arrival (by default as Spark reads it, which
        only a single file fixes). A table without session columns is one session.
        """
        if coord_system not in CORE:
            raise ValueError("coord_system is 'gps' or 'local'")
        notes, found = [], dict(columns or {})
        lower = {c.lower(): c for c in reversed(df.columns)}
        for target in ("unix_time", *CORE[coord_system]):
            if target not in found:
                hits = [lower[n] for n in NAMES[target] if n in lower and lower[n] not in keys]
                if target == "unix_time" and len(hits) > 1:
                    notes.append(f"several time columns; {hits[0]} is used")
                if hits:
                    found[target] = hits[0]
        needed = ("unix_time", *CORE[coord_system][:2])
        if missing := [t for t in needed if t not in found or found[t] not in df.columns]:
            raise ValueError(f"no column for {', '.join(missing)}")
        source = {v: k for k, v in found.items()}
        kinds = dict(df.dtypes)
        out = []
        for c in df.columns:
            target = source.get(c, c)
            if target == TIME and kinds[c].startswith(("timestamp", "date")):
                out.append(epoch(F.col(c)).alias(TIME))
            elif target == TIME or target in CORE[coord_system]:
                out.append(clean(F.col(c).try_cast("double")).alias(target))
            elif kinds[c] in ("double", "float"):
                out.append(clean(F.col(c)).alias(target))
            else:
                out.append(F.col(c).alias(target))
        row = F.col(order_by) if order_by else F.monotonically_increasing_id()
        frame = df.select(*out, row.cast("long").alias(ROW)) if ROW not in df.columns else df.select(*out)
        if not set(keys) <= set(frame.columns):
            frame = frame.withColumn("session_id", F.lit(name or "session"))
            keys = ("session_id",)
        if normalise:
            frame = normalise_times(frame, keys)
        extra = [c for c in frame.columns if c in RESERVED and c != "is_interpolated"]
        notes += [f"column {c} has a name that verbs write" for c in extra]
        frame = frame.withColumn("is_interpolated", F.lit(False))
        meta = {"name": name, "coordinate_system": coord_system, **metadata}
        trace = cls(frame, tuple(keys), coord_system, meta, (), frame)
        return trace._logged("initiate", df.columns, {"columns": found}, notes)

    def _logged(self, step: str, before: Sequence[str], detail: Mapping[str, object], notes: Sequence[str] = ()) -> Trace:
        run = 1 + sum(s.step == step for s in self.log)
        entry = Step(step, run, detail, tuple(before), tuple(self.df.columns), tuple(notes))
        return replace(self, log=(*self.log, entry))

    def _after(self, step: str, df: DataFrame, detail: Mapping[str, object], notes: Sequence[str] = (), **metadata) -> Trace:
        out = replace(self, df=df, metadata={**self.metadata, **metadata})
        return out._logged(step, self.df.columns, detail, notes)

    def _from(self, step: str, **options) -> Trace:
        """A trace that knows what its next step's quality is worked out from."""
        return replace(self, sources={**self.sources, step: (self.df, options)})

    def noted(self, *notes: str) -> Trace:
        """The trace with notes added to its last step."""
        last = replace(self.log[-1], notes=(*self.log[-1].notes, *notes))
        return replace(self, log=(*self.log[:-1], last))

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Trace:
        """Any DataFrame function; metadata and log stay."""
        return replace(self, df=fn(self.df))

    def set_metadata(self, **values) -> Trace:
        return replace(self, metadata={**self.metadata, **values})

    def validate(self, *columns: str) -> Trace:
        """Check the schema (no job); returns the trace."""
        needed = (*self.keys, TIME, ROW, *columns)
        if missing := [c for c in needed if c not in self.df.columns]:
            raise ValueError(f"the trace has no column {', '.join(missing)}")
        return self

    def stack(self, *others: Trace) -> Trace:
        """The sessions of several traces in one; columns that one lacks are null.

        Traces of different rates keep them: each row then has its session's.
        Metadata on which the traces differ is left out.
        """
        traces = [self, *others]
        rates = {t.rate(0.0) for t in traces}
        own = any(t.own_rates() for t in traces) or len(rates) > 1

        def rows(t: Trace) -> DataFrame:
            known = t.rate(0.0) or None
            return t.df if not own or t.own_rates() else t.df.withColumn(RATE, F.lit(known).cast("double"))

        df, initial = rows(self), self.initial
        for o in others:
            df = df.unionByName(rows(o), allowMissingColumns=True)
            if initial is not None and o.initial is not None:
                initial = initial.unionByName(o.initial, allowMissingColumns=True)
        shared = {k: v for k, v in self.metadata.items() if all(k in o.metadata and o.metadata[k] == v for o in others)}
        return replace(self, df=df, initial=initial, metadata=shared)

    def write(self, path: str) -> None:
        """Parquet of the rows, the metadata and the log."""
        self.df.write.mode("overwrite").parquet(f"{path}/trace")
        spark = self.df.sparkSession
        about = {"keys": list(self.keys), "coord_system": self.coord_system, "metadata": dict(self.metadata)}
        spark.createDataFrame([(json.dumps(about, default=str),)], "about string").write.mode("overwrite").parquet(f"{path}/metadata")
        self.quality_log().write.mode("overwrite").parquet(f"{path}/quality_log")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Trace:
        about = json.loads(spark.read.parquet(f"{path}/metadata").first()["about"])
        df = spark.read.parquet(f"{path}/trace")
        steps = [
            Step(
                r["step"],
                r["run_no"],
                json.loads(r["detail"]),
                tuple(r["columns_before"]),
                tuple(r["columns_after"]),
                tuple(r["notes"]),
                r["step_id"],
                r["at"],
                r["version"],
            )
            for r in spark.read.parquet(f"{path}/quality_log").orderBy("position").collect()
        ]  # one row per verb
        return cls(df, tuple(about["keys"]), about["coord_system"], about["metadata"], tuple(steps))

    # Rates -----------------------------------------------------------------

    def rate(self, default: float, *names: str) -> float:
        for n in names or ("interpolation_hz", "hz", "sample_rate"):
            if self.metadata.get(n) is not None:
                return float(self.metadata[n])
        return default

    def own_rates(self) -> bool:
        """Whether each session has its own rate, from an interpolation without ``hz`` or a stack."""
        return RATE in self.df.columns

    def rates(self, default: float) -> Column:
        """The rate of each row's session; the trace's where it has none of its own."""
        known = F.lit(self.rate(default))
        return F.coalesce(RATE, known) if self.own_rates() else known

    # Verbs -----------------------------------------------------------------

    def coordinate(
        self,
        source: str = "latlong",
        to: str = "xyz",
        crs: int = 3857,
        norm: bool | Sequence[float] = False,
        from_units: str | None = None,
        to_units: str = "m",
        rotate: Sequence[Sequence[float]] | None = None,
        drop_outliers: bool = False,
        origin_latlng: Sequence[float] | None = None,
    ) -> Trace:
        """x, y, z in metres: zero positions out, projection, origin, rotation, outliers."""
        if to != "xyz":
            raise ValueError("to is 'xyz'")
        self.validate(*(("lat", "lng") if source == "latlong" else ("x", "y")))
        if origin_latlng is not None:
            norm = coordinate.point(self.df.sparkSession, *origin_latlng, crs)
        df = coordinate.coordinate(self.df, self.keys, source, crs, norm, from_units, to_units, rotate, drop_outliers)
        notes = []
        if source == "latlong" and crs == 3857:
            notes.append("quality('crs') warns of sessions that EPSG:3857 stretches by 0.5 % or more")
        detail = {"source": source, "crs": crs, "norm": norm, "units": [from_units, to_units], "rotate": rotate, "drop_outliers": drop_outliers}
        more = {}
        if rotate is not None:
            more["rotation_angle"] = coordinate.sideline_angle(self.df.sparkSession, rotate, crs if source == "latlong" else None)
        return self._from("coordinate")._after("coordinate", df, detail | more, notes, **more)

    def utm_zone_suggest(self) -> DataFrame:
        return coordinate.utm_zone(self.df, self.keys)

    def interpolate(
        self, method: str = "linear", hz: float | None = None, max_gap_frames: int = 5, fill_passthrough: str = "none"
    ) -> Trace:
        """A regular grid of frames; without ``hz`` each session's own rate."""
        df = resample.interpolate(self.df, self.keys, hz, method, max_gap_frames, fill_passthrough)
        notes = [] if hz is not None else ["each session keeps its own frame rate"]
        detail = {"method": method, "hz": hz, "max_gap_frames": max_gap_frames, "fill_passthrough": fill_passthrough}
        source = self._from("interpolate", hz=hz, method=method, max_gap_frames=max_gap_frames)
        return source._after("interpolate", df, detail, notes, interpolation_hz=hz)

    def filtrate(self, method: str = "butterworth", target: str | Sequence[str] = "coordinates", **options) -> Trace:
        """Smoothed copies f_<column>."""
        given = options.pop("rate", None)
        rate = given or self.rate(10)
        notes = [
            f"f_{c} is filtered once more"
            for c in filters.targets(self.df, target)
            if f"f_{c}" in self.df.columns
        ]
        options = {"clamp" if k == "clamp_non_negative" else "kind" if k == "type" else k: v for k, v in options.items()}
        rows = self.df.withColumn(RATE, F.lit(float(given))) if given and self.own_rates() else self.df
        df = filters.filtrate(rows, self.keys, method, target, rate=rate, **options)
        source = self._from("filtrate", method=method, target=target, rate=rate, **options)
        return source._after("filtrate", df, {"method": method, "target": target, "rate": rate, **options}, notes)

    def filtrate_cutoff(
        self, target: str | Sequence[str] = "coordinates", method: str = "butterworth", steps: int = 50, low: float | None = None, high: float | None = None
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Residual curves, power spectra and suggested cutoffs of the signals.

        The cutoffs go from ``low`` to ``high``: by default 0.1 Hz to 0.95 of the
        Nyquist rate for Butterworth, and 0.01 to 0.5 for other methods (alpha,
        or one over the window). A session with its own rate is analysed at it.
        """
        rate = self.rate(10)

        def cutoffs(own: float) -> list[float]:
            first, last = (0.1, 0.95 * own / 2) if method == "butterworth" else (0.01, 0.5)
            first, last = first if low is None else low, last if high is None else high
            return [first + (last - first) * i / (steps - 1) for i in range(steps)]

        columns = filters.targets(self.df, target)
        curves = filters.residual_sweep(self.df, self.keys, columns, cutoffs, rate, method)
        return curves, filters.psd(self.df, self.keys, columns, rate), filters.elbows(curves, self.keys)

    def derivate(
        self,
        use_filtered: bool = True,
        window: int | Mapping[str, int] | None = None,
        speed_floor: float = 0.5,
        signed_omega: bool = False,
        derivatives: Sequence[str] | None = None,
    ) -> Trace:
        """distance, heading and derivatives by backward differences."""
        self.validate("x", "y")
        options = {
            "use_filtered": use_filtered,
            "window": window,
            "speed_floor": speed_floor,
            "signed_omega": signed_omega,
            "derivatives": derivatives,
            "rate": self.rate(5),
            "own_rates": self.own_rates(),
        }
        df = kinematics.derivate(self.df, self.keys, **options)
        raw = use_filtered and not {"f_x", "f_y"} <= set(self.df.columns)
        notes = ["there are no filtered coordinates; x and y are used"] if raw else []
        detail = {"window": window, "speed_floor": speed_floor, "signed_omega": signed_omega, "derivatives": derivatives}
        return self._from("derivate", **options)._after("derivate", df, detail, notes)

    def designate(
        self,
        v_threshold: float = 0.25,
        min_pts: int | None = None,
        labels: DataFrame | str | None = None,
        cols: str | Mapping[str, str] | None = None,
        rows_per_task: int | None = None,
    ) -> Trace:
        """Segments: by changepoints of velocity, or from ``labels`` (a table or a CSV path).

        With ``rows_per_task`` sessions that outgrow a task are searched in pieces.
        """
        if labels is not None:
            if isinstance(labels, str):
                labels = self.df.sparkSession.read.option("header", True).csv(labels)
            df = segment.label(self.df, self.keys, labels, cols)
            return self._after("designate", df, {"method": "manual", "cols": cols})
        points = int(5 * self.rate(10)) if min_pts is None else min_pts
        own = self.own_rates() and min_pts is None
        df = segment.designate(self.df, self.keys, v_threshold, F.floor(5 * self.rates(10)) if own else points, rows_per_task)
        source = self._from("designate", min_points=None if own else points)
        return source._after("designate", df, {"method": "changepoint", "v_threshold": v_threshold, "min_pts": "5 seconds" if own else points})

    def export_designations(self, path: str | None = None, strict: bool = False) -> DataFrame:
        runs = segment.export_designations(self.df, self.keys, strict)
        if path:
            runs.orderBy(*self.keys, "unix_start").write.option("header", True).csv(path)
        return runs

    def elaborate(self, by: Sequence[str] = (), **columns: Column | str) -> Trace:
        """New columns by expression, one after the other."""
        notes = [f"{c} is overwritten" for c in columns if c in RESERVED and c in self.df.columns]
        notes += [
            f"{n}: greatest and least skip nulls; pmax and pmin do not"
            for n, e in columns.items()
            if isinstance(e, str) and ("greatest(" in e or "least(" in e)
        ]
        df = summarise.elaborate(self.df, self.keys, columns, by)
        detail = {
            "by": list(by),
            "added": [c for c in columns if c not in self.df.columns],
            "modified": [c for c in columns if c in self.df.columns],
            "expressions": {n: str(e) for n, e in columns.items()},
        }
        return self._after("elaborate", df, detail, notes)

    def allocate(self, allocation: Mapping[str, Sequence[float]] | None = None, name: str = "allocation_1") -> Trace:
        """Intensity bands."""
        wanted = allocation or bands.DEFAULT
        notes = [f"{d} is no column or no derivative" for d in wanted if d not in bands.DEFAULT or d not in self.df.columns]
        df = bands.allocate(self.df, wanted, name)
        return self._after("allocate", df, {"name": name, "allocation": {k: list(v) for k, v in wanted.items()}}, notes)

    def allocate_csv(self, path: str) -> Trace:
        """Bands of every profile of a CSV file."""
        rows = self.df.sparkSession.read.option("header", True).csv(path).collect()  # a handful of bands
        out = self
        for name, allocation in bands.profiles([{**r.asDict()} for r in rows]).items():
            out = out.allocate(allocation, name)
        return out

    def quantitate(self, allocation: str | None = "allocation_1", derivative: str | Sequence[str] = "velocity", scope: str = "designation", active_only: bool = False, extra_keys: Sequence[str] = (), across_sessions: bool = False, ordered: bool = False, **measures: Column) -> DataFrame:
        """A summary table; ``across_sessions`` leaves the session out of the groups, ``ordered`` sorts by them."""
        keys = () if across_sessions else self.keys
        out = summarise.quantitate(self.df, keys, measures, allocation, derivative, scope, active_only, extra_keys)
        groups = [c for c in out.columns if c not in measures]
        return out.orderBy(*groups) if ordered and groups else out

    def quantitate_rollup(self, allocation: str | None = "allocation_1", derivative: str | Sequence[str] = "velocity", **measures: Column) -> DataFrame:
        """Summaries of segments, sessions and all sessions at once."""
        return summarise.quantitate_rollup(self.df, self.keys, measures, allocation, derivative)

    def band_duration(self) -> Column:
        return summarise.band_duration(self.rates(10) if self.own_rates() else self.rate(10))

    # Metadata and quality ----------------------------------------------------

    def sessions(self) -> DataFrame:
        return provenance.session_metadata(self.initial if self.initial is not None else self.df, self.keys)

    def quality_log(self) -> DataFrame:
        rows = [
            (i, s.step, s.run_no, s.step_id, s.at, s.version, list(s.columns_before), list(s.columns_after), list(s.notes), json.dumps(s.detail, default=str))
            for i, s in enumerate(self.log)
        ]
        schema = (
            "position int, step string, run_no int, step_id string, at timestamp, version string, "
            "columns_before array<string>, columns_after array<string>, notes array<string>, detail string"
        )
        return self.df.sparkSession.createDataFrame(rows, schema)

    def quality(self, step: str = "initiate") -> DataFrame:
        """Quality by session of one step, worked out now."""
        df, keys = self.df, self.keys
        if step == "initiate":
            return provenance.initial_quality(self.initial if self.initial is not None else df, keys)
        if step == "crs":
            return coordinate.mercator_stretch(df, keys)
        before, options = self.sources.get(step, (None, {}))
        if step == "coordinate" and {"x", "y"} <= set(df.columns):
            return provenance.coordinate_quality(df, keys, before)
        if step == "interpolate" and before is not None:
            return provenance.interpolation_quality(before, keys, **options)
        if step == "filtrate" and before is not None:
            return provenance.filter_quality(before, keys, **options)
        if step == "designate":
            points = options.get("min_points", 0) if before is not None else None
            return provenance.designation_quality(df, keys, F.floor(5 * self.rates(10)) if points is None and before is not None else points)
        if step == "derivate" and before is not None:
            return provenance.derivative_quality(before, keys, **options)
        if step == "allocate":
            return provenance.band_counts(df, keys, [c for c in df.columns if c.endswith("_band")])
        names = {
            "coordinate": ["x", "y", "z"],
            "interpolate": ["x", "y", "z"],
            "filtrate": [c for c in numeric_columns(df.schema) if c.startswith("f_")],
            "derivate": ["distance", "heading", *kinematics.OPTIONAL],
        }
        if step not in names:
            raise ValueError(f"no quality of {step!r}")
        return provenance.column_quality(df, keys, names[step])

    def quality_report(self, step: str | None = None, sessions: int = 20) -> str:
        """Text on each step of the log, with the first sessions' figures."""
        lines = []
        for s in self.log:
            if step in (None, s.step):
                lines.append(f"{s.step} (run {s.run_no}, {s.at:%Y-%m-%d %H:%M:%S} UTC, version {s.version})")
                lines += [f"  {k}: {v}" for k, v in s.detail.items() if v not in (None, {}, [])]
                lines += [f"  note: {n}" for n in s.notes]
                try:
                    table = self.quality(s.step)
                except ValueError:
                    continue
                for r in table.limit(sessions).collect():
                    lines.append("  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()))
        return "\n".join(lines)

    def metadata_report(self, sessions: int = 20) -> str:
        lines = [f"{k}: {v}" for k, v in self.metadata.items() if v is not None]
        for r in self.sessions().limit(sessions).collect():
            lines.append(", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None))
        return "\n".join(lines)

    def full_report(self) -> str:
        return f"{self.metadata_report()}\n\n{self.quality_report()}"

    def __repr__(self) -> str:
        names = self.df.columns
        shown = ", ".join(names[:15]) + (f", ... ({len(names)} columns)" if len(names) > 15 else "")
        return f"Trace by {', '.join(self.keys)} ({self.coord_system}), {len(self.log)} steps: {shown}"
