"""Intensity bands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = {
    "velocity": (0, 2, 4, 6, 8),
    "acceleration": (0, 1, 2, 3, 4),
    "angular_velocity": (0, 100, 200, 300, 400),
}
UNSIGNED = ("acceleration", "angular_velocity")


def band_number(value: Column, thresholds: Sequence[float]) -> Column:
    """1 to n - 1 for n thresholds: values below the first or from the last one on
    are in the outer bands, so only the inner thresholds count."""
    number = F.lit(1)
    for t in sorted(thresholds)[1:-1]:
        number = number + (value >= F.lit(float(t))).cast("int")
    return F.when(value.isNotNull(), number)


def allocate(
    df: DataFrame, allocation: Mapping[str, Sequence[float]] | None = None, name: str = "allocation_1"
) -> DataFrame:
    """``<name>_<derivative>_band``: band_1, band_2 ...; unknown derivatives are left out."""
    wanted = {d: t for d, t in (allocation or DEFAULT).items() if d in DEFAULT and d in df.columns}
    bands = {}
    for d, thresholds in wanted.items():
        value = F.abs(d) if d in UNSIGNED else F.col(d)
        number = band_number(value, thresholds)
        bands[f"{name}_{d}_band"] = F.when(number.isNotNull(), F.concat(F.lit("band_"), number.cast("string")))
    return df.withColumns(bands)


def band_order(band: Column | str) -> Column:
    """A band's number, to sort by (band_10 comes after band_9)."""
    return F.substring(band, 6, 10).cast("int")


def profiles(rows: Iterable[Mapping]) -> dict[str, dict[str, list[float]]]:
    """Thresholds by profile and derivative from (profile_name, target_derivative,
    profile_start, profile_end); a profile's bands must follow on each other."""
    found: dict[str, dict[str, list[tuple[float, float]]]] = {}
    for r in rows:
        ends = float(r["profile_start"]), float(r["profile_end"])
        found.setdefault(r["profile_name"], {}).setdefault(r["target_derivative"], []).append(ends)
    out: dict[str, dict[str, list[float]]] = {}
    for name, by in found.items():
        for d, spans in by.items():
            spans.sort()
            if any(a[1] != b[0] for a, b in zip(spans, spans[1:])):
                raise ValueError(f"profile {name!r}: the bands of {d} do not follow on each other")
            out.setdefault(name, {})[d] = [*[a for a, _ in spans], spans[-1][1]]
    return out
