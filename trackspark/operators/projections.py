"""Map projections in Column expressions, from a table of published parameters.

Latitudes and longitudes are those of WGS 84. Systems on an ellipsoid of their
own are reached by a seven-parameter shift of geocentric positions at height 0;
ETRS89, NAD83, GDA94 and their like are taken to be WGS 84, as is usual at a
metre's accuracy.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis in metres and inverse flattening."""

    a: float
    rf: float

    @property
    def f(self) -> float:
        return 1 / self.rf

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


# Ellipsoids.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
AIRY = Ellipsoid(6377563.396, 299.3249646)
AIRY_MODIFIED = Ellipsoid(6377340.189, 299.3249646)
BESSEL = Ellipsoid(6377397.155, 299.1528128)
INTERNATIONAL = Ellipsoid(6378388.0, 297.0)


@dataclass(frozen=True)
class Shift:
    """From a local datum to WGS 84: metres, seconds of arc (position vector), parts per million."""

    dx: float
    dy: float
    dz: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0


@dataclass(frozen=True)
class System:
    """A projected coordinate system; angles in degrees, lengths in metres."""

    kind: str
    ellipsoid: Ellipsoid
    lat0: float
    lng0: float
    east: float
    north: float
    scale: float = 1.0
    parallels: tuple[float, float] = (0.0, 0.0)
    shift: Shift | None = None


def _tm(lat0, lng0, scale, east, north, ellipsoid=GRS80, shift=None) -> System:
    return System("tm", ellipsoid, lat0, lng0, east, north, scale, shift=shift)


def _lcc(lat0, lng0, first, second, east, north, ellipsoid=GRS80, shift=None) -> System:
    return System("lcc", ellipsoid, lat0, lng0, east, north, parallels=(first, second), shift=shift)


# Published parameters of projected systems, by EPSG code.
SYSTEMS = {
    # Lambert conformal conic with two standard parallels
    2154: _lcc(46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0),
    3034: _lcc(52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0),
    3111: _lcc(-37.0, 145.0, -36.0, -38.0, 2500000.0, 2500000.0),
    3112: _lcc(0.0, 134.0, -18.0, -36.0, 0.0, 0.0),
    3301: _lcc(57.5175539305556, 24.0, 59.3333333333333, 58.0, 500000.0, 6375000.0),
    3308: _lcc(-33.25, 147.0, -30.75, -35.75, 9300000.0, 4500000.0),
    3347: _lcc(63.390675, -91.8666666666667, 49.0, 77.0, 6200000.0, 3000000.0),
    3812: _lcc(50.797815, 4.35921583333333, 49.8333333333333, 51.1666666666667, 649328.0, 665262.0),
    3978: _lcc(49.0, -95.0, 49.0, 77.0, 0.0, 0.0),
    31370: _lcc(
        90.0, 4.36748666666667, 51.1666672333333, 49.8333339, 150000.013, 5400088.438, INTERNATIONAL,
        Shift(-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747),
    ),
    # Transverse Mercator
    2100: _tm(0.0, 24.0, 0.9996, 500000.0, 0.0, shift=Shift(-199.87, 74.79, 246.62)),
    2157: _tm(53.5, -8.0, 0.99982, 600000.0, 750000.0),
    2180: _tm(0.0, 19.0, 0.9993, 500000.0, -5300000.0),
    2193: _tm(0.0, 173.0, 0.9996, 1600000.0, 10000000.0),
    3006: _tm(0.0, 15.0, 0.9996, 500000.0, 0.0),
    3067: _tm(0.0, 27.0, 0.9996, 500000.0, 0.0),
    3763: _tm(39.6682583333333, -8.13310833333333, 1.0, 0.0, 0.0),
    3765: _tm(0.0, 16.5, 0.9999, 500000.0, 0.0),
    27700: _tm(49.0, -2.0, 0.9996012717, 400000.0, -100000.0, AIRY, Shift(446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)),
    29903: _tm(53.5, -8.0, 1.000035, 200000.0, 250000.0, AIRY_MODIFIED, Shift(482.5, -130.6, 564.6, -1.042, -0.214, -0.631, 8.15)),
    # Lambert azimuthal equal-area
    3035: System("laea", GRS80, 52.0, 10.0, 4321000.0, 3210000.0),
    # Mercator on the ellipsoid
    3395: System("mercator", WGS84, 0.0, 0.0, 0.0, 0.0),
}

#: Families of zones of six degrees: first and last code, what the code is beyond its zone, ellipsoid, south.
UTM_FAMILIES = (
    (32601, 32660, 32600, WGS84, False),
    (32701, 32760, 32700, WGS84, True),
    (25828, 25838, 25800, GRS80, False),
    (26901, 26923, 26900, GRS80, False),
    (28346, 28359, 28300, GRS80, True),
    (7846, 7859, 7800, GRS80, True),
)
#: Zones of three degrees on the Bessel ellipsoid: code 31464 + zone.
GAUSS_KRUGER = range(31466, 31470)
GAUSS_KRUGER_SHIFT = Shift(598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)


def system(crs: int) -> System:
    """The parameters of an EPSG code."""
    if crs in SYSTEMS:
        return SYSTEMS[crs]
    for first, last, base, ellipsoid, south in UTM_FAMILIES:
        if first <= crs <= last:
            return _tm(0.0, 6.0 * (crs - base) - 183.0, 0.9996, 500000.0, 10000000.0 if south else 0.0, ellipsoid)
    if crs in GAUSS_KRUGER:
        zone = crs - 31464
        return _tm(0.0, 3.0 * zone, 1.0, zone * 1e6 + 500000.0, 0.0, BESSEL, GAUSS_KRUGER_SHIFT)
    known = ", ".join(map(str, sorted(SYSTEMS)))
    zones = ", ".join(f"{a}-{b}" for a, b, *_ in UTM_FAMILIES)
    raise ValueError(f"EPSG:{crs} is not supported: 3857, {known}, {zones} and 31466-31469 are")


# Datums -------------------------------------------------------------------------
#
# Each step names what the next ones use several times: one nested expression
# would repeat it, and its own parts, in each place.

PHI, LAM, EAST, NORTH = "__phi", "__lam", "__east", "__north"


def named(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({f"__{k}": v for k, v in columns.items()})


def shifted(df: DataFrame, shift: Shift, local: Ellipsoid) -> DataFrame:
    """Radians (__phi, __lam) on a local datum instead of WGS 84."""
    c = F.col
    second = math.pi / 180 / 3600
    rx, ry, rz = shift.rx * second, shift.ry * second, shift.rz * second
    m = 1 + shift.ppm * 1e-6
    out = named(df, sin=F.sin(PHI), cos=F.cos(PHI))
    out = named(out, n=F.lit(WGS84.a) / F.sqrt(1 - WGS84.e2 * c("__sin") * c("__sin")))
    out = named(
        out,
        x=(c("__n") * c("__cos") * F.cos(LAM) - shift.dx) / m,
        y=(c("__n") * c("__cos") * F.sin(LAM) - shift.dy) / m,
        z=(c("__n") * (1 - WGS84.e2) * c("__sin") - shift.dz) / m,
    )
    out = named(
        out,
        u=c("__x") + rz * c("__y") - ry * c("__z"),
        v=c("__y") - rz * c("__x") + rx * c("__z"),
        w=c("__z") + ry * c("__x") - rx * c("__y"),
    )
    # Bowring's formula: at the ground a single step is exact to a small part of a millimetre.
    b = local.a * (1 - local.f)
    out = named(out, p=F.sqrt(c("__u") * c("__u") + c("__v") * c("__v")))
    out = named(out, theta=F.atan2(c("__w") * local.a, c("__p") * b))
    up = c("__w") + local.e2 / (1 - local.e2) * b * F.pow(F.sin("__theta"), F.lit(3.0))
    along = c("__p") - local.e2 * local.a * F.pow(F.cos("__theta"), F.lit(3.0))
    return named(out, phi=F.atan2(up, along), lam=F.atan2("__v", "__u"))


# Projections: __east and __north from radians; __lam is from the central meridian ------


def transverse_mercator(df: DataFrame, s: System) -> DataFrame:
    """Krüger's series in the third flattening."""
    n = s.ellipsoid.f / (2 - s.ellipsoid.f)
    arc = s.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    out = named(df, s=F.sin(PHI))
    out = named(out, t=F.sinh(F.atanh("__s") - F.lit(e) * F.atanh(F.lit(e) * F.col("__s"))))
    t = F.col("__t")
    out = named(out, xi=F.atan2(t, F.cos(LAM)), eta=F.atanh(F.sin(LAM) / F.sqrt(1 + t * t)))
    xi, eta = F.col("__xi"), F.col("__eta")
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    sin0 = math.sin(math.radians(s.lat0))
    xi0 = math.atan(math.sinh(math.atanh(sin0) - e * math.atanh(e * sin0)))
    origin = xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1))
    k = s.scale * arc
    return named(out, east=s.east + k * east, north=s.north + k * (north - origin if s.lat0 else north))


def lambert_conic(df: DataFrame, s: System) -> DataFrame:
    """Conformal, with two standard parallels (or one, given twice)."""
    e = s.ellipsoid.e

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        es = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (e / 2)

    first, second = map(math.radians, s.parallels)
    n = math.sin(first) if first == second else math.log(m(first) / m(second)) / math.log(t(first) / t(second))
    size = s.ellipsoid.a * m(first) / (n * t(first) ** n)
    r0 = size * max(0.0, t(math.radians(s.lat0))) ** n
    out = named(df, es=F.lit(e) * F.sin(PHI), turn=n * F.col(LAM))
    here = F.tan(math.pi / 4 - F.col(PHI) / 2) / F.pow((1 - F.col("__es")) / (1 + F.col("__es")), F.lit(e / 2))
    out = named(out, r=size * F.pow(here, F.lit(n)))
    r = F.col("__r")
    return named(out, east=s.east + r * F.sin("__turn"), north=s.north + r0 - r * F.cos("__turn"))


def lambert_azimuthal(df: DataFrame, s: System) -> DataFrame:
    """Equal-area, about a point that is no pole."""
    e, e2 = s.ellipsoid.e, s.ellipsoid.e2

    def q(phi: float) -> float:
        es = e * math.sin(phi)
        return (1 - e2) * (math.sin(phi) / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * e))

    phi0, polar = math.radians(s.lat0), q(math.pi / 2)
    beta0, size = math.asin(q(phi0) / polar), s.ellipsoid.a * math.sqrt(polar / 2)
    d = s.ellipsoid.a * math.cos(phi0) / math.sqrt(1 - e2 * math.sin(phi0) ** 2) / (size * math.cos(beta0))
    out = named(df, sin=F.sin(PHI), cosl=F.cos(LAM))
    out = named(out, es=F.lit(e) * F.col("__sin"))
    es = F.col("__es")
    own = (1 - e2) * (F.col("__sin") / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * e))
    out = named(out, beta=F.asin(own / polar))
    out = named(out, sinb=F.sin("__beta"), cosb=F.cos("__beta"))
    sin, cos, along = F.col("__sinb"), F.col("__cosb"), F.col("__cosb") * F.col("__cosl")
    out = named(out, b=size * F.sqrt(2 / (1 + math.sin(beta0) * sin + math.cos(beta0) * along)))
    b = F.col("__b")
    return named(
        out,
        east=s.east + b * d * cos * F.sin(LAM),
        north=s.north + b / d * (math.cos(beta0) * sin - math.sin(beta0) * along),
    )


def mercator(df: DataFrame, s: System) -> DataFrame:
    e, a = s.ellipsoid.e, s.ellipsoid.a
    out = named(df, es=F.lit(e) * F.sin(PHI))
    es = F.col("__es")
    stretch = F.tan(math.pi / 4 + F.col(PHI) / 2) * F.pow((1 - es) / (1 + es), F.lit(e / 2))
    return named(out, east=a * F.col(LAM), north=a * F.log(stretch))


KINDS: dict[str, Callable[[DataFrame, System], DataFrame]] = {
    "tm": transverse_mercator,
    "lcc": lambert_conic,
    "laea": lambert_azimuthal,
    "mercator": mercator,
}


def project(df: DataFrame, s: System) -> DataFrame:
    """``df`` with __east and __north, in metres, of its lat and lng, in degrees on WGS 84."""
    kept = df.columns
    if s.shift is None:
        degrees = F.col("lng") - F.lit(s.lng0)
        out = named(df, phi=F.radians("lat"), lam=F.radians(degrees) if s.kind == "tm" else _turned(degrees))
    else:
        out = shifted(named(df, phi=F.radians("lat"), lam=F.radians("lng")), s.shift, s.ellipsoid)
        out = named(out, lam=_turned(F.degrees(LAM) - F.lit(s.lng0)))
    return KINDS[s.kind](out, s).select(*kept, EAST, NORTH)


def _turned(degrees: Column) -> Column:
    """Radians between -pi and pi."""
    return F.radians(F.when(degrees > 180, degrees - 360).when(degrees < -180, degrees + 360).otherwise(degrees))
