"""The engine's queries over the driver's tables, and their SQL.

``events`` are read as traces: a session per user, x = value and y = props.k,
and as positions on the globe; ``lineitem`` as a trace of many repeated times.
The grid has one frame an hour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions.columns import TIME, in_order, pmax, pmin, rolling
from trackspark.functions.shared import shared_folder
from trackspark.functions.times import epoch, normalise_times
from trackspark.operators import coordinate, filters, provenance, resample, segment
from trackspark.streaming import live
from trackspark.trace import Trace

HZ = 1.0 / 3600.0
KEYS = ("session_id",)
SESSION = "session_id"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# Traces ----------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> Trace:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias(SESSION),
        F.col("ts").alias(TIME),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").alias("y"),
        "event_type",
        "event_id",
    )
    return Trace.from_dataframe(df, KEYS, "local", order_by="event_id").transform(lambda d: d.drop("event_id"))


def gps(spark: SparkSession, sf_dir: str) -> Trace:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    # The SQL's -60 + user_id * 0.08 is a decimal, so exact; a sum of doubles differs in its last places.
    lat = (F.col("user_id") * 8 - 6000) / 100.0 + F.col("value") * 1e-4
    lng = (F.col("user_id") * 22 - 17000) / 100.0 + k * 1e-4
    no, zero = F.col("event_id") % 17 == 0, F.col("event_id") % 23 == 0
    df = e.select(
        F.col("user_id").alias(SESSION),
        F.col("ts").alias(TIME),
        F.when(~no, F.when(zero, 0.0).otherwise(lat)).alias("lat"),
        F.when(~no, F.when(zero, 0.0).otherwise(lng)).alias("lng"),
        (F.col("value") / 10).alias("altitude"),
        "event_id",
    )
    return Trace.from_dataframe(df, KEYS, "gps", order_by="event_id").transform(lambda d: d.drop("event_id"))


def lineitems(spark: SparkSession, sf_dir: str) -> Trace:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias(SESSION),
        F.col("l_shipdate").alias(TIME),
        F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("n"),
    )
    return Trace.from_dataframe(df, KEYS, "local", order_by="n").transform(lambda d: d.drop("n"))


def gridded(spark: SparkSession, sf_dir: str, method: str = "linear", passthrough: str = "none") -> Trace:
    return events(spark, sf_dir).interpolate(method, hz=HZ, fill_passthrough=passthrough)


def moving(spark: SparkSession, sf_dir: str, **options) -> Trace:
    options = {"window": 1, "speed_floor": 0.0005, "use_filtered": False} | options
    return gridded(spark, sf_dir).derivate(**options)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


E = """e AS (SELECT user_id AS session_id, epoch(ts) AS unix_time, value AS x,
       CAST(props->>'$.k' AS DOUBLE) AS y, event_type, event_id AS _row FROM events)"""
G = """g AS (SELECT user_id AS session_id, epoch(ts) AS unix_time, event_id AS _row, value / 10 AS altitude,
       CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 23 = 0 THEN 0.0
            ELSE -60 + user_id * 0.08 + value * 1e-4 END END AS lat,
       CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 23 = 0 THEN 0.0
            ELSE -170 + user_id * 0.22 + CAST(props->>'$.k' AS DOUBLE) * 1e-4 END END AS lng FROM events)"""
C = f"""{G}, c AS (SELECT session_id, unix_time, _row, altitude,
       CASE WHEN lat = 0 AND lng = 0 THEN NULL ELSE lat END AS lat,
       CASE WHEN lat = 0 AND lng = 0 THEN NULL ELSE lng END AS lng FROM g),
    p AS (SELECT *, 6378137.0 * radians(lng) AS x,
       6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y, altitude AS z FROM c)"""
GRID = f"""{E}, s AS (SELECT *, CAST(round_even(unix_time * (1.0::DOUBLE / 3600.0::DOUBLE), 0) AS BIGINT) AS k FROM e),
    u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY _row) = 1),
    b AS (SELECT session_id, unnest(generate_series(min(k), max(k))) AS k FROM u GROUP BY session_id),
    r AS (SELECT b.session_id, b.k, b.k / (1.0::DOUBLE / 3600.0::DOUBLE) AS unix_time, u.x AS x0, u.y AS y0, u.event_type,
          u._row IS NULL AS is_new
          FROM b LEFT JOIN u ON b.session_id = u.session_id AND b.k = u.k),
    n AS (SELECT *,
          last_value(CASE WHEN NOT is_new THEN k END IGNORE NULLS) OVER up AS ka,
          last_value(x0 IGNORE NULLS) OVER up AS xa, last_value(y0 IGNORE NULLS) OVER up AS ya,
          first_value(CASE WHEN NOT is_new THEN k END IGNORE NULLS) OVER down AS kb,
          first_value(x0 IGNORE NULLS) OVER down AS xb, first_value(y0 IGNORE NULLS) OVER down AS yb
          FROM r WINDOW up AS (PARTITION BY session_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        down AS (PARTITION BY session_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    i AS (SELECT *, CASE WHEN NOT is_new THEN x0 WHEN kb - ka - 1 <= 5 THEN xa + (xb - xa) * (k - ka) / (kb - ka) END AS x,
          CASE WHEN NOT is_new THEN y0 WHEN kb - ka - 1 <= 5 THEN ya + (yb - ya) * (k - ka) / (kb - ka) END AS y FROM n)"""
W = "PARTITION BY session_id ORDER BY k"


def derived(rows: int = 1, floor: float = 0.0005) -> str:
    w = f"({W})"
    whole = f"({W} ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW)"
    return f"""{GRID},
    d1 AS (SELECT *, CASE WHEN NOT max(x IS NULL OR y IS NULL) OVER {whole}
               THEN sqrt((x - lag(x, {rows}) OVER {w}) * (x - lag(x, {rows}) OVER {w})
                       + (y - lag(y, {rows}) OVER {w}) * (y - lag(y, {rows}) OVER {w})) END AS dist,
           unix_time - lag(unix_time, {rows}) OVER {w} AS dt,
           x - lag(x, {rows}) OVER {w} AS dx, y - lag(y, {rows}) OVER {w} AS dy FROM i),
    d2 AS (SELECT *, dist / dt AS vel FROM d1),
    d3 AS (SELECT *, CASE WHEN vel >= {floor} THEN atan2(dy, dx) * (180.0 / pi()) END AS head,
           CASE WHEN NOT max(vel IS NULL) OVER {whole} THEN (vel - lag(vel, {rows}) OVER {w}) / dt END AS acc FROM d2),
    d4 AS (SELECT *, head - lag(head, {rows}) OVER {w} + 180.0 AS turn,
           CASE WHEN NOT max(acc IS NULL) OVER {whole} THEN (acc - lag(acc, {rows}) OVER {w}) / dt END AS jrk FROM d3),
    d AS (SELECT session_id, k, unix_time, x, y, coalesce(dist, 0) AS distance, coalesce(vel, 0) AS velocity,
          head AS heading, acc AS acceleration, jrk AS jerk,
          coalesce((turn - 360.0 * floor(turn / 360.0) - 180.0) / dt, 0) AS omega FROM d4)"""


# Sources, times, metadata ------------------------------------------------------


@query("trace_view", f"WITH {E} SELECT session_id, round(unix_time, 3) AS unix_time, x, y, event_type, _row FROM e")
def trace_view(spark, sf_dir):
    df = events(spark, sf_dir).df.select(SESSION, TIME, "x", "y", "event_type", "_row")
    return rounded(df, unix_time=3)


@query(
    "time_normalise",
    f"""WITH {E}, m AS (SELECT session_id, _row, floor(unix_time) * CASE session_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 1000 END AS t FROM e),
    q AS (SELECT *, quantile_cont(t, 0.5) OVER (PARTITION BY session_id) AS med FROM m)
    SELECT session_id, _row, t / CASE floor(log10(abs(med))) + 1 WHEN 13 THEN 1000.0 WHEN 12 THEN 100.0 WHEN 11 THEN 100.0 ELSE 1.0 END AS unix_time FROM q""",
)
def time_normalise(spark, sf_dir):
    unit = F.when(F.col(SESSION) % 3 == 0, 1).when(F.col(SESSION) % 3 == 1, 100).otherwise(1000)
    df = events(spark, sf_dir).df.withColumn(TIME, F.floor(TIME) * unit.cast("double"))
    return normalise_times(df, KEYS).select(SESSION, "_row", TIME)


META = f"""{E}, dt AS (SELECT *, unix_time - lag(unix_time) OVER (PARTITION BY session_id ORDER BY _row) AS step FROM e),
    pos AS (SELECT *, CASE WHEN step > 0 THEN step END AS dt FROM dt)"""


@query(
    "session_metadata",
    f"""WITH {META} SELECT session_id, round(quantile_cont(dt, 0.5), 3) AS median_dt,
    round(max(unix_time) - min(unix_time), 3) AS session_duration_sec, count(*) AS n_rows,
    round(1 / quantile_cont(dt, 0.5), 2) AS native_hz FROM pos GROUP BY session_id""",
)
def session_metadata(spark, sf_dir):
    df = events(spark, sf_dir).sessions().select(SESSION, "median_dt", "session_duration_sec", "n_rows", "native_hz")
    return rounded(df, median_dt=3, session_duration_sec=3)


@query(
    "qc_summary",
    f"""WITH {META}, med AS (SELECT *, quantile_cont(dt, 0.5) OVER (PARTITION BY session_id) AS m FROM pos)
    SELECT session_id, count(*) AS n_rows, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*) AS completeness,
    count(*) FILTER (WHERE dt > 3 * m) AS n_gaps, round(coalesce(max(dt) FILTER (WHERE dt > 3 * m), 0), 3) AS largest_gap,
    round(coalesce(100.0 * count(*) FILTER (WHERE dt > 3 * m) / nullif(count(dt), 0), 0), 6) AS gap_percentage,
    count(*) - count(DISTINCT unix_time) AS n_duplicates FROM med GROUP BY session_id""",
)
def qc_summary(spark, sf_dir):
    df = events(spark, sf_dir).quality("initiate")
    df = df.select(SESSION, "n_rows", "completeness", "n_gaps", "largest_gap", "gap_percentage", F.col("n_duplicates").cast("long").alias("n_duplicates"))
    return rounded(df, largest_gap=3, gap_percentage=6)


# Coordinates -------------------------------------------------------------------


@query("zero_gps", f"WITH {C} SELECT session_id, _row, lat, lng FROM c")
def zero_gps(spark, sf_dir):
    return coordinate.drop_zero_gps(gps(spark, sf_dir).df).select(SESSION, "_row", "lat", "lng")


@query("project_mercator", f"WITH {C} SELECT session_id, _row, round(x, 4) AS x, round(y, 4) AS y, z FROM p")
def project_mercator(spark, sf_dir):
    return rounded(gps(spark, sf_dir).coordinate().df.select(SESSION, "_row", "x", "y", "z"), x=4, y=4)


# Krüger's series to the third power of n, its constants worked out by SQL itself.
UTM = f"""{C}, w AS (SELECT 1 / 298.257223563::DOUBLE AS f), n AS (SELECT f / (2 - f) AS n FROM w),
    q AS (SELECT n, 6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) AS arc, n / 2 - 2 * n * n / 3 + 5 * n ** 3 / 16 AS a1,
          13 * n * n / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM n),
    t AS (SELECT session_id, _row, lat, lng, q.*, radians(lng - 3) AS lam,
          sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM c, q),
    v AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)"""


@query(
    "project_utm",
    f"""WITH {UTM} SELECT session_id, _row,
    round(500000 + 0.9996::DOUBLE * arc * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS x,
    round(10000000 + 0.9996::DOUBLE * arc * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS y FROM v""",
)
def project_utm(spark, sf_dir):
    return rounded(gps(spark, sf_dir).coordinate(crs=32731).df.select(SESSION, "_row", "x", "y"), x=3, y=3)


# Positions near a place: a sixtieth of the degrees of the others.
def near(spark, sf_dir, lat: float, lng: float, crs: int) -> DataFrame:
    def moved(d: DataFrame) -> DataFrame:
        zero = (F.col("lat") == 0) & (F.col("lng") == 0)
        places = {"lat": F.lit(lat) + F.col("lat") / 60, "lng": F.lit(lng) + F.col("lng") / 60}
        return d.withColumns({c: F.when(zero, 0.0).otherwise(p) for c, p in places.items()})

    trace = gps(spark, sf_dir).transform(moved).coordinate(crs=crs)
    return rounded(trace.df.select(SESSION, "_row", "x", "y"), x=3, y=3)


def _near_sql(lat: float, lng: float) -> str:
    return f"{C}, o AS (SELECT session_id, _row, radians({lat}::DOUBLE + lat / 60) AS phi, {lng}::DOUBLE + lng / 60 AS lng FROM c)"


# The textbook's two-parallel conic on GRS 80, its constants worked out by SQL itself.
LCC = f"""{_near_sql(47.0, 5.5)},
    ell AS (SELECT sqrt(2 / 298.257222101::DOUBLE - 1 / 298.257222101::DOUBLE ** 2) AS e),
    q AS (SELECT e, phi, cos(phi) / sqrt(1 - (e * sin(phi)) ** 2) AS m, tan(pi() / 4 - phi / 2) / ((1 - e * sin(phi)) / (1 + e * sin(phi))) ** (e / 2) AS t,
          deg FROM ell, (SELECT radians(deg) AS phi, deg FROM (VALUES (49.0::DOUBLE), (44.0::DOUBLE), (46.5::DOUBLE)) AS v(deg))),
    k AS (SELECT a.e, (ln(a.m) - ln(b.m)) / (ln(a.t) - ln(b.t)) AS n, a.m AS m1, a.t AS t1, o.t AS t0
          FROM q a, q b, q o WHERE a.deg = 49 AND b.deg = 44 AND o.deg = 46.5),
    r AS (SELECT session_id, _row, n, radians(lng - 3.0::DOUBLE) * n AS theta, 6378137.0::DOUBLE * m1 / (n * t1 ** n) * t0 ** n AS r0,
          6378137.0::DOUBLE * m1 / (n * t1 ** n)
          * (tan(pi() / 4 - phi / 2) / ((1 - e * sin(phi)) / (1 + e * sin(phi))) ** (e / 2)) ** n AS r FROM o, k)"""


@query(
    "project_lcc",
    f"WITH {LCC} SELECT session_id, _row, round(700000 + r * sin(theta), 3) AS x, round(6600000 + r0 - r * cos(theta), 3) AS y FROM r",
)
def project_lcc(spark, sf_dir):
    return near(spark, sf_dir, 47.0, 5.5, 2154)


# Geocentric positions, the seven parameters turned round, Bowring's latitude, and Krüger's series on the Airy ellipsoid.
SHIFTED = f"""{_near_sql(53.0, 0.5)},
    w AS (SELECT 1 / 298.257223563::DOUBLE AS f, 1 / 299.3249646::DOUBLE AS lf, 6377563.396::DOUBLE AS la,
          pi() / 648000 AS sec, 1 - 20.489e-6::DOUBLE AS m),
    ell AS (SELECT *, f * (2 - f) AS e2, lf * (2 - lf) AS le2, la * (1 - lf) AS lb, lf / (2 - lf) AS n FROM w),
    c1 AS (SELECT session_id, _row, ell.*, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(phi) ** 2) AS nu, phi, radians(lng) AS lam FROM o, ell),
    c2 AS (SELECT *, (nu * cos(phi) * cos(lam) - 446.448::DOUBLE) / m AS x1, (nu * cos(phi) * sin(lam) + 125.157::DOUBLE) / m AS y1,
           (nu * (1 - e2) * sin(phi) - 542.06::DOUBLE) / m AS z1 FROM c1),
    c3 AS (SELECT *, x1 + 0.842::DOUBLE * sec * y1 - 0.247::DOUBLE * sec * z1 AS x2, y1 - 0.842::DOUBLE * sec * x1 + 0.15::DOUBLE * sec * z1 AS y2,
           z1 + 0.247::DOUBLE * sec * x1 - 0.15::DOUBLE * sec * y1 AS z2 FROM c2),
    c4 AS (SELECT *, sqrt(x2 * x2 + y2 * y2) AS p, atan2(z2 * la, sqrt(x2 * x2 + y2 * y2) * lb) AS theta FROM c3),
    c5 AS (SELECT session_id, _row, n, la, atan2(z2 + le2 / (1 - le2) * lb * sin(theta) ** 3, p - le2 * la * cos(theta) ** 3) AS phi,
           atan2(y2, x2) + radians(2.0::DOUBLE) AS lam, 2 * sqrt(n) / (1 + n) AS ecc, la / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) AS arc,
           n / 2 - 2 * n * n / 3 + 5 * n ** 3 / 16 AS a1, 13 * n * n / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM c4),
    c6 AS (SELECT *, sinh(atanh(sin(phi)) - ecc * atanh(ecc * sin(phi))) AS t,
           atan(sinh(atanh(sin(radians(49.0::DOUBLE))) - ecc * atanh(ecc * sin(radians(49.0::DOUBLE))))) AS xi0 FROM c5),
    c7 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta,
           xi0 + a1 * sin(2 * xi0) + a2 * sin(4 * xi0) + a3 * sin(6 * xi0) AS north0 FROM c6)"""


@query(
    "project_tm_shifted",
    f"""WITH {SHIFTED} SELECT session_id, _row,
    round(400000 + 0.9996012717::DOUBLE * arc * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS x,
    round(-100000 + 0.9996012717::DOUBLE * arc * (xi - north0 + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS y FROM c7""",
)
def project_tm_shifted(spark, sf_dir):
    return near(spark, sf_dir, 53.0, 0.5, 27700)


LAEA = f"""{_near_sql(51.0, 12.5)},
    ell AS (SELECT 2 / 298.257222101::DOUBLE - 1 / 298.257222101::DOUBLE ** 2 AS e2),
    par AS (SELECT e2, sqrt(e2) AS e, radians(52.0::DOUBLE) AS phi0 FROM ell),
    q0 AS (SELECT *, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp,
           (1 - e2) * (sin(phi0) / (1 - e2 * sin(phi0) ** 2) - ln((1 - e * sin(phi0)) / (1 + e * sin(phi0))) / (2 * e)) AS q FROM par),
    k AS (SELECT *, asin(q / qp) AS b0, 6378137.0::DOUBLE * sqrt(qp / 2) AS rq,
          6378137.0::DOUBLE * cos(phi0) / sqrt(1 - e2 * sin(phi0) ** 2) / (6378137.0::DOUBLE * sqrt(qp / 2) * cos(asin(q / qp))) AS d FROM q0),
    b AS (SELECT session_id, _row, k.*, radians(lng - 10.0::DOUBLE) AS lam,
          asin((1 - e2) * (sin(phi) / (1 - e2 * sin(phi) ** 2) - ln((1 - e * sin(phi)) / (1 + e * sin(phi))) / (2 * e)) / qp) AS beta FROM o, k),
    r AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(lam))) AS s FROM b)"""


@query(
    "project_laea",
    f"""WITH {LAEA} SELECT session_id, _row, round(4321000 + s * d * cos(beta) * sin(lam), 3) AS x,
    round(3210000 + s / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(lam)), 3) AS y FROM r""",
)
def project_laea(spark, sf_dir):
    return near(spark, sf_dir, 51.0, 12.5, 3035)


@query(
    "utm_zone",
    f"""WITH {C}, m AS (SELECT session_id, quantile_cont(lat, 0.5) AS la, quantile_cont(lng, 0.5) AS lo FROM g GROUP BY session_id)
    SELECT session_id, CAST(floor((lo + 180) / 6) + 1 AS INT) AS zone,
    CAST(CASE WHEN la >= 0 THEN 32600 ELSE 32700 END + floor((lo + 180) / 6) + 1 AS INT) AS epsg FROM m""",
)
def utm_zone(spark, sf_dir):
    return gps(spark, sf_dir).utm_zone_suggest()


@query(
    "unit_convert",
    f"WITH {E} SELECT session_id, _row, round(x * (0.01 / 1), 8) AS x, round(y * (1.0 / 100.0), 8) AS y FROM e",
)
def unit_convert(spark, sf_dir):
    df = events(spark, sf_dir).coordinate("xyz", from_units="cm", to_units="m").df
    return rounded(df.select(SESSION, "_row", "x", "y"), x=8, y=8)


@query(
    "normalise_first",
    f"""WITH {C}, o AS (SELECT session_id, arg_min(x, _row) AS x0, arg_min(y, _row) AS y0, arg_min(z, _row) AS z0
    FROM p WHERE x IS NOT NULL GROUP BY session_id)
    SELECT p.session_id, _row, round(x - x0, 3) + 0.0 AS x, round(y - y0, 3) + 0.0 AS y, round(z - z0, 6) + 0.0 AS z FROM p LEFT JOIN o USING (session_id)""",
)
def normalise_first(spark, sf_dir):
    df = gps(spark, sf_dir).coordinate(norm=True).df.select(SESSION, "_row", "x", "y", "z")
    return rounded(df, x=3, y=3, z=6)


@query("normalise_custom", f"WITH {E} SELECT session_id, _row, round(x - 50.0, 6) + 0.0 AS x, round(y - 25.0, 6) + 0.0 AS y FROM e")
def normalise_custom(spark, sf_dir):
    df = events(spark, sf_dir).coordinate("xyz", norm=(50.0, 25.0)).df.select(SESSION, "_row", "x", "y")
    return rounded(df, x=6, y=6)


@query(
    "rotate",
    f"""WITH {E} SELECT session_id, _row, round(x * cos(-atan2(4.0, 3.0)) - y * sin(-atan2(4.0, 3.0)), 5) + 0.0 AS x,
    round(x * sin(-atan2(4.0, 3.0)) + y * cos(-atan2(4.0, 3.0)), 5) + 0.0 AS y FROM e""",
)
def rotate(spark, sf_dir):
    df = events(spark, sf_dir).coordinate("xyz", rotate=((0, 0), (3, 4))).df.select(SESSION, "_row", "x", "y")
    return rounded(df, x=5, y=5)


@query(
    "drop_outliers_iqr",
    f"""WITH {E}, q AS (SELECT *, quantile_cont(x, 0.25) OVER w AS a, quantile_cont(x, 0.75) OVER w AS b,
    quantile_cont(y, 0.25) OVER w AS c, quantile_cont(y, 0.75) OVER w AS d FROM e WINDOW w AS (PARTITION BY session_id)),
    f AS (SELECT *, x < a - 3 * (b - a) OR x > b + 3 * (b - a) OR y < c - 3 * (d - c) OR y > d + 3 * (d - c) AS bad FROM q)
    SELECT session_id, _row, CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y FROM f""",
)
def drop_outliers_iqr(spark, sf_dir):
    return events(spark, sf_dir).coordinate("xyz", drop_outliers=True).df.select(SESSION, "_row", "x", "y")


@query(
    "crs_check",
    f"""WITH {C}, m AS (SELECT session_id, quantile_cont(lat, 0.5) AS la, quantile_cont(lng, 0.5) AS lo FROM p GROUP BY session_id),
    s AS (SELECT session_id, round(100 * (1 / cos(radians(abs(la))) - 1), 1) AS percent,
          CAST(CASE WHEN la >= 0 THEN 32600 ELSE 32700 END + floor((lo + 180) / 6) + 1 AS INT) AS epsg FROM m)
    SELECT session_id, percent, epsg, percent >= 0.5 AS warned FROM s""",
)
def crs_check(spark, sf_dir):
    checked = gps(spark, sf_dir).coordinate().quality("crs")
    return checked.select(SESSION, "percent", "epsg", F.col("warning").isNotNull().alias("warned"))


# Resampling ----------------------------------------------------------------------

L = """l AS (SELECT l_suppkey AS session_id, CAST(round_even(epoch(l_shipdate) * (1.0::DOUBLE / 3600.0::DOUBLE), 0) AS BIGINT) AS k,
    l_quantity AS x, l_discount AS y, l_orderkey * 100 + l_linenumber AS _row FROM lineitem)"""


@query(
    "snap_dedup",
    f"WITH {L} SELECT session_id, k, x, y, _row FROM l QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY _row) = 1",
)
def snap_dedup(spark, sf_dir):
    df = resample.snapped(lineitems(spark, sf_dir).df, KEYS, HZ)
    return df.select(SESSION, F.col(resample.FRAME).alias("k"), "x", "y", "_row")


@query("grid_expand", f"WITH {GRID} SELECT session_id, k, x0 AS x, is_new FROM r")
def grid_expand(spark, sf_dir):
    df = resample.on_grid(resample.snapped(events(spark, sf_dir).df, KEYS, HZ), KEYS)
    return df.select(SESSION, F.col(resample.FRAME).alias("k"), "x", F.col("__new").alias("is_new"))


def frame() -> Column:
    return F.rint(F.col(TIME) * HZ).cast("long").alias("k")


@query("interp_linear", f"WITH {GRID} SELECT session_id, k, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM i")
def interp_linear(spark, sf_dir):
    return rounded(gridded(spark, sf_dir).df.select(SESSION, frame(), "x", "y"), x=6, y=6)


@query(
    "interp_constant",
    f"""WITH {GRID}, z AS (SELECT *, max(k) OVER (PARTITION BY session_id) + 1 AS kz FROM n)
    SELECT session_id, k, CASE WHEN coalesce(kb, kz) - ka - 1 <= 5 OR NOT is_new THEN xa END AS x FROM z""",
)
def interp_constant(spark, sf_dir):
    return gridded(spark, sf_dir, "constant").df.select(SESSION, frame(), "x")


@query(
    "interp_passthrough",
    f"""WITH {GRID} SELECT session_id, k, last_value(event_type IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type FROM i""",
)
def interp_passthrough(spark, sf_dir):
    return gridded(spark, sf_dir, passthrough="constant").df.select(SESSION, frame(), "event_type")


# The cubic through all points of a session: its system of three diagonals (low, mid, up; b) for the s of each
# point, eliminated downwards (f) and solved upwards (g); d are the slopes between points, t the third differences.
SPLINE = f"""{GRID},
    pt AS (SELECT session_id, 'x' AS c, k, x0 AS v FROM r WHERE NOT is_new AND x0 IS NOT NULL
           UNION ALL SELECT session_id, 'y', k, y0 FROM r WHERE NOT is_new AND y0 IS NOT NULL),
    po AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session_id, c) AS m, lead(k) OVER w - k AS h,
           (lead(v) OVER w - v) / (lead(k) OVER w - k) AS d FROM pt WINDOW w AS (PARTITION BY session_id, c ORDER BY k)),
    th AS (SELECT *, ((lead(d, 2) OVER w - lead(d, 1) OVER w) / (lead(k, 3) OVER w - lead(k, 1) OVER w)
                    - (lead(d, 1) OVER w - d) / (lead(k, 2) OVER w - k)) / (lead(k, 3) OVER w - k) AS t FROM po WINDOW w AS (PARTITION BY session_id, c ORDER BY k)),
    sy AS (SELECT session_id, c, i, m, k, v, h, d, lag(h) OVER w AS low,
           CASE WHEN i = 1 THEN -h WHEN i = m THEN -lag(h) OVER w ELSE 2 * (lag(h) OVER w + h) END AS mid,
           CASE WHEN i = 1 THEN h * h * t WHEN i = m THEN -(lag(h) OVER w) * (lag(h) OVER w) * lag(t, 3) OVER w ELSE d - lag(d) OVER w END AS b
           FROM th WHERE m >= 4 WINDOW w AS (PARTITION BY session_id, c ORDER BY k)),
    f AS (SELECT session_id, c, i, CAST(mid AS DOUBLE) AS mid, CAST(b AS DOUBLE) AS b, h FROM sy WHERE i = 1
          UNION ALL SELECT y.session_id, y.c, y.i, y.mid - y.low / f.mid * f.h, y.b - y.low / f.mid * f.b, y.h
          FROM f JOIN sy y ON y.session_id = f.session_id AND y.c = f.c AND y.i = f.i + 1),
    g AS (SELECT f.session_id, f.c, f.i, f.b / f.mid AS s, NULL::DOUBLE AS sn FROM f JOIN sy USING (session_id, c, i) WHERE sy.i = sy.m
          UNION ALL SELECT f.session_id, f.c, f.i, (f.b - f.h * g.s) / f.mid, g.s
          FROM g JOIN f ON f.session_id = g.session_id AND f.c = g.c AND f.i = g.i - 1),
    pc AS (SELECT sy.*, g.s, g.sn FROM sy JOIN g USING (session_id, c, i)),
    ev AS (SELECT n.session_id, n.k, n.is_new, n.x0, n.y0, pc.c, pc.v + (n.k - pc.k) * (pc.d - pc.h * (pc.sn + 2 * pc.s)
           + (n.k - pc.k) * (3 * pc.s + (n.k - pc.k) * (pc.sn - pc.s) / pc.h)) AS v
           FROM n LEFT JOIN pc ON n.is_new AND n.kb - n.ka - 1 <= 5 AND pc.session_id = n.session_id AND pc.k = n.ka)"""


@query(
    "interp_spline",
    f"""WITH RECURSIVE {SPLINE} SELECT session_id, k, round(CASE WHEN NOT bool_or(is_new) THEN max(x0) ELSE max(v) FILTER (WHERE c = 'x') END, 4) + 0.0 AS x,
    round(CASE WHEN NOT bool_or(is_new) THEN max(y0) ELSE max(v) FILTER (WHERE c = 'y') END, 4) + 0.0 AS y FROM ev GROUP BY session_id, k""",
)
def interp_spline(spark, sf_dir):
    return rounded(gridded(spark, sf_dir, "spline").df.select(SESSION, frame(), "x", "y"), x=4, y=4)


@query("is_interpolated", f"WITH {GRID} SELECT session_id, k, is_new AND x IS NOT NULL AND y IS NOT NULL AS is_interpolated FROM i")
def is_interpolated(spark, sf_dir):
    return gridded(spark, sf_dir).df.select(SESSION, frame(), "is_interpolated")


@query(
    "gap_stats",
    f"""WITH {GRID}, j AS (SELECT session_id, kb - ka - 1 AS n FROM n WHERE is_new GROUP BY session_id, ka, kb)
    SELECT session_id, count(*) AS n_gaps, CAST(sum(n) AS BIGINT) AS total_frames, min(n) AS shortest, max(n) AS longest,
    round(avg(n), 6) AS mean_frames, quantile_cont(n, 0.5) AS median_frames, count(*) FILTER (WHERE n > 5) AS n_exceeding
    FROM j GROUP BY session_id""",
)
def gap_stats(spark, sf_dir):
    df = resample.gap_runs(events(spark, sf_dir).df, KEYS, HZ, 5)
    return rounded(df, mean_frames=6)


# Filters ------------------------------------------------------------------------


def _sma_sql(n: int) -> str:
    a, b = n - 1 - n // 2, n // 2
    return f"""WITH {E} SELECT session_id, _row, CASE WHEN count(x) OVER f = {n} THEN round(avg(x) OVER f, 6) END AS f_x FROM e
    WINDOW f AS (PARTITION BY session_id ORDER BY unix_time, _row ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"""


def _filtered(spark, sf_dir, method, **options) -> DataFrame:
    trace = events(spark, sf_dir).filtrate(method, target="x", **options)
    return rounded(trace.df.select(SESSION, "_row", "f_x"), f_x=6)


@query("sma_odd", _sma_sql(5))
def sma_odd(spark, sf_dir):
    return _filtered(spark, sf_dir, "sma", window=5)


@query("sma_even", _sma_sql(4))
def sma_even(spark, sf_dir):
    return _filtered(spark, sf_dir, "moving_average", window=4)


# 35 times the published weights of a quadratic over five points, by the point smoothed.
SAVGOL_35 = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3), (-5, 6, 12, 13, 9), (3, -5, -3, 9, 31))


def _savgol_sql() -> str:
    w = SAVGOL_35

    def mix(row, values) -> str:
        return " + ".join(f"({q} / 35.0::DOUBLE) * {v}" for q, v in zip(row, values))

    inner = mix(w[2], ["lag(x, 2) OVER o", "lag(x, 1) OVER o", "x", "lead(x, 1) OVER o", "lead(x, 2) OVER o"])
    head = [f"nth_value(x, {i}) OVER a" for i in range(1, 6)]
    tail = [f"nth_value(x, {i}) OVER z" for i in range(5, 0, -1)]
    return f"""WITH {E}, c AS (SELECT session_id, _row, x, row_number() OVER o AS i, count(*) OVER (PARTITION BY session_id) AS n,
    {inner} AS m, {mix(w[0], head)} AS h0, {mix(w[1], head)} AS h1, {mix(w[3], tail)} AS t1, {mix(w[4], tail)} AS t0 FROM e
    WINDOW o AS (PARTITION BY session_id ORDER BY unix_time, _row),
    a AS (PARTITION BY session_id ORDER BY unix_time, _row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
    z AS (PARTITION BY session_id ORDER BY unix_time DESC, _row DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT session_id, _row, round(CASE WHEN n < 5 THEN NULL WHEN i = 1 THEN h0 WHEN i = 2 THEN h1 WHEN i = n - 1 THEN t1
    WHEN i = n THEN t0 ELSE m END, 6) + 0.0 AS f_x FROM c"""


@query("savgol", _savgol_sql())
def savgol(spark, sf_dir):
    return _filtered(spark, sf_dir, "savgol", window=5, poly_order=2)


@query(
    "ema",
    f"""WITH RECURSIVE {E}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY unix_time, _row) AS i FROM e),
    r AS (SELECT session_id, i, _row, x AS v FROM o WHERE i = 1
          UNION ALL SELECT o.session_id, o.i, o._row, 0.3 * o.x + 0.7 * r.v FROM r JOIN o ON o.session_id = r.session_id AND o.i = r.i + 1)
    SELECT session_id, _row, CASE WHEN max(i) OVER (PARTITION BY session_id) >= 4 THEN round(v, 6) END AS f_x FROM r""",
)
def ema(spark, sf_dir):
    return _filtered(spark, sf_dir, "ema", alpha=0.3)


@query(
    "clamp_non_negative",
    f"""WITH {E} SELECT session_id, _row, CASE WHEN count(x) OVER f = 3 THEN round(greatest(avg(x - 50) OVER f, 0), 6) END AS f_velocity FROM e
    WINDOW f AS (PARTITION BY session_id ORDER BY unix_time, _row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def clamp_non_negative(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(velocity=F.col("x") - 50).filtrate("sma", "velocity", window=3)
    return rounded(trace.df.select(SESSION, "_row", "f_velocity"), f_velocity=6)


def _twice(cuts: str) -> str:
    """Each session's x through a second-order Butterworth low pass and back, for each cutoff c of ``cuts``.

    ``cuts`` has session_id, c and the session's rate (both in Hz). The textbook
    biquad, run from rest as a recursion over six zeros beyond the end.
    """
    step = """SELECT p.session_id, p.i, l.c, l.b * p.x + 2 * l.b * l.x1 + l.b * l.x2 - l.a1 * l.v - l.a2 * l.v1 AS v,
        l.v AS v1, p.x AS x1, l.x1 AS x2, l.b, l.a1, l.a2"""
    return f"""{E}, o AS (SELECT session_id, _row, x, row_number() OVER (PARTITION BY session_id ORDER BY unix_time, _row) AS i,
        count(*) OVER (PARTITION BY session_id) AS n FROM e WHERE x IS NOT NULL),
    p AS (SELECT session_id, i, x FROM o UNION ALL SELECT session_id, n + j, 0.0 FROM o, range(1, 7) AS q(j) WHERE i = n),
    k AS (SELECT session_id, c, tan(pi() * c / rate) AS k FROM ({cuts})),
    h AS (SELECT session_id, c, k * k / (1 + sqrt(2) * k + k * k) AS b, 2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1,
          (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM k),
    f AS (SELECT session_id, i, c, b * x AS v, 0.0::DOUBLE AS v1, x AS x1, 0.0::DOUBLE AS x2, b, a1, a2 FROM p JOIN h USING (session_id) WHERE i = 1
          UNION ALL {step} FROM f AS l JOIN p ON p.session_id = l.session_id AND p.i = l.i + 1),
    r AS (SELECT session_id, c, v AS x, max(i) OVER (PARTITION BY session_id, c) + 1 - i AS i FROM f),
    g AS (SELECT session_id, i, c, b * x AS v, 0.0::DOUBLE AS v1, x AS x1, 0.0::DOUBLE AS x2, b, a1, a2 FROM r JOIN h USING (session_id, c) WHERE i = 1
          UNION ALL {step} FROM g AS l JOIN r AS p ON p.session_id = l.session_id AND p.c = l.c AND p.i = l.i + 1),
    s AS (SELECT o.session_id, o._row, o.x, o.n, g.c, g.v FROM o JOIN g ON g.session_id = o.session_id AND g.i = o.n + 7 - o.i)"""


def _sweep_sql(rate: str) -> str:
    """Residuals of the 50 default cutoffs, for a rate in Hz of each session."""
    cuts = f"""SELECT session_id, 0.1::DOUBLE + (0.95::DOUBLE * rate / 2 - 0.1::DOUBLE) * j / 49 AS c, rate
        FROM (SELECT DISTINCT session_id, {rate} AS rate FROM e), range(50) AS q(j)"""
    return f"""{_twice(cuts)}, m AS (SELECT session_id, c AS cutoff, sqrt(avg((x - v) * (x - v))) AS residual FROM s GROUP BY session_id, c)"""


SWEEP = _sweep_sql("10.0::DOUBLE")


@query(
    "butterworth",
    f"""WITH RECURSIVE {_twice("SELECT DISTINCT session_id, 1.0::DOUBLE AS c, 10.0::DOUBLE AS rate FROM e")}
    SELECT e.session_id, e._row, CASE WHEN n >= 4 THEN round(v, 6) + 0.0 END AS f_x FROM e LEFT JOIN s USING (session_id, _row)""",
)
def butterworth(spark, sf_dir):
    return _filtered(spark, sf_dir, "butterworth", cutoff=1, n=2)


@query("residual_sweep", f"WITH RECURSIVE {SWEEP} SELECT session_id, 'x' AS signal, cutoff, round(residual, 6) AS residual FROM m")
def residual_sweep(spark, sf_dir):
    curves, _, _ = events(spark, sf_dir).filtrate_cutoff("x")
    return rounded(curves, residual=6)


OWN_RATE = "CASE session_id % 4 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END"


def own_rate() -> Column:
    k = F.col(SESSION) % 4
    return F.when(k == 0, 2.0).when(k == 1, 5.0).when(k == 2, 10.0).otherwise(20.0)


@query(
    "rate_cutoff",
    f"""WITH RECURSIVE {_sweep_sql(OWN_RATE)} SELECT session_id, 'x' AS signal, round(cutoff, 9) AS cutoff, round(residual, 6) AS residual FROM m""",
)
def rate_cutoff(spark, sf_dir):
    """Sessions of 2, 5, 10 and 20 frames a second, each up to 0.95 of its own Nyquist rate."""
    curves, _, _ = events(spark, sf_dir).transform(lambda d: d.withColumn("_hz", own_rate())).filtrate_cutoff("x")
    return rounded(curves, cutoff=9, residual=6)


# The Fourier sum of each frequency, term by term.
PSD = f"""{E}, o AS (SELECT session_id, x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n
        FROM e WHERE x IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY unix_time, _row)),
    l AS (SELECT *, x - regr_intercept(x, i) OVER w - i * regr_slope(x, i) OVER w AS v, floor(n * 0.1::DOUBLE) AS m FROM o
          WHERE n >= 4 WINDOW w AS (PARTITION BY session_id)),
    t AS (SELECT *, CASE WHEN least(i, n - 1 - i) < m THEN 0.5 * (1 - cos(pi() * (2 * least(i, n - 1 - i) + 1) / (2 * m))) ELSE 1 END AS u FROM l),
    smooth AS (SELECT 2 ** a * 3 ** b * 5 ** c AS q FROM range(21) AS a(a), range(13) AS b(b), range(9) AS c(c)),
    size AS (SELECT n, (SELECT min(q) FROM smooth WHERE q >= n) AS long FROM (SELECT DISTINCT n FROM t)),
    f AS (SELECT session_id, n, CAST(long AS BIGINT) AS long, list(v * u ORDER BY i) AS z, avg(u * u) AS kept FROM t JOIN size USING (n) GROUP BY ALL),
    k AS (SELECT *, unnest(range(1, long // 2 + 1)) AS k FROM f),
    d AS (SELECT session_id, n, long, kept, k, list_sum(list_transform(z, lambda y, i: y * cos(2 * pi() * k * (i - 1) / long))) AS re,
          list_sum(list_transform(z, lambda y, i: y * sin(2 * pi() * k * (i - 1) / long))) AS im FROM k)"""


@query(
    "psd",
    f"""WITH {PSD} SELECT session_id, 'x' AS signal, k * 10.0::DOUBLE / long AS freq,
    round((re * re + im * im) / (n * 10) / kept, 6) AS power FROM d""",
)
def psd(spark, sf_dir):
    return rounded(filters.psd(events(spark, sf_dir).df, KEYS, ["x"], 10.0), power=6)


# Second derivatives g of the smoothing spline with all 50 cutoffs as knots: a symmetric system of five
# diagonals (a, b, c), solved by its LDL factors. The traces are those of the inner B-splines on equal steps h.
ELBOW = f"""{SWEEP},
    n AS (SELECT *, row_number() OVER w - 1 AS i, (lead(residual) OVER w - 2 * residual + lag(residual) OVER w) * 49 AS bend FROM m
          WINDOW w AS (PARTITION BY session_id ORDER BY cutoff)),
    lam AS (SELECT 1 / 49::DOUBLE AS h, (53 / 144::DOUBLE + 46 * 0.5::DOUBLE) / ((4.5::DOUBLE + 46 * 8 / 3::DOUBLE) * 49 ** 3) * 256 ** 0.8::DOUBLE AS l),
    co AS (SELECT 2 * h / 3 + 6 * l / h ** 2 AS a, h / 6 - 4 * l / h ** 2 AS b, l / h ** 2 AS c FROM lam),
    fac AS (SELECT 1 AS i, a AS d, b / a AS e, c / a AS f, 0::DOUBLE AS dp, 0::DOUBLE AS fp, a, b, c FROM co
            UNION ALL SELECT i + 1, a - d * e * e - dp * fp * fp, (b - d * e * f) / (a - d * e * e - dp * fp * fp),
                      c / (a - d * e * e - dp * fp * fp), d, f, a, b, c FROM fac WHERE i < 48),
    z AS (SELECT session_id, 1 AS i, bend AS z, 0::DOUBLE AS zp FROM n WHERE i = 1
          UNION ALL SELECT z.session_id, z.i + 1, n.bend - fac.e * z.z - fac.fp * z.zp, z.z
          FROM z JOIN n ON n.session_id = z.session_id AND n.i = z.i + 1 JOIN fac ON fac.i = z.i WHERE z.i < 48),
    gamma AS (SELECT session_id, i, z / d AS g, 0::DOUBLE AS gn FROM z JOIN fac USING (i) WHERE i = 48
          UNION ALL SELECT g.session_id, g.i - 1, z.z / fac.d - fac.e * g.g - fac.f * g.gn, g.g
          FROM gamma AS g JOIN z ON z.session_id = g.session_id AND z.i = g.i - 1 JOIN fac ON fac.i = g.i - 1)"""


@query(
    "cutoff_elbow",
    f"""WITH RECURSIVE {ELBOW}
    SELECT session_id, 'x' AS signal, arg_max(cutoff, abs(gamma.g)) AS cutoff FROM gamma JOIN n USING (session_id, i) GROUP BY session_id""",
)
def cutoff_elbow(spark, sf_dir):
    _, _, suggested = events(spark, sf_dir).filtrate_cutoff("x")
    return suggested


# Kinematics -----------------------------------------------------------------------


def _moved(spark, sf_dir, digits: dict[str, int], **options) -> DataFrame:
    df = moving(spark, sf_dir, **options).df.select(SESSION, frame(), *digits)
    return rounded(df, **digits)


def _derived_sql(columns: str, rows: int = 1) -> str:
    return f"WITH {derived(rows)} SELECT session_id, k, {columns} FROM d"


@query("velocity_distance", _derived_sql("round(distance, 6) AS distance, round(velocity, 9) AS velocity"))
def velocity_distance(spark, sf_dir):
    return _moved(spark, sf_dir, {"distance": 6, "velocity": 9})


@query("velocity_wide", _derived_sql("round(distance, 6) AS distance, round(velocity, 9) AS velocity", 3))
def velocity_wide(spark, sf_dir):
    return _moved(spark, sf_dir, {"distance": 6, "velocity": 9}, window=3)


@query("heading", _derived_sql("round(heading, 5) + 0.0 AS heading"))
def heading(spark, sf_dir):
    return _moved(spark, sf_dir, {"heading": 5})


@query("angular_velocity_unsigned", _derived_sql("round(abs(omega), 7) AS angular_velocity"))
def angular_velocity_unsigned(spark, sf_dir):
    return _moved(spark, sf_dir, {"angular_velocity": 7})


@query("angular_velocity_signed", _derived_sql("round(omega, 7) + 0.0 AS angular_velocity"))
def angular_velocity_signed(spark, sf_dir):
    return _moved(spark, sf_dir, {"angular_velocity": 7}, signed_omega=True)


@query("acceleration", _derived_sql("round(acceleration * 1e6, 6) + 0.0 AS acceleration"))
def acceleration(spark, sf_dir):
    df = moving(spark, sf_dir).df.select(SESSION, frame(), (F.col("acceleration") * 1e6).alias("acceleration"))
    return rounded(df, acceleration=6)


@query("jerk", _derived_sql("round(jerk * 1e9, 5) + 0.0 AS jerk"))
def jerk(spark, sf_dir):
    df = moving(spark, sf_dir, derivatives=["jerk"]).df.select(SESSION, frame(), (F.col("jerk") * 1e9).alias("jerk"))
    return rounded(df, jerk=5)


@query(
    "lateral_g",
    _derived_sql("round(1e6 * CASE WHEN velocity >= 0.0005 THEN velocity * omega * (pi() / 180.0) / 9.80665 ELSE 0 END, 5) + 0.0 AS lateral_g"),
)
def lateral_g(spark, sf_dir):
    trace = moving(spark, sf_dir, signed_omega=True, derivatives=["lateral_g"])
    return rounded(trace.df.select(SESSION, frame(), (F.col("lateral_g") * 1e6).alias("lateral_g")), lateral_g=5)


# Labels ------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ranges of days of the events, in the order of their rows."""
    start = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts").alias("t"))
    t0 = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / F.lit(1e6)).cast("double")
    return start.select(t0.alias("t0"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select(
        F.concat(F.lit("phase_"), F.col("i").cast("string")).alias("designation"),
        (F.col("t0") + F.col("i") * 172800).alias("unix_start"),
        (F.col("t0") + F.col("i") * 172800 + F.when(F.col("i") % 3 == 0, 200000).otherwise(120000)).alias("unix_end"),
        F.col("i").alias("_row"),
    )


LAB = f"""{E}, t AS (SELECT floor(epoch(min(ts))) AS t0 FROM events),
    b AS (SELECT 'phase_' || i AS designation, t0 + i * 172800 AS a, t0 + i * 172800 + CASE WHEN i % 3 = 0 THEN 200000 ELSE 120000 END AS z, i
          FROM t, range(12) AS q(i)),
    w AS (SELECT e.*, (SELECT arg_max(designation, i) FROM b WHERE e.unix_time BETWEEN a AND z) AS designation FROM e)"""


@query("designate_manual", f"WITH {LAB} SELECT session_id, _row, designation FROM w")
def designate_manual(spark, sf_dir):
    return events(spark, sf_dir).designate(labels=_labels(spark, sf_dir)).df.select(SESSION, "_row", "designation")


@query("designate_overlap_last_wins", f"WITH {LAB} SELECT designation, count(*) AS n FROM w GROUP BY designation")
def designate_overlap_last_wins(spark, sf_dir):
    labels = _labels(spark, sf_dir).toDF("label", "start_time", "end_time", "_row")
    trace = events(spark, sf_dir).designate(labels=labels, cols="guess")
    return trace.df.groupBy("designation").agg(F.count("*").alias("n"))


@query(
    "export_designations",
    f"""WITH {LAB}, c AS (SELECT *, CASE WHEN designation IS NOT DISTINCT FROM lag(designation) OVER o
        AND row_number() OVER o > 1 THEN 0 ELSE 1 END AS chg FROM w WINDOW o AS (PARTITION BY session_id ORDER BY unix_time, _row)),
    r AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY unix_time, _row) AS run FROM c)
    SELECT session_id, designation, round(min(unix_time), 3) AS unix_start, round(max(unix_time), 3) AS unix_end
    FROM r GROUP BY session_id, run, designation""",
)
def export_designations(spark, sf_dir):
    runs = events(spark, sf_dir).designate(labels=_labels(spark, sf_dir)).export_designations()
    return rounded(runs, unix_start=3, unix_end=3)


REF = f"""{E}, v AS (SELECT session_id, _row, unix_time, x AS velocity, CAST(floor(unix_time / 86400) AS BIGINT) AS blk FROM e),
    m AS (SELECT *, avg(velocity) OVER (PARTITION BY session_id, blk) < 50 AS down FROM v),
    c AS (SELECT *, CASE WHEN down IS NOT DISTINCT FROM lag(down) OVER o THEN 0 ELSE 1 END AS chg FROM m
          WINDOW o AS (PARTITION BY session_id ORDER BY unix_time, _row)),
    r AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY unix_time, _row) AS run FROM c),
    s AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS n FROM r),
    k AS (SELECT *, coalesce(last_value(CASE WHEN n >= 4 THEN run END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY unix_time, _row
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS kept FROM s),
    j AS (SELECT *, CASE WHEN avg(velocity) OVER (PARTITION BY session_id, kept) < 50 THEN 'relief' ELSE 'active' END AS kind,
          count(*) OVER (PARTITION BY session_id) AS total FROM k)"""


@query(
    "segment_refine",
    f"""WITH {REF} SELECT session_id, _row, CASE WHEN total < 2 THEN 'active_1'
    ELSE kind || '_' || dense_rank() OVER (PARTITION BY session_id, kind ORDER BY kept) END AS designation FROM j""",
)
def segment_refine(spark, sf_dir):
    df = events(spark, sf_dir).df.withColumn("velocity", F.col("x"))
    df = df.withColumn("__block", F.floor(F.col(TIME) / 86400).cast("long"))
    return segment.refine(df, KEYS, 50.0, 4).select(SESSION, "_row", "designation")


# Optimal partitioning without any pruning: for each row the least cost of a last segment, over all its starts.
# Lists of a session's sums s and squares q (from 0 on) are carried with the costs (best) and starts (came) so far.
PELT = f"""{E}, v AS (SELECT session_id, _row, unix_time, x AS velocity, row_number() OVER w AS i, avg(x) OVER (PARTITION BY session_id) AS mu FROM e
          WINDOW w AS (PARTITION BY session_id ORDER BY unix_time, _row)),
    su AS (SELECT *, sum(velocity - mu) OVER w AS s, sum((velocity - mu) ** 2) OVER w AS q FROM v WINDOW w AS (PARTITION BY session_id ORDER BY i)),
    li AS (SELECT session_id, count(*) AS n, list_concat([0.0::DOUBLE], list(s ORDER BY i)) AS s, list_concat([0.0::DOUBLE], list(q ORDER BY i)) AS q FROM su GROUP BY session_id),
    dp AS (SELECT session_id, 0 AS t, [-2 * ln(n)] AS best, [0::BIGINT] AS came FROM li
           UNION ALL SELECT session_id, t + 1, list_append(best, list_min(total) + 2 * ln(n)), list_append(came, list_position(total, list_min(total)) - 1)
           FROM (SELECT d.session_id, d.t, d.best, d.came, l.n, list_transform(range(0, d.t + 1),
                 lambda k: d.best[k + 1] + (l.q[d.t + 2] - l.q[k + 1]) - (l.s[d.t + 2] - l.s[k + 1]) ** 2 / (d.t + 1 - k)) AS total
                 FROM dp d JOIN li l ON l.session_id = d.session_id WHERE d.t < l.n)),
    bt AS (SELECT session_id, came, came[n + 1] AS t FROM dp JOIN li USING (session_id) WHERE t = n
           UNION ALL SELECT session_id, came, came[t + 1] FROM bt WHERE t > 0),
    bl AS (SELECT v.*, (SELECT count(*) FROM bt WHERE bt.session_id = v.session_id AND bt.t > 0 AND bt.t <= v.i) AS blk FROM v)"""


@query(
    "designate_pelt",
    f"""WITH RECURSIVE {PELT}, {REF[REF.index("m AS (SELECT"):].replace("FROM v)", "FROM bl)").replace("n >= 4 THEN", "n >= 5 THEN")}
    SELECT session_id, _row, CASE WHEN total < 2 THEN 'active_1'
    ELSE kind || '_' || dense_rank() OVER (PARTITION BY session_id, kind ORDER BY kept) END AS designation FROM j""",
)
def designate_pelt(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(velocity=F.col("x")).designate(v_threshold=50, min_pts=5)
    return trace.df.select(SESSION, "_row", "designation")


# Expressions ---------------------------------------------------------------------------


@query(
    "elaborate_seq",
    f"WITH {E} SELECT session_id, _row, x * 2 AS a, x * 2 + y AS b, CASE WHEN x > 50 THEN 'high' ELSE 'low' END AS level, least(x, y) AS lo, greatest(x, y) AS hi FROM e",
)
def elaborate_seq(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(
        a=F.col("x") * 2,
        b="a + y",
        level="case when x > 50 then 'high' else 'low' end",
        lo=pmin("x", "y"),
        hi=pmax("x", "y"),
    )
    return trace.df.select(SESSION, "_row", "a", "b", "level", "lo", "hi")


@query(
    "elaborate_grouped",
    f"""WITH {E} SELECT session_id, _row, round(avg(x) OVER w, 6) AS mean_x, max(x) OVER w AS peak, count(*) OVER w AS n
    FROM e WINDOW w AS (PARTITION BY session_id, event_type)""",
)
def elaborate_grouped(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(
        by=["event_type"], mean_x=F.avg("x"), peak=F.max("x"), n=F.count("*")
    )
    return rounded(trace.df.select(SESSION, "_row", "mean_x", "peak", "n"), mean_x=6)


@query(
    "rolling_mean",
    f"""WITH {E} SELECT session_id, _row, CASE WHEN count(x) OVER f = 7 THEN round(avg(x) OVER f, 6) END AS roll FROM e
    WINDOW f AS (PARTITION BY session_id ORDER BY unix_time, _row ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def rolling_mean(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(roll=rolling(F.col("x"), in_order(KEYS), 3, 3))
    return rounded(trace.df.select(SESSION, "_row", "roll"), roll=6)


# Rates by session: times in units of 25,000, 12,500 or 8,333 seconds, so that the rates are about 1, 2 and 3.
def _rates_sql(view: str, given: str = "NULL") -> str:
    """The chain of grid, fill and derivatives of a view whose sessions have their own rates, or those of ``given``."""
    return f"""{E}, v AS ({view}),
    st AS (SELECT *, unix_time - lag(unix_time) OVER (PARTITION BY session_id ORDER BY _row) AS step FROM v),
    hz AS (SELECT session_id, coalesce({given}, round(1 / quantile_cont(CASE WHEN step > 0 THEN step END, 0.5), 2), 1) AS hz FROM st GROUP BY session_id),
    sn AS (SELECT v.*, hz, CAST(round_even(unix_time * hz, 0) AS BIGINT) AS k FROM v JOIN hz USING (session_id)),
    u AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY _row) = 1),
    b AS (SELECT session_id, hz, unnest(generate_series(min(k), max(k))) AS k FROM u GROUP BY session_id, hz),
    r AS (SELECT b.session_id, b.hz, b.k, b.k / b.hz AS unix_time, u.x, u.y, u._row IS NULL AS is_new
          FROM b LEFT JOIN u ON u.session_id = b.session_id AND u.k = b.k),
    n AS (SELECT *, last_value(CASE WHEN NOT is_new THEN {{'k': k, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
          first_value(CASE WHEN NOT is_new THEN {{'k': k, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY k
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM r),
    i AS (SELECT session_id, hz, greatest(CAST(floor(hz) AS BIGINT), 1) AS w, k, unix_time,
          CASE WHEN NOT is_new THEN x WHEN z.k - a.k - 1 <= 5 THEN a.x + (z.x - a.x) * (k - a.k) / (z.k - a.k) END AS x,
          CASE WHEN NOT is_new THEN y WHEN z.k - a.k - 1 <= 5 THEN a.y + (z.y - a.y) * (k - a.k) / (z.k - a.k) END AS y FROM n),
    j AS (SELECT *, (x IS NULL OR y IS NULL)::INT AS gap, sum((x IS NULL OR y IS NULL)::INT) OVER (PARTITION BY session_id ORDER BY k) AS gaps FROM i),
    d AS (SELECT h.session_id, h.hz, CASE WHEN h.gaps - o.gaps + o.gap = 0 THEN sqrt((h.x - o.x) ** 2 + (h.y - o.y) ** 2) END AS distance,
          h.unix_time - o.unix_time AS dt FROM j h LEFT JOIN j o ON o.session_id = h.session_id AND o.k = h.k - h.w),
    q AS (SELECT session_id, hz, coalesce(distance, 0) AS distance, coalesce(distance / dt, 0) AS velocity FROM d)"""


RATES = _rates_sql("SELECT session_id, _row, x, y, unix_time * (1 + session_id % 3) / 25000.0::DOUBLE AS unix_time FROM e")


@query(
    "rate_default_chain",
    f"""WITH {RATES} SELECT session_id, 'band_' || CAST(1 + (velocity >= 20)::INT + (velocity >= 50)::INT AS VARCHAR) AS allocation_1_velocity_band,
    round(sum(distance), 4) AS total_distance, round(count(*) / max(hz), 6) AS seconds FROM q GROUP BY ALL""",
)
def rate_default_chain(spark, sf_dir):
    whole = 1 + F.col(SESSION) % 3
    trace = events(spark, sf_dir).transform(lambda d: d.withColumn(TIME, F.col(TIME) * whole / F.lit(25000.0))).interpolate()
    trace = trace.derivate(use_filtered=False).allocate({"velocity": (0, 20, 50, 100)})
    return trace.quantitate(
        scope="session", total_distance=F.round(F.sum("distance"), 4), seconds=F.round(trace.band_duration(), 6)
    )


# Sessions of about 2, 5, 10 and 20 frames a second that keep their rates, and the same ones at 5 by request.
STACK = _rates_sql(
    f"""SELECT session_id, _row, x, y, unix_time / (25000 * ({OWN_RATE})) AS unix_time FROM e
        UNION ALL SELECT session_id + 100000, _row, x, y, unix_time / 125000.0::DOUBLE FROM e""",
    "CASE WHEN session_id >= 100000 THEN 5.0::DOUBLE END",
)


@query(
    "rate_stack_chain",
    f"""WITH {STACK} SELECT session_id, 'band_' || CAST(1 + (velocity >= 20)::INT + (velocity >= 50)::INT AS VARCHAR) AS allocation_1_velocity_band,
    round(sum(distance), 4) AS total_distance, round(count(*) / max(hz), 6) AS seconds FROM q GROUP BY ALL""",
)
def rate_stack_chain(spark, sf_dir):
    own = events(spark, sf_dir).transform(lambda d: d.withColumn(TIME, F.col(TIME) / (25000 * own_rate()))).interpolate()
    five = events(spark, sf_dir).transform(
        lambda d: d.withColumns({SESSION: F.col(SESSION) + 100000, TIME: F.col(TIME) / F.lit(125000.0)})
    )
    trace = own.stack(five.interpolate(hz=5.0)).derivate(use_filtered=False).allocate({"velocity": (0, 20, 50, 100)})
    return trace.quantitate(
        scope="session", total_distance=F.round(F.sum("distance"), 4), seconds=F.round(trace.band_duration(), 6)
    )


# Quality ---------------------------------------------------------------------------------


@query(
    "quality_interpolate",
    f"""WITH {GRID}, c AS (SELECT session_id, count(*) AS n_input FROM e GROUP BY session_id),
    g AS (SELECT *, (x0 IS NULL) AS gap, CASE WHEN (x0 IS NULL) = lag(x0 IS NULL) OVER w THEN 0 ELSE 1 END AS chg FROM i
          WINDOW w AS (PARTITION BY session_id ORDER BY k)),
    u2 AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY k) AS run FROM g),
    v AS (SELECT session_id, run, any_value(gap) AS gap, count(*) AS n FROM u2 GROUP BY session_id, run),
    w AS (SELECT session_id, count(*) FILTER (WHERE gap) AS n_gaps, max(n) FILTER (WHERE gap) AS max_gap,
          count(*) FILTER (WHERE gap AND n > 5) AS n_exceeding FROM v GROUP BY session_id),
    s2 AS (SELECT session_id, count(*) AS n_rows, count(*) FILTER (WHERE is_new) AS n_time_gaps,
          count(*) FILTER (WHERE is_new AND x IS NOT NULL AND y IS NOT NULL) AS n_interpolated,
          count(*) FILTER (WHERE x IS NULL) AS na_x, count(*) FILTER (WHERE x0 IS NULL AND x IS NOT NULL) AS filled_x,
          CAST(floor((max(unix_time) - min(unix_time)) * (1.0::DOUBLE / 3600.0::DOUBLE)) AS BIGINT) + 1 AS expected_rows FROM i GROUP BY session_id),
    j AS (SELECT *, n_input - n_rows + n_time_gaps AS n_duplicates, round(100.0::DOUBLE * n_interpolated / n_rows, 2) AS share
          FROM s2 JOIN c USING (session_id) JOIN w USING (session_id))
    SELECT session_id, n_input, n_rows, n_duplicates, n_time_gaps, n_interpolated, filled_x, na_x, n_gaps, max_gap, n_exceeding, expected_rows, share,
           (share > 50)::INT + (n_exceeding > 0)::INT + (na_x > 0)::INT + (n_duplicates > 0)::INT + (abs(n_rows - expected_rows) > 1)::INT
           + (n_time_gaps > 0)::INT AS n_issues FROM j""",
)
def quality_interpolate(spark, sf_dir):
    found = gridded(spark, sf_dir).quality("interpolate")
    names = ("n_input", "n_rows", "n_duplicates", "n_time_gaps", "n_interpolated", "filled_x", "na_x", "n_gaps", "max_gap", "n_exceeding", "expected_rows", "share")
    return found.select(SESSION, *names, F.size("issues").alias("n_issues"))


# Positions far from most: a high power of the values.
FAR = "pow(x / 20, 8)"


@query(
    "quality_coordinate",
    f"""WITH {E}, p AS (SELECT session_id, _row, {FAR} AS x, y FROM e),
    q AS (SELECT *, quantile_cont(x, 0.25) OVER w AS a, quantile_cont(x, 0.75) OVER w AS b, quantile_cont(y, 0.25) OVER w AS c, quantile_cont(y, 0.75) OVER w AS d
          FROM p WINDOW w AS (PARTITION BY session_id)),
    f AS (SELECT *, coalesce(x < a - 3 * (b - a) OR x > b + 3 * (b - a), false) AS ox, coalesce(y < c - 3 * (d - c) OR y > d + 3 * (d - c), false) AS oy FROM q)
    SELECT session_id, count(*) AS n_rows, round(max(x) - min(x), 4) AS x_range, round(max(y) - min(y), 6) AS y_range,
           count(*) FILTER (WHERE ox) AS n_out_x, count(*) FILTER (WHERE oy) AS n_out_y, count(*) FILTER (WHERE ox OR oy) AS n_outlier_rows,
           coalesce(string_agg(CAST(_row AS VARCHAR), ',' ORDER BY _row) FILTER (WHERE ox), '') AS rows_x FROM f GROUP BY session_id""",
)
def quality_coordinate(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(x=FAR).coordinate("xyz")
    found = trace.quality("coordinate").withColumn("rows_x", F.concat_ws(",", F.col("rows_x").cast("array<string>")))
    return rounded(found, x_range=4, y_range=6).select(SESSION, "n_rows", "x_range", "y_range", "n_out_x", "n_out_y", "n_outlier_rows", "rows_x")


@query(
    "quality_derivate",
    f"""WITH {derived()}, v2 AS (SELECT d2.session_id, d2.k, max(x IS NULL OR y IS NULL) OVER w AS gv, max(vel IS NULL) OVER w AS ga FROM d2
          WINDOW w AS ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
    SELECT d.session_id, count(*) AS n_rows, count(acceleration) AS acceleration_valid, count(*) - count(acceleration) AS acceleration_null,
           count(*) - count(heading) AS heading_null, round(max(velocity), 9) AS velocity_max, count(*) FILTER (WHERE gv) AS gap_velocity,
           count(*) FILTER (WHERE ga) AS gap_acceleration, (bool_or(gv))::INT AS n_issues
    FROM d JOIN v2 USING (session_id, k) GROUP BY d.session_id""",
)
def quality_derivate(spark, sf_dir):
    found = moving(spark, sf_dir).quality("derivate").withColumn("n_issues", F.size("issues"))
    names = ("n_rows", "acceleration_valid", "acceleration_null", "heading_null", "velocity_max", "gap_velocity", "gap_acceleration", "n_issues")
    return rounded(found.select(SESSION, *names), velocity_max=9)


@query(
    "quality_filtrate",
    f"""WITH {E}, v AS (SELECT session_id, unix_time, _row, CASE WHEN x >= 30 THEN x - 60 END AS v FROM e),
    f AS (SELECT *, CASE WHEN v IS NOT NULL AND count(v) OVER w = 5 THEN avg(v) OVER w END AS s FROM v
          WINDOW w AS (PARTITION BY session_id, v IS NULL ORDER BY unix_time, _row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT session_id, 'velocity' AS "column", count(*) AS n_rows, count(v) AS n_valid, count(*) FILTER (WHERE v IS NOT NULL AND s IS NULL) AS n_lost,
           count(*) FILTER (WHERE s < 0) AS n_clamped, (count(v) < 4)::INT AS n_issues FROM f GROUP BY session_id""",
)
def quality_filtrate(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(velocity=F.when(F.col("x") >= 30, F.col("x") - 60)).filtrate("sma", "velocity", window=5)
    return trace.quality("filtrate").withColumn("n_issues", F.size("issues")).drop("issues")


@query(
    "quality_designate",
    f"""WITH {E} SELECT session_id, count(*) AS n_rows, count(CASE WHEN x >= 99 THEN x END) AS n_finite, CAST(30 AS BIGINT) AS min_points,
    (count(CASE WHEN x >= 99 THEN x END) = 0)::INT + (count(*) < 60)::INT + (count(CASE WHEN x >= 99 THEN x END) = 0)::INT AS n_issues FROM e GROUP BY session_id""",
)
def quality_designate(spark, sf_dir):
    trace = events(spark, sf_dir).elaborate(velocity=F.when(F.col("x") >= 99, F.col("x"))).designate(v_threshold=50, min_pts=30)
    found = trace.quality("designate").withColumn("n_issues", F.size("issues"))
    return found.select(SESSION, "n_rows", "n_finite", "min_points", "n_issues")


# Bands and summaries -----------------------------------------------------------------------

SPEEDS = {"velocity": (0, 10, 20, 40, 80)}
TURNS = {"velocity": (0, 10, 20, 40, 80), "angular_velocity": (0, 60, 120, 180)}
B = f"""{derived()}, h AS (SELECT session_id, k, distance, velocity * 3600 AS velocity, abs(omega) * 3600 AS angular_velocity FROM d),
    q AS (SELECT *, 'band_' || CAST(1 + (velocity >= 10)::INT + (velocity >= 20)::INT + (velocity >= 40)::INT AS VARCHAR) AS allocation_1_velocity_band,
          'band_' || CAST(1 + (angular_velocity >= 60)::INT + (angular_velocity >= 120)::INT AS VARCHAR) AS allocation_1_angular_velocity_band,
          CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 < 3 THEN 'active_' || (k % 5) ELSE 'relief_1' END AS designation FROM h)"""


def banded(spark, sf_dir) -> Trace:
    trace = moving(spark, sf_dir).elaborate(
        velocity=F.col("velocity") * 3600, angular_velocity=F.col("angular_velocity") * 3600
    )
    part = F.rint(F.col(TIME) * HZ).cast("long") % 5
    label = F.when(part == 0, None).when(part < 3, F.concat(F.lit("active_"), part.cast("string"))).otherwise("relief_1")
    return trace.elaborate(designation=label).allocate(TURNS)


@query("allocate_velocity", f"WITH {B} SELECT session_id, k, allocation_1_velocity_band FROM q")
def allocate_velocity(spark, sf_dir):
    return banded(spark, sf_dir).df.select(SESSION, frame(), "allocation_1_velocity_band")


@query("allocate_abs", f"WITH {B} SELECT session_id, k, allocation_1_angular_velocity_band FROM q")
def allocate_abs(spark, sf_dir):
    trace = moving(spark, sf_dir, signed_omega=True).elaborate(angular_velocity=F.col("angular_velocity") * 3600)
    trace = trace.allocate({"angular_velocity": TURNS["angular_velocity"]})
    return trace.df.select(SESSION, frame(), "allocation_1_angular_velocity_band")


@query(
    "allocate_profiles",
    f"""WITH {B} SELECT session_id, k, 'band_' || CAST(1 + (velocity >= 15)::INT AS VARCHAR) AS walk_velocity_band,
    'band_' || CAST(1 + (velocity >= 5)::INT + (velocity >= 50)::INT AS VARCHAR) AS run_velocity_band FROM q""",
)
def allocate_profiles(spark, sf_dir):
    from trackspark.operators import bands

    inf = float("inf")
    rows = [("walk", 15, inf), ("walk", 0, 15), ("run", 0, 5), ("run", 5, 50), ("run", 50, inf)]
    names = ("profile_name", "target_derivative", "profile_start", "profile_end")
    trace = banded(spark, sf_dir)
    for name, allocation in bands.profiles([dict(zip(names, (n, "velocity", a, z))) for n, a, z in rows]).items():
        trace = trace.allocate(allocation, name)
    return trace.df.select(SESSION, frame(), "walk_velocity_band", "run_velocity_band")


MEASURES = "count(*) AS frames, round(sum(distance), 4) AS total_distance, round(max(velocity), 4) AS peak_velocity"


def measures() -> dict[str, Column]:
    return {
        "frames": F.count("*"),
        "total_distance": F.round(F.sum("distance"), 4),
        "peak_velocity": F.round(F.max("velocity"), 4),
    }


def _summary(keys: str, where: str = "") -> str:
    return f"WITH {B} SELECT {keys}, {MEASURES} FROM q {where} GROUP BY {keys}"


@query("quantitate_designation", _summary("session_id, designation, allocation_1_velocity_band"))
def quantitate_designation(spark, sf_dir):
    return banded(spark, sf_dir).quantitate(**measures())


@query("quantitate_session", _summary("session_id, allocation_1_velocity_band"))
def quantitate_session(spark, sf_dir):
    return banded(spark, sf_dir).quantitate(scope="session", **measures())


@query("quantitate_active", _summary("session_id, allocation_1_velocity_band", "WHERE designation LIKE 'active\\_%' ESCAPE '\\'"))
def quantitate_active(spark, sf_dir):
    return banded(spark, sf_dir).quantitate(scope="active", **measures())


@query(
    "quantitate_active_only",
    _summary("session_id, designation, allocation_1_velocity_band", "WHERE designation LIKE 'active\\_%' ESCAPE '\\'"),
)
def quantitate_active_only(spark, sf_dir):
    return banded(spark, sf_dir).quantitate(active_only=True, **measures())


@query("quantitate_multiband", _summary("session_id, allocation_1_velocity_band, allocation_1_angular_velocity_band"))
def quantitate_multiband(spark, sf_dir):
    return banded(spark, sf_dir).quantitate(
        derivative=["velocity", "angular_velocity"], scope="session", **measures()
    )


@query("quantitate_noband", _summary("session_id, designation"))
def quantitate_noband(spark, sf_dir):
    return banded(spark, sf_dir).quantitate(allocation=None, **measures())


@query(
    "band_duration",
    f"WITH {B} SELECT session_id, allocation_1_velocity_band, round(count(*) * 3600.0, 3) AS seconds FROM q GROUP BY ALL",
)
def band_duration(spark, sf_dir):
    trace = banded(spark, sf_dir)
    return trace.quantitate(scope="session", seconds=F.round(trace.band_duration(), 3))


@query("across_sessions", _summary("allocation_1_velocity_band"))
def across_sessions(spark, sf_dir):
    return banded(spark, sf_dir).quantitate(scope="session", across_sessions=True, **measures())


@query(
    "quantitate_rollup",
    f"""WITH {B} SELECT session_id, designation, allocation_1_velocity_band,
    CASE WHEN grouping(designation) = 0 THEN 'designation' WHEN grouping(session_id) = 0 THEN 'session' ELSE 'all' END AS scope,
    grouping(allocation_1_velocity_band) = 1 AS all_bands, {MEASURES} FROM q GROUP BY GROUPING SETS (
    (session_id, designation, allocation_1_velocity_band), (session_id, designation), (session_id, allocation_1_velocity_band), (session_id),
    (allocation_1_velocity_band), ())""",
)
def quantitate_rollup(spark, sf_dir):
    return banded(spark, sf_dir).quantitate_rollup(**measures())


# Batches ------------------------------------------------------------------------------------


@query(
    "stack_sessions",
    f"""WITH {E}, {L}, a AS (SELECT session_id, x, y, event_type FROM e UNION ALL SELECT session_id, x, y, NULL FROM l)
    SELECT session_id, count(*) AS n, round(sum(x), 4) AS sx, count(event_type) AS typed FROM a GROUP BY session_id""",
)
def stack_sessions(spark, sf_dir):
    df = events(spark, sf_dir).stack(lineitems(spark, sf_dir)).df
    return df.groupBy(SESSION).agg(
        F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.count("event_type").alias("typed")
    )


@query(
    "roster_left_join",
    f"""WITH {E} SELECT e.session_id, c.c_mktsegment AS position, count(*) AS n, max(x) AS peak
    FROM e LEFT JOIN customer c ON c.c_custkey = e.session_id * 2 GROUP BY ALL""",
)
def roster_left_join(spark, sf_dir):
    roster = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("__key"), F.col("c_mktsegment").alias("position")
    )
    by = events(spark, sf_dir).df.groupBy(SESSION).agg(F.count("*").alias("n"), F.max("x").alias("peak"))
    return by.join(roster, F.col(SESSION) * 2 == F.col("__key"), "left").drop("__key")


# Streams: the events in one go, with what the watermark has not passed left out.
DELAY = "2 hours"


@query(
    "stream_running",
    f"""WITH RECURSIVE {E}, m AS (SELECT CAST(floor(max(unix_time) * 1000) AS BIGINT) - 7200000 AS mark FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY unix_time, _row) AS i,
          coalesce(unix_time - lag(unix_time) OVER (PARTITION BY session_id ORDER BY unix_time, _row) > 3600, false) AS gap FROM e),
    r AS (SELECT session_id, i, _row, unix_time, x AS v, gap FROM o WHERE i = 1
          UNION ALL SELECT o.session_id, o.i, o._row, o.unix_time, 0.3 * o.x + 0.7 * r.v, o.gap FROM r JOIN o ON o.session_id = r.session_id AND o.i = r.i + 1)
    SELECT session_id, _row, round(v, 9) AS average, gap FROM r, m WHERE CAST(floor(unix_time * 1000) AS BIGINT) <= mark""",
)
def stream_running(spark, sf_dir):
    """Events as a stream of files, through the running average to a table, read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern: a stream's plain path must be a folder, and the table may be one file.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(
        F.col("user_id").alias(SESSION), epoch(F.col("ts")).alias(TIME), F.col("event_id").alias("_row"), F.col("value").alias("x")
    )
    given = live.running(rows, KEYS, "x", alpha=0.3, gap_seconds=3600, delay=DELAY)
    table, marks = shared_folder(spark, "stream"), shared_folder(spark, "stream-marks")
    given.writeStream.format("parquet").option("path", table).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(given.schema).parquet(table).select(SESSION, "_row", "average", "gap"), average=9)


@query(
    "minimum_slice",
    f"WITH {B} SELECT session_id, allocation_1_velocity_band, {MEASURES} FROM q GROUP BY session_id, allocation_1_velocity_band",
)
def minimum_slice(spark, sf_dir):
    trace = moving(spark, sf_dir).elaborate(velocity=F.col("velocity") * 3600).allocate(SPEEDS)
    return trace.quantitate(scope="session", **measures())


@query(
    "full_pipeline",
    f"""WITH {LAB}, {B.replace(E + ",", "", 1)}, f AS (SELECT q.session_id, q.distance, q.velocity, q.allocation_1_velocity_band,
    (SELECT arg_max(b2.designation, b2.i) FROM (SELECT 'phase_' || i AS designation, t0 + i * 172800 AS a,
      t0 + i * 172800 + CASE WHEN i % 3 = 0 THEN 200000 ELSE 120000 END AS z, i FROM t, range(12) AS q2(i)) b2
      WHERE q.k * 3600.0 BETWEEN b2.a AND b2.z) AS designation FROM q)
    SELECT session_id, designation, allocation_1_velocity_band, {MEASURES} FROM f GROUP BY ALL""".replace("b AS (SELECT 'phase_'", "lb AS (SELECT 'phase_'", 1).replace("FROM b WHERE e.unix_time", "FROM lb WHERE e.unix_time", 1),
)
def full_pipeline(spark, sf_dir):
    trace = (
        events(spark, sf_dir)
        .coordinate("xyz")
        .interpolate("linear", hz=HZ)
        .derivate(window=1, speed_floor=0.0005, use_filtered=False)
        .designate(labels=_labels(spark, sf_dir))
        .elaborate(velocity=F.col("velocity") * 3600)
        .allocate(SPEEDS)
    )
    return trace.quantitate(**measures())
