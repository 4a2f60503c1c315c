"""GPX tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.functions.columns import ROW
from trackspark.functions.times import epoch
from trackspark.sources.textcsv import session_names


def read_gpx(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """session_id (from the file's name), unix_time, lat, lng, altitude, _row by time."""
    points = (
        spark.read.format("xml")
        .option("rowTag", "trkpt")
        .schema("_lat double, _lon double, ele double, time string")
        .load(path if isinstance(path, str) else list(path))
    )
    out = points.select(
        session_names(points).alias("session_id"),
        epoch(F.try_to_timestamp("time")).alias("unix_time"),
        F.col("_lat").alias("lat"),
        F.col("_lon").alias("lng"),
        F.col("ele").alias("altitude"),
    )
    by_time = Window.partitionBy("session_id").orderBy("unix_time", "lat", "lng")
    return out.withColumn(ROW, F.row_number().over(by_time).cast("long"))
