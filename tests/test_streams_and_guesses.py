"""Streams with late rows against the batch, and folders of files of several layouts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trackspark.sources import initiate
from trackspark.sources.textcsv import guess_csv_template
from trackspark.streaming.live import running, seconds

SCHEMA = "session_id string, unix_time double, _row long, x double"


def replayed(spark, folder, parts, schema=SCHEMA, **options):
    """The results of a stream of files, one at a time in the order of ``parts``."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/new")
        file = next(f for f in os.listdir(f"{folder}/new") if f.startswith("part-"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/new/{file}", f"{folder}/in/{i:03}.parquet")
        os.utime(f"{folder}/in/{i:03}.parquet", (1_000_000 + i, 1_000_000 + i))
        os.rename(f"{folder}/new", f"{folder}/gone{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = running(stream, **options)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def batch(rows, alpha, gap):
    out, last = {}, {}
    for s, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        at, average = last.get(s, (None, None))
        if v is not None:
            average = v if average is None else alpha * v + (1 - alpha) * average
        out[s, i] = (t, v, None if v is None else average, at is not None and t - at > gap)
        last[s] = (t, average)
    return out


def test_late_rows_come_in_their_place(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, 1000 + i * 0.5 + (9 if i > 60 else 0), i, None if i % 13 == 4 else rng.random()) for s in "abc" for i in range(120)]
    rows += [("a", 1010.0, 900, 5.0)]  # a repeated time
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 8)  # up to 8 seconds late
    parts = [arrival[i : i + 40] for i in range(0, len(arrival), 40)]
    parts += [[("late", 1000.0, 0, 1.0)], [("z", 5000.0, 1, 0.0)], [("z", 5001.0, 2, 0.0), ("a", 1001.0, 901, 7.0)]]
    found = replayed(spark, str(tmp_path), parts, alpha=0.3, gap_seconds=5.0, delay="10 seconds")
    want = batch(rows, 0.3, 5.0)
    got = {(r["session_id"], r["_row"]): (r["unix_time"], r["value"], r["average"], r["gap"]) for r in found if r["session_id"] in "abc"}
    assert len(found) == len({(r["session_id"], r["_row"]) for r in found})
    assert got == want  # what came too late (of a, of late) is not among them
    assert sum(r[3] for r in want.values()) == 3


def test_running_wants_an_alpha(spark):
    with pytest.raises(ValueError):
        running(spark.readStream.schema(SCHEMA).parquet("/tmp"), alpha=0)
    assert seconds("2 hours") == 7200 and seconds("90 seconds") == 90


FILES = {
    "first.csv": "Device,77\nexported by hand\n\nTimestamp,Latitude,Longitude,Speed,Load,Load\n1700000000,50.5,8.25,1,2,3\n1700000001,50.6,8.35,1,2,3\n1700000002,,8.45,1,2,3\n",
    "second.csv": '"lng","lat","epoch","alt"\n9.5,51.5,1700000100,120\n9.6,51.6,1700000101,121\n',
    "third.csv": "a note, with a comma\nTime,Lat,Lon,Time\n1700000200,52.0,10.0,99\n1700000201,52.1,10.1,99\n1700000202,52.2,10.2,99\nend, of file\n",
    "fourth.csv": "1,2,3\nno more\nunix,latitude,longitude\n1700000300,53.0,11.0,\n1700000301,53.5,11.5,\n1700000302,53.5,11.5,\n",
}


def test_a_folder_of_four_layouts(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    t = initiate(spark, str(tmp_path), source="guess_csv")
    found = {(r["session_id"], r["unix_time"] - 1.7e9): (r["lat"], r["lng"], r["altitude"]) for r in t.df.collect()}
    assert found == {
        ("first", 0.0): (50.5, 8.25, None),
        ("first", 1.0): (50.6, 8.35, None),
        ("first", 2.0): (None, 8.45, None),
        ("second", 100.0): (51.5, 9.5, 120.0),
        ("second", 101.0): (51.6, 9.6, 121.0),
        ("third", 200.0): (52.0, 10.0, None),
        ("third", 201.0): (52.1, 10.1, None),
        ("third", 202.0): (52.2, 10.2, None),
        ("fourth", 300.0): (53.0, 11.0, None),
        ("fourth", 301.0): (53.5, 11.5, None),
        ("fourth", 302.0): (53.5, 11.5, None),
    }
    assert t.coord_system == "gps" and "4 layouts of files" in t.log[-1].notes


def test_files_that_do_not_go_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,lat,lon\n1,2,3\n2,2,3\n")
    (tmp_path / "b.csv").write_text("time,x,y\n1,2,3\n2,2,3\n")
    with pytest.raises(ValueError, match="apart"):
        initiate(spark, str(tmp_path), source="guess_csv")
    (tmp_path / "b.csv").write_text("nothing here\n")
    with pytest.raises(ValueError, match="b"):
        initiate(spark, str(tmp_path), source="guess_csv")
    assert guess_csv_template(spark, str(tmp_path / "a.csv")).col_coord1 == "lat"
