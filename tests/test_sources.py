import json

import pytest

from trackspark.functions.columns import jaro, match_names
from trackspark.sources import ApiTemplate, CsvTemplate, initiate, load_template
from trackspark.sources.api import strava_id
from trackspark.sources.templates import strava_template
from trackspark.sources.textcsv import guess_csv_template, position


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(trace, *columns):
    return [tuple(r) for r in trace.df.orderBy("session_id", "_row").select(*columns).collect()]


def test_template_csv_with_preamble_comments_and_end(spark, tmp_path):
    text = "Device 7\nExported\nUnixTimestamp,Latitude,Longitude,Heart\n# note\n1700000000.0,1.5,2.5,90\n\n1700000000.1,NULL,2.6,x\n\n\n\n1,2,3,4\n"
    put(tmp_path / "a.csv", text)
    put(tmp_path / "b.csv", "p\nq\nLongitude,Latitude,UnixTimestamp\n7,8,1700000001\n")
    template = CsvTemplate("unixtimestamp", "Latitude", "Longitude", skip=2, extra={"Heart": None})
    template.save(str(tmp_path / "t.xml"))
    assert load_template(str(tmp_path / "t.xml")) == template
    trace = initiate(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], template=str(tmp_path / "t.xml"))
    assert rows(trace, "session_id", "unix_time", "lat", "lng", "Heart") == [
        ("a", 1700000000.0, 1.5, 2.5, "90"),
        ("a", 1700000000.1, None, 2.6, "x"),
        ("b", 1700000001.0, 8.0, 7.0, None),
    ]
    assert "no column for Heart" in trace.log[0].notes


def test_european_csv_in_milliseconds(spark, tmp_path):
    path = put(tmp_path / "e.csv", "zeit;breite;länge;puls\n1700000000000;48,5;9,25;80\n1700000000100;48,6;9,26;81\n")
    template = CsvTemplate("zeit", "breite", "länge", delimiter=";", decimal=",", extra={"puls": "pulse"})
    found = rows(initiate(spark, path, template=template), "unix_time", "lat", "lng", "pulse")
    assert found == [(1700000000.0, 48.5, 9.25, 80.0), (1700000000.1, 48.6, 9.26, 81.0)]


def test_duplicate_columns():
    header = ["Time", "Time", "Lat"]
    with pytest.raises(ValueError):
        position(header, "time")
    assert position(header, "time", "use_first") == 0
    assert position(header, "time", "use_second") == 1
    assert position(header, 2) == 1 and position(header, "none") is None


def test_guessed_csv(spark, tmp_path):
    path = put(tmp_path / "g.csv", "some device, v2\nTimestamp,Latitude,Longitud,speed\n2024-03-01 10:00:00,1,2,3\n2024-03-01 10:00:01,1.1,2.1,3\n")
    assert guess_csv_template(spark, path).col_coord2 == "Longitud"
    assert rows(initiate(spark, path), "unix_time", "lat", "lng") == [(1709287200.0, 1.0, 2.0), (1709287201.0, 1.1, 2.1)]


def test_replay_export(spark, tmp_path):
    path = put(tmp_path / "r.csv", "Replay\nStartTimeSeconds 01/02/2024 10:00:00\nTime, Time, Latitude, Longitude, Load\n1700000000,0.0,1,2,9\n1700000001,1.0,3,4,9\n\nfoot,er\n")
    assert rows(initiate(spark, path, source="catapult_replay"), "unix_time", "lat", "lng") == [(1700000000.0, 1.0, 2.0), (1700000001.0, 3.0, 4.0)]


def test_gpx(spark, tmp_path):
    text = """<gpx><trk><trkseg><trkpt lat="1" lon="2"><ele>5</ele><time>2024-01-01T00:00:01Z</time></trkpt></trkseg>
    <trkseg><trkpt lat="3" lon="4"><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>"""
    found = rows(initiate(spark, put(tmp_path / "run.gpx", text)), "session_id", "unix_time", "lat", "lng", "altitude")
    assert found == [("run", 1704067200.0, 3.0, 4.0, None), ("run", 1704067201.0, 1.0, 2.0, 5.0)]


@pytest.mark.parametrize(
    "shape, answer",
    [
        ("records", [{"t": 10, "lat": 1, "lng": 2, "hr": 60}, {"t": 11, "lat": 3, "lng": 4}]),
        ("columnar", {"t": [10, 11], "lat": [1, 3, 99], "lng": [2, 4], "hr": [60]}),
        ("streams", {"t": {"data": [10, 11]}, "lat": {"data": [1, 3]}, "lng": {"data": [2, 4]}, "hr": {"data": [60]}}),
    ],
)
def test_api_shapes(spark, monkeypatch, shape, answer):
    monkeypatch.setenv("KEY_OF_TEST", "s3")
    seen = []

    def fetch(method, url, headers, body):
        seen.append((method, url, headers))
        return 200, json.dumps({"out": {"rows": answer}})

    template = ApiTemplate("http://host/{session}", "t", data_path="out.rows", response_format=shape, auth_type="bearer", auth_value="$KEY_OF_TEST", stream_lat="lat", stream_lng="lng", extra={"hr": "pulse"})
    trace = initiate(spark, "a b", template=template, fetch=fetch)
    assert rows(trace, "unix_time", "lat", "lng", "pulse") == [(10.0, 1.0, 2.0, 60.0), (11.0, 3.0, 4.0, None)]
    assert seen == [("GET", "http://host/a%20b", {"Authorization": "Bearer s3"})]


def test_api_errors_and_secrets(spark, tmp_path):
    template = ApiTemplate("http://host/{session}", stream_lat="a", stream_lng="b", auth_type="bearer", auth_value="open")
    assert "open" not in repr(template)
    with pytest.raises(ValueError):
        template.save(str(tmp_path / "x.xml"))
    with pytest.raises(RuntimeError, match="429"):
        initiate(spark, "1", template=template, fetch=lambda *a: (429, ""))


def test_strava_with_an_old_token(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("ID_OF_TEST", "i")
    token = put(tmp_path / "token.json", json.dumps({"refresh_token": "r", "access_token": "old", "expires_at": 0}))

    def fetch(method, url, headers, body):
        if "token" in url:
            return 200, json.dumps({"access_token": "new", "expires_at": 4e9})
        assert headers["Authorization"] == "Bearer new"
        if "streams" in url:
            return 200, json.dumps({"time": {"data": [0, 1]}, "latlng": {"data": [[1, 2], [3, 4]]}})
        return 200, json.dumps({"name": "Run", "start_date": "2024-01-01T00:00:00Z"})

    template = strava_template(oauth2_client_id="$ID_OF_TEST", oauth2_client_secret="$ID_OF_TEST", oauth2_token_path=token)
    trace = initiate(spark, "https://www.strava.com/activities/42", template=template, fetch=fetch)
    assert rows(trace, "unix_time", "lat", "lng") == [(1704067200.0, 1.0, 2.0), (1704067201.0, 3.0, 4.0)]
    assert json.load(open(token))["access_token"] == "new" and strava_id("42") == "42"


def test_names():
    assert jaro("martha", "marhta") == pytest.approx(0.9444, abs=1e-4)
    assert match_names(["Lat", "LATITUDE"], {"lat": ("latitude", "lat")}) == {"lat": "LATITUDE"}


def test_files_of_one_name_are_sessions_of_their_own_and_dates_go_by_file(spark, tmp_path):
    for day, first in (("mon", "2024-01-31 10:00:0"), ("tue", "31-01-2024 10:00:0")):
        (tmp_path / day).mkdir()
        lines = [f"{first}{i},{i},{i}" for i in range(5)]
        (tmp_path / day / "game.csv").write_text("time,lat,lng\n" + "\n".join(lines) + "\n")
    trace = initiate(spark, str(tmp_path), source="manual_csv", coord_system="gps", col_unix="time", columns=["lat", "lng"])
    found = {(r["session_id"], r["unix_time"]) for r in trace.df.collect()}
    assert {s for s, _ in found} == {"mon/game", "tue/game"} and len(found) == 10
    assert {t for _, t in found} == {1706695200.0 + i for i in range(5)}


def test_a_guessed_file_without_a_coordinate_has_nulls(spark, tmp_path):
    (tmp_path / "half.csv").write_text("time,latitude,speed\n1700000000,1,2\n1700000001,1,2\n")
    trace = initiate(spark, str(tmp_path / "half.csv"))
    assert [r["lng"] for r in trace.df.collect()] == [None, None]
