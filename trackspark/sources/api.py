"""Sessions from HTTP interfaces. One answer, a session, passes through the driver."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions.times import epoch
from trackspark.sources.templates import ApiTemplate

#: (method, url, headers, body) to (status, text).
Fetch = Callable[[str, str, dict[str, str], bytes | None], tuple[int, str]]

TROUBLE = {
    401: "the credentials are not accepted",
    403: "the credentials don't give access to this session",
    404: "there is no such session",
    429: "too many requests; try again later",
}
#: Seconds before its end at which a token is renewed.
LEEWAY = 120


def http(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=60) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def asked(fetch: Fetch, method: str, url: str, headers: dict[str, str], body: bytes | None = None):
    status, text = fetch(method, url, headers, body)
    if not 200 <= status < 300:
        raise RuntimeError(f"HTTP {status}: {TROUBLE.get(status, text[:200])}")
    return json.loads(text)


def secret(value: str | None) -> str:
    """A value, or that of the environment variable that ``$NAME`` names."""
    if value and value.startswith("$"):
        if value[1:] not in os.environ:
            raise ValueError(f"the environment variable {value[1:]} is not set")
        return os.environ[value[1:]]
    if not value:
        raise ValueError("the template has no credentials")
    return value


def valid_token(template: ApiTemplate, fetch: Fetch = http) -> str:
    """The access token of a token file; renewed, and the file rewritten, shortly before it ends."""
    path = template.oauth2_token_path or template.token_path
    if not path:
        raise ValueError("the template has no token file")
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    if held.get("access_token") and held.get("expires_at", 0) > time.time() + LEEWAY:
        return held["access_token"]
    form = {
        "grant_type": "refresh_token",
        "refresh_token": held["refresh_token"],
        "client_id": secret(template.oauth2_client_id),
        "client_secret": secret(template.oauth2_client_secret),
    }
    body = urllib.parse.urlencode(form).encode()
    kind = {"Content-Type": "application/x-www-form-urlencoded"}
    new = asked(fetch, "POST", template.oauth2_token_url, kind, body)
    if "expires_in" in new:
        new.setdefault("expires_at", time.time() + new["expires_in"])
    held |= new
    with open(path, "w", encoding="utf-8") as f:
        json.dump(held, f)
    return held["access_token"]


def request(session: str, template: ApiTemplate, fetch: Fetch = http):
    """The part of the answer below ``data_path``."""
    url, headers = template.url.replace("{session}", urllib.parse.quote(str(session), safe="")), {}
    params = dict(template.request_params or {})
    if template.auth_type == "bearer":
        headers["Authorization"] = f"Bearer {secret(template.auth_value)}"
    elif template.auth_type == "oauth2_refresh":
        headers["Authorization"] = f"Bearer {valid_token(template, fetch)}"
    elif template.auth_type == "api_key_header":
        headers[template.auth_header] = secret(template.auth_value)
    elif template.auth_type == "api_key_query":
        params[template.auth_param] = secret(template.auth_value)
    if params:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
    body = None
    if template.request_body is not None:
        body, headers["Content-Type"] = json.dumps(template.request_body).encode(), "application/json"
    found = asked(fetch, template.request_method, url, headers, body)
    for part in (template.data_path or "").split("."):
        if part:
            try:
                found = found[int(part)] if isinstance(found, list) else found[part]
            except (KeyError, IndexError, ValueError):
                raise ValueError(f"the answer has no {template.data_path!r}") from None
    return found


def columns(found, template: ApiTemplate) -> dict[str, list]:
    """Parallel lists by key, whatever the shape of the answer."""
    if template.response_format == "records":
        keys = list(dict.fromkeys(k for row in found for k in row))
        first = lambda v: v if not isinstance(v, list) or len(v) == 2 else (v[0] if v else None)
        return {k: [first(row.get(k)) for row in found] for k in keys}
    if template.response_format == "columnar":
        return {k: v for k, v in found.items() if isinstance(v, list)}
    if isinstance(found, list):
        found = {s.get("type"): s for s in found}
    return {k: v[template.stream_data_key] for k, v in found.items() if template.stream_data_key in v}


def read_api(spark: SparkSession, session: str, template: ApiTemplate, fetch: Fetch = http) -> tuple[DataFrame, list[str]]:
    """The rows of a session, and notes. Shorter streams end in nulls, longer ones are cut."""
    streams = columns(request(session, template, fetch), template)
    if template.stream_time not in streams:
        raise ValueError(f"the answer has no stream {template.stream_time!r}, but {', '.join(streams)}")
    times, notes = streams[template.stream_time], []
    wanted: dict[str, list] = {}
    if template.stream_latlng:
        pairs = [p or (None, None) for p in streams.get(template.stream_latlng, [])]
        wanted["lat"], wanted["lng"] = [p[0] for p in pairs], [p[1] for p in pairs]
    names = {"lat": "stream_lat", "lng": "stream_lng", "altitude": "stream_altitude"} if template.coord_system == "gps" else {a: f"stream_{a}" for a in "xyz"}
    names |= {"velocity": "stream_velocity", "acceleration": "stream_acceleration"}
    for target, key in names.items():
        if (ref := getattr(template, key)) and target not in wanted:
            if ref in streams:
                wanted[target] = streams[ref]
            else:
                notes.append(f"no stream {ref}")
    text = {}
    for ref, name in template.extra.items():
        if ref not in streams:
            notes.append(f"no stream {ref}")
        elif all(v is None or _number(v) is not None for v in streams[ref]):
            wanted[name or ref] = streams[ref]
        else:
            text[name or ref] = streams[ref]
    for target, values in (wanted | text).items():
        if len(values) > len(times):
            notes.append(f"{target} is longer than the times and is cut")
    series = [[_number(v) for v in x[: len(times)]] for x in wanted.values()]
    words = [[None if v is None else str(v) for v in x[: len(times)]] for x in text.values()]
    rows = [(i, None if t is None else str(t), *v) for i, (t, *v) in enumerate(zip_longest(times, *series, *words))]
    schema = "_row long, t string" + "".join(f", `{c}` double" for c in wanted) + "".join(f", `{c}` string" for c in text)
    df = spark.createDataFrame(rows, schema).withColumn("session_id", F.lit(str(session)))
    if template.time_type == "iso8601":
        moment = epoch(F.try_to_timestamp("t"))
    else:
        moment = F.col("t").try_cast("double") + F.lit(template.time_origin if template.time_type == "relative" else 0.0)
    return df.withColumn("unix_time", moment).drop("t"), notes


def _number(v) -> float | None:
    try:
        return None if v is None else float(v)
    except (TypeError, ValueError):
        return None


def strava_id(session: str) -> str:
    """An activity's number, from its address or as it is."""
    found = re.search(r"(?:activities/)?(\d+)(?:[/?#].*)?$", session)
    if not found:
        raise ValueError(f"no activity number in {session!r}")
    return found[1]


def read_strava(spark: SparkSession, session: str, template: ApiTemplate, fetch: Fetch = http) -> tuple[DataFrame, list[str], dict]:
    """The streams of an activity from its start on, and its name and start."""
    number = strava_id(session)
    token = {"Authorization": f"Bearer {valid_token(template, fetch)}"}
    about = asked(fetch, "GET", f"{template.url.split('/activities/')[0]}/activities/{number}", token)
    start = spark.sql("select unix_micros(try_to_timestamp(:t)) / 1e6 as t", args={"t": about.get("start_date")}).first()["t"]
    from dataclasses import replace

    df, notes = read_api(spark, number, replace(template, time_origin=start or 0.0), fetch)
    return df, notes, {"name": about.get("name"), "session_start": about.get("start_date")}
