"""Descriptions of device files and HTTP interfaces, kept as XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

Ref = str | int  # a column's name (whatever the case) or its number from 1

DUPLICATES = ("return_error", "use_first", "use_second")
AUTH = ("none", "bearer", "api_key_header", "api_key_query", "oauth2_refresh")
SHAPES = ("records", "columnar", "streams")
TIMES = ("unix", "iso8601", "relative")


@dataclass(frozen=True)
class CsvTemplate:
    """Where a delimited file has its header, and which columns are what.

    ``extra`` maps references to names (or None for the column's own name).
    ``header_pattern`` finds the header by a regular expression instead of by
    ``skip``; it is not kept in the XML form.
    """

    col_unix: Ref
    col_coord1: Ref
    col_coord2: Ref
    col_coord3: Ref | None = None
    col_velocity: Ref | None = None
    col_acceleration: Ref | None = None
    coord_system: str = "gps"
    skip: int = 0
    max_empty_lines: int = 3
    comment: str | None = "#"
    duplicate_method: str = "return_error"
    delimiter: str = ","
    decimal: str = "."
    extra: Mapping[Ref, str | None] = field(default_factory=dict)
    n_max: int | None = None
    header_pattern: str | None = None

    def __post_init__(self):
        if self.coord_system not in ("gps", "local"):
            raise ValueError("coord_system is 'gps' or 'local'")
        if len(self.delimiter) != 1:
            raise ValueError("the delimiter is one character")
        if self.decimal not in (".", ","):
            raise ValueError("the decimal mark is '.' or ','")
        if self.duplicate_method not in DUPLICATES:
            raise ValueError(f"duplicate_method is one of {', '.join(DUPLICATES)}")
        if None in (self.col_unix, self.col_coord1, self.col_coord2):
            raise ValueError("a template names the time and two coordinates")

    @property
    def targets(self) -> dict[str, Ref]:
        """The references by column of the trace."""
        axes = ("lat", "lng", "altitude") if self.coord_system == "gps" else ("x", "y", "z")
        every = dict(zip(("unix_time", *axes), (self.col_unix, self.col_coord1, self.col_coord2, self.col_coord3)))
        every |= {"velocity": self.col_velocity, "acceleration": self.col_acceleration}
        return {k: v for k, v in every.items() if v is not None}

    def save(self, path: str) -> None:
        root = ET.Element("csv_template")
        for name in ("coord_system", "skip", "max_empty_lines", "comment", "duplicate_method", "delimiter", "decimal"):
            _put(root, name, getattr(self, name))
        columns = ET.SubElement(root, "columns")
        for f in fields(self):
            if f.name.startswith("col_"):
                _put(columns, f.name, getattr(self, f.name))
        _put_extra(root, "extra_columns", "col", self.extra)
        _write(root, path)

    @classmethod
    def load(cls, path: str) -> CsvTemplate:
        root = ET.parse(path).getroot()
        if root.tag != "csv_template":
            raise ValueError(f"{path} has no csv_template")
        found = {e.tag: e.text or "" for e in root if not len(e) and e.tag in _names(cls)}
        found |= {k: int(found[k]) for k in ("skip", "max_empty_lines", "n_max") if k in found}
        columns = {e.tag: _ref(e.text) for e in root.iterfind("columns/*")}
        found.setdefault("comment", None)
        return cls(**found, **columns, extra=_get_extra(root, "extra_columns"))


@dataclass(frozen=True)
class ApiTemplate:
    """How to ask an HTTP interface for a session and what its answer holds.

    Values that begin with ``$`` name environment variables; other secrets are
    not written to files.
    """

    url: str
    stream_time: str = "time"
    api: str = "generic"
    coord_system: str = "gps"
    token_path: str | None = None
    request_method: str = "GET"
    data_path: str | None = None
    auth_type: str = "none"
    auth_value: str | None = None
    auth_header: str = "X-API-Key"
    auth_param: str = "api_key"
    oauth2_token_url: str | None = None
    oauth2_client_id: str | None = None
    oauth2_client_secret: str | None = None
    oauth2_token_path: str | None = None
    response_format: str = "records"
    stream_data_key: str = "data"
    time_type: str = "unix"
    time_origin: float = 0.0
    stream_latlng: str | None = None
    stream_lat: str | None = None
    stream_lng: str | None = None
    stream_altitude: str | None = None
    stream_x: str | None = None
    stream_y: str | None = None
    stream_z: str | None = None
    stream_velocity: str | None = None
    stream_acceleration: str | None = None
    extra: Mapping[str, str | None] = field(default_factory=dict)
    request_params: Mapping[str, str] | None = None
    request_body: object | None = None

    def __post_init__(self):
        for name, allowed in (("auth_type", AUTH), ("response_format", SHAPES), ("time_type", TIMES), ("coord_system", ("gps", "local"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        pair = self.stream_latlng or (self.stream_lat and self.stream_lng)
        if not (pair if self.coord_system == "gps" else self.stream_x and self.stream_y):
            raise ValueError("a template names two coordinates")

    def __repr__(self) -> str:
        shown = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) not in (None, {}, f.default)}
        hidden = {k: "***" for k in ("auth_value", "oauth2_client_secret") if shown.get(k)}
        return f"ApiTemplate({', '.join(f'{k}={v!r}' for k, v in (shown | hidden).items())})"

    _SECTIONS = {
        "request": ("url", "request_method", "data_path"),
        "auth": ("auth_type", "auth_value", "auth_header", "auth_param", "oauth2_token_url", "oauth2_client_id", "oauth2_client_secret", "oauth2_token_path"),
        "response": ("response_format", "stream_data_key", "time_type", "time_origin"),
        "streams": ("stream_time", "stream_latlng", "stream_lat", "stream_lng", "stream_altitude", "stream_x", "stream_y", "stream_z", "stream_velocity", "stream_acceleration"),
    }

    def save(self, path: str) -> None:
        """Write everything but the request's parameters and body."""
        for name in ("auth_value", "oauth2_client_secret"):
            if (value := getattr(self, name)) and not value.startswith("$"):
                raise ValueError(f"{name} is a secret: name an environment variable by $NAME to save it")
        root = ET.Element("api_stream_template")
        for name in ("api", "coord_system", "token_path"):
            _put(root, name, getattr(self, name))
        for section, names in self._SECTIONS.items():
            part = ET.SubElement(root, section)
            for name in names:
                _put(part, name, getattr(self, name))
        _put_extra(root, "extra_streams", "stream", self.extra)
        _write(root, path)

    @classmethod
    def load(cls, path: str) -> ApiTemplate:
        root = ET.parse(path).getroot()
        if root.tag != "api_stream_template":
            raise ValueError(f"{path} has no api_stream_template")
        found = {e.tag: e.text or "" for e in root.iter() if not len(e) and e.tag in _names(cls)}
        if "time_origin" in found:
            found["time_origin"] = float(found["time_origin"])
        return cls(**found, extra=_get_extra(root, "extra_streams"))


def strava_template(**changes) -> ApiTemplate:
    """The streams of an activity, times counted from its start."""
    made = ApiTemplate(
        url="https://www.strava.com/api/v3/activities/{session}/streams?keys=time,latlng,altitude,velocity_smooth&key_by_type=true",
        api="strava",
        auth_type="oauth2_refresh",
        oauth2_token_url="https://www.strava.com/oauth/token",
        response_format="streams",
        time_type="relative",
        stream_latlng="latlng",
        stream_altitude="altitude",
        stream_velocity="velocity_smooth",
    )
    return replace(made, **changes)


def load_template(path: str) -> CsvTemplate | ApiTemplate:
    tag = ET.parse(path).getroot().tag
    kinds = {"csv_template": CsvTemplate, "api_stream_template": ApiTemplate}
    if tag not in kinds:
        raise ValueError(f"{path} is no template: its root is {tag}")
    return kinds[tag].load(path)


def _names(cls) -> set[str]:
    return {f.name for f in fields(cls)}


def _ref(text: str | None) -> Ref:
    text = text or ""
    return int(text) if text.isdigit() else text


def _put(parent: ET.Element, name: str, value) -> None:
    if value is not None:
        ET.SubElement(parent, name).text = str(value)


def _put_extra(root: ET.Element, section: str, tag: str, extra: Mapping[Ref, str | None]) -> None:
    if extra:
        part = ET.SubElement(root, section)
        for ref, name in extra.items():
            ET.SubElement(part, tag, {"ref": str(ref)} | ({"as": name} if name else {}))


def _get_extra(root: ET.Element, section: str) -> dict[Ref, str | None]:
    """Also the older form, where a column's name is the element's text."""
    part = root.find(section)
    return {_ref(e.get("ref") or e.text): e.get("as") for e in (part if part is not None else ())}


def _write(root: ET.Element, path: str) -> None:
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="UTF-8", xml_declaration=True)
