"""Loading sessions from device files, GPX tracks, HTTP interfaces and tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from trackspark.sources import api, gpx, textcsv
from trackspark.sources.templates import ApiTemplate, CsvTemplate, load_template
from trackspark.trace import Trace

SOURCES = ("auto", "guess_csv", "manual_csv", "template_csv", "csv", "catapult_replay", "gpx", "strava", "generic")


def initiate(
    spark: SparkSession,
    session: str | Sequence[str],
    source: str = "auto",
    coord_system: str = "auto",
    template: CsvTemplate | ApiTemplate | str | None = None,
    fetch: api.Fetch = api.http,
    **options,
) -> Trace:
    """A trace of the sessions that ``session`` names: files, a folder, or an HTTP session.

    ``template`` (or the path of its XML) decides the source. Without one,
    'auto' goes by the file's ending. ``options`` are those of
    :func:`textcsv.manual_template`.
    """
    if source not in SOURCES:
        raise ValueError(f"source is one of {', '.join(SOURCES)}")
    notes: list[str] = []
    if isinstance(template, str):
        template = load_template(template)
    if template is not None:
        chosen = "template_csv" if isinstance(template, CsvTemplate) else "strava" if template.api == "strava" else "generic"
        if source not in ("auto", "csv", chosen):
            notes.append(f"the template is for {chosen}; source={source!r} is not used")
        source = chosen
    elif source == "auto":
        first = (session if isinstance(session, str) else session[0]).lower()
        source = {"csv": "guess_csv", "gpx": "gpx"}.get(first.rpartition(".")[2], "")
        if not source:
            raise ValueError("the source can't be told from the name; choose one")
    meta: dict[str, object] = {"source": source}
    if source == "gpx":
        df, system = gpx.read_gpx(spark, session), "gps"
    elif source in ("strava", "generic"):
        if template is None:
            raise ValueError(f"source {source!r} needs a template")
        if source == "strava":
            df, more, about = api.read_strava(spark, session, template, fetch)
            meta |= about
        else:
            df, more = api.read_api(spark, session, template, fetch)
        notes, system = notes + more, template.coord_system
    else:
        if source == "manual_csv":
            template = textcsv.manual_template(coord_system, options.pop("col_unix"), options.pop("columns"), **options)
        elif source == "catapult_replay":
            template = replace(textcsv.REPLAY, **options)
        elif source != "guess_csv" and not isinstance(template, CsvTemplate):
            raise ValueError("source 'template_csv' needs a template")
        if source == "guess_csv" and template is None:
            df, more, system = textcsv.read_guessed(spark, session, coord_system, options.pop("confidence_threshold", 0.8))
        else:
            df, more = textcsv.read_csv(spark, session, template)
            system = template.coord_system
        notes = notes + more
        if source == "catapult_replay":
            df = df.join(textcsv.replay_start(spark, session), "session_id", "left")
    trace = Trace.from_dataframe(df, ("session_id",), system, order_by="_row", **meta)
    return trace.noted(*notes)


__all__ = ["ApiTemplate", "CsvTemplate", "SOURCES", "initiate", "load_template"]
