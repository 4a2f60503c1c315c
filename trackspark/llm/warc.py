"""WARC records in a content-addressed archive.

Payload bytes are stored once each, under their verified SHA-256; the exact
record headers are stored apart, in the order of their archive; a join of the
two gives back the original records, byte for byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm.common import (
    HEAVY_GROUPS,
    broadcast_if_small,
    join_groups,
    materialise,
    scratch_path,
)

CRLF = "\r\n"
#: Payload bytes from which on equal payloads are stored as revisits.
REVISIT_BYTES = 100
#: Records of one archive file, and bytes of its payloads, at most.
FILE_RECORDS, FILE_BYTES = 4_000, 256 << 20
#: Payload bytes from which on records go to files of their own kind, of fewer records.
LARGE_BYTES = FILE_BYTES // FILE_RECORDS
#: Bytes of decompressed archive that a reader asks for at a time.
CHUNK = 1 << 20


def _uri(record_id: Column) -> Column:
    """An id as a URI: nothing after the colon for no id, and "=" before any other."""
    name = F.concat(F.lit("="), F.url_encode(record_id.cast("string")))
    return F.concat(F.lit("<urn:page:"), F.coalesce(name, F.lit("")), F.lit(">"))


def classify(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """One row per page: id, url, payload, payload_bytes, digest, record_type, refers_to.

    Of the pages with equal payloads of ``REVISIT_BYTES`` bytes or more, the one
    with the smallest id is the response and the others revisit it. Only digests
    and ids are grouped and shuffled; the heaviest groups meet their rows by a
    broadcast. The revisits' ids meet the pages by a broadcast too, so payloads
    stay where they are, unless there are very many revisits. Rows that repeat
    an id are told apart by their digests.
    """
    own = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    keyed = own.select(
        "id",
        "url",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("digest"),
        "payload",
    )
    heads = materialise(keyed.select("id", "payload_bytes", "digest"), "warc_heads")
    groups = materialise(
        heads.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1"),
        "warc_groups",
    )
    revisits = (
        join_groups(heads, groups, "digest", "n", heads.count(), "inner")
        .filter("first_id is not null and not (id <=> first_id)")
        .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first_id").alias("refers_to"))
        .distinct()
    )
    revisits = broadcast_if_small(materialise(revisits, "warc_revisits"))
    met = keyed.join(
        revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left"
    )
    return met.select(
        "id",
        "url",
        "payload",
        "payload_bytes",
        "digest",
        F.when(F.col("r_digest").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        "refers_to",
    )


def header(record: DataFrame, date: str) -> Column:
    """The exact header block of each record, with the empty line that ends it."""
    block = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("WARC-Refers-To: "), F.when(F.col("record_type") == "revisit", _uri(F.col("refers_to")))),
        F.when(
            F.col("record_type") == "revisit",
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))  # concat_ws skips nulls


def write_warc(records: DataFrame, path: str, most_bytes: int, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write classified pages as gzip-compressed WARC 1.1 files.

    A reader takes a file as one value, so its payloads are bounded: small ones
    (below LARGE_BYTES) are FILE_RECORDS to a file, large ones, below
    ``path/large``, as many as fit in FILE_BYTES if all have ``most_bytes``.
    """
    is_large = F.col("payload_bytes") >= LARGE_BYTES
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    for rows, folder, most in (
        (records.filter(~is_large), "small", FILE_RECORDS),
        (records.filter(is_large), "large", max(1, FILE_BYTES // max(most_bytes, 1))),
    ):
        (
            rows.select(F.concat(header(rows, date), body).alias("value"))
            .write.option("lineSep", CRLF + CRLF)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", most)
            .text(f"{path}/{folder}")
        )


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Header block and body of each record of a decompressed stream.

    Bodies are cut by Content-Length, so they may hold any bytes; no more than
    one record and one chunk is in memory.
    """
    held = b""

    def fill(n: int | None) -> bool:
        nonlocal held
        parts, have = [held], len(held)
        while n is None or have < n:
            chunk = next(chunks, None)
            if chunk is None:
                held = b"".join(parts)
                return False
            parts.append(chunk)
            have += len(chunk)
            if n is None:
                break
        held = b"".join(parts)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(None):
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        end += 4
        head = held[:end]
        length = next(
            int(line.partition(b":")[2])
            for line in head.split(b"\r\n")
            if line.lower().startswith(b"content-length:")
        )
        if not fill(end + length + 4) and len(held) < end + length:
            raise ValueError("the archive ends within a record's body")
        yield head, held[end : end + length]
        held = held[end + length + 4 :]


def _inflate(data: bytes) -> Iterator[bytes]:
    """The contents of one or more gzip members, a chunk at a time."""
    while data:
        unzip = zlib.decompressobj(wbits=31)
        while not unzip.eof:
            out = unzip.decompress(data, CHUNK)
            data = unzip.unconsumed_tail if not unzip.eof else unzip.unused_data
            if out:
                yield out
            elif not data:
                break


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: file, at (number in the file), header, body."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for at, (head, body) in enumerate(parse_warc(_inflate(content))):
                    rows.append((name, at, head.decode(), body))
                    held += len(body)
                    if held > 16 * CHUNK:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "at", "header", "body"]
        )

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = found.option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, at long, header string, body binary")


def field(name: str, head: Column | str = "header") -> Column:
    """A named field of a header, null if it isn't there."""
    found = F.regexp_extract(head, f"(?im)^{name}: *([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def store(records: DataFrame, path: str) -> None:
    """Put records (file, at, header, body) into a content-addressed archive.

    ``path/payloads`` gets each distinct payload once, under the digest that is
    computed from its bytes; a record whose header states another digest fails
    the job. ``path/headers`` gets every header. Which of equal payloads is
    stored is settled by digests and places alone; the places of the others meet
    the records by a broadcast, so payloads stay where they are, unless very
    many repeat.
    """
    kept = records.withColumn("digest", F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", ""))
    is_full = field("WARC-Type") == "response"
    kept.select("file", "at", "header", "digest").write.option("compression", "zstd").parquet(f"{path}/headers")
    places = records.sparkSession.read.parquet(f"{path}/headers").filter(is_full).select("file", "at", "digest")
    firsts = materialise(
        places.groupBy("digest").agg(F.min(F.struct("file", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1"),
        "warc_firsts",
    )
    again = (
        join_groups(places, firsts, "digest", "n", places.count(), "inner")
        .filter(F.struct("file", "at") != F.col("first"))
        .select("file", "at")
    )
    again = broadcast_if_small(materialise(again, "warc_repeats"))
    own = F.sha2("body", 256)
    checked = F.when(
        own == F.col("digest"), own
    ).otherwise(F.raise_error(F.concat(F.lit("digest mismatch: "), F.coalesce("digest", F.lit("none")))))
    full = kept.filter(is_full).join(again, ["file", "at"], "left_anti")
    full.select(checked.alias("digest"), "body").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The headers and payloads of an archive."""
    return spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: file, at, header, digest, body (empty for revisits).

    Responses meet their payloads by digest. A payload of many records, and of
    4 KB at most, is broadcast; there are 1024 such at most. Larger ones of many
    records are dealt out several times, to as many parts of their records.
    """
    headers, payloads = read_store(spark, path)
    is_full = field("WARC-Type") == "response"
    full = headers.filter(is_full)
    total = full.count()
    line = max(1, total // HEAVY_GROUPS)
    hot = full.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > line)
    hot = materialise(hot.withColumn("parts", F.ceil(F.col("n") / line).cast("int")), "warc_hot")
    known = payloads.join(F.broadcast(hot), "digest", "left").withColumn("small", F.octet_length("body") <= 4096)
    spread = known.filter("n is null or not small").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    )
    few = known.filter("n is not null and small").select("digest", "body")
    met = full.join(F.broadcast(hot.drop("n")), "digest", "left")
    met = met.withColumn("part", F.pmod(F.xxhash64("file", "at"), F.coalesce("parts", F.lit(1))).cast("int"))
    met = met.join(F.broadcast(few.withColumnRenamed("body", "few")), "digest", "left")
    columns = ["file", "at", "header", "digest"]
    stay = met.filter("few is not null").select(*columns, F.col("few").alias("body"))
    move = met.filter("few is null").join(spread.select("digest", "part", "body"), ["digest", "part"]).select(*columns, "body")
    empty = headers.filter(~is_full).select(*columns, F.lit(b"").alias("body"))
    return stay.unionByName(move).unionByName(empty)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original records of an archive: file, at, record (its exact bytes)."""
    end = F.lit((CRLF + CRLF).encode())
    return rebuilt(spark, path).select("file", "at", F.concat(F.col("header").cast("binary"), "body", end).alias("record"))


def archive_pages(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Archive ``pages`` below ``path`` (or in a scratch folder) and return what the archive says of each.

    Writes WARC files, reads them back into the content-addressed store, and
    rebuilds the records from it. A response's payload_bytes and payload_digest
    are computed from its rebuilt body, a revisit's are those of the stored
    payload: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Edge cases: a null or empty payload is an empty response; a null url is an
    empty one; rows that repeat an id and a large payload are all responses if
    theirs is the smallest id; a null id is never the smallest (a group of null
    ids only has responses only); an empty table gives an empty result; other
    columns are ignored. Ids are read back as their type was.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    kind = pages.schema[id_col].dataType
    records = classify(pages, id_col, url_col, payload_col)
    most = pages.agg(F.max(F.octet_length(payload_col))).first()[0] or 0
    write_warc(records, f"{path}/warc", most)
    store(read_warc(spark, f"{path}/warc"), f"{path}/store")

    def page(name: str) -> Column:
        inner = F.regexp_extract(field(name), "^<urn:page:=(.*)>$", 1)
        return F.when(inner != "", F.url_decode(inner)).when(field(name) == "<urn:page:=>", F.lit("")).cast(kind)

    rows = materialise(
        rebuilt(spark, f"{path}/store").select(
            page("WARC-Record-ID").alias(id_col),
            F.octet_length("body").cast("long").alias("payload_bytes"),
            F.when(field("WARC-Type") == "response", F.sha2("body", 256)).otherwise(F.col("digest")).alias("payload_digest"),
            field("WARC-Type").alias("record_type"),
            page("WARC-Refers-To").alias("refers_to"),
        ),
        "warc_rows",
    )
    again = rows.filter("record_type = 'revisit'")
    uses = again.groupBy("payload_digest").agg(F.count("*").alias("n"))
    _, payloads = read_store(spark, f"{path}/store")
    sizes = payloads.select(F.col("digest").alias("payload_digest"), F.octet_length("body").cast("long").alias("payload_bytes"))
    sized = materialise(sizes.join(uses, "payload_digest"), "payload_uses")
    met = join_groups(again.drop("payload_bytes"), sized, "payload_digest", "n", again.count(), "inner")
    columns = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.filter("record_type <> 'revisit'").select(columns).unionByName(met.select(columns))
