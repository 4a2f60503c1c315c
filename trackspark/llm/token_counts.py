"""Token counts of whole texts, through a stored cache of counts by content."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trackspark.llm.bpe import _KNOWN_RULES, WordEncoder, _byte_level, _words
from trackspark.llm.common import ASCII_SPACE, join_groups, materialise, small_batches, tidy

#: Distinct words whose token counts a worker keeps.
KEEP_WORDS = 300_000
#: Characters of text that are cut into words at a time.
CHUNK_CHARS = 1_000_000
#: Rows of which one broadcast says whether they are encoded: 64 MB as bits.
WAVE_ROWS = 1 << 29
#: 64-bit words of one row of those bits.
SLOT_WORDS = 128

CACHE = "version string, digest binary, n_tokens long"


# Counting in a worker ----------------------------------------------------------


def drops_space(path: str) -> bool:
    """Whether the file's own rules make nothing of white space but a border of words."""
    if not path.endswith(".json"):
        return False
    spec = json.load(open(path, encoding="utf-8"))
    try:
        rules = json.dumps(spec["normalizer"]["normalizers"]), spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    except (KeyError, TypeError):
        return False
    return rules == _KNOWN_RULES and not any(" " in a["content"] for a in spec["added_tokens"])


class WordCounts:
    """Token counts of texts as sums over their words; each distinct word is encoded once."""

    def __init__(self, tokenizer: Tokenizer, path: str):
        self.tokenizer, self.encoder = tokenizer, WordEncoder(path)
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        words = [_words(text, self.tokenizer, self.encoder) for text in texts]
        new = set().union(*words) - self.known.keys()
        if len(self.known) + len(new) > KEEP_WORDS:
            self.known.clear()
            new = set().union(*words)
        special = new & self.encoder.special.keys()
        self.known.update(dict.fromkeys(special, 1))
        symbols: dict[str, list[str]] = {}
        for w in new - special:
            own = w[1:] if w[0] == "\0" else w if w.isascii() else _byte_level(w)
            symbols.setdefault(own, []).append(w)
        for own, ids in self.encoder.encode_words(symbols).items():
            self.known.update(dict.fromkeys(symbols[own], len(ids)))
        get = self.known.__getitem__
        return [sum(map(get, own)) for own in words]


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts: tokenizers for .json, sentencepiece for .model.

    No begin, end or other added special tokens, no truncation and no padding;
    special strings in a text are what the library makes of them by default.
    """
    if path.endswith(".model"):
        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if drops_space(path):
        return WordCounts(tokenizer, path)
    return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def counted(texts: list[str], path: str) -> list[int]:
    """Token counts, a bounded number of characters at a time."""
    count, found, chunk, chars = counter(path), [], [], 0
    for text in texts:
        chunk.append(text)
        chars += len(text)
        if chars > CHUNK_CHARS:
            found += count(chunk)
            chunk, chars = [], 0
    return found + count(chunk)


# The cache -----------------------------------------------------------------------


def version(path: str) -> str:
    """A digest of the tokenizer's file and of how its texts are normalised and counted here."""
    rule = "white space squeezed" if drops_space(path) else "as it is"
    with open(path, "rb") as file:
        return hashlib.sha256(f"{os.path.splitext(path)[1]}, {rule}, no added tokens\n".encode() + file.read()).hexdigest()


def content(text: Column, path: str) -> Column:
    """What a count depends on: null as empty, and white space squeezed where the tokenizer drops it."""
    there = F.coalesce(text, F.lit(""))
    return F.regexp_replace(there, ASCII_SPACE, " ") if drops_space(path) else there


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """version, digest, n_tokens of a cache, empty if there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(CACHE).parquet(folder) if system.exists(place) else spark.createDataFrame([], CACHE)


def _cached(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; writers at the same time may have added a text twice."""
    own = read_cache(spark, folder).filter(F.col("version") == tokenizer)
    return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def placed(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """file, row (where a row of a Parquet table lies) and text, then ``columns``.

    A table that is not read straight from Parquet files is written first.
    """
    wanted = [
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.col(text_col).alias("text"),
        *columns,
    ]
    try:
        return docs.select(*wanted)
    except AnalysisException:
        return materialise(docs, "texts").select(*wanted)


def row_bits(rows: DataFrame) -> DataFrame:
    """file, slot, words: the rows (file, row) as bits, SLOT_WORDS words to a slot."""
    words = rows.groupBy("file", F.expr("row div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(row % 64 as int))")).alias("bits")
    )
    entry = F.struct(F.expr(f"cast(word % {SLOT_WORDS} as int)").alias("at"), "bits")
    slots = words.groupBy("file", F.expr(f"word div {SLOT_WORDS}").alias("slot")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("found")
    )
    every = F.sequence(F.lit(0), F.lit(SLOT_WORDS - 1))
    return slots.select(
        "file", "slot", F.transform(every, lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("long"))).alias("words")
    )


def encode_rows(rows: DataFrame, bits: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of the rows of :func:`placed` whose bit is set; texts stay where they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counted(batch.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["digest", "n_tokens"])

    word = F.expr(f"get(words, cast(row div 64 % {SLOT_WORDS} as int))")
    bit = F.call_function("getbit", word, F.expr("cast(row % 64 as int)"))
    met = rows.withColumn("slot", F.expr(f"row div {64 * SLOT_WORDS}")).join(F.broadcast(bits), ["file", "slot"])
    own = met.filter(bit == 1).select(content(F.col("text"), path).alias("content"))
    return own.select(F.unhex(F.sha2("content", 256)).alias("digest"), "content").mapInArrow(
        tidy(count, "bpe"), "digest binary, n_tokens long"
    )


def count_tokens(
    docs: DataFrame,
    path: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    wave_rows: int = WAVE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a tokenizer file, present on every worker. ``cache`` is a folder
    that driver and executors share: a Parquet table of counts by the digest of
    the tokenizer version and that of the normalised content. It is made when
    there is none, and kept: a later call encodes what is new to it.

    The texts are read for their digests, which leave a small table behind.
    Grouped by digest (counted before the shuffle, so a hot text is one row from
    each task) and joined to the cache they give the distinct misses, and for
    each miss one row of the table, known by its file and position. Those rows
    are bits, broadcast in waves of files of WAVE_ROWS rows, so that the second
    read encodes the misses where they lie: no text is ever shuffled. New counts
    are appended to the cache; a job that loses an executor appends once, as
    Spark's committer has it. Counts meet the rows by digest, hot digests by a
    broadcast.

    Edge cases: a null text is an empty one, of 0 bytes and 0 tokens; texts are
    encoded whole, whatever their length; rows that repeat an id, or have none,
    each have a row; an empty table gives an empty result and adds nothing;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = version(path)
    source = placed(docs, text_col, F.col(id_col).alias("id"))
    rows = materialise(
        source.select(
            "id",
            F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
            F.unhex(F.sha2(content(F.col("text"), path), 256)).alias("digest"),
            "file",
            "row",
        ),
        "digests",
    )
    total = rows.count()
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("file", "row")).alias("at"))
    misses = materialise(
        groups.join(_cached(spark, cache, tokenizer), "digest", "left_anti").select("at.file", "at.row"), "misses"
    )
    waves = max(1, -(-total // wave_rows))
    for k in range(waves):
        wave = F.pmod("file", F.lit(waves)) == k
        bits = materialise(row_bits(misses.filter(wave)), "bits")
        fresh = encode_rows(source.filter(wave).drop("id"), bits, path)
        fresh.select(F.lit(tokenizer).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = materialise(
        rows.groupBy("digest").agg(F.count("*").alias("n")).join(_cached(spark, cache, tokenizer), "digest"), "counts"
    )
    return join_groups(rows.select("id", "n_bytes", "digest"), counts, "digest", "n", total, "inner").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
