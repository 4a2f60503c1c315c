"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.common import small_batches, told

#: Letters of a text that are turned into n-grams at a time.
STEP = 1 << 20
#: n-grams that a training task holds for its languages before it passes them on.
HELD_GRAMS = 1_000_000
#: Texts that are counted together in training.
CHUNK_ROWS = 128
UNKNOWN = "und"

_BITS = 21  # of a code point; three of them fit in 63 bits
_EDGE = 1  # stands for the edge of a word


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters_of(text: str) -> np.ndarray:
    """The code points of the lower-cased words (runs of letters), with an edge between, before and after."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    alpha = _letters()[codes]
    if not alpha.any():
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(alpha)
    codes, alpha = codes[at[0] : at[-1] + 1], alpha[at[0] : at[-1] + 1]
    codes = np.where(alpha, codes, _EDGE).astype(np.uint64)
    keep = alpha | np.concatenate([[True], alpha[:-1]])
    return np.concatenate([[_EDGE], codes[keep], [_EDGE]]).astype(np.uint64)


def _counted(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) == 1:
        return grams[0], counts[0]
    every, at = np.unique(np.concatenate(grams), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def grams_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of one to three letters or edges, and their counts."""
    found: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for start in range(0, max(len(codes), 1), STEP):
        part = codes[start : start + STEP + 2]
        own = min(STEP, len(codes) - start)  # n-grams that begin here
        two = (part[:-1] << np.uint64(_BITS)) | part[1:]
        three = (two[:-1] << np.uint64(_BITS)) | part[2:]
        one = part[:own]
        every = np.concatenate([one[one != _EDGE], two[:own], three[:own]])
        g, n = np.unique(every, return_counts=True)
        found.append(g)
        sizes.append(n)
    return _counted(found, sizes)


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return grams[np.lexsort((grams, -counts))[:size]]


def language_profiles(train: DataFrame, size: int) -> DataFrame:
    """lang, rank (0 is most frequent), gram: the profile of each language.

    Tasks count whole texts and merge their own counts before the shuffle, so a
    language of most rows is a few thousand rows per task; all counts of a
    language are summed and its ``size`` most frequent n-grams ranked.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(start, CHUNK_ROWS)
                texts: dict[str, list[str]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    for codes in map(letters_of, own):
                        if len(codes):
                            g, n = grams_of(codes)
                            have = held.get(lang)
                            held[lang] = _counted([g, have[0]], [n, have[1]]) if have else (g, n)
                if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                    yield from passed_on()
        yield from passed_on()

    counts = train.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= size)  # so: Spark cuts each language's rows before it shuffles them
        .select("lang", (F.col("place") - 1).alias("rank"), "gram")
    )


class Profiles:
    """The ranks of every profile's n-grams, side by side."""

    def __init__(self, rows: list, size: int):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.array(sorted({r["gram"] for r in rows}), np.uint64)
        self.ranks = np.full((len(self.langs), len(self.grams)), size, np.int32)
        for r in rows:
            self.ranks[self.langs.index(r["lang"]), np.searchsorted(self.grams, np.uint64(r["gram"]))] = r["rank"]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose profile is the least out of place, and how near it is.

        An n-gram's distance is that of its ranks, or the profile's size if the
        profile doesn't have it. The score is 1 for no distance, 0 for the most.
        """
        codes = letters_of(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = top(*grams_of(codes), self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == own, self.ranks[:, at], self.size)
        there = ranks < self.size
        away = np.where(there, np.abs(ranks - np.arange(len(own))), self.size).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.size * len(own))


def held_out(id_col: Column) -> Column:
    """Whether a document is left out of training: a quarter, by a checksum of its id."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def identify(
    docs: DataFrame,
    size: int = 300,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Profiles are learnt from the whole texts of all documents with a language
    that are not held out; a prediction sees the text only. What goes through
    the driver is ``size`` n-grams per language, however many documents.

    Edge cases: a null text, or one without a letter, is ``und`` with score 0,
    and so is every text when nothing can be learnt; equal distances go to the
    first language by code point; a null id is not held out; rows that repeat
    are predicted alike; an empty table gives an empty result; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    own = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        held_out(F.col(id_col)).alias("held_out"),
    )
    train = own.filter("lang is not null and text is not null and not held_out")
    known = told(docs.sparkSession, Profiles(language_profiles(train, size).collect(), size))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(2):
                lang, score = known.value.predict(text.as_py())
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "held_out", "lang_pred", "score"],
            )

    rows = own.select("id", "held_out", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        predict, f"id {kind}, held_out boolean, lang_pred string, score double"
    ).withColumnRenamed("id", id_col)
