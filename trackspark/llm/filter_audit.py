"""What quality filters remove, in every order: a packed bitmap index by part."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trackspark.llm.common import NOT_SPACE, join_groups, materialise

#: Rows whose bits a task holds before it counts them.
INDEX_ROWS = 1 << 22

SUMS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by letter."""
    words = F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0))
    n, distinct = (F.size(w).cast("long") for w in (words, F.array_distinct(words)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n < 50,
        "B": 100 * distinct < 65 * n,
        "C": 100 * capitals > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def earlier_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (id, digest) with ``copy``: whether a smaller id has the same digest.

    A null id is neither smaller nor larger than another.
    """
    total = rows.count()
    first = materialise(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "first_ids")
    met = join_groups(rows, first, "digest", "n", total, "inner")
    return met.withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False))).drop("digest", "first", "n")


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: whether any label of the id says so."""

    def says(name: str) -> Column:
        return F.coalesce(F.max(F.col(name) == 1), F.lit(False))

    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        says("quality").alias("good"), says("toxic").alias("toxic")
    )
    # Rows without an id meet no label; they would all meet in one task.
    named = rows.filter("id is not null").join(known, "id", "left").fillna(False, ["good", "toxic"])
    nameless = rows.filter("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return named.unionByName(nameless)


def index_counts(fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Counts of one part's rows for each filter and each set of filters before it.

    ``fails`` has a row of booleans for each filter. Row f * 2^n + s of the
    result is what SUMS names, for filter f after those of the bits of s; rows
    whose set holds f itself stay zero.
    """
    n, size = fails.shape
    bits = np.packbits(fails, axis=1)
    good, toxic = np.packbits(good), np.packbits(toxic)
    gone = np.zeros((1 << n, bits.shape[1]), np.uint8)
    for s in range(1, 1 << n):
        low = (s & -s).bit_length() - 1
        gone[s] = gone[s & (s - 1)] | bits[low]
    lost = np.bitwise_count(gone).sum(1, dtype=np.int64)
    out = np.zeros((n << n, len(SUMS)), np.int64)
    for f in range(n):
        for s in range(1 << n):
            if not s >> f & 1:
                new = bits[f] & ~gone[s]
                removed = int(np.bitwise_count(new).sum(dtype=np.int64))
                out[f << n | s] = (
                    size - lost[s] - removed,
                    removed,
                    lost[1 << f] - removed,
                    np.bitwise_count(new & good).sum(dtype=np.int64),
                    np.bitwise_count(new & toxic).sum(dtype=np.int64),
                )
    return out


def partial_counts(rows: DataFrame, letters: str) -> DataFrame:
    """part, key and SUMS of each task's rows; ``key`` is a filter and the set before it."""
    n = len(letters)
    names = [*letters, "good", "toxic"]
    keys = [f << n | s for f in range(n) for s in range(1 << n) if not s >> f & 1]

    def counted(parts: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(parts, kind="stable")
        found, starts = np.unique(parts[order], return_index=True)
        for part, own in zip(found, np.split(order, starts[1:])):
            sums = index_counts(flags[:n, own], flags[n, own], flags[n + 1, own])[keys]
            columns = [pa.array([part] * len(keys)), pa.array(keys, pa.int32()), *map(pa.array, sums.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "key", *SUMS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names_of: dict[str, int] = {}
            codes = []
            for parts, _ in held:
                own, at = np.unique(parts, return_inverse=True)
                codes.append(np.array([names_of.setdefault(p, len(names_of)) for p in own], int)[at])
            text = list(names_of)
            for batch in counted(np.concatenate(codes), np.concatenate([f for _, f in held], axis=1)):
                yield batch.set_column(0, "part", pa.array([text[i] for i in batch.column(0).to_pylist()], pa.string()))
            held.clear()

        for batch in batches:
            if batch.num_rows:
                flags = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in names], bool)
                held.append((np.array(batch.column("part").to_pylist(), object), flags))
                size += batch.num_rows
                if size >= INDEX_ROWS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    schema = "part string, key int, " + ", ".join(f"{c} long" for c in SUMS)
    return rows.select("part", *names).mapInArrow(count, schema)


def every_order(letters: str) -> list[tuple[str, int, int]]:
    """order, step and key of each step of each order of the filters."""
    n, out = len(letters), []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(letters[i] for i in order), step, f << n | before))
            before |= 1 << f
    return out


def shares(letters: str) -> list[tuple[int, int, int, bool]]:
    """key, filter, how many orders have the filter after just that set, and whether the set is all others."""
    n = len(letters)
    out = []
    for f in range(n):
        others = [i for i in range(n) if i != f]
        for size in range(n):
            for chosen in combinations(others, size):
                orders = math.factorial(size) * math.factorial(n - 1 - size)
                out.append((f << n | sum(1 << i for i in chosen), f, orders, size == n - 1))
    return out


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    filters: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``filters`` are failure conditions by letter, over the column ``text`` (by
    default :func:`text_filters`); the last one, E (or the next letter), is a
    text that a smaller id of the whole table has. Columns: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The texts are read once, for their flags and digests. Copies are found by
    digest, labels by id, on rows of a few bytes; hot texts meet by a broadcast.
    Each task packs its rows' flags, labels and parts into bitsets of NumPy and
    counts, by AND-NOT and popcount, what each filter removes after each set of
    others: of n filters n * 2^(n-1) rows a part, not n! * n. Only these are
    shuffled and summed; a part that holds most of the rows is no hot key. The
    n! orders are looked up in the sums.

    Edge cases: a null text is an empty one (it fails the first filter, and is a
    copy of other empty texts); a null part is ""; a null id is no smaller one and
    has no label; rows that repeat an id are rows of their own, and no copies of
    each other; of several labels of an id any counts; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    own = dict(filters or text_filters(F.col("text")))
    last = chr(ord(max(own)) + 1)
    letters = "".join(own) + last
    rows = materialise(base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in own.items()]), "flags")
    marked = labelled(earlier_copies(rows).withColumnRenamed("copy", last), labels, id_col)
    sums = partial_counts(marked, letters).groupBy("part", "key").agg(*[F.sum(c).alias(c) for c in SUMS])

    spark = docs.sparkSession
    weights = spark.createDataFrame(shares(letters), "key int, filter int, orders int, alone boolean")
    steps = spark.createDataFrame(every_order(letters), "filter_order string, step int, key int")
    by_filter = Window.partitionBy("part", "filter")  # of one part and filter: 2^(n-1) rows
    known = materialise(
        sums.join(F.broadcast(weights), "key")
        .withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(by_filter))
        .withColumn("unique_fails", F.sum(F.when(F.col("alone"), F.col("removed"))).over(by_filter)),
        "sums",
    )
    return known.join(F.broadcast(steps), "key").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
