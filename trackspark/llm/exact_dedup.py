"""Exact deduplication by a two-pass Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import (
    ASCII_SPACE,
    join_groups,
    materialise,
    scratch_path,
    without_ids,
)

#: Cells of a filter per row, and of one filter at most: 64 MB as bits.
CELLS_PER_ROW, MOST_CELLS = 16, 1 << 29
#: 64-bit words of a filter that one row of it holds.
SLOT_WORDS = 128


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def repeated_cells(hashes: DataFrame, cells: int) -> DataFrame:
    """slot, words: the cells in which ``hashes`` (cell) has two rows or more, as bits.

    Bit c % 64 of word c / 64 stands for cell c; a slot is an array of
    SLOT_WORDS words. Rows of one cell are counted before they are shuffled.
    """
    words = (
        hashes.groupBy("cell")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy(F.expr("cell div 64").alias("id"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits"))
    )
    every = hashes.sparkSession.range(cells // 64).join(words, "id", "left")
    word = F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.groupBy((F.expr(f"id div {SLOT_WORDS}")).alias("slot")).agg(
        F.transform(F.array_sort(F.collect_list(word)), lambda w: w["bits"]).alias("words")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_cells: int = MOST_CELLS
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the smallest id stays.

    The texts are read once and leave behind a table of ids and digests, in as
    many ranges of a hash of the digest as keep a range's filter at
    ``most_cells`` bits, whatever the number of rows. In each range the first
    pass counts the rows in a cell, 16 cells per row; cells with two rows or
    more are the filter, a bit per cell. It is broadcast, and the second pass
    probes it: a digest without its bit is certainly the only one of its kind,
    and its row goes straight to the result. Only the others, the copies and
    about one in 16 of the rest, are grouped by the full digest, which clears
    the filter's false alarms, so the result is exact.

    Edge cases: a null text is an empty one, and empty texts are one group; a
    null id is never smaller than another id, and a group of null ids only has
    a null keep_id, and all its rows stay, as nothing tells them apart. Rows
    that repeat both id and text are copies that share one fate. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    total = docs.count()
    ranges = max(1, -(-total * CELLS_PER_ROW // most_cells))
    cells = SLOT_WORDS * 64
    while cells < min(most_cells, total * CELLS_PER_ROW // ranges):
        cells *= 2
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    path = scratch_path(spark, "digests")
    own = docs.select(F.col(id_col).alias("id"), digest.alias("digest")).withColumn("hash", F.xxhash64("digest"))
    own = own.withColumn("range", F.pmod("hash", F.lit(ranges)).cast("int"))
    # Each task writes to the ranges' folders what it has for them: no shuffle.
    (own.write.partitionBy("range") if ranges > 1 else own.write).parquet(path)
    rows = spark.read.schema(own.schema).parquet(path)
    cell = F.pmod(F.expr(f"hash div {ranges}"), F.lit(cells))
    found = []
    for k in range(ranges):
        part = rows.filter(F.col("range") == k).withColumn("cell", cell)
        known = materialise(repeated_cells(part.select("cell"), cells), "repeated")  # most_cells bits
        word = F.expr(f"get(words, cast(cell div 64 % {SLOT_WORDS} as int))")
        bit = F.call_function("getbit", word, F.expr("cast(cell % 64 as int)"))
        probed = part.join(F.broadcast(known), F.expr(f"cell div {64 * SLOT_WORDS}") == F.col("slot"))
        found.append(materialise(probed.select("id", "digest", (bit == 1).alias("maybe")), "probed"))
    probed = found[0]
    for more in found[1:]:
        probed = probed.unionByName(more)

    maybe = probed.filter("maybe").select("id", "digest")
    groups = materialise(
        maybe.groupBy("digest").agg(
            F.min("id").alias("keep_id"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    alone = probed.filter("not maybe").select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return (
        join_groups(maybe, groups, "digest", "group_size", total, "inner")
        .unionByName(alone)
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of equal texts, all columns kept.

    Ids are taken to name documents; rows with a null id stay.
    """
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select(id_col)
    return without_ids(docs, materialise(gone, "copies"), id_col)
