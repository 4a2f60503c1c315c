"""Line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import broadcast_if_small, join_groups, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"

#: Frequent keys that may be sent to every task (about 12 bytes each).
LOOKUP_KEYS = 200_000
#: Slots of the lookup of frequent keys.
SLOTS = 1 << 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _folded(key: Column) -> Column:
    """A text that two keys share exactly if they are equal with A-Z in lower case.

    Spark's own lower() is fast but folds other letters too. So the text has
    what it gives and, for keys beyond ASCII, their other characters as they
    are. Only of the two letters whose lower case is in ASCII (the Kelvin sign
    and the dotted capital I) this would lose the place; their keys are
    translated letter by letter.
    """
    other = F.regexp_replace(key, "[\\x00-\\x7F]+", "")
    odd = F.contains(key, F.lit("\u212a")) | F.contains(key, F.lit("\u0130"))
    return (
        F.when(F.octet_length(key) == F.length(key), F.lower(key))
        .when(odd, F.concat(F.lit("\0"), F.translate(key, UPPER, LOWER)))
        .otherwise(F.concat(F.lower(key), F.lit("\0"), other))
    )


def _keys(lines: Column) -> Column:
    """A line's key as two hashes (96 bits); null for a key of no characters."""

    def fold(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE))
        return F.when(key != "", _folded(key))

    def hashes(folded: Column) -> Column:
        return F.when(
            folded.isNotNull(), F.struct(F.xxhash64(folded).alias("h"), F.hash(folded).alias("g"))
        )

    return F.transform(F.transform(lines, fold), hashes)


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line key: h, g, n_docs, first (id and position of the first line).

    Each document deals out its distinct keys with their first positions: its
    keys and positions are sorted, and each that differs from the one before is
    the first of its kind, so that many lines of one text take their sort. They
    are range-partitioned by key, document and position, so that a key of very
    many documents spans several partitions, and sorted by the same; each
    partition is streamed in that order and gives one row per key, and only
    those are merged.
    """
    # The range partitioning reads its input twice (to find the ranges first), so
    # the hashes, a few bytes a line, are a scratch table.
    keyed = docs.select(F.col(id_col).alias("id"), _keys(_lines(F.col(text_col))).alias("keys"))
    places = F.transform(
        "keys", lambda k, i: F.when(k.isNotNull(), F.struct(k["h"].alias("h"), k["g"].alias("g"), i.cast("long").alias("pos")))
    )

    def is_first(k: Column, i: Column) -> Column:
        before = F.get("places", i - 1)
        return (i == 0) | (k["h"] != before["h"]) | (k["g"] != before["g"])

    return (
        materialise(keyed, "line_keys")
        .select("id", F.array_sort(F.array_compact(places)).alias("places"))
        .select("id", F.explode(F.filter("places", is_first)).alias("key"))
        .select("key.h", "key.g", "id", "key.pos")
        .repartitionByRange("h", "g", "id", "pos")
        .sortWithinPartitions("h", "g", "id", "pos")
        .groupBy("h", "g")
        .agg(
            F.count("*").alias("n_docs"),
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "pos")).alias("first"),
        )
    )


def frequent_lines(
    docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The keys of ``line_occurrences`` that ``min_docs`` documents or more hold."""
    found = line_occurrences(docs, id_col, text_col).filter(F.col("n_docs") >= min_docs)
    return materialise(found, "frequent_lines")


def _drop_flags(
    docs: DataFrame, frequent: DataFrame, id_col: str, text_col: str, keep_first: bool
) -> DataFrame:
    """``docs`` with ``__drop``: for each line, whether its key is frequent.

    With ``keep_first``, but for the line where the key is met first.
    """
    by_lookup = frequent.count() <= LOOKUP_KEYS
    found = _flags_by_lookup(docs, frequent, text_col) if by_lookup else _flags_by_join(docs, frequent, id_col, text_col)
    if not keep_first:
        return found
    firsts = (
        frequent.select(F.col("first.id").alias("__first"), F.col("first.pos").alias("pos"))
        .groupBy("__first")
        .agg(F.collect_set("pos").alias("__stay"))  # a document's lines at most
    )
    firsts = broadcast_if_small(materialise(firsts, "first_lines"))
    stays = lambda d, i: d & ~F.coalesce(F.array_contains(F.col("__stay"), i), F.lit(False))
    return (
        found.join(firsts, F.col(id_col).eqNullSafe(F.col("__first")), "left")
        .withColumn("__drop", F.transform("__drop", stays))
        .drop("__first", "__stay")
    )


def _flags_by_lookup(docs: DataFrame, frequent: DataFrame, text_col: str) -> DataFrame:
    """Every task has the short list as an array of slots; no text is shuffled."""
    by_slot = (
        frequent.select(
            F.pmod("h", F.lit(SLOTS)).alias("slot"), F.struct("h", "g").alias("key")
        )
        .groupBy("slot")
        .agg(F.collect_list("key").alias("keys"))
    )
    slots = (
        frequent.sparkSession.range(SLOTS)
        .withColumnRenamed("id", "slot")
        .join(by_slot, "slot", "left")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "keys"))).alias("all"))
        .select(F.transform("all", lambda x: x["keys"]))
    )
    lookup = slots.scalar()
    held = lambda k: F.coalesce(
        F.array_contains(F.get(F.col("__slots"), F.pmod(k["h"], F.lit(SLOTS)).cast("int")), k),
        F.lit(False),
    )
    return (
        docs.withColumn("__keys", _keys(_lines(F.col(text_col))))
        .withColumn("__slots", lookup)
        .withColumn("__drop", F.transform("__keys", lambda k: k.isNotNull() & held(k)))
        .drop("__keys", "__slots")
    )


def _flags_by_join(docs: DataFrame, frequent: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keys meet the long list by a shuffle, hot ones by a broadcast; flags come back by row.

    Only hashes and places are shuffled for that. A row is known by its id and
    two hashes of its text: rows alike in these have equal flags. Rows meet
    their flags by a broadcast if few rows have any, and are shuffled otherwise.
    """
    row = F.struct(
        F.xxhash64(F.to_json(F.struct(id_col))).alias("i"), F.xxhash64(text_col).alias("a"), F.hash(text_col).alias("b")
    )
    keyed = docs.withColumn("__row", row)
    lines = materialise(
        keyed.select("__row", F.posexplode(_keys(_lines(F.col(text_col)))).alias("pos", "key")).filter("key is not null"),
        "line_places",
    )
    known = frequent.select(F.struct("h", "g").alias("key"), "n_docs")
    hits = (
        join_groups(lines, known, "key", "n_docs", lines.count(), "inner")
        .groupBy("__row")
        .agg(F.collect_set("pos").alias("__hits"))  # a document's lines at most
    )
    hits = broadcast_if_small(materialise(hits, "line_hits"))
    drop = F.transform(
        _lines(F.col(text_col)),
        lambda _, i: F.coalesce(F.array_contains(F.col("__hits"), i), F.lit(False)),
    )
    return keyed.join(hits, "__row", "left").withColumn("__drop", drop).drop("__hits", "__row")


def _bitmap(drop: Column) -> Column:
    """Keep bits by 64-bit word; words whose lines all stay are left out."""
    words = F.sequence(F.lit(0), F.floor((F.size(drop) - 1) / 64).cast("int"))

    def word(w: Column) -> Column:
        part = F.slice(drop, w * 64 + 1, 64)
        bits = F.transform(part, lambda d, i: F.when(d, F.lit(0)).otherwise(F.lit(1)).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), i))
        kept = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
        return F.struct(w.alias("word"), kept.alias("keep"), F.exists(part, lambda d: d).alias("cut"))

    cut = F.filter(F.transform(words, word), lambda x: x["cut"])
    return F.map_from_entries(F.transform(cut, lambda x: F.struct(x["word"], x["keep"])))


def with_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_first: bool = False,
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and keep_bits as in :func:`line_bitmaps`."""
    frequent = frequent_lines(docs, min_docs, id_col, text_col)
    return _drop_flags(docs, frequent, id_col, text_col, keep_first).withColumns(
        {
            "n_lines": F.size("__drop").cast("long"),
            "n_dropped": F.size(F.filter("__drop", lambda d: d)).cast("long"),
            "keep_bits": _bitmap(F.col("__drop")),
        }
    ).drop("__drop")


def line_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_first: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, keep_bits.

    A line's key is the line without ASCII white space at its ends and with A-Z
    in lower case. Keys of at least one character that are found in ``min_docs``
    documents or more lose all their lines; with ``keep_first`` all but the
    first one, by document id and position (ids must be unique then).
    ``keep_bits`` maps a word's number
    to its 64 keep bits (bit i of word w is line 64 w + i); words without a
    dropped line are not in it, so a document that loses nothing has an empty
    map. No text leaves the documents' own partitions.

    Edge cases: a null or empty text is one empty line, which stays; rows that
    repeat an id count as documents of their own; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_bitmaps(own, min_docs, "id", "text", keep_first)
    return found.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "keep_bits")


def apply_bitmap(text: Column, keep_bits: Column) -> Column:
    """The lines of a text that its bitmap keeps, joined by newlines."""

    def keeps(_, i: Column) -> Column:
        word = F.element_at(keep_bits, F.floor(i / 64).cast("int"))
        return F.coalesce(F.call_function("getbit", word, i % 64), F.lit(1)) == 1

    kept = F.array_join(F.filter(_lines(text), keeps), "\n")
    return F.when(F.size(keep_bits) == 0, F.coalesce(text, F.lit(""))).otherwise(kept)


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the lines of frequent keys cut from the texts, and counts.

    The texts are what :func:`apply_bitmap` leaves of them. Adds n_lines and
    n_dropped; edge cases as in :func:`line_bitmaps`.
    """
    own = docs.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("__all"),
    )
    found = with_bitmaps(own, min_docs, "__id", "__text")
    kept = apply_bitmap(F.col("__text"), F.col("keep_bits"))
    return found.select(
        *[(kept if c == text_col else F.col("__all").getField(c)).alias(c) for c in docs.columns],
        "n_lines",
        "n_dropped",
    )
