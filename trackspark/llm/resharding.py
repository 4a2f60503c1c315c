"""Resharding by minimum-cost flow: fewest bytes moved to near-equal shards."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.common import RUN_ROWS, broadcast_if_small, materialise

#: The source of rows without a shard.
NOWHERE = -1


def min_cost_transfers(
    sizes: Sequence[int], capacities: Sequence[int], cost=lambda old, new: int(old != new)
) -> dict[tuple[int, int], int]:
    """Bytes to send from each old shard to each new one, at the least cost.

    Cheapest augmenting paths from shards with bytes left to shards with room
    left; ``cost`` is that of one byte (0 where it stays, 1 where it moves).
    The graph has one node per shard, whatever the data. The capacities hold
    the sizes in total.
    """
    left, room = list(sizes), list(capacities)
    n, m = len(left), len(room)
    flow: dict[tuple[int, int], int] = {}
    while any(left):
        # Shortest distances over old shards (0..n-1) and new ones (n..n+m-1).
        far = float("inf")
        dist = [0 if left[i] else far for i in range(n)] + [far] * m
        came: list[int | None] = [None] * (n + m)
        todo = deque(i for i in range(n) if left[i])
        while todo:
            u = todo.popleft()
            if u < n:
                steps = [(n + j, cost(u, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n))]
            for v, price in steps:
                if dist[u] + price < dist[v]:
                    dist[v], came[v] = dist[u] + price, u
                    if v not in todo:
                        todo.append(v)
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v])
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        back = [flow[v, u - n] for u, v in zip(path, path[1:]) if u >= n]
        amount = min([left[path[0]], room[end - n], *back])
        for u, v in zip(path, path[1:]):
            arc, sign = ((u, v - n), 1) if u < n else ((v, u - n), -1)
            flow[arc] = flow.get(arc, 0) + sign * amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return {arc: x for arc, x in flow.items() if x}


def reshard(
    docs: DataFrame,
    shards: int = 16,
    old_shard: Column | None = None,
    old_shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, old_shard, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 1. ``old_shard`` gives the
    present shards, whatever their numbers (by default a hash of the id, over
    ``old_shards``, or as many shards as there will be); the new ones get equal
    capacities. Rows without a shard (null or negative) are one more source, all
    of which moves.
    Minimum-cost flow over the shards' sizes says how many bytes each sends to
    each. A shard's rows form blocks: by magnitude (power of two of the size),
    the largest first, and within it by a hash of the id, about 20,000 rows each
    at most, so that no sorted run grows with the data. The bytes that leave are
    ranges at the end of that order, where rows are small. A row goes where its
    middle goes, so a shard is off its capacity by half a small row per transfer
    or so. ``slot`` numbers a shard's rows from 0 without a gap.

    Edge cases: a null text has size 1 and the checksum of an empty one; rows
    that repeat an id or a text, or have none, are rows of their own, spread by
    id and text (only rows alike in both share a block); an empty table gives an empty result. Other columns are
    ignored.
    """
    old_shards = old_shards or shards
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows without an id, or that repeat one, are spread by their texts.
    known = F.col(id_col).isNotNull()
    hashed = F.when(known, F.xxhash64(F.lit("shard"), F.col(id_col))).otherwise(F.xxhash64(F.lit("shard"), text))
    place = F.pmod(hashed, F.lit(old_shards)) if old_shard is None else old_shard
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            place.cast("int").alias("old_shard"),
            F.greatest(F.coalesce(place.cast("int"), F.lit(NOWHERE)), F.lit(NOWHERE)).alias("source"),
            F.xxhash64(F.lit("block"), F.col(id_col), F.xxhash64(text)).alias("key"),
        ),
        "shard_rows",
    )
    of_old = {
        r["source"]: r
        for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    }  # one row per shard
    sources = sorted(of_old)
    sizes = [of_old[i]["size"] for i in sources]
    total = sum(sizes)
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    moves = min_cost_transfers(sizes, capacities, lambda old, new: int(sources[old] != new))

    ranges, spark = [], docs.sparkSession
    for k, i in enumerate(sources):
        at = 0
        for j in sorted((j for a, j in moves if a == k), key=lambda j: (j != i, j)):
            ranges.append((i, at, at + moves[k, j], j))
            at += moves[k, j]
    segments = spark.createDataFrame(ranges, "source int, low long, high long, shard int")

    blocks = max([1, *(-(-r["n"] // RUN_ROWS) for r in of_old.values())])
    magnitude = F.floor(F.log2("size")).cast("long")
    rows = rows.withColumn("block", (63 - magnitude) * blocks + F.pmod("key", F.lit(blocks)))
    starts = materialise(
        rows.groupBy("source", "block")
        .agg(F.sum("size").alias("bytes"))
        .withColumn(
            "block_start",
            F.sum("bytes").over(Window.partitionBy("source").orderBy("block")) - F.col("bytes"),
        )
        .drop("bytes"),
        "blocks",
    )
    by_block = Window.partitionBy("source", "block").orderBy("key", "id", "size", "text_crc32")
    by_piece = Window.partitionBy("source", "block", "shard").orderBy("key", "id", "size", "text_crc32")
    placed = (
        rows.withColumn("in_block", F.sum("size").over(by_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(broadcast_if_small(starts), ["source", "block"])
        .withColumn("at", F.col("block_start") + F.col("in_block") + F.expr("size div 2"))
        .alias("r")
        .join(
            F.broadcast(segments.alias("s")),  # one row per pair of shards at most
            (F.col("r.source") == F.col("s.source")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")),
        )
        .select("id", "size", "text_crc32", "key", "old_shard", "r.source", "block", "shard")
        .withColumn("in_piece", F.row_number().over(by_piece) - 1)
    )
    placed = materialise(placed, "placed")
    pieces = placed.groupBy("shard", "source", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("source", "block")
    pieces = materialise(
        pieces.withColumn("piece_start", F.sum("n").over(before) - F.col("n")).drop("n"), "pieces"
    )
    return placed.join(broadcast_if_small(pieces), ["shard", "source", "block"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "old_shard",
        "shard",
        (F.col("piece_start") + F.col("in_piece")).cast("long").alias("slot"),
    )


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Rewrite, below ``path``, the folders of the shards that gain or lose rows.

    ``docs`` holds the rows and ``plan`` is the result of :func:`reshard` on
    them (a scratch table is best). Folders are named ``shard=N`` (Hive's default
    name for rows without a shard); those of other shards are not touched. Those
    of shards that have no rows any more are deleted once the others are written.
    Ids must be unique and not null. Returns the numbers of the shards that were
    written or emptied.
    """
    moved = plan.filter(~F.col("old_shard").eqNullSafe(F.col("shard")))
    touched = {
        r[0] for r in moved.select(F.explode(F.array("old_shard", "shard"))).distinct().collect()
    }  # shard numbers
    if touched:
        where = plan.filter(F.col("shard").isin([n for n in touched if n is not None])).select(
            F.col(id_col).alias("__id"), F.col("shard"), F.col("slot").alias("__slot")
        )
        docs = docs.drop("shard")
        (
            docs.join(where, docs[id_col] == F.col("__id"))
            .drop("__id")
            .repartition("shard", F.floor(F.col("__slot") / RUN_ROWS))
            .sortWithinPartitions("shard", "__slot")
            .drop("__slot")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("shard")
            .parquet(path)
        )
        filled = {r[0] for r in plan.select("shard").distinct().collect()}  # shard numbers
        jvm, hadoop = docs.sparkSession.sparkContext._jvm, docs.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for n in touched - filled:
            name = "__HIVE_DEFAULT_PARTITION__" if n is None else n
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={name}")
            folder.getFileSystem(hadoop).delete(folder, True)
    return sorted(n for n in touched if n is not None)
