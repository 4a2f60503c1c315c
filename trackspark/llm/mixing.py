"""Mixing sources to target weights by Sainte-Laguë, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.common import (
    NOT_SPACE,
    RUN_ROWS,
    broadcast_if_small,
    materialise,
    ranked,
)

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """``sources`` (src, source, size, rows) with the target of each.

    The sources share ``share`` times all words by weight. No target is above
    ``most`` times its source's size; what is cut off goes to the other sources
    by weight, until none is above. Each round of that is one sum over the
    table of sources, and the level per unit of weight only rises.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    table = materialise(
        ranked(sources, order, "source_ranks")
        .withColumn("weight", weight)
        .withColumn("most", F.col("size") * F.lit(float(most))),
        "sources",
    )
    total = table.agg(F.sum("size")).first()[0] or 0
    level, wanted = -1.0, share * total
    fixed, free = 0.0, table.agg(F.sum("weight")).first()[0] or 0.0
    while free > 0 and (now := (wanted - fixed) / free) > level:
        level = now
        full = F.col("weight") * F.lit(level) >= F.col("most")
        fixed, free = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
    target = F.least(F.col("most"), F.col("weight") * F.lit(max(level, 0.0)))
    return table.withColumn("target", target).drop("most", "weight")


def apportion(parties: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``parties`` (with votes, and seats of the whole group) with ``quota``.

    Sainte-Laguë gives a group's seats to the highest quotients votes / (2k+1).
    With n parties the dividing quotient lies between those at which the votes
    round to n/2 seats more and n/2 seats less than there are. So each party's
    seats up to the lower bound are certain and those beyond the upper one are
    out, and only the quotients in between, 2n at most in a group however many
    seats there are, are ranked. Ties go by ``order``.
    """
    whole = Window.partitionBy(*group)
    votes, seats = F.col("votes"), F.col("seats")
    all_votes, n = F.sum("votes").over(whole), F.count("*").over(whole)

    def rounded(number: Column) -> Column:
        part = F.when(all_votes > 0, votes * F.greatest(number, F.lit(0.0)) / all_votes)
        return F.floor(F.coalesce(part, F.lit(0.0)) + 0.5).cast("long")

    bounds = materialise(
        parties.withColumn("sure", rounded(seats - n / 2))
        .withColumn("limit", rounded(seats + n / 2) + 1)
        .withColumn("left", seats - F.sum("sure").over(whole)),
        "bounds",
    )
    rivals = (
        bounds.filter("votes > 0 and limit > sure")
        .select("*", F.explode(F.sequence("sure", F.col("limit") - 1)).alias("k"))
        .withColumn("quotient", votes / (2 * F.col("k") + 1))
    )
    turn = Window.partitionBy(*group).orderBy(F.desc("quotient"), *order, "k")
    won = (
        rivals.withColumn("turn", F.row_number().over(turn))
        .filter("turn <= left")
        .groupBy(*group, *[c for c in order if c not in group])
        .agg(F.count("*").alias("more"))
    )
    keys = [*group, *[c for c in order if c not in group]]
    return (
        bounds.join(won, keys, "left")
        .withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0)))
        .drop("sure", "limit", "left", "more")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 16,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    A source's words form blocks of ``block_words``. Sainte-Laguë gives each
    source its number of blocks by target, and each shard of a source (a hash
    of the id; large sources have many, of about 20,000 rows) its part of them
    by size. A shard lists its documents in an order seeded by ``seed`` and
    takes its quota of blocks from the start, going round again when the quota
    is above its size. So ``taken`` is a document's size times the full rounds,
    plus what the last round covers of it: at most one document of a shard is
    taken in part, none more than ``most`` (2) times (for a ``most`` that is no
    whole number: the next whole number), and a rerun agrees. Sources are ranked
    and their quotients ordered in one task, which is one row per source: names
    of sources are taken to be few (some hundred thousand rows are no burden).

    Edge cases: a null text has no words; a null source is a source, last by
    rank; rows that repeat an id are documents of their own; sources without
    words get nothing; an empty table gives an empty result. Other columns are
    ignored.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"),
        ),
        "sizes",
    )
    by_source = rows.groupBy("src", "source").agg(
        F.sum("size").alias("size"), F.count("*").alias("rows")
    )
    targets = source_targets(by_source, weights, share, most)
    parties = targets.withColumn("votes", F.col("target")).withColumn("all", F.lit(0))
    seats = F.round(F.sum("target").over(Window.partitionBy("all")) / block_words).cast("long")
    quotas = materialise(
        apportion(parties.withColumn("seats", seats), ["all"], ["src"])
        .withColumn("shards", F.ceil(F.col("rows") / RUN_ROWS).cast("long"))
        .select("src", F.col("size").alias("source_size"), "target", "quota", "shards"),
        "source_quotas",
    )
    small = broadcast_if_small(quotas)
    dealt = materialise(
        rows.join(small, "src")
        .withColumn("shard", F.pmod("key", F.col("shards")))
        .select("id", "size", "src", "source_size", "target", "key", "shard", F.col("quota").alias("seats")),
        "dealt",
    )
    shards = dealt.groupBy("src", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("seats").alias("seats")
    )
    shard_quotas = materialise(
        apportion(shards.withColumn("votes", F.col("shard_size").cast("double")), ["src"], ["shard"])
        .withColumn(
            "words", F.least(F.col("quota") * block_words, F.floor(F.col("shard_size") * most).cast("long"))
        )
        .select("src", "shard", "shard_size", "words"),
        "shard_quotas",
    )
    before = (
        Window.partitionBy("src", "shard")
        .orderBy("key", "id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rounds = F.coalesce(F.expr("words div nullif(shard_size, 0)"), F.lit(0))
    rest = F.col("words") - rounds * F.col("shard_size")
    return (
        dealt.withColumn("start", F.sum("size").over(before) - F.col("size"))
        .join(broadcast_if_small(shard_quotas), ["src", "shard"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (
                rounds * F.col("size")
                + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
            ).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix takes them: whole, as often as :func:`mix` says, all columns.

    A document of which the mix takes a part of a round is there once for it,
    so a shard of a source has at most one document more than its quota of
    words. Documents of no words are not in a mix of words. Ids are taken to
    name documents: rows that repeat one get the largest number of their copies.
    """
    taken = mix(docs, id_col=id_col, **options).filter("taken > 0")
    copies = taken.groupBy(F.col(id_col).alias("__id")).agg(
        F.max(F.ceil(F.col("taken") / F.col("size")).cast("int")).alias("__copies")
    )
    copies = broadcast_if_small(materialise(copies, "copies"))
    return (
        docs.join(copies, docs[id_col].eqNullSafe(F.col("__id")))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*docs.columns)
    )
