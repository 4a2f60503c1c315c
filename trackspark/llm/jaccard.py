"""N-gram Jaccard join: prefix filtering under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trackspark.llm.common import join_groups, materialise, narrow_files, only_ids, small_batches, tidy, without_ids

#: Bytes of text whose shingles are worked out at a time.
CHUNK_BYTES = 1 << 18
#: A token is common from so many documents on (more, if too many tokens are).
COMMON_DOCS = 16
#: Common tokens that every task may know: 8 MB.
COMMON_TOKENS = 1_000_000
#: Bits (as a power of two) that tell tokens of one document from others, four
#: per counted token but 32 MB at most. Beyond some hundred million tokens they
#: fill up; then nearly all prefix tokens are posted, which is about a tenth of a
#: set (at 90 percent) and no more.
LEAST_BITS, MOST_BITS = 20, 28
#: Seeds of the further orders, under which candidates must meet again.
ORDERS = (0x51ED27, 0xC2B2AE)
#: Columns of a set's prefixes under them.
PREFIXES = tuple(f"order{k}" for k in range(len(ORDERS)))
#: 64-bit words of a set's sketch.
SKETCH = tuple(f"s{k}" for k in range(4))
#: And of its wide one, for the last step, whose pairs are near but mostly do not link.
WIDE = tuple(f"w{k}" for k in range(16))
#: Pivots of a token's bucket, and rounds of pairing nodes with pivots.
PIVOTS, ROUNDS = 4, 3
#: Steps of label propagation between these rounds, which need no final labels.
HOPS = 2
#: Members of a token's bucket that one task compares with each other; larger buckets are dealt to pieces.
BUCKET = 1 << 11
#: Rows of buckets, and pairs of them, that are looked at together.
ROWS_TOGETHER, PAIRS_TOGETHER = 1 << 15, 1 << 17
#: Bytes of cells that a task counts together.
COUNT_BYTES = 48 << 20

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit image of each number (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES * 2)
            self.up, self.down = (self._series(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


_powers = _Powers()


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of adjacent texts, and where each text's words begin."""
    n = len(data)
    folded = _FOLD[data]
    inside = ~_SPACE[folded]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])  # whether the byte before is in a word
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~after))
    up, down = _powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[folded] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes.

    Words are runs of other bytes than ASCII white space, with A-Z in lower
    case. A text of fewer than ``width`` words has one shingle, of all of them;
    one without words (or null) has none.
    """
    column = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    everything = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES)) - 1)
        end = min(end, len(column))
        own = offsets[at : end + 1] - offsets[at]
        words, first = _word_hashes(everything[offsets[at] : offsets[end]], own)
        rolled = words[: max(0, len(words) - width + 1)].copy()
        for k in range(1, width):
            rolled = mixed(rolled * np.uint64(_BASE) + words[k : k + len(rolled)])
        for i in range(end - at):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                one = words[a : a + 1].copy()
                for k in range(a + 1, b):
                    one = mixed(one * np.uint64(_BASE) + words[k : k + 1])
                yield mixed(one + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
        at = end


def _known_bits(percent: int) -> int:
    """Document counts are known of tokens below two to this power.

    In an order by hash, prefixes lie at the low end; half as long again or
    more is counted, so that enough tokens are left beside those that repeat.
    """
    return 62 if percent >= 85 else 63 if percent >= 70 else 64


def _cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    """40-bit cells of the tokens whose document counts are to be known."""
    if bits < 64:
        tokens = tokens[tokens < np.uint64(1 << bits)]
    return tokens >> np.uint64(bits - 40)


def _needed(n: int, percent: int) -> int:
    """The fewest tokens that a set of n shares with any set it links to."""
    return (percent * n + 99) // 100


class Frequencies:
    """What is known of the tokens' document counts, in bounded memory.

    A bit per group of cells says whether one of them is in two documents or
    more: a token without it is in one only. ``common`` lists cells in many.
    """

    def __init__(self, shared: np.ndarray, common: np.ndarray, bits: int):
        self.shared, self.common, self.bits = shared, common, bits
        self.unit = len(shared).bit_length() + 2  # the bitmap's bits, as a power of two

    def tiers(self, tokens: np.ndarray) -> np.ndarray:
        """0: in one document; 1: in a few; 2: not counted; 3: in many."""
        known = tokens < np.uint64(1 << self.bits) if self.bits < 64 else np.ones(len(tokens), bool)
        cell = np.where(known, tokens >> np.uint64(self.bits - 40), np.uint64(0))
        bit = cell >> np.uint64(40 - self.unit)
        held = self.shared[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1
        tier = np.where(known, held, 2)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, cell), len(self.common) - 1)
            tier[known & (self.common[at] == cell)] = 3
        return tier


def _prefix(
    tokens: np.ndarray, known: Frequencies, seed: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a set, and their tiers: rare ones first, then by hash.

    Of two sets that link, the prefixes under one order share a token.
    """
    n = len(tokens)
    length = n - _needed(n, percent) + 1
    tier = known.tiers(tokens)
    order = np.lexsort((mixed(tokens ^ np.uint64(seed)) if seed else tokens, tier))[:length]
    return tokens[order], tier[order]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def profiles(docs: DataFrame, width: int, percent: int, shards: int) -> DataFrame:
    """Rows of two kinds: of each document, id, n and node (a hash of its set);
    and of each task, its tokens' cells by shard, as bytes."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, cells = [], [], []
            for tokens in shingle_sets(batch.column(1), width):
                sizes.append(len(tokens))
                nodes.append(mixed(tokens).sum(dtype=np.uint64))
                cells.append(_cells(tokens, bits))
            none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            node = pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64(), mask=np.array(sizes) == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), node, *none], names=names)
            every = np.sort(np.concatenate(cells)) if cells else np.zeros(0, np.uint64)
            cuts = np.searchsorted(every, [(k << 40) // shards for k in range(shards + 1)])
            packed = [_packed(every[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
            which = [k for k in range(shards) if cuts[k + 1] > cuts[k]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(which), batch.column(0).type),
                    pa.nulls(len(which), pa.int64()),
                    pa.nulls(len(which), pa.int64()),
                    pa.array(which, pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                names=names,
            )

    bits = _known_bits(percent)
    names = ["id", "n", "node", "shard", "cells"]
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidy(profile), f"id {kind}, n long, node long, shard int, cells binary")


def _packed(cells: np.ndarray) -> bytes:
    low, high = cells.astype("<u4"), (cells >> np.uint64(32)).astype(np.uint8)
    return high.tobytes() + low.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    high, low = np.frombuffer(data, np.uint8, n), np.frombuffer(data, "<u4", n, n)
    return (high.astype(np.uint64) << np.uint64(32)) | low


def frequencies(parts: DataFrame, percent: int, shards: int) -> Frequencies:
    """Count the cells of all tasks, shard by shard.

    What comes to the driver is a bitmap and a list of bounded sizes. They only
    set the order of tokens, so that a full bitmap or a list cut short (at the
    document count where it fits) changes the speed and not the result.
    """
    held = parts.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0]
    bitmap = min(MOST_BITS, max(LEAST_BITS, (4 * (held // 5)).bit_length()))
    unit = 1 << (bitmap - 3)  # bytes of the bitmap
    pieces = max(1, -(-held // (shards * COUNT_BYTES)))
    shards = shards * pieces

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's cells in ``pieces``, so that no group outgrows a task."""
        for batch in batches:
            which, packed = [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = _unpacked(x.as_py())
                cuts = np.searchsorted(cells, [((k * pieces + i) << 40) // shards for i in range(pieces + 1)])
                for i in range(pieces):
                    if cuts[i + 1] > cuts[i]:
                        which.append(k * pieces + i)
                        packed.append(_packed(cells[cuts[i] : cuts[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(packed, pa.binary())], names=["shard", "cells"])

    if pieces > 1:
        parts = parts.mapInArrow(tidy(cut), "shard int, cells binary")

    def count(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        every = np.concatenate([_unpacked(x.as_py()) for x in group.column("cells")])
        cells, n = np.unique(every, return_counts=True)
        low = (k << bitmap) // shards >> 3
        high = min(unit, (((k + 1) << bitmap) // shards >> 3) + 1)
        flags = np.zeros((high - low) * 8, bool)
        flags[(cells[n > 1] >> np.uint64(40 - bitmap)).astype(np.int64) - low * 8] = True
        many = n >= COMMON_DOCS
        return pa.table(
            {
                "cell": pa.concat_arrays([pa.array([low], pa.int64()), _long(cells[many])]),
                "n": pa.concat_arrays([pa.array([0], pa.int64()), pa.array(n[many], pa.int64())]),
                "bits": pa.array([np.packbits(flags).tobytes()] + [None] * int(many.sum()), pa.binary()),
            }
        )

    found = materialise(
        parts.groupBy("shard").applyInArrow(count, "cell long, n long, bits binary"), "frequencies"
    )
    shared = np.zeros(unit, np.uint8)
    for r in found.filter("n = 0").select("cell", "bits").toLocalIterator():  # 32 MB in all
        part = np.frombuffer(r["bits"], np.uint8)
        shared[r["cell"] : r["cell"] + len(part)] |= part
    listed = found.filter("n > 0")
    by_size = listed.groupBy(F.floor(F.log2("n")).alias("size")).count().collect()  # 64 rows at most
    line, held = 64, 0
    for r in sorted(by_size, key=lambda r: -r["size"]):
        if held + r["count"] > COMMON_TOKENS:
            break
        held, line = held + r["count"], r["size"]
    rows = listed.filter(F.floor(F.log2("n")) >= line).select("cell").toArrow()
    common = np.sort(rows.column(0).to_numpy().view(np.uint64))
    return Frequencies(shared, common, _known_bits(percent))


def postings(docs: DataFrame, known, width: int, percent: int) -> DataFrame:
    """token, node, n, at of the prefix tokens of each set that other sets may hold.

    ``at`` is the token's place in the prefix.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for own in shingle_sets(batch.column(1), width):
                n = len(own)
                if 100 * n >= percent * (n + 1):  # else no other set is near enough
                    prefix, tier = _prefix(own, known.value, 0, percent)
                    places.append(np.flatnonzero(tier > 0))
                    prefix = prefix[tier > 0]
                    tokens.append(prefix)
                    nodes.append(np.full(len(prefix), mixed(own).sum(dtype=np.uint64)))
                    sizes.append(np.full(len(prefix), n))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(np.concatenate(tokens)),
                        _long(np.concatenate(nodes)),
                        pa.array(np.concatenate(sizes), pa.int32()),
                        pa.array(np.concatenate(places), pa.int32()),
                    ],
                    names=["token", "node", "n", "at"],
                )

    return docs.mapInArrow(tidy(post), "token long, node long, n int, at int")


def _sketch(tokens: np.ndarray, words: int) -> np.ndarray:
    """Parities of the tokens by cell: two sets differ in as many tokens as cells, or more."""
    cells = np.bincount((tokens & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((cells & 1).astype(bool), bitorder="little").view("<i8")


def candidate_sets(docs: DataFrame, known, width: int, percent: int) -> DataFrame:
    """node, n, both sketches, its prefixes under the further orders, and its tokens as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bits, sketches, wide = [], [], [], [], []
            prefixes: list[list] = [[] for _ in PREFIXES]
            for own in shingle_sets(batch.column(1), width):
                nodes.append(int(mixed(own).sum(dtype=np.uint64).view(np.int64)))
                sizes.append(len(own))
                bits.append(own.tobytes())
                sketches.append(_sketch(own, len(SKETCH)))
                wide.append(_sketch(own, len(WIDE)))
                for k, seed in enumerate(ORDERS):
                    prefixes[k].append(_prefix(own, known.value, seed, percent)[0].astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    *[pa.array([x[k] for x in sketches], pa.int64()) for k in range(len(SKETCH))],
                    *[pa.array([x[k] for x in wide], pa.int64()) for k in range(len(WIDE))],
                    *[pa.array(f, pa.list_(pa.int32())) for f in prefixes],
                    pa.array(bits, pa.binary()),
                ],
                names=["node", "n", *SKETCH, *WIDE, *PREFIXES, "tokens"],
            )

    words = "".join(f"{c} long, " for c in SKETCH + WIDE)
    arrays = "".join(f"{c} array<int>, " for c in PREFIXES)
    return docs.mapInArrow(tidy(sets), f"node long, n int, {words}{arrays}tokens binary")


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted tokens) link."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _distance(a: str, b: str, sketch: tuple[str, ...] = SKETCH) -> Column:
    """Cells in which the sketches of two structs differ."""
    words = [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in sketch]
    return sum(words[1:], words[0])


def may_link(a: str, b: str, percent: int, sketch: tuple[str, ...] = SKETCH) -> Column:
    """What must hold of two structs (node, n, at of a token they share, sketch) that link.

    Their sizes are near; the token is as early in both as the first one that
    they share must be; and the sets, so their sketches as well, differ in few
    tokens.
    """
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    parts = F.lit(100 + percent)

    def least(total: Column) -> Column:
        """The fewest tokens that two sets of so many in all have in common."""
        return F.floor((F.lit(percent) * total + parts - 1) / parts)

    both = least(x + y)
    early = (F.col(f"{a}.at") <= x - both) & (F.col(f"{b}.at") <= y - both)
    few = _distance(a, b, sketch) <= x + y - 2 * both
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & early & few


def linked(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of the ``pairs`` (a, b) that link.

    First the pair must share a prefix token under each further order; only
    then do the two whole sets meet and are counted.
    """
    def side(end: str, columns: list[str]) -> DataFrame:
        return sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])

    meet = [F.arrays_overlap(f"{o}_a", f"{o}_b") for o in PREFIXES]
    every = meet[0]
    for m in meet[1:]:
        every = every & m
    prefixes = list(PREFIXES)
    left = pairs.join(side("a", prefixes), "a").join(side("b", prefixes), "b").filter(every)
    files = narrow_files(pairs.sparkSession)
    left = materialise(left.select("a", "b").repartition(files), f"{name}_candidates")
    whole = left.join(side("a", ["tokens"]), "a").join(side("b", ["tokens"]), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                keep.append(_links(x, y, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = whole.select("a", "b", "tokens_a", "tokens_b").mapInArrow(tidy(verify), "a long, b long")
    return materialise(found.repartition(files), name)


def components(links: DataFrame, known: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """node, label: the smallest node that links (a, b) lead to.

    Each round gives every node the smallest label around it and then its
    label's own label, so paths shrink by half or more; minima are taken before
    the shuffle, so a node of very many links is no burden. ``known`` are labels
    by some of the links, to begin with. Stopped after so many ``rounds``, labels
    are nodes that links lead to, but not the smallest ones everywhere.
    """
    files = narrow_files(links.sparkSession)
    both = materialise(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(files),
        "both_ways",
    )
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    if known is not None:
        known = known.withColumnRenamed("label", "before")
        labels = labels.join(known, "node", "left").select("node", F.least("label", "before").alias("label"))
    labels, turn = materialise(labels.coalesce(files), "labels"), 0
    while True:
        turn += 1
        around = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        hooked = materialise(
            labels.join(around, F.col("node") == F.col("a"))
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            .coalesce(files),
            "hooked",
        )
        own = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = hooked.join(own, "label").select("node", "old", F.least("label", "above").alias("label"))
        seen = Observation()
        labels = materialise(
            jumped.observe(seen, F.count_if(F.col("old") != F.col("label")).alias("changed")).select("node", "label").coalesce(files),
            "labels",
        )
        if not seen.get["changed"] or turn == rounds:
            return labels


def nearest_pivots(placed: DataFrame, likely: Column, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each node with the nearest pivot that it may link with.

    ``placed`` has token, x (node, n, at, sketch) and label; pivots are the
    members of a token's bucket that are first by ``likely``, one of each of
    PIVOTS parts of it. Nodes with one label are not paired. A bucket's members
    meet its few pivots; one of very many members meets them by a broadcast.
    """
    part = F.pmod(F.xxhash64(F.lit(turn), F.lit("part"), "x.node"), F.lit(PIVOTS))
    pivots = (
        placed.groupBy("token", part.alias("part"))
        .agg(
            F.max_by(F.struct("x", "label"), F.struct(likely, F.col("x.node"))).alias("y"),
            F.count("*").alias("size"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        )
        .groupBy("token")
        .agg(
            F.collect_list("y").alias("pivots"),  # PIVOTS at most
            F.sum("size").alias("members"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
        .filter("low <> high")
        .select("token", "members", "pivots")
    )
    pivots = materialise(pivots, "pivots")
    met = join_groups(placed.select("token", "x", "label"), pivots, "token", "members", placed.count(), "inner")
    return (
        met.select("x", "label", F.explode("pivots").alias("p"))
        .select("x", "label", F.col("p.x").alias("y"), F.col("p.label").alias("label_y"))
        .filter((F.col("label") != F.col("label_y")) & may_link("x", "y", percent))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), _distance("x", "y").alias("away"))
        .groupBy("a")
        .agg(F.min(F.struct("away", "b")).alias("nearest"))
        .select("a", F.col("nearest.b").alias("b"))
    )


def _near(n: np.ndarray, at: np.ndarray, wide: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`may_link` of pairs of rows (i, j): those that may, and the cells in which their sketches differ."""
    x, y = n[i], n[j]
    both = (percent * (x + y) + 99 + percent) // (100 + percent)
    ok = np.flatnonzero((at[i] <= x - both) & (at[j] <= y - both) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)))
    i, j, most = i[ok], j[ok], (x + y - 2 * both)[ok]
    away = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int32)
    ok = np.flatnonzero(away <= most)
    return i[ok], j[ok], away[ok]


def _met(rows: dict[str, np.ndarray], starts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, low, high, away of the pairs of rows in one group (``starts``) and of different labels that may link.

    Rows of the group's main label need no pair among themselves; two others meet once.
    """
    node, label, n, at = rows["node"], rows["label"], rows["n"].astype(np.int64), rows["at"].astype(np.int64)
    wide = np.column_stack([rows[c].view(np.uint64) for c in WIDE])
    main = label == rows["main"]
    # Of a bucket in pieces, the rows of one piece meet those of the other.
    apart, second = rows["i"] != rows["j"], rows["own"] == rows["j"]
    sizes = np.diff(np.append(starts, len(node)))
    minor = np.flatnonzero(~main)
    group = np.searchsorted(starts, minor, "right") - 1
    first, met = starts[group], sizes[group]
    ends = np.cumsum(met)
    start = 0
    while start < len(minor):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_TOGETHER, "right")))
        m = met[start:stop]
        y = np.repeat(minor[start:stop], m)
        x = np.arange(len(y)) + np.repeat(first[start:stop] - (ends[start:stop] - m - done), m)
        start = stop
        ok = (label[x] != label[y]) & (main[x] | (node[x] < node[y])) & (~apart[y] | (second[x] != second[y]))
        x, y, away = _near(n, at, wide, x[ok], y[ok], percent)
        if len(x):
            ends_of = [np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]
            ends_of += [np.minimum(label[x], label[y]), np.maximum(label[x], label[y])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ends_of), pa.array(away, pa.int32())], names=["a", "b", "low", "high", "away"])


def cross_pairs(open_rows: DataFrame, percent: int) -> DataFrame:
    """a, b, low, high, away: pairs of nodes of different components (low, high) that share a token and may link.

    ``open_rows`` has token, members (of its bucket), main (its most frequent
    label), label, node, n, at and the wide sketch. Nodes of the main component
    are not paired with each other. Pairs are the one thing here that can grow
    with the square of a bucket, so they are looked at in arrays, and are no
    rows before they may link; a bucket of more than BUCKET members is dealt to
    pieces, whose pairs are tasks' groups.
    """
    pieces = F.ceil(F.col("members") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64(F.lit("piece"), "node"), pieces).cast("int")
    dealt = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "main", "label", "node", "n", "at", *WIDE)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, enough = 0, ROWS_TOGETHER

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """The pairs of the held groups, but for the last one, which may go on."""
            nonlocal held, count, enough
            table = pa.Table.from_batches(held).combine_chunks()
            rows = {c: table.column(c).to_numpy() for c in table.column_names}
            new = np.ones(len(table), bool)
            new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("token", "i", "j")], axis=0)
            starts = np.flatnonzero(new)
            end = len(table) if last else starts[-1]
            held = table.slice(end).to_batches()
            count = len(table) - end
            enough = count + ROWS_TOGETHER
            yield from _met({c: v[:end] for c, v in rows.items()}, starts[starts < end], percent)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= enough:
                yield from whole(False)
        if count:
            yield from whole(True)

    grouped = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return grouped.mapInArrow(tidy(pairs), "a long, b long, low long, high long, away int").distinct()


def joined_across(
    cross: DataFrame, sets: DataFrame, links: DataFrame, labels: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """All links, and the labels that they give, once the pairs of ``cross`` are verified.

    ``cross`` has pairs (a, b) with their components so far (low, high) and the
    distance of their sketches. Of each pair of components the nearest pair of
    nodes comes first; most of the others are within one component then, and
    need no verification.
    """
    nearest = materialise(
        cross.groupBy("low", "high")
        .agg(F.min(F.struct("away", "a", "b")).alias("nearest"))
        .select("nearest.a", "nearest.b"),
        "nearest",
    )
    found = linked(nearest, sets, percent, "cross_links")
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = components(links, labels)
    now = {end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in "ab"}
    rest = (
        cross.select("a", "b")
        .join(nearest, ["a", "b"], "left_anti")
        .join(now["a"], "a", "left")
        .join(now["b"], "b", "left")
        .filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
        .select("a", "b")
    )
    found = linked(materialise(rest, "rest"), sets, percent, "rest_links")
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = components(links, labels)
    return links, labels


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Two documents link when 100 times the shingles that they share is at least
    ``percent`` times those that either has; component_id is the smallest id
    that links lead to. The result is exact (but for hashes of 64 bits).

    1. Documents with one set of shingles are one node. A first reading of the
       texts gives each its node and counts, for tokens that can be in a
       prefix, how many documents hold them.
    2. Under an order (rare tokens first, then by a hash) two sets that link
       share a token of their prefixes. A second reading posts the prefixes
       under the first order, but for tokens that are in one document only.
    3. In rounds, a few of each token's nodes are pivots: first those whose
       tokens are the most frequent, so the middle of a group of near copies,
       then others by hash. Each node is paired with one pivot, the nearest by
       sketch of those outside its component so far. A pair must also share
       prefix tokens under two more orders; what is left is verified on whole
       sets. A round has one pair a node at most, and the rounds find nearly all
       components, so that few nodes are left for the last step.
    4. In each token's bucket, nodes in the most frequent component so far need
       nothing more from each other. The others meet the nodes of other
       components; only pairs whose sketches (of 1024 bits here, four times as
       wide as in the rounds) don't rule a link out are given.
       They are filtered and verified likewise, first one pair for each pair of
       components, then those that still are in two. No pair of different
       components is left out, so the components are complete. Pairs that are
       near but do not link are the only ones whose number can grow faster than
       the nodes.

    Edge cases: a text without words, or null, has no shingles and links with
    nothing; one of fewer than ``width`` words has one; rows that repeat an id
    or a text are documents of their own; a row of a null id links with nothing
    and its component_id is null; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profile = materialise(profiles(own, width, percent, shards), "profiles")
    own = own.filter("id is not null")
    known = spark.sparkContext.broadcast(
        frequencies(profile.filter("shard is not null").select("shard", "cells"), percent, shards)
    )
    every = profile.filter("shard is null").select("id", "n", "node")
    rows = every.filter("id is not null and node is not null")
    total = rows.count()
    nodes = materialise(
        rows.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "nodes"
    )
    copies = join_groups(rows, nodes.filter("copies > 1"), "node", "copies", total, "inner")
    firsts = nodes.select(F.col("first").alias("id"))
    repeats = copies.filter("id <> first").select("id").join(firsts, "id", "left_anti")
    posted = materialise(
        postings(without_ids(own, materialise(repeats, "repeats"), "id"), known, width, percent), "postings"
    )
    buckets = (
        posted.groupBy("token")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members"))
        .filter("low <> high")
        .select("token", "members")
    )
    buckets = materialise(buckets, "buckets")
    shared = materialise(
        join_groups(posted, buckets, "token", "members", posted.count(), "inner"), "shared"
    )
    wanted = materialise(
        shared.select("node").distinct().join(nodes, "node").select("first"), "candidates"
    )
    sets = materialise(candidate_sets(only_ids(own, wanted, "id"), known, width, percent), "sets")

    member = F.struct("node", "n", "at", *SKETCH)
    middle = F.avg("members").over(Window.partitionBy("node"))
    marked = materialise(
        shared.withColumn("middle", middle)
        .join(sets.select("node", *SKETCH), "node")
        .select("token", "middle", member.alias("x")),
        "marked",
    )
    placed = marked.withColumn("label", F.col("x.node"))
    links, labels = None, None
    for turn in range(ROUNDS):
        likely = F.col("middle") if turn == 0 else F.xxhash64(F.lit(turn), "x.node")
        star = nearest_pivots(placed, likely, turn, percent)
        found = linked(materialise(star, "star"), sets, percent, "star_links")
        last = turn == ROUNDS - 1
        links = found if links is None else links.unionByName(found)
        labels = components(links, labels, None if last else HOPS)
        placed = materialise(
            marked.withColumn("node", F.col("x.node"))
            .join(labels, "node", "left")
            .withColumn("label", F.coalesce("label", "node"))
            .select("token", "middle", "x", "label"),
            "placed",
        )
    largest = (
        placed.groupBy("token", "label")
        .agg(F.count("*").alias("size"))
        .groupBy("token")
        .agg(
            F.max_by("label", F.struct("size", "label")).alias("main"),
            F.count("*").alias("labels"),
            F.sum("size").alias("members"),
        )
        .filter("labels > 1")
        .select("token", "main", "members")
    )
    known.destroy()
    open_rows = placed.join(materialise(largest, "largest"), "token").select(
        "token", "members", "main", "label", "x.node", "x.n", "x.at"
    )
    cross = cross_pairs(open_rows.join(sets.select("node", *WIDE), "node"), percent)
    links, labels = joined_across(materialise(cross, "cross"), sets, links, labels, percent)

    named = labels.join(nodes, "node")
    whole = named.groupBy("label").agg(F.min("first").alias("component_id"))
    grouped = materialise(
        nodes.join(named.select("node", "label"), "node", "left")
        .filter("copies > 1 or label is not null")
        .join(whole, "label", "left")
        .select("node", "copies", F.coalesce("component_id", "first").alias("component_id")),
        "grouped",
    )
    found = join_groups(rows, grouped, "node", "copies", total)
    alone = every.filter("id is null or node is null").withColumn("component_id", F.col("id"))
    return found.unionByName(alone, allowMissingColumns=True).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document, the one of smallest id, of each component."""
    found = near_duplicates(docs, width, percent, id_col, text_col)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).coalesce(narrow_files(docs.sparkSession))
    return without_ids(docs, materialise(gone, "near_copies"), id_col)
