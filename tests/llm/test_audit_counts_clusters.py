"""Filter audit, token counts and clustering against brute force, on awkward small tables."""

import hashlib
import itertools
import math
import random
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trackspark.llm.clustering import Move, cluster_vectors, reassign, scan
from trackspark.llm.common import scratch_path
from trackspark.llm.filter_audit import audit_filters
from trackspark.llm.token_counts import count_tokens, counted, drops_space, read_cache

from test_corpus import SCHEMA, awkward

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# Filter audit ------------------------------------------------------------------------


def brute_audit(rows, labels):
    """What each filter removes, by walking each order over all rows."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    seen = {}
    for i, t, _, source, *_ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        seen.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, own in seen.items():
        removed_at = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                row = [part, order, step, len(left), len(lost), sum(r[0][f] for r in gone)]
                row.append(sum(r[0][f] and sum(r[0].values()) == 1 for r in own))
                out.append([*row, sum(r[1] for r in lost), sum(r[2] for r in lost), f])
                removed_at[f] = removed_at.get(f, 0) + len(lost)
                gone += lost
        out = [[*r[:9], removed_at[r[9]]] if len(r) == 10 and r[0] == part and isinstance(r[9], str) else r for r in out]
    return sorted(map(tuple, out), key=repr)


def test_audit_is_the_walk_over_every_order(spark, docs):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 40, 2)] + [(4, 1, 1), (5, None, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(audit_filters(docs, table)) == brute_audit(awkward(), labels)


def test_audit_with_few_rows_held_and_a_hot_part(spark, monkeypatch):
    monkeypatch.setattr("trackspark.llm.filter_audit.INDEX_ROWS", 7)
    rng = random.Random(3)
    rows = [(i, rng.choice(["# a", "A B c", "same " * 60, " ".join(map(str, range(70)))]), None, rng.choice(["hot"] * 9 + ["x"])) for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows_of(audit_filters(frame, empty)) == brute_audit(rows, [])


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs.limit(0), labels).count() == 0


# Token counts --------------------------------------------------------------------------


@lru_cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def library(path, texts):
    if path.endswith(".model"):
        return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(tokenizer(path).encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_counts_are_the_library_s(spark, docs, path):
    found = count_tokens(docs, path, scratch_path(spark, "cache"), limit=30)
    texts = [r[1] or "" for r in awkward()]
    want = [(r[0], len(t.encode()), n, n > 30) for r, t, n in zip(awkward(), texts, library(path, texts))]
    assert rows_of(found) == sorted(want, key=repr)


def test_only_distinct_misses_are_encoded_and_kept(spark, docs):
    cache = scratch_path(spark, "cache")
    first = docs.filter("doc_id < 20 or doc_id is null")
    count_tokens(first, WORD, cache)
    own = read_cache(spark, cache).collect()
    texts = {re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in awkward() if r[0] is None or r[0] < 20}
    assert {bytes(r["digest"]) for r in own} == {hashlib.sha256(t.encode()).digest() for t in texts}
    assert len(own) == len(texts)
    # Rows of a cache are believed: counts made wrong on purpose come back.
    read_cache(spark, cache).selectExpr("version", "digest", "n_tokens + 1000 as n_tokens").write.mode("append").parquet(cache)
    again = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, WORD, cache, wave_rows=5).collect()}
    whole = dict(zip([r[0] for r in awkward()], library(WORD, [r[1] or "" for r in awkward()])))
    new = {i for i in whole if i is not None and i >= 20}
    squeezed = {re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in awkward() if r[0] in new} - texts
    assert read_cache(spark, cache).count() == 2 * len(texts) + len(squeezed)
    assert all(again[r[0]] in (whole[r[0]], whole[r[0]] + 1000) for r in awkward())
    assert all(again[i] == whole[i] + 1000 for i in whole if i is None or i < 20)
    # Another tokenizer's counts are its own.
    other = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, BYTE, cache).collect()}
    assert other == dict(zip([r[0] for r in awkward()], library(BYTE, [r[1] or "" for r in awkward()])))


def test_counts_of_a_file_and_of_a_table_that_is_none(spark, docs):
    path = scratch_path(spark, "docs")
    docs.write.parquet(path)
    straight = spark.read.parquet(path)
    joined = straight.unionByName(straight.limit(0))  # has no file positions
    want = rows_of(count_tokens(straight, WORD, scratch_path(spark, "cache")))
    assert rows_of(count_tokens(joined, WORD, scratch_path(spark, "cache"), wave_rows=4)) == want
    assert count_tokens(docs.limit(0), WORD, scratch_path(spark, "cache")).count() == 0


PIECES = st.sampled_from(["a", "B's", " ", "\n\t", "\x0b", "\x0c ", "é", "é", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "ſ", "İ", " ", "\x1c", "\x85", "12", "!?", "\x00", "🙂", "﻿"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=4))
def test_counts_do_not_depend_on_the_white_space_that_is_squeezed(texts):
    assert drops_space(WORD) and not drops_space(BYTE) and not drops_space(PIECE)
    squeezed = [re.sub("[\x20\x09-\x0d]+", " ", t) for t in texts]
    assert counted(squeezed, WORD) == counted(texts, WORD) == library(WORD, texts)


# Clustering -----------------------------------------------------------------------------


def brute_kmeans(rows, k, rounds, dim, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, own in groups.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sum(e for _, e, m in last if m == n), total, digest[n]) for i, d, n in last), key=repr)


def vectors(n, dim, spread):
    rng = random.Random(n)
    out = [(i, [rng.choice([-spread, 0.0, spread]) + rng.gauss(0, 0.02) for _ in range(dim)]) for i in range(n)]
    out += [(100 + i, [0.25] * dim) for i in range(12)]  # ties, and a hot group
    out += [(200, [0.5, None] + [0.0] * (dim - 2)), (201, [float("nan")] * dim), (202, [float("inf")] * dim), (203, [0.1]), (204, None), (205, [])]
    return out + [out[0], (None, [0.3] * dim), (0, [-0.3] * dim)]


@pytest.mark.parametrize("n, k, spread", [(60, 5, 0.4), (30, 16, 0.0), (3, 16, 1.0)])
def test_clusters_are_lloyd_s(spark, n, k, spread):
    rows = [(i, v, "clash", 7) for i, v in vectors(n, 8, spread)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, cluster int").repartition(3)
    found = cluster_vectors(frame, k=k, rounds=3, dim=8)
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert rows_of(found.select(*columns)) == brute_kmeans([r[:2] for r in rows], k, 3, 8, 64)


def test_clusters_of_nothing_and_of_too_large_numbers(spark):
    frame = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<float>")
    assert cluster_vectors(frame, dim=3).count() == 0
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(frame, dim=2).count()


def test_bounds_save_scans(spark):
    rng = random.Random(2)
    rows = [(i, [i % 4 + rng.gauss(0, 0.05) for _ in range(6)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = cluster_vectors(frame, k=4, dim=6)
    scans = [r["scans"] for r in found.collect()]
    assert sum(scans) < 2 * len(rows)  # of four passes


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([1, 3, 40, 1 << 26]))
def test_reassigning_by_bounds_is_a_full_scan(seed, k, size):
    rng = np.random.default_rng(seed)
    v = rng.integers(-size, size + 1, (80, 5)).astype(np.int64)
    old = v[rng.integers(0, 80, k)]
    cluster, upper, lower = scan(v, old)
    scans = np.ones(80, int)
    for _ in range(3):
        new = old + rng.integers(-max(1, size // 8), max(1, size // 8) + 1, old.shape)
        cluster, upper, lower, scans = reassign(v, cluster, upper, lower, scans, Move(old, new))
        want = np.array([min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(new.tolist()))[1] for x in v.tolist()])
        assert (cluster == want).all()
        old = new
