"""The pipeline's stages, each against a brute-force version on its own input."""

import os
import sys
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from trackspark.functions import shared
from trackspark.llm import bpe, common
from trackspark.llm.common import BATCH_BYTES, BATCH_ROWS, materialise, ranked, release, scratch, scratch_path, small_batches, tidy, told
from trackspark.llm.mixing import mix
from trackspark.llm.toxicity import score

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_corpus import brute_components, squeezed  # noqa: E402


def test_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen, data)
        assert out.columns == columns, name
        ids, before = [[r["doc_id"] for r in f.collect()] for f in (out, seen)]
        assert set(ids) <= set(before)
        if name == "exact_dedup":
            texts = [" ".join((r["text"] or "").split()) for r in out.collect()]
            assert len(set(texts)) == len(texts)
        seen = spark.createDataFrame(out.collect(), docs.schema)
    rows = pipeline.STAGES[-1][1](spark, seen, data).collect()
    assert len(rows) == seen.count() and all(r["n_tokens"] >= 0 for r in rows)


def test_stages_keep_what_brute_force_keeps(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def kept(name, seen):
        rows = stages[name](spark, seen, data).collect()
        assert all(r["text"] == texts[r["doc_id"]] for r in rows), name
        return rows

    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    # The classifier has no brute-force version: its verdicts, and the labels.
    judged = {r["doc_id"]: r["rejected"] for r in score(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    ids = [r["doc_id"] for r in kept("toxicity", docs)]
    assert sorted(ids) == sorted(i for i in texts if not judged[i])
    clean = [i for i in texts if labels.get(i) == (1, 0)]
    assert clean and len(set(clean) & set(ids)) >= 0.95 * len(clean)

    first = {}
    for i in sorted(texts):
        first.setdefault(squeezed(texts[i]), i)
    assert sorted(r["doc_id"] for r in kept("exact_dedup", docs)) == sorted(first.values())

    want = brute_components(list(texts.items()), 5, 80)
    assert sorted(r["doc_id"] for r in kept("ngram_join", docs)) == sorted(i for i, (_, c) in want.items() if c == i)

    copies = Counter(r["doc_id"] for r in kept("mix_sources", docs))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mix(docs).collect()}
    assert max(copies.values()) <= 2
    # A document that is taken in part comes whole.
    assert all(copies[i] == -(-got // size) if size else i not in copies for i, (got, size) in taken.items())


def test_blocks_release_what_they_made_and_nothing_else(spark):
    with scratch() as kept:
        stays = materialise(spark.range(5), "stays")
        with scratch() as given_up:
            goes = materialise(spark.range(7), "goes")
            shared = told(spark, [1])
        last = materialise(spark.range(3), "last")
    assert [len(x.folders) for x in (kept, given_up)] == [2, 1] and given_up.broadcasts == [shared]
    goes_files = goes.inputFiles()
    release(spark, given_up)
    assert stays.count() == 5 and last.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://")) for f in goes_files)
    assert not given_up.folders and not given_up.broadcasts


def test_a_worker_gives_its_free_memory_back_after_a_task():
    psutil = pytest.importorskip("psutil")
    sizes = []

    def step(batches):
        words = [b"x" * (500 + k % 7) for k in range(200_000)]
        last = words[-1]  # memory that is free lies below memory that is not
        del words
        sizes.append(psutil.Process().memory_info().rss)
        yield last

    assert len(list(tidy(step)(iter([])))) == 1
    assert psutil.Process().memory_info().rss < sizes[0] - 50e6


def test_a_worker_lets_go_of_what_another_stage_holds():
    bpe._tools(public_tokenizers.path("word_bpe_49k.json"))
    held = bpe._tools.cache_info().currsize
    assert held and list(tidy(iter, "bpe")(iter([1]))) == [1] and bpe._tools.cache_info().currsize == held
    assert list(tidy(iter)(iter([2]))) == [2] and bpe._tools.cache_info().currsize == 0


def test_batches_have_few_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in ((str(1 << 30), str(BATCH_BYTES)), ("64m", str(BATCH_BYTES)), ("100k", "100k"), ("5", "5")):
            spark.conf.set(name, given)
            small_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_parquet_is_read_in_batches_of_few_rows(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        for given, want in (("4096", str(BATCH_ROWS)), ("100", "100")):
            spark.conf.set(name, given)
            small_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_ranks_start_no_python_workers(spark):
    for n in (0, 5):
        found = ranked(spark.range(n), [F.desc("id")], "ranks")
        assert {r["id"]: r["rank"] for r in found.collect()} == {k: n - 1 - k for k in range(n)}
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()


def test_a_worker_holds_one_vocabulary():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), bpe._tools(path)[0]
    assert own.get_vocab_size() == 0
    for text in ("", "It's  2\u00b2 A\u030a\u0130\u1e9e \u4e2d\u6587\u3000x<|endoftext|>y\x00 \U0001f600\u200d"):
        pieces = [t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text)) for t in (whole, own)]
        assert pieces[0] == pieces[1]


def test_scratch_tables_are_no_part_of_the_folder_above(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/checkpoints")
    monkeypatch.setattr(shared, "_own_folder", lambda: f"file://{tmp_path}/checkpoints")
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with scratch() as made:
        assert materialise(spark.range(5), "plain").count() == 5
        parted = scratch_path(spark, "parted")
        spark.range(4).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(parted)
        assert spark.read.parquet(parted).groupBy("part").count().count() == 2
        kept = shared.shared_folder(spark, "kept")
        spark.range(6).write.parquet(kept)
        assert spark.read.parquet(kept).count() == 6
        spark.read.schema("id long").parquet(str(tmp_path))  # no error: conflicting directory structures
        found = spark.read.schema("id long").option("recursiveFileLookup", "true").parquet(str(tmp_path))
        assert found.count() == 3
    release(spark, made)
