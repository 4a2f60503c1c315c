"""The corpus pipeline: five stages over ``documents``, each written and reread.

The stages cannot be said in SQL (a fitted classifier, a tokenizer), so there
is no ORACLE_SQL. The tests hold the exact and near duplicates against brute
force, the mix against its own plan, the encoding against the tokenizers
library, and the toxicity stage against the labels.

All stages take what their operators take: null and empty texts are texts
without words; rows that repeat an id share one fate, and rows of a null id are
never dropped by a deduplicating stage; an empty table stays empty; columns
beyond those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm.bpe import bpe
from trackspark.llm.common import Scratch, materialise, release, scratch
from trackspark.llm.exact_dedup import drop_exact_copies
from trackspark.llm.jaccard import drop_near_duplicates
from trackspark.llm.mixing import mixed_documents
from trackspark.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of smallest id stays."""
    return drop_exact_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, similarity 0.8 or more) the smallest id stays."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once, twice or not at all, as their source's target asks."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's scratch tables and broadcasts go once its result is written, and
    with them the result before it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch()
    for name, stage in STAGES:
        with scratch() as own:
            found = stage(spark, docs, sf_dir)
        with scratch() as result:
            docs = materialise(found, name)
        for made in (own, before):
            release(spark, made)
        before = result
    return docs
