"""The queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm.bpe import bpe
from trackspark.llm.clustering import cluster_vectors
from trackspark.llm.common import scratch_path
from trackspark.llm.exact_dedup import exact_groups
from trackspark.llm.filter_audit import audit_filters
from trackspark.llm.jaccard import near_duplicates
from trackspark.llm.langid import identify
from trackspark.llm.line_dedup import drop_frequent_lines
from trackspark.llm.media import image_copies, rendered
from trackspark.llm.mixing import mix
from trackspark.llm.resharding import reshard
from trackspark.llm.token_counts import count_tokens
from trackspark.llm.toxicity import score
from trackspark.llm.warc import archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each vector of ``embeddings`` is drawn as one."""
    images = rendered(table(spark, sf_dir, "embeddings"))
    return image_copies(images, id_col="vec_id", image_col="image")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs, min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first, so that a result depends on its tables only."""
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_language": op3_language,
    "op4_media": op4_media,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_mix": op7_mix,
    "op8_reshard": op8_reshard,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_counts": op12_token_counts,
    "op13_clustering": op13_clustering,
}


def _kmeans_sql(rounds: int) -> str:
    """Assignments and moves of the centroids, round by round, as tables a<i> and c<i>."""
    kept = r"""
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"""
    parts = [
        f"kept AS ({kept})",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY k LIMIT 16)",
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (
            SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
            FROM kept, c{i})""")
        parts.append(f"""a{i} AS (
            SELECT vec_id, v, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        parts.append(f"""s{i} AS (
            SELECT k, j, sum(x) AS s, count(*) AS n
            FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY k, j)""")
        parts.append(f"""c{i + 1} AS (
            SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
                SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY k) m USING (k))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a{rounds}.k AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(list_aggregate(list_transform(c, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = a{rounds}.k"""


ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
            FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept,
               h AS text_sha256
        FROM d
    """,
    "op9_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l),
        f AS (SELECT key FROM k WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op6_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n,
                   sha256(coalesce(html, '')) AS d
            FROM pages),
        f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d
    """,
    # Rows by the set of filters that they fail; the orders are walked over these few sets.
    "op11_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
                   CAST(len(words) < 50 AS INT)
                   + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
                   + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
                   + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
                   + 16 * CAST(w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS INT) AS mask
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x
              FROM f GROUP BY part, mask),
        p AS (SELECT letter, CAST(1 << (ascii(letter) - 65) AS BIGINT) AS bit FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter)),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
              FROM p a, p b, p c, p d, p e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([b1, b2, b3, b4, b5]) AS bit,
                     unnest([0, b1, b1 + b2, b1 + b2 + b3, b1 + b2 + b3 + b4]) AS before FROM o),
        r AS (
            SELECT part, filter_order, step, bit,
                   coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
                   coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS removed,
                   coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0) AS redundant,
                   coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
                   coalesce(sum(g) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
                   coalesce(sum(x) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
            FROM m, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r
    """,
    "op13_clustering": _kmeans_sql(3),
}
