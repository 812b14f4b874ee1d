"""The registered queries of this subpackage: each puts one operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, exact_dedup, filter_audit, html_text, language_id, line_dedup, mixing, near_dedup, nearest, sharding, token_counts, toxicity
from .common import documents, shared_folder

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    map_path = f"{shared_folder(spark)}/skyloom-slot-maps/{hashlib.sha256(sf_dir.encode()).hexdigest()}"  # one for each table, kept between calls
    return sharding.shard_by_bytes(documents(spark, sf_dir), shards=24, map_path=map_path)


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), share=1.5, weights=(3, 1, 2)).drop("key", "rep", "source")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit_language_model(docs.filter(~language_id.held_out()))
    found = language_id.identify_languages(docs, model)
    return found.withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), token_counts.read_pieces(public_tokenizers.path(PIECE_FILE)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("mark", "stays")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), words=3, percent=85).drop("mark", "stays")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(documents(spark, sf_dir), words=50)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, dimensions=64, seed=3)


def op12_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.find_toxicity(docs, model)
    return found.withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "score", "predicted", "n_words", "spans")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_virtual_slots,
        op2_multi_index_hashing,
        op3_source_mixing,
        op4_language_id,
        op5_html_text,
        op6_token_counts,
        op7_exact_dedup,
        op8_byte_bpe,
        op9_near_dedup,
        op10_line_dedup,
        op11_sort_means,
        op12_chain_toxicity,
        op13_filter_audit,
    )
}


def _sort_means_sql(k: int, rounds: int) -> str:
    """Every round as two tables: the assignment, then the centroids it makes."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT p.r, m.c, sum((p.v - m.v) * (p.v - m.v)) AS d FROM p JOIN m{n} m ON p.i = m.i GROUP BY p.r, m.c)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""
        m{n + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce((s - ((s % n) + n) % n) // n, m.v)::BIGINT AS v FROM m{n} m LEFT JOIN
            (SELECT a.c, p.i, sum(p.v) AS s, count(*) AS n FROM a{n} a JOIN p ON a.r = p.r GROUP BY a.c, p.i) t ON m.c = t.c AND m.i = t.i)""")
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 1024)::BIGINT) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
        p AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(x) AS v FROM kept),
        m0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x
            FROM kept QUALIFY c < {k})),{",".join(steps)},
        h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
        SELECT kept.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
            (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
        FROM kept JOIN a{rounds} a ON kept.r = a.r JOIN h ON h.c = a.c
    """


ORACLE_SQL = {
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 3 THEN [w] ELSE [w[i:i + 2] FOR i IN range(1,
            len(w) - 1)] END) AS sh FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT ee.b, r.c FROM r JOIN ee ON ee.a = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept FROM r LEFT JOIN n
            ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op10_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        n AS (SELECT *, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS words FROM l),
        w AS (SELECT doc_id, lines, words, size, unnest(range(1, len(lines) - size + 2)) AS s FROM n, (VALUES (1), (2), (3)) AS t(size)
            WHERE len(lines) >= size),
        k AS (SELECT doc_id, s, size, lines[s:s + size - 1] AS run FROM w WHERE size = 3 OR list_sum(words[s:s + size - 1]) > 50),
        f AS (SELECT doc_id, s, size, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS place FROM k),
        o AS (SELECT doc_id, unnest(range(s, s + size)) AS line FROM f WHERE place > 1),
        gone AS (SELECT doc_id, list(DISTINCT line) AS gone FROM o GROUP BY doc_id)
        SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(CASE WHEN gone IS NULL THEN text
                ELSE coalesce(array_to_string(list_transform(list_sort(list_filter(range(1, len(lines) + 1), lambda i: NOT
                    list_contains(gone, i))), lambda i: lines[i]), chr(10)), '') END) AS text_sha256
        FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id
    """,
    "op11_sort_means": _sort_means_sql(8, 10),
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
            100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
            coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM d),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
        i AS (SELECT unnest(range(1, 6)) AS i),
        o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS places FROM i p JOIN i q ON q.i <> p.i JOIN i r ON r.i NOT IN (p.i, q.i) JOIN i s ON s.i NOT IN (p.i, q.i, r.i)
            JOIN i t ON t.i NOT IN (p.i, q.i, r.i, s.i)),
        z AS (SELECT places, array_to_string(list_transform(places, lambda x: 'ABCDE'[x]), '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
        x AS (SELECT part, filter_order, step, places[step] AS own, n, good, toxic, fails[places[step]] AS fails,
            list_bool_or(list_transform(places[1:step - 1], lambda x: fails[x])) IS TRUE AS gone, len(list_filter(fails, lambda x: x)) AS many FROM m, z),
        s AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (fails AND many = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
            coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
    """,
}
