"""The operN queries, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontamination, html_text, mixing, near_text, near_vectors, suffixes, tables, token_counts, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_documents(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    rows = warc.read_archives(spark, path, payloads=False)
    number = lambda c: F.when(F.col(c) != warc.NO_ID, F.substring_index(c, ":", -1).cast("long"))
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.cosine_links(_read(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.jaccard_links(_read(spark, sf_dir, "documents"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_read(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_backoff_scores": op3_backoff_scores,
    "op4_warc": op4_warc,
    "op5_near_vectors": op5_near_vectors,
    "op6_main_text": op6_main_text,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_repeated_bytes": op8_repeated_bytes,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_counts": op10_token_counts,
}

#: The words of a table's rows, and their distinct five-word shingles (id, g).
WORDS = "{0}_words AS (SELECT {1} AS id, regexp_extract_all(lower(text), '[\\pL\\pN\\pM_]+') AS w FROM {0})"
SHINGLES = WORDS + """,
        {0}_shingles AS (SELECT DISTINCT id, array_to_string(w[r.i:r.i + 4], ' ') AS g FROM {0}_words, unnest(range(1, len(w) - 3)) AS r(i))"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH {SHINGLES.format("documents", "doc_id")}, {SHINGLES.format("benchmark", "item_id")},
        sizes AS (SELECT id, count(*) AS n FROM benchmark_shingles GROUP BY id),
        held AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM documents_shingles d JOIN benchmark_shingles b USING (g) GROUP BY ALL)
        SELECT doc_id, item_id, n::INT AS item_shingles, k::INT AS found_shingles, k::DOUBLE / n AS containment
        FROM held JOIN sizes ON item_id = id WHERE k >= 0.8 * n""",
    "op3_backoff_scores": f"""
        WITH {WORDS.format("documents", "doc_id")},
        p AS (SELECT id, r.i AS i, w[r.i] AS c, CASE WHEN r.i > 1 THEN w[r.i - 1] END AS b, CASE WHEN r.i > 2 THEN w[r.i - 2] END AS a FROM documents_words, unnest(range(1, len(w) + 1)) AS r(i)),
        n AS (SELECT count(*) AS n FROM p),
        c1 AS (SELECT c, count(*) AS k FROM p GROUP BY ALL),
        c2 AS (SELECT b, c, count(*) AS k FROM p WHERE b IS NOT NULL GROUP BY ALL),
        c3 AS (SELECT a, b, c, count(*) AS k FROM p WHERE a IS NOT NULL GROUP BY ALL),
        s AS (SELECT p.id, CASE
                WHEN c3.k >= 2 THEN ln(c3.k / ab.k)
                WHEN bc.k >= 2 THEN ln(bc.k / b1.k) + CASE WHEN p.i > 2 THEN ln(0.4::DOUBLE) ELSE 0 END
                ELSE ln(c1.k / n.n) + ln(0.4::DOUBLE) * least(p.i - 1, 2) END AS x
            FROM p CROSS JOIN n JOIN c1 ON c1.c = p.c LEFT JOIN c1 b1 ON b1.c = p.b LEFT JOIN c2 bc ON bc.b = p.b AND bc.c = p.c
            LEFT JOIN c2 ab ON ab.b = p.a AND ab.c = p.b LEFT JOIN c3 ON c3.a = p.a AND c3.b = p.b AND c3.c = p.c),
        t AS (SELECT id, count(*) AS k, sum(x) AS x FROM s GROUP BY id)
        SELECT d.doc_id, coalesce(k, 0) AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / k, 6) AS mean_log_score
        FROM documents d LEFT JOIN t ON t.id = d.doc_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND top IS DISTINCT FROM page_id THEN top END AS refers_to
        FROM w""",
    "op5_near_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(id, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.x = pairs.a),
        links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
        part AS (SELECT id, min(x) AS c FROM reach GROUP BY id)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = e.vec_id AS kept
        FROM embeddings e JOIN part ON id = e.vec_id LEFT JOIN links ON a = e.vec_id""",
    "op7_jaccard_join": f"""
        WITH RECURSIVE {SHINGLES.format("documents", "doc_id")},
        s AS (SELECT * FROM documents_shingles UNION ALL SELECT id, array_to_string(w, ' ') FROM documents_words WHERE len(w) BETWEEN 1 AND 4),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        held AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
        pairs AS (SELECT a, b, k = x.n AND k = y.n AS same FROM held JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.8 * (x.n + y.n - k)),
        reach(id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.x = pairs.a),
        class AS (SELECT id, min(x) AS c FROM reach GROUP BY id)
        SELECT d.doc_id, least(d.doc_id, min(b) FILTER (same)) AS copy_of, count(b) AS n_links, any_value(c) AS class_id, any_value(c) = d.doc_id AS kept
        FROM documents d JOIN class ON class.id = d.doc_id LEFT JOIN pairs ON a = d.doc_id GROUP BY d.doc_id""",
    "op9_mix_sources": """
        WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS mean FROM counts),
        shares AS (SELECT source, mean, greatest(ceil(mean / 32.0), 1)::INT AS parts FROM rates),
        steps(source, parts, m, k, p, c) AS (
            SELECT source, parts, mean / parts, 0, exp(-(mean / parts)), exp(-(mean / parts)) FROM shares
            UNION ALL
            SELECT source, parts, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM steps WHERE k < ceil(m + 12 * sqrt(m) + 30)),
        draws AS (
            SELECT d.doc_id, d.source, i.part, ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i.part), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
            FROM documents d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source, unnest(range(1, s.parts + 1)) AS i(part)),
        copies AS (SELECT r.doc_id, count(*) AS n FROM draws r JOIN steps t ON r.source IS NOT DISTINCT FROM t.source AND t.c <= r.u GROUP BY r.doc_id)
        SELECT d.*, i.copy::INT AS copy, ('0x' || substr(md5('7:' || d.doc_id || ':' || i.copy || ':order'), 1, 15))::BIGINT AS shuffle_key
        FROM documents d JOIN copies c ON d.doc_id = c.doc_id, unnest(range(1, c.n + 1)) AS i(copy)""",
}
