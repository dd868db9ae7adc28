"""Registered queries of the numbered operators: thin, production parameters,
whole tables.  Each derives the digest columns from its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the byte-level vocabulary of 50k entries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.packing import pack

    vocabulary, pattern = bpe_vocabulary()
    return pack(_table(spark, sf_dir, "documents"), vocabulary, pattern, capacity=1024).drop("ids")


def op2_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.sharding import shard_documents

    out = shard_documents(_table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.vptree import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans", "spdx")


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.linededup import find_blocks

    return find_blocks(_table(spark, sf_dir, "documents")).drop("key")


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.toxicity import held_out, score_documents, train

    documents = _table(spark, sf_dir, "documents")
    scored = score_documents(documents, train(documents, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.warc import archive_and_read

    out = archive_and_read(_table(spark, sf_dir, "pages"), least_revisit_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.urlfilter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op11_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.ranked import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from proselens.llm.tokenfiles import encode_and_read

    return encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op13_counted_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proselens.llm.infill import infill, part_lengths, restore

    out = part_lengths(infill(_table(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_karmarkar_karp_sharding": op2_karmarkar_karp_sharding,
    "op3_vantage_point_search": op3_vantage_point_search,
    "op4_license_rules": op4_license_rules,
    "op5_cgk_decontamination": op5_cgk_decontamination,
    "op6_patience_line_dedup": op6_patience_line_dedup,
    "op7_weak_toxicity": op7_weak_toxicity,
    "op8_minhash_bayes": op8_minhash_bayes,
    "op9_warc_index": op9_warc_index,
    "op10_url_template_filter": op10_url_template_filter,
    "op11_range_maximum_search": op11_range_maximum_search,
    "op12_context_mixing_files": op12_context_mixing_files,
    "op13_counted_infill": op13_counted_infill,
}

SQL: dict[str, str] = {
    "op3_vantage_point_search": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                   list_reduce(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
            FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op8_minhash_bayes": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                ELSE list_sort(list_distinct(list_transform(
                                         range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
            FROM w),
        c AS (SELECT s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s),
        t AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
        p AS (
            SELECT a.rep AS a, b.rep AS b, any_value(a.n + b.n) AS n, count(*) AS shared
            FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
        l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (n - shared)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT rep, rep AS start FROM c UNION SELECT e.b, r.start FROM r JOIN e ON e.a = r.rep),
        k AS (SELECT rep, min(start) AS component_id FROM r GROUP BY rep)
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id,
               coalesce(k.component_id, s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k ON c.rep = k.rep
    """,
    "op9_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT html, min(page_id) AS first, sha1(html) AS h FROM p GROUP BY html),
        b AS (
            SELECT html, first,
                   array_to_string(list_transform(range(32), lambda i: substr(
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER,
                       1)), '') AS payload_digest
            FROM f)
        SELECT page_id, strlen(p.html) AS payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p JOIN b ON p.html = b.html
    """,
    "op11_range_maximum_search": r"""
        WITH t AS (
            SELECT row_number() OVER () AS row, doc_id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        c AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        l AS (SELECT row, sum(tf)::BIGINT AS n FROM c GROUP BY row),
        k AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM l),
        q AS (
            SELECT DISTINCT item_id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        w AS (
            SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM c, k GROUP BY term),
        s AS (
            SELECT item_id, row, any_value(doc_id) AS doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
            FROM q JOIN c USING (term) JOIN w USING (term) JOIN l USING (row), k GROUP BY item_id, row),
        r AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
                                 AS INTEGER) AS rank, doc_id, score
            FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
    """,
    "op13_counted_infill": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents),
        e AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1,
                   ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2
            FROM d),
        f AS (
            SELECT doc_id, text, n,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(u[1:least(c1, c2)], '') AS p,
                   array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
                   array_to_string(u[greatest(c1, c2) + 1:n], '') AS s
            FROM e)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM f
    """,
}
