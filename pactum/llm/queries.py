"""The queries of the training-data operators, for the driver's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table as plain_table
from .common import small_batches


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)  # these queries send whole texts to Python
    return plain_table(spark, sf_dir, name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import find_repeats

    return find_repeats(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(read_table(spark, sf_dir, "documents"))


def op7_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import token_tables

    return token_tables(read_table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract, fit

    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import fit, score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import link_documents

    return link_documents(read_table(spark, sf_dir, "documents"))


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import fit, whiten

    vectors = read_table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    labels = read_table(spark, sf_dir, "labels")
    return audit(spark, f"{sf_dir}/documents.parquet", labels)  # a stream over the table's files


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_documents

    return scan_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_quality_rules, op2_suffix_array_dedup, op3_language_id, op4_best_fit_packing, op5_mix_sources,
        op6_jpeg_media, op7_sstable_tokens, op8_html_main_text, op9_quality_neighbours, op10_minhash_near_dedup,
        op11_whiten_embeddings, op12_filter_audit, op13_license_scan,
    )
    return {f.__name__: f for f in found}


OP10_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
    SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id
), c AS (
    SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id
)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


OP12_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (
    SELECT s, min(doc_id) AS m FROM t GROUP BY s
), l AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT t.part, [
        len(t.w) < 200, 100 * len(list_distinct(t.w)) < 50 * len(t.w), 100 * len(regexp_extract_all(t.s, '[A-Z]')) > 3 * length(t.s),
        regexp_matches(t.s, '[#$%&*|]'), coalesce(t.doc_id > first.m, false)
    ] AS fails, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
    FROM t JOIN first ON first.s = t.s LEFT JOIN l ON l.doc_id = t.doc_id
), n AS (
    SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), x AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
    SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), st AS (
    SELECT list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, x.i AS step, o[x.i] AS own, o[1:x.i - 1] AS before FROM o, x
), r AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fails_own, len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
        len(list_filter(fails, lambda y: y)) = 1 AS once FROM n, st
), g AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN NOT fails_own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails_own AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails_own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails_own AND once THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails_own AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails_own AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM r GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr('ABCDE', own, 1) AS filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL can say it; the tests compare the others with brute force."""
    return {"op10_minhash_near_dedup": OP10_SQL, "op12_filter_audit": OP12_SQL}
