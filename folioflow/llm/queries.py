"""The operators bound to the driver's tables: one query opN_<name> each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table
from folioflow.llm.conversations import ORACLE_SQL as _conversation_sql
from folioflow.llm.licenses import oracle_sql as _license_sql
from folioflow.llm.lines import ORACLE_SQL as _line_sql
from folioflow.llm.variants import oracle_sql as _variant_sql


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.minhash import NearDuplicates

    found = NearDuplicates(width=3, percent=85).classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.token_counts import section_token_counts

    return section_token_counts(table(spark, sf_dir, "documents"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.pst import LanguageModelScores

    return LanguageModelScores().scores(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.licenses import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.toxicity import held_out, score_texts, train

    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.html_crf import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.quality import site_quality, train
    from folioflow.llm.toxicity import held_out

    docs = table(spark, sf_dir, "documents")
    # documents name their site in `source`; the language stands for the path within it
    return site_quality(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()), F.col("source"), F.col("lang"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.conversations import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.lines import keep_bitmaps, with_kept_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = with_kept_lines(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.variants import spelling_variants, word_counts

    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_token_counts, op3_lm_scores, op4_decontamination, op5_exact_dedup, op6_license_scan, op7_toxicity, op8_html_text, op9_packing, op10_site_quality, op11_conversation_repair, op12_line_dedup, op13_spelling_variants)}

ORACLE_SQL = {
    "op1_minhash_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
            FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
            s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
        FROM s LEFT JOIN c ON c.a = s.doc_id""",
    "op6_license_scan": _license_sql(),
    "op11_conversation_repair": _conversation_sql,
    "op12_line_dedup": _line_sql,
    "op13_spelling_variants": _variant_sql(),
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
