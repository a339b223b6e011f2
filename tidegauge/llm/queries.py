"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import table
from tidegauge.llm.decontaminate import leaking_documents
from tidegauge.llm.filter_audit import audit_filters
from tidegauge.llm.language_id import predict_languages
from tidegauge.llm.license_scan import scan_licenses
from tidegauge.llm.near_dedup import near_duplicates
from tidegauge.llm.neural_lm import score_texts
from tidegauge.llm.packing import pack
from tidegauge.llm.perplexity_rules import VERDICT, quality_verdicts
from tidegauge.llm.pii import find_pii
from tidegauge.llm.quality_model import score_quality
from tidegauge.llm.ranked_search import ranked_search
from tidegauge.llm.substring_dedup import substring_duplicates
from tidegauge.llm.warc import round_trip


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_verdicts(docs).select("doc_id", *[f.name for f in VERDICT], "kept", "log_ppl")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=columns).select("doc_id", *columns)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_language_id, op4_benchmark_decontamination, op5_warc_segments, op6_simhash_near_dedup, op7_quality_rules, op8_best_fit_packing, op9_lm_scoring, op10_substring_dedup, op11_filter_interaction_audit, op12_pii, op13_ranked_search)}
ORACLES: dict[str, str] = {
    "op5_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
             f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s)
        SELECT page_id, n AS payload_bytes, d.s AS payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM d LEFT JOIN f ON d.s = f.s
    """,
    "op11_filter_interaction_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             e AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
             l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
             f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
                     || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                     || CASE WHEN e.doc_id > low OR (e.doc_id IS NULL AND low IS NOT NULL) THEN 'E' ELSE '' END AS fails
                   FROM e LEFT JOIN l ON l.doc_id = e.doc_id),
             m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
             c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
             o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM c a, c b, c, c d, c e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
             s AS (SELECT o, i AS step, o[i] AS x, o[:i - 1] AS before, o[:i] AS upto FROM o, range(1, 6) r(i)),
             r AS (SELECT part, o, step, any_value(x) AS x,
                     sum(CASE WHEN translate(fails, upto, '') = fails THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
                   FROM m, s GROUP BY 1, 2, 3)
        SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
        FROM r
    """,
    "op13_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
             s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS dn, CAST(sum(len(ws)) AS BIGINT) AS dl FROM d),
             i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
             q AS (SELECT item, item_id, w, count(*) AS qtf FROM (SELECT item, item_id, unnest(ws) AS w FROM i) GROUP BY 1, 2, 3),
             p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY 1, 2),
             f AS (SELECT w, CAST(floor(1000 * ln((2 * dn + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY w, dn),
             m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ws) * dn) // dl AS m FROM d, s WHERE len(ws) > 0),
             t AS (SELECT item, item_id, p.r, doc_id, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (w) JOIN p USING (w) JOIN m ON m.r = p.r GROUP BY 1, 2, 3, 4),
             k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM t WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
    """,
}
