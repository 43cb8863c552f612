"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontamination, language_id, line_dedup, packing, quality_mil, repetition_rules, simhash_neardup, suffix_dedup, toxicity_kn, url_filter
from tideline.llm._common import table


def _held_out(mod: int, rest: int):
    """Whether a row is one that learning leaves out; a row without an id, which nothing learns from, is not."""
    return F.coalesce(F.crc32(F.col("id").cast("string")) % mod == rest, F.lit(False))


def op1_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.inspect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join("matches.item_id", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_simhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op3_simhash_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_neardup.groups(table(spark, sf_dir, "documents"), shingle=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The url rules (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_url_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_mil.learn(docs, table(spark, sf_dir, "labels"))
    return quality_mil.score(docs, model).select(F.col("id").alias("doc_id"), _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_kn.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity_kn.score(docs, model).select(F.col("id").alias("doc_id"), _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select(F.col("id").alias("doc_id"), _held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {
    "op1_suffix_array_decontamination": op1_suffix_array_decontamination,
    "op2_simhash_line_dedup": op2_simhash_line_dedup,
    "op3_simhash_positional_index": op3_simhash_positional_index,
    "op4_url_digest_array": op4_url_digest_array,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_columnwise_suffix_dedup": op6_columnwise_suffix_dedup,
    "op7_quality_mil": op7_quality_mil,
    "op8_toxicity_kneser_ney": op8_toxicity_kneser_ney,
    "op9_repetition_rules": op9_repetition_rules,
    "op10_language_id": op10_language_id,
}

ORACLES = {
    "op4_url_digest_array": """
        WITH cut AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES
            ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
            ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fits AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS k
            FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
        FROM cut c LEFT JOIN fits f ON f.page_id = c.page_id AND f.host = c.host AND f.path = c.path AND f.k = 1""",
    "op1_suffix_array_decontamination": r"""
        WITH items AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        docs AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
        item_windows AS (
            SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g
            FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0) t),
        doc_windows AS (
            SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM item_windows) s WHERE len(w) >= k) t),
        met AS (SELECT DISTINCT d.doc_id, d.i, d.k, b.item FROM doc_windows d JOIN item_windows b ON b.k = d.k AND b.g = d.g),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) t GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM met) t GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id""",
    "op6_columnwise_suffix_dedup": r"""
        WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
        p AS (SELECT doc_id, t, unnest(range(1, octet_length(t) + 1)) AS i FROM b),
        g AS (SELECT doc_id, i, hex(array_slice(t, i, i)) AS byte, CASE WHEN i + 49 <= octet_length(t) THEN array_slice(t, i, i + 49) END AS s FROM p),
        least_id AS (SELECT s, min(doc_id) AS first_id FROM g WHERE s IS NOT NULL GROUP BY s),
        starts AS (SELECT g.doc_id, g.i, g.byte, CASE WHEN l.first_id < g.doc_id THEN 1 ELSE 0 END AS dup FROM g LEFT JOIN least_id l ON l.s = g.s),
        gone AS (SELECT doc_id, i, byte, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS out FROM starts),
        runs AS (SELECT *, lag(out, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone),
        per AS (
            SELECT doc_id, sum(out) AS n_removed, count(*) FILTER (WHERE out = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE out = 0) AS kept FROM runs GROUP BY doc_id)
        SELECT b.doc_id, octet_length(b.t) AS n_bytes, CAST(coalesce(per.n_removed, 0) AS BIGINT) AS n_removed, coalesce(per.n_spans, 0) AS n_spans, sha256(unhex(coalesce(per.kept, ''))) AS kept_sha256
        FROM b LEFT JOIN per ON per.doc_id = b.doc_id""",
    "op9_repetition_rules": r"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, g) AS n
            FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (VALUES (3), (8), (101)) s(k) WHERE len(w) >= k) t) u),
        covered AS (SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM windows WHERE n > 1) t GROUP BY doc_id, k),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) t WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        counted AS (
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS n_covered, c.n IS NOT NULL AS long_repeat
            FROM docs d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN covered a ON a.doc_id = d.doc_id AND a.k = 3
            LEFT JOIN covered b ON b.doc_id = d.doc_id AND b.k = 8 LEFT JOIN covered c ON c.doc_id = d.doc_id AND c.k = 101)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_covered <= 3 * n_words AND NOT long_repeat AS kept, n_covered
        FROM counted""",
}
