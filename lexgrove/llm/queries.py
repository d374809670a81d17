"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import (
    exact_dedup, fill_middle, language_id, lexical_search, license_scan, lm_scoring, mixing, packing, quality_rules,
    secret_scan, simhash_dedup, suffix_dedup, warc,
)
from lexgrove.llm.common import table
from lexgrove.llm.oracles import LATER_ORACLES


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(named, language_id.fit(docs), "doc_id", "held_out").select(
        "doc_id", "held_out", "lang_pred", F.col("score"), "ambiguous"
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept"
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(table(spark, sf_dir, "documents"), "doc_id")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_warc_archive, op3_simhash_dedup, op4_exact_dedup, op5_suffix_dedup, op6_lm_scoring,
        op7_best_fit_packing, op8_source_mixing, op9_language_id, op10_quality_rules, op11_fill_middle,
        op12_lexical_search, op13_license_scan,
    )
}

ORACLES = LATER_ORACLES | {
    "op2_warc_archive": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages),
        h AS (SELECT *, sha1(payload) AS hex FROM p)
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::INTEGER) & 31)::BIGINT + 1, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> holder THEN holder END AS refers_to
        FROM h""",
    "op10_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS n FROM d),
        e AS (
            SELECT doc_id, n, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
                               lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o] AS eight,
                   lead(n, 7) OVER o IS NOT NULL AS whole
            FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
        f AS (SELECT doc_id, n, count(*) OVER (PARTITION BY doc_id, eight) AS times FROM e WHERE whole),
        r AS (
            SELECT doc_id, count(DISTINCT n + k)::BIGINT AS n_repeat_words
            FROM (SELECT doc_id, n, unnest(range(0, 8)) AS k FROM f WHERE times > 1) GROUP BY doc_id),
        m AS (
            SELECT doc_id, len(words)::BIGINT AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
                   len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
            FROM d LEFT JOIN r USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
                    OR 10 * n_dup_lines > 4 * n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words
                    OR 10 * n_lettered < 7 * n_words) AS kept
        FROM m""",
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_source_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
        w AS (
            SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight,
                   2.0 * source_size AS most, 1.5 * sum(source_size) OVER () AS budget FROM s),
        fill(round, source, target, stopped) AS (
            SELECT 0, source, least(budget * weight / sum(weight) OVER (), most),
                   budget * weight / sum(weight) OVER () >= most FROM w
            UNION ALL
            SELECT round + 1, source, least(level * weight, most), stopped OR level * weight >= most
            FROM (
                SELECT f.round, f.source, f.stopped, w.weight, w.most,
                       (budget - coalesce(sum(most) FILTER (WHERE f.stopped) OVER (), 0))
                       / sum(w.weight) FILTER (WHERE NOT f.stopped) OVER () AS level, f.target
                FROM fill f JOIN w ON f.source IS NOT DISTINCT FROM w.source)
            WHERE round < (SELECT count(*) FROM s)),
        t AS (
            SELECT w.source, w.source_size, fill.target::DOUBLE AS target, round(fill.target)::BIGINT AS quota
            FROM fill JOIN w ON fill.source IS NOT DISTINCT FROM w.source
            WHERE fill.round = (SELECT count(*) FROM s)),
        p AS (
            SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.quota,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - d.size AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        need AS (
            SELECT t.source, (t.quota + 2047) // 2048 AS n,
                   sum((t.quota + 2047) // 2048) OVER (ORDER BY w.no) - (t.quota + 2047) // 2048 AS low,
                   greatest(16, length(bin(sum((t.quota + 2047) // 2048) OVER () - 1))) AS bits
            FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source WHERE t.quota > 0),
        slots AS (SELECT source, bits, unnest(range(low::BIGINT, (low + n)::BIGINT)) AS x FROM need),
        turned AS (
            SELECT source, list_sum(list_transform(range(bits::BIGINT),
                       lambda i: ((x >> i::INTEGER) & 1) * (2 ** (bits - 1 - i))::BIGINT))::BIGINT AS place FROM slots),
        ranked AS (SELECT source, place, row_number() OVER (PARTITION BY source ORDER BY place) - 1 AS block FROM turned),
        passes AS (
            SELECT doc_id, source, pass, start + pass * source_size AS low,
                   least(start + size + pass * source_size, quota) AS high
            FROM p, (VALUES (0), (1)) AS passes(pass) WHERE size > 0),
        met AS (
            SELECT doc_id, source, pass, unnest(range((low // 2048)::BIGINT, ((high - 1) // 2048 + 1)::BIGINT)) AS block
            FROM passes WHERE low < high),
        begun AS (
            SELECT doc_id, min(place) FILTER (WHERE pass = 0) AS first_place, min(place) FILTER (WHERE pass = 1) AS second_place
            FROM met JOIN ranked ON met.source IS NOT DISTINCT FROM ranked.source AND met.block = ranked.block GROUP BY doc_id)
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(start + size, quota) - start)
                + greatest(0, least(start + size, quota - source_size) - start))::BIGINT AS taken, first_place, second_place
        FROM p LEFT JOIN begun USING (doc_id)""",
}
