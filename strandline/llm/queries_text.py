"""Queries over documents."""

from __future__ import annotations

import public_tokenizers

from strandline.llm.exact_dedup import exact_dedup
from strandline.llm.language import identify
from strandline.llm.near_dedup import near_groups
from strandline.llm.packing import pack
from strandline.llm.piece_bpe import encode
from strandline.llm.quality_model import quality_scores
from strandline.llm.quality_rules import STOP_WORDS, quality_rules
from strandline.session import table


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality_discriminant(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_language_profiles(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op5_hierarchical_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_piece_dropout(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=17)


QUERIES = {
    "op2_piece_dropout": op2_piece_dropout,
    "op5_hierarchical_packing": op5_hierarchical_packing,
    "op3_language_profiles": op3_language_profiles,
    "op1_quality_rules": op1_quality_rules,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_quality_discriminant": op10_quality_discriminant,
}
_RULES_SQL = """
    WITH w AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
        FROM documents
    ),
    windows AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    covered AS (
        SELECT doc_id, count(DISTINCT p) AS n
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM windows) WHERE k > 1)
        GROUP BY doc_id
    ),
    m AS (
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
               len(ls)::BIGINT AS n_lines, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
               len(list_filter(ws, lambda x: list_contains([STOPS], lower(x))))::BIGINT AS n_stop_words,
               len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_same_words
        FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
    ),
    r AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               n_words BETWEEN 50 AND 1000000 AS pass_length,
               n_words = 0 OR word_chars / n_words BETWEEN 2 AND 20 AS pass_word_length,
               n_words = 0 OR n_symbols / n_words <= 0.3 AS pass_symbols,
               n_words = 0 OR n_exclamations / n_words <= 0.5 AS pass_exclamations,
               n_words = 0 OR n_stop_words / n_words BETWEEN 0.01 AND 0.9 AS pass_stop_words,
               n_lines = 0 OR n_dup_lines / n_lines <= 0.5 AS pass_repeated_lines,
               n_words = 0 OR n_same_words / n_words <= 0.3 AS pass_same_words
        FROM m
    )
    SELECT *, NOT base_failed AND pass_length AND pass_word_length AND pass_symbols AND pass_exclamations AND pass_stop_words AND pass_repeated_lines AND pass_same_words AS kept
    FROM r
"""

ORACLES = {
    "op1_quality_rules": _RULES_SQL.replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS)),
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
