"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, filter_audit, prefix_trie
from .decontamination import op2_benchmark_decontamination
from .filter_audit import op12_filter_audit
from .html_extraction import op8_html_extraction
from .jaccard_join import op10_ngram_jaccard_join
from .license_scan import op1_license_scan
from .nearest import op13_nearest_neighbours
from .packing import op6_packing
from .pii import op5_pii
from .prefix_trie import op11_prefix_trie
from .quality_classifier import op4_quality_classifier
from .quality_rules import op7_quality_rules, rule_ablation
from .token_counts import op3_token_counts
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "rule_ablation": rule_ablation,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

#: The ledger, as the table f.
LEDGER_SQL = r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
        p AS (SELECT r, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
              FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1),
        rep AS (SELECT r, count(DISTINCT i + k) AS n FROM q, (VALUES (0), (1), (2)) v(k) GROUP BY r),
        l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM l GROUP BY r),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
                     coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                     coalesce(n_lines, 0)::BIGINT AS n_lines,
                     len([x for x in w if regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')])::BIGINT AS n_letter_words
              FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
        f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
                     + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (10 * n_dup_lines > 4 * n_lines)::BIGINT
                     + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
                     + 32 * (10 * n_letter_words < 7 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": decontamination.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op7_quality_rules": f"""{LEDGER_SQL}
        SELECT *, fail_bits = 0 AS kept, fail_bits & 3 <> 0 AS base_failed, 'v2' AS policy, fail_bits & 3 = 0 AS kept_v1,
               CASE fail_bits WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
                              WHEN 16 THEN 'short_or_long_words' WHEN 32 THEN 'few_letter_words' END AS kept_without FROM f
    """,
    "rule_ablation": f"""{LEDGER_SQL},
        v AS (SELECT * FROM (VALUES ('v1', 3), ('v2', 63)) t(policy, mask)),
        u AS (SELECT * FROM (VALUES ('too_few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8),
                                    ('short_or_long_words', 16), ('few_letter_words', 32)) t(rule, bit))
        SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_failed_alone,
               count(*) FILTER (fail_bits & mask = 0) + count(*) FILTER (fail_bits & mask = bit) AS n_kept_without
        FROM f, v, u WHERE mask & bit <> 0 GROUP BY policy, rule
    """,
}
