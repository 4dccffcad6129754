"""The training-data queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe_round_trip
from .ctw import op2_ctw_scoring
from .decontamination import op4_spaced_seed_leaks
from .language_id import op6_language_id
from .near_dedup import op10_order_minhash
from .quality_model import op8_quality_classifier
from .quality_rules import MEASURES, RULES, STOP_WORDS, Rule, op1_quality_rules
from .repeats import op3_repeated_strings
from .sharding import op7_jump_sharding
from .token_files import op9_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ctw_scoring": op2_ctw_scoring,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_spaced_seed_leaks": op4_spaced_seed_leaks,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_language_id": op6_language_id,
    "op7_jump_sharding": op7_jump_sharding,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_order_minhash": op10_order_minhash,
}

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))


def _broken(r: Rule) -> str:
    m = f"({MEASURES[r.measure]})"
    bad = [f"{m} < {r.low}"] * (r.low is not None) + [f"{m} > {r.high}"] * (r.high is not None)
    return f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END"


# Sharding needs CRC-32, which DuckDB hasn't; the rest are models, sketches and tokenizers. Tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) u(i)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, range(5) r(k) GROUP BY 1),
lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
counted AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_capitals
  FROM lined LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {", ".join(map(_broken, RULES))}) AS broken_rules FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept,
  n_lines, n_stop_words, n_capitals, broken_rules FROM judged""",
}
