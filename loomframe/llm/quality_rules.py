"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the text of its own row, so the operator is one
narrow projection: no shuffle, no user function, no state. Its cost is linear in the text but for
one sort of a document's own word windows, and that only where the document repeats a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

SPACE = "\\x20\\x09-\\x0D"
WINDOW = 5

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the be to of and that have with in is was for on are as by at from this it an or".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= measure <= high``; an absent bound is not tested."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The measures that rules can name: SQL over the base columns.
MEASURES = {
    "words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    "capital_ratio": "n_capitals / greatest(word_chars, 1)",
}

RULES = (
    Rule("length", "words", 10, None),
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("dup_lines", "dup_line_ratio", None, 0.3),
    Rule("repeats", "repeat_word_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("capitals", "capital_ratio", None, 0.5),
)


def _repeat_words(n_words: Column, hashes: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        at = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

        def count(ranked: Column) -> Column:
            twice = F.filter(
                F.transform(
                    ranked,
                    lambda r, j: F.when(
                        F.coalesce(F.get(ranked, j - 1)["w"] == r["w"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["w"] == r["w"], F.lit(False)),
                        r["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                F.sort_array(twice),
                start,
                lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(F.sort_array(at), count)).otherwise(F.lit(0))

    windows = F.transform(F.sequence(F.lit(0), n_words - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    return F.when(n_words >= WINDOW, let(windows, covered)).otherwise(F.lit(0))


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base counts of ``text_col`` (null counts as the empty text)."""
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    df = df.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumns({"_words": F.regexp_extract_all("_text", F.lit(f"[^{SPACE}]+"), F.lit(0)), "_lines": lines})
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": _repeat_words(n, F.col("_hashes")).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(stops))).cast("long"),
            "n_capitals": (F.length("_text") - F.length(F.regexp_replace("_text", "\\p{Lu}+", ""))).cast("long"),
        }
    )
    return df.drop("_text", "_words", "_lines", "_hashes")


def compiled(rules: Sequence[Rule]) -> Column:
    """The names of the rules that a row breaks, as one array expression."""
    if unknown := {r.measure for r in rules} - MEASURES.keys():
        raise ValueError(f"unknown measures: {sorted(unknown)}")

    def broken(r: Rule) -> Column:
        m = F.expr(MEASURES[r.measure])
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < F.lit(r.low))
        if r.high is not None:
            bad = bad | (m > F.lit(r.high))
        return F.when(bad, F.lit(r.name))

    return F.array_compact(F.array(*map(broken, rules))) if rules else F.array().cast("array<string>")


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: the base counts, ``broken_rules`` and ``kept``.

    Null or empty text: all counts 0, hence ``base_failed`` and not kept. Null ids, repeated rows
    and ties stay as they are, one output row for each. An empty table gives an empty result. Only
    ``id_col`` and ``text_col`` are read, so extra columns of any name can't clash.
    """
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df = measured(df).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    df = df.withColumn("broken_rules", compiled(rules))
    kept = ~F.col("base_failed") & (F.size("broken_rules") == 0)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select("doc_id", *counts, "base_failed", kept.alias("kept"), "n_lines", "n_stop_words", "n_capitals", F.array_join("broken_rules", ",").alias("broken_rules"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
