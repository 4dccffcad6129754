"""From raw documents to token ids: five stages, each one operator over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import bpe, decontamination, language_id, near_dedup, repeats
from loomframe.llm.common import id_remainder, stored, table
from loomframe.plans.core import named

LEAST_CERTAINTY = 0.05
PASSAGE_BYTES = 200
PASSAGE_GRAM = 64
PASSAGE_WORDS = 50
PASSAGE_VARIETY = 10


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages go on.

    Rejected are null texts, texts without a letter, and texts for which the network is not even
    LEAST_CERTAINTY of the way from an even guess to certainty. It learns from the documents whose crc32 of the id modulo 4 is not 2;
    where these have no language at all, every text with a letter goes on. Repeated rows fare alike;
    an empty table stays empty.
    """
    net = language_id.fit(docs.where(id_remainder("doc_id", 4) != 2))
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("_row"), F.col("text").alias("_text"))
    found = language_id.predict(rows, net, "_text")
    if net.languages:
        guess = 1 / len(net.languages)
        found = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= guess + LEAST_CERTAINTY * (1 - guess)))
    else:
        found = found.where(F.col("_text").rlike("\\p{L}"))
    return found.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id goes on.

    Null and blank texts are in no class and stay; of rows equal in id and text one stays; an empty
    table stays empty.
    """
    return near_dedup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in other documents too are cut out, in whole characters; texts of which nothing is left go.

    A passage is a run of PASSAGE_WORDS words or more, PASSAGE_VARIETY of them different, all within
    strings of PASSAGE_BYTES bytes that some other document has as well. What a document repeats only
    within itself, and runs of one word, are no passages. Null texts become empty; equal rows lose the
    same; an empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*map(named, others)).alias("_row"), "text")
    cut = repeats.remove_repeats(rows, id_col="_row", length=PASSAGE_BYTES, gram=PASSAGE_GRAM, whole_characters=True, across=True, min_words=PASSAGE_WORDS, min_distinct_words=PASSAGE_VARIETY)
    cut = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0))
    kept = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(kept[c].alias(c) if c in kept else F.col("doc_id").getField(c).alias(c) for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null texts contain none, and without items all stay."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number and the SHA-256 of the bytes they decode to; one row per document, null is the empty text."""
    return bpe.encode(docs, decoded=True).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared work folder and read by the next.

    An empty table gives an empty result; extra columns go along as far as the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, sketches and a tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
