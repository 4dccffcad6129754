"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed looks at consecutive tokens and ignores those under the zeros of a fixed mask, so a
replaced token breaks only the seeds that look at it. Masks are chosen so that wherever the tokens
that may differ lie, one of them looks past all: every pair that the rule below calls a leak has a
seed. Seeds at every position of the benchmark items are a table
(hash, item, position); every position of every document is looked up in it, and around each hit
the item is laid over the document and compared token by token.

A pair is a leak when, in one alignment, some ``run`` consecutive tokens of the item (all of them if
it has fewer) agree with the document in at least ``agree`` of their places.

Plan: one narrow pass over the documents per block of benchmark items; positions are exploded first,
so that seeds are plain expressions of compiled code. Items longer than PIECE tokens are cut in pieces
that overlap by ``run`` - 1 tokens, which holds every run of the rule. A block has TOKENS_PER_BLOCK item
tokens on average and at most a piece more per item, which bounds both tables that are broadcast, in
bytes; a larger benchmark makes more blocks, not larger ones. Only hits are shuffled, after each was
laid out over the runs that hold its seed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RUN = 13
AGREE = 0.8
#: By (tokens, how many of them may differ): masks of which one, somewhere within, looks at none that differs.
LOSSLESS = {
    (13, 2): ("11101011", "11001111"),
    (12, 2): ("11101011", "101100111", "111111"),
    (11, 2): ("111101", "110010011"),
    (10, 2): ("111011", "11010011", "11111"),
    (9, 1): ("111111", "1110111"),
    (8, 1): ("11111", "111011"),
    (7, 1): ("11111", "111011", "110111"),
    (6, 1): ("1111", "11011"),
    (5, 1): ("1111", "11101", "11011", "10111"),
}
TOKENS_PER_BLOCK = 500_000
PIECE = 512


def lossless_masks(n: int, agree: float = AGREE) -> tuple[str, ...]:
    """Masks that find ``n`` tokens with as many differing ones as ``agree`` allows, wherever those lie.

    Without an entry in LOSSLESS: the longest run that agrees in any case.
    """
    differ = n - max(1, math.ceil(n * agree))
    return LOSSLESS.get((n, differ)) or ("1" * math.ceil((n - differ) / (differ + 1)),)


def token_hashes(text: Column) -> Column:
    """One long for each run of letters and digits, lower-cased; null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _at_positions(rows: DataFrame, masks: Sequence[str]) -> DataFrame:
    """``rows`` (hashes, n) once for each token position ``_i`` and mask ``_mask``, with ``_seed``.

    Tokens past the end of a text are left out of its seeds, which then are none of an item.
    """
    at = rows.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_i"))
    seeds = [F.xxhash64(F.lit(m), *(F.get("hashes", F.col("_i") + k) for k, bit in enumerate(m) if bit == "1")) for m in masks]
    return at.select("*", F.posexplode(F.array(*seeds)).alias("_mask", "_seed"))


def _item_seeds(items: DataFrame, families: dict[int, Sequence[str]], masks: Sequence[str], run: int) -> DataFrame:
    """(seed, item, position, mask) for the masks of an item's own length, all positions where the mask fits."""
    wanted = F.lit(False)
    for i, m in enumerate(masks):
        here = F.col("n").isin([k for k, family in families.items() if k < run and m in family])
        if m in families[run]:
            here = here | (F.col("n") >= run)
        wanted = wanted | ((F.col("_mask") == i) & here & (F.col("_i") <= F.col("n") - len(m)))
    return _at_positions(items, masks).where(wanted).select("_seed", "_item", F.col("_i").alias("_j"), F.col("_mask").alias("_by"))


def _best_run(hashes: Column, item: Column, offset: Column, run: int) -> Column:
    """Most agreeing tokens in ``run`` consecutive ones of the item laid over the document at ``offset``."""
    agrees = F.transform(item, lambda x, k: F.when(F.get(hashes, offset + k) == x, F.lit(1)).otherwise(F.lit(0)))

    def swept(m: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("now"), F.lit(0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            now = acc["now"] + x - F.when(acc["k"] >= run, F.get(m, acc["k"] - run)).otherwise(F.lit(0))
            return F.struct((acc["k"] + 1).alias("k"), now.alias("now"), F.greatest(acc["best"], now).alias("best"))

        return F.aggregate(m, start, step, lambda acc: acc["best"])

    return F.element_at(F.transform(F.array(agrees), swept), 1)


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[str] | None = None,
    run: int = RUN,
    agree: float = AGREE,
    tokens_per_block: int = TOKENS_PER_BLOCK,
    piece: int = PIECE,
) -> DataFrame:
    """One row for each document and benchmark item that it contains: doc_id, item_id, n_item_tokens, n_agreeing.

    Null or empty documents contain nothing; null or token-less items are contained nowhere.
    Repeated documents or items count once for each pair of ids; null ids are ids like any other.
    An empty table on either side gives an empty result. Only ids and texts are read, so extra
    columns can't clash. Texts and items of any length are searched whole. Every leak is found, but for
    items of ``run`` tokens or more under ``masks`` of one's own. ``n_agreeing`` is the most that agree in a run.
    """
    if masks is not None and (not masks or any(len(m) > run or set(m) - {"0", "1"} or "1" not in m for m in masks)):
        raise ValueError(f"masks must be at most {run} zeros and ones")
    if piece < 2 * run:
        raise ValueError("piece must be twice run or more")
    items = benchmark.select(F.col(item_col).alias("_item_id"), token_hashes(F.col(item_text_col)).alias("hashes")).distinct()
    items = items.withColumn("_n_item", F.size("hashes")).where("_n_item > 0")
    begins = F.when(F.col("_n_item") > piece, F.sequence(F.lit(0), F.col("_n_item") - run, F.lit(piece - run + 1))).otherwise(F.array(F.lit(0)))
    items = items.select("_item_id", "_n_item", "hashes", F.explode(begins).alias("_begin")).withColumn("hashes", F.slice("hashes", F.col("_begin") + 1, piece)).drop("_begin")
    items = items.withColumns({"n": F.size("hashes"), "_item": F.xxhash64(F.col("_item_id").cast("string"), "hashes")})
    facts = items.agg(F.sum("n").alias("tokens"), F.collect_set(F.when(F.col("n") < run, F.col("n"))).alias("short"), F.max("n").alias("longest")).first()
    blocks = max(1, math.ceil((facts.tokens or 0) / tokens_per_block))
    families = {n: lossless_masks(n, agree) for n in sorted(facts.short)}
    families[run] = tuple(masks or lossless_masks(run, agree)) if (facts.longest or run) >= run else ()
    masks = [*dict.fromkeys(m for n in sorted(families, reverse=True) for m in families[n])]

    texts = documents.select(F.col(id_col).alias("_doc_id"), token_hashes(F.col(text_col)).alias("hashes")).withColumn("n", F.size("hashes"))
    places = _at_positions(texts, masks).select("_doc_id", F.col("hashes").alias("_hashes"), "_i", "_seed")
    spans = F.array(*(F.lit(len(m)) for m in masks))
    found = []
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.col("_item"), F.lit(blocks)) == block)
        hits = places.join(F.broadcast(_item_seeds(mine, families, masks, run)), "_seed")
        hits = hits.join(F.broadcast(mine.select("_item", "_item_id", "_n_item", "hashes", "n")), "_item")
        # all runs that hold the seed's tokens
        first = F.greatest(F.col("_j") + F.get(spans, F.col("_by")) - run, F.lit(0))
        around = F.slice(F.col("hashes"), first + 1, F.least(F.col("_j") + run, F.col("n")) - first)
        best = _best_run(F.col("_hashes"), around, F.col("_i") - F.col("_j") + first, run)
        found.append(hits.select("_doc_id", "_item_id", "_n_item", best.alias("best")))
    every = reduce(DataFrame.unionByName, found)
    # judged by pair, so that an alignment is laid out once for each hit and not again to filter by it
    pairs = every.groupBy(F.col("_doc_id").alias("doc_id"), F.col("_item_id").alias("item_id")).agg(F.max("_n_item").cast("long").alias("n_item_tokens"), F.max("best").cast("long").alias("n_agreeing"))
    return pairs.where(F.col("n_agreeing") >= F.ceil(F.least(F.col("n_item_tokens"), F.lit(run)) * F.lit(agree)))


def without_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` but for those that contain an item; rows with equal ids go or stay together, a null id like any other."""
    bad = leaks(documents, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("_leaking")).distinct()
    return documents.join(bad, documents[id_col].eqNullSafe(bad["_leaking"]), "left_anti")


def op4_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
