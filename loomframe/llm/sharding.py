"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in built-in functions only.

The generator of the paper is a 64-bit linear congruential one that relies on wrap-around.
Spark's ANSI arithmetic raises on overflow, so the state is held as two 32-bit halves in longs and
multiplied limb by limb; no intermediate value leaves the range of a long.

A shard's slots are gapless but its rows are never gathered in one task: rows are numbered inside
(shard, bucket), and a bucket's first slot is the running count of the buckets before it, computed
over a table of shards x buckets rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, text_or_empty

MULTIPLIER = 2862933555777941757
BLOCK = 10_000
_LOW = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of ``state * MULTIPLIER + 1`` modulo 2**64."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    m1, m0 = m_lo >> 16, m_lo & 0xFFFF
    high_part = lo * F.lit(m1)
    low_sum = lo * F.lit(m0) + F.lit(1) + F.shiftleft(high_part.bitwiseAND(F.lit(_LOW)), 16)
    carry = F.shiftright(low_sum, 32) + F.shiftleft(F.shiftright(high_part, 32), 16)
    cross = (hi * F.lit(m0)).bitwiseAND(F.lit(_LOW)) + F.shiftleft((hi * F.lit(m1)).bitwiseAND(F.lit(0xFFFF)), 16) + (lo * F.lit(m_hi)).bitwiseAND(F.lit(_LOW))
    return (carry + cross).bitwiseAND(F.lit(_LOW)), low_sum.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard 0 to ``shards`` - 1 of a long key; appending a shard moves rows only into it."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = key.cast("long")
    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(F.lit(_LOW)).alias("hi"),
        key.bitwiseAND(F.lit(_LOW)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(s: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])

        def landed(n: Column) -> Column:
            j = ((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(n["hi"], 1) + 1).cast("double"))).cast("long")
            return F.struct(n["hi"].alias("hi"), n["lo"].alias("lo"), s["j"].alias("b"), j.alias("j"))

        return let(F.struct(hi.alias("hi"), lo.alias("lo")), landed)

    # each jump goes at least one shard further, so there are at most `shards` of them
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, lambda s, _: F.when(s["j"] < shards, jump(s)).otherwise(s), lambda s: s["b"].cast("int"))


def shard_key(id_col: Column) -> Column:
    """A stable long of an id of any type, the same in every session; null is a key of its own."""
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("\x00null")))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, buckets: int | None = None) -> DataFrame:
    """One row per input row: its size, checksum, shard, slot in the shard and shard after growth by one.

    Null text has size 1 and the checksum of no bytes; a null id is hashed as one fixed key.
    Repeated rows go to the same shard and get different slots. An empty table gives an empty
    result. Only ``id_col`` and ``text_col`` are read, so extra columns can't clash.

    Rows that are equal in id, size and checksum are interchangeable: they are counted before the
    shuffle, take a run of slots together and are written out again in runs of BLOCK, so that a row
    that fills a third of the table is no more than a count until the end. ``buckets`` are the parts
    that a shard is numbered in (default: the session's shuffle partitions, 64 at least); they
    change slots, never shards.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = text_or_empty("text")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_key", shard_key(F.col("doc_id")))
    rows = rows.withColumns({"shard": jump_hash(F.col("_key"), shards), "grown_shard": jump_hash(F.col("_key"), shards + 1)})
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    each = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(each, ["shard", "_bucket"])
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(BLOCK).cast("long")))).repartition("_key", "_block")
    last = F.least(F.col("_block") + BLOCK, F.col("_n")) - 1
    rows = rows.withColumn("_in", F.explode(F.sequence(F.col("_block"), last)))
    slot = (F.col("_first") + F.col("_at") + F.col("_in")).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
