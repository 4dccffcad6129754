"""Token ids as Parquet files that can be read in parts.

Documents are dealt by ranges of their id and encoded in that order. A file holds one row per
document: ids as a list column with dictionary encoding (a vocabulary's worth of values fits one
dictionary page), id, count and offsets with delta encoding; row groups and pages are of a set size
and have column and page indexes, so a reader takes single columns or single documents.

Each writer keeps the running count of its own part; where a part begins follows from the counts of
the parts before it, read back from two small columns. No task sees more than one part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import small_batches, table, work_dir
from .textkernels import Words, gathered, pretoken_starts, slices

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2000
MEMO_WORDS = 1 << 19


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


@cache
def _added(content: str) -> re.Pattern[bytes] | None:
    """Finds the strings that the tokenizer takes out of a text before it cuts words."""
    found = json.loads(content).get("added_tokens", [])
    if any(t.get(k) for t in found for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take white space or whole words are not supported")
    return re.compile(b"|".join(re.escape(t["content"].encode()) for t in sorted(found, key=lambda t: -len(t["content"])))) if found else None


def _cut_out(pattern: re.Pattern[bytes], raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """(start, end) of each match inside a text."""
    hits = [m.span() for m in pattern.finditer(raw)]
    if any(len(set(np.searchsorted(offsets, [a, b - 1], "right").tolist())) > 1 for a, b in hits):  # over the border of two texts
        bounds = offsets.tolist()
        hits = [(lo + a, lo + b) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for a, b in (m.span() for m in pattern.finditer(raw[lo:hi]))]
    return np.array(hits, np.int64).reshape(-1, 2)


class _Memo:
    """Ids of the pre-tokens seen so far, at most MEMO_WORDS of them beside one slice's; then it starts anew."""

    def __init__(self, content: str) -> None:
        self.encode, self.added = _tokenizer(content).encode_batch_fast, _added(content)
        self.clear()

    def clear(self) -> None:
        self.words, self.starts, self.lengths, self.ids, self.used = Words(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), 0

    def _room(self, name: str, need: int) -> np.ndarray:
        a = getattr(self, name)
        if len(a) < need:
            a = np.concatenate([a, np.empty(max(need, 2 * len(a)) - len(a), a.dtype)])
            setattr(self, name, a)
        return a

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens begin; an added token is one."""
        raw = data.tobytes() if self.added else b""
        hits = _cut_out(self.added, raw, offsets) if self.added and self.added.search(raw) else ()
        if not len(hits):
            return pretoken_starts(data, offsets)
        start = pretoken_starts(data, np.unique(np.concatenate([offsets, hits.ravel()])))
        last = np.searchsorted(hits[:, 0], start, "left") - 1  # the last match that begins before
        return start[(last < 0) | (hits[last, 1] <= start)]

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if self.words.count > MEMO_WORDS:
            self.clear()
        start = self._cut(data, offsets)
        words, known = self.words, self.words.count
        at = words.numbers(data, start, np.append(start[1:], len(data))[: len(start)])
        if words.count > known:
            lo, size = words.starts[known : words.count], words.lengths[known : words.count]
            raw, base = words.bytes[lo[0] : words.size].tobytes(), int(lo[0])
            got = [e.ids for e in self.encode([raw[a : a + b].decode() for a, b in zip((lo - base).tolist(), size.tolist(), strict=True)], add_special_tokens=False)]
            n = np.array([len(x) for x in got], np.int64)
            total = int(n.sum())
            self._room("ids", self.used + total)[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.int32, total)
            self._room("lengths", words.count)[known : words.count] = n
            self._room("starts", words.count)[known : words.count] = self.used + np.cumsum(n) - n
            self.used += total
        n = self.lengths[at]
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offsets)]
        return gathered(self.starts[at], n, self.ids), np.diff(bounds)


@cache
def _memo(content: str) -> _Memo:
    """One for each worker, which goes from task to task: a cache of a pure function."""
    return _Memo(content)


def write(df: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of every text, ``end_id`` after each, in ascending order of id (nulls first, ties by a hash of the text).

    Ids are those of the tokenizers library without special tokens added: a string of the tokenizer's
    added tokens in a text is that token. Null and empty texts are the end id alone. Repeated rows
    are written as often as they come, and may go to different files. An empty table is written as
    files without rows. A text is encoded as a whole by one task, in memory of some times its
    length. Extra columns aren't read.
    """
    with open(tokenizer or tokenizer_file(), encoding="utf-8") as f:
        content = f.read()
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # the row's place in the scan parts equal rows, so that many of them are not one task
    order.append(F.col("_tie"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    schema = StructType([StructField("part", IntegerType()), StructField("first", LongType()), rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("tokens", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, memo = TaskContext.get().partitionId(), 0, _memo(content)
        for batch in batches:
            for s in slices(batch.column(1)):
                ids, n = memo.encoded(s.data, s.offsets)
                ends = np.cumsum(n)
                flat = np.insert(ids, ends, end_id)
                n = n + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                firsts = pa.array(first + ends[:-1])
                first += int(ends[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), firsts, batch.column(0)[s.first : s.last], pa.array(n), lists], names=schema.names)

    writer = rows.mapInArrow(run, schema).write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
    for name in ("first", "doc_id", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked, ``tokens``; only what is asked is read.

    Where each part begins is broadcast: one row a file, of which ``write`` makes at most
    spark.sql.shuffle.partitions. Rows come as they were written, repeated ones too; an empty table has none.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(parts), "part").withColumn("start", (F.col("_before") + F.col("first")).cast("long"))
    return rows.select("doc_id", "start", "n_tokens", *["tokens"] * tokens)


def checksums(rows: DataFrame) -> DataFrame:
    """``tokens`` replaced by ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers."""
    schema = StructType([f for f in rows.schema.fields if f.name != "tokens"] + [StructField("ids_crc32", LongType())])
    where = rows.columns.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(where)
            raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            ends = 4 * np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            kept = [c for i, c in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path)
    return checksums(read(spark, path))
