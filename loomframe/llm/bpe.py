"""Byte-level BPE encoding through a global shuffle of distinct words, and decoding.

Pre-tokens are cut from whole texts with their positions and grouped in chunks of a few MB of
documents. In a chunk, each distinct word is kept once and the positions are a packed array of word
numbers. The distinct words of all chunks are shuffled by hash, each word of the corpus is encoded
once where its hash lives, and the ids go back to the chunks that asked, where each document is put
together by position. So no step holds the vocabulary of the corpus, nothing is broadcast but the
tokenizer's own file, and a word that fills a third of the corpus is one row per chunk.

Decoding joins ids with the tokenizer's table of token bytes, whose size the tokenizer fixes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import cogrouped, grouped, narrow, small_batches, table
from .packing import pack, smallest, unpack
from .textkernels import U, Words, gathered, prefix_hash, pretoken_starts, slices, span_hash

CHUNK_BYTES = 8 << 20
_PAYLOAD = -1


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def _encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _token_bytes(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and bytes of every id."""
    pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, content.splitlines()) if a]
    tokens = [b""] * (max((i for i, _ in pairs), default=-1) + 1)
    for i, t in pairs:
        tokens[i] = t
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(tokens), np.uint8)


class _Chunk:
    """Distinct words of some documents and, for each pre-token, the number of its word."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.words = Words()
        self.stream: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        start = pretoken_starts(data, offsets)
        end = np.append(start[1:], len(data))[: len(start)]
        self.stream.append(self.words.numbers(data, start, end))
        self.counts.append(np.diff(np.searchsorted(start, offsets)))
        self.ids.append(ids)
        self.size += len(data)

    def rows(self, buckets: int, payload: bool) -> Iterator[tuple[int, bytes, pa.Array | None]]:
        """Words by bucket, or the stream that refers to them; both number the words by (bucket, first seen)."""
        words = self.words
        hashes = words.hashes[: words.count]
        bucket = ((hashes >> U(20)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        if payload:
            stream = np.concatenate([*self.stream, np.empty(0, np.int32)])
            use = np.bincount(stream, minlength=len(hashes))
            rank_of = np.empty(len(hashes), np.int64)
            by_use = np.argsort(-use, kind="stable")
            rank_of[by_use] = np.arange(len(hashes))
            place = np.empty(len(hashes), np.int64)
            place[order] = np.arange(len(hashes))
            ids = pa.concat_arrays(self.ids)
            # frequent words get small numbers, which pack tighter
            yield _PAYLOAD, pack(smallest(rank_of[stream]), smallest(place[by_use]), smallest(np.concatenate(self.counts))), ids
            return
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            mine = order[edges[b] : edges[b + 1]]
            yield int(b), pack(smallest(words.lengths[mine]), gathered(words.starts[mine], words.lengths[mine], words.bytes)), None


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, payload: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The chunks of one partition; a chunk's number holds the partition's, so a repeated task gives it again."""
    top, n = TaskContext.get().partitionId() << 24, 0
    chunk = _Chunk()

    def ended() -> Iterator[pa.RecordBatch]:
        for part, blob, ids in chunk.rows(buckets, payload):
            lists = pa.array([None], pa.list_(kind)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([top + n], pa.int64()), pa.array([part], pa.int32()), pa.array([blob], pa.binary()), lists], names=["chunk", "part", "blob", "ids"])

    for batch in batches:
        for s in slices(batch.column(1)):
            chunk.add(batch.column(0)[s.first : s.last], s.data, s.offsets)
            if chunk.size >= CHUNK_BYTES:
                yield from ended()
                chunk, n = _Chunk(), n + 1
    if chunk.ids:
        yield from ended()


def _encoded_words(encode: Callable[[list[bytes]], list[list[int]]]) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: every distinct word encoded once, its ids sent to each chunk that has it."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = [unpack(b) for b in rows["blob"].to_pylist()]
        lengths = np.concatenate([b[0] for b in blobs]).astype(np.int64)
        data = np.concatenate([b[1] for b in blobs])
        end = np.cumsum(lengths)
        # the hash only groups: words are told apart by their bytes
        h = span_hash(prefix_hash(data), end - lengths, end)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[end[i] - lengths[i] : end[i]] for i in first]
        same = lengths[first][which] == lengths
        same[same] = _equal_spans(data, (end - lengths)[first][which][same], (end - lengths)[same], lengths[same])
        for i in np.flatnonzero(~same):
            which[i] = len(words)
            words.append(raw[end[i] - lengths[i] : end[i]])
        ids = encode(words)
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum()))
        starts = np.cumsum(n) - n
        out, at = [], 0
        for b in blobs:
            mine = which[at : at + len(b[0])]
            at += len(b[0])
            out.append(pack(smallest(n[mine]), smallest(gathered(starts[mine], n[mine], flat))))
        return pa.table({"chunk": rows["chunk"], "part": rows["part"], "blob": pa.array(out, pa.binary()), "ids": pa.nulls(len(out), rows.schema.field("ids").type)})

    return run


def _equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ok = data[np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] == gathered(b, lengths, data)
    return np.minimum.reduceat(ok, np.cumsum(lengths) - lengths) if len(lengths) else np.empty(0, bool)


def _assembled(content: bytes | None, packed_ids: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The documents of one chunk, each put together by position; decoded again if the ranks are given."""

    def run(words: pa.Table, chunk: pa.Table) -> pa.Table:
        if len(chunk) != 1:
            raise RuntimeError("a chunk was cut otherwise when it was read again: its input isn't deterministic")
        stream, place, counts = unpack(chunk["blob"][0].as_py())
        blobs = dict(zip(words["part"].to_pylist(), words["blob"].to_pylist(), strict=True))
        back = [unpack(blobs.pop(p)) for p in sorted(blobs)]
        n = np.concatenate([*(b[0].astype(np.int64) for b in back), np.empty(0, np.int64)])
        if len(n) != len(place):
            raise RuntimeError("a chunk was cut otherwise when it was read again: its input isn't deterministic")
        flat = np.concatenate([*(b[1].astype(np.int32) for b in back), np.empty(0, np.int32)])
        starts = np.cumsum(n) - n
        word = place.astype(np.int64)[stream]
        lengths = n[word]
        ids = gathered(starts[word], lengths, flat)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts.astype(np.int64))])]
        out = {"doc_id": chunk["ids"].combine_chunks().flatten()}
        out["ids"] = _binary(ids.astype("<u4").view(np.uint8), 4 * ends) if packed_ids else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        if content is not None:
            raw, bounds = _bytes_of(content, ids, ends)
            out["decoded"] = _binary(raw, bounds)
        return pa.table(out)

    return run


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _bytes_of(content: bytes, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table joined to ids: all bytes, and the bounds of each list's bytes."""
    start, length, data = _token_bytes(content)
    sizes = length[ids]
    return gathered(start[ids], sizes, data), np.concatenate([[0], np.cumsum(sizes)])[ends]


def encode(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, buckets: int | None = None, packed_ids: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every text, as tiktoken would encode it without special tokens.

    ``packed_ids`` gives the ids as the bytes of little-endian unsigned 32-bit integers instead;
    ``decoded`` adds the bytes that the ids decode to, made in the same pass as the ids.

    ``vocabulary`` is the path of a file of ranks; its content travels with the tasks. Null and
    empty texts have no ids. Null ids, repeated rows and ties stay, one output row each; an empty
    table gives an empty result. Only ``id_col`` and ``text_col`` are read, so extra columns can't
    clash. ``df`` is read twice and must give the same rows in the same order both times, as a scan
    of files does; where it does not, the query fails rather than mix up words.
    """
    with open(vocabulary or vocabulary_file(), "rb") as f:
        content = f.read()
    pattern = pattern or _pattern()
    small_batches(df.sparkSession)
    buckets = buckets or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = StructType([StructField("chunk", LongType()), StructField("part", IntegerType()), StructField("blob", BinaryType()), StructField("ids", ArrayType(id_type))])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def cut(payload: bool) -> DataFrame:
        return rows.mapInArrow(narrow(lambda batches: _chunks(batches, buckets, payload, kind)), schema)

    def tokens(words: list[bytes]) -> list[list[int]]:
        e = _encoding(content, pattern)
        return [e.encode_ordinary(w.decode("utf-8")) for w in words]

    back = cut(False).groupBy("part").applyInArrow(grouped(_encoded_words(tokens)), schema)
    out = StructType([StructField("doc_id", id_type), StructField("ids", BinaryType() if packed_ids else ArrayType(IntegerType())), *[StructField("decoded", BinaryType())] * decoded])
    # a cogroup, so that both scans are stages of their own and number their partitions alike
    return back.groupBy("chunk").cogroup(cut(True).groupBy("chunk")).applyInArrow(cogrouped(_assembled(content if decoded else None, packed_ids)), out)


def decode(df: DataFrame, vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of each list of ids; null and empty lists give no bytes.

    A column of ``df`` named ``decoded`` is replaced.
    """
    with open(vocabulary or vocabulary_file(), "rb") as f:
        content = f.read()
    df = df.drop("decoded")
    where = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(where)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, bounds = _bytes_of(content, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(raw, bounds)], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(narrow(run), StructType([*df.schema.fields, StructField("decoded", BinaryType())]))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), packed_ids=True, decoded=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
