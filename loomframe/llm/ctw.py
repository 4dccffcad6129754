"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own context tree over the DEPTH bytes before it. A
node holds a Krichevsky-Trofimov estimate; a node's weighted probability is the even mixture of its
estimate and the product of its children's. The tree learns from the training documents and is then
frozen: a text's probability is the product, over its bytes and one end byte, of
``weighted(training + bit) / weighted(training)`` along the path of contexts.

Plan. Documents are read in chunks of a few MB. A chunk sends each distinct (context, byte) and each
distinct word once, with its training count, packed by bucket; the bucket of a context is that of
its last two bytes, so a bucket holds whole subtrees and computes them alone. Only the nodes of
depth 2 meet on the driver: at most 2**16 contexts x 255 nodes, whatever the corpus. Buckets then
send each chunk the log-probabilities of what it asked for, and the chunk sums them over its texts.
Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations


from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import cogrouped, grouped, id_remainder, narrow, stored, table
from .packing import pack, smallest, unpack
from .textkernels import LOWER, HashIndex, U, mixed, owner, prefix_hash, slices, span_hash, word_spans

DEPTH = 5
CHUNK_BYTES = 32 << 20
END_WORD = 0x0E4D_0F7E_7700_0001  # stands for the end of a text among word hashes


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: Stirling's series above 10, reached by the recurrence."""
    x = np.asarray(x, float)
    back = np.zeros_like(x)
    small = x < 10
    y = x.copy()
    if small.any():
        z, low = x[small], np.zeros(int(small.sum()))
        for _ in range(10):
            low += np.log(z)
            z = z + 1
        y[small], back[small] = z, low
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y - back


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def mixed_nodes(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln weighted probability, weight of the node's own estimate, own probability of a one).

    ``children`` is the sum of the children's ln weighted probabilities; None for leaves.
    """
    own, one = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if children is None:
        return own, np.ones(len(own)), one
    weighted = np.logaddexp(own, children) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted), one


class Subtrees:
    """Nodes of depth 2 to ``depth`` over sorted distinct codes (context bytes, then the byte) and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int) -> None:
        symbol = codes & U(255)
        context = (codes >> U(8)) << U(8)
        node, bit = [], []
        for level in range(8):
            node.append(context | U(1 << level) | (symbol >> U(8 - level)))
            bit.append((symbol >> U(7 - level)) & U(1))
        self.bit = np.concatenate(bit).astype(bool)
        keys, self.at = np.unique(np.concatenate(node), return_inverse=True)
        n = np.tile(counts.astype(float), 8)
        ones = np.bincount(self.at, n * self.bit, minlength=len(keys))
        zeros = np.bincount(self.at, n * ~self.bit, minlength=len(keys))
        weighted, self.weights, self.ones, self.parents = None, [], [], []
        children = None
        for d in range(depth, 1, -1):
            if d < depth:
                shorter = ((keys >> U(8)) & U((1 << (8 * d)) - 1)) << U(8) | keys & U(255)
                keys, up = np.unique(shorter, return_inverse=True)
                self.parents.append(up)
                zeros, ones, children = (np.bincount(up, a, minlength=len(keys)) for a in (zeros, ones, weighted))
            weighted, w, one = mixed_nodes(zeros, ones, children)
            self.weights.append(w)
            self.ones.append(one)
        self.roots = keys, zeros, ones, weighted

    def log10(self, top: Top) -> np.ndarray:
        """log10 probability of each code's byte in its context."""
        p, at = self.ones[0], np.arange(len(self.ones[0]))
        for up, w, one in zip(self.parents, self.weights[1:], self.ones[1:], strict=True):
            at = up[at]
            p = w[at] * one[at] + (1 - w[at]) * p
        key = self.roots[0][at]
        near, root = (key & U(0xFFFF)).astype(np.int64), (key & U(0xFF)).astype(np.int64)
        p = top.weight1[near] * top.one1[near] + (1 - top.weight1[near]) * p
        p = top.weight0[root] * top.one0[root] + (1 - top.weight0[root]) * p
        p = p[self.at]
        return np.log10(np.where(self.bit, p, 1 - p)).reshape(8, -1).sum(0)


class Top:
    """Nodes of depth 0 and 1, dense by (byte, node)."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> None:
        near = (keys & U(0xFFFF)).astype(np.int64)
        z, o, c = (np.bincount(near, a, minlength=1 << 16) for a in (zeros, ones, weighted))
        own, self.weight1, self.one1 = mixed_nodes(z, o, c)
        z, o, c = (a.reshape(256, 256).sum(0) for a in (z, o, own))
        _, self.weight0, self.one0 = mixed_nodes(z, o, c)


def coded(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of every byte and end byte, and the text it is of; a text begins after ``depth`` zero bytes."""
    lengths = np.diff(offsets)
    n = len(lengths)
    padded = np.zeros(len(data) + n * (depth + 1), U)
    padded[np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, lengths)] = data
    of = np.repeat(np.arange(n), lengths + 1)
    at = np.arange(len(data) + n) + (of + 1) * depth
    code = padded[at]
    for k in range(1, depth + 1):
        code |= padded[at - k] << U(8 * k)
    return code, of


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and of one end for each text, and the text each is of."""
    lowered = LOWER[data]
    start, end = word_spans(lowered, offsets)
    of = owner(offsets, start)
    n = len(offsets) - 1
    h = np.concatenate([span_hash(prefix_hash(lowered), start, end), np.full(n, END_WORD, U)])
    return h, np.concatenate([of, np.arange(n)])


class _Counts:
    def __init__(self) -> None:
        self.index, self.keys, self.n = HashIndex(), [], np.zeros(0)

    def add(self, keys: np.ndarray, counted: np.ndarray) -> None:
        at = self.index.find(keys)
        if (at < 0).any():
            new = np.unique(keys[at < 0])
            self.index.add(new)
            self.keys.append(new)
            at = self.index.find(keys)
        n = np.bincount(at, counted, minlength=self.index.count)
        n[: len(self.n)] += self.n
        self.n = n

    def by_bucket(self, bucket_of: Callable[[np.ndarray], np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
        keys = np.concatenate([*self.keys, np.empty(0, U)])
        bucket = bucket_of(keys) % U(buckets)
        order = np.lexsort((keys, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
        for b in np.flatnonzero(np.diff(edges)):
            mine = order[edges[b] : edges[b + 1]]
            yield int(b), pack(smallest(np.diff(keys[mine], prepend=U(0))), smallest(self.n[mine]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(number, slices with their ids and flags); a number holds its partition's, so a repeated task gives it again."""
    top, n, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
    for batch in batches:
        for s in slices(batch.column(2)):
            held.append((s, batch.column(0)[s.first : s.last], np.array(batch.column(1)[s.first : s.last].to_pylist(), bool)))
            size += len(s.data)
            if size >= CHUNK_BYTES:
                yield top + n, held
                n, held, size = n + 1, [], 0
    if held:
        yield top + n, held


def _asked(depth: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _chunks(batches):
            grams, words = _Counts(), _Counts()
            for s, _, held_out in held:
                for counts, (keys, of) in ((grams, coded(s.data, s.offsets, depth)), (words, word_hashes(s.data, s.offsets))):
                    counts.add(keys, (~held_out)[of].astype(float))
            rows = [*grams.by_bucket(lambda k: mixed((k >> U(8)) & U(0xFFFF)) >> U(20), buckets)]
            rows += [(b + buckets, blob) for b, blob in words.by_bucket(lambda k: mixed(k) >> U(20), buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "part", "blob"])

    return run


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    blobs = [unpack(b) for b in rows["blob"].to_pylist()]
    keys, at = np.unique(np.concatenate([np.cumsum(b[0].astype(U)) for b in blobs]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([b[1] for b in blobs]).astype(float), minlength=len(keys)), at, blobs


def _summary(depth: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Depth-2 nodes of a bucket of contexts; number of words and of their occurrences of a bucket of words."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        keys, n, *_ = _merged(rows)
        if part < buckets:
            blob = pack(*Subtrees(keys, n, depth).roots)
        else:
            blob = pack(np.array([np.count_nonzero(n), n.sum()]))
        return pa.table({"part": pa.array([part], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return run


def _answers(depth: int, buckets: int, top: Top) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        keys, n, at, blobs = _merged(rows)
        value = Subtrees(keys, n, depth).log10(top).astype(np.float32) if rows["part"][0].as_py() < buckets else smallest(n)
        ends = np.cumsum([len(b[0]) for b in blobs])
        out = [pack(b[0], value[at[e - len(b[0]) : e]]) for b, e in zip(blobs, ends.tolist(), strict=True)]
        return pa.table({"chunk": rows["chunk"], "part": rows["part"], "blob": pa.array(out, pa.binary())})

    return run


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for number, held in _chunks(batches):
        data = b"".join(s.data.tobytes() for s, *_ in held)
        ids = pa.concat_arrays([i for _, i, _ in held])
        flags = np.concatenate([f for *_, f in held])
        bound = pa.array([0, len(ids)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([squeeze.compress(data)], pa.binary()), pa.ListArray.from_arrays(bound, ids), pa.ListArray.from_arrays(bound, pa.array(flags)), pa.array([pack(smallest(np.concatenate([np.diff(s.offsets) for s, *_ in held])))], pa.binary())],
            names=["chunk", "blob", "ids", "flags", "lengths"],
        )


def _scored(depth: int, buckets: int, total: float, distinct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(answers: pa.Table, chunk: pa.Table) -> pa.Table:
        if len(chunk) != 1:
            raise RuntimeError("a chunk was cut otherwise when it was read again: its input isn't deterministic")
        tables = []
        parts = np.array(answers["part"].to_pylist())
        blobs = answers["blob"].to_pylist()
        for mine in (parts < buckets, parts >= buckets):
            got = [unpack(blobs[i]) for i in np.flatnonzero(mine)]
            tables.append((HashIndex(np.concatenate([np.cumsum(b[0].astype(U)) for b in got])), np.concatenate([b[1].astype(float) for b in got])))
        (grams, log_p), (words, n) = tables
        base = np.log10((n + 1) / (total + distinct + 1))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(chunk["blob"][0].as_py()), np.uint8)
        lengths = unpack(chunk["lengths"][0].as_py())[0].astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(data)])
        out = {k: np.zeros(len(lengths), np.int64 if k[0] == "n" else float) for k in ("n_tokens", "n_known", "base_score", "score")}
        for s in slices(texts):
            size, here = s.last - s.first, slice(s.first, s.last)
            code, of = coded(s.data, s.offsets, depth)
            at = grams.find(code)
            word, of_word = word_hashes(s.data, s.offsets)
            known = words.find(word)
            if at.min(initial=0) < 0 or known.min(initial=0) < 0:
                raise RuntimeError("a chunk was cut otherwise when it was read again: its input isn't deterministic")
            out["score"][here] = np.bincount(of, log_p[at], minlength=size)
            out["n_tokens"][here] = np.bincount(of_word, minlength=size)
            out["n_known"][here] = np.bincount(of_word, n[known] > 0, minlength=size).astype(np.int64)
            out["base_score"][here] = np.bincount(of_word, base[known], minlength=size)
        ids, flags = chunk["ids"].combine_chunks().flatten(), chunk["flags"].combine_chunks().flatten()
        bits = -out["score"] / np.log10(2) / (lengths + 1)
        columns = {"doc_id": ids, "held_out": flags, "n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": np.full(len(lengths), int(total)), "base_score": out["base_score"], "score": out["score"], "bits_per_byte": bits}
        return pa.table(columns)

    return run


def score(df: DataFrame, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per text: its counts of tokens, unigram base score, log10 probability under the tree and bits per byte.

    ``held_out`` names a boolean column: rows where it is true don't train. Null and empty texts
    are the end byte and the end token alone. Null ids, ties and repeated rows stay, one output row
    each; with no training row every bit has probability 1/2; an empty table gives an empty result.
    Only the three named columns are read. ``df`` must give the same rows in the same order when it
    is read twice, as a scan of files does; otherwise the query fails.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(held_out).cast("boolean"), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    asked = StructType([StructField("chunk", LongType()), StructField("part", IntegerType()), StructField("blob", BinaryType())])
    id_field = rows.schema["doc_id"]
    sent = stored(rows.mapInArrow(narrow(_asked(depth, buckets)), asked), "ctw-counts")
    roots, words, total = [], 0, 0.0
    for r in sent.groupBy("part").applyInArrow(grouped(_summary(depth, buckets)), StructType(asked.fields[1:])).collect():
        got = unpack(r.blob)
        if r.part < buckets:
            roots.append(got)
        else:
            words, total = words + int(got[0][0]), total + float(got[0][1])
    top = Top(*(np.concatenate([r[i] for r in roots] or [np.empty(0, U if not i else float)]) for i in range(4)))
    back = sent.groupBy("part").applyInArrow(grouped(_answers(depth, buckets, top)), asked)
    packed = StructType([asked.fields[0], asked.fields[2], StructField("ids", ArrayType(id_field.dataType)), StructField("flags", ArrayType(BooleanType())), StructField("lengths", BinaryType())])
    texts = rows.mapInArrow(narrow(_packed_texts), packed)
    out = StructType([id_field, StructField("held_out", BooleanType()), *(StructField(k, LongType()) for k in ("n_tokens", "n_known", "train_tokens")), *(StructField(k, DoubleType()) for k in ("base_score", "score", "bits_per_byte"))])
    return back.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(cogrouped(_scored(depth, buckets, total, words)), out)


def op2_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents.select("doc_id", "text", (id_remainder("doc_id", 7) == 2).alias("held_out")))
