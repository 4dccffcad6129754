"""Removal of long repeated byte strings by maximal repeats of an enhanced suffix array.

A byte goes when it lies in a string of ``length`` bytes that also starts anywhere else in the corpus.

Suffixes are not sorted corpus-wide. In every window of ``length`` bytes the GRAM-byte string with
the least hash is the window's anchor; equal windows have their anchor at the same place, so a
window only has to be compared with windows of the same anchor. The steps:

1. Each chunk of documents lists its anchors with the range of windows they stand for, as (hash of
   the anchor, hash of the whole range). The hashes go to buckets, packed; the chunk learns which
   ranges occur elsewhere byte for byte, and which anchors stand in differing ranges. A frequent
   anchor is at most two entries a chunk.
2. A range that occurs elsewhere is covered as it is. Of the others, those whose anchor occurs
   elsewhere are sent, with their bytes, to where all differing ranges of the anchor meet: one copy
   of each range.
3. There, the suffixes that begin at the anchor are sorted and their common-prefix interval tree is
   scanned with a stack. In an interval of depth r, the bytes left of the anchor decide: occurrences
   whose left extensions agree on l bytes with l + r >= length are a maximal repeat, and every one of
   them is covered over its l + r bytes.
4. An anchor with more than GROUP differing ranges is not gathered: its windows are hashed one by one
   and counted in buckets, which is the same test without the bytes.
5. Each chunk unites what was found with its own and cuts its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import cogrouped, grouped, narrow, small_batches, stored, table
from .packing import pack, smallest, unpack
from .textkernels import U, gathered, gram_hash, mixed, prefix_hash, slices, sliding_min, span_hash, word_spans

LENGTH = 400
GRAM = 96
GROUP = 20_000
CHUNK_BYTES = 4 << 20
PART_BYTES = 1 << 19
_RANGE, _WHOLE, _WINDOW, _PLACES = 0, 1, 2, 3


class Anchors(NamedTuple):
    """Anchor positions with the span of bytes of the windows that they stand for, in one buffer."""

    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    gram: np.ndarray
    span: np.ndarray


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[Anchors, np.ndarray]:
    """The anchors of all windows inside texts, and the prefix hash they were made from."""
    prefix = prefix_hash(data)
    h = gram_hash(prefix, gram)
    bits = U(max(1, len(data).bit_length()))
    least = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=U), length - gram + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    window = np.flatnonzero(ends - np.arange(len(least)) >= length)
    at = (least[window] & ((U(1) << bits) - U(1))).astype(np.int64)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(fresh)
    start = window[first]
    end = window[np.append(first[1:], len(window))[: len(first)] - 1] + length
    at = at[first]
    return Anchors(at, start, end, h[at], span_hash(prefix, start, end) ^ mixed((at - start).astype(U))), prefix


class _Text(NamedTuple):
    number: int
    data: np.ndarray
    offsets: np.ndarray
    ids: pa.Array


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Text]:
    """Documents in chunks; a chunk's number holds its partition's, so a repeated task gives it again."""
    top, n, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

    def ended() -> _Text:
        lengths = np.concatenate([np.diff(s.offsets) for s, _ in held])
        return _Text(top + n, np.concatenate([s.data for s, _ in held]), np.concatenate([[0], np.cumsum(lengths)]), pa.concat_arrays([i for _, i in held]))

    for batch in batches:
        for s in slices(batch.column(1)):
            held.append((s, batch.column(0)[s.first : s.last]))
            size += len(s.data)
            if size >= CHUNK_BYTES:
                yield ended()
                n, held, size = n + 1, [], 0
    if held:
        yield ended()


def _in_slices(text: _Text) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(where the slice begins, its bytes, its offsets)."""
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text.offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(text.offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(text.data))])
    for s in slices(column, PART_BYTES):
        yield int(text.offsets[s.first]), s.data, s.offsets


def _all_anchors(text: _Text, length: int, gram: int) -> Anchors:
    parts = []
    for begin, data, offsets in _in_slices(text):
        a, _ = anchors(data, offsets, length, gram)
        parts.append(Anchors(a.at + begin, a.start + begin, a.end + begin, a.gram, a.span))
    return Anchors(*(np.concatenate([p[i] for p in parts]) for i in range(5)))


def _dealt(keys: np.ndarray, values: list[np.ndarray], buckets: int, first: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of ascending keys with their values, by a hash of the key."""
    bucket = (mixed(keys) >> U(24)) % U(buckets)
    order = np.lexsort((keys, bucket))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
    for b in np.flatnonzero(np.diff(edges)):
        mine = order[edges[b] : edges[b + 1]]
        yield first + int(b), pack(smallest(np.diff(keys[mine], prepend=U(0))), *(v[mine] for v in values))


def _rows(number: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["chunk", "part", "blob"])


_PACKED = StructType([StructField("chunk", LongType()), StructField("part", IntegerType()), StructField("blob", BinaryType())])


def _ranges(a: Anchors) -> np.ndarray:
    """One key for anchor and range together."""
    return mixed(a.gram) + a.span


def _document(text: _Text, at: np.ndarray) -> np.ndarray:
    """The number within the chunk of the document that each byte position lies in."""
    return np.searchsorted(text.offsets, at, "right") - 1


def _times(keys: np.ndarray, document: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs; if documents are given, in how many of them."""
    if document is None:
        return np.unique(keys, return_counts=True)
    order = np.lexsort((document, keys))
    keys, document = keys[order], document[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
    return np.unique(keys[fresh], return_counts=True)


def _listed(length: int, gram: int, buckets: int, across: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in _chunks(batches):
            a = _all_anchors(text, length, gram)
            keys, n = _times(_ranges(a), _document(text, a.start) if across else None)
            rows = [*_dealt(keys, [np.minimum(n, 2).astype(np.uint8)], buckets, 0)]
            grams, at = np.unique(a.gram, return_inverse=True)
            least, most = np.full(len(grams), np.iinfo(U).max), np.zeros(len(grams), U)
            np.minimum.at(least, at, a.span)
            np.maximum.at(most, at, a.span)
            own = np.unique(np.stack([at.astype(U), a.span]), axis=1)[0] if len(at) else at
            kinds = np.bincount(own.astype(np.int64), minlength=len(grams))
            rows += _dealt(grams, [least, most - least, smallest(kinds)], buckets, buckets)
            if rows:
                yield _rows(text.number, rows)

    return run


def _merged(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, index of each entry's key, ends of the blobs)."""
    each = [np.cumsum(b[0].astype(U)) for b in blobs]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    return keys, at, np.cumsum([len(k) for k in each])


def _judged(buckets: int, group: int):
    """For ranges: 1 if it occurs elsewhere, and 2 more in the one chunk that stands for it. For anchors: 1 if ranges differ, 2 if they are too many to gather."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = [unpack(b) for b in rows["blob"].to_pylist()]
        keys, at, ends = _merged(blobs)
        if rows["part"][0].as_py() < buckets:
            n = np.bincount(at, np.concatenate([b[1] for b in blobs]), minlength=len(keys))
            stands = np.zeros(len(at), bool)
            stands[np.unique(at, return_index=True)[1]] = True
            verdict = ((n > 1)[at] + 2 * stands).astype(np.uint8)
        else:
            least, most = np.full(len(keys), np.iinfo(U).max), np.zeros(len(keys), U)
            np.minimum.at(least, at, np.concatenate([b[1] for b in blobs]))
            np.maximum.at(most, at, np.concatenate([b[1] + b[2] for b in blobs]))
            kinds = np.bincount(at, np.concatenate([b[3] for b in blobs]).astype(float), minlength=len(keys))
            verdict = np.where(least == most, 0, np.where(kinds > group, 2, 1)).astype(np.uint8)[at]
        out = [pack(b[0], verdict[e - len(b[0]) : e]) for b, e in zip(blobs, ends.tolist(), strict=True)]
        return pa.table({"chunk": rows["chunk"], "part": rows["part"], "blob": pa.array(out, pa.binary())})

    return run


def _looked_up(answers: list[list[np.ndarray]], keys: np.ndarray) -> np.ndarray:
    known = np.concatenate([np.cumsum(b[0].astype(U)) for b in answers] or [np.empty(0, U)])
    value = np.concatenate([b[1] for b in answers] or [np.empty(0, np.uint8)])
    order = np.argsort(known)
    at = np.searchsorted(known[order], keys)
    if len(keys) and (not len(known) or at.max() >= len(known) or (known[order][at] != keys).any()):
        raise RuntimeError("a chunk was cut otherwise when it was read again: its input isn't deterministic")
    return value[order][at] if len(keys) else np.empty(0, np.uint8)


def _unpacked_text(chunk: pa.Table) -> _Text:
    if len(chunk) != 1:
        raise RuntimeError("a chunk was cut otherwise when it was read again: its input isn't deterministic")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(chunk["blob"][0].as_py()), np.uint8)
    lengths = unpack(chunk["lengths"][0].as_py())[0].astype(np.int64)
    return _Text(chunk["chunk"][0].as_py(), data, np.concatenate([[0], np.cumsum(lengths)]), chunk["ids"].combine_chunks().flatten())


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for text in _chunks(batches):
        ids = pa.ListArray.from_arrays(pa.array([0, len(text.ids)], pa.int32()), text.ids)
        yield pa.RecordBatch.from_arrays([pa.array([text.number], pa.int64()), pa.array([squeeze.compress(text.data.tobytes())], pa.binary()), ids, pa.array([pack(smallest(np.diff(text.offsets)))], pa.binary())], names=["chunk", "blob", "ids", "lengths"])


# what step 2 sends on: ranges to compare (_RANGE), bytes found covered (_WHOLE), windows to count (_WINDOW) and where they stand (_PLACES)
_FOUND = StructType([StructField("kind", IntegerType()), StructField("chunk", LongType()), StructField("part", IntegerType()), StructField("gram", LongType()), StructField("start", ArrayType(IntegerType())), StructField("lead", IntegerType()), StructField("needs", BooleanType()), StructField("owner", LongType()), StructField("blob", BinaryType())])


def _found(kind: int, chunk: int, n: int, **columns: list | pa.Array) -> pa.Table:
    given = {"kind": pa.array([kind] * n, pa.int32()), "chunk": pa.array([chunk] * n, pa.int64())} | columns
    kinds = {"part": pa.int32(), "gram": pa.int64(), "start": pa.list_(pa.int32()), "lead": pa.int32(), "needs": pa.bool_(), "owner": pa.int64(), "blob": pa.binary()}
    return pa.table({f.name: given.get(f.name, pa.nulls(n, kinds.get(f.name, pa.null()))) for f in _FOUND.fields})


def united(start: np.ndarray, end: np.ndarray, touching: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same bytes as disjoint, ascending spans; spans that overlap become one, and those that touch if asked."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1] if touching else start[1:] >= reach[:-1]
    first = np.flatnonzero(fresh)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _compared(length: int, gram: int, buckets: int, across: bool):
    def run(answers: pa.Table, chunk: pa.Table) -> pa.Table:
        text = _unpacked_text(chunk)
        a = _all_anchors(text, length, gram)
        parts, blobs = answers["part"].to_pylist(), [unpack(b) for b in answers["blob"].to_pylist()]
        of_range = _looked_up([b for p, b in zip(parts, blobs, strict=True) if p < buckets], _ranges(a))
        of_gram = _looked_up([b for p, b in zip(parts, blobs, strict=True) if p >= buckets], a.gram)
        whole = (of_range & 1) == 1
        out = [_found(_WHOLE, text.number, 1, blob=pa.array([pack(*map(smallest, united(a.start[whole], a.end[whole], touching=False)))], pa.binary()))]
        # one copy of every range that differs from others of its anchor, with all places where it stands here
        of = _ranges(a)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.append(np.append(True, of[order][1:] != of[order][:-1]), True)) if len(of) else np.zeros(1, np.int64)
        first = order[edges[:-1]]
        wanted = (of_gram[first] == 1) & (of_range[first] & 2 == 2)
        send = first[wanted]
        raw = text.data.tobytes()
        if len(send):
            # what occurs elsewhere as a whole needs no other place here
            n = np.where(whole[send], 1, np.diff(edges)[wanted])
            places = a.start[gathered(edges[:-1][wanted], n, order)]
            # a range of one document only belongs to it, any other to nobody
            owner = np.where(whole[send] | (not across), -1, (text.number << 31) + _document(text, a.start[send]))
            out.append(
                _found(
                    _RANGE,
                    text.number,
                    len(send),
                    gram=pa.array(a.gram[send].view(np.int64)),
                    start=pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(places, pa.int32())),
                    lead=pa.array(a.at[send] - a.start[send], pa.int32()),
                    needs=pa.array(~whole[send]),
                    owner=pa.array(owner, pa.int64()),
                    blob=pa.array([raw[s:e] for s, e in zip(a.start[send].tolist(), a.end[send].tolist(), strict=True)], pa.binary()),
                )
            )
        hot = np.flatnonzero(of_gram == 2)
        if len(hot):
            starts = _window_starts(a, hot, length)
            out.append(_found(_PLACES, text.number, 1, blob=pa.array([pack(*map(smallest, united(starts, starts + 1)))], pa.binary())))
            prefix = prefix_hash(text.data)
            keys, n = _times(span_hash(prefix, starts, starts + length), _document(text, starts) if across else None)
            rows = [*_dealt(keys, [np.minimum(n, 2).astype(np.uint8)], buckets, 0)]
            out.append(_found(_WINDOW, text.number, len(rows), part=pa.array([p for p, _ in rows], pa.int32()), blob=pa.array([b for _, b in rows], pa.binary())))
        return pa.concat_tables(out)

    return run


def _window_starts(a: Anchors, which: np.ndarray, length: int) -> np.ndarray:
    """The starts of all windows that the anchors stand for."""
    n = a.end[which] - length - a.start[which] + 1
    return np.unique(np.repeat(a.start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))


def _counted(rows: pa.Table) -> pa.Table:
    """For windows: 1 if it occurs elsewhere."""
    blobs = [unpack(b) for b in rows["blob"].to_pylist()]
    keys, at, ends = _merged(blobs)
    n = np.bincount(at, np.concatenate([b[1] for b in blobs]), minlength=len(keys))
    verdict = (n > 1).astype(np.uint8)[at]
    out = [pack(b[0], verdict[e - len(b[0]) : e]) for b, e in zip(blobs, ends.tolist(), strict=True)]
    return pa.table({"chunk": rows["chunk"], "part": rows["part"], "blob": pa.array(out, pa.binary())})


# --- the suffix array of one anchor

def _sorted(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings in a zero-padded byte matrix, and the common prefix of each with the next.

    Strings that differ in trailing zeros only are told apart by size, as an end mark would do.
    """
    by_size = np.argsort(sizes, kind="stable")
    packed = np.ascontiguousarray(rows[by_size]).view(f"S{rows.shape[1]}").ravel()
    order = by_size[np.argsort(packed, kind="stable")]
    return order, _shared(rows, sizes, order)


def _shared(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(max(0, len(order) - 1), np.int64)
    for lo in range(0, len(out), 4096):
        a, b = order[lo : lo + 4096][: len(out) - lo], order[lo + 1 : lo + 4097]
        differ = rows[a] != rows[b]
        common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[lo : lo + len(a)] = np.minimum(common, np.minimum(sizes[a], sizes[b]))
    return out


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval of a suffix array, children before parents, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i in range(len(lcp) + 1):
        d, first = (int(lcp[i]) if i < len(lcp) else -1), i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            yield depth, first, i
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, first))


def _nearest(near: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each of the sorted strings the most that it shares with one of another owner, from what neighbours share; far below 0 if there is none."""
    out = np.full(len(owner), -(1 << 40))
    if (owner < 0).all() or (owner[1:] != owner[:-1]).all():
        out[:-1] = near
        out[1:] = np.maximum(out[1:], near)
        return out
    for step in (1, -1):
        who, shared = owner[::step], near[::step]
        edge = np.ones(len(who), bool)
        edge[1:] = (who[1:] != who[:-1]) | (who[1:] < 0)
        first = np.flatnonzero(edge)
        mine = np.full(len(who), -(1 << 40))
        for lo, hi in zip(first.tolist(), np.append(first[1:], len(who)).tolist(), strict=True):
            if lo:
                mine[lo:hi] = np.minimum.accumulate(shared[lo - 1 : hi - 1])
        out = np.maximum(out, mine[::step])
    return out


def maximal_repeats(left: np.ndarray, right: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray, length: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of an anchor, the bytes left and right of it that repeats of ``length`` or more cover.

    ``right`` holds the suffixes from the anchor on, ``left`` the bytes before it read backwards.
    Suffixes in an interval of depth r share r bytes. Their left extensions, sorted, show how
    diverse they are: neighbours that agree on l bytes, l + r >= length, are occurrences of one
    repeat, and runs of such neighbours are its group, which no byte to the left extends as a whole.
    Repeats of one occurrence all hold the anchor, so their union is one span. With ``owner``,
    occurrences of one owner (0 or more) are no repeat of each other.
    """
    owner = np.full(len(right), -1) if owner is None else owner
    covered_left, covered_right = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
    order, lcp = _sorted(right, right_sizes)
    rank = np.empty(len(left), np.int64)
    by_left, _ = _sorted(left, left_sizes)
    rank[by_left] = np.arange(len(left))
    widest = int(left_sizes.max(initial=0))
    for depth, first, last in intervals(lcp):
        if depth + widest < length:
            continue
        mine = order[first : last + 1]
        mine = mine[np.argsort(rank[mine])]
        near = _shared(left, left_sizes, mine)
        agree = _nearest(near, owner[mine])
        hit = agree + depth >= length
        at = mine[hit]
        covered_left[at] = np.maximum(covered_left[at], agree[hit])
        covered_right[at] = np.maximum(covered_right[at], depth)
    return covered_left, covered_right


def _matrix(blobs: list[bytes], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in blobs])
    out = np.zeros((len(blobs), max(1, int(sizes.max()))), np.uint8)
    for i, b in enumerate(blobs):
        row = np.frombuffer(b, np.uint8)
        out[i, : len(b)] = row[::-1] if backwards else row
    return out, sizes


def _repeats(length: int):
    def compared(rows: pa.Table) -> pa.Table | None:
        needs = np.array(rows["needs"].to_pylist())
        if len(rows) < 2 or not needs.any():
            return None
        blobs, lead = rows["blob"].to_pylist(), rows["lead"].to_pylist()
        left, left_sizes = _matrix([b[:n] for b, n in zip(blobs, lead, strict=True)], True)
        right, right_sizes = _matrix([b[n:] for b, n in zip(blobs, lead, strict=True)], False)
        before, after = maximal_repeats(left, right, left_sizes, right_sizes, length, rows["owner"].to_numpy())
        hit = np.flatnonzero(needs & (after > 0))
        start = rows["start"].combine_chunks().take(pa.array(hit))
        each = np.repeat(hit, start.value_lengths().to_numpy())
        anchor = start.flatten().to_numpy() + np.array(lead, np.int64)[each]
        return pa.table({"chunk": rows["chunk"].combine_chunks().take(pa.array(each)), "kind": pa.array(np.full(len(each), _RANGE, np.int32)), "start": pa.array(anchor - before[each], pa.int32()), "end": pa.array(anchor + after[each], pa.int32()), "blob": pa.nulls(len(each), pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor; a group may go over batches."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            gram = rows["gram"].to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
            for lo, hi in zip(edges[:-2].tolist(), edges[1:-1].tolist(), strict=True):
                if (out := compared(rows.slice(lo, hi - lo))) is not None:
                    yield from out.to_batches()
            rest = rows.slice(int(edges[-2]))
        if rest is not None and (out := compared(rest)) is not None:
            yield from out.to_batches()

    return run


# --- the texts that are left

def _wordy(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, words: int, distinct: int) -> np.ndarray:
    """Whether each span holds so many whole words, and so many different ones."""
    word, last = word_spans(data, offsets)
    lo, hi = np.searchsorted(word, start), np.searchsorted(last, end, "right")
    out = hi - lo >= words
    for i in np.flatnonzero(out).tolist():
        found: set[bytes] = set()
        for j in range(lo[i], hi[i]):
            if len(found) >= distinct:
                break
            found.add(data[word[j] : last[j]].tobytes())
        out[i] = len(found) >= distinct
    return out


def _cut(length: int, whole_characters: bool, words: int, distinct: int):
    def run(found: pa.Table, chunk: pa.Table) -> pa.Table:
        text = _unpacked_text(chunk)
        kind = np.array(found["kind"].to_pylist(), np.int64)
        blobs = found["blob"].to_pylist()
        spans = [(found["start"].to_numpy()[kind == _RANGE], found["end"].to_numpy()[kind == _RANGE])]
        spans += [unpack(blobs[i])[:2] for i in np.flatnonzero(kind == _WHOLE)]
        for i in np.flatnonzero(kind == _PLACES):
            lo, hi = (x.astype(np.int64) for x in unpack(blobs[i]))
            starts = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
            elsewhere = _looked_up([unpack(blobs[j]) for j in np.flatnonzero(kind == _WINDOW)], span_hash(prefix_hash(text.data), starts, starts + length)) == 1
            spans.append((starts[elsewhere], starts[elsewhere] + length))
        start, end = (np.concatenate([s[i] for s in spans]).astype(np.int64) for i in (0, 1))
        n = len(text.offsets) - 1
        # a gap of one between texts, so that spans of neighbours don't join
        of = np.searchsorted(text.offsets, start, "right") - 1
        start, end = united(start + of, end + of)
        of = np.searchsorted(text.offsets + np.arange(n + 1), start, "right") - 1
        start, end = start - of, end - of
        if words or distinct:
            long = _wordy(text.data, text.offsets, start, end, words, distinct)
            start, end, of = start[long], end[long], of[long]
        gone = np.zeros(len(text.data), bool)
        for lo, hi in zip(start.tolist(), end.tolist(), strict=True):
            gone[lo:hi] = True
        lengths = np.diff(text.offsets)
        removed = np.bincount(of, end - start, minlength=n).astype(np.int64)
        columns = {"doc_id": text.ids, "n_bytes": pa.array(lengths), "n_removed": pa.array(removed), "n_spans": pa.array(np.bincount(of, minlength=n))}
        if whole_characters and len(text.data):
            first = np.flatnonzero((text.data & 0xC0) != 0x80).astype(np.int32)
            partly = np.logical_or.reduceat(gone, first)
            gone = np.repeat(partly, np.diff(np.append(first, len(gone))))
        kept = ~gone
        bounds = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])[text.offsets]
        kind_ = pa.large_string() if whole_characters else pa.large_binary()
        left = pa.Array.from_buffers(kind_, n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text.data[kept])])
        return pa.table(columns | {"kept": left.cast(pa.string() if whole_characters else pa.binary())})

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, whole_characters: bool = False, across: bool = False, min_words: int = 0, min_distinct_words: int = 0) -> DataFrame:
    """One row per text: doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that are left.

    Strings are judged on the input; overlaps, repeats in one text and equal texts count. Null and
    empty texts have 0 bytes. Null ids, ties and repeated rows stay, one output row each; an empty
    table gives an empty result. Extra columns aren't read. With ``whole_characters`` a character
    that lost a byte goes as a whole and ``kept`` is a string. With ``across`` only strings that also
    occur in another document count, not those that repeat within one. A run of bytes to remove stays
    if it holds fewer than ``min_words`` whole words or fewer than ``min_distinct_words`` different ones. ``df`` is read more than once and
    must give the same rows in the same order, as a scan of files does; otherwise the query fails.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be 1 to length")
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    to_arrow_type(id_type)  # an id that Arrow can't carry fails here, not on an executor
    packed = StructType([StructField("chunk", LongType()), StructField("blob", BinaryType()), StructField("ids", ArrayType(id_type)), StructField("lengths", BinaryType())])
    texts = rows.mapInArrow(narrow(_packed_texts), packed).groupBy("chunk")
    answers = rows.mapInArrow(narrow(_listed(length, gram, buckets, across)), _PACKED).groupBy("part").applyInArrow(grouped(_judged(buckets, group)), _PACKED)
    found = stored(answers.groupBy("chunk").cogroup(texts).applyInArrow(cogrouped(_compared(length, gram, buckets, across)), _FOUND), "repeats")

    covered = StructType([StructField("chunk", LongType()), StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("blob", BinaryType())])
    ranges = found.where(F.col("kind") == _RANGE).select("gram", "chunk", "start", "lead", "needs", "owner", "blob")
    ranges = ranges.repartition("gram").sortWithinPartitions("gram").mapInArrow(narrow(_repeats(length)), covered)
    counts = found.where(F.col("kind") == _WINDOW).select("chunk", "part", "blob").groupBy("part").applyInArrow(grouped(_counted), _PACKED)
    known = found.where(F.col("kind").isin(_WHOLE, _PLACES))
    nothing = F.lit(None).cast("int")
    every = ranges.unionByName(counts.select("chunk", F.lit(_WINDOW).alias("kind"), nothing.alias("start"), nothing.alias("end"), "blob"))
    every = every.unionByName(known.select("chunk", "kind", nothing.alias("start"), nothing.alias("end"), "blob"))
    out = StructType([StructField("doc_id", id_type), *(StructField(k, LongType()) for k in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if whole_characters else BinaryType())])
    return every.groupBy("chunk").cogroup(texts).applyInArrow(cogrouped(_cut(length, whole_characters, min_words, min_distinct_words)), out)


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
