"""Vectorised text kernels: an Arrow column of texts as one byte buffer, worked on by numpy.

Every kernel takes a slice of a few MB of whole texts at a time, so memory is bounded by the slice
(or by the longest single text), never by the partition. Span hashes are 64-bit: differences of a
prefix sum of random byte values times powers of an odd base, modulo 2**64, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BYTE_VALUES_2 = mixed(np.arange(1001, 1257, dtype=U) * U(0x9E3779B97F4A7C15))


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers 0 to n of the base and of its inverse modulo 2**64."""
        if len(cls.up) <= n:
            m = max(n, SLICE_BYTES) + 1
            for name, b in (("up", _BASE), ("down", _BASE_INVERSE)):
                p = np.full(m + 1, U(b))
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


class TextSlice(NamedTuple):
    """Texts ``first`` to ``last`` - 1 of a column; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """The column in slices of about ``max_bytes``; null counts as empty, a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_binary(column.type) else column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield TextSlice(at, to, data[lo:hi], offsets[at : to + 1] - lo)
        at = to


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    up, _ = _Powers.of(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((_BYTE_VALUES_2 if second else _BYTE_VALUES)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = _Powers.of(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of data[i:i + k] for every i; lighter than ``span_hash`` with all starts."""
    n = len(prefix) - 1
    if n < k:
        return np.empty(0, U)
    _, down = _Powers.of(n)
    h = prefix[k:] - prefix[:-k]
    h *= down[: n - k + 1]
    h ^= h >> U(32)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every i, in two running minima over blocks."""
    n = len(x)
    if n < width:
        return np.empty(0, x.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each byte position lies in; positions ascend."""
    counts = np.diff(np.searchsorted(positions, offsets))
    return np.repeat(np.arange(len(offsets) - 1), counts)


# --- words

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and tab to carriage return, within texts."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


# --- pre-tokens of byte-level BPE

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def _classes() -> np.ndarray:
    """The class of every code point, from the Unicode properties that the pattern names."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    index = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            table[index[m.start() : m.end()]] = kind
    return table


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pre-tokens begin, as the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` would cut each text:
    runs of one class; a space before a run joins it; white space before a run gives its last
    character away; an apostrophe that stands alone takes its contraction from the letters after it.
    """
    if not len(data):
        return np.empty(0, np.int64)
    if data.max() < 0x80:
        points, at = data, None
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)  # the first code point of a text; n ends the last
    text_starts = offsets if at is None else np.searchsorted(at, offsets)
    first[text_starts] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    run_kind = kind[runs]
    space = ends[(run_kind == SPACE) & ~first[ends]]  # white space with something after it
    start[space - 1] = True
    start[space[points[space - 1] == 0x20]] = False
    mark = runs[(run_kind == OTHER) & (ends - runs == 1) & (points[runs] == 0x27) & ~first[ends] & start[runs]]
    if len(mark):
        one = points[mark + 1]
        two = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
        two = np.where(first[mark + 2], 0, two)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        took = np.where(short, 2, np.where(long, 3, 0))
        mark, took = mark[took > 0], took[took > 0]
        start[mark + 1] = False
        rest = (mark + took)[mark + took < n]
        start[rest] = True
    runs = np.flatnonzero(start)
    return runs if at is None else at[runs]


# --- tables by hash

class HashIndex:
    """64-bit keys to row numbers: open addressing in two numpy arrays; grows as keys are added."""

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.count = 0
        self._make(1 << 12)
        if keys is not None:
            self.add(keys)

    def _make(self, size: int) -> None:
        self.keys = np.zeros(size, U)
        self.rows = np.full(size, -1, np.int32)
        self.shift = U(64 - (size.bit_length() - 1))

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        at = ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        while len(keys):
            free = self.rows[at] < 0
            spot, who = np.unique(at[free], return_index=True)
            who = np.flatnonzero(free)[who]
            self.keys[spot], self.rows[spot] = keys[who], rows[who]
            left = np.ones(len(keys), bool)
            left[who] = False
            keys, rows, at = keys[left], rows[left], at[left]
            stuck = self.rows[at] >= 0
            at = np.where(stuck, (at + 1) & (len(self.keys) - 1), at)

    def add(self, keys: np.ndarray) -> None:
        """Numbers new, distinct keys on from the last."""
        total = self.count + len(keys)
        size = len(self.keys)
        while size < 2 * total:
            size *= 2
        if size > len(self.keys):
            used = self.rows >= 0
            old, rows = self.keys[used], self.rows[used]
            self._make(size)
            self._place(old, rows)
        self._place(keys, np.arange(self.count, total, dtype=np.int32))
        self.count = total

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        at = ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.rows[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            spot = at[wrong]
            found[wrong] = self.rows[spot]
            wrong = wrong[(self.rows[spot] >= 0) & (self.keys[spot] != keys[wrong])]
        return found


def gathered(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, at_once: int = 1 << 19) -> np.ndarray:
    """The concatenation of values[start:start + length] over all pairs, made in parts of about ``at_once`` values."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    lo = 0
    while lo < len(lengths):
        begin = int(ends[lo] - lengths[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + at_once, "right")))
        n, end = lengths[lo:hi], ends[lo:hi]
        out[begin : int(end[-1])] = values[np.repeat(starts[lo:hi] - (end - n), n) + np.arange(begin, int(end[-1]))]
        lo = hi
    return out


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def _heads(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of each string as one number, zeros after its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[start] & _MASKS[np.minimum(lengths, 8)]


class Words:
    """Distinct strings of bytes, numbered as they come. A hash finds a string, its bytes tell it apart."""

    def __init__(self) -> None:
        self.index, self.count, self.size = HashIndex(), 0, 0
        self.starts, self.lengths, self.heads, self.hashes, self.bytes = (np.empty(0, t) for t in (np.int64, np.int64, U, U, np.uint8))
        self.number = np.empty(0, np.int32)  # by row of the index
        self.others: dict[bytes, int] = {}  # strings whose hash another string had before

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        a = getattr(self, name)
        if len(a) < at + len(values):
            a = np.concatenate([a[:at], np.empty(max(len(values), at), a.dtype)])
            setattr(self, name, a)
        a[at : at + len(values)] = values

    def _add(self, data: np.ndarray, start: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        ends = self.size + np.cumsum(lengths)
        for name, values in (("starts", ends - lengths), ("lengths", lengths), ("heads", _heads(data, start, lengths)), ("hashes", hashes)):
            self._put(name, self.count, values)
        self._put("bytes", self.size, gathered(start, lengths, data))
        first = self.count
        self.count += len(start)
        self.size = int(ends[-1])
        return np.arange(first, self.count, dtype=np.int32)

    def _same(self, data: np.ndarray, start: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = (self.lengths[at] == lengths) & (self.heads[at] == _heads(data, start, lengths))
        if len(long := np.flatnonzero(out & (lengths > 8))):
            n = lengths[long] - 8
            ok = gathered(self.starts[at[long]] + 8, n, self.bytes) == gathered(start[long] + 8, n, data)
            out[long] = np.minimum.reduceat(ok, np.cumsum(n) - n)
        return out

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each data[start:end]; new ones are added."""
        if not len(start):
            return np.empty(0, np.int32)
        lengths, h = end - start, span_hash(prefix_hash(data), start, end)
        row = self.index.find(h)
        if (fresh := np.flatnonzero(row < 0)).size:
            new, where = np.unique(h[fresh], return_index=True)
            where = fresh[where]
            self._put("number", self.index.count, self._add(data, start[where], lengths[where], new))
            self.index.add(new)
            row[fresh] = self.index.find(h[fresh])
        out = self.number[row]
        for i in np.flatnonzero(~self._same(data, start, lengths, out)).tolist():
            word = data[start[i] : end[i]].tobytes()
            if word not in self.others:
                one = slice(i, i + 1)
                self.others[word] = int(self._add(data, start[one], lengths[one], h[one])[0])
            out[i] = self.others[word]
        return out
