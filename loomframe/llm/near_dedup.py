"""Near-duplicate classes by order min-hashing and banded alignment.

A sketch takes the KEPT occurrence-labelled five-word k-mers of a text with the least hash values
and keeps them in text order, so texts agree on it when they share those k-mers and their order.
Texts that share a sketch are candidates; a candidate is verified by the edit distance of the word
sequences, computed in a diagonal band that widens until it holds the answer: similar means
``1 - distance / longer length >= 0.8``.

Equal texts are one text from the start. First every text of a bucket is held against the bucket's least
key, which joins most of what is similar by a few links a text. Then nothing is left open: in every bucket
whose texts are not yet of one component, all pairs of texts of different components are decided. The texts of
a bucket meet in one worker (of a large bucket: two blocks of them at a time, of lengths that can be similar),
which drops pairs by length and by counts of hashed words before it aligns any; so rows grow with the
members of buckets, not with their pairs. Classes are the connected components of all similar pairs that share a
sketch, found by alternating star contractions.

Texts are known by a 64-bit hash; texts whose hashes collide get others by their MD5 first, so that equal
keys mean equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, grouped, narrow, small_batches, stored, table
from .textkernels import LOWER, U, mixed, owner, prefix_hash, slices, span_hash

WORDS = 5
SKETCHES = 48
KEPT = 2
SIMILARITY = 0.8
HASHED = 128
BLOCK = 1 << 18
EACH = 100
RATIO = 1.26
COLLISIONS = 100_000
SEEN = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased run of letters, digits and non-ASCII bytes, and the text it is of."""
    if not len(data):
        return np.empty(0, U), np.empty(0, np.int64)
    solid = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hash(prefix_hash(LOWER[data]), start, end), owner(offsets, start)


def labelled_kmers(words: np.ndarray, counts: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of texts of so many words, told apart by occurrence, and the number for each text.

    A text of fewer than ``k`` words is one k-mer.
    """
    ends = np.cumsum(counts)
    number = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    of = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(ends - counts, number)
    last = np.repeat(ends, number) - 1
    s = np.zeros(len(of), U)
    for j in range(k):
        inside = at + j <= last
        s = (s + np.where(inside, words[np.minimum(at + j, len(words) - 1)], U(0))) * U(0x9E3779B97F4A7C15) if len(words) else s
        s ^= s >> U(29)
    within = s ^ mixed(of.astype(U))
    order = np.argsort(within, kind="stable")
    same = within[order]
    first = np.ones(len(same), bool)
    first[1:] = same[1:] != same[:-1]
    run = np.flatnonzero(first)
    nth = np.arange(len(same)) - np.repeat(run, np.diff(np.append(run, len(same))))
    label = np.empty(len(same), U)
    label[order] = nth.astype(U)
    return mixed(s + label * U(0xD1342543DE82EF95)), number


def sketches(x: np.ndarray, number: np.ndarray, count: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """``count`` order min-hashes for each text that has a k-mer: an array of texts x sketches."""
    some = number[number > 0]
    starts = np.cumsum(some) - some
    out = np.empty((len(some), count), U)
    if not len(some):
        return out
    top = np.iinfo(U).max
    for i in range(count):
        seed = mixed(np.array([i + 1], U))[0]
        v = (x ^ seed) * U(0x9E3779B97F4A7C15)
        v ^= v >> U(32)
        v *= U(0xD6E8FEB86659FD93)
        at = np.full((len(some), kept), len(x), np.int64)
        for j in range(kept):
            least = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == np.repeat(least, some))
            v[hit] = top
            text = np.searchsorted(starts, hit, "right") - 1
            left = some[text] > j
            at[text[left], j] = hit[left]
        at.sort(axis=1)  # text order
        sig = np.full(len(some), seed)
        for j in range(kept):
            sig = mixed(sig + np.where(at[:, j] < len(x), x[np.minimum(at[:, j], len(x) - 1)], U(0)))
        out[:, i] = sig
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        if len(seen) > SEEN:  # only saves work: copies are dropped later in any case
            seen.clear()
        keys = batch.column(0).to_pylist()
        fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        batch = batch.take(pa.array(fresh, pa.int64()))
        key = batch.column(0).to_numpy()
        for s in slices(batch.column(1)):
            words, of = tokens(s.data, s.offsets)
            n = np.bincount(of, minlength=s.last - s.first)
            x, number = labelled_kmers(words, n)
            sig = sketches(x, number)
            mine = np.repeat(key[s.first : s.last][number > 0], sig.shape[1])
            at = np.tile(np.arange(sig.shape[1], dtype=np.int8), len(sig))
            n = np.repeat(n[number > 0].astype(np.int32), sig.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(at), pa.array(sig.ravel().view(np.int64)), pa.array(n)], names=["key", "at", "sig", "n"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, compressed text), each text once a task."""
    seen: set[int] = set()
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        if len(seen) > SEEN:
            seen.clear()
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in fresh], pa.int64()), pa.array([squeeze.compress(texts[i].as_py().encode()) for i in fresh], pa.binary())], names=["key", "packed"])


# --- alignment

def banded_distances(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distance of each pair, exact where it is at most ``band``; lengths differ by at most ``band``."""
    out = np.full(len(a), np.iinfo(np.int32).max, np.int64)
    order = np.argsort([-len(x) for x in a], kind="stable")
    width = 2 * band + 1
    per = max(1, (1 << 18) // width)
    for lo in range(0, len(order), per):
        mine = order[lo : lo + per]
        n = np.array([len(a[i]) for i in mine])
        m = np.array([len(b[i]) for i in mine])
        rows = int(n[0])
        left = np.zeros((len(mine), max(rows, 1)), U)
        right = np.zeros((len(mine), rows + width + 1), U)
        for r, i in enumerate(mine):
            left[r, : len(a[i])] = a[i] | U(1)
            right[r, band : band + min(len(b[i]), rows + band + 1)] = b[i][: rows + band + 1] | U(1)
        steps = np.arange(width, dtype=np.int32)
        d = np.where(steps >= band, steps - band, 1 << 28).astype(np.int32)
        d = np.repeat(d[None, :], len(mine), 0)
        live, goal = len(mine), m - n + band
        done = n == 0
        out[mine[done]] = d[done, goal[done]]
        for i in range(1, rows + 1):
            while live and n[live - 1] < i:
                live -= 1
            d = d[:live]
            new = d + (right[:live, i - 1 : i - 1 + width] != left[:live, i - 1 : i])
            np.minimum(new[:, :-1], d[:, 1:] + 1, out=new[:, :-1])
            new -= steps
            np.minimum.accumulate(new, axis=1, out=new)
            new += steps
            d = new
            ended = np.flatnonzero(n[:live] == i)
            out[mine[ended]] = d[ended, goal[ended]]
    return out


def _most(longer: np.ndarray) -> np.ndarray:
    """The edits that similar texts of this length may have."""
    return ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Whether ``1 - distance / longer >= least`` for each pair of word sequences."""
    out = np.zeros(len(a), bool)
    todo, x, y, limit = [], [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        longer = max(len(p), len(q))
        most = int((1 - least) * longer + 1e-9)
        if abs(len(p) - len(q)) > most:
            continue
        # words that have no partner need an edit each
        both, n = np.unique(np.concatenate([p, q]), return_inverse=True)
        common = np.minimum(np.bincount(n[: len(p)], minlength=len(both)), np.bincount(n[len(p) :], minlength=len(both))).sum()
        if longer - common > most:
            continue
        short = min(len(p), len(q))
        differ = np.flatnonzero(p[:short] != q[:short])
        lead = int(differ[0]) if len(differ) else short
        p, q = p[lead:], q[lead:]
        short = min(len(p), len(q))
        differ = np.flatnonzero(p[len(p) - short :][::-1] != q[len(q) - short :][::-1])
        tail = int(differ[0]) if len(differ) else short
        p, q = p[: len(p) - tail], q[: len(q) - tail]
        if max(len(p), len(q)) <= most:
            out[i] = True
            continue
        todo.append(i)
        x.append(p)
        y.append(q)
        limit.append(most)
    band = 8
    while todo:
        fits = [j for j in range(len(todo)) if abs(len(x[j]) - len(y[j])) <= band]
        d = np.full(len(todo), np.iinfo(np.int32).max, np.int64)
        d[fits] = banded_distances([x[j] for j in fits], [y[j] for j in fits], band)
        rest = []
        for j, i in enumerate(todo):
            if d[j] <= band:
                out[i] = d[j] <= limit[j]
            elif limit[j] > band:
                rest.append(j)
        todo, x, y, limit = ([v[j] for j in rest] for v in (todo, x, y, limit))
        band *= 4
    return out


def _words(packed: list[bytes]) -> list[np.ndarray]:
    """The word hashes of compressed texts."""
    opened, out = zstandard.ZstdDecompressor(), []
    for s in slices(pa.array([opened.decompress(x) for x in packed], pa.large_binary())):
        h, of = tokens(s.data, s.offsets)
        out += np.split(h, np.cumsum(np.bincount(of, minlength=s.last - s.first))[:-1])
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, packed text of a, packed text of b), the (a, b) that are similar."""
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            words = [_words(batch.column(c).to_pylist()) for c in (2, 3)]
            ok = pa.array(similar(*words))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _settled(rows: pa.Table) -> pa.Table:
    """Of bucket members (sig, i, j, block, at, key, root, sigs, packed): the (a, b) of roots with similar texts.

    All texts of block i are held against all of block j of a bucket, a pair under one of its common sketches
    only, drawn by its keys so that no bucket gets them all, and only while its roots are not linked yet.
    """
    rows = rows.combine_chunks()
    sig, i, j, block, at, key, root = (rows[c].to_numpy() for c in ("sig", "i", "j", "block", "at", "key", "root"))
    drawn, first, text = np.unique(key.view(U), return_index=True, return_inverse=True)
    sigs = np.array(rows["sigs"].take(pa.array(first)).to_pylist(), np.int64)
    words = _words(rows["packed"].take(pa.array(first)).to_pylist())
    size = np.array([len(w) for w in words])
    of = np.repeat(np.arange(len(words)), size) * HASHED + ((np.concatenate(words) >> U(17)) % U(HASHED)).astype(np.int64)
    hashed = np.bincount(of, minlength=len(words) * HASHED).astype(np.int32).reshape(-1, HASHED)
    names, group = np.unique(root, return_inverse=True)
    up, found = np.arange(len(names)), []
    order = np.lexsort((j, i, sig))
    new = np.flatnonzero((np.diff(sig[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    for mine in np.split(order, new):
        one, two = mine[block[mine] == i[mine]], mine[block[mine] == j[mine]]
        inside = i[mine[0]] == j[mine[0]]
        step = max(1, (1 << 20) // max(1, len(two)))
        for lo in range(0, len(one), step):
            x = one[lo : lo + step]
            apart = up[group[x]][:, None] != up[group[two]][None, :]
            p, q = size[text[x]][:, None], size[text[two]][None, :]
            apart &= np.abs(p - q) <= _most(np.maximum(p, q))
            if inside:
                apart &= np.arange(lo, lo + len(x))[:, None] < np.arange(len(two))[None, :]
            x, y = (v[k] for v, k in zip((x, two), np.nonzero(apart), strict=True))
            left = []
            for k in range(0, len(x), 4096):
                p, q = text[x[k : k + 4096]], text[y[k : k + 4096]]
                longer = np.maximum(size[p], size[q])
                # no fewer than the words that both have
                common = np.minimum(hashed[p], hashed[q]).sum(axis=1)
                ok = np.flatnonzero(longer - common <= _most(longer))
                p, q = p[ok], q[ok]
                turn = (mixed(drawn[p] ^ drawn[q]) % U(sigs.shape[1])).astype(np.int64)[:, None]
                further = np.where(sigs[p] == sigs[q], (np.arange(sigs.shape[1]) - turn) % sigs.shape[1], sigs.shape[1])
                left.append(k + ok[further.argmin(axis=1) == at[x[k + ok]]])
            left = np.concatenate(left) if left else np.empty(0, np.int64)
            while len(left):
                left = left[up[group[x[left]]] != up[group[y[left]]]]
                now, left = left[:64], left[64:]
                same = similar([words[t] for t in text[x[now]]], [words[t] for t in text[y[now]]])
                for a, b in zip(group[x[now[same]]].tolist(), group[y[now[same]]].tolist(), strict=True):
                    if up[a] != up[b]:
                        found.append((names[a], names[b]))
                        up[up == up[a]] = up[b]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


# --- components

def components(edges: DataFrame) -> DataFrame:
    """(key, root) for every key on an edge (a, b); the root is the least key that it is connected with.

    Alternating large and small stars: each round is two aggregations and two joins, written to the
    shared work folder; only the sum of a round's hashes reaches the driver.
    """
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r.n, r.x

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    mark = state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that both sides of the join are plain shuffles and Spark can split the edges of a hub
        nearest = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.where("a <> b"), "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        small = stored(small.where("a <> b").distinct(), "star")
        before, mark = mark, state(small)
        forget(now.sparkSession, now, large, nearest)
        now = small
        if mark == before:
            break
    return now.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())


# --- the operator

def text_key(text: Column) -> Column:
    """A 64-bit key of a text; null for null and for texts without a letter, digit or symbol."""
    text = text.cast("string")
    return F.when(F.length(F.trim(text)) > 0, F.xxhash64(text))


def _keyed(rows: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """``rows`` with the ``text_key`` of a column, made anew from MD5 where different texts have one key."""
    rows = rows.withColumn(key_col, text_key(F.col(text_col)))
    second = F.md5(F.col(text_col).cast("binary"))
    each = rows.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("_collides")).agg(F.min(second).alias("lo"), F.max(second).alias("hi"))
    bad = stored(each.where("lo <> hi").select("_collides"), "collisions")
    n = bad.count()
    if not n:
        return rows
    rows = rows.join(F.broadcast(bad) if n <= COLLISIONS else bad, F.col(key_col) == F.col("_collides"), "left")
    return rows.withColumn(key_col, F.when(F.col("_collides").isNull(), F.col(key_col)).otherwise(F.xxhash64(key_col, second))).drop("_collides")


def _candidates(members: DataFrame) -> DataFrame:
    """(bucket, key, least key of the bucket and its words, other columns) for all keys but the least."""
    least = members.groupBy("sig").agg(F.min(F.struct("key", "n")).alias("l"), F.max("key").alias("most")).where("l.key <> most")
    least = least.select("sig", F.col("l.key").alias("least"), F.col("l.n").alias("least_n"))
    return members.join(least, "sig").where("key <> least")


def roots(texts: DataFrame) -> DataFrame:
    """(key, root) of keys of texts that are similar to another, for a table (key, text) with any number of copies."""
    small_batches(texts.sparkSession)
    members = stored(texts.mapInArrow(narrow(_sketched), "key long, at tinyint, sig long, n int"), "sketches")
    first = stored(_candidates(members), "candidates")
    pairs = stored(first.select(F.col("key").alias("a"), F.col("least").alias("b")).distinct(), "pairs")
    # only texts that are in a pair go on, one copy each
    asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    packed = texts.mapInArrow(narrow(_squeezed), "key long, packed binary").join(asked.hint("merge"), "key", "left_semi")
    packed = stored(packed.groupBy("key").agg(F.first("packed").alias("packed")), "texts")
    one = packed.select(F.col("key").alias("a"), F.col("packed").alias("packed_a"))
    two = packed.select(F.col("key").alias("b"), F.col("packed").alias("packed_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "packed_a", "packed_b")
    found = stored(components(stored(both.mapInArrow(narrow(_verified), "a long, b long"), "links")), "roots")
    # links between components join these; a key that had none is its own
    rest = components(_rest(members, first, packed, found))
    known = found.join(rest.select(F.col("key").alias("root"), F.col("root").alias("_root")), "root", "left")
    return known.select("key", F.coalesce("_root", "root").alias("root")).unionByName(rest.join(found, "key", "left_anti").select("key", "root"))


def _rest(members: DataFrame, first: DataFrame, packed: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between the components ``found``, such that all similar texts that share a bucket are of one."""
    inside = first.select("sig", "at", "key", "n").unionByName(first.select("sig", "at", F.col("least").alias("key"), F.col("least_n").alias("n"))).distinct()
    inside = inside.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    inside = stored(inside.select("sig", "at", "key", "root", "n", (F.col("n") + EACH).cast("long").alias("weight")), "buckets")
    # all that is asked of a bucket goes to its members by one join
    split = inside.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    split = split.groupBy("sig").agg(F.count(F.lit(1)).alias("roots"), F.sum("weight").alias("total"), F.max_by("root", F.struct("n", "root")).alias("usual"))
    split = split.where("roots > 1").select("sig", "total", "usual")
    left = stored(inside.join(split.hint("merge"), "sig"), "open")
    asked = left.select("key").distinct()
    sigs = members.join(asked.hint("merge"), "key", "left_semi").groupBy("key").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "sig"))), lambda x: x["sig"]).alias("sigs"))
    small = F.col("total") <= 2 * BLOCK
    weight = left.where(small).agg(F.sum("weight")).first()[0]
    here, number = F.lit(0).cast("long"), max(1, -(-(weight or 0) // BLOCK))
    whole = left.where(small).select("sig", "at", "key", "root", F.pmod(F.xxhash64("sig"), F.lit(number)).alias("group"), here.alias("block"), here.alias("i"), here.alias("j"))
    each = whole.unionByName(_blocks(left.where(~small)))
    each = each.join(stored(sigs.join(packed, "key"), "open-texts"), "key")
    return stored(each.groupBy("group").applyInArrow(grouped(_settled), "a long, b long"), "rest")


def _blocks(large: DataFrame) -> DataFrame:
    """The members of large buckets, once for each pair (i, j) of blocks that they are in.

    Blocks hold texts of like length, and those of a bucket's largest component are apart: texts of lengths that
    differ by more than RATIO twice can't be similar, and a component isn't held against itself.
    """
    slot = F.floor(F.log("n") / F.log(F.lit(RATIO))).cast("long") * 2 + (F.col("root") == F.col("usual")).cast("long")
    large = large.withColumn("slot", slot)
    blocks = large.groupBy("sig", "slot").agg(F.ceil(F.sum("weight") / BLOCK).cast("long").alias("blocks"))
    blocks = blocks.groupBy("sig").agg(F.map_from_entries(F.collect_list(F.struct("slot", "blocks"))).alias("blocks"))
    large = large.join(blocks, "sig")
    wide = F.lit(1 << 32)
    block = F.col("slot") * wide + F.pmod(F.xxhash64("key"), F.col("blocks")[F.col("slot")])
    level = F.floor(F.col("slot") / 2).cast("long")
    near = F.filter(F.map_keys("blocks"), lambda s: (F.abs(F.floor(s / 2).cast("long") - level) <= 1) & (F.pmod(s, F.lit(2)) + F.pmod("slot", F.lit(2)) < 2))
    others = F.flatten(F.transform(near, lambda s: F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks")[s] - 1), lambda k: s * wide + k)))
    large = large.withColumn("block", block).select("sig", "at", "key", "root", "block", F.explode(others).alias("other"))
    large = large.select("sig", "at", "key", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return large.select("sig", "at", "key", "root", F.xxhash64("sig", "i", "j").alias("group"), "block", "i", "j")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the least doc_id of its class), n_class and ``group``.

    Equal texts are of one class. Null and blank texts are in no class: ``class_id`` is their own
    id, n_class 1 and ``group`` null. Null ids are ignored in the least; a class with null ids only has
    a null class_id. Texts without a word are similar to their copies only. Repeated rows count one
    by one. An empty table gives an empty result. Extra columns aren't read.
    """
    rows = _keyed(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", "key")
    found = roots(rows.where("key is not null").select("key", "text"))
    rows = rows.drop("text")
    rows = rows.join(found, "key", "left").select("doc_id", F.coalesce("root", "key").alias("group"))
    each = rows.where("`group` is not null").groupBy("group").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    # written first, so that both sides of the join are plain shuffles and Spark can split a large class
    rows = rows.join(stored(each, "classes"), "group", "left")
    mine = F.col("group").isNotNull()
    return rows.select("doc_id", F.when(mine, F.col("_least")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("n_class"), "group")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``classes``, the one with the least id (then the least text key), with all columns of ``df``.

    Rows in no class stay. Of rows equal in id and text one stays. Null ids come after all others.
    The texts are shuffled once, for the join with the rows to keep.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = _keyed(rows, "text", "_key")
    texts = rows.where("_key is not null").select(F.col("_key").alias("key"), "text")
    small = rows.where("_key is not null").select(F.col("_key").alias("key"), "_id")
    small = small.join(roots(texts), "key", "left").withColumn("group", F.coalesce("root", "key"))
    best = small.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "key")).alias("b"))
    keep = best.select(F.col("b.key").alias("_k"), F.col("b._id").alias("_i"))
    kept = rows.where("_key is not null").select("_row", "_id", "_key")
    kept = kept.join(keep, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi").dropDuplicates(["_key", "_id"])
    return kept.unionByName(rows.where("_key is null").select(*kept.columns)).select("_row.*")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("group")
