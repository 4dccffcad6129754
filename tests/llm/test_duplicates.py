"""Near-duplicate classes, components, repeated strings and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import near_dedup, repeats

from .helpers import EDGES, clashing, table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(r, words, rate):
    out = []
    for w in words:
        u = r.random()
        if u < rate / 3:
            continue
        out.append(f"new{r.randint(0, 10**6)}" if u < 2 * rate / 3 else w)
        if u > 1 - rate / 3:
            out.append("more")
    return out


def test_banded_alignment():
    r = random.Random(3)
    a = [[r.randint(0, 9) for _ in range(r.randint(0, 50))] for _ in range(300)]
    b = [[x if r.random() > 0.12 else 11 for x in xs if r.random() > 0.06] for xs in a]
    as_words = lambda xs: np.array(xs, np.uint64) * np.uint64(2)
    wanted = [max(len(x), len(y)) == 0 or 1 - distance(x, y) / max(len(x), len(y)) >= 0.8 - 1e-9 for x, y in zip(a, b, strict=True)]
    assert near_dedup.similar(list(map(as_words, a)), list(map(as_words, b))).tolist() == wanted
    assert near_dedup.banded_distances([as_words([1, 2, 3])], [as_words([2, 3, 4])], 2).tolist() == [2]


def test_sketch_keeps_order_and_occurrence():
    def sketch(text):
        words = np.array([hash(w) & (2**63 - 1) for w in text.split()], np.uint64)
        return set(near_dedup.sketches(*near_dedup.labelled_kmers(words, np.array([len(words)])))[0].tolist())

    words = [f"w{i}" for i in range(60)]
    one = sketch(" ".join(words))
    assert one == sketch(" ".join(words)) and len(one) == near_dedup.SKETCHES
    moved = sketch(" ".join(words[30:] + words[:30]))
    assert len(one & moved) < near_dedup.SKETCHES / 2  # nearly the same k-mers in another order
    assert sketch("a b c d e " * 2) != sketch("a b c d e " * 3)


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


@pytest.fixture(scope="module")
def corpus():
    """Groups of copies and near copies, a passage that many share, and texts of their own."""
    r = random.Random(21)
    fresh = lambda n: [f"{r.choice('abcdefghij')}{r.randint(0, 5000)}" for _ in range(n)]
    passage = fresh(60)
    docs, truth, at = list(EDGES), {}, 100
    for size in (30, 2, 2, 3, 5):
        origin = fresh(150)
        for k in range(size):
            docs.append((at, " ".join(origin if k % 4 == 0 else edited(r, origin, 0.05))))
            truth[at] = size, origin[0]
            at += 1
    for _ in range(60):
        docs.append((at, " ".join(fresh(100) + passage)))
        truth[at] = at
        at += 1
    return docs, truth


def test_classes(spark, tmp_path, corpus):
    docs, truth = corpus
    df = clashing(table(spark, tmp_path, "d", docs))
    got = near_dedup.classes(df).collect()
    assert len(got) == len(docs)
    found = {r.doc_id: r.class_id for r in got}
    groups = {}
    for i, g in truth.items():
        groups.setdefault(g, []).append(i)
    assert {i: min(members) for members in groups.values() for i in members} == {i: found[i] for i in truth}
    assert all(found[i] == i for i in (1, 2, 3)) and found[6] == 5 and Counter(r.n_class for r in got)[3] >= 3
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i in truth) == sorted(min(m) for m in groups.values())
    assert {1, 2, 3, 5} <= set(ids) and 6 not in ids and None in ids
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_texts_whose_keys_collide(spark, tmp_path, monkeypatch, corpus):
    docs, _ = corpus
    df = table(spark, tmp_path, "d", docs)
    wanted = sorted(map(tuple, near_dedup.classes(df).drop("group").collect()), key=str)
    real = near_dedup.text_key
    monkeypatch.setattr(near_dedup, "text_key", lambda text: F.pmod(real(text), F.lit(40)))
    assert sorted(map(tuple, near_dedup.classes(df).drop("group").collect()), key=str) == wanted
    monkeypatch.setattr(near_dedup, "COLLISIONS", 3)
    assert near_dedup.deduplicated(df).count() == len({r[1] for r in wanted if r[0] not in (1, 2, 3)} | {1, 2, 3})


def test_recall_of_scattered_replacements():
    """Pairs of texts of 200 words at edit similarity 0.95 to 0.8: how many share a sketch."""
    r = np.random.default_rng(5)
    for similarity, least in ((0.95, 1.0), (0.9, 0.99), (0.85, 0.95), (0.8, 0.75)):
        found = 0
        for _ in range(100):
            one = r.integers(0, 2**62, 200).astype(np.uint64)
            two = one.copy()
            two[r.choice(200, round(200 * (1 - similarity)), replace=False)] = r.integers(0, 2**62, round(200 * (1 - similarity))).astype(np.uint64)
            assert near_dedup.similar([one], [two])[0]
            x, y = (near_dedup.sketches(*near_dedup.labelled_kmers(w, np.array([200])))[0] for w in (one, two))
            found += bool((x == y).any())
        assert found >= 100 * least, (similarity, found)


def removed(texts, length, across=False, words=0, distinct=0):
    raw = [(t or "").encode() for t in texts]
    windows = [[b[i : i + length] for i in range(len(b) - length + 1)] for b in raw]
    seen = Counter(x for w in windows for x in (set(w) if across else w))
    out = []
    for b, mine in zip(raw, windows, strict=True):
        gone = bytearray(len(b))
        for i, w in enumerate(mine):
            if seen[w] > 1:
                gone[i : i + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(gone)) if words or distinct else ():
            inside = [b[x.start() : x.end()] for x in re.finditer(rb"[^ \t-\r]+", b) if m.start() <= x.start() and x.end() <= m.end()]
            if len(inside) < words or len(set(inside)) < distinct:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("gram", "group"), [(6, 20_000), (6, 3), (20, 100), (1, 100)])
def test_repeats_against_brute_force(spark, tmp_path, monkeypatch, gram, group):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    r = random.Random(gram * 31 + group)
    passages = ["".join(r.choice("abcé") for _ in range(r.randint(5, 60))) for _ in range(12)]
    texts = [None, "", passages[0] * 3, passages[1] * 4 + passages[2] * 2, "\0" * 80, "\0" * 30 + "x", "ab" * 200, *(t for _, t in EDGES if t is None or len(t) < 1000)]
    for _ in range(200):
        t = ""
        for _ in range(r.randint(0, 5)):
            t += "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 30)))
            if r.random() < 0.6:
                p = r.choice(passages)
                t += p[r.randint(0, len(p) // 2) :]
            if r.random() < 0.1:
                t += t[-40:]
        texts.append(t)
    texts += r.sample(texts, 20)
    df = clashing(table(spark, tmp_path, "d", list(enumerate(texts))))
    for across in (False, True):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in repeats.remove_repeats(df, length=20, gram=gram, group=group, across=across).collect()}
        assert got == dict(enumerate(removed(texts, 20, across)))


def test_repeats_of_so_many_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    r = random.Random(9)
    fresh = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    passages = [fresh(n) for n in (4, 8, 9, 10, 11, 12, 30)] + ["so " * 40]
    texts = [None, "", " ", passages[3], passages[3], passages[6] + " " + passages[6]]
    texts += [f"{fresh(r.randint(0, 9))} {r.choice(passages)}{r.choice(['', ' ', ', x'])} {fresh(r.randint(0, 9))} {r.choice(passages)}" for _ in range(80)]
    df = clashing(table(spark, tmp_path, "d", list(enumerate(texts))))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in repeats.remove_repeats(df, length=30, gram=8, across=True, min_words=10, min_distinct_words=5).collect()}
    assert got == dict(enumerate(removed(texts, 30, True, 10, 5)))


def test_repeats_in_whole_characters(spark, tmp_path):
    passage = "é" * 30
    df = table(spark, tmp_path, "d", [(1, "a" + passage + "b"), (2, "x" + passage + "y"), (3, None), (None, "ü")])
    got = {r.doc_id: r.kept for r in repeats.remove_repeats(df, length=21, gram=5, whole_characters=True).collect()}
    assert got == {1: "ab", 2: "xy", 3: "", None: "ü"}
    assert repeats.remove_repeats(df.limit(0), length=21, gram=5).count() == 0


def test_intervals_and_maximal_repeats():
    assert sorted(repeats.intervals(np.array([1, 3, 0, 2]))) == [(0, 0, 4), (1, 0, 2), (2, 3, 4), (3, 1, 2)]
    rows = [b"abcdX", b"abcdY", b"abZ", b"abcdX"]
    left = [b"Lqq", b"Lqz", b"Lqq", b"Mqq"]
    right, sizes = repeats._matrix(rows, False)
    before, left_sizes = repeats._matrix(left, True)
    got = repeats.maximal_repeats(before, right, left_sizes, sizes, 6)
    # 0 and 3 share qq + abcdX; 1 shares abcd, but no byte before it; 2 shares Lqq + ab, too short
    assert got[0].tolist() == [2, 0, 0, 2] and got[1].tolist() == [5, 0, 0, 5]


def test_pipeline_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    docs, _ = corpus
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice("the of and river house green walks slowly under bridge stone light".split()) + str(r.randint(0, 9)) * (r.random() < 0.2) for _ in range(n))
    item = prose(30)
    rows = [(i, t, "en", "src", len(t or ""), "x") for i, t in docs] + [(1000, prose(60) + " " + item + " " + prose(60), "en", "src", 1, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string"
    table(spark, tmp_path, "documents.parquet", rows, schema)
    table(spark, tmp_path, "benchmark.parquet", [(1, item)], "item_id long, text string", 1)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert not {1, 2, 3, 8} & seen["language_id"] and {4, 5, 6, 7, 9} <= seen["language_id"]
    assert 6 not in seen["near_dedup"] and 5 in seen["near_dedup"] and 1000 in seen["repeats"] and 1000 not in seen["decontamination"]
    shared = docs[-1][1].split(" ")[100:]
    final = {r.doc_id: r.text for r in now.collect()}
    assert len(shared) == 60 and sum(" ".join(shared[:50]) in (t or "") for t in final.values()) == 0
    assert 4 in final and final[4].split() == ["word"] * 4000  # repeats itself only
    tokens = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in tokens.collect()} == seen["decontamination"]
    from hashlib import sha256

    assert all(r.decoded_sha256 == sha256(final[r.doc_id].encode()).hexdigest() for r in tokens.collect())


def test_template_family_leaves_hardly_a_pair_open(spark, tmp_path):
    """Texts that share a template and are just not similar, with similar pairs among them."""
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    template, texts = fresh(111), []
    for _ in range(300):
        words = template + fresh(29)
        texts.append(words)
        if len(texts) % 6 == 0:
            twin = [*words]
            for k in range(3):
                twin[111 + 9 * k] = f"t{r.randint(0, 10**9)}"
            for k in range(10):
                twin[5 + 11 * k] = f"t{r.randint(0, 10**9)}"
            texts.append(twin)
    df = table(spark, tmp_path, "d", [(i, " ".join(w)) for i, w in enumerate(texts)] + [(1000 + i, " ".join(w)) for i, w in enumerate(texts[:40])])
    found = {x.doc_id: x.class_id for x in near_dedup.classes(df).collect()}
    number = np.unique([w for t in texts for w in t], return_inverse=True)[1].astype(np.uint64) * np.uint64(2)
    ids = np.split(number, np.cumsum([len(t) for t in texts])[:-1])
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    same = near_dedup.similar([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs])
    near = [p for p, ok in zip(pairs, same, strict=True) if ok]
    drawn = [set(s.tolist()) for s in (near_dedup.sketches(*near_dedup.labelled_kmers(words, np.array([len(words)])))[0] for words in (near_dedup.tokens(*packed(w))[0] for w in texts))]
    near = [(a, b) for a, b in near if drawn[a] & drawn[b]]
    missed = [(a, b) for a, b in near if found[a] != found[b]]
    assert len(near) >= 20 and len(missed) <= 0.1 * len(near), (len(near), len(missed))
    assert len(set(found.values())) >= 300


def packed(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return data, np.array([0, len(data)])


@pytest.mark.parametrize("block", [None, 3000])
def test_no_similar_pair_of_a_bucket_is_lost(spark, tmp_path, monkeypatch, block):
    """Families that share a template and are just not similar, of several lengths: classes are the components of all similar pairs that share a sketch."""
    if block and hasattr(near_dedup, "BLOCK"):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(31)
    fresh = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    texts = []
    for length in (70, 111, 140):
        template = fresh(length)
        for _ in range(150):
            words = template + fresh(r.randint(length * 26 // 100, length * 29 // 100))
            texts.append(words)
            if r.random() < 0.3:
                texts.append([f"t{r.randint(0, 10**9)}" if r.random() < 0.12 else w for w in words])
    texts += [["only"], ["only", "two"], ["x"] * 90, ["x"] * 100, ["x"] * 300]
    df = table(spark, tmp_path, "d", [(i, " ".join(w)) for i, w in enumerate(texts)])
    found = {x.doc_id: x.class_id for x in near_dedup.classes(df).collect()}
    number = np.unique([w for t in texts for w in t], return_inverse=True)[1].astype(np.uint64) * np.uint64(2)
    ids = np.split(number, np.cumsum([len(t) for t in texts])[:-1])
    drawn = np.stack([near_dedup.sketches(*near_dedup.labelled_kmers(words, np.array([len(words)])))[0] for words in (near_dedup.tokens(*packed(w))[0] for w in texts)])
    pairs = [(a, b) for a in range(len(texts)) for b in np.flatnonzero((drawn[:a] == drawn[a]).any(axis=1)).tolist()]
    same = near_dedup.similar([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs])
    wanted = list(range(len(texts)))
    for (a, b), ok in zip(pairs, same, strict=True):
        if ok and wanted[a] != wanted[b]:
            lo, hi = sorted((wanted[a], wanted[b]))
            wanted = [lo if w == hi else w for w in wanted]
    assert len(pairs) > 20_000 and same.sum() > 60
    assert found == dict(enumerate(wanted))


@pytest.mark.parametrize("block", [None, 2000])
def test_members_of_open_buckets_are_joined_once(spark, tmp_path, monkeypatch, block):
    """Joins by bucket make each candidate once, each member of an open bucket once, and those of large buckets once more."""
    if block:
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(17)
    fresh = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    template = fresh(110)
    texts = [template + fresh(30) for _ in range(120)]
    texts += [edited(r, w, 0.03) for w in texts[:40]]
    df = table(spark, tmp_path, "d", [(i, " ".join(w)) for i, w in enumerate(texts)])
    made, real = Counter(), near_dedup.stored

    def counted(rows, what):
        out = real(rows, what)
        made[what] += out.count() if what in ("candidates", "open") else 0
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    near_dedup.classes(df).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs, rows = store.executionsList(), 0
    for run in (runs.apply(i) for i in range(before, runs.size())):
        nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(r"Join \[sig#\w+\], \[sig#\w+\]", node.desc()):
                metrics = node.metrics()
                ids = [m.accumulatorId() for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "number of output rows"]
                rows += sum(int(values.apply(k).replace(",", "")) for k in ids if values.contains(k))
    assert made["open"] > 1000
    assert made["candidates"] + made["open"] <= rows <= made["candidates"] + made["open"] * (2 if block else 1)
