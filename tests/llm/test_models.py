"""Language ID, quality classifier and language model: held-out accuracy and the textbook recursion."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from loomframe.llm import ctw, language_id, quality_model

from .helpers import EDGES, clashing, sentences, table


def test_language_id(spark, tmp_path):
    docs = [(i, sentences(i, 30, lang), lang) for i, lang in enumerate(["en", "de"] * 60)] + [(i, t, None) for i, t in EDGES]
    df = table(spark, tmp_path, "d", docs, "doc_id long, text string, lang string")
    got = language_id.identify(clashing(df)).collect()
    assert len(got) == len(docs)
    truth = {i: lang for i, _, lang in docs if lang}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id > 9 and r.held_out)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    texts = {(i, t) for i, t, lang in docs if lang is None and not re.search(r"[^\W\d_]", t or "")}
    assert all(any(r.lang_pred == "und" for r in by_id[i]) for i, _ in texts)
    assert {r.lang_pred for r in language_id.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_windows_of_a_text_are_scored_together():
    net = language_id.train([sentences(i, 20, lang).encode() for i in range(40) for lang in ("en", "de")], ["en", "de"] * 40).fast()
    import pyarrow as pa

    long, short = sentences(1, 2000, "de"), sentences(2, 12)
    which, prob = language_id.scored(net, pa.array([short, None, long, "", short]))
    assert [net.languages[w] for w in which[[0, 2, 4]]] == ["en", "de", "en"] and prob[0] == pytest.approx(prob[4])


def test_quality_classifier(spark, tmp_path):
    junk = "win*** cash%%% now### click&&&"
    docs = [*EDGES, *((100 + i, sentences(i, 40) if i % 2 else " ".join(f"{w}***" for w in sentences(i, 40).split()) + junk) for i in range(200))]
    labels = [(100 + i, i % 2) for i in range(200)] + [(None, 1), (100, None)]
    got = quality_model.classify(clashing(table(spark, tmp_path, "d", docs)), clashing(table(spark, tmp_path, "l", labels, "doc_id long, quality int"))).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 100 and r.held_out]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.classify(table(spark, tmp_path, "e", EDGES), empty).count() == len(EDGES)


def test_repeated_words_are_one_feature():
    data = np.frombuffer(b"spam spam spam eggs eggs", np.uint8)
    pairs = list(quality_model.features(data, np.array([0, len(data)])))[1][1]
    assert len(pairs) == 4 and len(set(pairs.tolist())) == 2


# --- context-tree weighting

def kt(z, o):
    return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)


def steps(text, depth):
    context = b"\0" * depth
    for byte in (text or "").encode() + b"\0":
        node = 1
        for level in range(7, -1, -1):
            bit = byte >> level & 1
            yield [(context[depth - d :], node) for d in range(depth + 1)], bit
            node = 2 * node + bit
        context = (context + bytes([byte]))[1:]


def textbook(train, texts, depth):
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text in train:
        for path, bit in steps(text, depth):
            for key in path:
                counts[key][bit] += 1
                if key[0]:
                    children[key[0][1:], key[1]].add(key)

    @cache
    def weighted(key):
        if key not in counts:
            return 0.0
        own = kt(*counts[key])
        return own if len(key[0]) == depth else np.logaddexp(own, sum(map(weighted, children[key]))) - math.log(2)

    def probability(path, bit):
        p = None
        for key in reversed(path):
            n = counts.get(key, (0, 0))
            own = (n[bit] + 0.5) / (sum(n) + 1)
            w = 1.0 if p is None else math.exp(kt(*n) - math.log(2) - weighted(key))
            p = w * own + (1 - w) * (p or 0)
        return p

    return [sum(math.log10(probability(path, bit)) for path, bit in steps(t, depth)) for t in texts]


def test_ctw_against_the_recursion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 1500)
    docs = [*((i, t) for i, t in EDGES if i != 4), *((100 + i, sentences(i, 12)) for i in range(40))]
    held = lambda i: i is not None and i % 5 == 2
    df = clashing(table(spark, tmp_path, "d", docs)).selectExpr("*", "doc_id % 5 = 2 as held_out")
    got = sorted(ctw.score(df, depth=3).collect(), key=lambda r: (str(r.doc_id), r.score))
    train = [t for i, t in docs if not held(i)]
    scores = textbook(train, [t for _, t in docs], 3)
    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    known = Counter(w for t in train for w in words(t))
    total = sum(known.values())
    wanted = sorted(((i, s, t) for (i, t), s in zip(docs, scores, strict=True)), key=lambda r: (str(r[0]), r[1]))
    assert len(got) == len(wanted)
    for r, (i, s, t) in zip(got, wanted, strict=True):
        base = sum(math.log10((known[w] + 1) / (total + len(known) + 1)) for w in words(t))
        assert r.doc_id == i and r.score == pytest.approx(s, rel=1e-5) and r.base_score == pytest.approx(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(t)), sum(known[w] > 0 for w in words(t)), total)
    assert ctw.score(df.limit(0), depth=3).count() == 0
    untrained = ctw.score(df.selectExpr("doc_id", "text", "true as held_out").where("text = ''"), depth=3).first()
    assert untrained.score == pytest.approx(-8 * math.log10(2)) and untrained.base_score == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 9.9, 10, 123.5, 1e6, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
