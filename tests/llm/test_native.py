"""Quality rules, sharding and decontamination against plain Python."""

import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomframe.llm import decontamination, quality_rules, sharding

from .helpers import EDGES, clashing, sentences, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_against_python(spark, tmp_path):
    docs = EDGES + [(100 + i, sentences(i, 5 * i) + "\n" + sentences(i % 3, 12) + "\n" + sentences(i % 3, 12)) for i in range(30)] + [(200, "a b c d e a b c d e a b"), (201, "x\x0bx\x0cy\rz\tw v")]
    got = sorted(map(tuple, quality_rules.apply_rules(clashing(table(spark, tmp_path, "d", docs))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    wanted = []
    for i, text in docs:
        c = base_counts(text)
        wanted.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(wanted, key=str)


def test_rules_keep_prose_and_drop_junk(spark, tmp_path):
    prose, junk = sentences(1, 120), "buy*** now%%% cheap### deals&&& here$$$ best*** price|||"
    docs = [(1, "\n".join(sentences(k, 40) + " distinctive" + str(k) for k in range(5))), (2, " ".join([junk] * 3)), (3, "short text"), (4, prose.upper())]
    verdict = dict(quality_rules.apply_rules(table(spark, tmp_path, "d", docs), rules=[quality_rules.Rule("symbols", "symbols_per_word", None, 0.1), quality_rules.Rule("capitals", "capital_ratio", None, 0.5)]).select("doc_id", "broken_rules").collect())
    assert verdict == {1: "", 2: "symbols", 3: "", 4: "capitals"}
    with pytest.raises(ValueError, match="unknown measures"):
        quality_rules.compiled([quality_rules.Rule("x", "nope", 1)])
    assert quality_rules.apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_are_one_projection(spark, tmp_path):
    plan = quality_rules.apply_rules(table(spark, tmp_path, "d", EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 10**18, 10**16)]
    for n in (1, 2, 8, 9, 100):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select(sharding.jump_hash(F.col("k"), n)).collect()
        assert [r[0] for r in got] == [jump(k, n) for k in keys]


def test_shards(spark, tmp_path):
    docs = EDGES + [(i, f"text {i}") for i in range(100, 1100)] + [(50, "hot")] * 300
    got = sharding.assign(clashing(table(spark, tmp_path, "d", docs)), buckets=5).collect()
    assert len(got) == len(docs)
    for shard in range(8):
        mine = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert sizes == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs}
    assert len({r.shard for r in got if r.doc_id == 50}) == 1
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ITEM = "which of the following rivers flows north through nine countries before it meets the sea"


def test_leaks(spark, tmp_path):
    words = ITEM.split()
    changed = [*words]
    changed[2], changed[9] = "some", "seven"
    docs = [
        *EDGES,
        (20, sentences(1, 50) + " " + ITEM + " " + sentences(2, 50)),
        (21, sentences(3, 50) + " " + " ".join(changed).upper() + "!"),
        (22, " ".join(words[:8]) + " " + sentences(4, 30)),
        (23, " ".join(reversed(words))),
        (24, "alpha beta gamma"),
        (None, ITEM),
    ]
    bench = [(1, ITEM), (1, ITEM), (2, None), (3, "?!"), (4, "beta, gamma"), (5, ITEM + " and then some more words that are nowhere else at all")]
    items = table(spark, tmp_path, "b", bench, "item_id long, text string", 1)
    frame = clashing(table(spark, tmp_path, "d", docs))
    wanted = {(20, 1), (21, 1), (None, 1), (20, 5), (21, 5), (None, 5), (24, 4)}
    for per_block in (500_000, 20):
        got = decontamination.leaks(frame, items, tokens_per_block=per_block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == wanted and len(got) == len(wanted)
    kept = decontamination.without_leaks(frame, items)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in (20, 21, 24, None))
    assert decontamination.leaks(frame.limit(0), items).count() == decontamination.leaks(frame, items.limit(0)).count() == 0
    assert "Python" not in decontamination.leaks(frame, items)._jdf.queryExecution().executedPlan().toString()


def leaking(doc, item):
    """The rule by brute force: 13 consecutive item tokens (all, if fewer) of which 80 % agree in one alignment."""
    run = min(13, len(item))
    for offset in range(1 - len(item), len(doc)):
        same = [0 <= offset + k < len(doc) and doc[offset + k] == x for k, x in enumerate(item)]
        if any(5 * sum(same[k : k + run]) >= 4 * run for k in range(len(item) - run + 1)):
            return True
    return False


def replaced(item, at):
    return [f"other{k}" if k in at else x for k, x in enumerate(item)]


def against_the_rule(spark, tmp_path, items, docs):
    bench = table(spark, tmp_path, "b", [(i, " ".join(x)) for i, x in items.items()], "item_id long, text string", 1)
    frame = table(spark, tmp_path, "d", [(i, " ".join(x)) for i, x in enumerate(docs)])
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, bench).collect()}
    wanted = {(i, j) for i, doc in enumerate(docs) for j, item in items.items() if leaking(doc, item)}
    assert got == wanted
    return wanted


def test_leaks_with_two_of_thirteen_tokens_replaced(spark, tmp_path):
    item = [f"w{k}" for k in range(20)]
    docs = [replaced(item[:16], {2, 7, 12})]
    for start in (0, 3, 4, 7):
        docs += [["x", "y", *replaced(item, {start + a, start + b})[start : start + 13], "z"] for a, b in combinations(range(13), 2)]
        docs += [replaced(item, {start + a, start + b, start + 6})[start : start + 13] for a, b in combinations(range(6), 2)]
    wanted = against_the_rule(spark, tmp_path, {1: item, 2: item[:16]}, docs)
    assert (0, 2) in wanted and len(wanted) > 400


def test_leaks_of_short_items(spark, tmp_path):
    items = {n: [f"n{n}w{k}" for k in range(n)] for n in range(1, 13)}
    docs = []
    for n, item in items.items():
        for size in (0, 1, 2, 3):
            docs += [["x", *replaced(item, set(at)), "y", "z"] for at in combinations(range(n), size)]
        docs += [item[1:], item[:-1], item[2:], item[1:-1]]
    wanted = against_the_rule(spark, tmp_path, items, docs)
    assert {j for _, j in wanted} == set(items) and len(wanted) < len(docs)


def test_leaks_of_long_items(spark, tmp_path):
    """Items of several pieces, whole texts of over a MB, and counts against the rule."""
    item = [f"i{k}" for k in range(400)]
    far = ["x"] * 300_000
    docs = [[*far, *replaced(item[a : a + 13], {1, 5}), *far[:9]] for a in (0, 17, 18, 19, 27, 387)] + [[*far, *replaced(item[30:43], {1, 5, 8})], item]
    frame = table(spark, tmp_path, "d", [(i, " ".join(x)) for i, x in enumerate(docs)])
    bench = table(spark, tmp_path, "b", [(7, " ".join(item))], "item_id long, text string", 1)
    got = {r.doc_id: (r.n_item_tokens, r.n_agreeing) for r in decontamination.leaks(frame, bench, piece=30).collect()}
    assert got == {i: (400, 11) for i in range(6)} | {7: (400, 13)}
