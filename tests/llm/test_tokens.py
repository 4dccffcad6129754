"""BPE round trips and token files against the libraries."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomframe.llm import bpe, token_files
from loomframe.llm.textkernels import HashIndex, Words, prefix_hash, pretoken_starts, slices, span_hash

from .helpers import EDGES, clashing, sentences, table


def test_pretokens_are_those_of_the_pattern():
    r = random.Random(5)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "5", "½", "!", "字", "\x85", "\x1c", "​", "😀", "'s", "e", "\xa0"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    pattern = regex.compile(bpe._pattern())
    for s in slices(pa.array(texts), 5000):
        starts = pretoken_starts(s.data, s.offsets)
        for i in range(s.first, s.last):
            lo, hi = s.offsets[i - s.first : i - s.first + 2]
            mine = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo
            assert mine.tolist() == [len(texts[i][: m.start()].encode()) for m in pattern.finditer(texts[i])], repr(texts[i])


def test_hash_index():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    keys = np.unique(np.append(keys, np.array([0, 2**64 - 1], np.uint64)))
    index = HashIndex()
    for part in np.array_split(keys, 7):
        index.add(part)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys ^ np.uint64(1))[~np.isin(keys ^ np.uint64(1), keys)] == -1).all()


def thue_morse(n, swapped=False):
    """Two words of 2**n letters, each the other's complement: a polynomial hash modulo 2**64 takes them for one."""
    return "".join("ab"[(bin(i).count("1") + swapped) % 2] for i in range(2**n))


def test_words_are_told_apart_by_bytes():
    texts = ["x", thue_morse(11), "y" * 9, thue_morse(11, True), "x", thue_morse(11, True), "", "y" * 9, "y" * 8 + "z", thue_morse(11)]
    for s in slices(pa.array(texts)):
        hashes = span_hash(prefix_hash(s.data), s.offsets[:-1], s.offsets[1:])
        assert hashes[1] == hashes[3]
        words = Words()
        got = [words.numbers(s.data, s.offsets[:-1], s.offsets[1:]).tolist() for _ in range(2)]
        assert got[0] == got[1] and [texts[got[0].index(n)] for n in got[0]] == texts
        assert [words.bytes[words.starts[n] :][: words.lengths[n]].tobytes().decode() for n in got[0]] == texts


DOCS = [*EDGES, (400, thue_morse(11) + " " + thue_morse(11, True)), (401, thue_morse(11, True)), (402, "<|endoftext|>"), (403, "a<|endoftext|><|endoftext|> b <|endoftext"), (404, "|>"), *((100 + i, sentences(i, 200) + f" rare{i}word") for i in range(40)), (300, "<|endoftext|> x" * 3)]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 4000)
    df = clashing(table(spark, tmp_path, "d", DOCS))
    library = bpe._encoding(open(bpe.vocabulary_file(), "rb").read(), bpe._pattern())
    wanted = sorted(((i, library.encode_ordinary(t or "")) for i, t in DOCS), key=str)
    encoded = bpe.encode(df)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == wanted
    texts = sorted(((i, (t or "").encode()) for i, t in DOCS), key=str)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in bpe.decode(encoded).collect()), key=str) == texts
    both = bpe.encode(df, packed_ids=True, decoded=True).collect()
    assert sorted(((r.doc_id, sha256(r.ids).hexdigest(), bytes(r.decoded)) for r in both), key=str) == sorted(((i, sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), (t or "").encode()) for i, t in DOCS), key=str)
    assert bpe.encode(df.limit(0)).count() == 0
    assert bpe.encode(df.where("text is null")).collect()[0].ids == []


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 50)
    df = clashing(table(spark, tmp_path, "d", DOCS))
    path = str(tmp_path / "tokens")
    token_files.write(df, path)
    library = Tokenizer.from_file(token_files.tokenizer_file())
    assert 50256 in library.encode(dict(DOCS)[402], add_special_tokens=False).ids
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in DOCS}
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in DOCS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens) and any(r.tokens == v for (i, _), v in ids.items() if i == r.doc_id)
        at += r.n_tokens
    sums = {(r.doc_id, r.ids_crc32) for r in token_files.checksums(token_files.read(spark, path)).collect()}
    assert sums == {(i, zlib.crc32(np.array(v, "<u4").tobytes())) for (i, _), v in ids.items()}
    assert "tokens" not in token_files.read(spark, path, tokens=False).columns
    plan = token_files.read(spark, path, tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    token_files.write(df.limit(0), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_files_have_lists_dictionaries_and_page_indexes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write(table(spark, tmp_path, "d", DOCS).where(F.col("doc_id") >= 100), path)
    for f in glob.glob(f"{path}/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        by_name = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in by_name["tokens"].encodings)
        assert any("DELTA" in e for e in by_name["doc_id"].encodings)
        assert by_name["doc_id"].has_offset_index and by_name["doc_id"].has_column_index
