"""Quality classifier on supervised subword embeddings.

Words, word pairs and character n-grams are hashed into one embedding table; a document is the mean
of the vectors of all its features, and a softmax layer scores the mean. Table and layer are
trained together in numpy by stochastic gradient descent. Prediction is linear in the mean, so a
trained model is folded into one weight per hash bucket: scoring is a hash and a lookup per feature.

Training takes a bounded sample: the ``SAMPLE_ROWS`` labelled rows that come first by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, narrow, small_batches, table, with_fields
from .textkernels import U, gram_hash, mixed, owner, prefix_hash, slices, span_hash, word_spans

BUCKETS = 1 << 18
GRAMS = (3, 4)
DIMENSIONS = 8
EPOCHS = 6
RATE = 4.0
SAMPLE_ROWS = 4000
_REPEATED = U(0x5EED)


@dataclass
class SubwordModel:
    """``weights[b]`` is what one feature of bucket b adds before the mean is taken."""

    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owning text, bucket) arrays for words, word pairs and character n-grams; owners ascend in each."""
    prefix = prefix_hash(data)
    start, end = word_spans(data, offsets)
    words = span_hash(prefix, start, end)
    of = owner(offsets, start)
    mask = U(BUCKETS - 1)
    yield of, (words & mask).astype(np.int64)
    if len(words) > 1:
        both = of[1:] == of[:-1]
        # a word after itself is one and the same feature, whatever the word
        pair = np.where(words[1:] == words[:-1], _REPEATED, mixed(words[:-1] * U(3) + words[1:]))
        yield of[1:][both], (pair[both] & mask).astype(np.int64)
    for k in GRAMS:
        grams = gram_hash(prefix, k)
        inside = np.ones(len(grams), bool)
        for back in range(1, k):  # grams that cross into the next text
            at = offsets[1:-1] - back
            inside[at[(at >= 0) & (at < len(grams))]] = False
        at = np.flatnonzero(inside)
        yield owner(offsets, at), (grams[at] & mask).astype(np.int64)


def train(texts: list[str], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> SubwordModel:
    """Both classes count alike. With no text or one class only, the model knows no feature."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return SubwordModel(np.zeros(BUCKETS, np.float32), 0.0 if not len(labels) else 4.0 * (2 * int(labels[0]) - 1))
    rng = np.random.default_rng(seed)
    documents = []
    for part in slices(pa.array(texts), 1):  # a slice for each text
        for i in range(part.last - part.first):
            lo, hi = part.offsets[i], part.offsets[i + 1]
            found = np.concatenate([b for _, b in features(part.data[lo:hi], np.array([0, hi - lo]))] or [np.empty(0, np.int64)])
            documents.append(np.unique(found, return_counts=True))
    table_ = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            rate = RATE * (1 - step / steps)
            step += 1
            found, count = documents[i]
            if not len(found):
                continue
            share = count / count.sum()
            hidden = share @ table_[found]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = layer @ p
            layer -= 0.1 * rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            table_[found] -= rate * share[:, None] * back[None, :]
    return SubwordModel((table_ @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scored(model: SubwordModel, column: pa.Array) -> np.ndarray:
    """The probability of label 1 of each text; a text without features gets that of the bias."""
    out = np.zeros(len(column))
    for part in slices(column, 1 << 20):
        n = part.last - part.first
        total, count = np.zeros(n), np.zeros(n)
        for of, bucket in features(part.data, part.offsets):
            total += np.bincount(of, model.weights[bucket], minlength=n)
            count += np.bincount(of, minlength=n)
        logit = np.where(count > 0, total / np.maximum(count, 1), 0) + model.bias
        out[part.first : part.last] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return out


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> SubwordModel:
    """Trains on at most ``sample_rows`` labelled rows, the first by a hash of the id.

    Rows with a null id, label or text don't train. The sample is at most ``sample_rows`` ids, so
    it is broadcast to the documents; only their texts reach the driver.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    marked = marked.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample_rows)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    rows = rows.join(F.broadcast(marked), "_id").select("_id", "_text", "_label").orderBy(F.xxhash64(F.col("_id").cast("string")), "_text").limit(sample_rows)
    got = rows.toArrow()
    return train(got["_text"].to_pylist(), got["_label"].to_numpy())


def predict(df: DataFrame, model: SubwordModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (the probability of label 1) and ``predicted``; null text is the empty text.

    Columns of ``df`` with these names are replaced.
    """
    df = df.drop("score", "predicted")
    small_batches(df.sparkSession)
    shared, where = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)  # BUCKETS weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scored(shared.value, batch.column(where)))], names=[*batch.schema.names, "score"])

    return df.mapInArrow(narrow(run), with_fields(df.schema, score="double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learns from labels of ids whose crc32 modulo 3 is not 1 and scores every document.

    Returns doc_id, held_out, score and predicted, one row per document. Null text scores as empty.
    """
    known = labels.where(id_remainder(id_col, 3) != 1)
    model = fit(df, known, id_col, text_col, label_col)
    rows = df.select(F.col(id_col).alias("doc_id"), (id_remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "score", "predicted")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
