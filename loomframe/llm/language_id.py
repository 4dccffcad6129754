"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths slide over raw bytes; each filter is a table of one weight per offset and
byte value, which is a convolution over one-hot bytes. The largest response of a filter in a
fixed-length window is kept, a softmax layer turns the kept responses into one score per language,
and a document's scores are the mean over all its windows.

Training needs a bounded sample: ``SAMPLE_PER_LANG`` documents of each language, chosen by a hash of
the id, ``SAMPLE_WINDOWS`` windows each. Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_remainder, narrow, small_batches, table, with_fields
from .textkernels import slices

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW_BYTES = 128
SAMPLE_PER_LANG = 500
SAMPLE_WINDOWS = 4
EPOCHS = 4
UNDETERMINED = "und"
_PAD = max(WIDTHS)
_PART = 1 << 18


@dataclass
class ByteConvNet:
    """``tables[w]`` has shape (w, 256, FILTERS); ``dense`` maps all kept responses to languages."""

    languages: list[str]
    tables: list[np.ndarray]
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def responses(self, data: np.ndarray, width: int) -> np.ndarray:
        """Filter responses at each byte of ``data`` that ``width`` - 1 more follow; pairs of offsets are one lookup."""
        t = self.tables[width]
        n = len(data) - _PAD + 1
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        out = None
        for k in range(0, width - 1, 2):
            got = t[k // 2][pair[k : k + n]]
            out = got if out is None else np.add(out, got, out=out)
        if width % 2:
            out += t[-1][data[width - 1 : width - 1 + n]]
        return out

    def fast(self) -> ByteConvNet:
        """The same network with two offsets folded into one table of byte pairs."""
        folded = {}
        for w, t in zip(WIDTHS, self.tables, strict=True):
            pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for k in range(0, w - 1, 2)]
            folded[w] = pairs + [t[w - 1].astype(np.float32)] * (w % 2)
        return ByteConvNet(self.languages, folded, self.shift, self.dense, self.bias)


def train(windows: list[bytes], labels: list[str], seed: int = 7, epochs: int = EPOCHS) -> ByteConvNet:
    """Stochastic gradient descent (with Adam's step sizes) on windows of at most WINDOW_BYTES bytes."""
    languages = sorted(set(labels))
    if not languages:
        return ByteConvNet([], [np.zeros((w, 256, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), np.zeros((len(WIDTHS) * FILTERS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    x = np.zeros((len(windows), WINDOW_BYTES + _PAD), np.uint8)
    for i, w in enumerate(windows):
        x[i, : min(len(w), WINDOW_BYTES)] = np.frombuffer(w[:WINDOW_BYTES], np.uint8)
    y = np.searchsorted(languages, labels)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS] + [np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)).clip(1))  # languages count alike
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            xb, yb = x[rows], y[rows]
            best, kept = [], []
            for w, t in zip(WIDTHS, params, strict=False):
                r = sum(t[k][xb[:, k : k + WINDOW_BYTES]] for k in range(w))
                best.append(r.argmax(1))
                kept.append(np.take_along_axis(r, best[-1][:, None, :], 1)[:, 0, :])
            raw = np.concatenate(kept, 1) + params[-3]
            hidden = np.maximum(raw, 0)
            logits = hidden @ params[-2] + params[-1]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(rows)), yb] -= 1
            g *= weight[yb][:, None] / len(rows)
            back = (g @ params[-2].T) * (raw > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                gw, gt = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(params[i])
                for k in range(w):
                    np.add.at(gt[k], (np.take_along_axis(xb, best[i] + k, 1), np.arange(FILTERS)[None, :]), gw)
                grads.append(gt)
            grads += [back.sum(0), hidden.T @ g, g.sum(0)]
            step += 1
            for j, gr in enumerate(grads):
                first[j] += 0.1 * (gr - first[j])
                second[j] += 0.01 * (gr * gr - second[j])
                params[j] -= 0.01 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
    return ByteConvNet(languages, params[:-3], params[-3], params[-2], params[-1])


def scored(net: ByteConvNet, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language of each text and its probability; ``net`` is ``fast()``."""
    which, prob = np.zeros(len(column), np.int64), np.zeros(len(column))
    for part in slices(column, _PART):
        lengths = np.diff(part.offsets)
        starts = part.offsets[:-1] + _PAD * np.arange(len(lengths))  # zeros between the texts
        data = np.zeros(len(part.data) + _PAD * (len(lengths) + 1), np.uint8)
        data[np.arange(len(part.data)) + np.repeat(_PAD * np.arange(len(lengths)), lengths)] = part.data
        counts = np.maximum(1, -(-lengths // WINDOW_BYTES))
        ends = np.cumsum(counts)
        begin = np.repeat(starts, counts) + WINDOW_BYTES * (np.arange(ends[-1]) - np.repeat(ends - counts, counts))
        kept = np.concatenate([np.maximum.reduceat(net.responses(data, w), begin, axis=0) for w in WIDTHS], 1)
        logits = np.maximum(kept + net.shift, 0) @ net.dense + net.bias
        filled = np.minimum(WINDOW_BYTES, np.repeat(starts + lengths, counts) - begin).clip(1)
        logits *= filled[:, None]
        mean = np.add.reduceat(logits, ends - counts, axis=0) / np.add.reduceat(filled, ends - counts)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        which[part.first : part.last] = p.argmax(1)
        prob[part.first : part.last] = p.max(1)
    return which, prob


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG) -> ByteConvNet:
    """Trains on at most ``sample_per_lang`` rows of each non-null language, chosen by a hash of id and text.

    Only windows cut from the chosen texts, evenly spaced over the whole text, reach the driver.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    order = F.xxhash64(F.col("id").cast("string"), "text")
    # a language's rows are first thinned by the hash to some times the sample, so that no task gets more
    counts = rows.where("lang is not null").groupBy("lang").count().collect()
    shares = {r["lang"]: 4 * sample_per_lang / r["count"] for r in counts if r["count"] > 8 * sample_per_lang}
    if shares:
        share = F.coalesce(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col("lang")], F.lit(1.0))
        rows = rows.where(order / float(1 << 63) <= 2 * share - 1)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    spread = F.greatest(F.length("text") - WINDOW_BYTES, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.col("text").substr((spread * i / max(1, SAMPLE_WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW_BYTES)))
    rows = rows.select("lang", order.alias("order"), F.array_distinct(cut).alias("windows"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("at") <= sample_per_lang)
    taken = sorted((r.lang, r.order, w) for r in rows.collect() for w in r.windows)
    return train([w.encode() for *_, w in taken], [lang for lang, *_ in taken])


def predict(df: DataFrame, net: ByteConvNet, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``.

    Null text and text without a letter: ``und``, score 0. With no language learned every row is
    ``und``. Repeated rows are predicted alike. Columns of ``df`` named like the two results are replaced.
    """
    df = df.drop("lang_pred", "score")
    if not net.languages:
        return df.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    small_batches(df.sparkSession)
    quick, where = net.fast(), df.columns.index(text_col)
    schema = with_fields(df.schema, lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(quick.languages)
        for batch in batches:
            which, prob = scored(quick, batch.column(where))
            out = [*batch.columns, names.take(pa.array(which)), pa.array(prob)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "lang_pred", "score"])

    found = df.mapInArrow(narrow(run), schema)
    known = F.coalesce(F.col(text_col).cast("string").rlike("\\p{L}"), F.lit(False))
    return found.withColumns({"lang_pred": F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED), "score": F.when(known, F.col("score")).otherwise(0.0)})


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows whose crc32 of the id modulo 4 is not 2 and predicts every row.

    Returns doc_id, held_out, lang_pred and score, one row per input row, in a table of its own, so
    extra columns can't clash. Null ids count as the empty text for the split.
    """
    held = id_remainder(id_col, 4) == 2
    net = fit(df.where(~held), id_col, text_col, lang_col)
    rows = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, net).select("doc_id", "held_out", "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
