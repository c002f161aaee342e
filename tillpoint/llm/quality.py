"""Quality classifier: a factorisation machine over hashed words and text statistics.

``score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])``:
all pairwise interactions of a document's features in time linear in their
number.  Features are the words of the whole text, lower-cased and hashed to
``BUCKETS`` numbers, and statistics of its characters, words and lines.

The machine is fitted on the driver on at most ``train_rows`` labelled
documents (those with the smallest hash of their id); the fitted weights have a
fixed size.  Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.textscan import Words, blocks

BUCKETS = 1 << 14
N_STATS = 16
N_FEATURES = BUCKETS + N_STATS


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows ``(first, index, value)``: row ``r`` has entries ``first[r]:first[r + 1]``.

    The word entries of a text have Euclidean length 1.  Every text has all statistics; those of an empty one are 0.
    """
    n = len(texts)
    w = Words(texts, lower=True)
    count = np.diff(w.first).astype(np.float64)
    key = (w.doc.astype(np.int64) << 14) | (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    cell, times = np.unique(key, return_counts=True)
    row, value = cell >> 14, np.log1p(times)
    scale = np.sqrt(np.bincount(row, value * value, n))
    value = value / scale[row]

    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, n)
    text = np.repeat(np.arange(n), size)
    share = lambda mask: np.bincount(text[mask], minlength=n) / np.maximum(size, 1)
    top = np.zeros(n)
    np.maximum.at(top, row, times)
    distinct = np.bincount(row, minlength=n)
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(w.doc, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length * length, n) / np.maximum(count, 1) - mean * mean, 0))
    last = w.buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    per_word = lambda mask: np.bincount(w.doc[mask], minlength=n) / np.maximum(count, 1)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    symbol = np.isin(raw, np.frombuffer(b"#$%&*<=>@[]^_`{|}~\\", np.uint8))
    again = np.zeros(len(w.hash), bool)
    if len(again):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    stats = np.stack([
        np.log1p(size) / 12, np.log1p(count) / 10, mean / 20, spread / 20, distinct / np.maximum(count, 1), top / np.maximum(count, 1),
        share((raw >= 65) & (raw <= 90)) * 2, share(letter), share((raw >= 48) & (raw <= 57)) * 4, share(symbol) * 4,
        share(raw == 33) * 8, share(raw == 10) * 8, share(raw >= 128) * 2, per_word(again),
        per_word(np.isin(last, np.frombuffer(b".,;:?", np.uint8))), per_word(length > 24)], axis=1)
    per = np.bincount(row, minlength=n) + N_STATS
    first = np.concatenate([[0], np.cumsum(per)])
    index, values = np.empty(first[-1], np.int32), np.empty(first[-1], np.float32)
    at = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
    index[at], values[at] = cell & (BUCKETS - 1), value
    at = (first[1:, None] - N_STATS + np.arange(N_STATS)).ravel()
    index[at], values[at] = np.tile(np.arange(BUCKETS, N_FEATURES), n), stats.ravel()
    return first, index, values


class Machine:
    def __init__(self, rank: int = 6, seed: int = 11):
        self.bias = 0.0
        self.linear = np.zeros(N_FEATURES)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (rank, N_FEATURES))

    def raw(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, sums: list | None = None) -> np.ndarray:
        out = self.bias + np.add.reduceat(self.linear[index] * value, first[:-1])
        for f in self.factors:
            x = f[index] * value
            s = np.add.reduceat(x, first[:-1])
            out += 0.5 * (s * s - np.add.reduceat(x * x, first[:-1]))
            if sums is not None:
                sums.append((x, s))
        return out

    def score(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, index, value), -30, 30)))

    def fit(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray,
            epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, batch: int = 256, seed: int = 5) -> Machine:
        """Logistic loss by AdaGrad, in a fixed order of rows drawn from ``seed``."""
        n, random = len(label), np.random.default_rng(seed)
        seen_l, seen_f, seen_b = np.full(N_FEATURES, 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(epochs):
            order = random.permutation(n)
            for at in range(0, n, batch):
                rows = order[at:at + batch]
                per = first[rows + 1] - first[rows]
                begin = np.concatenate([[0], np.cumsum(per)])
                take = np.repeat(first[rows] - begin[:-1], per) + np.arange(begin[-1])
                i, v, sums = index[take], value[take].astype(np.float64), []
                raw = self.raw(begin, i, v, sums)
                off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]) / len(rows)
                each = np.repeat(off, per)
                grad = np.bincount(i, each * v, N_FEATURES) + decay * self.linear / n
                seen_l += grad * grad
                self.linear -= rate * grad / np.sqrt(seen_l)
                for k, (x, s) in enumerate(sums):
                    grad = np.bincount(i, each * v * (np.repeat(s, per) - x), N_FEATURES) + decay * self.factors[k] / n
                    seen_f[k] += grad * grad
                    self.factors[k] -= rate * grad / np.sqrt(seen_f[k])
                seen_b += off.sum() ** 2
                self.bias -= rate * off.sum() / np.sqrt(seen_b)
        return self


FEATURE_SCHEMA = "label double, row_order long, index array<int>, value array<float>"


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in blocks(batch, 0):
            first, index, value = features(texts)
            offsets = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32())),
                                              pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32()))], ["label", "row_order", "index", "value"])


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Machine:
    """Fit on at most ``train_rows`` labelled documents that are not held out.

    A row without id or label is left out; of several labels of a document the smallest counts.
    Without any labelled document the machine scores 0.5.
    """
    rows = labels.select(F.col(doc_id).cast("long").alias("train_id"), F.col(label).cast("double").alias("label")).dropna()
    rows = rows.groupBy("train_id").agg(F.min("label").alias("label")).filter(~held_out("train_id"))
    rows = rows.withColumn("row_order", F.xxhash64("train_id")).orderBy("row_order", "train_id").limit(train_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("train_id"), F.col(text).cast("string").alias("text"))
    texts = texts.join(F.broadcast(rows), "train_id")  # at most train_rows rows
    got = texts.select("text", "label", "row_order").mapInArrow(_featurise, FEATURE_SCHEMA).toArrow()
    machine = Machine()
    try:
        return _fitted(machine, got) if got.num_rows else machine
    finally:
        # What the rows took goes back to the system: the driver goes on without it for the rest of the session.
        del got
        pa.default_memory_pool().release_unused()


def _fitted(machine: Machine, got: pa.Table) -> Machine:
    got = got.take(pa.compute.sort_indices(got, [("row_order", "ascending"), ("label", "ascending")])).combine_chunks()
    index = got.column("index").combine_chunks()
    index = index.chunk(0) if isinstance(index, pa.ChunkedArray) else index
    value = got.column("value").combine_chunks()
    value = value.chunk(0) if isinstance(value, pa.ChunkedArray) else value
    first = np.concatenate([[0], np.cumsum(np.asarray(index.value_lengths()))]).astype(np.int64)
    y = np.asarray(got.column("label")).astype(np.float64)
    return machine.fit(first, np.asarray(index.flatten()), np.asarray(value.flatten()), y)


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``; a null text scores as an empty one.  Other columns stay as they are."""
    schema = docs.schema
    if out in docs.columns:
        raise ValueError(f"the table has a column {out}; name another")
    at = docs.columns.index(text)
    lean = Machine.__new__(Machine)
    lean.bias, lean.linear, lean.factors = machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    weights = docs.sparkSession.sparkContext.broadcast(lean)  # a fixed size: (rank + 1) * N_FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch, at):
                scores = weights.value.score(*features(texts)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(scores)], [*batch.schema.names, out])
    return docs.mapInArrow(run, type(schema)([*schema.fields, *docs.sparkSession.range(0).select(F.lit(0.0).alias(out)).schema.fields]))
