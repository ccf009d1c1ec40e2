"""Quality classifier: a factorisation machine over hashed words and text statistics.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
the pairwise term in linear time by the sum-of-squares identity.  Inputs are
hashed words (square-root term weights, scaled to unit length), structure
statistics and the text's size; language, source and ids are never inputs.

The model is fitted in one task on a bounded sample of labelled texts
(``max_rows``, a documented parameter; chosen by a hash of the id, the same for
any partitioning).  Scoring is a stream of Arrow batches without a shuffle; the
model's size is fixed by ``buckets`` and ``factors``.

Defined cases: null and empty texts have no words and are scored from their
(zero) statistics; null labels and null ids are not used for learning; without
labelled rows every score is 0.5; ties cannot occur; repeated rows are scored
alike; an empty table gives an empty result; extra columns pass through, those
named like an output are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateloom.llm._text import release, slices, small_batches, text_buffers, trimmed, word_hashes

#: Production parameters.
BUCKETS, FACTORS, MAX_ROWS, EPOCHS, RATE = 1 << 15, 8, 8000, 6, 0.08
FOLDS, CUT = 5, 0.3
#: Texts of one step of learning.
BLOCK = 64

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 high, 7 mark, 8 symbol
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 7
_CLASS[[ord(c) for c in "#*$%&|<>!~^=_{}[]\\/@+"]] = 8
_KINDS = 9
N_STATS = _KINDS + 9


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def features(body: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, bucket ids, weights, statistics) of the texts: a sparse and a dense block."""
    n = len(off) - 1
    w, woff = word_hashes(body, off)
    row = np.repeat(np.arange(n), np.diff(woff))
    cell, count = np.unique(row * buckets + (w % np.uint64(buckets)).astype(np.int64), return_counts=True)
    r, idx = cell // buckets, cell % buckets
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(r, value**2, n))
    value = value / norm[r]
    lens = np.diff(off)
    byte_row = np.repeat(np.arange(n), lens)
    kinds = np.bincount(byte_row * _KINDS + _CLASS[body], minlength=n * _KINDS).reshape(n, _KINDS) / np.maximum(lens, 1)[:, None]
    words = np.diff(woff)
    distinct = np.bincount(np.unique(mix_rows(row, w) if len(w) else np.zeros(0, np.int64), return_index=True)[1].astype(np.int64), minlength=max(len(w), 1))[: len(w)]
    fresh = np.bincount(row, distinct, n) / np.maximum(words, 1)
    upper_first = kinds[:, 2] * lens / np.maximum(words, 1)
    lines = kinds[:, 5] * lens + 1
    stats = np.column_stack(
        [
            kinds,
            fresh,
            np.minimum(upper_first, 5) / 5,
            np.minimum(lens / np.maximum(words, 1), 20) / 20,
            np.minimum(words / lines, 60) / 60,
            np.log1p(words) / 10,
            np.log1p(lens) / 12,
            (words < 20).astype(float),
            (kinds[:, 8] > 0.02).astype(float),
            (fresh < 0.4).astype(float),
        ]
    )
    return np.searchsorted(r, np.arange(n + 1)), idx, value, stats


def mix_rows(row: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (w ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).astype(np.uint64)


def _sum(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values``; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0)])
    return total[ptr[1:]] - total[ptr[:-1]]


class Machine:
    """w0, w and v; statistics take the ids after the buckets."""

    def __init__(self, buckets: int = BUCKETS, factors: int = FACTORS, seed: int = 7):
        self.buckets, size = buckets, buckets + N_STATS
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, factors))

    def raw(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vw, vs = self.v[idx] * val[:, None], self.v[self.buckets :]
        inner = _sum(vw, ptr) + stats @ vs
        square = _sum(vw**2, ptr) + stats**2 @ vs**2
        linear = _sum((self.w[idx] * val)[:, None], ptr)[:, 0] + stats @ self.w[self.buckets :]
        return self.w0 + linear + 0.5 * (inner**2 - square).sum(1), inner

    def score(self, *x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*x)[0], -30, 30)))

    def fit(self, blocks: list, labels: list, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Adagrad over blocks of texts, in a fixed order."""
        share = np.clip(np.concatenate(labels).mean(), 0.01, 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        gw, gv, g0 = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for epoch in range(epochs):
            for b in np.random.default_rng(epoch).permutation(len(blocks)):
                ptr, idx, val, stats = blocks[b]
                raw, inner = self.raw(ptr, idx, val, stats)
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[b]) / len(labels[b])
                row = np.repeat(np.arange(len(err)), np.diff(ptr))
                e = err[row] * val
                touched, where = np.unique(idx, return_inverse=True)
                dw = np.bincount(where, e, len(touched)) + 1e-6 * self.w[touched]
                part = e[:, None] * (inner[row] - self.v[idx] * val[:, None])
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(len(touched) + 1))
                dv = _sum(part[order], cuts) + 1e-6 * self.v[touched]
                gw[touched] += dw**2
                gv[touched] += dv**2
                self.w[touched] -= rate * dw / np.sqrt(gw[touched])
                self.v[touched] -= 0.2 * rate * dv / np.sqrt(gv[touched])
                s = slice(self.buckets, None)
                dws = err @ stats
                dvs = stats.T @ (err[:, None] * inner) - (err @ stats**2)[:, None] * self.v[s]
                gw[s] += dws**2
                gv[s] += dvs**2
                self.w[s] -= rate * dws / np.sqrt(gw[s])
                self.v[s] -= 0.2 * rate * dvs / np.sqrt(gv[s])
                g0 += err.sum() ** 2
                self.w0 -= rate * err.sum() / np.sqrt(g0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, factors: int = FACTORS) -> Machine:
    """A machine fitted to at most ``max_rows`` of the labelled documents that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    # The ids are cut to max_rows before any text is touched, so they may be broadcast.
    chosen = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", F.col("y").cast("double").alias("y"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, blocks, ys = Machine(buckets, factors), [], []

        def learn(rows: pa.Table) -> None:
            body, off = text_buffers(rows.column("text"))
            blocks.append(features(body, off, buckets))
            ys.append(rows.column("y").to_numpy())

        held: list[pa.RecordBatch] = []  # fewer than 64 rows: blocks do not depend on how Arrow cuts its batches
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            whole = table.num_rows - table.num_rows % BLOCK
            for i in range(0, whole, BLOCK):
                learn(table.slice(i, BLOCK))
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            learn(pa.Table.from_batches(held))
        if not blocks:
            return
        machine.fit(blocks, ys)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], names=["model"])

    # One task by intent: the sample is bounded by max_rows.
    rows = sample.repartition(1).sortWithinPartitions("h", "text").mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else Machine(buckets, factors)


def score_quality(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= ``cut``).  Only texts go to the Python workers, only scores come back."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(machine)
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        m = model.value
        body, off = text_buffers(texts)
        parts = [m.score(*features(body[off[i] : off[j]], off[i : j + 1] - off[i], m.buckets)) for i, j in slices(off)]
        release()
        return pa.array(np.round(np.concatenate(parts), 9) if parts else np.zeros(0))

    return docs.select(*names, score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
