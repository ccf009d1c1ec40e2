"""Stupid-backoff language-model scores, computed relationally.

Documents are dealt to blocks.  A block's distinct n-grams (orders 1 to 3, hashed)
go, with their counts, to hash partitions as sorted, packed lists: the n-gram
count table, partitioned by hash.  Each partition adds the counts of equal
n-grams and answers every list in its own order, so only counts travel back.  A
block then joins the answers to its exploded n-grams and sums per document.

The score of a word is c(w1 w2 w3) / c(w1 w2), else ``backoff`` times that of the
next lower order; the unigram score is c(w) / N, unseen words count one half.
All counts are those of the whole corpus less the document's own (otherwise no
n-gram of the corpus would ever be unseen).  Nothing is sampled or pruned, and a
frequent n-gram is one entry a block.

Defined cases: words are split at white space, case kept; null and empty texts
have no words and score 0; the first words of a text start at their own order;
repeated rows are documents of their own; a null doc_id is kept; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateloom.llm._text import inside, mix, ngram_hashes, partitions, row_of_words, slices, small_batches, text_buffers, word_hashes

#: Text handled together by one task, and text whose n-grams share one hash partition.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
ORDER, BACKOFF = 3, 0.4


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of unsigned 64-bit integers, compressed: high bytes, mostly zero, vanish."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack(sorted_hashes: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_hashes, prepend=np.uint64(0)))


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b), dtype=np.uint64)


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets by row) of packed texts, a few megabytes at a time."""
    texts = pa.array([zstandard.decompress(z) for z in table.column("packed").to_pylist()], pa.binary())
    body, off = text_buffers(texts)
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(off, 2 << 20):
        w, woff = word_hashes(body[off[i] : off[j]], off[i : j + 1] - off[i])
        parts.append(w)
        counts.append(np.diff(woff))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zstandard.compress((t or "").encode(), 1) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["doc_id", "packed", "block"])


def _grams(table: pa.Table, order: int):
    """(word offsets, valid starts by order, hashes by order) of a block."""
    w, woff = _words(table)
    starts, hashes = [], []
    for k in range(1, order + 1):
        ok = np.flatnonzero(inside(woff, k, len(w)))
        starts.append(ok)
        hashes.append(mix(ngram_hashes(w, k)[ok] + np.uint64(k)) if len(ok) else np.zeros(0, np.uint64))
    return woff, starts, hashes


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _requests(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        woff, _, hashes = _grams(table, order)
        block = table.column("block")[0].as_py()
        gram, count = np.unique(np.concatenate(hashes), return_counts=True)
        cut = np.searchsorted(_bucket(gram, buckets), np.arange(buckets + 1))
        rows = [(-1, _planes(np.array([woff[-1]], np.uint64)), b"")]
        rows += [(b, _pack(gram[i:j]), _planes(count[i:j].astype(np.uint64))) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]
        bucket, grams, counts = zip(*rows, strict=True)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _answers(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block")
    if bucket < 0:  # the corpus size, told to every block
        total = sum(int(_unplanes(b.as_py())[0]) for b in table.column("grams"))
        answers = [_planes(np.array([total], np.uint64))] * len(blocks)
    else:
        grams = [_unpack(b.as_py()) for b in table.column("grams")]
        counts = np.concatenate([_unplanes(b.as_py()) for b in table.column("counts")])
        _, where = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(where, counts).astype(np.uint64)[where]  # exact below 2^53
        ends = np.cumsum([len(g) for g in grams])
        answers = [_planes(x) for x in np.split(total, ends[:-1])]
    return pa.table({"bucket": pa.array([bucket] * len(blocks), pa.int64()), "block": blocks.combine_chunks() if isinstance(blocks, pa.ChunkedArray) else blocks, "answer": pa.array(answers, pa.binary())})


def _scores(order: int, backoff: float):
    empty = {"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())}

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table(empty)
        woff, starts, hashes = _grams(docs, order)
        rank = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        told = [_unplanes(answers.column("answer")[int(i)].as_py()) for i in rank]
        size = float(told[0][0])
        total = np.concatenate(told[1:]) if len(told) > 1 else np.zeros(0, np.uint64)
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        row, n = row_of_words(woff), int(woff[-1])
        rest, cut = [], 0
        for s in starts:  # by order: the count outside the document, at each start
            mine = where[cut : cut + len(s)]
            cut += len(s)
            _, again, own = np.unique(row[s] * (len(total) + 1) + mine, return_inverse=True, return_counts=True)
            c = np.zeros(n)
            c[s] = total[mine].astype(float) - own[again]
            rest.append(c)
        outside = np.maximum(size - np.diff(woff), 1.0)[row] if n else np.zeros(0)
        value = np.maximum(rest[0], 0.5) / outside if n else np.zeros(0)
        place = np.arange(n) - woff[row] if n else np.zeros(0, np.int64)
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 1)  # the last word of a k-gram
            whole, context = rest[k - 1][at - k + 1], rest[k - 2][at - k + 1]
            seen = whole > 0
            lower = backoff * value[at]
            value[at] = np.where(seen, whole / np.maximum(context, 1.0), lower)
        logs = np.concatenate([[0.0], np.cumsum(np.log(value))])
        ids = docs.column("doc_id")
        return pa.table({"doc_id": ids, "n_words": pa.array(np.diff(woff).astype(np.int64)), "log_score": pa.array(logs[woff[1:]] - logs[woff[:-1]])})

    return run


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words and log_score (sum of the words' natural log scores) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(partitions(spark), -(-size // BLOCK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    named = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).mapInArrow(_pack_texts, "doc_id long, packed binary, block long")
    asked = named.groupBy("block").applyInArrow(_requests(order, buckets), "bucket long, block long, grams binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(_answers, "bucket long, block long, answer binary")
    return named.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_scores(order, backoff), "doc_id long, n_words long, log_score double")
