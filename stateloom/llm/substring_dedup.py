"""Substring dedup by level-wise doubling.

The first level looks at windows of a quarter of the length: of the short windows
inside each full window the one with the smallest hash stands for it, so equal
full windows have equal stand-ins and only about one short window in eight is
shuffled.  Those seen twice alone are extended to twice the length, and so on
until no candidates survive or the full length is reached, where the earliest
document of every window is found.  Further doubling cannot change which words
lie in a repeated full window.

A word goes if it lies in a window whose words also start earlier: in a
document of smaller id, or in the same document.  Windows are compared by
64-bit hashes of the last stand-in and the full window (96 bits together).

Defined cases: null or empty text has no words; texts shorter than a window
stay; rows are known by id and text, so ids may repeat with different texts and
be null; a null id sorts after all others; rows with equal ids (or without one)
are not "earlier" than each other, and windows repeated inside a row go; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateloom.llm._text import inside, mix, ngram_hashes, partitions, row_of_words, signed, slices, small_batches, text_buffers, word_hashes

_LAST = 2**63 - 1
#: Text whose windows are compared before anything is shuffled: hot passages leave a task once, not once a document.
LOCAL_BYTES = 8 << 20


def _sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """min(h[i:i+k]) for every i, by doubling."""
    size, out = 1, h
    while size * 2 <= k:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return out if size == k else np.minimum(out[: len(h) - k + 1], out[k - size : k - size + len(h) - k + 1])


def _levels(body: np.ndarray, off: np.ndarray, length: int, *sizes: int):
    """(row, start in row, stand-ins by size, full window) of every window, in order."""
    w, woff = word_hashes(body, off)
    if len(w) < length:
        return (np.zeros(0, np.int64),) * 2 + ([np.zeros(0, np.uint64)] * len(sizes), np.zeros(0, np.uint64))
    full = ngram_hashes(w, length)
    ok = inside(woff, length, len(w))
    row = row_of_words(woff)[: len(full)][ok]
    at = np.flatnonzero(ok) - woff[row]
    return row, at, [_sliding_min(ngram_hashes(w, size), length - size + 1)[: len(full)][ok] for size in sizes], full[ok]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all keys stay equal (the last key: grows by one)."""
    *same, step = keys
    change = np.zeros(len(step), bool)
    change[:1] = True
    for k in same:
        change[1:] |= k[1:] != k[:-1]
    change[1:] |= step[1:] != step[:-1] + 1
    return np.flatnonzero(change)


def _survive(batch: pa.RecordBatch, i: int, j: int, row: np.ndarray, stand: np.ndarray) -> np.ndarray:
    """Which windows of rows i to j have a stand-in that survived the level before."""
    mine = _column(batch, "stands").slice(i, j - i)
    flat = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    whose = np.repeat(np.arange(j - i), mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.uint64)
    return _in_sorted(mix(stand + row.astype(np.uint64)), np.sort(mix(flat + whose)))


def _stand_ins(length: int, size: int, before: int | None):
    """Distinct stand-ins of ``size`` of each row, of the windows that survived the level ``before``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = text_buffers(_column(batch, "text"))
            ids, hashes = _ids(batch, "_doc"), _ids(batch, "_h")
            for i, j in slices(off):
                row, _, stands, _ = _levels(body[off[i] : off[j]], off[i : j + 1] - off[i], length, size, *([before] if before else []))
                stand = stands[0]
                if before and len(row):
                    ok = _survive(batch, i, j, row, stands[1])
                    row, stand = row[ok], stand[ok]
                if len(row):
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (stand[1:] != stand[:-1])
                    row, stand = row[new], stand[new]
                    order = np.lexsort((stand, row))
                    row, stand = row[order], stand[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (stand[1:] != stand[:-1])
                    yield pa.RecordBatch.from_arrays([signed(stand[new]), pa.array(ids[i:j][row[new]]), pa.array(hashes[i:j][row[new]])], names=["stand", "_doc", "_h"])

    return run


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _full_windows(length: int, size: int):
    """Candidates at full length.  route >= 0 rows carry windows to compare; the others, ranges already known to go."""

    def emit(ids, hashes, row, at, stand, full, gone):
        starts = _runs(row, stand, gone.astype(np.int8), at)
        ends = np.append(starts[1:], len(row))
        first = row[starts]
        local = gone[starts]
        tails = (full & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cut = np.where(local, 0, ends - starts)
        keep = ~gone
        off = np.concatenate([[0], np.cumsum(cut * 4)]).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(tails[keep].tobytes())])
        route = np.where(local, mix(ids[first].astype(np.uint64) + at[starts].astype(np.uint64)), stand[starts])
        return pa.RecordBatch.from_arrays(
            [signed(route), pa.array(local), pa.array(ids[first]), pa.array(hashes[first]), pa.array(at[starts].astype(np.int32)), pa.array((at[starts] + (ends - starts)).astype(np.int32)), packed],
            names=["route", "known", "_doc", "_h", "first", "last", "tails"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = text_buffers(_column(batch, "text"))
            ids, hashes = _ids(batch, "_doc"), _ids(batch, "_h")
            for i, j in slices(off, LOCAL_BYTES):
                row, at, (stand,), full = _levels(body[off[i] : off[j]], off[i : j + 1] - off[i], length, size)
                if not len(row):
                    continue
                ok = _survive(batch, i, j, row, stand)
                row, at, stand, full = row[ok], at[ok], stand[ok], full[ok]
                if not len(row):
                    continue
                doc = ids[i:j][row]
                order = np.lexsort((doc, full))
                new = np.ones(len(order), bool)
                new[1:] = full[order][1:] != full[order][:-1]
                least = doc[order][new][np.cumsum(new) - 1]
                gone = np.zeros(len(order), bool)
                gone[order] = doc[order] > least
                yield emit(ids[i:j], hashes[i:j], row, at, stand, full, gone)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route and document: the ranges of windows that a smaller document has too.

    Between batches only the distinct windows of the route at hand are kept.
    """
    names = ["_doc", "_h", "first", "last"]
    last_key, seen_tail, seen_doc = None, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        known = _column(batch, "known").to_numpy(zero_copy_only=False).astype(bool)
        route, doc, hashes = _ids(batch, "route"), _ids(batch, "_doc"), _ids(batch, "_h")
        first, last = _ids(batch, "first"), _ids(batch, "last")
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(hashes[known]), pa.array(first[known].astype(np.int32)), pa.array(last[known].astype(np.int32))], names=names)
        if known.all():
            continue
        open_ = np.flatnonzero(~known)
        data, off = text_buffers(_column(batch, "tails"))
        tails = data.view(np.uint32)  # known rows have none
        lens = (last - first)[open_]
        rec = np.repeat(open_, lens)
        pos = first[rec] + np.arange(len(rec)) - np.repeat(np.cumsum(lens) - lens, lens)
        key, who = route[rec], doc[rec]
        if last_key is not None and key[0] == last_key:
            key = np.concatenate([np.full(len(seen_tail), last_key), key])
            tails, who = np.concatenate([seen_tail, tails]), np.concatenate([seen_doc, who])
        extra = len(key) - len(rec)
        order = np.lexsort((who, tails, key))
        k, t, d = key[order], tails[order], who[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        least = d[new][np.cumsum(new) - 1]
        gone = np.zeros(len(order), bool)
        gone[order] = d > least
        gone = gone[extra:]
        tip = new & (k == key[-1])
        last_key, seen_tail, seen_doc = key[-1], t[tip], d[tip]
        if gone.any():
            who, mark, pos = doc[rec][gone], hashes[rec][gone], pos[gone]
            starts = _runs(who, mark, pos)
            ends = np.append(starts[1:], len(pos))
            yield pa.RecordBatch.from_arrays([pa.array(who[starts]), pa.array(mark[starts]), pa.array(pos[starts].astype(np.int32)), pa.array((pos[starts] + ends - starts).astype(np.int32))], names=names)


def _removal(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _column(batch, "text")
            body, off = text_buffers(texts)
            first, last = _column(batch, "firsts"), _column(batch, "lasts")
            a = first.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            z = last.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            roff = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array(first.value_lengths().to_numpy(zero_copy_only=False), float)))]).astype(np.int64)
            n_words, n_gone, kept = [], [], []
            for i, j in slices(off):
                part, poff = body[off[i] : off[j]], off[i : j + 1] - off[i]
                w, woff = word_hashes(part, poff)
                depth = np.zeros(len(w) + 1, np.int32)
                full = ngram_hashes(w, length)
                if len(full):
                    ok = np.flatnonzero(inside(woff, length, len(w)))
                    row = row_of_words(woff)[ok].astype(np.uint64)
                    _, at = np.unique(mix(full[ok] + row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                    again = np.ones(len(ok), bool)
                    again[at] = False
                    np.add.at(depth, ok[again], 1)
                    np.add.at(depth, ok[again] + length, -1)
                rows = np.repeat(np.arange(j - i), np.diff(roff[i : j + 1]))
                np.add.at(depth, woff[rows] + a[roff[i] : roff[j]], 1)
                np.add.at(depth, woff[rows] + z[roff[i] : roff[j]] + length - 1, -1)
                stay = np.cumsum(depth[:-1]) == 0
                for r in range(j - i):
                    mask = stay[woff[r] : woff[r + 1]]
                    words = part[poff[r] : poff[r + 1]].tobytes().split()
                    n_words.append(len(words))
                    n_gone.append(int(len(mask) - mask.sum()))
                    kept.append(b" ".join(words if n_gone[-1] == 0 else compress(words, mask.tolist())))
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "_doc"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["_doc", "n_words", "n_removed", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the kept words joined by one space) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    key = ["_doc", "_h"]
    # All joins take the same three columns, so that one exchange of the texts serves them.
    base = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_h"), "text")
    rows, before = base, None
    for size in sorted({max(1, length // 4), max(1, length // 2)}):
        stands = rows.mapInArrow(_stand_ins(length, size, before), "stand long, _doc long, _h long")
        again = stands.groupBy("stand").agg(F.count("*").alias("n")).filter("n > 1").select("stand")
        mine = stands.join(again, "stand", "left_semi").groupBy(*key).agg(F.collect_set("stand").alias("stands"))
        rows, before = base.join(mine, key).select(*key, "text", "stands"), size
    full = rows.mapInArrow(_full_windows(length, before), "route long, known boolean, _doc long, _h long, first int, last int, tails binary")
    ranges = full.repartition(partitions(spark), "route").sortWithinPartitions("route", "_doc").mapInArrow(_compare, "_doc long, _h long, first int, last int")
    gone = ranges.groupBy(*key).agg(F.collect_set(F.struct("first", "last")).alias("r")).select(*key, F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts"))
    out = base.join(gone, key, "left").select("_doc", "text", "firsts", "lasts").mapInArrow(_removal(length), "_doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("_doc") != _LAST, F.col("_doc")).alias("doc_id"), "n_words", "n_removed", "kept")
