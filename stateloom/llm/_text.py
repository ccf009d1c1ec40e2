"""Shared vectorised text primitives and the shared-folder helper.

A word is a maximal run of bytes other than U+0020 and U+0009..U+000D.  Word
and n-gram hashes are 64-bit, computed for a whole Arrow buffer at once with
numpy; nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside one Python worker (a single longer text is handled alone).
SLICE_BYTES = 1 << 20
#: Text handed to a Python worker at once (a single longer text comes alone).
BATCH_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_CODE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) < n:
        size = max(n, 1 << 16)
        step = np.full(size, _BASE if kind == "up" else _BASE_INV, np.uint64)
        step[0] = 1
        _POW[kind] = np.cumprod(step)
    return _POW[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n+1) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts sum to at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by row) for the rows delimited by ``off``."""
    solid = ~_SPACE[body]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    real = off[:-1][off[:-1] < off[1:]]
    first[real] = solid[real]
    stop = off[1:][off[:-1] < off[1:]] - 1
    last[stop] = solid[stop]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(body: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, word offsets by row); ``lower`` folds A-Z."""
    if lower:
        body = _LOWER[body]
    s, e, woff = word_spans(body, off)
    if not len(s):
        return np.zeros(0, np.uint64), woff
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[body] * _powers("up", len(body)), out=total[1:])
    h = (total[e] - total[s]) * _powers("down", len(body) + 1)[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), woff


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xA0761D6478BD642F) + (b ^ np.uint64(0xE7037ED1A0B428DB)))


def ngram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of w[i:i+k] for every i (rows are not regarded), by doubling."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    if k == 1:
        return w
    half = k // 2
    left, right = ngram_hashes(w, half), ngram_hashes(w, k - half)
    n = len(w) - k + 1
    return pair_hash(left[:n], right[half : half + n])


def inside(woff: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which starts 0..total-k of k-word windows stay inside their row."""
    row = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    return row[: total - k + 1] == row[k - 1 : total] if total >= k else np.zeros(0, bool)


def row_of_words(woff: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches by bytes (a setting of the session: lowered only, and stated in the README), whatever the length of the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > most or now <= 0:
        spark.conf.set(key, str(most))


def release() -> None:
    """Hands memory that this process has freed back to the system (Arrow's pool and, where there is one, malloc's)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that releases memory when its task ends: Python workers stay for the tasks and stages that follow."""

    @wraps(run)
    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return ended


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session; a temporary one only where that is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="llm-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there and any executor can read it.

    The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
