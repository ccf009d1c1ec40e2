"""Keccak-256 (original padding) over whole Arrow batches, and content-addressing helpers.

SHA-256 is Spark's own ``sha2``; Keccak has no Spark function, so it is an Arrow
UDF whose permutation runs on all rows of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RATE = 136


def _round_constants() -> list[int]:
    """From the degree-8 linear feedback register of the specification."""
    out, state = [], 1
    for _ in range(24):
        word = 0
        for j in range(7):
            if state & 1:
                word |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(word)
    return out


def _offsets() -> dict[tuple[int, int], int]:
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_RC, _ROT = [np.uint64(c) for c in _round_constants()], _offsets()


def _rol(a: np.ndarray, n: int) -> np.ndarray:
    return a if n == 0 else (a << np.uint64(n)) | (a >> np.uint64(64 - n))


def _permute(a: list[np.ndarray]) -> list[np.ndarray]:
    """Lanes by x + 5 y; each is an array over the messages."""
    for rc in _RC:
        c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        d = [c[x - 1] ^ _rol(c[(x + 1) % 5], 1) for x in range(5)]
        b: list = [None] * 25
        for x in range(5):
            for y in range(5):
                b[y + 5 * ((2 * x + 3 * y) % 5)] = _rol(a[x + 5 * y] ^ d[x], _ROT[x, y])
        a = [b[i] ^ (~b[i // 5 * 5 + (i + 1) % 5] & b[i // 5 * 5 + (i + 2) % 5]) for i in range(25)]
        a[0] = a[0] ^ rc
    return a


def keccak_many(messages: list[bytes]) -> list[bytes]:
    """Keccak-256 of every message; messages of equally many blocks are absorbed together."""
    out: list[bytes] = [b""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        by_blocks.setdefault(len(m) // _RATE + 1, []).append(i)
    for blocks, at in by_blocks.items():
        size = blocks * _RATE
        padded = bytearray(size * len(at))
        for n, i in enumerate(at):
            m = messages[i]
            padded[n * size : n * size + len(m)] = m
            padded[n * size + len(m)] ^= 0x01
            padded[(n + 1) * size - 1] ^= 0x80
        words = np.frombuffer(bytes(padded), "<u8").reshape(len(at), blocks, _RATE // 8)
        lanes = [np.zeros(len(at), np.uint64) for _ in range(25)]
        for b in range(blocks):
            for j in range(_RATE // 8):
                lanes[j] = lanes[j] ^ words[:, b, j]
            lanes = _permute(lanes)
        digest = np.stack(lanes[:4], 1).astype("<u8").tobytes()
        for n, i in enumerate(at):
            out[i] = digest[32 * n : 32 * n + 32]
    return out


def keccak(message: bytes) -> bytes:
    return keccak_many([message])[0]


@F.arrow_udf(T.BinaryType())
def keccak256(col: pa.Array) -> pa.Array:
    """Keccak-256 of a binary column; null stays null."""
    values = col.to_pylist()
    some = [v for v in values if v is not None]
    digests = iter(keccak_many(some))
    return pa.array([None if v is None else next(digests) for v in values], pa.binary())


def be8(n: Column) -> Column:
    """An integer as 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def sha256(b: Column) -> Column:
    return F.unhex(F.sha2(b, 256))


def pad32(b: Column) -> Column:
    """Left-padded with zero bytes to 32."""
    return F.unhex(F.lpad(F.hex(b), 64, "0"))


def derived_address(digest: Column) -> Column:
    """The last 20 of 32 bytes."""
    return F.substring(digest, 13, 20)
