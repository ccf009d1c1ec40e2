"""Unsigned 256-bit integers as 32 big-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limb(value: str, i: int) -> Column:
    """The i-th of eight 32-bit limbs, most significant first."""
    return F.conv(F.hex(F.substring(value, 4 * i + 1, 4)), 16, 10).cast("bigint")


def sum_u256(df: DataFrame, key: list[str], value: str, out: str = "total") -> DataFrame:
    """Sums modulo 2^256: limbs are summed as integers (partial sums map-side), carries move once at the end.

    A group may hold 2^31 rows; null values count as zero.
    """
    sums = df.groupBy(*key).agg(*[F.coalesce(F.sum(limb(value, i)), F.lit(0)).alias(f"_l{i}") for i in range(8)])
    carry, parts = F.lit(0).cast("bigint"), []
    for i in range(7, -1, -1):
        whole = F.col(f"_l{i}") + carry
        parts.insert(0, F.lpad(F.hex(whole.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
        carry = F.shiftrightunsigned(whole, 32)
    return sums.select(*key, F.unhex(F.concat(*parts)).alias(out))


def u256(text: str) -> bytes:
    """A quoted decimal or 0x number; out of range is an error."""
    n = int(text, 16) if text.lower().startswith("0x") else int(text)
    if not 0 <= n < 1 << 256:
        raise ValueError(f"{text} is no unsigned 256-bit integer")
    return n.to_bytes(32, "big")
