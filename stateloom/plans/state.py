"""From account and storage tables to the state root, and the key-value projections of the layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateloom.functions.codecs import account_rlp
from stateloom.functions.hashing import keccak, keccak256
from stateloom.operators.merkle import EMPTY_ROOT, mpt_roots, storage_leaves

EMPTY_CODE = keccak(b"")


@F.arrow_udf(T.BinaryType())
def account_value(nonce: pa.Array, balance: pa.Array, root: pa.Array, code_hash: pa.Array) -> pa.Array:
    rows = zip(nonce.to_pylist(), balance.to_pylist(), root.to_pylist(), code_hash.to_pylist(), strict=True)
    return pa.array([account_rlp(int(n or 0), int.from_bytes(b or b"", "big"), r, c) for n, b, r, c in rows], pa.binary())


def with_roots(accounts: DataFrame, storage: DataFrame, prefix: int = 1) -> DataFrame:
    """accounts (address, nonce, balance, code) with addr_hash, code_hash and storage_root: storage folded by account, then a left join."""
    roots = mpt_roots(storage_leaves(storage.withColumnRenamed("address", "trie_id")), prefix).select(F.col("trie_id").alias("address"), F.col("root").alias("storage_root"))
    empty = lambda b: F.unhex(F.lit(b.hex()))
    code_hash = F.when(F.coalesce(F.octet_length("code"), F.lit(0)) == 0, empty(EMPTY_CODE)).otherwise(keccak256(F.coalesce("code", F.lit(b""))))
    return accounts.join(roots, "address", "left").withColumn("storage_root", F.coalesce("storage_root", empty(EMPTY_ROOT))).withColumn("addr_hash", keccak256("address")).withColumn("code_hash", code_hash)


def account_leaves(rooted: DataFrame) -> DataFrame:
    return rooted.select(F.lit("state").alias("trie_id"), F.col("addr_hash").alias("key_hash"), account_value("nonce", "balance", "storage_root", "code_hash").alias("value"))


def state_root(accounts: DataFrame, storage: DataFrame, prefix: int = 1) -> DataFrame:
    """One row: root and n_leaves of the account trie; no account gives no row (the empty root)."""
    return mpt_roots(account_leaves(with_roots(accounts, storage, prefix)), prefix).select("root", "n_leaves")


def layouts(rooted: DataFrame, storage: DataFrame, codes: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """The key-value tables of each physical layout: the same logical tables under different keys."""
    h, s = F.col("addr_hash"), keccak256("slot_key")
    live = storage.withColumn("v", F.expr("cast(trim(LEADING x'00' FROM slot_value) as binary)")).filter(F.octet_length("v") > 0).withColumn("addr_hash", keccak256("address")).withColumn("slot_hash", s)
    value = account_value("nonce", "balance", "storage_root", "code_hash")
    kv = lambda df, k, v: df.select(k.alias("k"), v.alias("v"))
    tag = lambda c: F.unhex(F.lit(c.encode().hex()))
    sh, v, code = F.col("slot_hash"), F.col("v"), kv(codes, F.col("code_hash"), F.col("code"))
    plain = {"accounts": kv(rooted, h, value), "storage": kv(live, F.concat(h, sh), v), "code": code}
    return {
        "snapshot": {"accounts": kv(rooted, F.concat(tag("a"), h), value), "storage": kv(live, F.concat(tag("o"), h, sh), v), "code": kv(codes, F.concat(tag("c"), F.col("code_hash")), F.col("code"))},
        "bonsai": plain,
        "hashed": plain,
        "flat": {"accounts": kv(rooted, F.substring(h, 1, 20), value), "storage": kv(live, F.concat(F.substring(h, 1, 4), sh, F.substring(h, 5, 16)), v), "code": code},
        "domains": {"accounts": kv(rooted, F.col("address"), value), "storage": kv(live, F.concat(F.col("address"), F.col("slot_key")), v), "code": code},
    }


def write_layout(tables: dict[str, DataFrame], folder: str, partitions: int | None = None) -> None:
    """Each table as Parquet in key order: ranges of keys by file, so readers skip by minimum and maximum."""
    for name, df in tables.items():
        ranged = df.repartitionByRange(partitions, "k") if partitions else df.repartitionByRange("k")
        ranged.sortWithinPartitions("k").write.mode("errorifexists").parquet(f"{folder}/{name}")
