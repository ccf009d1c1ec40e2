"""Genesis documents: the allocation as accounts, storage and code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ALLOC = "alloc map<string, struct<balance:string, nonce:string, code:string, storage:map<string,string>>>"


def _bytes(c: Column, width: int | None = None) -> Column:
    """Hex with or without 0x, or a decimal number, as bytes."""
    digits = F.regexp_replace(c, "^0x", "")
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.unhex(F.lpad(even, 2 * width, "0") if width else even)


def _number(c: Column) -> Column:
    """A number of at most 38 digits, 0x or decimal, as 32 bytes."""
    decimal = F.lpad(F.hex(c.cast("decimal(38,0)").cast("bigint")), 64, "0")
    return F.when(c.startswith("0x"), _bytes(c, 32)).otherwise(F.unhex(decimal))


def read_genesis(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """accounts (address, nonce, balance, code), storage (address, slot_key, slot_value), codes (code)."""
    doc = spark.read.schema(_ALLOC).json(path, multiLine=True, mode="FAILFAST")
    rows = doc.select(F.explode("alloc").alias("a", "e")).select(_bytes(F.col("a"), 20).alias("address"), "e.*")
    nonce = F.coalesce(F.expr("conv(regexp_replace(nonce, '^0x', ''), if(startswith(nonce, '0x'), 16, 10), 10)"), F.lit("0")).cast("bigint")
    accounts = rows.select("address", nonce.alias("nonce"), F.coalesce(_number(F.col("balance")), F.unhex(F.lit("00" * 32))).alias("balance"), F.when(F.length("code") > 2, _bytes(F.col("code"))).alias("code"))
    storage = rows.select("address", F.explode("storage").alias("k", "v")).select("address", _bytes(F.col("k"), 32).alias("slot_key"), _bytes(F.col("v"), 32).alias("slot_value"))
    return {"accounts": accounts, "storage": storage, "codes": accounts.filter("code is not null").select("code").distinct()}
