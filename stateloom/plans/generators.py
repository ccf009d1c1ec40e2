"""Table-valued generators: every row is a pure function of (seed, index), so any partitioning gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stateloom.functions.codecs import push
from stateloom.functions.hashing import be8, derived_address, keccak, keccak256, keccak_many, pad32
from stateloom.operators.session import ensure_checkpoints

SLOT_BYTES, ACCOUNT_BYTES = 140, 175


def _counter(domain: str, seed: int, i: str = "i") -> Column:
    return F.sha2(F.concat_ws("-", F.lit(domain), F.lit(str(seed)), F.col(i).cast("string")), 256)


def _u32(h: Column, at: int = 1) -> Column:
    return F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")


def draw_accounts(index: DataFrame, seed: int) -> DataFrame:
    """i, address, balance_ether and nonce (both below 1000)."""
    return index.select(
        "i",
        F.substring(_counter("eoa", seed), 25, 40).alias("address"),
        F.pmod(_u32(_counter("bal", seed)), F.lit(1000)).alias("balance_ether"),
        F.pmod(_u32(_counter("non", seed)), F.lit(1000)).alias("nonce"),
    )


def redraw(rows: DataFrame, key: str, taken: DataFrame, digits: int = 40, attempt: int = 0) -> DataFrame:
    """key, attempt, address (``digits`` hex digits) of every row: the first draw from ``attempt`` on that ``taken`` (address) lacks.

    Each round joins the rows still colliding alone; it ends when none is left.
    """
    ensure_checkpoints(rows.sparkSession)
    taken, out, left = taken.select("address").distinct(), None, rows.select(key)
    if taken.filter(F.length("address") == digits).count() >= 16**digits:
        raise ValueError(f"all addresses of {digits} digits are taken")
    while out is None or not left.isEmpty():
        h = F.sha2(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(attempt))), 256)
        drawn = left.select(key, F.lit(attempt).cast("bigint").alias("attempt"), F.substring(h, 1, digits).alias("address")).checkpoint()
        free = drawn.join(taken, "address", "left_anti").select(key, "attempt", "address")
        out = free if out is None else out.unionByName(free)
        left, attempt = drawn.join(taken, "address", "left_semi").select(key).checkpoint(), attempt + 1
    return out


def flavor_accounts(index: DataFrame, seed: int, funded: float = 0.90, delegated: float = 0.02, targets: int = 256) -> DataFrame:
    """i, funded, code: Bernoulli draws from one counter hash; delegation code names one of ``targets`` addresses."""
    rows = index.select("i", _counter("fla", seed).alias("h"))
    target = F.substring(F.sha2(F.concat(F.lit("target-"), F.pmod(_u32(F.col("h"), 17), F.lit(targets)).cast("string")), 256), 25, 40)
    share = lambda at: F.pmod(_u32(F.col("h"), at), F.lit(10000))
    return rows.select(
        "i",
        F.when(share(1) < int(funded * 10000), 1).otherwise(0).alias("funded"),
        F.when(share(9) < int(delegated * 10000), F.concat(F.lit("ef0100"), target)).otherwise(F.lit("")).alias("code"),
    )


def storage_pattern(spark: SparkSession, final: int) -> DataFrame:
    """slot, value: slot 0 holds final + 1, slot k holds k."""
    return spark.range(final + 1).select(F.col("id").alias("slot"), F.when(F.col("id") == 0, F.lit(final + 1)).otherwise(F.col("id")).cast("bigint").alias("value"))


def synthesized_slots(entities: DataFrame, seed: int, domain: str) -> DataFrame:
    """address, slot_key, slot_value: floor(size / 140) slots of each (address, size), keyed by Keccak of a counter."""
    n = F.floor(F.col("size") / SLOT_BYTES).cast("bigint")
    rows = entities.filter(F.col("size") >= SLOT_BYTES).select("address", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))
    seeded = F.concat(be8(F.lit(seed)), F.col("address"), F.lit(domain).cast("binary"), be8(F.col("i")))
    return rows.select("address", keccak256(seeded).alias("slot_key"), keccak256(F.concat(seeded, F.unhex(F.lit("76")))).alias("slot_value"))


def erc20_storage(tokens: DataFrame, seed: int) -> DataFrame:
    """address, slot_key, slot_value of tokens (address, owners): balances of derived holders, and their sum in slot 2."""
    from stateloom.functions.u256 import sum_u256

    rows = tokens.select("address", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("owners").cast("bigint") - 1)).alias("i"))
    base = F.concat(be8(F.lit(seed)), F.col("address"))
    rows = rows.select("address", derived_address(keccak256(F.concat(base, be8(F.col("i"))))).alias("holder"), keccak256(F.concat(base, F.lit("BAL").cast("binary"), be8(F.col("i")))).alias("r"))
    amount = F.pmod(F.conv(F.hex(F.substring("r", 25, 8)), 16, 10).cast("decimal(20,0)"), F.lit(10**18).cast("decimal(20,0)")).cast("bigint")
    rows = rows.select("address", keccak256(F.concat(pad32(F.col("holder")), pad32(be8(F.lit(0))))).alias("slot_key"), pad32(be8(F.greatest(amount, F.lit(1)))).alias("slot_value"))
    total = sum_u256(rows, ["address"], "slot_value", "slot_value").select("address", pad32(be8(F.lit(2))).alias("slot_key"), "slot_value")
    return rows.unionByName(total)


def erc20_allowances(tokens: DataFrame, seed: int) -> DataFrame:
    """address, slot_key, slot_value of tokens (address, allowances): a nested mapping, owner then spender, in slot 1."""
    rows = tokens.select("address", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("allowances").cast("bigint") - 1)).alias("i"))
    draw = lambda tag: keccak256(F.concat(be8(F.lit(seed)), F.col("address"), F.lit(tag).cast("binary"), be8(F.col("i"))))
    rows = rows.select("address", derived_address(draw("AOW")).alias("owner"), derived_address(draw("ASP")).alias("spender"), draw("AAM").alias("r"))
    amount = F.pmod(F.conv(F.hex(F.substring("r", 25, 8)), 16, 10).cast("decimal(20,0)"), F.lit(10**18).cast("decimal(20,0)")).cast("bigint")
    rows = rows.select("address", "spender", keccak256(F.concat(pad32(F.col("owner")), pad32(be8(F.lit(1))))).alias("inner"), pad32(be8(F.greatest(amount, F.lit(1)))).alias("slot_value"))
    return rows.select("address", keccak256(F.concat(pad32(F.col("spender")), F.col("inner"))).alias("slot_key"), "slot_value")


def create2_addresses(spark: SparkSession, factory: bytes, init_code: bytes, first: int, count: int) -> DataFrame:
    """salt, address of ``count`` salts: Keccak of ff, factory, salt and the code's hash."""
    code_hash = keccak(init_code)
    rows = spark.range(first, first + count).withColumnRenamed("id", "salt")
    data = F.concat(F.unhex(F.lit("ff" + factory.hex())), pad32(be8(F.col("salt"))), F.unhex(F.lit(code_hash.hex())))
    return rows.select("salt", derived_address(keccak256(data)).alias("address"))


def create_addresses(spark: SparkSession, sender: bytes, first: int, count: int) -> DataFrame:
    """nonce, address of ``count`` nonces of one sender: Keccak of RLP([sender, nonce])."""
    nonce = F.col("nonce")
    digits = F.ltrim(F.hex(nonce), F.lit("0"))
    body = F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))
    encoded = F.when(nonce == 0, F.unhex(F.lit("80"))).when(nonce < 128, body).otherwise(F.concat(F.unhex(F.hex(F.octet_length(body) + 128)), body))
    data = F.concat(F.unhex(F.hex(F.octet_length(encoded) + 21 + 192)), F.unhex(F.lit("94" + sender.hex())), encoded)
    rows = spark.range(first, first + count).withColumnRenamed("id", "nonce")
    return rows.select("nonce", derived_address(keccak256(data)).alias("address"))


def sequential_addresses(spark: SparkSession, base: bytes, count: int) -> DataFrame:
    """i, address: base + i in 160 bits; running over is an error."""
    start = int.from_bytes(base, "big")
    if start + count > 1 << 160:
        raise ValueError("addresses run over 160 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array([(start + i).to_bytes(20, "big") for i in ids.to_pylist()], pa.binary())], names=["i", "address"])

    return spark.range(count).mapInArrow(run, "i long, address binary")


# The curve y^2 = x^3 + 7; fixed values: field prime, order, generator.
_P = 2**256 - 2**32 - 977
_N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
_G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)


def _add(a, b):
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % _P == 0:
            return None
        slope = 3 * a[0] * a[0] * pow(2 * a[1], -1, _P) % _P
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, _P) % _P
    x = (slope * slope - a[0] - b[0]) % _P
    return x, (slope * (a[0] - x) - a[1]) % _P


def _times(k: int):
    out, step = None, _G
    while k:
        if k & 1:
            out = _add(out, step)
        step, k = _add(step, step), k >> 1
    return out


def key_addresses(spark: SparkSession, first: int, count: int) -> DataFrame:
    """i, address of the private keys first + i: one scalar multiplication a batch, then one addition a row."""
    if not (1 <= first and first + count <= _N):
        raise ValueError("private keys out of range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, last, point = [], None, None
            for i in batch.column(0).to_pylist():
                point = _add(point, _G) if last is not None and i == last + 1 else _times(first + i)
                last = i
                points.append(point[0].to_bytes(32, "big") + point[1].to_bytes(32, "big"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[12:] for h in keccak_many(points)], pa.binary())], names=["i", "address"])

    return spark.range(count).mapInArrow(run, "i long, address binary")


def unique_jumpdest_code(address: bytes, size: int) -> bytes:
    """Jump destinations, a leading jump to the last one, the address spliced in."""
    if not 0x61 <= size <= 16 << 20:
        raise ValueError("size out of range")
    code = bytearray(b"\x5b" * size)
    head = push(size - 1) + b"\x56"
    code[: len(head)] = head
    code[0x2C:0x40] = address
    return bytes(code)


def max_same_code(size: int) -> bytes:
    return b"\x00" + b"\x5b" * (size - 1)


def max_diff_code(address: bytes, size: int) -> bytes:
    return bytes(12) + address + b"\x5b" * (size - 32)


def giant_slots(spark: SparkSession, seed: int, giant: int, count: int, length_cdf: list[float]) -> DataFrame:
    """j, slot_key, slot_value: slot j is a counter hash of (seed, giant, j); value lengths by ``length_cdf`` (32 cumulative shares)."""
    draw = lambda what: _counter(f"giant-{what}-{giant}", seed, "id")
    share = _u32(draw("length")) / F.lit(2.0**32)
    over = F.size(F.filter(F.array(*[F.lit(float(c)) for c in length_cdf]), lambda c: c <= share))
    rows = spark.range(count).select(F.col("id").alias("j"), draw("key").alias("k"), draw("value").alias("v"), F.least(over + 1, F.lit(32)).alias("n"))
    return rows.select("j", F.unhex("k").alias("slot_key"), F.unhex(F.lpad(significant(F.col("v"), F.col("n")), 64, "0")).alias("slot_value"))


def significant(h: Column, n: Column) -> Column:
    """Hex of a number of exactly ``n`` bytes (0 to 32, 0 is empty) from the hash ``h``: a leading zero byte becomes 1."""
    lead = F.substring(h, 1, 2)
    lead = F.when(lead == "00", F.lit("01")).otherwise(lead)
    return F.when(n <= 0, F.lit("")).otherwise(F.concat(lead, F.substring(h, F.lit(3), (2 * n - 2).cast("int"))))


def truncated_normal(key: Column, domain: str, mean: float, deviation: float, lo: int, hi: int, attempts: int = 8) -> Column:
    """A whole number of N(mean, deviation) within [lo, hi]: the first of ``attempts`` counter draws that falls inside, else the last one's bound."""
    if lo >= hi:
        return F.lit(lo).cast("bigint")

    def value(i: Column) -> Column:
        h = F.sha2(F.concat_ws("-", F.lit(domain), key.cast("string"), i.cast("string")), 256)
        u, v = (_u32(h) + 1) / F.lit(2.0**32), _u32(h, 9) / F.lit(2.0**32)
        return F.lit(mean) + F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v) * F.lit(deviation)

    values = F.transform(F.sequence(F.lit(1), F.lit(attempts)), value)
    inside = F.filter(values, lambda x: (x >= float(lo)) & (x <= float(hi)))
    bound = F.when(F.element_at(values, -1) < float(lo), F.lit(lo)).otherwise(F.lit(hi))
    return F.coalesce(F.floor(F.get(inside, F.lit(0))), bound).cast("bigint")


def salt(seed: Column) -> Column:
    """The 32-bit FNV-1a hash of a seed's eight big-endian bytes."""
    octets = F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: F.conv(F.substring(F.lpad(F.hex(seed.cast("bigint")), 16, "0"), i, F.lit(2)), 16, 10).cast("bigint"))
    step = lambda a, x: (a.bitwiseXOR(x) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(octets, F.lit(2166136261).cast("bigint"), step)
