"""Templates: a validated entity becomes rows of accounts, storage and codes, all lazy.

Each template is a function (spark, entity, seed) -> Expansion; the registry maps
names to (function, honoured fields, parameter names).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateloom.functions.hashing import be8, keccak, pad32
from stateloom.plans import generators as g
from stateloom.plans.code_patterns import CodePattern, pattern_of
from stateloom.sources.spec import Entity, SpecError, hex_bytes, quoted_u256

#: Fixed value: the default deterministic-deployment factory.
FACTORY = bytes.fromhex("4e59b44847b379578588920ca78fbf26c0b4956c")
ACCOUNTS = "address binary, nonce bigint, balance binary, code binary"
STORAGE = "address binary, slot_key binary, slot_value binary"
ONE, ZERO = (1).to_bytes(32, "big"), bytes(32)


@dataclass
class Expansion:
    accounts: DataFrame
    storage: DataFrame | None = None


def _account(spark: SparkSession, e: Entity, nonce: int | None = None, balance: bytes | None = None, code: bytes = b"") -> DataFrame:
    return spark.createDataFrame([(e.address, e.nonce if nonce is None else nonce, balance or e.balance or ZERO, code or None)], ACCOUNTS)


def _constant(addresses: DataFrame, nonce: int, balance: bytes, code: bytes | None = None) -> DataFrame:
    bin_ = lambda b: F.unhex(F.lit(b.hex()))
    return addresses.select("address", F.lit(nonce).cast("bigint").alias("nonce"), bin_(balance).alias("balance"), (bin_(code) if code else F.lit(None).cast("binary")).alias("code"))


def _sized(spark: SparkSession, e: Entity, seed: int, domain: str) -> DataFrame:
    return g.synthesized_slots(spark.createDataFrame([(e.address, e.approximate_size_bytes)], "address binary, size bigint"), seed, domain)


def eoa(spark, e: Entity, seed: int) -> Expansion:
    return Expansion(_account(spark, e, code=e.code), _sized(spark, e, seed, "eoa"))


def raw(spark, e: Entity, seed: int) -> Expansion:
    return Expansion(_account(spark, e, nonce=max(e.nonce, 1), code=e.code), _sized(spark, e, seed, "raw"))


def _short_string(text: str) -> bytes:
    if len(text.encode()) > 31:
        raise SpecError(f"{text!r} is longer than 31 bytes")
    return text.encode().ljust(31, b"\0") + bytes([2 * len(text.encode())])


def erc20(spark, e: Entity, seed: int) -> Expansion:
    """Explicit owners over derived holders; name, symbol and total supply in their slots."""
    p = e.parameters
    explicit = [(keccak(hex_bytes(o["address"], 20).rjust(32, b"\0") + ZERO), quoted_u256(o["balance"])) for o in p.get("owners", [])]
    total = p.get("total_owners", 0) or max(len(explicit), e.approximate_size_bytes // 140 - 3 if not p.get("total_allowances") else 0)
    if p.get("total_owners") and len(explicit) > total:
        raise SpecError("more owners than total_owners")
    slot = lambda i: i.to_bytes(32, "big")
    own = spark.createDataFrame([(e.address, k, v) for k, v in explicit] + [(e.address, slot(3), _short_string(p.get("name", ""))), (e.address, slot(4), _short_string(p.get("symbol", "")))], STORAGE)
    if total > len(explicit):
        drawn = g.erc20_storage(spark.createDataFrame([(e.address, total - len(explicit))], "address binary, owners bigint"), seed)
        balances = drawn.filter(F.col("slot_key") != F.unhex(F.lit(slot(2).hex()))).unionByName(own.filter(F.col("slot_key").isin([bytearray(k) for k, _ in explicit])))
        own = own.unionByName(drawn.filter(F.col("slot_key") != F.unhex(F.lit(slot(2).hex()))))
    else:
        balances = own.filter(F.col("slot_key").isin([bytearray(k) for k, _ in explicit])) if explicit else own.limit(0)
    given = [(keccak(hex_bytes(a["spender"], 20).rjust(32, b"\0") + keccak(hex_bytes(a["owner"], 20).rjust(32, b"\0") + slot(1))), quoted_u256(a["allowance"])) for a in p.get("allowances", [])]
    if p.get("total_allowances") and len(given) > p["total_allowances"]:
        raise SpecError("more allowances than total_allowances")
    if given:
        own = own.unionByName(spark.createDataFrame([(e.address, k, v) for k, v in given], STORAGE))
    if (more := p.get("total_allowances", 0) - len(given)) > 0:
        own = own.unionByName(g.erc20_allowances(spark.createDataFrame([(e.address, more)], "address binary, allowances bigint"), seed))
    from stateloom.functions.u256 import sum_u256

    supply = sum_u256(balances, ["address"], "slot_value", "slot_value").select("address", F.unhex(F.lit(slot(2).hex())).alias("slot_key"), "slot_value")
    return Expansion(_account(spark, e, nonce=max(e.nonce, 1)), own.unionByName(supply))


def sequential_eoas(spark, e: Entity, seed: int) -> Expansion:
    p = e.parameters
    return Expansion(_constant(g.sequential_addresses(spark, e.address, _count(p)), 0, quoted_u256(p["balance"]) if "balance" in p else ONE))


def _count(p: dict, name: str = "count") -> int:
    n = int(p.get(name, 0))
    if not 1 <= n <= 1 << 32:
        raise SpecError(f"{name} must be in 1..2^32")
    return n


def sequential_pkey_eoas(spark, e: Entity, seed: int) -> Expansion:
    p = e.parameters
    return Expansion(_constant(g.key_addresses(spark, int(p["start_pkey"], 0), _count(p)), 0, quoted_u256(p["balance"]) if "balance" in p else ONE))


def _pattern(p: dict, *owned: str) -> CodePattern | None:
    try:
        return pattern_of(p, *owned)
    except ValueError as e:
        raise SpecError(str(e)) from e


def _init_code(p: dict, pattern: CodePattern | None) -> bytes:
    return pattern.init_code() if pattern else hex_bytes(p["initcode"])


def sequential_pkey_delegations(spark, e: Entity, seed: int) -> Expansion:
    """Key i delegates to the contract of salt start + i: two generators joined by index."""
    p = e.parameters
    n, first = _count(p), int(p.get("salt_start", 0))
    keys = g.key_addresses(spark, int(p["start_pkey"], 0), n)
    targets = g.create2_addresses(spark, hex_bytes(p["factory"], 20) if "factory" in p else FACTORY, _init_code(p, _pattern(p, "initcode")), first, n).select((F.col("salt") - first).alias("i"), F.col("address").alias("target"))
    rows = keys.join(targets, "i")
    balance = quoted_u256(p["balance"]) if "balance" in p else ONE
    return Expansion(rows.select("address", F.lit(1).cast("bigint").alias("nonce"), F.unhex(F.lit(balance.hex())).alias("balance"), F.concat(F.unhex(F.lit("ef0100")), "target").alias("code")))


def storage_pattern(spark, e: Entity, seed: int) -> Expansion:
    rows = g.storage_pattern(spark, int(e.parameters["final"]))
    fixed = rows.select(F.unhex(F.lit(e.address.hex())).alias("address"), pad32(be8(F.col("slot"))).alias("slot_key"), pad32(be8(F.col("value"))).alias("slot_value"))
    return Expansion(_account(spark, e, nonce=max(e.nonce, 1)), fixed)


def create2_factory(spark, e: Entity, seed: int) -> Expansion:
    code = bytes.fromhex("7fffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffe03601600081602082378035828234f58015156039578182fd5b8082525050506014600cf3")
    return Expansion(_account(spark, e, nonce=1, code=code))


def _deployed(addresses: DataFrame, p: dict, pattern: CodePattern | None) -> Expansion:
    accounts = _constant(addresses, 1, ZERO, b"" if pattern else hex_bytes(p["runtime"]))
    if pattern:
        accounts = accounts.withColumn("code", pattern.column(F.col("address")))
    slots = {hex_bytes(k if len(k) % 2 == 0 else "0x0" + k[2:]).rjust(32, b"\0"): hex_bytes(v if len(v) % 2 == 0 else "0x0" + v[2:]).rjust(32, b"\0") for k, v in p.get("storage_init", {}).items()}
    if len(slots) < len(p.get("storage_init", {})):
        raise SpecError("storage_init names a slot twice")
    if not slots:
        return Expansion(accounts)
    pairs = F.array(*[F.struct(F.unhex(F.lit(k.hex())).alias("k"), F.unhex(F.lit(v.hex())).alias("v")) for k, v in slots.items()])
    return Expansion(accounts, addresses.select("address", F.explode(pairs).alias("s")).select("address", F.col("s.k").alias("slot_key"), F.col("s.v").alias("slot_value")))


def create2_deploys(spark, e: Entity, seed: int) -> Expansion:
    p = e.parameters
    pattern = _pattern(p, "initcode", "runtime")
    return _deployed(g.create2_addresses(spark, hex_bytes(p["factory"], 20) if "factory" in p else FACTORY, _init_code(p, pattern), int(p.get("salt_start", 0)), _count(p, "salt_count")).select("address"), p, pattern)


def create_preimage_deploys(spark, e: Entity, seed: int) -> Expansion:
    p = e.parameters
    return _deployed(g.create_addresses(spark, hex_bytes(p["sender"], 20), int(p.get("start_nonce", 0)), _count(p)).select("address"), p, _pattern(p, "runtime"))


_ALL = {"balance", "nonce", "code", "approximate_size_bytes"}
REGISTRY: dict[str, tuple[Callable[..., Expansion], set[str], set[str]]] = {
    "eoa": (eoa, _ALL, set()),
    "raw": (raw, _ALL, set()),
    "erc20": (erc20, {"balance", "nonce", "approximate_size_bytes"}, {"symbol", "name", "decimals", "owners", "allowances", "total_owners", "total_allowances"}),
    "sequential_eoas": (sequential_eoas, set(), {"count", "balance"}),
    "sequential_pkey_eoas": (sequential_pkey_eoas, set(), {"start_pkey", "count", "balance"}),
    "sequential_pkey_delegations": (sequential_pkey_delegations, set(), {"start_pkey", "count", "balance", "code_pattern", "initcode", "factory", "salt_start", "code_size"}),
    "storage_pattern": (storage_pattern, {"balance", "nonce"}, {"final"}),
    "create2_factory": (create2_factory, set(), set()),
    "create2_deploys": (create2_deploys, set(), {"initcode", "runtime", "salt_start", "salt_count", "factory", "storage_init", "code_pattern", "code_size"}),
    "create_preimage_deploys": (create_preimage_deploys, set(), {"sender", "start_nonce", "count", "runtime", "storage_init", "code_pattern", "code_size"}),
}


def template_of(e: Entity) -> str:
    return "eoa" if e.kind == "eoa" else e.template or "raw"


def check(e: Entity) -> None:
    """Set fields that the template ignores, and unknown parameters, are errors."""
    name = template_of(e)
    _, honoured, parameters = REGISTRY[name]
    given = {"balance": e.balance is not None, "nonce": e.nonce != 0, "code": bool(e.code), "approximate_size_bytes": e.approximate_size_bytes != 0}
    for f, is_set in given.items():
        if is_set and f not in honoured:
            hint = f"; use parameters.{f}" if f in parameters else ""
            raise SpecError(f"{name}: {f} is ignored by this template{hint}")
    if unknown := set(e.parameters) - parameters:
        raise SpecError(f"{name}: unknown parameters {sorted(unknown)}")


def expand(spark: SparkSession, entities: list[Entity], seed: int) -> dict[str, DataFrame]:
    """accounts and storage of resolved entities; the default factory must be declared where it is used."""
    uses = any(e.template == "create2_deploys" and hex_bytes(e.parameters.get("factory", "0x" + FACTORY.hex())) == FACTORY for e in entities)
    fixed = [Entity(**{**e.__dict__, "address": FACTORY}) if e.template == "create2_factory" and not e.name and e.address == keccak(seed.to_bytes(8, "big") + f"anon-{e.ordinal}".encode())[12:] else e for e in entities]
    if uses and not any(e.template == "create2_factory" and e.address == FACTORY for e in fixed):
        raise SpecError("create2_deploys uses the default factory, but no create2_factory entity provides it")
    parts = []
    for e in fixed:
        check(e)
        parts.append(REGISTRY[template_of(e)][0](spark, e, seed))
    accounts = reduce(DataFrame.unionByName, [x.accounts for x in parts])
    storages = [x.storage for x in parts if x.storage is not None]
    storage = reduce(DataFrame.unionByName, storages) if storages else spark.createDataFrame([], STORAGE)
    return {"accounts": accounts, "storage": storage}


def collisions(accounts: DataFrame) -> DataFrame:
    """Addresses that more than one entity made."""
    return accounts.groupBy("address").count().filter("count > 1")
