"""Declarative state specifications: strict YAML in, validated entities out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import DataFrame, SparkSession

from stateloom.functions.hashing import keccak
from stateloom.functions.u256 import u256

MAX_CODE, LARGE = 24576, 1 << 40
SCHEMA = "ordinal int, kind string, name string, address binary, balance binary, nonce decimal(20,0), code binary, template string, parameters string, approximate_size_bytes decimal(20,0)"
_FIELDS = {"kind", "name", "address", "balance", "nonce", "code", "template", "parameters", "approximate_size_bytes"}


class SpecError(ValueError):
    """A rule is broken; the message names the entity."""


@dataclass(frozen=True)
class Entity:
    ordinal: int
    kind: str
    name: str = ""
    address: bytes | None = None
    balance: bytes | None = None
    nonce: int = 0
    code: bytes = b""
    template: str = ""
    parameters: dict = field(default_factory=dict)
    approximate_size_bytes: int = 0


def hex_bytes(text, size: int | None = None) -> bytes:
    """0x-prefixed hex of whole bytes, ``size`` of them if given."""
    if not isinstance(text, str) or not text.startswith("0x") or len(text) % 2:
        raise SpecError(f"{text!r} is no 0x-prefixed hex string")
    out = bytes.fromhex(text[2:])
    if size is not None and len(out) != size:
        raise SpecError(f"{text!r} has not {size} bytes")
    return out


def quoted_u256(text) -> bytes:
    """Numbers must be quoted: a YAML integer, float or bool is an error."""
    if not isinstance(text, str):
        raise SpecError(f"{text!r} must be a quoted string")
    try:
        return u256(text)
    except ValueError as e:
        raise SpecError(str(e)) from e


def parse(text: str) -> list[Entity]:
    """Entities in order; unknown fields are errors."""
    doc = yaml.safe_load(text) or {}
    if unknown := set(doc) - {"entities"}:
        raise SpecError(f"unknown fields {sorted(unknown)}")
    out = []
    for i, e in enumerate(doc.get("entities") or []):
        if unknown := set(e) - _FIELDS:
            raise SpecError(f"entities[{i}]: unknown fields {sorted(unknown)}")
        out.append(
            Entity(
                i,
                e.get("kind", ""),
                e.get("name") or "",
                hex_bytes(e["address"], 20) if e.get("address") else None,
                quoted_u256(e["balance"]) if e.get("balance") is not None else None,
                int(e.get("nonce") or 0),
                hex_bytes(e["code"]) if e.get("code") else b"",
                e.get("template") or "",
                dict(e.get("parameters") or {}),
                int(e.get("approximate_size_bytes") or 0),
            )
        )
    return out


def validate(entities: list[Entity], known: set[str] | None = None) -> list[str]:
    """Warnings; the first broken rule is raised."""
    if not entities:
        raise SpecError("no entities")
    seen: dict[bytes, int] = {}
    warnings = []
    for e in entities:
        at = f"entities[{e.ordinal}]" + (f" ({e.name})" if e.name else "")
        contract = e.kind == "contract"
        rules = [
            (not e.kind, "kind is missing"),
            (e.kind not in ("contract", "eoa"), f"unknown kind {e.kind!r}"),
            (contract and not e.template and not e.code, "a contract needs template or code"),
            (contract and bool(e.template) and bool(e.code), "template and code exclude each other"),
            (contract and bool(e.template) and known is not None and e.template not in known, f"unknown template {e.template!r}"),
            (bool(e.parameters) and not e.template, "parameters need a template"),
            (e.kind == "eoa" and bool(e.template), "an eoa has no template"),
            (e.address is not None and e.address in seen, f"address repeats that of entities[{seen.get(e.address or b'')}]"),
            (len(e.code) > MAX_CODE, f"code is longer than {MAX_CODE} bytes"),
        ]
        for broken, what in rules:
            if broken:
                raise SpecError(f"{at}: {what}")
        if e.address is not None:
            seen[e.address] = e.ordinal
        if e.approximate_size_bytes > LARGE:
            warnings.append(f"{at}: approximate_size_bytes is above 1 TiB")
    return warnings


def resolve(entities: list[Entity], seed: int) -> list[Entity]:
    """Addresses: explicit, else from the name, else from the ordinal."""
    return [e if e.address is not None else replace(e, address=keccak(seed.to_bytes(8, "big") + (e.name or f"anon-{e.ordinal}").encode())[12:]) for e in entities]


def cost(e: Entity) -> int:
    return 175 + e.approximate_size_bytes // 140 * 140


def truncate(entities: list[Entity], budget: int) -> list[Entity]:
    """The longest prefix within ``budget`` bytes; 0 is no budget."""
    total = 0
    for n, e in enumerate(entities):
        total += cost(e)
        if budget and total > budget:
            return entities[:n]
    return entities


def to_frame(spark: SparkSession, entities: list[Entity]) -> DataFrame:
    from decimal import Decimal

    rows = [(e.ordinal, e.kind, e.name or None, e.address, e.balance, Decimal(e.nonce), e.code or None, e.template or None, json.dumps(e.parameters) if e.parameters else None, Decimal(e.approximate_size_bytes)) for e in entities]
    return spark.createDataFrame(rows, SCHEMA)
