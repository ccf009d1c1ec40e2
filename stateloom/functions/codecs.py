"""Byte codecs of the physical layouts: recursive length prefix, hex prefix, varints, compact integers and row records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(n: int) -> bytes:
    """Big-endian without leading zeros; 0 is empty."""
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def rlp(item) -> bytes:
    """RLP of bytes, integers and nested lists."""
    if isinstance(item, int):
        item = be(item)
    if isinstance(item, (bytes, bytearray)):
        return bytes(item) if len(item) == 1 and item[0] < 0x80 else _header(len(item), 0x80) + bytes(item)
    body = b"".join(rlp(x) for x in item)
    return _header(len(body), 0xC0) + body


def _header(n: int, base: int) -> bytes:
    return bytes([base + n]) if n < 56 else bytes([base + 55 + len(be(n))]) + be(n)


def rlp_list(encoded: list[bytes]) -> bytes:
    """A list of items that are encoded already."""
    body = b"".join(encoded)
    return _header(len(body), 0xC0) + body


def unrlp(data: bytes):
    """Bytes or nested lists; anything else than one whole item is an error."""
    item, rest = _unrlp(data)
    if rest:
        raise ValueError("bytes after the item")
    return item


def _unrlp(data: bytes):
    if not data:
        raise ValueError("no item")
    head, short = data[0], 0x80 if data[0] < 0xC0 else 0xC0
    if head < 0x80:
        return data[:1], data[1:]
    n, at = head - short, 1
    if n > 55:
        at = 1 + n - 55
        n = int.from_bytes(data[1:at], "big")
    body = data[at : at + n]
    if len(body) < n:
        raise ValueError("item cut short")
    if short == 0x80:
        return body, data[at + n :]
    out = []
    while body:
        x, body = _unrlp(body)
        out.append(x)
    return out, data[at + n :]


def hex_prefix(nibbles: str, leaf: bool) -> bytes:
    """Compact path: a hex digit a nibble in, flag nibble and padding out."""
    odd = len(nibbles) % 2
    return bytes.fromhex(f"{2 * leaf + odd:x}" + ("" if odd else "0") + nibbles)


def un_hex_prefix(data: bytes) -> tuple[str, bool]:
    flag = data[0] >> 4
    return data.hex()[1 if flag & 1 else 2 :], bool(flag & 2)


def leb128(n: int) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def un_leb128(data: bytes) -> tuple[int, bytes]:
    n = 0
    for i, b in enumerate(data):
        n |= (b & 0x7F) << 7 * i
        if not b & 0x80:
            return n, data[i + 1 :]
    raise ValueError("varint cut short")


def account_rlp(nonce: int, balance: int, storage_root: bytes, code_hash: bytes) -> bytes:
    return rlp([nonce, balance, storage_root, code_hash])


def account_fields(nonce: int, balance: int, code_hash: bytes, incarnation: int) -> bytes:
    """Four length-prefixed fields; an empty code hash has length 0."""
    return b"".join(bytes([len(x)]) + x for x in (be(nonce), be(balance), code_hash, be(incarnation)))


def un_account_fields(data: bytes) -> tuple[int, int, bytes, int]:
    out = []
    for _ in range(4):
        n = data[0]
        out.append(data[1 : 1 + n])
        data = data[1 + n :]
    if data:
        raise ValueError("bytes after the record")
    return int.from_bytes(out[0], "big"), int.from_bytes(out[1], "big"), out[2], int.from_bytes(out[3], "big")


def static_vid(path: str, level: int) -> int:
    """Number of the vertex at ``level`` on ``path``: levels are numbered one after another."""
    return 1 + sum(16**i + int(path[i], 16) * 16 ** (level - i - 1) for i in range(level))


def jump_destinations(code: bytes) -> bytes:
    """A bit per byte of code, set at each jump destination outside push data."""
    out, i = bytearray((len(code) + 7) // 8), 0
    while i < len(code):
        if code[i] == 0x5B:
            out[i // 8] |= 1 << i % 8
        i += code[i] - 0x5E if 0x60 <= code[i] <= 0x7F else 1
    return bytes(out)


def push(n: int) -> bytes:
    """The shortest instruction that pushes ``n``."""
    return b"\x5f" if n == 0 else bytes([0x5F + len(be(n))]) + be(n)


# --- compact records, as columns -------------------------------------------------------


def stripped(b: Column) -> Column:
    """Hex of a big-endian number without its leading zero bytes; zero is empty."""
    return F.regexp_replace(F.hex(b), "^(00)+", "")


def compact_account(nonce: Column, balance: Column, code_hash: Column) -> Column:
    """Binary record of an account: two header bytes (low first: 4 bits nonce bytes, 6 bits balance bytes, 1 bit code), nonce, balance, code hash if any."""
    n, b = stripped(F.unhex(F.lpad(F.hex(nonce.cast("bigint")), 16, "0"))), stripped(balance)
    half = lambda x: (F.length(x) / 2).cast("int")
    head = half(n) + 16 * half(b) + F.when(code_hash.isNull(), 0).otherwise(1024)
    octet = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    return F.unhex(F.concat(octet(F.pmod(head, F.lit(256))), octet(F.floor(head / 256)), n, b, F.coalesce(F.hex(code_hash), F.lit(""))))


def compact_account_fields(record: Column) -> Column:
    """nonce, balance (stripped) and code_hash of such a record."""
    h = F.hex(record)
    octet = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    head = octet(1) + 256 * octet(3)
    n, b = F.pmod(head, F.lit(16)), F.pmod(F.floor(head / 16), F.lit(64)).cast("int")
    cut = lambda at, size: F.substring(h, (5 + 2 * at).cast("int"), (2 * size).cast("int"))
    nonce = F.when(n == 0, F.lit(0)).otherwise(F.conv(cut(F.lit(0), n), 16, -10).cast("bigint"))
    code = F.when(head >= 1024, F.unhex(cut(n + b, F.lit(32))))
    return F.struct(nonce.cast("bigint").alias("nonce"), F.unhex(cut(n, b)).alias("balance"), code.alias("code_hash"))


def compact_slot(key: Column, value: Column) -> Column:
    """Binary record of a storage slot: the key of 32 bytes, then the value without leading zero bytes."""
    return F.unhex(F.concat(F.hex(key), stripped(value)))
