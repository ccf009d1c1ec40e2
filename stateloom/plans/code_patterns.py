"""Code patterns: contract code of a chosen size by rule, and the init code that deploys it.

A pattern is a layout: a head, whether the contract's own address is spliced in and
where, and jump destinations (5b) up to the size.  The code of many contracts is a
column: constants around the address, joined by Spark; nothing is made per row in
Python.  Init code is written by a small assembler and only its hash is used, for
CREATE2 addresses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stateloom.functions.codecs import push

# Names, sizes and the offsets at which the address stands.
DEFAULT_SIZE, LARGEST = 0x6000, 16 << 20
ADDRESS_AT = {"unique_jumpdest": 0x2C, "max_same": None, "max_diff": 0x0C}
SMALLEST = {"unique_jumpdest": 0x61, "max_same": 0x20, "max_diff": 0x20}
FIXED = "_pre_amsterdam"

_DEST, _STOP = b"\x5b", b"\x00"
_JUMP, _MSTORE, _MSTORE8, _MCOPY, _ADDRESS, _OR, _RETURN = b"\x56", b"\x52", b"\x53", b"\x5e", b"\x30", b"\x17", b"\xf3"
_ZERO = b"\x60\x00"


def _word(value: bytes) -> bytes:
    return b"\x7f" + value.ljust(32, _DEST)


class CodePattern:
    """A named pattern with its size; names ending in ``_pre_amsterdam`` have a fixed size."""

    def __init__(self, name: str, code_size: int | None = None):
        kind = name.removesuffix(FIXED)
        if kind not in ADDRESS_AT:
            raise ValueError(f"unknown code_pattern {name!r}; known: {', '.join([*(k + FIXED for k in ADDRESS_AT), *ADDRESS_AT])}")
        if name.endswith(FIXED) and code_size is not None:
            raise ValueError(f"code_size does not go with {name}, whose size is fixed")
        size = DEFAULT_SIZE if code_size is None else int(code_size)
        if not SMALLEST[kind] <= size <= LARGEST:
            raise ValueError(f"code_size {size:#x} is not in {SMALLEST[kind]:#x}..{LARGEST:#x}")
        self.kind, self.size, self.at = kind, size, ADDRESS_AT[kind]

    @property
    def head(self) -> bytes:
        """What stands first: a jump to the last byte, a stop, or the zeros of a word that holds the address."""
        return {"unique_jumpdest": push(self.size - 1) + _JUMP, "max_same": _STOP, "max_diff": bytes(0x0C)}[self.kind]

    def pieces(self) -> tuple[bytes, bytes]:
        """The code before and after the address (all of it before, where there is none)."""
        if self.at is None:
            return self.head.ljust(self.size, _DEST), b""
        return self.head.ljust(self.at, _DEST), _DEST * (self.size - self.at - 20)

    def code(self, address: bytes) -> bytes:
        before, after = self.pieces()
        return before + (address if self.at is not None else b"") + after

    def column(self, address: Column) -> Column:
        """The code of each row's contract."""
        before, after = (F.unhex(F.lit(x.hex())) for x in self.pieces())
        return F.concat(before, address, after) if self.at is not None else before

    def init_code(self) -> bytes:
        """Fills memory with jump destinations by doubling copies, writes the head and the address, returns the size."""
        parts, span = [_word(b"") + _ZERO + _MSTORE], 32
        while span < self.size:
            parts.append(push(span) + _ZERO + push(span) + _MCOPY)
            span *= 2
        parts.append(
            {
                "unique_jumpdest": _word(self.head) + _ZERO + _MSTORE + _word(_DEST * 12 + bytes(20)) + _ADDRESS + _OR + b"\x60\x20" + _MSTORE,
                "max_same": _ZERO + _ZERO + _MSTORE8,
                "max_diff": _ADDRESS + _ZERO + _MSTORE,
            }[self.kind]
        )
        return b"".join([*parts, push(self.size), _ZERO, _RETURN])


def pattern_of(parameters: dict, *owned: str) -> CodePattern | None:
    """The pattern that ``parameters`` name, which then owns the parameters ``owned``; without one these are required."""
    if "code_pattern" in parameters:
        if taken := [x for x in owned if x in parameters]:
            raise ValueError(f"{', '.join(taken)} cannot stand beside code_pattern")
        return CodePattern(str(parameters["code_pattern"]), parameters.get("code_size"))
    if "code_size" in parameters:
        raise ValueError("code_size needs a code_pattern")
    if missing := [x for x in owned if x not in parameters]:
        raise ValueError(f"{', '.join(missing)} or code_pattern is required")
    return None
