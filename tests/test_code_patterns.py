"""Init code, run by a small machine, returns the code that the pattern says."""

import pytest

from stateloom.plans.code_patterns import CodePattern, pattern_of

ADDRESS = bytes(range(100, 120))


def run(code: bytes, address: bytes) -> bytes:
    stack, memory, pc = [], bytearray(1 << 17), 0
    while True:
        op, pc = code[pc], pc + 1
        if 0x5F <= op <= 0x7F:
            n = op - 0x5F
            stack.append(int.from_bytes(code[pc : pc + n], "big"))
            pc += n
        elif op == 0x30:
            stack.append(int.from_bytes(address, "big"))
        elif op == 0x17:
            stack.append(stack.pop() | stack.pop())
        elif op == 0x52:
            at = stack.pop()
            memory[at : at + 32] = stack.pop().to_bytes(32, "big")
        elif op == 0x53:
            at = stack.pop()
            memory[at] = stack.pop() & 255
        elif op == 0x5E:
            to, source, n = stack.pop(), stack.pop(), stack.pop()
            memory[to : to + n] = memory[source : source + n]
        elif op == 0xF3:
            at, n = stack.pop(), stack.pop()
            return bytes(memory[at : at + n])
        else:
            raise AssertionError(hex(op))


@pytest.mark.parametrize("name", ["unique_jumpdest", "max_same", "max_diff"])
@pytest.mark.parametrize("size", [None, 0x61, 0x100, 0x101, 0x6000, 0x10000])
def test_init_code_deploys_the_code(name, size):
    p = CodePattern(name, size)
    assert len(p.code(ADDRESS)) == (size or 0x6000) and run(p.init_code(), ADDRESS) == p.code(ADDRESS)
    if size is None:
        assert CodePattern(name + "_pre_amsterdam").init_code() == p.init_code()


def test_rules():
    assert pattern_of({"initcode": "0x00"}, "initcode") is None
    for bad in ({}, {"code_pattern": "max_same", "initcode": "0x"}, {"code_pattern": "other"}, {"initcode": "0x", "code_size": 64}, {"code_pattern": "max_same_pre_amsterdam", "code_size": 64}, {"code_pattern": "unique_jumpdest", "code_size": 0x60}):
        with pytest.raises(ValueError):
            pattern_of(bad, "initcode")


def test_column_equals_the_code(spark):
    df = spark.createDataFrame([(bytearray(ADDRESS),)], "address binary")
    for name in ("unique_jumpdest", "max_same", "max_diff"):
        p = CodePattern(name, 0x80)
        assert bytes(df.select(p.column(df["address"]).alias("c")).first().c) == p.code(ADDRESS)
