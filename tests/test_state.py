"""Hashes, codecs, tries and specifications against known values and plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stateloom.functions import codecs as c
from stateloom.functions.hashing import keccak, keccak_many
from stateloom.operators import merkle
from stateloom.plans import generators as g
from stateloom.plans import state, templates
from stateloom.sources import spec
from stateloom.sources.genesis import read_genesis


def test_keccak():
    assert keccak(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert merkle.EMPTY_ROOT.hex() == "56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421"
    long = [b"x" * n for n in (0, 1, 134, 135, 136, 137, 272, 500)]
    assert keccak_many(long) == [keccak(m) for m in long] and len(set(keccak_many(long))) == 8


@pytest.mark.parametrize("path,leaf,out", [("12", False, "0012"), ("bc", True, "20bc"), ("", True, "20"), ("5", False, "15"), ("123", True, "3123"), ("", False, "00")])
def test_hex_prefix(path, leaf, out):
    assert c.hex_prefix(path, leaf).hex() == out and c.un_hex_prefix(bytes.fromhex(out)) == (path, leaf)


def test_codecs_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randbytes(rng.randrange(70)), [rng.randbytes(1), []], rng.randbytes(300)]
        assert c.unrlp(c.rlp(item)) == item
        n = rng.getrandbits(rng.randrange(1, 64))
        assert c.un_leb128(c.leb128(n)) == (n, b"")
        row = (n, rng.getrandbits(200), rng.choice([b"", rng.randbytes(32)]), 1)
        assert c.un_account_fields(c.account_fields(*row)) == row
    assert [c.static_vid("0000", i) for i in range(5)] == [1, 2, 18, 274, 4370]
    assert c.jump_destinations(bytes.fromhex("605b5b00")).hex() == "04"
    with pytest.raises(ValueError):
        c.unrlp(b"\x83ab")


def naive(leaves: dict[str, bytes], depth: int = 0) -> bytes:
    """Encoded node of the leaves (hex keys) below ``depth``."""
    ref = lambda e: e if len(e) < 32 else c.rlp(keccak(e))
    if len(leaves) == 1:
        (k, v), = leaves.items()
        return c.rlp([c.hex_prefix(k[depth:], True), v])
    nibbles = {k[depth] for k in leaves}
    if len(nibbles) == 1:
        n = depth
        while len({k[n] for k in leaves}) == 1:
            n += 1
        return c.rlp_list([c.rlp(c.hex_prefix(next(iter(leaves))[depth:n], False)), ref(naive(leaves, n))])
    parts = [{k: v for k, v in leaves.items() if k[depth] == f"{i:x}"} for i in range(16)]
    return c.rlp_list([ref(naive(p, depth + 1)) if p else b"\x80" for p in parts] + [b"\x80"])


@pytest.mark.parametrize("prefix", [1, 2])
def test_trie_roots_equal_the_naive_trie(spark, prefix):
    rng = random.Random(prefix)
    tries, rows = {}, []
    for t in range(25):
        head = rng.randbytes(rng.choice([0, 2, 30]))
        tries[t] = {(head + rng.randbytes(32 - len(head))).hex(): rng.randbytes(rng.choice([1, 5, 33])) for _ in range(rng.randrange(1, 60))}
        rows += [(t, bytearray.fromhex(k), bytearray(v)) for k, v in tries[t].items()]
    df = spark.createDataFrame(rows, "trie_id int, key_hash binary, value binary")
    for n in (1, 5):
        got = {r.trie_id: bytes(r.root) for r in merkle.mpt_roots(df.repartition(n), prefix).collect()}
        assert got == {t: keccak(naive(x)) for t, x in tries.items()}


def test_known_roots(spark):
    """Roots published for raw keys and values."""
    cases = {
        "single": ([("a0" * 32, "42" * 32)], "3bded4a8", "1403"),
        "two": ([("a0" * 32, "01"), ("a0" * 31 + "a1", "02")], "4d96abf5", "506a"),
        "three": ([(x + "00" * 31, v) for x, v in (("10", "01"), ("20", "02"), ("30", "03"))], "68a7eae8", "a56d"),
        "full": ([(f"{i:x}0" + "00" * 31, f"{i + 1:02x}") for i in range(16)], "e9f165f8", "68dc"),
    }
    rows = [(n, bytearray.fromhex(k), bytearray.fromhex(v)) for n, (leaves, _, _) in cases.items() for k, v in leaves]
    for r in merkle.mpt_roots(spark.createDataFrame(rows, "trie_id string, key_hash binary, value binary")).collect():
        root = bytes(r.root).hex()
        assert root.startswith(cases[r.trie_id][1]) and root.endswith(cases[r.trie_id][2])


def genesis(spark, tmp_path, alloc):
    path = tmp_path / "genesis.json"
    path.write_text(json.dumps({"alloc": alloc}))
    return read_genesis(spark, str(path))


def test_genesis_roots(spark, tmp_path):
    one = genesis(spark, tmp_path, {"0x" + "00" * 19 + "01": {"balance": "111111111"}, "0x" + "00" * 19 + "02": {"balance": "222222222"}})
    assert bytes(state.state_root(one["accounts"], one["storage"]).first().root).hex() == "92683e6af0f8a932e5fe08c870f2ae9d287e39d4518ec544b0be451f1035fd39"
    word = lambda n: f"0x{n:064x}"
    two = genesis(
        spark,
        tmp_path,
        {
            "0x1000000000000000000000000000000000000001": {"balance": "0x3635c9adc5dea00000", "nonce": "0x7"},
            "0x2000000000000000000000000000000000000002": {"code": "0x600160015500", "balance": "0x64", "nonce": "0x1", "storage": {word(0): word(0xAA), word(1): word(0xBB), word(2): word(0xCCCCCC)}},
            "0x3000000000000000000000000000000000000003": {"code": "0x60015b00", "balance": "0x0", "nonce": "0x0"},
        },
    )
    root = "7acb3fa2fa378c411135fef796a61c4c681c14e9c844e4af1d779a6f6a7006fb"
    assert bytes(state.state_root(two["accounts"], two["storage"]).first().root).hex() == root
    rooted = state.with_roots(two["accounts"], two["storage"])
    nodes = merkle.trie_nodes(state.account_leaves(rooted)).collect()
    assert any(keccak(bytes(n.node)).hex() == root and n.path == "" for n in nodes) and sum(bytes(n.node)[:1] == b"\xf8" for n in nodes) >= 4
    tables = state.layouts(rooted, two["storage"], rooted.filter("code is not null").select("code_hash", "code").distinct())
    for name, layout in tables.items():
        state.write_layout(layout, str(tmp_path / name), 2)
        assert [spark.read.parquet(str(tmp_path / name / x)).count() for x in ("accounts", "storage", "code")] == [3, 3, 2]


def test_binary_root(spark):
    import hashlib

    sha = lambda b: hashlib.sha256(b).digest()
    rng = random.Random(3)
    stems = {rng.randbytes(31): {rng.randrange(256): rng.randbytes(32) for _ in range(rng.randrange(1, 9))} for _ in range(40)}
    close = bytearray(next(iter(stems)))
    close[5] ^= 1
    stems[bytes(close)] = {3: b"v"}

    def stem_hash(stem, values):
        level = [sha(values[i]) if i in values else bytes(32) for i in range(256)]
        while len(level) > 1:
            level = [bytes(32) if not any(a + b) else sha(a + b) for a, b in zip(level[::2], level[1::2], strict=True)]
        return sha(stem + b"\0" + level[0])

    hashes = {s: stem_hash(s, v) for s, v in stems.items()}
    rows = [(bytearray(s), i, bytearray(v)) for s, x in stems.items() for i, v in x.items()]
    got = merkle.stem_hashes(spark.createDataFrame(rows, "stem binary, suffix int, value binary"))
    assert {bytes(r.stem): r.stem_hash for r in got.collect()} == {s: h.hex() for s, h in hashes.items()}
    for group in (1, 4):
        want = merkle.binary_fold(sorted((f"{int.from_bytes(s, 'big'):0248b}", h) for s, h in hashes.items()), 0, group)
        for n in (1, 3):
            assert bytes(merkle.binary_root(got.repartition(n), group=group).first().root) == want


SPEC = """
entities:
  - {kind: eoa, name: alice, balance: "1000"}
  - {kind: contract, code: "0x600160015500", approximate_size_bytes: 1400}
  - {kind: contract, template: erc20, name: token, parameters: {name: Token, symbol: TK, total_owners: 20, total_allowances: 4, allowances: [{owner: "0x00000000000000000000000000000000000000aa", spender: "0x00000000000000000000000000000000000000ab", allowance: "9"}], owners: [{address: "0x00000000000000000000000000000000000000aa", balance: "5"}]}}
  - {kind: contract, template: storage_pattern, name: p, parameters: {final: 9}}
  - {kind: contract, template: sequential_eoas, name: q, parameters: {count: 7, balance: "3"}}
  - {kind: contract, template: sequential_pkey_eoas, parameters: {start_pkey: "1", count: 4}}
  - {kind: contract, template: create2_factory}
  - {kind: contract, template: create2_deploys, parameters: {salt_count: 3, initcode: "0x00", runtime: "0x5b", storage_init: {"0x1": "0x2"}}}
  - {kind: contract, template: create_preimage_deploys, parameters: {sender: "0x00000000000000000000000000000000000000bb", start_nonce: 126, count: 4, runtime: "0x5b"}}
  - {kind: contract, template: sequential_pkey_delegations, parameters: {start_pkey: "0x100", count: 3, initcode: "0x00"}}
"""


def test_specification_end_to_end(spark):
    entities = spec.resolve(spec.parse(SPEC), 42)
    assert spec.validate(spec.parse(SPEC), set(templates.REGISTRY)) == []
    assert spec.to_frame(spark, entities).count() == 10
    out = templates.expand(spark, entities, 42)
    assert out["accounts"].count() == 1 + 1 + 1 + 1 + 7 + 4 + 1 + 3 + 4 + 3
    assert templates.collisions(out["accounts"]).count() == 0
    # raw 10 slots, token 20 balances, 4 allowances and 3 more, pattern 10, create2 3
    assert out["storage"].count() == 10 + 27 + 10 + 3
    again = templates.expand(spark, entities, 42)
    assert out["storage"].exceptAll(again["storage"]).count() == 0
    first = state.state_root(out["accounts"], out["storage"]).first()
    assert first.root == state.state_root(again["accounts"].repartition(3), again["storage"].repartition(5)).first().root
    assert spec.truncate(entities, 175 + 175 + 1400) == entities[:2]
    keys = {r.i: bytes(r.address).hex() for r in g.key_addresses(spark, 1, 2).collect()}
    assert keys == {0: "7e5f4552091a69125d5dfcb7b8c2659029395bdf", 1: "2b5ad5c4795c026514f8317c7a215e218dccd6cf"}


def test_create_address_encoding(spark):
    sender = bytes.fromhex("00" * 19 + "bb")
    for first in (0, 1, 127, 128, 255, 256, 65535):
        row = g.create_addresses(spark, sender, first, 1).first()
        assert bytes(row.address) == keccak(c.rlp([sender, first]))[12:], first


@pytest.mark.parametrize(
    "entity,message",
    [
        ("{kind: contract}", "needs template or code"),
        ("{kind: robot}", "unknown kind"),
        ("{kind: eoa, template: raw}", "no template"),
        ("{kind: contract, template: nope}", "unknown template"),
        ('{kind: contract, template: erc20, code: "0x00"}', "exclude"),
        ("{kind: eoa, balance: 5}", "quoted"),
        ("{kind: eoa, colour: red}", "unknown fields"),
        ('{kind: eoa, address: "0x12"}', "20 bytes"),
    ],
)
def test_broken_specifications(entity, message):
    with pytest.raises(spec.SpecError, match=message):
        spec.validate(spec.parse(f"entities:\n  - {entity}\n"), set(templates.REGISTRY))


def test_ignored_fields_are_errors():
    for e in (spec.Entity(0, "contract", template="sequential_eoas", balance=b"\0" * 32), spec.Entity(0, "contract", template="erc20", code=b"\0"), spec.Entity(0, "contract", template="storage_pattern", parameters={"x": 1})):
        with pytest.raises(spec.SpecError):
            templates.check(e)


def test_giant_slots_do_not_depend_on_partitioning(spark):
    cdf = [(i + 1) / 32 for i in range(32)]
    a = g.giant_slots(spark, 42, 1, 50, cdf)
    assert {r.j: bytes(r.slot_key) for r in a.collect()} == {r.j: bytes(r.slot_key) for r in a.repartition(3).collect()}
    assert a.filter(F.octet_length("slot_value") != 32).count() == 0


def test_giant_values_have_lengths_of_the_table(spark):
    rows = g.giant_slots(spark, 42, 2, 64, [0.0] * 3 + [1.0] * 29).collect()
    assert {len(bytes(r.slot_value).lstrip(b"\0")) for r in rows} == {4}
    assert len({bytes(r.slot_key) for r in rows}) == 64


def test_known_salts(spark):
    def fnv(n):
        h = 2166136261
        for b in (n % 2**64).to_bytes(8, "big"):
            h = (h ^ b) * 16777619 % 2**32
        return h

    seeds = [0, 1, 42, -1, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(s,) for s in seeds], "s long").select("s", g.salt(F.col("s")).alias("salt")).collect()
    assert {r.s: r.salt for r in rows} == {s: fnv(s) for s in seeds}


def test_compact_accounts_round_trip(spark):
    from stateloom.functions.codecs import compact_account, compact_account_fields, compact_slot

    rows = [(0, b"", None), (1, b"\0" * 32, b"\x11" * 32), (2**63 - 1, b"\xff" * 32, None), (-1, b"\0\x01\0", b"\0" * 32), (256, b"\x80", None)]
    df = spark.createDataFrame(rows, "n long, b binary, c binary").select("*", compact_account(F.col("n"), F.col("b"), F.col("c")).alias("r"), compact_slot(F.lit(b"\x07" * 32), F.col("b")).alias("s"))
    for r in df.withColumn("f", compact_account_fields(F.col("r"))).collect():
        value = bytes(r.b).lstrip(b"\0")
        assert (r.f.nonce, bytes(r.f.balance), r.f.code_hash) == (r.n, value, r.c)
        n = (r.n % 2**64).to_bytes(8, "big").lstrip(b"\0")
        head = len(n) | len(value) << 4 | (r.c is not None) << 10
        assert bytes(r.r) == head.to_bytes(2, "little") + n + value + bytes(r.c or b"")
        assert bytes(r.s) == b"\x07" * 32 + value


def test_truncated_normal_stays_inside(spark):
    rows = spark.range(500).select(g.truncated_normal(F.col("id"), "t", 50.0, 20.0, 40, 60).alias("a"), g.truncated_normal(F.col("id"), "t", 0.0, 1.0, 900, 1000).alias("b"), g.truncated_normal(F.col("id"), "t", 0.0, 1.0, 7, 7).alias("c")).collect()
    assert {r.b for r in rows} == {900} and {r.c for r in rows} == {7}
    assert min(r.a for r in rows) >= 40 and max(r.a for r in rows) <= 60 and len({r.a for r in rows}) > 10
