"""Merkle folds: the hexary Keccak trie and the binary SHA-256 trie, as partial and final ordered aggregates.

Hexary: leaves are sorted inside (trie, key prefix) partitions; each prefix
bucket becomes an unresolved top (leaf, or a path to a branch), and the at most
16^k tops of a trie are joined in a second pass.  Nodes are hashed depth by
depth, a whole depth of all tries of a batch in one call.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stateloom.functions.codecs import hex_prefix, rlp, rlp_list
from stateloom.functions.hashing import keccak_many

#: Leaves whose nodes are hashed together.
CHUNK = 50_000


class Pool:
    """Nodes of many tries; ``resolve`` gives each its encoding and its reference in a parent."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []  # (depth, kind, path, value, children, place)

    def leaf(self, depth: int, path: str, value: bytes, place=None) -> int:
        self.nodes.append((depth, "leaf", path, value, (), place))
        return len(self.nodes) - 1

    def extension(self, depth: int, path: str, child, place=None) -> int:
        self.nodes.append((depth, "extension", path, None, (child,), place))
        return len(self.nodes) - 1

    def branch(self, depth: int, children: list, place=None) -> int:
        self.nodes.append((depth, "branch", "", None, tuple(children), place))
        return len(self.nodes) - 1

    def attach(self, top: tuple, depth: int, place=None):
        """A top as child: its node, or the reference that it is already."""
        kind, path, payload = top
        if kind == "leaf":
            return self.leaf(depth, path, payload, place)
        return self.extension(depth, path, payload, place) if path else payload

    def resolve(self) -> None:
        self.encoded: list[bytes] = [b""] * len(self.nodes)
        self.refs: list[bytes] = [b""] * len(self.nodes)
        order = sorted(range(len(self.nodes)), key=lambda i: -self.nodes[i][0])
        ref = lambda c: b"\x80" if c is None else (self.refs[c] if isinstance(c, int) else c)
        for _, group in groupby(order, key=lambda i: self.nodes[i][0]):
            at = list(group)
            for i in at:
                _, kind, path, value, children, _ = self.nodes[i]
                if kind == "leaf":
                    self.encoded[i] = rlp([hex_prefix(path, True), value])
                elif kind == "extension":
                    self.encoded[i] = rlp_list([rlp(hex_prefix(path, False)), ref(children[0])])
                else:
                    self.encoded[i] = rlp_list([ref(c) for c in children] + [b"\x80"])
            large = [i for i in at if len(self.encoded[i]) >= 32]
            for i, digest in zip(large, keccak_many([self.encoded[i] for i in large]), strict=True):
                self.refs[i] = b"\xa0" + digest
            for i in at:
                self.refs[i] = self.refs[i] or self.encoded[i]


def subtrie(pool: Pool, keys: list[str], values: list[bytes], lo: int, hi: int, depth: int, trie=None) -> tuple:
    """The top of the sorted keys lo..hi below ``depth``: (kind, path, value or node)."""
    if hi - lo == 1:
        return "leaf", keys[lo][depth:], values[lo]
    common = commonprefix([keys[lo][depth:], keys[hi - 1][depth:]])
    at, children, i = depth + len(common), [None] * 16, lo
    while i < hi:
        nibble = keys[i][at]
        j = bisect_left(keys, keys[i][:at] + chr(ord(nibble) + 1), i, hi)
        top = subtrie(pool, keys, values, i, j, at + 1, trie)
        children[int(nibble, 16)] = pool.attach(top, at + 1, (trie, keys[i][: at + 1]))
        i = j
    return "branch", common, pool.branch(at, children, (trie, keys[lo][:at]))


def join_tops(pool: Pool, tops: list[tuple[str, tuple]], depth: int) -> tuple:
    """One top of the sorted (prefix, top) pairs."""
    if len(tops) == 1:
        prefix, (kind, path, payload) = tops[0]
        return kind, prefix[depth:] + path, payload
    common = commonprefix([tops[0][0][depth:], tops[-1][0][depth:]])
    at, children = depth + len(common), [None] * 16
    for nibble, group in groupby(tops, key=lambda t: t[0][at]):
        children[int(nibble, 16)] = pool.attach(join_tops(pool, list(group), at + 1), at + 1)
    return "branch", common, pool.branch(at, children)


EMPTY_ROOT = keccak_many([b"\x80"])[0]


def _chunks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[tuple[tuple, list[dict]]]]:
    """Whole groups of sorted rows, about CHUNK rows at a time."""
    groups: list = []
    size, last = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if k != last:
                if size >= CHUNK:
                    yield groups
                    groups, size = [], 0
                groups.append((k, []))
                last = k
            groups[-1][1].append(row)
            size += 1
    if groups:
        yield groups


def mpt_roots(leaves: DataFrame, prefix: int = 1) -> DataFrame:
    """trie_id, root, n_leaves of the leaves (trie_id, key_hash binary, value binary).

    A bucket of one trie and ``prefix`` nibbles must fit a task; of equal keys in
    a trie the greatest value counts (keys are unique in valid input).
    """
    one = leaves.groupBy("trie_id", "key_hash").agg(F.max("value").alias("value"))
    keyed = one.select("trie_id", F.lower(F.hex("key_hash")).alias("key"), "value").withColumn("prefix", F.substring("key", 1, prefix))
    kind = dict(keyed.dtypes)["trie_id"]
    arrow = to_arrow_type(keyed.schema["trie_id"].dataType)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _chunks(batches, ["trie_id", "prefix"]):
            pool, tops = Pool(), []
            for (trie, pre), rows in groups:
                keys, values = [r["key"] for r in rows], [bytes(r["value"]) for r in rows]
                tops.append((trie, pre, subtrie(pool, keys, values, 0, len(keys), len(pre)), len(keys)))
            pool.resolve()
            done = [(t, p, k, path, pool.refs[x] if isinstance(x, int) else x, n) for t, p, (k, path, x), n in tops]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], a) for i, a in enumerate((arrow, pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()))], names=["trie_id", "prefix", "kind", "path", "payload", "n"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _chunks(batches, ["trie_id"]):
            pool, tops = Pool(), []
            for (trie,), rows in groups:
                top = join_tops(pool, [(r["prefix"], (r["kind"], r["path"], bytes(r["payload"]))) for r in rows], 0)
                tops.append((trie, pool.attach(top, 0), sum(r["n"] for r in rows)))
            pool.resolve()
            refs = [pool.refs[x] if isinstance(x, int) else x for _, x, _ in tops]
            short = [i for i, r in enumerate(refs) if len(r) != 33]
            roots = [r[1:] for r in refs]
            for i, digest in zip(short, keccak_many([refs[i] for i in short]), strict=True):
                roots[i] = digest
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in tops], arrow), pa.array(roots, pa.binary()), pa.array([n for _, _, n in tops], pa.int64())], names=["trie_id", "root", "n_leaves"])

    tops = keyed.repartition("trie_id", "prefix").sortWithinPartitions("trie_id", "prefix", "key").mapInArrow(partial, f"trie_id {kind}, prefix string, kind string, path string, payload binary, n long")
    return tops.repartition("trie_id").sortWithinPartitions("trie_id", "prefix").mapInArrow(final, f"trie_id {kind}, root binary, n_leaves long")


def trie_nodes(leaves: DataFrame) -> DataFrame:
    """trie_id, path, node (encoded) of every node that is hashed into a parent, and the root: for tries that fit a task."""
    keyed = leaves.groupBy("trie_id", "key_hash").agg(F.max("value").alias("value")).select("trie_id", F.lower(F.hex("key_hash")).alias("key"), "value")
    kind = dict(keyed.dtypes)["trie_id"]
    arrow = to_arrow_type(keyed.schema["trie_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _chunks(batches, ["trie_id"]):
            pool = Pool()
            for (trie,), rows in groups:
                top = subtrie(pool, [r["key"] for r in rows], [bytes(r["value"]) for r in rows], 0, len(rows), 0, trie)
                pool.attach(top, 0, (trie, ""))
            pool.resolve()
            out = [(*place, pool.encoded[i]) for i, (_, _, _, _, _, place) in enumerate(pool.nodes) if len(pool.encoded[i]) >= 32 or place[1] == ""]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], a) for i, a in enumerate((arrow, pa.string(), pa.binary()))], names=["trie_id", "path", "node"])

    return keyed.repartition("trie_id").sortWithinPartitions("trie_id", "key").mapInArrow(run, f"trie_id {kind}, path string, node binary")


def storage_leaves(storage: DataFrame) -> DataFrame:
    """Leaves of (trie_id, slot_key, slot_value): hashed slot, RLP of the trimmed value; zero values do not exist."""
    from stateloom.functions.hashing import keccak256

    trimmed = F.expr("cast(trim(LEADING x'00' FROM slot_value) as binary)")
    live = storage.withColumn("v", trimmed).filter(F.octet_length("v") > 0)
    return live.select("trie_id", keccak256("slot_key").alias("key_hash"), short_rlp(F.col("v")).alias("value"))


def short_rlp(b: Column) -> Column:
    """RLP of byte strings shorter than 56, in built-in functions."""
    n = F.octet_length(b)
    return F.when((n == 1) & (F.hex(b) < "80"), b).otherwise(F.concat(F.unhex(F.hex(n + 128)), b))


def stem_hashes(entries: DataFrame) -> DataFrame:
    """stem, n, bitmap, stem_hash of (stem binary, suffix int 0..255, value binary): eight rounds of built-in SHA-256.

    A suffix without a value hashes to nothing, two nothings to nothing.
    """
    zero = "00" * 32
    pairs = entries.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("suffix", F.sha2("value", 256).alias("h")))).alias("m"))
    level = pairs.select("stem", F.size("m").cast("bigint").alias("n"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.col("m")[i], F.lit(""))).alias("h"))
    for width in (128, 64, 32, 16, 8, 4, 2, 1):

        def up(i: Column) -> Column:
            a, b = F.get("h", 2 * i), F.get("h", 2 * i + 1)
            some = lambda x: F.when(x == "", F.lit(zero)).otherwise(x)
            return F.when((a == "") & (b == ""), F.lit("")).otherwise(F.sha2(F.unhex(F.concat(some(a), some(b))), 256))

        level = level.select("stem", "n", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), up).alias("h"))
    return level.select("stem", "n", F.sha2(F.concat("stem", F.unhex(F.concat(F.lit("00"), F.col("h")[0]))), 256).alias("stem_hash"))


def _sha_many(pairs: list[bytes]) -> list[bytes]:
    import hashlib

    return [hashlib.sha256(p).digest() for p in pairs]


def binary_fold(stems: list[tuple[str, bytes]], depth: int, group: int = 1) -> bytes:
    """Root below ``depth`` of sorted (bit string, hash): a lone stem stands where it becomes unique, at a group boundary."""
    if not stems:
        return bytes(32)
    if len(stems) == 1 and depth % group == 0:
        return stems[0][1]
    cut = next((i for i, (bits, _) in enumerate(stems) if bits[depth] == "1"), len(stems))
    left, right = binary_fold(stems[:cut], depth + 1, group), binary_fold(stems[cut:], depth + 1, group)
    return bytes(32) if not any(left) and not any(right) else _sha_many([left + right])[0]


def binary_root(stems: DataFrame, prefix: int = 8, group: int = 1) -> DataFrame:
    """One row: root of (stem binary, stem_hash hex).  Buckets of ``prefix`` bits fold alone; a bucket of one stem stays open, as its place depends on its neighbours."""
    bits = F.array_join(F.transform(F.split(F.hex("stem"), ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    rows = stems.select(bits.alias("bits"), F.unhex("stem_hash").alias("h")).withColumn("bucket", F.substring("bits", 1, prefix))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _chunks(batches, ["bucket"]):
            done = []
            for (bucket,), rs in groups:
                lone = len(rs) == 1
                done.append((bucket, rs[0]["bits"] if lone else bucket, bytes(rs[0]["h"]) if lone else binary_fold([(r["bits"], bytes(r["h"])) for r in rs], prefix, group), lone))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], a) for i, a in enumerate((pa.string(), pa.string(), pa.binary(), pa.bool_()))], names=["bucket", "bits", "h", "lone"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [(r["bits"], bytes(r["h"]), r["lone"]) for b in batches for r in b.to_pylist()]

        def go(part: list, depth: int) -> bytes:
            if not part:
                return bytes(32)
            if len(part) == 1:
                bits, h, lone = part[0]
                if lone and depth % group == 0:
                    return h
                if not lone and depth == prefix:
                    return h
            cut = next((i for i, t in enumerate(part) if t[0][depth] == "1"), len(part))
            left, right = go(part[:cut], depth + 1), go(part[cut:], depth + 1)
            return bytes(32) if not any(left) and not any(right) else _sha_many([left + right])[0]

        yield pa.RecordBatch.from_arrays([pa.array([go(tops, 0)], pa.binary())], names=["root"])

    tops = rows.repartition("bucket").sortWithinPartitions("bucket", "bits").mapInArrow(partial, "bucket string, bits string, h binary, lone boolean")
    return tops.repartitionByRange(1, "bucket").sortWithinPartitions("bucket").mapInArrow(final, "root binary")  # at most 2^prefix rows
