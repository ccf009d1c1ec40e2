"""Integrity checks on tries and tables as joins; none of them compares every row with every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stateloom.operators.session import ensure_checkpoints


def prefix_rows(keys: DataFrame, key: str, depth: int) -> DataFrame:
    """path, mask of the inner rows of a trie over hex ``key``: every prefix up to ``depth`` with the bits of its children."""
    spread = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("d"))
    return spread.select(F.substring(F.col(key), F.lit(1), F.col("d")).alias("path"), F.pow(F.lit(2), F.conv(F.substring(F.col(key), F.col("d") + 1, F.lit(1)), 16, 10)).cast("int").alias("bit")).groupBy("path").agg(F.bit_or("bit").alias("mask"))


def _shared(a: Column, b: Column, digits: int) -> Column:
    """How many first digits two different hex keys share: by the highest bit that differs in their first 15 digits, digit by digit only where those are equal."""
    head = min(digits, 15)
    number = lambda k: F.conv(F.substring(k, 1, head), 16, 10).cast("bigint")
    differ = number(a).bitwiseXOR(number(b))
    slow = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(digits)), lambda i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i)))
    return F.when(differ != 0, F.lit(head) - F.shiftright(F.length(F.bin(differ)) + 3, 2)).when(differ == 0, slow)


def _bit(key: str, depth: str) -> Column:
    """The bit of the digit of hex ``key`` after its first ``depth``."""
    return F.expr(f"shiftleft(1, cast(conv(substring({key}, {depth} + 1, 1), 16, 10) as int))")


def _placed(keys: DataFrame, key: str, digits: int, block: int) -> DataFrame:
    """``keys`` by blocks of the first digits (_b), with _a, the digits that ``key`` shares with the one before it in the block, and _m, the most it shares with another key there; null where there is none."""
    rows = keys.withColumn("_b", F.substring(key, 1, block)).repartition("_b")
    w, same = Window.partitionBy("_b").orderBy(key), Window.partitionBy("_b", key)
    rows = rows.withColumn("_p", F.lag(key).over(w)).withColumn("_a", F.when(F.col("_p") != F.col(key), _shared(F.col("_p"), F.col(key), digits))).drop("_p")
    return rows.withColumn("_m", F.greatest("_a", F.lead("_a").over(w))).withColumn("_m", F.max("_m").over(same))


def _blocks(keys: DataFrame, key: str, block: int) -> DataFrame:
    """_b, _first, _last key of each block, and _near, the most digits it shares with another block: at most 16^``block`` rows."""
    w = Window.orderBy("_b")
    rows = keys.groupBy(F.substring(key, 1, block).alias("_b")).agg(F.min(key).alias("_first"), F.max(key).alias("_last")).filter("_b is not null")
    near = [_shared(F.col("_b"), f("_b").over(w), block) for f in (F.lag, F.lead)]
    return rows.withColumn("_near", F.greatest(*near, F.lit(0)))


def whole_trie(keys: DataFrame, key: str, digits: int = 64, block: int = 4) -> DataFrame:
    """path, mask, leaf of a whole trie over distinct hex ``key``: the root and every prefix of two keys or more with the bits of its children, and each key's leaf (mask 0) one below its deepest inner row.

    Keys are dealt by their first ``block`` digits and put in order there, once; each gives
    the rows below the prefix it shares with the key before.  What is shorter than a block
    comes from the blocks' first and last keys.
    """
    block = min(block, digits)
    keys = keys.select(F.col(key).alias("_k"))
    d = F.explode(F.sequence(F.greatest("_a", F.lit(block)), F.col("_m") + 1)).alias("d")
    spread = _placed(keys, "_k", digits, block).filter("_m is not null").select("_b", "_k", "_m", d)
    bit = F.when(F.col("d") <= F.col("_m"), _bit("_k", "d")).otherwise(0)
    deep = spread.groupBy("_b", F.substring(F.col("_k"), F.lit(1), F.col("d")).alias("path")).agg(F.bit_or(bit).alias("mask")).select("path", "mask", (F.col("mask") == 0).alias("leaf"))
    blocks = _blocks(keys, "_k", block)
    short = blocks.select("_b", "_first", "_last", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("d"))
    inner = short.groupBy(F.substring(F.col("_b"), F.lit(1), F.col("d")).alias("path")).agg(F.bit_or(_bit("_b", "d")).alias("mask"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    top = inner.filter("_first < _last or path = ''").select("path", "mask", F.lit(False).alias("leaf"))
    alone = blocks.filter("_first = _last").select(F.substring(F.col("_b"), F.lit(1), F.col("_near") + 1).alias("path"), F.lit(0).alias("mask"), F.lit(True).alias("leaf"))
    return deep.unionByName(top).unionByName(alone)


def own_ancestors(keys: DataFrame, key: str, digits: int = 64, block: int = 4) -> DataFrame:
    """Each row of ``keys`` (without ``key``) with path, mask of every inner row that its hex ``key`` passes in the whole trie over all of them.

    A key has as many as the digits it shares with a neighbour, so nothing longer is looked
    up; masks are gathered inside blocks as in ``whole_trie``, those of shorter paths come
    with the block.
    """
    block = min(block, digits)
    others = [c for c in keys.columns if c != key]
    spread = _placed(keys, key, digits, block).select("*", F.explode(F.sequence(F.lit(block), F.coalesce("_m", F.lit(block)))).alias("_d"))
    rows = spread.select(*others, "_b", F.col("_m").isNull().alias("_alone"), "_d", F.substring(F.col(key), F.lit(1), F.col("_d")).alias("_path"), _bit(key, "_d").alias("_bit"))
    rows = rows.withColumn("_mask", F.bit_or("_bit").over(Window.partitionBy("_b", "_path"))).drop("_bit")
    blocks = _blocks(keys, key, block)
    for d in range(block):
        blocks = blocks.withColumn(f"_{d}", F.bit_or(_bit("_b", str(d))).over(Window.partitionBy(F.substring("_b", 1, d))))
    tops = blocks.select("_b", "_near", F.array(*[F.struct(F.substring("_b", 1, d).alias("path"), F.col(f"_{d}").alias("mask")) for d in range(block)]).alias("_top"))
    own = F.array(F.struct(F.col("_path").alias("path"), F.col("_mask").alias("mask")))
    found = F.when(F.col("_d") > block, own).when(F.col("_alone"), F.slice("_top", 1, F.col("_near") + 1)).otherwise(F.concat("_top", own))
    return rows.join(F.broadcast(tops), "_b").select(*others, F.explode(found).alias("_f")).select(*others, "_f.path", "_f.mask")


def dangling_and_orphans(rows: DataFrame, depth: int) -> DataFrame:
    """kind, path: child bits above ``depth`` without a row, and rows that no parent's bit names; rows and named children meet in one grouping by path."""
    entry = lambda path, named: F.struct(path.alias("path"), F.lit(named).alias("named"))
    child = lambda i: F.when((F.col("mask").bitwiseAND(1 << i) != 0) & (F.length("path") + 1 < depth), entry(F.concat("path", F.lit(f"{i:x}")), 1))
    own = entry(F.col("path"), 0)
    both = rows.select(F.explode(F.when(F.col("mask") == 0, F.array(own)).otherwise(F.array(own, *[child(i) for i in range(16)]))).alias("e")).filter("e is not null").select("e.*")
    counts = both.groupBy("path").agg(F.sum("named").alias("named"), F.sum(1 - F.col("named")).alias("rows"))
    wrong = counts.filter("rows = 0 or (named = 0 and path <> '')").select(F.when(F.col("rows") == 0, "dangling").otherwise("orphan").alias("kind"), "path", F.greatest("rows", "named").alias("n"))
    return wrong.select(F.explode(F.array_repeat("kind", F.col("n").cast("int"))).alias("kind"), "path")


def ancestors(rows: DataFrame, target: DataFrame, key: str, depth: int) -> DataFrame:
    """The rows whose path is a prefix of a target key: the target's prefixes are exploded and joined by equality."""
    wanted = target.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.substring(F.col(key), F.lit(1), d))).alias("path")).distinct()
    return rows.join(wanted, "path")


def differences(got: DataFrame, want: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, got, want of the keys whose values differ or that one side lacks."""
    both = got.select(*key, F.col(value).alias("got")).join(want.select(*key, F.col(value).alias("want")), key, "full_outer")
    return both.filter(~F.col("got").eqNullSafe(F.col("want")))


def record_hashes(content: DataFrame, key: str, value: str) -> DataFrame:
    """key, recorded: the SHA-256 of each ``value`` by hashlib, kept as a checkpoint: the record does not change with the content."""
    ensure_checkpoints(content.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], names=[key, "recorded"])

    kind = content.schema[key].dataType.simpleString()
    return content.select(key, F.col(value).cast("string")).mapInArrow(run, f"{key} {kind}, recorded string").checkpoint()


def verify_content(content: DataFrame, recorded: DataFrame, key: str, value: str) -> DataFrame:
    """key, verified of every row of ``content`` and of every record without content; what has no record is not verified, null content stays null."""
    both = content.select(key, F.sha2(value, 256).alias("_h"), F.lit(True).alias("_c")).join(recorded.select(key, "recorded", F.lit(True).alias("_r")), key, "full_outer")
    missing = F.col("_r").isNull() | F.col("_c").isNull()
    return both.select(key, F.when(missing, F.lit(False)).otherwise(F.col("_h") == F.col("recorded")).alias("verified"))


def reachable(edges: DataFrame, roots: DataFrame, levels: int = 65) -> DataFrame:
    """node, level of all nodes reached from ``roots`` (node) along ``edges`` (parent, child): one join a level, stops when a level is empty."""
    seen = frontier = roots.select("node").distinct().withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = step.withColumn("level", F.lit(level)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        if not frontier.isEmpty():
            raise RuntimeError(f"nodes are still reached after {levels} levels")
    return seen


def reached_paths(rows: DataFrame, block: int = 4) -> DataFrame:
    """node, level of the root '' and all ``path`` of ``rows`` (hex) that are reached from it through rows one digit longer each.

    Paths are dealt by their first ``block`` digits and put in order there, so that each
    follows its parent; shorter ones go to all blocks below them, and only the first gives them out.
    """
    short = F.lit(block) - F.length("path")
    below = F.transform(F.sequence(F.lit(0), F.pow(F.lit(16), short).cast("int") - 1), lambda i: F.concat("path", F.lpad(F.lower(F.hex(i)), short, F.lit("0"))))
    dealt = rows.filter("path <> ''").select(F.explode(F.when(short > 0, below).otherwise(F.array(F.substring("path", 1, block)))).alias("_b"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, way = None, [""]  # way: the reached paths down to the last one
        for batch in batches:
            out = []
            for at, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != here:
                    here, way = at, [""]
                while not path.startswith(way[-1]):
                    way.pop()
                if len(path) == len(way[-1]) + 1:
                    way.append(path)
                    if len(path) >= block or path.ljust(block, "0") == at:
                        out.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["node"])

    found = dealt.repartition("_b").sortWithinPartitions("_b", "path").mapInArrow(run, "node string")
    root = rows.sparkSession.range(1).select(F.lit("").alias("node"))
    return root.unionByName(found).select("node", F.length("node").alias("level"))
