"""Order-sensitive operators without a single-task window: global ranks, prefix sums, samples by index.

Each works in two steps: blocks of the key space are ordered alone, and small
per-block totals (as many rows as blocks) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_rank(df: DataFrame, key: str, block: Column, out: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank by ``key``; ``block`` must not decrease as ``key`` grows, and bounds what one task orders."""
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return rows.withColumn("_inner", inner).join(F.broadcast(before), "_block").withColumn(out, (F.col("_inner") + F.col("_before")).cast("bigint")).drop("_block", "_inner", "_before")


def prefix_sum(df: DataFrame, order: str, value: str, block: Column, out: str = "running") -> DataFrame:
    """``df`` with the running sum of ``value`` by ``order``; ``block`` as in global_rank."""
    rows = df.withColumn("_block", block)
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inner", inner).join(F.broadcast(before), "_block").withColumn(out, (F.col("_inner") + F.col("_before")).cast("bigint")).drop("_block", "_inner", "_before")


def neighbour(df: DataFrame, key: str, group: Column, block: Column, out: str, after: bool = False) -> DataFrame:
    """``df`` with the key before (or ``after``) by ``key`` inside ``group``, null at its end.

    ``block`` refines ``group`` and does not decrease as ``key`` grows.  Blocks are ordered alone; only their
    first or last keys, as many rows as blocks, are ordered by group and sent out.
    """
    rows = df.withColumn("_group", group).withColumn("_block", block)
    near, edge = (F.lead, F.min) if after else (F.lag, F.max)
    edges = rows.groupBy("_group", "_block").agg(edge(key).alias("_edge"))
    beside = edges.select("_block", near("_edge").over(Window.partitionBy("_group").orderBy("_block")).alias("_edge"))
    inner = rows.withColumn(out, near(key).over(Window.partitionBy("_block").orderBy(key)))
    return inner.join(F.broadcast(beside), "_block").withColumn(out, F.coalesce(out, "_edge")).drop("_group", "_block", "_edge")


def truncate_to_budget(df: DataFrame, order: str, cost: str, budget: int, block: Column) -> DataFrame:
    """The longest prefix by ``order`` whose running ``cost`` stays within ``budget``; costs are positive."""
    return prefix_sum(df, order, cost, block).filter(F.col("running") <= budget)


def even_sample(df: DataFrame, group: list[str], order: str, k: int = 5) -> DataFrame:
    """All rows of groups of at most k; else the rows at floor(i (n - 1) / (k - 1)), i = 0..k-1."""
    w = Window.partitionBy(*group)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)).cast("int"))
    return rows.filter((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def step_sample(df: DataFrame, group: list[str], order: str, cap: int) -> DataFrame:
    """Rows at 0, n - 1 and the multiples of n div (cap - 1), at most cap of them."""
    w = Window.partitionBy(*group)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("_n") / (cap - 1)).cast("int"), F.lit(1))
    return rows.filter((F.col("_n") <= cap) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | ((F.pmod(F.col("_i"), step) == 0) & (F.col("_i") / step < cap - 1))).drop("_i", "_n")


def bottom_k(df: DataFrame, score: Column, k: int) -> DataFrame:
    """A uniform sample without replacement that no partitioning changes: the k smallest scores."""
    return df.withColumn("_score", score).orderBy("_score").limit(k).drop("_score")


def keep_last(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` of each key: later puts win."""
    whole = F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_row")
    return df.groupBy(*key).agg(whole).select(*key, "_row.*")
