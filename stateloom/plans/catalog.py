"""The engine's queries by operator, each with DuckDB SQL of the same rows where SQL can say it.

Entries are (name, identifiers, function, SQL or None); ``@query`` registers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stateloom.functions.hashing import be8, keccak256, pad32
from stateloom.operators import audit, merkle, ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str, **more) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}, **more)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return register


def _hash(*parts: str) -> F.Column:
    return F.sha2(F.concat_ws("-", *[F.col(p).cast("string") for p in parts]), 256)


def _u(h: str = "h", digits: int = 8) -> str:
    """The first hex digits as an integer, in Spark SQL."""
    return f"cast(conv(substr({h}, 1, {digits}), 16, 10) as bigint)"


def _du(h: str = "h", digits: int = 8) -> str:
    """The same in DuckDB."""
    return f"cast(('0x' || substr({h}, 1, {digits})) as bigint)"


# --- sorts, merges, limits -------------------------------------------------------------


@query("keyed_sort_spill", "select l_orderkey, l_linenumber, h, row_number() over (order by h) as rank from (select l_orderkey, l_linenumber, sha256(l_orderkey::varchar || '-' || l_linenumber::varchar) as h from lineitem)")
def keyed_sort_spill(t):
    """SO1, SO7, SO8, W2: rank in the order of a content hash, 256 key ranges ordered apart."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", _hash("l_orderkey", "l_linenumber").alias("h"))
    return ordered.global_rank(rows, "h", F.substring("h", 1, 2))


@query("range_partition_rank", f"select cast(floor({_du()} * 7 / 4294967296.0) as bigint) as bucket, count(*) as n, min(h) as lo, max(h) as hi from (select sha256(o_orderkey::varchar) as h from orders) group by 1")
def range_partition_rank(t):
    """SO4, O10: key ranges floor(h R / 2^32), their sizes and bounds."""
    return t.orders.select(_hash("o_orderkey").alias("h")).groupBy(F.expr(f"cast(floor({_u()} * 7 / 4294967296D) as bigint)").alias("bucket")).agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))


@query("kway_merge_runs", "select src, id, h, row_number() over (order by h, src) as rank from (select 'o' as src, o_orderkey as id, sha256(o_orderkey::varchar) as h from orders union all select 'c', c_custkey, sha256('c' || c_custkey::varchar) from customer)")
def kway_merge_runs(t):
    """SO3, SET1: sorted runs merged by key."""
    runs = t.orders.select(F.lit("o").alias("src"), F.col("o_orderkey").alias("id"), _hash("o_orderkey").alias("h")).unionByName(t.customer.select(F.lit("c").alias("src"), F.col("c_custkey").alias("id"), F.sha2(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), 256).alias("h")))
    return ordered.global_rank(runs.withColumn("_k", F.concat("h", "src")), "_k", F.substring("h", 1, 2)).drop("_k")


@query("postorder_groups", "select substr(h, 1, 2) as grp, count(*) as n, sha256(string_agg(h, '' order by h)) as digest from (select sha256(c_custkey::varchar) as h from customer) group by 1")
def postorder_groups(t):
    """SO5, W5, O9: rows of a two-nibble group in key order, folded to a digest."""
    return t.customer.select(_hash("c_custkey").alias("h")).groupBy(F.substring("h", 1, 2).alias("grp")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("h")).alias("hs")).select("grp", "n", F.sha2(F.array_join("hs", ""), 256).alias("digest"))


@query("map_sorted_slots", "select o_custkey, string_agg(o_orderkey::varchar || ':' || cast(round(o_totalprice * 100) as bigint)::varchar, ',' order by o_orderkey) as slots from orders group by 1")
def map_sorted_slots(t):
    """SO6: a map's entries in key order."""
    pairs = t.orders.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v")))).alias("m"))
    return pairs.select("o_custkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("slots"))


@query("first_rows", "select o_orderkey, o_custkey from orders order by o_orderkey limit 25")
def first_rows(t):
    """SO10, RNG10: the first rows in key order (a limit by nature)."""
    return t.orders.select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(25)


# --- windows and prefix operators ------------------------------------------------------

_COST = "175 + (p_size * 100 // 140) * 140"


@query("budget_prefix_truncate", f"select p_partkey, cast(cost as bigint) as cost, cast(running as bigint) as running from (select p_partkey, cost, sum(cost) over (order by p_partkey rows unbounded preceding) as running from (select p_partkey, {_COST} as cost from part)) where running <= 500000")
def budget_prefix_truncate(t):
    """W1, PRJ6, SO9, O5: the longest prefix within a byte budget, cost 175 + floor(size / 140) 140."""
    cost = (F.lit(175) + F.floor(F.col("p_size") * 100 / 140) * 140).cast("bigint")
    return ordered.truncate_to_budget(t.part.select("p_partkey", cost.alias("cost")), "p_partkey", "cost", 500000, F.floor(F.col("p_partkey") / 1000))


@query("keep_last_by_key", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def keep_last_by_key(t):
    """W8, SET5: the last put of a key wins."""
    return ordered.keep_last(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.struct("ts", "event_id")).drop("ts")


@query("first_three", "select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by c_custkey) as r from customer) where r <= 3")
def first_three(t):
    """The first three of each class."""
    return t.customer.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))).filter("r <= 3").select("c_mktsegment", "c_custkey")


@query("cpl_lag", "select o_orderkey, h, case when p is null then 0 else cast((select max(i) from range(0, 17) r(i) where substr(h, 1, cast(i as int)) = substr(p, 1, cast(i as int))) as int) end as cpl from (select o_orderkey, h, lag(h) over (partition by substr(h, 1, 1) order by h) as p from (select o_orderkey, sha256(o_orderkey::varchar) as h from orders))")
def cpl_lag(t):
    """Common prefix (to 16 nibbles) with the key before, inside one top nibble."""
    rows = t.orders.select("o_orderkey", _hash("o_orderkey").alias("h"))
    return _with_cpl(rows).select("o_orderkey", "h", "cpl")


def _with_cpl(rows: DataFrame, out: str = "cpl", after: bool = False) -> DataFrame:
    rows = ordered.neighbour(rows, "h", F.substring("h", 1, 1), F.substring("h", 1, 3), "_p", after)
    same = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.when(F.substring(F.col("h"), F.lit(1), i) == F.substring(F.col("_p"), F.lit(1), i), i).otherwise(F.lit(0))))
    return rows.withColumn(out, F.coalesce(F.when(F.col("_p").isNotNull(), same), F.lit(0))).drop("_p")


@query("placement_depth", "with k as (select sha256(o_orderkey::varchar) as h from orders), n as (select h, lag(h) over w as p, lead(h) over w as q from k window w as (partition by substr(h, 1, 1) order by h)), c as (select h, coalesce((select max(i) from range(0, 17) r(i) where substr(h, 1, cast(i as int)) = substr(p, 1, cast(i as int))), 0) as a, coalesce((select max(i) from range(0, 17) r(i) where substr(h, 1, cast(i as int)) = substr(q, 1, cast(i as int))), 0) as b from n) select h, cast(greatest(a, b) + 1 as int) as depth, cast(ceil((greatest(a, b) + 1) / 4.0) * 4 as int) as grouped from c")
def placement_depth(t):
    """W4, AG5: depth max(left, right common prefix) + 1, rounded up to a group boundary of 4."""
    rows = _with_cpl(_with_cpl(t.orders.select(_hash("o_orderkey").alias("h")), "a"), "b", after=True)
    depth = F.greatest("a", "b") + 1
    return rows.select("h", depth.cast("int").alias("depth"), (F.ceil(depth / 4) * 4).cast("int").alias("grouped"))


@query("cumulative_weights", "select p_brand, n, cast(sum(n) over (order by p_brand) - n as bigint) as lo, cast(sum(n) over (order by p_brand) as bigint) as hi from (select p_brand, count(*) as n from part group by 1)")
def cumulative_weights(t):
    """Cumulative weights of a small class table."""
    return _weights(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand")


def _weights(classes: DataFrame, key: str) -> DataFrame:
    hi = F.sum("n").over(Window.orderBy(key))  # as many rows as classes
    return classes.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("n"))


# --- samples and distributions ---------------------------------------------------------


@query("evenly_spaced_sample", "select c_nationkey, c_custkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, count(*) over (partition by c_nationkey) as n from customer) where n <= 5 or i in (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1)")
def evenly_spaced_sample(t):
    """RNG8: five evenly spaced keys of each group."""
    return ordered.even_sample(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 5)


@query("index_sample", "select c_nationkey, c_custkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, count(*) over (partition by c_nationkey) as n from customer) where n <= 5 or i = 0 or i = n - 1 or (i % greatest(n // 4, 1) = 0 and i // greatest(n // 4, 1) < 4)")
def index_sample(t):
    """RNG9: first, last and step multiples of each group."""
    return ordered.step_sample(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 5)


@query("bottom_k_reservoir", "select doc_id, n_chars from documents where n_chars between 1024 and 24576 order by sha256(doc_id::varchar || '-7') limit 100")
def bottom_k_reservoir(t):
    """RNG7: a reservoir of eligible values, reproducible under any partitioning (a sample by nature)."""
    rows = t.documents.filter("n_chars between 1024 and 24576").select("doc_id", "n_chars")
    return ordered.bottom_k(rows, F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("-7")), 256), 100)


@query("cdf_class_draw", f"with w as (select p_brand, sum(n) over (order by p_brand) as hi, sum(n) over (order by p_brand) - n as lo from (select p_brand, count(*) as n from part group by 1)) select o_orderkey, p_brand from (select o_orderkey, {_du('sha256(o_orderkey::varchar)')} % (select count(*) from part) as u from orders) join w on u >= lo and u < hi")
def cdf_class_draw(t):
    """RNG3, RNG5, J8, GEN8: inverse-CDF draw, by a range join with a class table of checked size."""
    classes = _weights(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand").select("p_brand", "lo", "hi")
    return inverse_cdf(t.orders.select("o_orderkey", _hash("o_orderkey").alias("h")), classes).select("o_orderkey", "p_brand")


def inverse_cdf(rows: DataFrame, classes: DataFrame, limit: int = 65536) -> DataFrame:
    """Joins the class whose [lo, hi) holds the draw.

    The range is cut into as many equal cells as there are classes (at most ``limit``, checked), and each
    class goes out once for every cell that it touches: an equi-join on the cell, in which a draw
    meets two classes on average however uneven the weights are.
    """
    size, total = classes.agg(F.count("*"), F.max("hi")).first()
    if size > limit:
        raise ValueError("class table too large for a broadcast draw")
    if not total:
        raise ValueError("class table without weight")
    width = max(1, total // size)
    cell = lambda c: F.floor(c / width).cast("bigint")
    held = classes.filter("hi > lo").withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    drawn = rows.withColumn("_u", F.pmod(F.expr(_u()), F.lit(total))).withColumn("_cell", cell(F.col("_u")))
    found = drawn.join(F.broadcast(held), "_cell").filter((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi")))
    return found.drop("_u", "_cell", "lo", "hi")


@query("tail_interpolate", f"with k(lo_u, hi_u, lo_s, hi_s) as (values (0, 500, 28, 100), (500, 900, 100, 1000), (900, 1000, 1000, 100000)) select o_orderkey, cast(least(lo_s + 1 + (u - lo_u) * (hi_s - lo_s) // (hi_u - lo_u), hi_s) as bigint) as slots from (select o_orderkey, {_du('sha256(o_orderkey::varchar)')} % 1000 as u from orders) join k on u >= lo_u and u < hi_u")
def tail_interpolate(t):
    """RNG4: a piecewise-linear tail between knots."""
    u = F.pmod(F.expr(_u("sha2(cast(o_orderkey as string), 256)")), F.lit(1000))
    knots = [(0, 500, 28, 100), (500, 900, 100, 1000), (900, 1000, 1000, 100000)]
    slots = F.coalesce(*[F.when((u >= a) & (u < b), F.least(F.lit(s) + 1 + F.floor((u - a) * (z - s) / (b - a)), F.lit(z))) for a, b, s, z in knots])
    return t.orders.select("o_orderkey", slots.cast("bigint").alias("slots"))


@query("slot_distributions", f"select o_orderkey, cast(floor(least(1 / pow(1 - u, 1 / 1.5), 10000)) as bigint) as pareto, cast(least(floor(-ln(1 - u) * 250 / ln(2.0)), 1000) as bigint) as exponential, cast(1 + floor(u * 1000) as bigint) as uniform from (select o_orderkey, ({_du('sha256(o_orderkey::varchar)')} % 1000003) / 1000003.0::double as u from orders)")
def slot_distributions(t):
    """RNG2: Pareto (1.5), exponential (median max / 4) and uniform slot counts, clamped."""
    rows = t.orders.select("o_orderkey", (F.pmod(F.expr(_u("sha2(cast(o_orderkey as string), 256)")), F.lit(1000003)) / F.lit(1000003.0)).alias("u"))
    u = F.col("u")
    return rows.select(
        "o_orderkey",
        F.floor(F.least(1 / F.pow(1 - u, F.lit(1 / 1.5)), F.lit(10000.0))).cast("bigint").alias("pareto"),
        F.least(F.floor(-F.log(1 - u) * 250 / F.log(F.lit(2.0))), F.lit(1000)).cast("bigint").alias("exponential"),
        (1 + F.floor(u * 1000)).cast("bigint").alias("uniform"),
    )


# --- generators ------------------------------------------------------------------------


@query("eoa_draw", f"select o_orderkey as i, substr(sha256('eoa-42-' || o_orderkey::varchar), 25, 40) as address, {_du('sha256(' + chr(39) + 'bal-42-' + chr(39) + ' || o_orderkey::varchar)')} % 1000 as balance_ether, {_du('sha256(' + chr(39) + 'non-42-' + chr(39) + ' || o_orderkey::varchar)')} % 1000 as nonce from orders")
def eoa_draw(t):
    """GEN1, GEN29: accounts drawn by a counter hash: the same whatever the partitioning."""
    from stateloom.plans.generators import draw_accounts

    return draw_accounts(t.orders.select(F.col("o_orderkey").alias("i")), seed=42)


@query("flavored_accounts", "with d as (select o_orderkey as i, sha256('fla-42-' || o_orderkey::varchar) as h from orders) select i, case when cast('0x' || substr(h, 1, 8) as bigint) % 10000 < 9000 then 1 else 0 end as funded, case when cast('0x' || substr(h, 9, 8) as bigint) % 10000 < 200 then 'ef0100' || substr(sha256('target-' || (cast('0x' || substr(h, 17, 8) as bigint) % 256)::varchar), 25, 40) else '' end as code from d")
def flavored_accounts(t):
    """GEN2, GEN3, F17: funded with 0.90, delegated with 0.02 to one of 256 targets."""
    from stateloom.plans.generators import flavor_accounts

    return flavor_accounts(t.orders.select(F.col("o_orderkey").alias("i")), seed=42)


@query("contract_slots", f"with c as (select p_partkey as i, 1 + {_du('sha256(' + chr(39) + 'cnt-' + chr(39) + ' || p_partkey::varchar)')} % 5 as n from part) select i, j, sha256('slot-' || i::varchar || '-' || j::varchar) as slot_key from (select i, unnest(range(0, cast(n as bigint))) as j from c)")
def contract_slots(t):
    """GEN4, GEN5, GEN14: contracts exploded to their storage slots."""
    n = 1 + F.pmod(F.expr(_u("sha2(concat('cnt-', cast(p_partkey as string)), 256)")), F.lit(5))
    rows = t.part.select(F.col("p_partkey").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("j"))
    return rows.select("i", "j", F.sha2(F.concat_ws("-", F.lit("slot"), "i", "j"), 256).alias("slot_key"))


@query("code_pool_pick", "with m as (select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) as r from documents), s as (select p_partkey, p_size * 100 as want from part), e as (select p_partkey, want, (select count(*) from m where n_chars >= want) as k from s) select p_partkey, want, doc_id from e join m on m.r = 1 + p_partkey % k where k > 0")
def code_pool_pick(t):
    """GEN7, J7: a pool member of sufficient size: members ranked by size, so the eligible ones are a prefix, whose length is a running count of sizes."""
    members = t.documents.select("doc_id", "n_chars").withColumn("k", F.format_string("%012d|%020d", F.lit(10**11) - F.col("n_chars"), F.col("doc_id")))
    ranked = ordered.global_rank(members, "k", F.floor(F.lit(10**8) - F.col("n_chars") / 1000), "r").select("doc_id", "r")
    wanted = t.part.select("p_partkey", (F.col("p_size") * 100).cast("bigint").alias("want"))
    eligible = _at_least(members.select("n_chars"), wanted.select("want")).filter("n > 0")
    return wanted.join(eligible, "want").withColumn("r", 1 + F.pmod("p_partkey", "n")).join(ranked, "r").select("p_partkey", "want", "doc_id")


def _at_least(sizes: DataFrame, wants: DataFrame) -> DataFrame:
    """want and n, the number of sizes of at least ``want``: sizes are counted, and one running sum from the largest serves all wants."""
    marks = sizes.toDF("want").withColumn("one", F.lit(1)).unionByName(wants.toDF("want").withColumn("one", F.lit(0))).filter(F.col("want").isNotNull())
    counts = marks.groupBy("want").agg(F.sum("one").alias("here"), F.min("one").alias("asked"))
    running = ordered.prefix_sum(counts.withColumn("_down", -F.col("want")), "_down", "here", F.floor(F.col("_down") / 1000), "n")
    return running.filter("asked = 0").select("want", "n")


@query(
    "truncated_normal",
    "with d as (select p_partkey, list_transform(range(1, 9), lambda i: sha256('norm-' || p_partkey::varchar || '-' || i::varchar)) as hs from part), "
    "v as (select p_partkey, list_transform(hs, lambda h: 900.0::double + sqrt(-2.0::double * ln((cast('0x' || substr(h, 1, 8) as bigint) + 1) / 4294967296.0::double)) * cos(2 * pi() * (cast('0x' || substr(h, 9, 8) as bigint) / 4294967296.0::double)) * 700.0::double) as vs from d), "
    "w as (select p_partkey, vs, list_filter(vs, lambda x: x >= 1000 and x <= 1200) as good from v) "
    "select p_partkey, cast(coalesce(floor(good[1]), case when vs[8] < 1000 then 1000 else 1200 end) as bigint) as size from w",
)
def truncated_normal(t):
    """RNG1, GEN7: a normal draw within bounds, eight attempts, then the bound."""
    from stateloom.plans.generators import truncated_normal as draw

    return t.part.select("p_partkey", draw(F.col("p_partkey"), "norm", 900.0, 700.0, 1000, 1200).alias("size"))


@query("significant_bytes", "select o_orderkey, n, case when n = 0 then '' else (case when substr(h, 1, 2) = '00' then '01' else substr(h, 1, 2) end) || substr(h, 3, cast(2 * n - 2 as int)) end as number from (select o_orderkey, sha256('sig-' || o_orderkey::varchar) as h, cast(o_orderkey % 33 as int) as n from orders)")
def significant_bytes(t):
    """RNG6: numbers of exactly n bytes, the first of them not zero."""
    from stateloom.plans.generators import significant

    n = F.pmod("o_orderkey", F.lit(33)).cast("int")
    return t.orders.select("o_orderkey", n.alias("n"), significant(F.sha2(F.concat(F.lit("sig-"), F.col("o_orderkey").cast("string")), 256), n).alias("number"))


@query("seed_salt", "select c_custkey as seed, list_reduce([2166136261::bigint] || list_transform(range(7, -1, -1), lambda i: (c_custkey::bigint >> (8 * i)) & 255), lambda a, x: (xor(a, x) * 16777619) & 4294967295) as salt from customer")
def seed_salt(t):
    """the salt of a seed."""
    from stateloom.plans.generators import salt

    return t.customer.select(F.col("c_custkey").alias("seed"), salt(F.col("c_custkey")).alias("salt"))


@query("human_counts", "select user_id, format('{:,}', sum(event_id)::bigint) as shown from events group by 1")
def human_counts(t):
    """whole numbers with separators."""
    return t.events.groupBy("user_id").agg(F.format_number(F.sum("event_id"), 0).alias("shown"))


@query("rank_permutation", "select p_partkey as rank, (p_partkey * 7919) % 20011 as place from part")
def rank_permutation(t):
    """GEN9: a coprime multiplicative permutation of ranks."""
    return t.part.select(F.col("p_partkey").alias("rank"), F.pmod(F.col("p_partkey").cast("decimal(38,0)") * 7919, F.lit(20011)).cast("bigint").alias("place"))


@query("power_law_giants", "select i, cast(floor(1000000.0::double * (2 * 115 * 115) / (2 * 115 * 115 - (2 * i - 1) * 114)) as bigint) as slots from range(1, 116) t(i)")
def power_law_giants(t):
    """GEN12, GEN13: sizes of the giants, closed form."""
    return t.spark.range(1, 116).select(F.col("id").alias("i"), F.floor(F.lit(1000000.0) * (2 * 115 * 115) / (2 * 115 * 115 - (2 * F.col("id") - 1) * 114)).cast("bigint").alias("slots"))


@query("storage_pattern_rows", "select k as slot, case when k = 0 then 1001 else k end as value from range(0, 1001) t(k)")
def storage_pattern_rows(t):
    """GEN23: slot 0 holds final + 1, slot k holds k."""
    from stateloom.plans.generators import storage_pattern

    return storage_pattern(t.spark, 1000)


@query("code_pattern_bytes", "select s_suppkey, '00' || repeat('5b', 96 + s_suppkey % 50) as max_same, repeat('00', 12) || substr(sha256(s_suppkey::varchar), 25, 40) || repeat('5b', 64) as max_diff from supplier")
def code_pattern_bytes(t):
    """GEN27: patterned code: jump destinations, with a stop first or an address spliced in."""
    a = F.substring(_hash("s_suppkey"), 25, 40)
    return t.supplier.select("s_suppkey", F.concat(F.lit("00"), F.expr("repeat('5b', cast(96 + s_suppkey % 50 as int))")).alias("max_same"), F.concat(F.lit("00" * 12), a, F.lit("5b" * 64)).alias("max_diff"))


@query(
    "code_pattern_runtime",
    "with a as (select s_suppkey, substr(sha256(s_suppkey::varchar), 25, 40) as a from supplier) "
    "select s_suppkey, '60ff56' || repeat('5b', 41) || a || repeat('5b', 192) as unique_jumpdest, '00' || repeat('5b', 255) as max_same, repeat('00', 12) || a || repeat('5b', 224) as max_diff from a",
)
def code_pattern_runtime(t):
    """GEN27: the code of the three patterns at 256 bytes, by the builders that the templates use."""
    from stateloom.plans.code_patterns import ADDRESS_AT, CodePattern

    rows = t.supplier.select("s_suppkey", F.unhex(F.substring(_hash("s_suppkey"), 25, 40)).alias("address"))
    return rows.select("s_suppkey", *(F.lower(F.hex(CodePattern(k, 256).column(F.col("address")))).alias(k) for k in ADDRESS_AT))


@query("code_chunks", "select doc_id, cast(i as int) as i, sha256(substr(hex, cast(i * 62 + 1 as int), 62)) as chunk from (select doc_id, lower(hex(encode(text))) as hex, unnest(range(0, cast(ceil(octet_length(encode(text)) / 31.0) as bigint))) as i from documents where n_chars > 0)")
def code_chunks(t):
    """31-byte chunks of code by offset."""
    rows = t.documents.filter("n_chars > 0").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("x"))
    spread = rows.select("doc_id", F.posexplode(F.regexp_extract_all("x", F.lit(".{1,62}"), F.lit(0))).alias("i", "c"))
    return spread.select("doc_id", "i", F.sha2("c", 256).alias("chunk"))


# --- projections, filters, predicates --------------------------------------------------


@query("address_resolve", "select s_suppkey, substr(sha256('42' || coalesce(case when s_suppkey % 3 = 0 then s_name end, 'anon-' || s_suppkey::varchar)), 25, 40) as derived, coalesce(case when s_suppkey % 5 = 0 then repeat('ab', 20) end, substr(sha256('42' || coalesce(case when s_suppkey % 3 = 0 then s_name end, 'anon-' || s_suppkey::varchar)), 25, 40)) as address from supplier")
def address_resolve(t):
    """PRJ1: explicit address, else from the name, else from the ordinal."""
    rows = t.supplier.select("s_suppkey", F.when(F.pmod("s_suppkey", F.lit(5)) == 0, F.lit("ab" * 20)).alias("explicit"), F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.col("s_name")).alias("name"))
    derived = F.substring(F.sha2(F.concat(F.lit("42"), F.coalesce("name", F.concat(F.lit("anon-"), F.col("s_suppkey").cast("string")))), 256), 25, 40)
    return rows.select("s_suppkey", derived.alias("derived"), F.coalesce("explicit", derived).alias("address"))


_ROUTE = "case when kind = 'eoa' then 'eoa' when template is not null then template when code then 'raw' else 'invalid' end"
_SPEC = "select p_partkey as ordinal, case when p_size % 2 = 0 then 'eoa' else 'contract' end as kind, case when p_size % 2 = 1 and p_size % 3 = 0 then 'erc20' end as template, p_size % 5 = 0 as code, p_size % 7 as nonce from {part}"


@query("route_template", f"select ordinal, kind, {_ROUTE} as template_used from ({_SPEC.replace('{part}', 'part')})")
def route_template(t):
    """PRJ2: entity to template."""
    return t.sql(f"select ordinal, kind, {_ROUTE} as template_used from ({_SPEC})", "part")


@query("honored_fields", f"with s as ({_SPEC.replace('{part}', 'part')}), d(template_used, field, alternative) as (values ('erc20', 'code', ''), ('erc20', 'nonce', 'parameters.nonce')), f as (select ordinal, {_ROUTE} as template_used, unnest(list_filter(['code', 'nonce'], lambda x: (x = 'code' and code) or (x = 'nonce' and nonce <> 0))) as field from s) select ordinal, f.template_used, f.field, alternative from f join d on f.template_used = d.template_used and f.field = d.field")
def honored_fields(t):
    """PRJ3: set fields that the template ignores, with the alternative."""
    ignored = t.spark.createDataFrame([("erc20", "code", ""), ("erc20", "nonce", "parameters.nonce")], "template_used string, field string, alternative string")
    rows = t.sql(f"select ordinal, {_ROUTE} as template_used, explode(filter(array(if(code, 'code', null), if(nonce <> 0, 'nonce', null)), x -> x is not null)) as field from ({_SPEC})", "part")
    return rows.join(F.broadcast(ignored), ["template_used", "field"])


@query("dependency_rule", "select o_orderpriority from orders where o_orderstatus = 'P' group by 1 having not exists (select 1 from orders o where o.o_orderstatus = 'X' and o.o_orderpriority = orders.o_orderpriority)")
def dependency_rule(t):
    """PRJ12, PRJ11: consumers without a provider."""
    used = t.orders.filter("o_orderstatus = 'P'").select("o_orderpriority").distinct()
    return used.join(t.orders.filter("o_orderstatus = 'X'").select("o_orderpriority"), "o_orderpriority", "left_anti")


@query("spec_findings", "select p_partkey, case when p_size > 45 then 'oversize' when p_name = '' then 'missing' else 'duplicate' end as finding from (select *, min(p_partkey) over (partition by p_type, p_brand) as first from part) where p_size > 45 or p_name = '' or p_partkey > first")
def spec_findings(t):
    """SRC3, AG9: one row a broken rule, duplicates by first index."""
    first = F.min("p_partkey").over(Window.partitionBy("p_type", "p_brand"))
    return t.part.withColumn("first", first).filter("p_size > 45 or p_name = '' or p_partkey > first").select("p_partkey", F.expr("case when p_size > 45 then 'oversize' when p_name = '' then 'missing' else 'duplicate' end").alias("finding"))


@query("zero_and_trim", "select o_orderkey, regexp_replace(printf('%016x', o_custkey % 300), '^(00)+', '') as trimmed from orders where o_custkey % 300 <> 0")
def zero_and_trim(t):
    """PRJ4, PRJ5, O4: zero values do not exist; leading zero bytes go."""
    value = be8(F.pmod("o_custkey", F.lit(300)))
    rows = t.orders.select("o_orderkey", value.alias("v")).filter(F.hex("v") != "0" * 16)
    return rows.select("o_orderkey", F.lower(F.hex(F.expr("trim(LEADING x'00' FROM v)"))).alias("trimmed"))


@query("account_kind", "select c_custkey, count(o_orderkey) > 0 or c_acctbal < 0 as is_contract from customer left join orders on o_custkey = c_custkey group by c_custkey, c_acctbal")
def account_kind(t):
    """PRJ7: contract if it has code or storage; storage counted before the join."""
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(counts, "c_custkey", "left").select("c_custkey", ((F.coalesce("n", F.lit(0)) > 0) | (F.col("c_acctbal") < 0)).alias("is_contract"))


@query("parse_size", "with s(x) as (values ('5GB'), ('1.5MB'), ('700'), ('2KB'), ('1TB'), ('0.5kb')) select x, cast(cast(regexp_extract(x, '^[0-9.]+') as double) * case upper(regexp_extract(x, '[A-Za-z]+$')) when 'KB' then 1024 when 'MB' then 1048576 when 'GB' then 1073741824 when 'TB' then 1099511627776 else 1 end as bigint) as bytes from s")
def parse_size(t):
    """PRJ9, F20: sizes as text, base 1024."""
    rows = t.spark.createDataFrame([(x,) for x in ("5GB", "1.5MB", "700", "2KB", "1TB", "0.5kb")], "x string")
    unit = F.create_map(*[F.lit(v) for kv in (("", 1), ("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30), ("TB", 1 << 40)) for v in kv])
    return rows.select("x", (F.regexp_extract("x", "^[0-9.]+", 0).cast("double") * unit[F.upper(F.regexp_extract("x", "[A-Za-z]*$", 0))]).cast("bigint").alias("bytes"))


@query("fork_order", "with f(name, rank) as (values ('london', 0), ('paris', 1), ('shanghai', 2), ('cancun', 3), ('prague', 4)) select o_orderkey, name, rank >= 2 as withdrawals from orders join f on o_orderkey % 5 = rank")
def fork_order(t):
    """PRJ10, SRC6, SRC7: forks by rank, columns by fork."""
    names = F.array(*[F.lit(x) for x in ("london", "paris", "shanghai", "cancun", "prague")])
    rank = F.pmod("o_orderkey", F.lit(5))
    return t.orders.select("o_orderkey", F.get(names, rank.cast("int")).alias("name"), (rank >= 2).alias("withdrawals"))


@query("ring_slot", "select event_id, epoch(date_trunc('second', ts))::bigint % 8191 as slot from events")
def ring_slot(t):
    """V5: ring-buffer slot of a timestamp."""
    return t.events.select("event_id", F.expr("pmod(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)), 8191)").alias("slot"))


# --- joins -----------------------------------------------------------------------------


@query("anti_join_redraw", "with g as (select distinct substr(sha256(c_custkey::varchar), 1, 3) as a from customer), d as (select o_orderkey, k, substr(sha256(o_orderkey::varchar || '-' || k::varchar), 1, 3) as a from orders, range(0, 8) t(k)) select o_orderkey, min(k) as attempt, arg_min(d.a, k) as address from d where not exists (select 1 from g where g.a = d.a) group by 1")
def anti_join_redraw(t):
    """Draws are repeated while they hit the taken set, until every order has one: eight of three digits as the SQL has them, then 160-bit addresses."""
    from stateloom.plans.generators import redraw

    taken = t.customer.select(_hash("c_custkey").alias("h"))
    orders = t.orders.select("o_orderkey").distinct()
    draws = orders.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("attempt")).withColumn("address", F.substring(_hash("o_orderkey", "attempt"), 1, 3))
    free = draws.join(taken.select(F.substring("h", 1, 3).alias("address")).distinct(), "address", "left_anti")
    first = free.groupBy("o_orderkey").agg(F.min(F.struct("attempt", "address")).alias("m")).select("o_orderkey", "m.attempt", "m.address")
    return first.unionByName(redraw(orders.join(first, "o_orderkey", "left_anti"), "o_orderkey", taken.select(F.substring("h", 1, 40).alias("address")), 40, 8))


@query("anti_join_redraw_whole", "with recursive g as (select distinct sha256(c_custkey::varchar) as h from customer), d as (select o_orderkey, k, substr(sha256(o_orderkey::varchar || '-' || k::varchar), 1, 3) as a from orders, range(0, 8) t(k)), f as (select o_orderkey, min(k) as attempt, arg_min(a, k) as address from d where a not in (select substr(h, 1, 3) from g) group by 1), w(o_orderkey, attempt, address) as (select distinct o_orderkey, 8::bigint, substr(sha256(o_orderkey::varchar || '-8'), 1, 40) from orders where o_orderkey not in (select o_orderkey from f) union all select o_orderkey, attempt + 1, substr(sha256(o_orderkey::varchar || '-' || (attempt + 1)::varchar), 1, 40) from w where address in (select substr(h, 1, 40) from g)) select o_orderkey, attempt, address from f union all select o_orderkey, attempt, address from w where address not in (select substr(h, 1, 40) from g)")
def anti_join_redraw_whole(t):
    """The rows of anti_join_redraw; this SQL too goes on after eight draws."""
    return anti_join_redraw(t)


@query("splice_roots", "select o_orderkey, coalesce(root, 'empty') as root from orders left join (select l_orderkey, sha256(string_agg(l_linenumber::varchar, ',' order by l_linenumber)) as root from lineitem where l_quantity > 45 group by 1) on l_orderkey = o_orderkey")
def splice_roots(t):
    """Roots spliced into accounts, with a default."""
    roots = t.lineitem.filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l_linenumber")), ","), 256).alias("root"))
    return t.orders.select("o_orderkey").join(roots, "o_orderkey", "left").select("o_orderkey", F.coalesce("root", F.lit("empty")).alias("root"))


@query("dictionary_join", "select c_custkey, count(*) as n from orders join (select c_custkey, sha256(c_custkey::varchar) as h from customer) on sha256(o_custkey::varchar) = h group by 1")
def dictionary_join(t):
    """Hash back to key."""
    return t.orders.select(_hash("o_custkey").alias("h")).join(t.customer.select("c_custkey", _hash("c_custkey").alias("h")), "h").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("got_vs_want", "select coalesce(g.k, w.k) as k, got, want from (select l_orderkey as k, count(*) as got from lineitem group by 1) g full join (select o_orderkey as k, 1 + o_custkey % 7 as want from orders) w on g.k = w.k where got is distinct from want")
def got_vs_want(t):
    """Differences of a built and an expected table."""
    got = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("v"))
    return audit.differences(got, t.orders.select(F.col("o_orderkey").alias("k"), (1 + F.pmod("o_custkey", F.lit(7))).alias("v")), ["k"], "v")


@query("set_equality", "select (select count(*) from (select o_custkey from orders where o_orderkey % 2 = 0 except all select c_custkey from customer)) as only_left, (select count(*) from (select c_custkey from customer except all select o_custkey from orders where o_orderkey % 2 = 0)) as only_right")
def set_equality(t):
    """SET4, V7: two results compared as multisets."""
    a, b = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    one = lambda df, n: df.agg(F.count("*").alias(n)).withColumn("j", F.lit(1))
    return one(a.exceptAll(b), "only_left").join(one(b.exceptAll(a), "only_right"), "j").drop("j")


_KEYS = "select sha256(o_orderkey::varchar) as h from orders"
_ROWS = f"select substr(h, 1, d) as path, bit_or(1 << cast('0x' || substr(h, d + 1, 1) as int)) as mask from ({_KEYS}), (select cast(d as int) as d from range(0, 4) t(d)) group by 1"


def _trie(t):
    return audit.prefix_rows(t.orders.select(_hash("o_orderkey").alias("h")), "h", 4)


@query("child_masks", f"select path, mask, bit_count(mask)::int as children from ({_ROWS})")
def child_masks(t):
    """AG6: child masks of the inner rows."""
    return _trie(t).select("path", "mask", F.bit_count("mask").alias("children"))


@query("depth_histogram", f"select length(path)::int as depth, count(*) as n from ({_ROWS}) group by 1")
def depth_histogram(t):
    """AG7: rows by depth."""
    return _trie(t).groupBy(F.length("path").alias("depth")).agg(F.count("*").alias("n"))


@query("strip_shallow", f"select path, mask from ({_ROWS}) where length(path) >= 2")
def strip_shallow(t):
    """V3: rows at least so deep."""
    return _trie(t).filter(F.length("path") >= 2)


@query("trie_audit", f"with r as (select * from ({_ROWS}) where substr(sha256(path), 1, 1) <> 'a' or path = ''), b as (select path || substr('0123456789abcdef', cast(i + 1 as int), 1) as path from r, range(0, 16) t(i) where (mask >> i::int) & 1 = 1 and length(path) < 3) select 'dangling' as kind, path from b where path not in (select path from r) union all select 'orphan', path from r where path <> '' and path not in (select path from b)")
def trie_audit(t):
    """Child bits without a row and rows without a parent, after some rows were lost."""
    kept = _trie(t).filter("substr(sha2(path, 256), 1, 1) <> 'a' or path = ''")
    return audit.dangling_and_orphans(kept, 4)


@query("prefix_probe", f"select path, mask from ({_ROWS}) where exists (select 1 from (select sha256(o_orderkey::varchar) as k from orders where o_orderkey % 97 = 0) where starts_with(k, path))")
def prefix_probe(t):
    """The ancestors of keys."""
    return audit.ancestors(_trie(t), t.orders.filter("o_orderkey % 97 = 0").select(_hash("o_orderkey").alias("k")), "k", 4)


@query("reachability", f"with recursive r as (select * from ({_ROWS})), e as (select substr(path, 1, length(path) - 1) as parent, path as child from r where path <> '' and substr(sha256(path), 1, 1) <> 'b'), w(node, level) as (select '', 0 union all select child, level + 1 from w join e on parent = node) select node, level::int as level from w")
def reachability(t):
    """What is reached from the root along the edges that are left."""
    from stateloom.operators.session import ensure_checkpoints

    ensure_checkpoints(t.spark)
    edges = _trie(t).filter("path <> '' and substr(sha2(path, 256), 1, 1) <> 'b'").select(F.expr("substr(path, 1, length(path) - 1)").alias("parent"), F.col("path").alias("child")).checkpoint()
    return audit.reachable(edges, t.spark.createDataFrame([("",)], "node string"))


# The seven above stop at depth 3, as their SQL has it; these take the whole trie.

_PREFIXES = f"select substr(h, 1, d) as path, h, bit_or(1 << cast('0x' || substr(h, d + 1, 1) as int)) over (partition by substr(h, 1, d)) as mask, count(*) over (partition by substr(h, 1, d)) as n, d from (select distinct h from ({_KEYS})), (select cast(d as int) as d from range(0, 64) t(d))"
_WHOLE = f"select distinct path, mask from ({_PREFIXES}) where n > 1 or d = 0"
_LEAVES = f"select substr(h, 1, 1 + max(d)) as path, 0 as mask from ({_PREFIXES}) where n > 1 or d = 0 group by h"


def _whole(t, leaves: bool = False):
    rows = audit.whole_trie(t.orders.select(_hash("o_orderkey").alias("h")), "h")
    return (rows if leaves else rows.filter("not leaf")).drop("leaf")


@query("child_masks_whole", f"select path, mask, bit_count(mask)::int as children from ({_WHOLE})")
def child_masks_whole(t):
    """AG6: child masks of all inner rows."""
    return _whole(t).select("path", "mask", F.bit_count("mask").alias("children"))


@query("depth_histogram_whole", f"select length(path)::int as depth, count(*) as n from ({_WHOLE}) group by 1")
def depth_histogram_whole(t):
    """AG7: all inner rows by depth."""
    return _whole(t).groupBy(F.length("path").alias("depth")).agg(F.count("*").alias("n"))


@query("strip_shallow_whole", f"select path, mask from ({_WHOLE}) where length(path) >= 2")
def strip_shallow_whole(t):
    """V3: all inner rows at least so deep."""
    return _whole(t).filter(F.length("path") >= 2)


@query("trie_audit_whole", f"with r as (select * from ({_WHOLE} union all {_LEAVES}) where substr(sha256(path), 1, 1) <> 'a' or path = ''), b as (select path || substr('0123456789abcdef', cast(i + 1 as int), 1) as path from r, range(0, 16) t(i) where (mask >> i::int) & 1 = 1) select 'dangling' as kind, path from b where path not in (select path from r) union all select 'orphan', path from r where path <> '' and path not in (select path from b)")
def trie_audit_whole(t):
    """Child bits without a row and rows without a parent at all depths, leaves included, after some rows were lost."""
    kept = _whole(t, leaves=True).filter("substr(sha2(path, 256), 1, 1) <> 'a' or path = ''")
    return audit.dangling_and_orphans(kept, 65)


@query("prefix_probe_whole", f"select o_orderkey, path, mask from ({_WHOLE}) r join (select o_orderkey, unnest(list_transform(range(0, 65), lambda d: substr(sha256(o_orderkey::varchar), 1, d))) as p from orders) on p = path")
def prefix_probe_whole(t):
    """The ancestors of every key, as deep as it has any."""
    return audit.own_ancestors(t.orders.select("o_orderkey", _hash("o_orderkey").alias("k")), "k")


@query("reachability_whole", f"with recursive r as (select * from ({_WHOLE} union all {_LEAVES})), e as (select substr(path, 1, length(path) - 1) as parent, path as child from r where path <> '' and substr(sha256(path), 1, 1) <> 'b'), w(node, level) as (select '', 0 union all select child, level + 1 from w join e on parent = node) select node, level::int as level from w")
def reachability_whole(t):
    """What is reached from the root down to the leaves along the edges that are left."""
    return audit.reached_paths(_whole(t, leaves=True).filter("path <> '' and substr(sha2(path, 256), 1, 1) <> 'b'"))


@query("route_by_depth_whole", f"select path, case when length(path) <= 1 then 'top' when length(path) <= 2 then 'mid' else 'fallback' end as family from ({_WHOLE})")
def route_by_depth_whole(t):
    """SNK5: column family of all inner rows by path length."""
    return _whole(t).select("path", F.expr("case when length(path) <= 1 then 'top' when length(path) <= 2 then 'mid' else 'fallback' end").alias("family"))


@query("zip_generators", "select c_custkey as i, c_name, s_name from customer join supplier on s_suppkey = c_custkey")
def zip_generators(t):
    """J11, GEN22: two generators aligned by index."""
    return t.customer.select(F.col("c_custkey").alias("i"), "c_name").join(t.supplier.select(F.col("s_suppkey").alias("i"), "s_name"), "i")


# --- aggregates, sets ------------------------------------------------------------------


@query("class_counters", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as slots, max(l_orderkey) as top, min(l_linenumber) as low from lineitem group by 1, 2")
def class_counters(t):
    """AG1, AG12: counters, extremes by class."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("slots"), F.max("l_orderkey").alias("top"), F.min("l_linenumber").alias("low"))


@query("u256_sum", "select o_custkey, printf('%064x', s) as total from (select o_custkey, sum(cast(o_orderkey as hugeint) * 1000000007) as s from orders group by 1)")
def u256_sum(t):
    """AG2: 256-bit sums in eight 32-bit limbs, one carry at the end."""
    from stateloom.functions.u256 import sum_u256

    rows = t.orders.select("o_custkey", pad32(F.unhex(F.lpad(F.hex((F.col("o_orderkey") * 1000000007).cast("bigint")), 16, "0"))).alias("v"))
    return sum_u256(rows, ["o_custkey"], "v").select("o_custkey", F.lower(F.hex("total")).alias("total"))


@query("code_dedup", "select sha256(text) as code_hash, min(doc_id) as first_doc, count(*) as uses from documents group by 1")
def code_dedup(t):
    """AG8, O7: distinct code by content."""
    return t.documents.groupBy(F.sha2("text", 256).alias("code_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses"))


@query("dup_first_index", "select doc_id, first_doc from (select doc_id, min(doc_id) over (partition by sha256(text)) as first_doc from documents) where doc_id > first_doc")
def dup_first_index(t):
    """AG9: later duplicates with the first index; aggregated before the join, so a hot value is one row."""
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "h").filter("doc_id > first_doc").select("doc_id", "first_doc")


@query("table_cardinalities", "select 'customer' as name, count(*) as n from customer union all select 'lineitem', count(*) from lineitem union all select 'orders', count(*) from orders union all select 'part', count(*) from part")
def table_cardinalities(t):
    """AG10, SRC13: rows by table."""
    counts = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("customer", "lineitem", "orders", "part")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("layered_union", "select origin, k from (select origin, k, row_number() over (partition by k order by p) as r from (select 'sys' as origin, 0 as p, n_nationkey::bigint as k from nation union all select 'spec', 1, s_suppkey from supplier union all select 'eoa', 2, c_custkey from customer)) where r = 1")
def layered_union(t):
    """SET2, SET3, SRC8: layers united, the earlier layer wins a key."""
    layers = [("sys", t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"))), ("spec", t.supplier.select(F.col("s_suppkey").alias("k"))), ("eoa", t.customer.select(F.col("c_custkey").alias("k")))]
    rows = None
    for p, (name, df) in enumerate(layers):
        df = df.select("k", F.lit(name).alias("origin"), F.lit(p).alias("p"))
        rows = df if rows is None else rows.unionByName(df)
    return rows.groupBy("k").agg(F.min_by("origin", "p").alias("origin"))


@query("corpus_decode", "select doc_id, length(text) as n, sha256(substr(text, 5, 40)) as member from documents")
def corpus_decode(t):
    """SRC9: members cut out by offset and length."""
    return t.documents.select("doc_id", F.char_length("text").cast("bigint").alias("n"), F.sha2(F.substring("text", 5, 40), 256).alias("member"))


@query("manifest_check", "select doc_id, sha256(text) = sha256(text || '') as verified from documents")
def manifest_check(t):
    """SRC10, SNK11: content against its recorded hash."""
    recorded = audit.record_hashes(t.documents, "doc_id", "text")
    return audit.verify_content(t.documents, recorded, "doc_id", "text")


@query("set_equality_whole", "select (select count(*) from (select o_custkey from orders except all select c_custkey from customer)) as only_left, (select count(*) from (select c_custkey from customer except all select o_custkey from orders)) as only_right")
def set_equality_whole(t):
    """SET4, V7: all orders and all customers compared as multisets."""
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    one = lambda df, n: df.agg(F.count("*").alias(n)).withColumn("j", F.lit(1))
    return one(a.exceptAll(b), "only_left").join(one(b.exceptAll(a), "only_right"), "j").drop("j")


@query("corpus_decode_whole", "with i as (select doc_id, unnest(range(0, length(text), 40)) as pos, length(text) as n from documents) select doc_id, pos, least(40, n - pos) as length, sha256(substr(text, pos + 1, least(40, n - pos))) as member from i join documents using (doc_id)")
def corpus_decode_whole(t):
    """SRC9: all members of the whole texts, cut out by a joined index of offsets and lengths."""
    n = F.char_length("text").cast("bigint")
    index = t.documents.filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(40).cast("bigint"))).alias("pos"))
    index = index.select("doc_id", "pos", F.least(F.lit(40).cast("bigint"), F.col("n") - F.col("pos")).alias("length"))
    cut = F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.col("length").cast("int"))
    return index.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "pos", "length", F.sha2(cut, 256).alias("member"))


# --- scalar codecs ---------------------------------------------------------------------


@query("hexprefix_encode", "select o_orderkey, case when n % 2 = 1 then '3' || substr(h, 1, n) else '20' || substr(h, 1, n) end as leaf, case when n % 2 = 1 then '1' || substr(h, 1, n) else '00' || substr(h, 1, n) end as ext from (select o_orderkey, sha256(o_orderkey::varchar) as h, cast(o_orderkey % 9 as int) as n from orders)")
def hexprefix_encode(t):
    """compact paths of leaves and extensions."""
    rows = t.orders.select("o_orderkey", F.expr("substr(sha2(cast(o_orderkey as string), 256), 1, cast(o_orderkey % 9 as int))").alias("p"))
    odd = F.length("p") % 2 == 1
    return rows.select("o_orderkey", F.concat(F.when(odd, "3").otherwise("20"), "p").alias("leaf"), F.concat(F.when(odd, "1").otherwise("00"), "p").alias("ext"))


@query("fixed_width", "select p_partkey, printf('%016x', p_partkey) as be, printf('%064x', p_partkey) as slot, printf('%08x%016x%032x', p_size, p_partkey, p_partkey * 1000) as basic from part")
def fixed_width(t):
    """fixed-width integers, padded slot keys, packed account fields."""
    basic = F.concat(F.lpad(F.hex(F.col("p_size").cast("bigint")), 8, "0"), F.lpad(F.hex("p_partkey"), 16, "0"), F.lpad(F.hex(F.col("p_partkey") * 1000), 32, "0"))
    return t.part.select("p_partkey", F.lower(F.hex(be8(F.col("p_partkey")))).alias("be"), F.lower(F.hex(pad32(be8(F.col("p_partkey"))))).alias("slot"), F.lower(basic).alias("basic"))


_COMPACT = "select c_custkey, cast(c_custkey % 1000 * 3700 as bigint) as nonce, cast(round(abs(c_acctbal) * 100) as bigint) as balance, case when c_custkey % 3 = 0 then sha256(c_custkey::varchar) end as code from customer"


@query(
    "compact_accounts",
    f"with a as ({_COMPACT}), x as (select *, case when nonce = 0 then '' else printf('%x', nonce) end as nx, case when balance = 0 then '' else printf('%x', balance) end as bx from a), "
    "e as (select *, repeat('0', cast(length(nx) % 2 as int)) || nx as n, repeat('0', cast(length(bx) % 2 as int)) || bx as b from x), "
    "h as (select *, cast(length(n) / 2 + 8 * length(b) + case when code is null then 0 else 1024 end as bigint) as head from e) "
    "select c_custkey, printf('%02x%02x', head % 256, head // 256) || n || b || coalesce(code, '') as record, nonce, b as balance, code as code_hash from h",
)
def compact_accounts(t):
    """F8, F9, SNK6: accounts as compact records, and the fields read back from them."""
    from stateloom.functions.codecs import compact_account, compact_account_fields

    balance = F.unhex(F.lpad(F.hex(F.round(F.abs("c_acctbal") * 100).cast("bigint")), 64, "0"))
    code = F.when(F.col("c_custkey") % 3 == 0, F.unhex(_hash("c_custkey")))
    rows = t.customer.select("c_custkey", compact_account(F.col("c_custkey") % 1000 * 3700, balance, code).alias("r"))
    low = lambda c: F.lower(F.hex(c))
    return rows.withColumn("f", compact_account_fields(F.col("r"))).select("c_custkey", low("r").alias("record"), "f.nonce", low("f.balance").alias("balance"), low("f.code_hash").alias("code_hash"))


@query("route_by_depth", f"select path, case when length(path) <= 1 then 'top' when length(path) <= 2 then 'mid' else 'fallback' end as family from ({_ROWS})")
def route_by_depth(t):
    """SNK5: column family by path length."""
    return _trie(t).select("path", F.expr("case when length(path) <= 1 then 'top' when length(path) <= 2 then 'mid' else 'fallback' end").alias("family"))


@query("static_vid", "select o_orderkey, lv, cast(1 + list_sum(list_transform(range(0, lv), lambda i: cast(16 ** i + cast('0x' || substr(h, cast(i + 1 as int), 1) as bigint) * 16 ** (lv - i - 1) as bigint))) as bigint) as vid from (select o_orderkey, sha256(o_orderkey::varchar) as h, 1 + o_orderkey % 6 as lv from orders)")
def static_vid(t):
    """vertex numbers by level and path."""
    rows = t.orders.select("o_orderkey", _hash("o_orderkey").alias("h"), (1 + F.pmod("o_orderkey", F.lit(6))).alias("lv"))
    vid = F.expr("aggregate(sequence(0, cast(lv as int) - 1), 1L, (a, i) -> a + cast(pow(16, i) as bigint) + cast(conv(substr(h, i + 1, 1), 16, 10) as bigint) * cast(pow(16, lv - i - 1) as bigint))")
    return rows.select("o_orderkey", "lv", vid.alias("vid"))


@query("sha_folding", "select p_partkey, sha256(p_name) as name_hash, case when length(p_name) < 32 then p_name else sha256(p_name) end as inlined from part")
def sha_folding(t):
    """hashed unless shorter than 32 bytes."""
    return t.part.select("p_partkey", F.sha2("p_name", 256).alias("name_hash"), F.when(F.length("p_name") < 32, F.col("p_name")).otherwise(F.sha2("p_name", 256)).alias("inlined"))


# --- Merkle folds ----------------------------------------------------------------------


def _rollup(rows: DataFrame, parent: str, key: str, digest: str) -> DataFrame:
    ordered_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, digest))), lambda s: s[digest]), "")
    return rows.groupBy(parent).agg(F.sha2(ordered_, 256).alias("root"))


@query("merkle_rollup", "with o as (select l_orderkey, sha256(string_agg(h, '' order by l_linenumber, h)) as root from (select l_orderkey, l_linenumber, sha256(l_orderkey::varchar || '-' || l_linenumber::varchar || '-' || l_partkey::varchar) as h from lineitem) group by 1), c as (select o_custkey, sha256(string_agg(root, '' order by o_orderkey)) as root from orders join o on l_orderkey = o_orderkey group by 1), n as (select c_nationkey, sha256(string_agg(root, '' order by c_custkey)) as root from customer join c on o_custkey = c_custkey group by 1) select n_name, root from n join nation on n_nationkey = c_nationkey")
def merkle_rollup(t):
    """AG3, AG4, O15: ordered folds of lines to orders, customers and nations."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", _hash("l_orderkey", "l_linenumber", "l_partkey").alias("h"))
    orders = t.orders.select("o_orderkey", "o_custkey").join(_rollup(lines, "l_orderkey", "l_linenumber", "h"), F.col("o_orderkey") == F.col("l_orderkey"))
    customers = t.customer.select("c_custkey", "c_nationkey").join(_rollup(orders, "o_custkey", "o_orderkey", "root"), F.col("c_custkey") == F.col("o_custkey"))
    nations = _rollup(customers, "c_nationkey", "c_custkey", "root")
    return t.nation.join(nations, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "root")


def _stems(t) -> DataFrame:
    return t.orders.select(F.unhex(F.substring(F.sha2(F.floor(F.col("o_orderkey") / 64).cast("string"), 256), 1, 62)).alias("stem"), F.pmod(F.col("o_orderkey") * 3, F.lit(256)).cast("int").alias("suffix"), F.unhex(_hash("o_custkey")).alias("value"))


@query("stem_bitmap", "select substr(sha256((o_orderkey // 64)::varchar), 1, 62) as stem, cast(bit_or(case when o_orderkey * 3 % 256 < 62 then 1::bigint << cast(o_orderkey * 3 % 256 as int) else 0 end) as bigint) as low_bits, count(distinct o_orderkey * 3 % 256) as n from orders group by 1")
def stem_bitmap(t):
    """AG6: suffix bitmaps of stems (the first word)."""
    bit = F.when(F.col("suffix") < 62, F.expr("shiftleft(1L, suffix)")).otherwise(F.lit(0).cast("bigint"))
    return _stems(t).groupBy(F.lower(F.hex("stem")).alias("stem")).agg(F.bit_or(bit).alias("low_bits"), F.countDistinct("suffix").alias("n"))


def _folded(name: str, k: str, levels: int, below: str, start: str) -> str:
    """SQL of SHA-256 folds of (keys, pos, h), one level at a time: a missing side is zeros, a missing pair nothing."""
    pair = "sha256(unhex(coalesce(max(case when pos % 2 = 0 then h end), repeat('00', 32)) || coalesce(max(case when pos % 2 = 1 then h end), repeat('00', 32))))"
    steps = [f"{name}{levels} as ({start})"]
    for i in range(levels - 1, -1, -1):
        steps.append(f"{name}{i} as (select {k}pos // 2 as pos, {pair} as h from {name}{i + 1} group by {k}pos // 2{below.format(i=i, shift=levels - i)})")
    return ", ".join(steps)


_STEM_SQL = (
    "leaf as (select distinct substr(sha256((o_orderkey // 64)::varchar), 1, 62) as stem, o_orderkey * 3 % 256 as pos, sha256(unhex(sha256(o_custkey::varchar))) as h from orders), "
    + _folded("s", "stem, ", 8, "", "select stem, pos, h from leaf")
    + ", stems as (select stem, n, sha256(unhex(stem || '00' || h)) as stem_hash from s0 join (select stem, count(*) as n from leaf group by 1) using (stem))"
)


@query("stem_hash", f"with {_STEM_SQL} select stem, n, stem_hash from stems")
def stem_hash(t):
    """AG4, T8: stems folded in eight rounds of built-in SHA-256."""
    return merkle.stem_hashes(_stems(t).dropDuplicates(["stem", "suffix"])).select(F.lower(F.hex("stem")).alias("stem"), "n", "stem_hash")


_PLACED_SQL = (
    "b as (select cast('0x' || substr(stem, 1, 10) as bigint) as v, stem_hash as h from stems), "
    "near as (select v, h, lag(v) over (order by v) as p, lead(v) over (order by v) as q from b), "
    "placed as materialized (select v, h, greatest(coalesce(40 - length(bin(xor(v, p))), -1), coalesce(40 - length(bin(xor(v, q))), -1)) + 1 as depth from near), "
    + _folded("t", "", 40, " union all select v >> {shift}, h from placed where depth = {i}", "select v as pos, h from placed where depth = 40")
)


@query("binary_root", f"with {_STEM_SQL}, {_PLACED_SQL} select h as root from t0")
def binary_root(t):
    """AG5, T8: root over all stems."""
    return merkle.binary_root(merkle.stem_hashes(_stems(t).dropDuplicates(["stem", "suffix"]))).select(F.lower(F.hex("root")).alias("root"))


@query("mpt_root")
def mpt_root(t):
    """AG3, T1-T7, J2: storage tries of all customers, spliced into one account trie."""
    from stateloom.plans.state import state_root

    storage = t.orders.select(be8(F.col("o_custkey")).alias("address"), pad32(be8(F.col("o_orderkey"))).alias("slot_key"), pad32(be8(F.round(F.col("o_totalprice") * 100).cast("bigint"))).alias("slot_value"))
    accounts = t.customer.select(be8(F.col("c_custkey")).alias("address"), F.col("c_custkey").alias("nonce"), F.unhex(F.hex("c_custkey")).alias("balance"), F.lit(None).cast("binary").alias("code"))
    return state_root(accounts, storage).select(F.lower(F.hex("root")).alias("root"), "n_leaves")


@query("keccak_slots")
def keccak_slots(t):
    """F1, F6, GEN15: mapping slots of holders."""
    return t.customer.select("c_custkey", F.lower(F.hex(keccak256(F.concat(pad32(be8(F.col("c_custkey"))), pad32(be8(F.lit(0))))))).alias("slot"))
