"""Line dedup by distinct-site spread.

A line that stands on ``min_sites`` distinct sites or more is cross-site
boilerplate and goes, in every document.  Lines are counted first (a line on k
sites occurs k times at least), so only lines that occur ``min_sites`` times or
more get a HyperLogLog sketch of their sites; sketches merge by aggregation, so
a line that a third of all rows share is one partial sketch a task.  A line whose
estimate is within ``margin`` of the threshold gets an exact distinct count.

Lines are told apart by a 64-bit hash and their length; lines with fewer than
``min_words`` words are never boilerplate.

Defined cases: null and empty texts are one empty line, which stays; a null site
is no site; repeated rows are treated alike; an empty table gives an empty
result; extra columns pass through, also those named like helper columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateloom.llm._text import written

#: Production parameters.
MIN_SITES, MIN_WORDS, MARGIN = 10, 3, 0.15
BROADCAST_BYTES = 16 << 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _name(line: Column) -> Column:
    return F.xxhash64(line, F.char_length(line))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows * 16 <= BROADCAST_BYTES else df


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, margin: float = MARGIN) -> DataFrame:
    """name of every line on ``min_sites`` sites or more."""
    long_enough = rf"^[ \t-\r]*[^ \t-\r]+([ \t-\r]+[^ \t-\r]+){{{min_words - 1}}}"
    lines = docs.select(F.col(site).alias("site"), F.explode(_lines(F.col("text"))).alias("line")).filter(F.col("line").rlike(long_enough)).select("site", _name(F.col("line")).alias("name"))
    often = lines.groupBy("name").agg(F.count("site").alias("n")).filter(f"n >= {min_sites}").select("name")
    often = written(often, "often")
    spread = lines.filter("site is not null").join(_sized(often, often.count()), "name")
    sketched = written(spread.groupBy("name").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(12))).alias("sites")), "sketched")
    sure = sketched.filter(F.col("sites") > min_sites * (1 + margin)).select("name")
    near = sketched.filter(F.abs(F.col("sites") - min_sites) <= min_sites * margin).select("name")
    exact = spread.join(_sized(near, near.count()), "name").groupBy("name", "site").count().groupBy("name").agg(F.count("*").alias("n")).filter(f"n >= {min_sites}").select("name")
    return written(sure.unionByName(exact), "boilerplate")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, margin: float = MARGIN) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_removed."""
    found = boilerplate(docs, site, min_sites, min_words, margin)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    key = [F.coalesce(F.col("_row.doc_id").cast("bigint"), F.lit(-1)).alias("_id"), F.xxhash64(F.coalesce(F.col("_row.text"), F.lit(""))).alias("_hash")]
    named = rows.select(*key, F.explode(F.array_distinct(F.transform(_lines(F.col("_row.text")), _name))).alias("name"))
    bad = named.join(_sized(found, found.count()), "name").groupBy("_id", "_hash").agg(F.collect_set("name").alias("_bad"))
    lines = _lines(F.col("_row.text"))
    stay = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda line: ~F.array_contains("_bad", _name(line))))
    out = rows.select("_row", *key).join(bad, ["_id", "_hash"], "left").withColumn("_stay", stay)
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    n = F.size(lines)
    text = F.when(F.size("_stay") < n, F.array_join("_stay", "\n")).otherwise(F.col("_row.text"))
    both = out.select(*kept, text.alias("text"), n.cast("bigint").alias("n_lines"), (n - F.size("_stay")).cast("bigint").alias("n_removed"))
    return both.select(*docs.columns, *[c for c in ("n_lines", "n_removed") if c not in docs.columns])
