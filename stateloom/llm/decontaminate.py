"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame functions.  Three passes over the corpus, none of which explodes
anything but tokens that the benchmark uses:

1. frequencies of the benchmark's own terms in the corpus;
2. postings (term, document, position) of each window's two rarest terms, kept
   as a table in the shared folder: the positional index;
3. offset-adjusted posting lists are intersected, rarest first, and the whole
   phrase is compared where both agree, so matches are exact.

A word is a maximal run of characters above U+007F, ASCII digits and letters,
with A-Z folded.  A window is ``length`` consecutive words of an item; a shorter
item is one window.  The term table is broadcast only while its measured size is
below ``broadcast_bytes``; beyond that Spark joins by shuffle.

``proximity`` is the other half: near matches, from the postings of three rare terms.

Defined cases: null and empty texts have no words and no windows; repeated items
count once per item_id, equal windows of several items hit all of them; repeated
document rows each get their own result; extra columns are ignored; an empty
benchmark leaves every document clean; an empty corpus gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stateloom.llm._text import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The largest term or window table that is sent to every executor.
BROADCAST_BYTES = 16 << 20


def words_of(text: str) -> Column:
    """The words of column ``text``; one alphabetic pass for ASCII texts, a character map for others."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BREAK, -1), "")


def windows_of(items: DataFrame, length: int) -> DataFrame:
    """window (its words joined), terms (array) and item_id of every distinct window of every item."""
    w = items.select("item_id", words_of("text").alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1)))
    spread = w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(length)).alias("terms"))
    return spread.select(F.array_join("terms", " ").alias("window"), "terms", F.col("item_id").cast("string").alias("item_id")).distinct()


def _sized(df: DataFrame, bytes_: int, limit: int) -> DataFrame:
    return F.broadcast(df) if bytes_ <= limit else df


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``docs`` with n_words, hits (sorted disjoint half-open word ranges) and items (sorted item_ids)."""
    outputs = ["n_words", "hits", "items"]
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in outputs]
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    text = "_row.text"
    no_ranges, no_items = F.expr("cast(array() as array<struct<first:int,last:int>>)"), F.expr("cast(array() as array<string>)")

    windows = written(windows_of(items, length).groupBy("window", "terms").agg(F.collect_set("item_id").alias("items")), "windows")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if not size:
        return base.select(*kept, F.size(words_of(text)).cast("bigint").alias("n_words"), no_ranges.alias("hits"), no_items.alias("items"))

    tokens = base.select(F.explode(words_of(text)).alias("term"))
    counts = tokens.join(_sized(terms, size, broadcast_bytes), "term").groupBy("term").agg(F.count("*").alias("n"))
    # A term that the corpus lacks is the rarest of all: its windows cannot occur.
    ranked = (
        windows.select("window", F.posexplode("terms").alias("offset", "term"))
        .join(counts, "term", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("n", "offset")))
        .filter("rank <= 2")
    )
    anchors = written(ranked.select("window", F.col("offset").cast("int").alias("offset"), "term", "n"), "anchors")
    alive = anchors.groupBy("window").agg(F.min("n").alias("least"), F.count("*").cast("int").alias("needed")).filter("least > 0").drop("least")
    anchors = anchors.drop("n").join(alive, "window")
    sought = anchors.select("term").distinct()

    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col("_row.doc_id"), F.lit(-1)))
    postings = base.select(key.alias("_key"), F.posexplode(words_of(text)).alias("position", "term")).join(_sized(sought, size, broadcast_bytes), "term")
    index = written(postings.select("term", "_key", "position").distinct(), "postings")

    many = windows.agg(F.sum(F.octet_length("window") + 40 * F.size("terms") + 40 * F.size("items"))).first()[0]
    adjusted = index.join(_sized(anchors, 2 * many, broadcast_bytes), "term").select("window", "needed", "_key", (F.col("position") - F.col("offset")).alias("start")).filter("start >= 0")
    agree = adjusted.groupBy("_key", "start", "window", "needed").agg(F.count("*").alias("n")).filter("n = needed").select("_key", "start", "window")
    found = agree.join(_sized(windows, many, broadcast_bytes), "window").groupBy("_key").agg(F.collect_list(F.struct("start", "terms", "items")).alias("_found"))

    # The words are an argument, not an outer column: Spark may inline columns into lambdas, once per element.
    exact = F.array_compact(F.zip_with("_found", F.array_repeat("_w", F.size("_found")), lambda c, w: F.when(F.slice(w, c["start"] + 1, F.size(c["terms"])) == c["terms"], c)))
    ranges = F.array_sort(F.array_distinct(F.transform("_hit", lambda c: F.struct(c["start"].alias("first"), (c["start"] + F.size(c["terms"])).alias("last")))))
    joined = lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= r["first"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], r["last"]).alias("last")))),
    ).otherwise(F.concat(acc, F.array(F.struct(r["first"].alias("first"), r["last"].alias("last")))))
    return (
        base.withColumn("_key", key)
        .join(found, "_key", "left")
        .withColumn("_w", words_of(text))
        .withColumn("_hit", F.when(F.col("_found").isNotNull(), exact))
        .withColumn("_ranges", F.when(F.size("_hit") > 0, ranges))
        .select(
            *kept,
            F.size("_w").cast("bigint").alias("n_words"),
            F.coalesce(F.when(F.col("_ranges").isNotNull(), F.aggregate("_ranges", no_ranges, joined)), no_ranges).alias("hits"),
            F.coalesce(F.when(F.size("_hit") > 0, F.array_sort(F.array_distinct(F.flatten(F.transform("_hit", lambda c: c["items"]))))), no_items).alias("items"),
        )
    )


def proximity(docs: DataFrame, items: DataFrame, length: int = 10, slack: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, near (sorted distinct half-open word ranges) and items (sorted item_ids) of every row of ``docs``.

    A window is near at a stretch of its length and up to ``3 * slack`` words more
    if the stretch has all its distinct terms, or all but one if there are five or more.
    Of three rare terms two are left then, and their offset-adjusted positions differ by
    ``slack`` at most while no more words are put in or taken out between them: such
    postings are neighbours in a document's list, sorted by window and start.
    """
    base = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(-1))).alias("_key"))
    windows = written(windows_of(items, length).groupBy("window", "terms").agg(F.collect_set("item_id").alias("items")).withColumn("window", F.xxhash64("window")), "windows")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    many = windows.agg(F.sum(40 * F.size("terms") + 40 * F.size("items"))).first()[0] or 0
    counts = base.select(F.explode(words_of("text")).alias("term")).join(_sized(terms, size, broadcast_bytes), "term").groupBy("term").agg(F.count("*").alias("n"))
    places = windows.select("window", F.posexplode("terms").alias("offset", "term"), F.size(F.array_distinct("terms")).alias("distinct"))
    once = places.groupBy("window", "term", "distinct").agg(F.collect_list("offset").alias("offsets"))
    ranked = once.join(counts, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "term"))).filter("rank <= 3")
    bit = F.pow(F.lit(2), F.col("rank") - 1).cast("int")
    anchors = written(ranked.select("window", "term", bit.alias("bit"), (F.col("distinct") == 1).alias("single"), F.explode("offsets").alias("offset")), "anchors")
    sought = anchors.select("term").distinct()
    index = written(base.select("_key", F.posexplode(words_of("text")).alias("position", "term")).join(_sized(sought, size, broadcast_bytes), "term").distinct(), "postings")

    # Dealt by document before the join, so the longer lists behind it are not shuffled.
    starts = index.repartition("_key").join(_sized(anchors, 2 * many, broadcast_bytes), "term").select("_key", F.struct("window", (F.col("position") - F.col("offset")).alias("start"), "bit", "single").alias("s"))
    lists = starts.groupBy("_key").agg(F.array_sort(F.collect_list("s")).alias("a"))
    pair = lambda x, y: F.when(x["single"], F.struct(x["window"].alias("window"), x["start"].alias("low"), x["start"].alias("high"))).when(
        (x["window"] == y["window"]) & (x["bit"] != y["bit"]) & (y["start"] - x["start"] <= slack), F.struct(x["window"].alias("window"), x["start"].alias("low"), y["start"].alias("high"))
    )
    met = lists.select("_key", F.explode(F.array_distinct(F.array_compact(F.zip_with("a", F.slice("a", F.lit(2), F.size("a")), pair)))).alias("m"))
    places = met.select("_key", "m.window", F.greatest(F.col("m.low") - slack, F.lit(0)).cast("int").alias("first"), (F.col("m.high") + slack).cast("int").alias("high"))
    found = places.join(_sized(windows, many, broadcast_bytes), "window").groupBy("_key").agg(F.collect_list(F.struct("first", (F.col("high") + F.size("terms")).alias("last"), F.array_distinct("terms").alias("terms"), "items")).alias("_found"))
    least = lambda c: F.size(c["terms"]) - F.when(F.size(c["terms"]) >= 5, 1).otherwise(0)
    held = lambda c, w: F.size(F.array_intersect(F.slice(w, c["first"] + 1, c["last"] - c["first"]), c["terms"])) >= least(c)
    near = F.array_compact(F.zip_with("_found", F.array_repeat("_w", F.size("_found")), lambda c, w: F.when(held(c, w), F.struct(c["first"].alias("first"), F.least(c["last"], F.size(w)).alias("last"), c["items"].alias("items")))))
    none = F.expr("cast(array() as array<struct<first:int,last:int,items:array<string>>>)")
    out = base.join(found, "_key", "left").withColumn("_w", words_of("text")).withColumn("_near", F.coalesce(F.when(F.col("_found").isNotNull(), near), none))
    return out.select(
        "doc_id",
        F.array_sort(F.array_distinct(F.transform("_near", lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"))))).alias("near"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_near", lambda c: c["items"])))).alias("items"),
    )
