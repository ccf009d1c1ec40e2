"""Quality rules: per-document counts and a hashed n-gram log-likelihood ratio.

Only DataFrame functions.  Two multinomials over ``buckets`` hashed word bigrams
(a text of one word: that word) are counted over all documents: one over the
trusted documents, one over the raw corpus.  A document's score is the mean over
its n-grams of log p_trusted(bucket) - log p_raw(bucket); it is kept if the score
reaches ``threshold``.  The raw counts are scaled to the trusted total and both
sides take the same ``prior`` per bucket, so a bucket of few observations says
little, and one that is common in the corpus and rare in the trusted documents
counts against a text however small the tables are.  The weights have
one entry per bucket whatever the input, so they travel as a constant array, and
each document is scored in its own row: the only shuffle is the bucket count.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D.
Defined cases: null and empty texts have no words, fail the base rules and score
0; without trusted documents every score is 0 (both multinomials alike); rows
with a null id are never trusted; repeated rows count as often as they occur; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = r"[#*$%&|<>]"
#: Production parameters: hashed buckets, prior observations a bucket, and the least mean log-likelihood ratio per n-gram.
BUCKETS, PRIOR, THRESHOLD = 1 << 16, 8.0, -0.2
WINDOW = 8
#: The largest set of trusted ids (8 bytes each) that is sent to every executor.
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+", -1), "")


def _shifted(a: Column, by: int, n: Column) -> Column:
    return F.slice(a, F.lit(1 + by), n)


def _pairs(a: Column, step: int, n: Column) -> Column:
    """hash(a[i], a[i + step]) for the n starts i."""
    return F.zip_with(F.slice(a, F.lit(1), n), _shifted(a, step, n), lambda x, y: F.xxhash64(x, y))


def text_counts(docs: DataFrame, text: str = "text", keep_pairs: bool = False) -> DataFrame:
    """``docs`` with _words (``keep_pairs``: and _pairs), n_words, word_chars, n_symbols, n_dup_lines and _grams (hashes of all 8-word windows)."""
    n = F.col("n_words").cast("int")
    solid = lambda line: line.rlike(r"[^ \t-\r]")
    return (
        docs.withColumn("_words", words_of(F.col(text)))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", (F.size(F.split(F.coalesce(F.col(text), F.lit("")), SYMBOLS, -1)) - 1).cast("bigint"))
        .withColumn("_lines", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), solid))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .drop("_lines")
        .withColumn("_pairs", F.when(n > 1, _pairs(F.col("_words"), 1, n - 1)))
        .withColumn("_h4", F.when(n >= WINDOW, _pairs(F.col("_pairs"), 2, n - 3)))
        .withColumn("_grams", F.when(n >= WINDOW, _pairs(F.col("_h4"), 4, n - 7)))
        .drop("_h4", *([] if keep_pairs else ["_pairs"]))
    )


def with_repeats(counted: DataFrame) -> DataFrame:
    """Adds n_repeat_words: windows sorted by hash, positions of equal neighbours, covered lengths.

    Texts whose windows all differ are not sorted.  Lambdas see their arguments
    only, so nothing is computed per element even if Spark inlines the columns.
    """
    last = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    first = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    none = F.expr("cast(array() as array<int>)")
    twins = lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(none)
    order = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    covered = F.aggregate(F.zip_with(first("_twice"), last("_twice"), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda acc, x: acc + x)
    return (
        counted.withColumn("_order", order)
        .withColumn("_twice", F.array_sort(F.array_distinct(F.flatten(F.zip_with(first("_order"), last("_order"), twins)))))
        .withColumn("n_repeat_words", F.when(F.col("_order").isNotNull(), covered).otherwise(F.lit(0)).cast("bigint"))
        .drop("_order", "_twice")
    )


def _features(words: Column, pairs: Column) -> Column:
    """Hashes of the n-grams that are scored."""
    return F.when(F.size(words) > 1, pairs).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """The weight of each bucket, from all documents; ``trusted`` holds the doc_id of the target sample."""
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct()
    if ids.count() * 8 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    w = docs.select("doc_id", words_of(F.col("text")).alias("_w")).join(ids.withColumn("_t", F.lit(1)), "doc_id", "left")
    grams = w.select("_t", F.explode(_features(F.col("_w"), _pairs(F.col("_w"), 1, F.size("_w") - 1))).alias("h"))
    counts = grams.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.count("_t").alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for row in counts.collect():  # one row a bucket at most
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not sum(target):
        return [0.0] * buckets
    scale = sum(target) / sum(raw)  # what a bucket would hold if trusted documents were like the others
    return [math.log((t + prior) / (r * scale + prior)) for t, r in zip(target, raw, strict=True)]


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept of every row."""
    weights = bucket_weights(docs, trusted, buckets, prior)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")  # folded to one constant
    counted = with_repeats(text_counts(docs.select("doc_id", "text"), keep_pairs=True))
    score = F.aggregate("_f", F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(buckets)).cast("int"))) / F.size("_f")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.withColumn("_f", _features(F.col("_words"), F.col("_pairs")))
        .withColumn("score", F.when(F.size("_f") > 0, F.round(score, 6)).otherwise(F.lit(0.0)))
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
    )
