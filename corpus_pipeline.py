"""The corpus pipeline: quality classifier, line dedup, near duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  ``run`` writes each
stage's rows to the shared folder and reads them again, so a lost executor never
repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateloom.llm._text import written
from stateloom.llm.bpe import bpe_round_trip
from stateloom.llm.decontaminate import decontaminate
from stateloom.llm.jaccard_join import jaccard_classes
from stateloom.llm.line_dedup import line_dedup
from stateloom.llm.quality_classifier import score_quality, train
from stateloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, machine).filter("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; n_chars follows the text."""
    return line_dedup(docs, site="source").select(*[(F.char_length("text").cast("bigint").alias("n_chars") if c == "n_chars" else F.col(c)) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one of smallest id (null last): five-word shingles, Jaccard 0.8.

    Rows are known by id and text, so repeated and null ids are judged row by row;
    of equal rows of one id the least stays.  Texts without words are no duplicates.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    classes = jaccard_classes(keyed.select(F.col("_key").alias("doc_id"), "text"), k=5, num=80, den=100)
    rows = keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    members = classes.filter("n_shingles > 0").select(F.col("doc_id").alias("_key"), "component_id").distinct().join(rows, "_key")
    members = written(members.select("_key", "component_id", "doc_id", "n"), "members")
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("s")).select("component_id", F.col("s._key").alias("_stay"))
    judged = members.join(stays, "component_id")
    left = keyed.join(judged.filter("_key <> _stay").select("_key"), "_key", "left_anti")
    twice = judged.filter("_key = _stay and n > 1").select("_key")
    if not twice.isEmpty():
        one = left.join(twice, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("r"))
        return left.join(twice, "_key", "left_anti").select(*docs.columns).unionByName(one.select("r.*"))
    return left.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("hits") == 0).select(*docs.columns)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether decoding them gives back the tokens' text."""
    both = bpe_round_trip(docs.select("doc_id", "text"), tokenizer_path())
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", tokenize_stage),
]

#: The classifier and the tokenizer cannot be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}-{name}")
    return docs
