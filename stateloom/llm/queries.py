"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The word-level vocabulary file of the public tokenizers; STATELOOM_TOKENIZER overrides the place."""
    if path := os.environ.get("STATELOOM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.bpe import bpe_decode, bpe_encode

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = tokenizer_path()
    both = bpe_decode(bpe_encode(docs, path).select("doc_id", "token_ids"), path)
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _only(kind: str):
    return lambda s: F.when(s["kind"] == kind, s["first"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.pii import PATTERNS, find_pii, rendered

    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.array_compact(F.transform("base", _only(kind)))).cast("bigint").alias(f"n_{kind}") for kind in PATTERNS]
    return out.select("doc_id", *counts, F.sha2(rendered("base").cast("binary"), 256).alias("base_sha256"), rendered("spans").alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.quality_rules import quality_rules

    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.jaccard_join import jaccard_classes

    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.quality_classifier import held_out, score_quality, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.lm_score import stupid_backoff

    out = stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_words", F.round(mean, 4).alias("mean_log_score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.licenses import license_scan

    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first"], x["last"])), ",").alias("spans"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.substring_dedup import substring_dedup

    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.line_dedup import line_dedup

    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), site="source")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.decontaminate import decontaminate

    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda acc, r: acc + (r["last"] - r["first"]))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stateloom.llm.decontaminate import proximity

    out = proximity(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", F.size("near").cast("bigint").alias("n_near"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("near") > 0).alias("near"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_OP6_LM_SCORE = f"""
with d as (select doc_id, {_WORDS} as w from documents),
t as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as k from d where len(w) > 0),
g as (select *, lag(w) over p as a, lag(w, 2) over p as b from t window p as (partition by doc_id order by k)),
c as (select doc_id, k, count(*) over (partition by w) - count(*) over (partition by doc_id, w) as r1,
  case when k >= 2 then count(*) over (partition by k >= 2, a, w) - count(*) over (partition by doc_id, k >= 2, a, w) end as r2,
  case when k >= 3 then count(*) over (partition by k >= 3, b, a, w) - count(*) over (partition by doc_id, k >= 3, b, a, w) end as r3,
  greatest(count(*) over () - count(*) over (partition by doc_id), 1) as rest from g),
x as (select *, lag(r1) over p as c1, lag(r2) over p as c2 from c window p as (partition by doc_id order by k)),
s1 as (select *, greatest(r1, 0.5::double) / rest as v1 from x),
s2 as (select *, case when k < 2 then v1 when r2 > 0 then r2::double / greatest(c1, 1) else 0.4::double * v1 end as v2 from s1),
s3 as (select *, case when k < 3 then v2 when r3 > 0 then r3::double / greatest(c2, 1) else 0.4::double * v2 end as v3 from s2),
m as (select doc_id, count(*) as n, sum(ln(v3)) as l from s3 group by 1)
select doc_id, coalesce(n, 0) as n_words, round(case when n > 0 then l / n else 0 end, 4) as mean_log_score from documents left join m using (doc_id)
"""

SQL_OP8_SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_WORDS} as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 18)) as i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as g from d where len(w) >= 20),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as n from p) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + 20)) as k from r),
t as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as k from d),
o as (select t.doc_id, count(c.k) as gone, string_agg(case when c.k is null then w end, ' ' order by t.k) as kept from t left join c on c.doc_id = t.doc_id and c.k = t.k group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join o on o.doc_id = d.doc_id
"""

SQL_OP9_LINE_DEDUP = r"""
with l as (select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as k from documents),
b as (select line from l where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 group by 1 having count(distinct source) >= 10)
select doc_id, count(*) as n_lines, count(b.line) as n_removed, sha256(coalesce(string_agg(case when b.line is null then l.line end, chr(10) order by k), '')) as kept_sha256
from l left join b on l.line = b.line group by 1
"""

SQL_OP10_DECONTAMINATE = f"""
with i as (select item_id, {_FOLDED} as w from benchmark),
f as (select item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda j: array_to_string(w[j:j + 9], ' '))) as g from i where len(w) > 0),
d as (select doc_id, {_FOLDED} as w from documents),
p as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as j, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) as g from d, (select distinct n from f) where len(w) >= n),
h as (select distinct doc_id, p.n, j, item_id from p join f on f.g = p.g and f.n = p.n),
k as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(j, j + n)) as x from (select distinct doc_id, n, j from h)) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join k on k.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""


def queries() -> dict[str, Query]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k.removeprefix("SQL_").lower(): v for k, v in globals().items() if k.startswith("SQL_OP")}
