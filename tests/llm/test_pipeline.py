"""Each stage of the pipeline against its plain version, on what its predecessor kept."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p


def data(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf):
    from stateloom.llm._text import written

    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in p.STAGES:
        docs.append(written(stage(spark, docs[-1], sf), name))
    return docs


def test_columns(stages):
    assert all(sorted(d.columns) == sorted(stages[0].columns) for d in stages[1:-1])
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "bpe"]


def test_quality_keeps_good_documents(spark, sf, stages):
    kept = set(data(stages[1]))
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_lines(stages):
    rows = [(r.doc_id, r.text, r.source) for r in data(stages[1]).values()]
    want = {i: t for i, _, _, t in brute.line_dedup(rows, 10, 3)}
    got = data(stages[2])
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in data(stages[2]).values()]
    want = {i for i, (_, c) in brute.classes(rows, 5, 80, 100).items() if c == i}
    assert set(data(stages[3])) == want


def test_decontamination(spark, sf, stages):
    rows = [(r.doc_id, r.text) for r in data(stages[3]).values()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(data(stages[4])) == {i for i, *_, hit in brute.decontaminate(rows, items, 10) if not hit}


def test_tokens_and_run(spark, sf, stages):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(p.tokenizer_path()), {i: r.text for i, r in data(stages[4]).items()}
    got = data(stages[5])
    assert set(got) == set(texts)
    assert all(r.n_tokens == len(library.encode(texts[i], add_special_tokens=False).ids) for i, r in got.items())
    assert p.run(spark, sf).exceptAll(stages[5]).count() == 0


def test_one_python_worker_a_task_tokenizes(spark, sf, tmp_path):
    from test_contracts import odd_docs

    from stateloom.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip

    odd_docs(spark, "decoded string, name string, n int").write.parquet(str(tmp_path / "odd"))
    docs, path = spark.read.parquet(str(tmp_path / "odd")), p.tokenizer_path()
    plan = p.tokenize_stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    want, got = bpe_decode(bpe_encode(docs, path), path).drop("text"), bpe_round_trip(docs, path)
    assert sorted(got.columns) == sorted(want.columns)
    assert got.count() == docs.count() and got.select(*want.columns).exceptAll(want).isEmpty()


def test_a_task_releases_what_it_freed():
    import re
    from pathlib import Path

    import numpy as np

    from stateloom.llm._text import trimmed

    def mb():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    pins = []

    @trimmed
    def run(batches):
        for n in batches:
            parts = [np.ones(12_000) for _ in range(n)]
            pins.append(np.ones(12_000))  # lies above the others, so free() alone gives nothing back
            yield mb(), len(parts)

    before = mb()
    (within, n), = run(iter([2000]))
    assert n == 2000 and within > before + 150 and mb() < before + 50


def test_nulls_pass_every_stage(spark, sf):
    from test_contracts import odd_docs

    docs = odd_docs(spark)
    for _, stage in p.STAGES:
        for df in (docs, docs.limit(0)):
            stage(spark, df, sf).select(F.count("*")).collect()
