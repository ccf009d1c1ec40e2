"""Queries that do the whole job, on tables where a part of it would not show it all."""

import pytest

from stateloom.plans.catalog import QUERIES


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_anti_join_redraw_keeps_every_order(spark, folder):
    """All 4,096 short addresses are taken."""
    spark.range(60000).selectExpr("id as c_custkey").write.parquet(f"{folder}/customer.parquet")
    spark.range(500).selectExpr("id as o_orderkey").write.parquet(f"{folder}/orders.parquet")
    rows = QUERIES["anti_join_redraw"](spark, folder).collect()
    assert sorted(r.o_orderkey for r in rows) == list(range(500))
    assert {(r.attempt, len(r.address)) for r in rows} == {(8, 40)}


def test_redraw_ends_with_the_last_collision(spark):
    from stateloom.plans.generators import redraw

    taken = spark.createDataFrame([(x,) for x in "01234567"], "address string")
    rows = redraw(spark.range(20), "id", taken, 1).collect()
    assert sorted(r.id for r in rows) == list(range(20)) and {r.address for r in rows} <= set("89abcdef") and max(r.attempt for r in rows) > 0
    with pytest.raises(ValueError, match="taken"):
        redraw(spark.range(2), "id", spark.createDataFrame([(x,) for x in "0123456789abcdef"], "address string"), 1)


def test_op3_rejects_on_small_tables_with_production_parameters(spark):
    """Good documents outside the trusted sample stay, bad ones go."""
    import random

    from stateloom.llm.quality_rules import quality_rules

    rng = random.Random(1)
    text = lambda words: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, text(["river", "stone", "hill", "cloud", "rain"] if i < 60 else ["win", "cash", "now", "click", "free"])) for i in range(120)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long"))
    assert {r.doc_id for r in out.collect() if r.kept} == set(range(60))


def test_op7_notices_at_the_threshold_and_full_texts(spark):
    from stateloom.llm.licenses import TEMPLATES, Scanner, license_scan

    gpl = TEMPLATES.get("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.")
    rows = [(1, "Licensed under the MIT License"), (2, "file one. " + gpl + " import os"), (3, "under the license")]
    got = {r.doc_id: [(x.license, x.coverage) for x in r.found] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("MIT", 0.8)] and ("GPL-3.0-header", 1.0) in got[2] and got[3] == []
    for name, text in TEMPLATES.items():
        assert any(x[0] == name and x[1] == 1.0 for x in Scanner(TEMPLATES, 0.8, 0.5).scan(f"a b {text} c d")), name
    words = [f"w{i}" for i in range(35)]  # 0.8 * 35 is above 28 in floats
    assert Scanner({"x": " ".join(words)}, 0.8, 0.5).scan(" ".join(words[:28]))


def test_whole_trie_follows_long_common_prefixes(spark):
    """Two keys that differ in the last digit, two that share four, one alone; repeated keys count once."""
    from stateloom.operators.audit import dangling_and_orphans, whole_trie

    keys = ["a" * 64, "a" * 63 + "b", "c" * 64, "c" * 4 + "d" * 60, "0" * 64, "0" * 64]
    rows = whole_trie(spark.createDataFrame([(k,) for k in keys], "h string"), "h").collect()
    inner, leaves = {r.path: r.mask for r in rows if not r.leaf}, {r.path for r in rows if r.leaf}
    want = {"": 1 << 10 | 1 << 12 | 1} | {"a" * d: 1 << 10 for d in range(1, 63)} | {"a" * 63: 3 << 10} | {"c" * d: 1 << 12 for d in range(1, 4)} | {"c" * 4: 3 << 12}
    assert inner == want and leaves == {"a" * 64, "a" * 63 + "b", "ccccc", "ccccd", "0"} and len(rows) == len(want) + 5
    assert not dangling_and_orphans(spark.createDataFrame([(r.path, r.mask) for r in rows], "path string, mask int"), 65).collect()


def test_op10_proximity_finds_changed_passages(spark):
    """A word replaced or put in every nine words leaves no exact window; an unrelated text is not near."""
    from stateloom.llm.decontaminate import decontaminate, proximity

    words = [f"q{i}" for i in range(40)]
    replaced = ["zz" if i % 9 == 4 else w for i, w in enumerate(words)]
    added = [x for i, w in enumerate(words) for x in ([w, "zz"] if i % 9 == 4 else [w])]
    rows = [(1, replaced), (2, added), (3, words), (4, words[::5] * 4), (5, ["q1"]), (6, words[:8] + ["zz"] * 20 + words[8:16])]
    docs = spark.createDataFrame([(i, "x y " + " ".join(w) + " z") for i, w in rows] + [(7, None), (3, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "alpha beta"), (3, None)], "item_id long, text string")
    exact = {(r.doc_id, len(r.hits)) for r in decontaminate(docs, items).collect()}
    assert (1, 0) in exact and (2, 0) in exact and (3, 1) in exact
    got = sorted((r.doc_id, bool(r.near), r["items"]) for r in proximity(docs, items).collect())
    assert got == [(1, True, ["1"]), (2, True, ["1"]), (3, False, []), (3, True, ["1"]), (4, False, []), (5, False, []), (6, False, []), (7, False, [])]
    assert proximity(docs, items.limit(0)).filter("size(near) > 0").count() == 0 and proximity(docs.limit(0), items).count() == 0


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    """Equal rows, null ids, one id with two texts."""
    from corpus_pipeline import near_duplicate_stage

    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (7, text("c") + " x"), (7, text("d")), (9, None), (9, None), (None, "")]
    out = near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(1, text("a")), (None, text("b")), (5, text("c")), (7, text("d")), (9, None), (9, None), (None, "")]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_manifest_check_sees_changed_missing_and_added_content(spark):
    from stateloom.operators.audit import record_hashes, verify_content

    kept = spark.createDataFrame([(1, "a"), (2, "é"), (3, None), (4, "d")], "doc_id long, text string")
    now = spark.createDataFrame([(1, "a"), (2, "e"), (3, None), (5, "new")], "doc_id long, text string")
    got = {r.doc_id: r.verified for r in verify_content(now, record_hashes(kept, "doc_id", "text"), "doc_id", "text").collect()}
    assert got == {1: True, 2: False, 3: None, 4: False, 5: False}


def test_whole_comparison_and_decoding_leave_no_row_out(spark, folder):
    spark.range(1, 6).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(2, 5).selectExpr("id as c_custkey").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, "é" * 85), (2, "")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert tuple(QUERIES["set_equality_whole"](spark, folder).select("only_left", "only_right").first()) == (2, 0)
    assert sorted((r.doc_id, r.pos, r.length) for r in QUERIES["corpus_decode_whole"](spark, folder).collect()) == [(1, 0, 40), (1, 40, 40), (1, 80, 5)]
