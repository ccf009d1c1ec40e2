"""The steps of the whole-trie queries against plain versions, on keys with long common prefixes, repeats and lone blocks, and the work their plans ask for."""

import random
import re

import pytest

from stateloom.operators import audit
from stateloom.plans.catalog import QUERIES

A, B = "a" * 64, "0123" + "f" * 60
ODD = [A, "a" * 63 + "b", "a" * 20 + "c" * 44, "c" * 64, "c" * 4 + "d" * 60, "0" * 64, B, "0123" + "e" * 60, "01" + "7" * 62, "01" + "7" * 61 + "8"]
rng = random.Random(5)
KEYS = {
    "none": (64, []),
    "one": (64, [B]),
    "one, repeated": (64, [B, B, B]),
    "odd, repeated": (64, ODD + ODD[:3]),
    "dense": (64, ["".join(rng.choice("0f") for _ in range(12)) + "".join(rng.choice("0123456789abcdef") for _ in range(52)) for _ in range(300)]),
    "short": (3, ["".join(rng.choice("0123456789abcdef") for _ in range(3)) for _ in range(90)]),
    "five digits": (5, ["".join(rng.choice("08") for _ in range(5)) for _ in range(12)]),
}


def plain_trie(keys):
    """path: mask of the inner rows, and the leaves."""
    found = {}
    for k in set(keys):
        for d in range(len(k)):
            found.setdefault(k[:d], set()).add(k)
    inner = {p: sum({1 << int(k[len(p)], 16) for k in ks}) for p, ks in found.items() if len(ks) > 1 or p == ""}
    return inner, [k[: 1 + max(d for d in range(len(k)) if k[:d] in inner)] for k in set(keys)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "id long, k string").repartition(3)


@pytest.fixture
def folder(tmp_path, spark):
    spark.range(700).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", KEYS)
def test_own_ancestors(spark, name):
    digits, keys = KEYS[name]
    inner, _ = plain_trie(keys)
    got = audit.own_ancestors(table(spark, keys), "k", digits)
    assert got.columns == ["id", "path", "mask"]
    assert sorted(map(tuple, got.collect())) == sorted((i, k[:d], inner[k[:d]]) for i, k in enumerate(keys) for d in range(digits) if k[:d] in inner)


def test_prefix_probe_whole_joins_blocks_alone(spark, folder):
    """65 prefixes of every key were made and joined by path, sent to all executors where the table was small on disk."""
    rows = QUERIES["prefix_probe_whole"](spark, folder)
    assert re.findall(r"Join \[(\w+)#", plan(rows)) == ["_b"]
    assert rows.filter("path = ''").count() == 700 and rows.filter("mask = 0").isEmpty()


@pytest.mark.parametrize("name", KEYS)
def test_whole_trie(spark, name):
    digits, keys = KEYS[name]
    inner, leaves = plain_trie(keys)
    rows = audit.whole_trie(table(spark, keys), "k", digits).collect()
    assert sorted((r.path, r.mask) for r in rows if not r.leaf) == sorted(inner.items())
    assert sorted((r.path, r.mask) for r in rows if r.leaf) == sorted((p, 0) for p in leaves)


def test_dangling_and_orphans_keeps_repeats(spark):
    """A named path without a row, a row that none names, both twice; what is as deep as ``depth`` is not asked for."""
    rows = [("", 1 << 15 | 1), ("", 1), ("f", 1 << 2), ("f2", 1), ("b", 1 << 3), ("b", 0)]
    got = audit.dangling_and_orphans(spark.createDataFrame(rows, "path string, mask int"), 3).collect()
    assert sorted(map(tuple, got)) == [("dangling", "0"), ("dangling", "0"), ("dangling", "b3"), ("orphan", "b"), ("orphan", "b")]


def test_trie_audit_whole_makes_the_trie_once(spark, folder):
    """Keys were put in order eight times, and rows joined to named children twice."""
    text = plan(QUERIES["trie_audit_whole"](spark, folder))
    assert "Join" not in text and len(re.findall(r"Exchange hashpartitioning\(_b#\d+, \d+\), REPARTITION", text)) == 1


@pytest.mark.parametrize("name", KEYS)
def test_reached_paths(spark, name):
    """As the walk level by level finds them, after some rows were lost."""
    inner, leaves = plain_trie(KEYS[name][1])
    paths = sorted(p for p in [*inner, *leaves] if p and hash_digit(p) not in "b3")
    want, level = [("", 0)], {""}
    while level:
        level = {p for p in paths if p[:-1] in level}
        want += [(p, len(p)) for p in level]
    rows = spark.createDataFrame([(p,) for p in paths + paths[:2]], "path string").repartition(3)
    assert sorted(map(tuple, audit.reached_paths(rows).collect())) == sorted(want)
    edges = rows.selectExpr("substr(path, 1, length(path) - 1) as parent", "path as child")
    if len(max(paths, default="")) < 20:
        from stateloom.operators.session import ensure_checkpoints

        ensure_checkpoints(spark)
        assert sorted(map(tuple, audit.reachable(edges.checkpoint(), spark.createDataFrame([("",)], "node string")).collect())) == sorted(want)


def hash_digit(path):
    import hashlib

    return hashlib.sha256(path.encode()).hexdigest()[0]


def test_reachability_whole_reads_the_edges_once(spark, folder):
    """All edges were joined anew on every level."""
    text = plan(QUERIES["reachability_whole"](spark, folder))
    assert "Join" not in text and "ExistingRDD" not in text and len(re.findall(r"Exchange hashpartitioning\(_b#\d+, \d+\), REPARTITION", text)) == 2
