"""Each operator against its plain version, on the small tables and on odd rows."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from stateloom.llm import queries as q

ODD = [None, "", " ", "\n\n", "x", "The THE the", "a b", "Ωmega ΣΑΣ é́ İ", "1.2.3.4 999.1.1.1 01.02.03.004 +1 (499) 555-6503 4111 1111 1111 1111 a@b.c a@b x@y.zz.w!", "*" * 50, "w " * 40, "line one two\n" * 5, "<|endoftext|> it's  don't <|x|>"]


def odd_docs(spark, extra="hits string, name string, n int"):
    """Nulls in every column, empty and repeated rows, a very long text, clashing extra columns."""
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(voc) for _ in range(30000))
    base = [" ".join(rng.choice(voc) for _ in range(n)) for n in (5, 12, 25, 60, 200, 600)]
    near = []
    for text in base:
        w = text.split()
        for change in (1, 2, 4, 9):
            v = list(w)
            for _ in range(min(change, len(v) // 4)):
                v[rng.randrange(len(v))] = "new" + str(rng.random())
            near.append(" ".join(v))
    texts = ODD + base + near + base[:3] + [long, long[:90000]] + [f"{base[4]} {i}" for i in range(30)]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 13}", len(t) if t else None, None, "name", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd_docs(spark).write.parquet(path)
    return spark.read.parquet(path)


def both(docs, odd):
    return [("small", docs), ("odd", odd), ("empty", odd.limit(0))]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_op1_equals_the_library(docs, odd):
    from tokenizers import Tokenizer

    from stateloom.llm.bpe import bpe_decode, bpe_encode

    path = q.tokenizer_path()
    library = Tokenizer.from_file(path)
    for _, df in both(docs, odd):
        for r in bpe_decode(bpe_encode(df, path), path).collect():
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert bytes(r.token_ids) == b"".join(x.to_bytes(4, "little") for x in want), r.text
            assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_op2_base_spans(docs, odd):
    from stateloom.llm.pii import find_pii

    for _, df in both(docs, odd):
        got = rows(find_pii(df).select("doc_id", F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])).alias("b")), "doc_id", "b")
        assert got == sorted(((i, [f"{k}:{s}:{e}" for k, s, e in brute.pii(t)]) for i, t in pairs(df)), key=str)


def test_op2_discovers_by_context(spark):
    """Seeds teach contexts; what stands there is found, with digits or without; other words, and contexts of little precision, are left alone."""
    from stateloom.llm.pii import find_pii

    rng = random.Random(2)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 14)))
    texts = [(i, f'{word()} {word()} token = "{key()}" {word()}') for i in range(20)]
    texts += [(100 + i, f"{word()} write to u{i}@x.org please") for i in range(12)]
    texts += [(200, f'{word()} TOKEN = "not-hexadecimal-at-all" {word()}'), (201, "write to somebody.at.home please"), (202, f'{word()} token = "s3cret!"!! x')]
    texts += [(300 + i, f"{word()} number {1000 + i} and {word()} extraordinarily {word()} the {key() if i == 0 else 'characteristically'}") for i in range(30)]
    out = {r.doc_id: {s.value for s in r.spans if s.kind == "context"} for r in find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[200] == {"not-hexadecimal-at-all"} and out[201] == {"somebody.at.home"} and out[202] == {"s3cret"}
    assert all(len(out[i]) == 1 for i in range(20)) and not any(out[i] for i in out if i >= 300 or 100 <= i < 112)


def test_op2_graph_scores(spark):
    from stateloom.llm.pii import bootstrap

    rng = random.Random(9)
    graph = {(f"i{rng.randrange(60)}", rng.randrange(12)) for _ in range(220)}
    seeds = {f"i{i}" for i in range(0, 60, 2) if i % 7}
    got = {r.instance: r.score for r in bootstrap(spark.createDataFrame([(i, p, i in seeds) for i, p in graph], "instance string, pattern long, seed boolean")).collect()}
    want = brute.bootstrap(graph, seeds, 0.8, 3, 0.5)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in got)


@pytest.mark.parametrize("run", ["7", "1.", "a", "x@y.z "])
def test_op2_long_runs(spark, run):
    """Two hundred thousand characters of one kind end within seconds, without recursion."""
    from stateloom.llm.pii import find_pii

    text = run * (100_000 // len(run))
    found = find_pii(spark.createDataFrame([(1, text + " a@b.c " + text)], "doc_id long, text string")).select(F.filter("base", lambda s: s["kind"] == "email").alias("e")).first()
    assert len(found.e) >= 1


def test_op3_counts(spark, docs, odd):
    from stateloom.llm.quality_rules import quality_rules

    trusted = spark.createDataFrame([(i,) for i in range(0, 200, 2)] + [(None,)], "doc_id long")
    for _, df in both(docs, odd):
        out = quality_rules(df, trusted)
        got = rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        want = [(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in pairs(df) for c in [brute.rule_counts(t)]]
        assert got == sorted(want, key=str)
        assert out.filter("kept and base_failed").count() == 0


def test_op3_verdict(spark):
    """Far from the trusted word use: rejected; near to it: kept."""
    from stateloom.llm.quality_rules import quality_rules

    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["river", "stone", "hill", "cloud", "rain"]) for _ in range(40))) for i in range(60)]
    bad = [(i, " ".join(rng.choice(["win", "cash", "now", "click", "free"]) for _ in range(40))) for i in range(60, 120)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    out = quality_rules(df, spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long"), threshold=0.0, prior=0.01)
    assert {r.doc_id for r in out.collect() if r.score >= 0} == set(range(60))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_op4_components(docs, odd, k, num):
    from stateloom.llm.jaccard_join import jaccard_classes

    for _, df in both(docs, odd):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, k=k, num=num, den=100).collect()}
        assert got == brute.classes(pairs(df), k, num, 100)


def test_op4_signatures_lose_no_link():
    """Random linked sets of all sizes share a signature."""
    import numpy as np

    from stateloom.llm.jaccard_join import Bands, signatures

    rng = np.random.default_rng(5)
    for num in (80, 90):
        bands = Bands(num, 100)
        bands.plan[bands.of(np.array([30]))[0]] = np.full(4, 2, np.int8)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            d = int(rng.integers(0, max(1, n // 4)))
            y = np.concatenate([x[: n - d // 2], rng.integers(0, 2**63, d - d // 2).astype(np.uint64)])
            union = len(set(x.tolist()) | set(y.tolist()))
            if 100 * len(set(x.tolist()) & set(y.tolist())) >= num * union and d:
                ptr = np.array([0, len(x), len(x) + len(y)])
                row, sig = signatures(bands, ptr, np.concatenate([x, y]))
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (num, n, d)


def test_op4_sketches_rule_out_no_link():
    """The parity distance never exceeds the differences, also where one sketch is folded."""
    import numpy as np

    from stateloom.llm.jaccard_join import _apart, sketches

    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 900))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)]))
        bits = sketches(np.array([0, len(x), len(x) + len(y)]), np.concatenate([x, y]), 80, 100)
        ends = np.cumsum([len(b) // 8 for b in bits])
        both = {"bits": np.frombuffer(b"".join(bits), np.uint64), "starts": np.array([0, ends[0]]), "ends": ends}
        assert _apart(both, np.array([0]), np.array([1]))[0] <= len(np.setxor1d(x, y))


def crowded_docs(spark, n=120):
    """One passage that all share, so that signatures crowd, pairs of near copies, and chains of small changes."""
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(30))
    texts = []
    for _ in range(n // 4):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([10, 30, 60]))]
        texts.append(f"{shared} {' '.join(own)}")
        changed = list(own)
        changed[rng.randrange(len(own))] = "x"
        texts += [f"{shared} {' '.join(changed)}", f"{shared} {' '.join(rng.sample(own, len(own)))}", f"{shared} {' '.join(changed[:-1])}"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_op4_crowded_signatures(spark):
    from stateloom.llm.jaccard_join import jaccard_classes

    df = crowded_docs(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, k=5, num=80, den=100, crowd=25, levels=1).collect()}
    assert got == brute.classes(pairs(df), 5, 80, 100)


def test_op4_repeated_and_null_ids(spark):
    from stateloom.llm.jaccard_join import jaccard_classes

    a, b = " ".join(f"t{i}" for i in range(60)), " ".join(f"u{i}" for i in range(40))
    rows_ = [(5, a), (5, b), (5, a), (None, a + " z"), (None, b), (None, "q r s t"), (7, a), (9, None), (None, None)]
    out = jaccard_classes(spark.createDataFrame(rows_, "doc_id long, text string"), k=3, num=90)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(5, 58, 5), (5, 38, 5), (5, 58, 5), (None, 59, 5), (None, 38, 5), (None, 2, None), (7, 58, 5), (9, 0, 9), (None, 0, None)], key=str)


def test_op4_allocation_is_least_cost():
    import itertools

    import numpy as np

    from stateloom.llm.jaccard_join import Bands

    bands = Bands(90, 100)
    band = int(bands.of(np.array([25]))[0])
    need = bands.segments(band)
    rng = np.random.default_rng(2)
    for _ in range(20):
        one, two = rng.random(need), rng.random(need) * 2
        bands.choose(band, one, two)
        cost = lambda plan, one=one, two=two: sum((0, a, b)[v] for v, a, b in zip(plan, one, two, strict=True))
        best = min(cost(p) for p in itertools.product((0, 1, 2), repeat=need) if sum(p) >= need)
        assert abs(cost(bands.plan[band]) - best) < 1e-9 and bands.plan[band].sum() >= need


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_random_graphs(spark, one_task):
    from stateloom.llm.jaccard_join import components

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(200, i) for i in range(201, 240)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_op5_held_out_accuracy(spark, sf):
    out = q.op5_quality_classifier(spark, sf.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    pairs_ = out.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    right = sum(r.predicted == r.quality for r in pairs_) / len(pairs_)
    good, bad = [r.score for r in pairs_ if r.quality], [r.score for r in pairs_ if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert right >= 0.85 and auc >= 0.85, (right, auc)


def test_op5_odd_rows(spark, odd):
    from stateloom.llm.quality_classifier import Machine, score_quality, train

    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    for df in (odd, odd.limit(0)):
        out = score_quality(df, train(df, labels))
        assert out.columns == [*odd.columns, "score", "predicted"] and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in score_quality(odd, train(odd, labels.limit(0))).collect()} and Machine().w0 == 0


def test_op6_scores(docs, odd):
    from stateloom.llm.lm_score import stupid_backoff

    for _, df in both(docs, odd):
        got = sorted((r.doc_id, r.n_words, round(r.log_score, 3)) for r in stupid_backoff(df).collect())
        data = pairs(df)
        want = sorted((i, n, round(s, 3)) for (i, _), (n, s) in zip(data, brute.backoff(data), strict=True))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 0.01 for a, b in zip(got, want, strict=True))


def test_op7_licenses(spark, docs, odd):
    from stateloom.llm.licenses import TEMPLATES, align, license_scan, words_of

    rows_ = [(1, TEMPLATES["MIT-text"]), (2, "x y " + TEMPLATES["MIT"] + "\n" + TEMPLATES["MIT"] + " z"), (3, "License the under 2.0"), (4, TEMPLATES["MIT-text"].replace("merge, publish", "weld")), (5, None)]
    got = {r.doc_id: [x.license for x in r.found] for r in license_scan(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT-text"], 2: ["MIT", "MIT"], 3: [], 4: ["MIT-text"], 5: []}
    assert align(list("abcde"), list("xbyd")) == [(1, 1), (3, 3)]
    for r in license_scan(docs).collect():
        text = docs.filter(F.col("doc_id") == r.doc_id).first().text if r.found else ""
        for x in r.found:
            assert len(set(words_of(text)[x.first : x.last]) & set(words_of(TEMPLATES[x.license]))) > 2
    found = {r.doc_id for r in license_scan(docs).collect() if r.found}
    plain = {i for i, t in pairs(docs) for name in list(TEMPLATES)[:4] if " ".join(words_of(TEMPLATES[name])) in " ".join(words_of(t or ""))}
    assert plain <= found
    assert license_scan(odd.limit(0)).count() == 0 and license_scan(odd).count() == odd.count()


def test_op8_windows(docs, odd):
    from stateloom.llm.substring_dedup import substring_dedup

    for _, df in both(docs, odd):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(df).collect()}
        assert got == brute.substring(pairs(df), 20)


def test_op8_repeated_and_null_ids(spark):
    from stateloom.llm.substring_dedup import substring_dedup

    text = " ".join(f"t{i}" for i in range(25))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text)], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.n_removed) for r in substring_dedup(df).collect()) == [(-1, 25), (5, 0), (5, 0), (9, 25)]


def test_op8_ids_with_different_texts(spark):
    from stateloom.llm.substring_dedup import substring_dedup

    a = " ".join(f"t{i}" for i in range(700))
    rows_ = [(1, a), (None, "z " + a), (None, "a b c"), (5, "q " + a), (5, "other words " + a[:200]), (5, None), (None, None)]
    out = substring_dedup(spark.createDataFrame(rows_, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted([(1, 700, 0), (None, 701, 700), (None, 3, 0), (5, 701, 700), (5, 2 + len(a[:200].split()), len(a[:200].split()) - 1), (5, 0, 0), (None, 0, 0)], key=str)


def test_op9_boilerplate(docs, odd):
    from stateloom.llm.line_dedup import line_dedup

    for name, df in both(docs, odd):
        sites = 3 if name == "odd" else 4
        data = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        got = rows(line_dedup(df, min_sites=sites).select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("t")), "*")
        assert got == sorted(brute.line_dedup(data, sites, 3), key=str)
        assert line_dedup(df, min_sites=sites).columns == [*df.columns, "n_lines", "n_removed"]


def test_op10_matches(spark, docs, odd, sf):
    from stateloom.llm.decontaminate import decontaminate

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    strange = spark.createDataFrame([(1, None), (2, ""), (3, "the"), (3, "the"), (40, "W1 w2"), (5, " ".join(f"w{i}" for i in range(30))), (6, "line one two line one two line one two line one two")], "item_id long, text string")
    for df, items in ((docs, bench), (odd, strange), (odd, strange.limit(0)), (odd.limit(0), bench)):
        out = decontaminate(df, items)
        n = F.aggregate("hits", F.lit(0), lambda a, r: a + (r["last"] - r["first"]))
        got = rows(out.select("doc_id", "n_words", n.alias("h"), F.size("items").alias("k"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("s"), (F.size("hits") > 0).alias("c")), "*")
        assert got == sorted(brute.decontaminate(pairs(df), [(r.item_id, r.text) for r in items.collect()], 10), key=str)


def test_queries_have_their_columns(spark, sf):
    for name, f in q.queries().items():
        df = f(spark, sf)
        assert df.count() == 200 and "doc_id" in df.columns, name
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
