"""Personal data: base patterns and bootstrapped contextual extraction.

Only DataFrame functions.  Base spans come from four patterns.  Their offsets
are computed in the row itself: the text is split at the matches and the lengths
of pieces and matches are summed, so nothing is shuffled for them.

Contextual extraction bootstraps from seed entities.  Texts are read as units: a
word, or up to six consecutive words with digits; a unit without its surrounding
punctuation is an instance.  Seeds are units that hold a base match or have one of
the ``SEED_SHAPES``.  The lexical patterns of an occurrence are its left word, its
two left words, its right word, and both neighbours.  In each round

1. the occurrences of accepted instances induce patterns; those with ``support``
   distinct instances go on;
2. their occurrences in all texts are listed by one scan, and their precision counted
   (occurrences of accepted instances against all); the occurrences of the precise
   ones are the edges of the pattern-instance graph;
3. the graph is scored to a fixed point: a pattern's confidence is the share of its
   distinct instances that are accepted, an instance's score the noisy-or of its
   patterns' confidences, and instances from ``accept`` on are accepted.

Newly accepted instances induce patterns in the next round; without any it ends.
Occurrences of accepted instances in precise patterns become spans of the kind
``context`` unless a base span holds them; base spans always stay.  Any unit
with a digit, an @ or a quotation mark or of twelve characters may be found.

Defined cases: null and empty texts have no spans; offsets are in code points,
ends exclusive; a pattern matches leftmost, non-overlapping, and a failing match
is dropped without retry; repeated rows give repeated results; an empty table
gives an empty result; extra columns are ignored; a null doc_id is kept as is, and
rows are known by id and text.  Patterns are possessive, so long runs of digits,
dots or letters take linear time and no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateloom.llm._text import written

#: The base patterns by kind, in their order.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without backtracking: an e-mail starts at the edge of its run of characters or where the last match ended.
_LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
#: A cheap test that every text with a match passes.
_NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Seeds besides the base kinds: long hexadecimal keys.
SEED_SHAPES = (r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}+$",)
_SEED_HINT = r"@|[0-9](?:[\x20().-]{0,3}[0-9]){3}|[0-9A-Fa-f]{32}"
#: Rounds of induction, score of accepted instances, least distinct instances and precision of a pattern, scoring steps at most.
ROUNDS, ACCEPT, SUPPORT, PRECISION, STEPS = 2, 0.8, 3, 0.5, 20
_DIGITS = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_UNIT = rf"{_DIGITS}(?:\x20{_DIGITS}){{0,5}}+|[^\x20\x09-\x0D]++"
#: Units that may be instances: with a digit, an @ or a quotation mark, or of twelve characters or more.
CANDIDATE = "[0-9@\"]|.{12}"
_EDGE = "\"'`()[]{}<>,.;:!?*#$%&|_~^\\/"
#: Offsets are summed in blocks of so many matches, so that work does not grow with the square of their number.
_BLOCK = 128
#: The most rows (patterns, instances or documents of some 24 bytes) that are broadcast.
SMALL_ROWS = 200_000
_SPAN = "array<struct<first:int,last:int,rank:int,kind:string,value:string>>"


def _spans(text: Column, pattern: str, rank: int, kind: str) -> Column:
    """All leftmost non-overlapping matches with their offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("m")))
    none, n = F.expr(f"cast(array() as {_SPAN})"), F.char_length

    def walk(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), none.alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + n(p["m"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + p["gap"]).alias("first"), (acc["at"] + p["gap"] + n(p["m"])).alias("last"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["m"].alias("value"))).alias("out"),
            ),
        )

    def step(acc: Column, i: Column) -> Column:
        block = walk(F.slice(acc["all"], i * _BLOCK + 1, F.lit(_BLOCK)), acc["at"])
        return F.struct(block["at"].alias("at"), F.concat(acc["out"], block["out"]).alias("out"), acc["all"].alias("all"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"))
    joined = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out"), pairs.alias("all")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > _BLOCK, joined).otherwise(walk(pairs, F.lit(0))["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.char_length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return acc + F.when(twice, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return n.between(12, 19) & (F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)) == 0)


def _octets(value: Column) -> Column:
    # Leading zeros aside, a part of more than three digits exceeds 255.
    small = lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= 3
    return F.forall(F.split(value, r"\."), lambda p: F.when(small(p), F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.when(F.char_length(_digits(value)).between(12, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base``, the base spans by start, then kind as listed."""
    out, t, none = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))), F.col("_t"), F.expr(f"cast(array() as {_SPAN})")
    for rank, kind in enumerate(PATTERNS):
        out = out.withColumn(f"_{kind}", F.when(t.rlike(_NEEDS[kind]), _spans(t, _LINEAR[kind], rank, kind)).otherwise(none))
    kept = [F.filter(f"_{kind}", _checked(kind)) for kind in PATTERNS]
    order = lambda s: F.struct(s["first"].alias("first"), s["rank"].alias("rank"), s["last"].alias("last"), s["kind"].alias("kind"), s["value"].alias("value"))
    return out.withColumn("_base", F.array_sort(F.transform(F.concat(*kept), order))).drop("_t", *(f"_{k}" for k in PATTERNS))


def _core(unit: Column) -> Column:
    return F.btrim(unit, F.lit(_EDGE))


def _word(unit: Column) -> Column:
    """A context word: lower case, digits alike, without punctuation around it unless it has nothing else."""
    bare = F.translate(F.lower(_core(unit)), "0123456789", "9" * 10)
    return F.when(bare == "", unit).otherwise(bare)


def _is_seed(core: Column) -> Column:
    held = lambda kind: _valid(kind, F.regexp_extract(core, _LINEAR[kind], 0))
    found = [F.when(core.rlike(_NEEDS[kind]), F.when(core.rlike(_LINEAR[kind]), held(kind)).otherwise(F.lit(False))).otherwise(F.lit(False)) for kind in PATTERNS]
    seed = F.lit(False)
    for one in [*found, *(core.rlike(x) for x in SEED_SHAPES)]:
        seed = seed | one
    return F.when(core.rlike(_SEED_HINT), seed).otherwise(F.lit(False))


def occurrences(docs: DataFrame, key: list[str], seeds_only: bool = False) -> DataFrame:
    """key, at (index of the unit), instance, seed and patterns (hashes of its contexts) of every unit."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.filter(text.rlike(_SEED_HINT)) if seeds_only else docs
    rows = rows.select(*key, F.regexp_extract_all(text, F.lit(_UNIT), F.lit(0)).alias("_u")).filter(F.size("_u") > 0)
    n, gap = F.size("_u"), F.array(F.lit(""))
    back = lambda k: F.slice(F.concat(*[gap] * k, F.col("_u")), F.lit(1), n)
    zipped = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("at"), F.col("_u").alias("u"), back(1).alias("l1"), back(2).alias("l2"), F.slice(F.concat(F.col("_u"), gap), F.lit(2), n).alias("r1"))
    rows = rows.select(*key, F.explode(F.filter(zipped, lambda s: s["u"].rlike(CANDIDATE))).alias("s")).select(*key, "s.*")
    rows = rows.select(*key, "at", _core(F.col("u")).alias("instance"), *(_word(F.col(c)).alias(c) for c in ("l1", "l2", "r1"))).filter(F.char_length("instance") >= 4)
    patterns = F.array(F.xxhash64(F.lit(1), "l1"), F.xxhash64(F.lit(2), "l2", "l1"), F.xxhash64(F.lit(3), "r1"), F.xxhash64(F.lit(4), "l1", "r1"))
    rows = rows.select(*key, "at", "instance", _is_seed(F.col("instance")).alias("seed"), patterns.alias("patterns"))
    return rows.filter("seed") if seeds_only else rows


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def bootstrap(edges: DataFrame, accept: float = ACCEPT, support: int = SUPPORT, precision: float = PRECISION) -> DataFrame:
    """instance, score of the instances accepted beyond the seeds; edges: distinct (instance, pattern, seed)."""
    accepted = edges.filter("seed").select("instance").distinct().withColumn("score", F.lit(1.0))
    size = accepted.count()
    for _ in range(STEPS):
        marked = edges.join(accepted.select("instance", F.lit(1).alias("hit")), "instance", "left")
        patterns = (
            marked.groupBy("pattern")
            .agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
            .filter(f"hits >= {support}")
            .select("pattern", (F.col("hits") / (F.col("n") + 1)).alias("confidence"))
            .filter(F.col("confidence") >= precision)
        )
        scored = edges.filter(~F.col("seed")).join(patterns, "pattern").groupBy("instance").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))), 9).alias("score"))
        fresh = scored.filter(F.col("score") >= accept)
        accepted = written(accepted.unionByName(fresh).groupBy("instance").agg(F.max("score").alias("score")), "accepted")
        before, size = size, accepted.count()
        if size == before:
            break
    return accepted.join(edges.filter("seed").select("instance").distinct(), "instance", "left_anti")


def contextual(docs: DataFrame, key: list[str], rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT, precision: float = PRECISION) -> DataFrame:
    """key, at of every occurrence of an accepted instance in a precise pattern."""
    by_pattern = lambda df: df.select("*", F.explode("patterns").alias("pattern")).drop("patterns")
    edges = known = None
    for _ in range(rounds):
        if known is None:
            held = by_pattern(occurrences(docs, key, seeds_only=True))
        else:
            held = by_pattern(occurrences(docs, key).join(_small(known.select("instance")), "instance"))
        induced = held.groupBy("pattern", "instance").count().groupBy("pattern").agg(F.count("*").alias("n")).filter(f"n >= {support}").select("pattern")
        induced = written(induced, "induced")
        met = written(by_pattern(occurrences(docs, key)).join(_small(induced), "pattern"), "met")
        known_here = met.withColumn("known", F.lit(False)) if known is None else met.join(_small(known.select("instance", F.lit(True).alias("known"))), "instance", "left")
        counted = known_here.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(F.col("seed") | F.coalesce("known", F.lit(False))).alias("hits"))
        precise = written(counted.filter(F.col("hits") >= precision * (F.col("n") + 1)).select("pattern"), "precise")
        listed = written(met.join(_small(precise), "pattern"), "edges")
        edges = listed if edges is None else written(edges.unionByName(listed).distinct(), "edges")
        graph = written(edges.groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "graph")
        fresh = bootstrap(graph, accept, support, precision)
        new = written(fresh if known is None else fresh.join(known, "instance", "left_anti"), "known")
        known = new if known is None else written(known.unionByName(new), "known")
        if new.isEmpty():
            break
    scored = graph.filter("seed").select("instance").unionByName(known.select("instance")).distinct()
    return edges.join(scored, "instance").select(*key, "at").distinct()


def find_pii(docs: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT, precision: float = PRECISION) -> DataFrame:
    """doc_id, base and spans (arrays of struct<first, rank, last, kind, value>) of every row of ``docs``."""
    key = ["_id", "_hash"]
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("_hash"))
    found = written(contextual(keyed.select(*key, "text"), key, rounds, accept, support, precision), "found")
    # Offsets are computed for the texts with occurrences alone.
    t = F.coalesce(F.col("text"), F.lit(""))
    units = keyed.select(*key, "text").join(_small(found.select(*key).distinct()), key).dropDuplicates(key).select(*key, _spans(t, _UNIT, len(PATTERNS), "context").alias("_units"))
    units = units.select(*key, F.posexplode("_units").alias("at", "s")).join(_small(found), [*key, "at"])
    left = F.char_length("s.value") - F.char_length(F.ltrim(F.col("s.value"), F.lit(_EDGE)))
    span = F.struct((F.col("s.first") + left).alias("first"), F.col("s.rank").alias("rank"), (F.col("s.first") + left + F.char_length(_core(F.col("s.value")))).alias("last"), F.col("s.kind").alias("kind"), _core(F.col("s.value")).alias("value"))
    extra = units.groupBy(*key).agg(F.collect_set(span).alias("_extra"))
    # Only the spans travel to the join, not the texts.
    slim = base_spans(keyed).select("doc_id", *key, "_base").join(extra, key, "left")
    free = lambda x, all_: ~F.exists(all_, lambda b: (b["first"] <= x["first"]) & (b["last"] >= x["last"]))
    return slim.select("doc_id", F.col("_base").alias("base"), F.when(F.col("_extra").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", F.filter("_extra", lambda x: free(x, F.col("_base")))))).alias("spans"))


def rendered(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")
