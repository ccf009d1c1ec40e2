"""Plain versions of the operators, one row at a time."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACE.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pii(text):
    text, found = text or "", []
    for rank, (kind, pattern) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
                if not 12 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def bootstrap(graph, seeds, accept, support, precision):
    """{instance: score} of the accepted ones beyond the seeds; graph: {(instance, pattern)}."""
    accepted, size = {i: 1.0 for i, _ in graph if i in seeds}, -1
    while len(accepted) != size:
        size = len(accepted)
        sure = {}
        for p in {p for _, p in graph}:
            mine = [i for i, q in graph if q == p]
            hits = sum(i in accepted for i in mine)
            if hits >= support and hits / (len(mine) + 1) >= precision:
                sure[p] = hits / (len(mine) + 1)
        fresh = {}
        for i, p in graph:
            if i not in seeds and p in sure:
                fresh[i] = 1 - (1 - fresh.get(i, 0.0)) * (1 - sure[p])
        for i, x in fresh.items():
            if x >= accept:
                accepted[i] = max(x, accepted.get(i, 0.0))
    return {i: x for i, x in accepted.items() if i not in seeds}


def rule_counts(text):
    w = words(text)
    lines = [line for line in (text or "").split("\n") if SPACE.search(line)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def shingles(text, k):
    w = words(fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def classes(docs, k, num, den):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)}; ids are distinct."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring(docs, length):
    """[(doc_id, text)] -> {doc_id: (n_words, n_removed, kept)}; ids are distinct."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        stay = [True] * len(w)
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            if key in seen:
                stay[j : j + length] = [False] * length
            seen.add(key)
        out[i] = (len(w), stay.count(False), " ".join(x for x, y in zip(w, stay, strict=True) if y))
    return out


def decontaminate(docs, items, length):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(fold(t))
        for j in range(max(1, len(w) - length + 1)):
            if w:
                windows[tuple(w[j : j + length])].add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w = ALNUM.findall(fold(t))
        hit, names = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    names |= windows[key]
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def backoff(docs, order=3, factor=0.4):
    """[(n_words, log score)] of each row, counts without the row's own."""
    rows = [words(t) for _, t in docs]
    counts = [Counter(tuple(w[i : i + k]) for w in rows for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    out = []
    for w in rows:
        own = [Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
        rest = lambda g, own=own: counts[len(g) - 1][g] - own[len(g) - 1][g]
        size, total = max(sum(map(len, rows)) - len(w), 1), 0.0
        for i in range(len(w)):
            weight, k = 1.0, min(order, i + 1)
            while k > 1:
                g = tuple(w[i - k + 1 : i + 1])
                if rest(g) > 0:
                    break
                weight, k = weight * factor, k - 1
            g = tuple(w[i - k + 1 : i + 1])
            total += math.log(weight * (rest(g) / max(rest(g[:-1]), 1) if k > 1 else max(rest(g), 0.5) / size))
        out.append((len(w), total))
    return out


def line_dedup(docs, min_sites, min_words):
    """[(doc_id, text, site)] -> [(doc_id, n_lines, n_removed, text)]."""
    sites = defaultdict(set)
    for _, t, s in docs:
        for line in (t or "").split("\n"):
            if s is not None and len(words(line)) >= min_words:
                sites[line].add(s)
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(sites[x]) < min_sites]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out
