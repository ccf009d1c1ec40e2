"""N-gram Jaccard join by universe partitioning.

Two shingle sets link when ``den`` * intersection >= ``num`` * union.  Equal sets
form one class; classes are joined:

* Sets are dealt to size bands.  Linked sets of sizes x <= y differ in at most
  H = (x + y)(den - num) / (den + num) elements, and y <= x den / num, so for each
  band H is known.
* Each band hashes the universe into m segments.  A segment with allocation 1
  signs its subset (catches no difference), with allocation 2 also its
  one-deletion neighbourhood (catches one).  As the allocations of a band sum to
  at least H + 1, linked sets share a signature (pigeonhole): no link is lost.
* Segments that are empty in both sets say nothing.  A band therefore has a slack
  of spare segments, and a set signs its empty segments only if there are more of
  them than the slack: else the others suffice.
* Allocations are chosen by cost, a dynamic programme over signatures written and
  collisions met in each segment, measured on a sample of ``sample`` documents and
  carried on to all (collisions grow as the square); the sample changes the cost,
  never the result.
* A set signs for its own band and for each band below in which a smaller partner
  can lie.
* Members of a signature are compared with the signature's hub (a star).  What the
  links leave apart inside a signature is compared by size and by foldable parity
  sketches, both of which only rule out what cannot link; the few pairs left are
  compared exactly, each member with one partner first, then with more where it is
  still apart.  Signatures of more than ``crowd`` members are split: each
  member signs again by an independent partition of the universe, of which linked
  sets share a segment too, so no pairs of a hot signature are listed and no link
  is lost.  Components of the verified links are found in one task while these are
  few (counted), else by alternating large-star and small-star steps.

Defined cases: fewer words than a shingle make one shingle of the whole text;
null and empty texts have an empty set and link with nothing, not even each
other; ids that repeat share one class if their sets agree, else each row is
judged alone; a null id sorts last; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateloom.llm._text import inside, mix, ngram_hashes, partitions, row_of_words, signed, slices, small_batches, text_buffers, trimmed, word_hashes, written

_LAST = 2**63 - 1
BAND_RATIO, SAMPLE = 1.3, 2000
#: Weight of one colliding pair against one written signature, sets remembered by a task, and the longest text of the sample.
PAIR_COST, SEEN, SAMPLE_TEXT = 0.05, 100_000, 1 << 15
_ODD = 0x9E3779B97F4A7C15
#: The shortest parity sketch; pairs and bytes of sketches compared at once.
LEAST_BITS, COMPARE_PAIRS, COMPARE_BYTES, LISTED_PAIRS = 64, 1 << 19, 8 << 20, 1 << 14
#: Partners of a member that are compared in each step (None: all that are left).
PARTNERS = (1, None)
#: Members above which a signature is partitioned anew, and how often.
CROWD, LEVELS = 20_000, 2
#: The most links (16 bytes each) that one executor task unites, and the most rows of 24 bytes that are broadcast.
ONE_TASK, SMALL_ROWS = 1_000_000, 100_000


def shingle_sets(body: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the distinct k-word shingles of each text, sorted; a-z and A-Z are one."""
    w, woff = word_hashes(body, off, lower=True)
    counts = np.diff(woff)
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ptr = np.concatenate([[0], np.cumsum(size)])
    el = np.zeros(ptr[-1], np.uint64)
    if len(w) >= k:
        el[np.repeat(counts >= k, size)] = ngram_hashes(w, k)[inside(woff, k, len(w))]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            h = w[woff[short]]
            for j in range(1, n):
                h = mix(h * np.uint64(_ODD) + w[woff[short] + j])
            el[ptr[short]] = mix(h + np.uint64(n))
    for i in np.flatnonzero(size > 1).tolist():
        el[ptr[i] : ptr[i + 1]].sort()
    row = np.repeat(np.arange(len(counts)), size)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (el[1:] != el[:-1])
    return row[new], el[new]


def _totals(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def set_names(row: np.ndarray, el: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, name, second name) of each row's set: order-free 64-bit sums of mixed elements."""
    ptr = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(ptr).astype(np.uint64)
    return ptr, mix(_totals(mix(el ^ np.uint64(0xA5A5A5A5 + salt)), ptr) + size), mix(_totals(mix(el + np.uint64(_ODD)), ptr) ^ size)


def sketch_bits(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Parity bits of a set's sketch: a power of two, at least six times the differences of linked sets of that size."""
    least = np.maximum(6 * (2 * sizes * (den - num) // (den + num)), LEAST_BITS)
    return 1 << np.ceil(np.log2(least)).astype(np.int64)


def sketches(ptr: np.ndarray, el: np.ndarray, num: int, den: int) -> list[bytes]:
    """The parity sketch of each row's set.

    Two sets differ in at least as many elements as their parities do, so the
    parities rule out links without ever ruling out a true one.  A sketch of
    twice the bits folds to one of the same elements in half the bits.
    """
    sizes = np.diff(ptr)
    bits = sketch_bits(sizes, num, den)
    hashed, row = mix(el), np.repeat(np.arange(len(sizes)), sizes)
    out: list[bytes] = [b""] * len(sizes)
    for b in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == b)
        place = np.cumsum(bits == b) - 1
        use = bits[row] == b
        step = max(1, (8 << 20) // b)
        for i in range(0, len(rows), step):
            part = use & (row >= rows[i]) & (row <= rows[min(i + step, len(rows)) - 1]) if len(rows) > step else use
            m = min(step, len(rows) - i)
            odd = np.bincount((place[row[part]] - i) * b + (hashed[part] & np.uint64(b - 1)).astype(np.int64), minlength=m * b) & 1
            packed = np.packbits(odd.astype(np.uint8).reshape(m, b), axis=1)
            for r, x in zip(rows[i : i + m].tolist(), packed, strict=True):
                out[r] = x.tobytes()
    return out


class Bands:
    """The size bands: their segments and, once planned, the allocations."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        self.start = [1]
        while self.start[-1] <= largest:
            self.start.append(max(int(self.start[-1] * BAND_RATIO), self.start[-1] + 1))
        self.edges = np.array(self.start, np.int64)
        self.plan: dict[int, np.ndarray] = {}

    def differences(self, band: int) -> int:
        """H of the band: its smaller partner is below the next band's start."""
        x = self.start[band + 1] - 1
        return (x + x * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> int:
        """H + 1 and the slack: about the most empty segments that the band's smallest set has."""
        least = m = self.differences(band) + 1
        for _ in range(50):
            empty = m * np.exp(-self.start[band] / m)
            wanted = least + int(np.ceil(empty + 3 * np.sqrt(empty)))
            if wanted <= m:
                break
            m = wanted
        return m

    def allocation(self, band: int) -> np.ndarray:
        """No signatures where H is 0: such sets link only if equal, and equal sets are one class."""
        if band not in self.plan:
            self.plan[band] = np.ones(self.segments(band) if self.differences(band) else 0, np.int8)
        return self.plan[band]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def choose(self, band: int, cost1: np.ndarray, cost2: np.ndarray) -> None:
        """Least total cost with allocations summing to H + 1 and the slack at least."""
        need = self.segments(band)
        best = np.full(need + 2, np.inf)  # a least-cost plan never sums to more than need + 1
        best[0] = 0.0
        steps = []
        for c1, c2 in zip(cost1, cost2, strict=True):
            one = np.concatenate([[np.inf], best[:-1] + c1])
            two = np.concatenate([[np.inf, np.inf], best[:-2] + c2])
            steps.append(np.argmin([best, one, two], 0))
            best = np.min([best, one, two], 0)
        left, plan = need + int(best[need + 1] < best[need]), np.zeros(len(cost1), np.int8)
        for j in range(len(cost1) - 1, -1, -1):
            plan[j] = steps[j][left]
            left -= int(plan[j])
        self.plan[band] = plan


def _cells(band: int, m: int, ptr: np.ndarray, el: np.ndarray, rows: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each element, its value, sum of the values of each cell, whether it is empty); a cell is a segment of one of ``rows``."""
    lens = np.diff(ptr)[rows]
    at = np.repeat(ptr[rows] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
    h = mix(el[at] + np.uint64((band + 1 + (salt << 20)) * _ODD & (2**64 - 1)))
    cell = np.repeat(np.arange(len(rows)), lens) * m + ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    value, total = mix(h), np.zeros(len(rows) * m, np.uint64)
    np.add.at(total, cell, value)
    return cell, value, total, np.bincount(cell, minlength=len(rows) * m) == 0


def _tags(band: int, m: int) -> np.ndarray:
    return mix(np.arange(m, dtype=np.uint64) + np.uint64((band << 32) + 1))


def signatures(bands: Bands, ptr: np.ndarray, el: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every set, for its band and those below where a partner can lie; ``salt`` picks an independent partition."""
    sizes = np.diff(ptr)
    own = bands.of(np.maximum(sizes, 1))
    lowest = bands.of(np.maximum(-(-sizes * bands.num // bands.den), 1))  # of the smallest partner
    out_row, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for shift in range(int((own - lowest).max(initial=0)) + 1):
        band_of = own - shift
        use = (sizes > 0) & (band_of >= lowest)
        for band in np.unique(band_of[use]).tolist():
            plan = bands.allocation(band)
            if not (m := len(plan)):
                continue
            rows = np.flatnonzero(use & (band_of == band))
            cell, value, total, empty = _cells(band, m, ptr, el, rows, salt)
            tags, wanted, row_of = np.tile(_tags(band, m), len(rows)), np.tile(plan, len(rows)), np.repeat(rows, m)
            silent = (wanted == 1) & empty
            slack = int(plan.sum()) - bands.differences(band) - 1
            pick = (wanted > 0) & ~(silent & np.repeat(silent.reshape(-1, m).sum(1) <= slack, m))
            out_row.append(row_of[pick])
            out_sig.append(mix(total[pick] ^ tags[pick]))
            if (plan == 2).any():
                pick = wanted[cell] == 2
                c = cell[pick]
                out_row.append(row_of[c])
                out_sig.append(mix((total[c] - value[pick]) ^ tags[c]))
    return np.concatenate(out_row), np.concatenate(out_sig)


def segment_costs(bands: Bands, band: int, ptr: np.ndarray, el: np.ndarray, rows: np.ndarray, grow: float) -> tuple[np.ndarray, np.ndarray]:
    """Cost of allocations 1 and 2 to each segment: signatures grow as the documents do (``grow`` of the sample), colliding pairs as their square."""
    m = bands.segments(band)
    cell, value, total, empty = _cells(band, m, ptr, el, rows)
    slack = np.repeat(empty.reshape(-1, m).sum(1) <= m - bands.differences(band) - 1, m)
    tags, seg = np.tile(_tags(band, m), len(rows)), np.tile(np.arange(m), len(rows))

    def cost(sig: np.ndarray, of: np.ndarray) -> np.ndarray:
        _, first, n = np.unique(sig, return_index=True, return_counts=True)
        return grow * np.bincount(of, minlength=m) + PAIR_COST * grow**2 * np.bincount(of[first], n * (n - 1.0) / 2, m)

    one = ~(empty & slack)
    return cost(mix(total ^ tags)[one], seg[one]), cost(np.concatenate([mix(total ^ tags), mix((total[cell] - value) ^ tags[cell])]), np.concatenate([seg, cell % m]))


def _col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _col(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def _name_sets(k: int, num: int, den: int, salt: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = text_buffers(_col(batch, "text"))
            for i, j in slices(off):
                row, el = shingle_sets(body[off[i] : off[j]], off[i : j + 1] - off[i], k)
                ptr, name, second = set_names(row, el, j - i, salt)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [_col(part, "doc_id"), _col(part, "h"), signed(name), signed(second), pa.array(np.diff(ptr).astype(np.int64)), pa.array(sketches(ptr, el, num, den), pa.binary())],
                    names=["doc_id", "h", "name", "second", "n_shingles", "bits"],
                )

    return run


def _sign(k: int, bands: Bands, salt: int):
    """(signature, priority) rows; the priority is a reversible scramble of the set's name, so the first of a signature is its hub."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            body, off = text_buffers(_col(batch, "text"))
            for i, j in slices(off):
                row, el = shingle_sets(body[off[i] : off[j]], off[i : j + 1] - off[i], k)
                _, name, _ = set_names(row, el, j - i, salt)
                fresh = np.zeros(j - i, bool)
                for r, x in enumerate(name.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[r] = True
                if len(seen) > SEEN:
                    seen.clear()
                use = fresh[row]
                ptr = np.searchsorted(row[use], np.arange(j - i + 1))
                r, sig = signatures(bands, ptr, el[use])
                if len(r):
                    yield pa.RecordBatch.from_arrays([signed(sig), signed(name[r] * np.uint64(_ODD))], names=["sig", "priority"])

    return run


def _sign_again(k: int, bands: Bands, level: int):
    """(sig, node) rows: each signature the set is crowded in, combined with the set's signatures of an independent partition."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowd = _long(batch, "sig").view(np.uint64)
            for r, z in enumerate(_col(batch, "packed")):
                body = np.frombuffer(zlib.decompress(z.as_py()), np.uint8)
                el = shingle_sets(body, np.array([0, len(body)]), k)[1]
                sig = signatures(bands, np.array([0, len(el)]), el, salt=level)[1]
                if len(sig):
                    yield pa.RecordBatch.from_arrays([signed(mix(sig ^ mix(crowd[r : r + 1]))), pa.repeat(_col(batch, "node")[r], len(sig))], names=["sig", "node"])

    return run


_UNDO = np.uint64(pow(_ODD, -1, 2**64))


@trimmed
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, priority): (sig, hub, member) for every further member of a signature; one hub is kept between batches."""
    sig0 = hub0 = last0 = None
    for batch in batches:
        sig, pri = _long(batch, "sig"), _long(batch, "priority")
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        new[0] = sig0 is None or sig[0] != sig0
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        hub = np.where(which >= 0, pri[starts[np.maximum(which, 0)]] if len(starts) else 0, 0 if hub0 is None else hub0)
        before = np.concatenate([[0 if last0 is None else last0], pri[:-1]])
        member = ~new & (pri != before) & (pri != hub)
        sig0, hub0, last0 = sig[-1], hub[-1], pri[-1]
        if member.any():
            back = lambda x: signed(np.ascontiguousarray(x).view(np.uint64) * _UNDO)
            yield pa.RecordBatch.from_arrays([pa.array(sig[member]), back(hub[member]), back(pri[member])], names=["sig", "hub", "member"])


def _apart(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing parity bits of rows i and j; the longer sketch is folded to the length of the shorter."""
    out, words = np.zeros(len(i), np.int64), x["ends"] - x["starts"]
    i, j = np.where(words[i] <= words[j], i, j), np.where(words[i] <= words[j], j, i)
    for few, many in np.unique(np.column_stack([words[i], words[j]]), axis=0).tolist():
        which = np.flatnonzero((words[i] == few) & (words[j] == many))
        step = max(1, COMPARE_BYTES // (8 * many))
        for at in range(0, len(which), step):
            p = which[at : at + step]
            long = x["bits"][x["starts"][j[p]][:, None] + np.arange(many)]
            long = np.bitwise_xor.reduce(long.reshape(len(p), many // few, few), axis=1)
            out[p] = np.bitwise_count(long ^ x["bits"][x["starts"][i[p]][:, None] + np.arange(few)]).sum(1, dtype=np.int64)
    return out


def _cross(num: int, den: int, most: int | None):
    """Rows sorted by sig: sig and pairs of members with different roots that sizes and parities do not rule out; of a member's, the ``most`` first (None: all).

    A pair is listed by the smallest signature that both share, so once.  One
    signature is kept between batches.
    """

    def listed_here(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether no smaller signature holds both rows."""
        out = np.ones(len(i), bool)
        for a in range(0, len(i), LISTED_PAIRS):
            pair, value = [], []
            for rows in (i[a : a + LISTED_PAIRS], j[a : a + LISTED_PAIRS]):
                n = x["me"][rows] - x["ms"][rows]
                which = np.repeat(np.arange(len(rows)), n)
                sig = x["more"][np.repeat(x["ms"][rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                less = sig < x["sig"][rows][which]
                pair.append(which[less])
                value.append(sig[less])
            pair, value = np.concatenate(pair), np.concatenate(value)
            order = np.lexsort((value, pair))
            pair, value = pair[order], value[order]
            out[a + pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])]] = False
        return out

    def picked(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        one, other = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((mix(x["node"][other].view(np.uint64)), one))
        start = np.flatnonzero(np.diff(one[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
        return np.unique(order[rank < most] % len(i))

    def pairs(x: dict) -> Iterator[np.ndarray]:
        order = np.lexsort((x["size"], x["sig"]))
        sig, size = x["sig"][order], x["size"][order]
        group = np.cumsum(np.diff(sig, prepend=sig[0] - 1) != 0)
        key = (group << 40) + size
        many = np.searchsorted(key, (group << 40) + size * den // num, "right") - np.arange(len(sig)) - 1  # partners of a size that may link
        total = np.concatenate([[0], np.cumsum(many)])
        a = 0
        while a < len(sig):
            z = max(a + 1, int(np.searchsorted(total, total[a] + COMPARE_PAIRS, "right")) - 1)
            n = many[a:z]
            left = np.repeat(np.arange(a, z), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(total[a:z] - total[a], n)
            i, j = order[left], order[right]
            ok = x["root"][i] != x["root"][j]
            i, j = i[ok], j[ok]
            ok = _apart(x, i, j) * (den + num) <= (x["size"][i] + x["size"][j]) * (den - num)
            i, j = i[ok], j[ok]
            ok = listed_here(x, i, j)
            if ok.any():
                i, j = i[ok], j[ok]
                if most is not None:
                    take = picked(x, i, j)
                    i, j = i[take], j[take]
                yield np.column_stack([x["sig"][i], np.sort(np.column_stack([x["node"][i], x["node"][j]]), 1)])
            a = z

    flat = (("bits", "starts", "ends"), ("more", "ms", "me"))  # values of all rows, and where those of a row begin and end

    def joined(x: dict, y: dict) -> dict:
        out = {c: np.concatenate([x[c], y[c]]) for c in ("sig", "node", "root", "size")}
        for values, lo, hi in flat:
            out |= {values: np.concatenate([x[values], y[values]])} | {c: np.concatenate([x[c], y[c] + len(x[values])]) for c in (lo, hi)}
        return out

    def cut(x: dict, i: int, j: int) -> dict:
        out = {c: x[c][i:j] for c in ("sig", "node", "root", "size")}
        for values, lo, hi in flat:
            first, last = (int(x[lo][i]), int(x[hi][j - 1])) if i < j else (0, 0)
            out |= {values: x[values][first:last], lo: x[lo][i:j] - first, hi: x[hi][i:j] - first}
        return out

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: _long(batch, c) for c in ("sig", "node", "root", "size")}
            body, off = text_buffers(_col(batch, "bits"))
            x |= {"bits": np.frombuffer(body.tobytes(), np.uint64), "starts": off[:-1] // 8, "ends": off[1:] // 8}
            sigs = _col(batch, "sigs")
            ends = np.cumsum(sigs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            x |= {"more": sigs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), "ms": np.concatenate([[0], ends[:-1]]), "me": ends}
            if held is not None:
                x = joined(held, x)
            n = len(x["sig"])
            done = int(np.searchsorted(x["sig"], x["sig"][-1]))
            held = cut(x, done, n)
            if done:
                for p in pairs(cut(x, 0, done)):
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, c]) for c in range(3)], names=["sig", "a", "b"])
        if held is not None:
            for p in pairs(held):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, c]) for c in range(3)], names=["sig", "a", "b"])

    return run


def _plausible(num: int, den: int):
    """Pairs whose parities do not rule out a link."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sides = [text_buffers(_col(batch, c)) for c in ("left", "right")]
            shift = len(sides[0][0]) // 8
            x = {
                "bits": np.frombuffer(sides[0][0].tobytes() + sides[1][0].tobytes(), np.uint64),
                "starts": np.concatenate([sides[0][1][:-1] // 8, sides[1][1][:-1] // 8 + shift]),
                "ends": np.concatenate([sides[0][1][1:] // 8, sides[1][1][1:] // 8 + shift]),
            }
            ok = _apart(x, np.arange(n), np.arange(n, 2 * n)) * (den + num) <= (_long(batch, "sa") + _long(batch, "sb")) * (den - num)
            part = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([_col(part, "a"), _col(part, "b")], names=["a", "b"])

    return run


def _pack(k: int, salt: int):
    """Compressed texts of the named sets; a row that has another text under the same id and hash is left out."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = text_buffers(_col(batch, "text"))
            want = _long(batch, "name").view(np.uint64)
            for i, j in slices(off):
                part, poff = body[off[i] : off[j]], off[i : j + 1] - off[i]
                _, name, _ = set_names(*shingle_sets(part, poff, k), j - i, salt)
                fit = np.flatnonzero(name == want[i:j])
                packed = [zlib.compress(part[poff[r] : poff[r + 1]].tobytes(), 1) for r in fit.tolist()]
                yield pa.RecordBatch.from_arrays([signed(name[fit]), pa.array(packed, pa.binary())], names=["name", "packed"])

    return run


def _verify(k: int, num: int, den: int):
    """Exact: the sorted shingle hashes of both texts are intersected; consecutive pairs of one hub unpack it once."""

    def unpack(z: pa.Scalar) -> np.ndarray:
        body = np.frombuffer(zlib.decompress(z.as_buffer()), np.uint8)
        return shingle_sets(body, np.array([0, len(body)]), k)[1]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, left, right, keep = _long(batch, "a").tolist(), _col(batch, "left"), _col(batch, "right"), []
            for i, node in enumerate(a):
                if node != hub:
                    hub, mine = node, unpack(left[i])
                other = unpack(right[i])
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                both = int((mine[at] == other).sum())
                keep.append(den * both >= num * (len(mine) + len(other) - both))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([_col(part, "a"), _col(part, "b")], names=["a", "b"])

    return run


@trimmed
def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links of one task: union-find, roots are the least nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(_long(batch, "u").tolist(), _long(batch, "v").tolist(), strict=True):
            lo, hi = sorted((find(u), find(v)))
            root[hi] = lo
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, root of every node of the undirected ``edges`` (a, b).

    At most ``one_task`` links (counted) are united in a single executor task; more
    by alternating large-star and small-star steps, each written to the shared folder.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    if edges.count() <= one_task:
        return written(edges.repartition(1).mapInArrow(_union, "node long, root long"), "roots")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _planned(docs: DataFrame, k: int, bands: Bands, sample: int) -> Bands:
    """Fills the allocations from a sample bounded in rows and bytes (texts above SAMPLE_TEXT are not in it): signatures written and pairs met, by segment."""
    texts = docs.filter(F.octet_length("text") <= SAMPLE_TEXT).select("doc_id", "text").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample)
    rows_in_all = docs.count()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, els, n = [], [], 0
        for batch in batches:
            body, off = text_buffers(_col(batch, "text"))
            for i, j in slices(off):
                row, el = shingle_sets(body[off[i] : off[j]], off[i : j + 1] - off[i], k)
                rows.append(row + n)
                els.append(el)
                n += j - i
        if not n:
            return
        row, el = np.concatenate(rows), np.concatenate(els)
        ptr, name, _ = set_names(row, el, n)
        keep = np.zeros(n, bool)
        keep[np.unique(name, return_index=True)[1]] = True
        el, row = el[keep[row]], row[keep[row]]
        ptr = np.searchsorted(row, np.arange(n + 1))
        size = np.diff(ptr)
        for band in range(int(bands.of(size.max(initial=1))) + 1):
            mine = np.flatnonzero((size >= bands.start[band]) & (size < bands.start[band + 1] * bands.den // bands.num + 1))
            if len(mine) < 2 or not bands.differences(band):
                continue
            one, two = segment_costs(bands, band, ptr, el, mine, max(1.0, rows_in_all / n))
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([one.tolist()], pa.list_(pa.float64())), pa.array([two.tolist()], pa.list_(pa.float64()))], names=["band", "one", "two"])

    for r in texts.repartition(1).mapInArrow(run, "band int, one array<double>, two array<double>").collect():
        bands.choose(r.band, np.array(r.one), np.array(r.two))
    return bands


def _named(base: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, int]:
    """(named rows, classes, salt): a class is a name of 64 bits; another salt is taken if two sets of one name differ in the second name."""
    for salt in range(8):
        named = written(base.mapInArrow(_name_sets(k, num, den, salt), "doc_id long, h long, name long, second long, n_shingles long, bits binary"), "sets")
        least = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("rep"), "h"))
        grouped = named.filter("n_shingles > 0").groupBy("name").agg(least.alias("r"), F.first("n_shingles").alias("size"), F.first("bits").alias("bits"), F.min("second").alias("lo"), F.max("second").alias("hi"))
        classes = written(grouped.select("name", "r.*", "size", "bits", (F.col("lo") < F.col("hi")).alias("mixed")), "classes")
        if classes.filter("mixed").isEmpty():
            return named, classes.drop("mixed"), salt
    raise RuntimeError("no salt keeps the names apart")


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, sample: int = SAMPLE, crowd: int = CROWD, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    bands = _planned(base, k, Bands(num, den), sample)
    named, classes, salt = _named(base, k, num, den)

    signed_rows = base.select("text").mapInArrow(_sign(k, bands, salt), "sig long, priority long")
    stars = signed_rows.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "priority").mapInArrow(_stars, "sig long, hub long, member long")
    stars = written(stars, "stars")

    def packed(nodes: DataFrame) -> DataFrame:
        """name, packed of the classes in ``nodes`` (name), each from the row it is named after."""
        needed = written(nodes.distinct().join(classes, "name").select("name", F.col("rep").alias("_doc"), "h"), "needed")
        rows = base.select(F.coalesce("doc_id", F.lit(_LAST)).alias("_doc"), "h", "text")
        needed = F.broadcast(needed) if needed.count() <= SMALL_ROWS else needed
        return written(rows.join(needed, ["_doc", "h"]).select("name", "text").mapInArrow(_pack(k, salt), "name long, packed binary").dropDuplicates(["name"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        texts = packed(pairs.select(F.explode(F.array("a", "b")).alias("name")))
        both = pairs.join(texts.select(F.col("name").alias("b"), F.col("packed").alias("right")), "b").join(texts.select(F.col("name").alias("a"), F.col("packed").alias("left")), "a")
        return written(both.mapInArrow(_verify(k, num, den), "a long, b long"), "links")

    def near(pairs: DataFrame) -> DataFrame:
        side = lambda c, s, bits: classes.select(F.col("name").alias(c), F.col("size").alias(s), F.col("bits").alias(bits))
        sized = pairs.join(side("a", "sa", "left"), "a").join(side("b", "sb", "right"), "b").filter(den * F.least("sa", "sb") >= num * F.greatest("sa", "sb"))
        return sized.mapInArrow(_plausible(num, den), "a long, b long")

    first = written(near(stars.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).distinct()), "pairs")
    links = verified(first)
    roots = components(links)

    # What is still apart inside one signature: pairs of members with different roots.
    inside_sig = stars.select("sig", F.col("hub").alias("node")).unionByName(stars.select("sig", F.col("member").alias("node"))).distinct()
    level = 0
    while True:
        labelled = inside_sig.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        mixed = labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("sig", "n")
        left = written(labelled.join(mixed, "sig"), f"mixed-{level}")
        last = level == levels  # partitions so often drawn anew leave only what is alike
        some = (left if last else left.filter(F.col("n") <= crowd)).select("sig", "node", "root")
        # First one partner of each member, then some, then all: what is linked meanwhile is not compared again.
        for most in PARTNERS:
            lists = some.groupBy("node").agg(F.collect_list("sig").alias("sigs"))
            about = lists.join(classes.select(F.col("name").alias("node"), "size", "bits"), "node")
            rows = some.join(about, "node").select("sig", "node", "root", "size", "bits", "sigs")
            met = written(rows.repartition(partitions(spark), "sig").sortWithinPartitions("sig").mapInArrow(_cross(num, den, most), "sig long, a long, b long"), "met")
            found = written(met.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "pairs")
            if not found.isEmpty():
                links, first = links.unionByName(verified(found)), first.unionByName(found)
                roots = components(links)
            if most is None or met.isEmpty():
                break
            again = some.select("sig", "node").join(met.select("sig").distinct(), "sig")  # the other signatures have no such pairs
            some = again.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        crowded = left.filter(F.col("n") > crowd).select("sig", "node")
        if last or crowded.isEmpty():
            break
        level += 1
        texts = packed(crowded.select(F.col("node").alias("name")))
        again = crowded.join(texts.withColumnRenamed("name", "node"), "node").select("sig", "node", "packed")
        inside_sig = written(again.mapInArrow(_sign_again(k, bands, level), "sig long, node long").distinct(), f"crowd-{level}")

    linked = classes.join(roots.select(F.col("node").alias("name"), "root"), "name").select("name", "rep", "root")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = classes.select("name", "rep").join(linked.join(least, "root").select("name", "component_id"), "name", "left").select("name", F.coalesce("component_id", "rep").alias("component_id"))
    out = named.join(answer, "name", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component_id") == _LAST, F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("bigint").alias("component_id"))
