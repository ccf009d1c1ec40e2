"""BPE encoding and decoding by a pair occurrence index.

The distinct pieces of a chunk of texts are laid out as one linked list of
symbols.  An index maps each mergeable pair (by its rank) to all its positions;
ranks are taken in ascending order from a heap, all positions of a rank are
merged at once, and the lists of the neighbouring pairs are updated.

Null and empty texts: no tokens, decoded to the empty text.  Special tokens of
the vocabulary are recognised in the raw text, as the public library does.
Extra columns pass through; the outputs replace columns of the same name.
Rows are handled one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stateloom.llm._text import slices, small_batches, text_buffers, trimmed

#: Bytes of text whose pieces share one pair index, and pieces remembered by a worker at most.
CHUNK_BYTES, CACHE_PIECES = 16 << 20, 300_000

_WHITE = r"\t-\r \x85\xa0  -     　"
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _WHITE + r"\p{L}\p{N}]+"
_NONE = 1 << 30


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """The parts of a tokenizer file that encoding needs; small and fixed, so it may be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in (ids | self.special).items():
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int32)
        self.final = np.array([ids[c + end] for c in alphabet], np.int32)
        keys, ranks, made = [], [], []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            keys.append(ids[a] << 32 | ids[b])
            ranks.append(rank)
            made.append(ids[a + b])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int32)  # by rank

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def merge_all(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all pieces, offsets by piece)."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lens)
    body = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(body)
    sym = vocab.inner[body]
    sym[ends - 1] = vocab.final[body[ends - 1]]
    # One spare cell stands for "no neighbour"; positions on a piece's edge point there.
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
    nxt[ends - 1] = n
    prv[ends - lens] = n
    sym = np.append(sym, np.int32(-1))
    alive = np.ones(n + 1, bool)
    rank = np.full(n + 1, _NONE, np.int64)
    rank[:n] = vocab.rank_of(sym[:n], sym[nxt[:n]])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray) -> None:
        at = at[rank[at] < _NONE]
        if len(at):
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cuts):
                r = int(rank[part[0]])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

    note(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        right = nxt[at]
        if sym[at[0]] == sym[right[0]]:  # aaa: positions overlap, the left one goes first
            keep, taken = np.ones(len(at), bool), -1
            for i, (p, q) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                if p == taken:
                    keep[i] = False
                else:
                    taken = q
            at, right = at[keep], right[keep]
        sym[at] = vocab.made[r]
        alive[right] = False
        after = nxt[right]
        nxt[at] = after
        real = after < n
        prv[after[real]] = at[real]
        rank[right] = _NONE
        before = prv[at]
        before = before[before < n]
        touched = np.unique(np.concatenate([before, at]))
        follower = nxt[touched]
        fresh = np.where(follower < n, vocab.rank_of(sym[touched], sym[follower]), _NONE)
        rank[touched] = fresh
        note(touched)
    left = alive[:n]
    count = np.concatenate([[0], np.cumsum(left)])
    return sym[:n][left], np.concatenate([[0], count[ends]])


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = value = len(self)
        return value


class Encoder:
    """Encodes texts; remembers at most CACHE_PIECES distinct pieces between chunks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.find = regex.compile(_PIECE).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")").split if vocab.special else None
        self.reset()

    def reset(self) -> None:
        self.number = _Numbers()
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        if "Σ" in text:  # the final-sigma rule of str.lower is not wanted
            text = text.replace("Σ", "σ")
        return self.find((text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower())

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        if len(self.number) > CACHE_PIECES:
            self.reset()
        get, rows = self.number.__getitem__, []
        for text in texts:
            if self.split and "<" in text and len(parts := self.split(text)) > 1:
                row = []
                for i, part in enumerate(parts):
                    row += [get((part,))] if i % 2 else map(get, self.pieces(part))
            else:
                row = list(map(get, self.pieces(text)))
            rows.append(np.array(row, np.int64))
        if new := list(self.number)[len(self.off) - 1 :]:
            self._learn(new)
        size = np.diff(self.off)
        for row in rows:
            lens = size[row]
            start = np.repeat(self.off[row] - np.cumsum(lens) + lens, lens)
            yield self.flat[start + np.arange(len(start))].astype("<u4").tobytes()

    def _learn(self, new: list) -> None:
        ids, off = merge_all(self.vocab, [b"!" if isinstance(p, tuple) else p.encode() for p in new])
        ids = ids.copy()
        for i, p in enumerate(new):
            if isinstance(p, tuple):  # a special token takes the place of the one-byte stand-in
                ids[off[i]] = self.vocab.special[p[0]]
        self.off = np.concatenate([self.off, self.off[-1] + off[1:]])
        self.flat = np.concatenate([self.flat, ids])


def _extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    keep = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(values, kind)], names=[batch.schema.names[i] for i in keep] + [name])


def _encoding(shared: Broadcast[Vocabulary], text: str, out: str):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            col = batch.column(batch.schema.names.index(text))
            _, off = text_buffers(col)
            for i, j in slices(off, CHUNK_BYTES):
                part = batch.slice(i, j - i)
                yield _with(part, out, list(encoder.encode(t or "" for t in col.slice(i, j - i).to_pylist())), pa.binary())

    return run


def _decoding(shared: Broadcast[Vocabulary], ids: str, out: str):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens.__getitem__
        for batch in batches:
            body, off = text_buffers(batch.column(batch.schema.names.index(ids)))
            numbers = body.view("<u4") if len(body) else np.zeros(0, np.uint32)
            texts = [" ".join(map(token, numbers[i // 4 : j // 4].tolist())) for i, j in pairwise(off.tolist())]
            yield _with(batch, out, texts, pa.string())

    return run


def _shared(df: DataFrame, tokenizer: str) -> Broadcast[Vocabulary]:
    """The vocabulary for all workers: fixed size, whatever the input."""
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as little-endian unsigned 32-bit integers (binary)."""
    return docs.mapInArrow(_encoding(_shared(docs, tokenizer), text, out), _extended(docs, out, T.BinaryType()))


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` stand for: tokens joined by one space, as a tokenizer without a decoder does."""
    return df.mapInArrow(_decoding(_shared(df, tokenizer), ids, out), _extended(df, out, T.StringType()))


def bpe_round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` without ``text``, with its token ids and the text they stand for, as bpe_encode and bpe_decode give them.

    One Python worker a task does both; the two chained keep two workers a task.
    """
    shared = _shared(docs, tokenizer)
    encode, decode = _encoding(shared, text, ids), _decoding(shared, ids, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decode(b.drop_columns([text]) for b in encode(batches))

    schema = _extended(docs.drop(text, ids, out), ids, T.BinaryType()).add(out, T.StringType())
    return docs.mapInArrow(run, schema)
