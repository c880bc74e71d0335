"""Byte-level BPE encoding by segment trees over byte positions, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No pair.
NONE = np.int64(1) << 62
#: Characters that are encoded together, and words remembered by a Python worker at most; both bound its memory.
SLICE = 1 << 19
MEMORY = 300_000
#: From this many bytes a piece has a tree of its own; below it, the trees of many pieces move in step.
LONG = 256


#: Fixed value: the pattern of byte-level BPE that words are remembered for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Marks that stand alone as a piece after a word.
_MARKS = frozenset(".,;:!?")


@dataclass
class Vocabulary:
    """Tokens by rank, and for adjacent tokens the rank of their union; of fixed size, so broadcast."""

    pattern: str
    offsets: np.ndarray  # token r is flat[offsets[r]:offsets[r + 1]]
    flat: np.ndarray
    pairs: np.ndarray  # an open hash table of left << 32 | right, -1 where free
    ranks: np.ndarray  # of the pairs' unions
    byte: np.ndarray  # ranks of the 256 single bytes
    whole: dict[bytes, int]
    encoder: Encoder | None = None


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    """Where the search for a pair starts: a multiplicative hash."""
    with np.errstate(over="ignore"):
        return (key ^ (key >> 32)) * np.int64(0x1E3779B97F4A7C15) >> 24 & (slots - 1)


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Reads base64 tokens and ranks, a line each. Ranks run from 0 without a gap."""
    with open(path, "rb") as lines:
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = sorted(rank, key=rank.__getitem__)
    if [rank[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    found = {}
    for token, r in rank.items():
        for k in range(1, len(token)):
            a, b = rank.get(token[:k]), rank.get(token[k:])
            if a is not None and b is not None:
                found[a << 32 | b] = r
    slots = 1 << (4 * len(found) + 1).bit_length()
    pairs, unions = np.full(slots, -1, np.int64), np.full(slots, NONE)
    for pair, r in found.items():
        at = int(_slot(np.int64(pair), slots))
        while pairs[at] >= 0:
            at = (at + 1) % slots
        pairs[at], unions[at] = pair, r
    return Vocabulary(
        pattern,
        np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64),
        np.frombuffer(b"".join(tokens), np.uint8),
        pairs,
        unions,
        np.array([rank[bytes([b])] for b in range(256)], np.int64),
        rank,
    )


def _union(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of each pair's union, or NONE."""
    key = left << 32 | right
    at = _slot(key, len(v.pairs))
    found = v.pairs[at]
    while len(astray := np.nonzero((found != key) & (found >= 0))[0]):
        if at.ndim > 1:
            return _union(v, left.ravel(), right.ravel()).reshape(left.shape)
        at[astray] = (at[astray] + 1) & (len(v.pairs) - 1)
        found[astray] = v.pairs[at[astray]]
    return np.where(found == key, v.ranks[at], NONE)


def merge_one(v: Vocabulary, piece: bytes) -> list[int]:
    """The tokens of one piece.

    Leaf i of the tree holds the rank of the pair that starts at byte i and i itself, as one number, so
    the root is the least rank at its leftmost place. A merge updates the leaves of its two ends and of
    the live neighbour to the left, each along one path to the root.
    """
    n = len(piece)
    token = v.byte[np.frombuffer(piece, np.uint8)]
    width = 1 << max(1, (n - 1).bit_length())
    shift, none = width.bit_length(), int(NONE)
    first = _union(v, token[:-1], token[1:])
    tree = [none] * (2 * width)
    tree[width : width + n - 1] = np.where(first == NONE, NONE, (first << shift) | np.arange(n - 1)).tolist()
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    token = token.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def value(i: int, j: int) -> int:
        rank = int(_union(v, np.array([token[i]]), np.array([token[j]]))[0])
        return none if rank == none else rank << shift | i

    while tree[1] != none:
        i = tree[1] & ((1 << shift) - 1)
        token[i], j = tree[1] >> shift, after[i]
        after[i] = k = after[j]
        before[k] = i
        put(j, none)
        put(i, value(i, k) if k < n else none)
        if (h := before[i]) >= 0:
            put(h, value(h, i))
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def merge_many(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """As merge_one for each of many short pieces: their trees lie in one array and move in step."""
    count, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << max(1, int(lengths.max() - 1).bit_length())
    shift = width.bit_length()
    stride = width + 2  # places -1 .. width of a piece's row, so that neighbours beyond its ends exist
    rows, place = np.repeat(np.arange(count), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    token = np.full(count * stride, -1, np.int64)
    token[rows * stride + place + 1] = v.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    grid = token.reshape(count, stride)
    tree = np.full((count, 2 * width), NONE, np.int64)
    first = _union(v, np.maximum(grid[:, 1:-1], 0), np.maximum(grid[:, 2:], 0))
    first = np.where((grid[:, 1:-1] < 0) | (grid[:, 2:] < 0) | (first == NONE), NONE, first << shift | np.arange(width))
    tree[:, width:] = first
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    tree = tree.reshape(-1)
    after, before = np.tile(np.arange(1, stride + 1), count), np.tile(np.arange(-1, stride - 1), count)
    live = np.flatnonzero(tree[1 :: 2 * width] != NONE)
    while len(live):
        top = tree[live * 2 * width + 1]
        i, base = (top & ((1 << shift) - 1)) + 1, live * stride
        at = base + i
        token[at] = top >> shift
        j = after[at]
        token[base + j] = -2
        k = after[base + j]
        after[at] = k
        before[base + k] = i
        h = before[at]
        left, mid, right = token[base + h], token[at], token[base + k]
        ahead = np.where(right < 0, NONE, _union(v, mid, np.maximum(right, 0)))
        behind = np.where(left < 0, NONE, _union(v, np.maximum(left, 0), mid))
        ahead = np.where(ahead == NONE, NONE, ahead << shift | (i - 1))
        behind = np.where(behind == NONE, NONE, behind << shift | np.maximum(h - 1, 0))
        has = h > 0
        base *= 2
        base = live * 2 * width
        leaf = np.concatenate([i, j, h[has]]) + (width - 1)
        root = np.concatenate([base, base, base[has]])
        tree[root + leaf] = np.concatenate([ahead, np.full(len(live), NONE), behind[has]])
        while leaf[0] > 1:
            leaf >>= 1
            child = root + 2 * leaf
            tree[root + leaf] = np.minimum(tree[child], tree[child + 1])
        live = live[tree[live * 2 * width + 1] != NONE]
    kept = token >= 0
    flat, ends = token[kept], np.cumsum(kept.reshape(count, stride).sum(axis=1)).tolist()
    flat = flat.tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Token ids of each piece (non-empty). A piece that is a token is that token."""
    out: list[list[int] | None] = [None if (r := v.whole.get(p)) is None else [r] for p in pieces]
    by: dict[int, list[int]] = {}
    for n, p in enumerate(pieces):
        if out[n] is None:
            by.setdefault(max(3, (len(p) - 1).bit_length()) if len(p) < LONG else 0, []).append(n)
    for width, those in by.items():
        step = max(1, (1 << 21) >> max(width, 1))
        for at in range(0, len(those), step):
            some = those[at : at + step]
            found = merge_many(v, [pieces[n] for n in some]) if width and len(some) > 8 else [merge_one(v, pieces[n]) for n in some]
            for n, ids in zip(some, found, strict=True):
                out[n] = ids
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Index(dict):
    """Numbers what it is asked for, as it is first seen."""

    def __missing__(self, key: object) -> int:
        n = self[key] = len(self)
        return n


def _latin(word: str) -> bool:
    """Letters alone, and such as every version of Unicode has as letters."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class Encoder:
    """Encodes texts, and remembers what it has seen up to a bound.

    With the byte-level pattern, a text falls apart at each space, if none of them has white space before it and
    white space or the end after it: then no match reaches over a space from the left, so what follows, the space
    included, is encoded for itself once and then remembered, whatever the vocabulary. Other texts and other
    patterns are split by the pattern alone.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.find = v, regex.compile(v.pattern).findall
        self.apart = v.pattern == BYTE_LEVEL
        self.joined = regex.compile(r"\s \s|\s \Z").search
        self.forget()

    def forget(self) -> None:
        self.index = _Index()  # words without the space before them; pieces as tuples
        self.pool, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[object]:
        if not self.apart or self.joined(text):
            return [(p,) for p in self.find(text)]
        first, *rest = text.split(" ")
        return [(p,) for p in self.find(first)] + rest

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word with a space before it. Latin words, and those with one mark after them, need no search."""
        if _latin(word):
            return [" " + word]
        if word[-1:] in _MARKS and _latin(word[:-1]):
            return [" " + word[:-1], word[-1]]
        return self.find(" " + word)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), and how many each text has."""
        parts = [self.split(t) for t in texts]
        index, known = self.index, len(self.index)
        where = np.fromiter(map(index.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        new = list(islice(index, known, None))
        if new:
            pieces = [p if type(p) is tuple else self.pieces(p) for p in new]
            flat = [p for those in pieces for p in those]
            at = {p: n for n, p in enumerate(dict.fromkeys(flat))}
            merged = merge(self.v, [p.encode("utf-8", "surrogatepass") for p in at])
            ids = [merged[at[those[0]]] if len(those) == 1 else [x for p in those for x in merged[at[p]]] for those in pieces]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, np.fromiter((x for one in ids for x in one), np.int32, int(lengths.sum()))])
        lengths = self.lengths[where]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = sums[np.cumsum([len(those) for those in parts])] if parts else np.zeros(0, np.int64)
        ids = self.pool[_ranges(self.starts[where], lengths)]
        if len(index) > MEMORY:
            self.forget()
        return ids, np.diff(ends, prepend=0)


def decode_flat(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and how many each has."""
    lengths = np.diff(v.offsets)[ids]
    sums = np.concatenate([[0], np.cumsum(lengths)])
    return v.flat[_ranges(v.offsets[ids], lengths)], np.diff(sums[np.cumsum(counts)], prepend=0)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids array<int>: the byte-level BPE tokens of each whole text; and, if
    asked for, decoded binary: what these ids decode to.

    Every match of the pattern is merged for itself, by ranks, leftmost first among equals; special
    tokens are ordinary text. A text that is null or empty has no ids. The vocabulary, whose size is
    fixed by its file, is broadcast; texts stream through Arrow batches without a shuffle, so a lost
    executor costs its own partitions. Repeated rows are encoded alike; only doc_id and text are read. Long texts go
    through alone, whole; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        if v.encoder is None:  # the worker keeps it from task to task, with the broadcast
            v.encoder = Encoder(v)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, end = [], 0, at
                while end < batch.num_rows and (not texts or size < SLICE):
                    texts.append(batch.column(1)[end].as_py() or "")
                    size, end = size + len(texts[-1]), end + 1
                ids, counts = v.encoder.encode(texts)
                columns, names = [batch.column(0).slice(at, end - at), _lists(pa.array(ids), counts)], ["doc_id", "ids"]
                if decoded:
                    columns, names = [*columns, _binaries(*decode_flat(v, ids, counts))], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>" + ", decoded binary" * decoded
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, ids, any others) with the decoded bytes of each row as `decoded` binary; null ids
    count as none, and an id outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    schema = encoded.select("doc_id", "ids").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            at = 0
            all_counts = np.asarray(batch.column(1).value_lengths().fill_null(0)).astype(np.int64)
            while at < batch.num_rows:
                end = at + max(1, int(np.searchsorted(np.cumsum(all_counts[at:]), SLICE)))
                part = batch.slice(at, end - at)
                ids, counts = np.asarray(part.column(1).flatten()).astype(np.int64), all_counts[at:end]
                if len(ids) and not (0 <= ids.min() and ids.max() < len(v.offsets) - 1):
                    raise ValueError("an id is not in the vocabulary")
                decoded = _binaries(*decode_flat(v, ids, counts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoded], names=["doc_id", "ids", "decoded"])
                at = end

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
