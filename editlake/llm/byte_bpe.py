"""Byte-level BPE encoding and decoding with a segment tree.

Over the byte positions of a pre-token lies a segment tree whose leaves hold
the rank of the pair that starts at a live position (infinite where no pair
can merge), packed with the position, so the root is the leftmost pair of
minimum rank. A merge takes the root, joins the pair, and changes three leaves
only (the merged position and its live neighbours); each change walks up the
tree in O(log n). A pre-token of n bytes costs O(n log n), whatever its length.

Short pre-tokens of equal tree size are merged side by side as rows of NumPy
arrays; long ones run on a tree of their own. Texts are cut at the starts of
whitespace runs, where the pattern always ends a match, so a piece of text has
the same ids wherever it stands; pieces met before are looked up. The lookup
keeps two generations of bounded size, which changes time but no result.

Defined results: a null or empty text has no ids. Rows are independent, so
repeated rows repeat their result and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate

#: White space of the split pattern (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
NONE = np.int64(1 << 40)
LONG = 256          # bytes; longer pre-tokens get a tree of their own
CACHED = 200_000    # pieces kept per worker, and as many of the generation before
ROWS = 1 << 19      # leaves merged side by side
FEW = 64            # fewer pre-tokens than this are merged one by one


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: pair table, whole-token ids and bytes of ids."""

    def __init__(self, content: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ids.get(bytes([i]), -1) for i in range(256)], np.int64)
        get = self.ids.get
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        top = max(self.bytes, default=-1) + 1
        self.listed, self.packed = list(map(str, range(top))), [i.to_bytes(4, "little") for i in range(top)]
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NONE)

    def merge_long(self, data: bytes) -> list[int]:
        """One pre-token on its own segment tree (plain lists)."""
        n = len(data)
        size = 1 << max(1, (n - 1).bit_length())
        none = int(NONE) * size
        token = [int(self.byte[b]) for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get

        def leaf(i: int) -> int:
            j = after[i]
            rank = get(token[i] << 24 | token[j]) if j < n else None
            return none if rank is None else rank * size + i

        tree = [none] * (2 * size)
        for i in range(n):
            tree[size + i] = leaf(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        alive = [True] * n

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            token[i], alive[j] = rank, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [t for t, live in zip(token, alive) if live]

    def merge_rows(self, pieces: Sequence[bytes], size: int) -> list[list[int]]:
        """Pre-tokens of at most ``size`` (a power of two) bytes, one row each."""
        w = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, w)
        col = np.arange(size)
        alive = col < length[:, None]
        token = np.full((w, size + 1), -1, np.int64)  # the last column is past the end
        token[:, :size][alive] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.minimum(col + 1, size), (w, size)).copy()
        after[np.arange(w), length - 1] = size
        before = np.broadcast_to(col - 1, (w, size)).copy()
        flat = token[:, :size].ravel(), np.take_along_axis(token, after, 1).ravel()
        tree = np.full((w, 2 * size), NONE * size, np.int64)
        tree[:, size:] = np.where(alive, self.pair_rank(*flat).reshape(w, size) * size + col, NONE * size)
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            i, rank = root % size, root // size
            j = after[live, i]
            k = after[live, j]
            token[live, i] = rank
            alive[live, j] = False
            after[live, i] = k
            inner = k < size
            before[live[inner], k[inner]] = i[inner]
            h = before[live, i]
            tree[live, size + j] = NONE * size
            tree[live, size + i] = self.pair_rank(rank, token[live, k]) * size + i
            has = h >= 0
            h = np.where(has, h, i)
            tree[live, size + h] = np.where(has, self.pair_rank(token[live, h], rank) * size + h, tree[live, size + i])
            nodes = [(size + x) >> 1 for x in (i, j, h)]
            while nodes[0][0]:
                for x in nodes:
                    tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
                nodes = [x >> 1 for x in nodes]
            live = live[tree[live, 1] < NONE]
        ids, ends = token[:, :size][alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: Sequence[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct pre-tokens; one that is itself a token is that id."""
        out: dict[bytes, list[int]] = {}
        by_size: dict[int, list[bytes]] = {}
        for p in pieces:
            whole = self.ids.get(p)
            if whole is not None:
                out[p] = [whole]
            elif len(p) > LONG:
                out[p] = self.merge_long(p)
            else:
                by_size.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(p)
        for size, group in by_size.items():
            if len(group) < FEW:
                out.update((p, self.merge_long(p)) for p in group)
                continue
            step = max(1, ROWS // size)
            for a in range(0, len(group), step):
                part = group[a:a + step]
                out.update(zip(part, self.merge_rows(part, size)))
        return out

    def lookup(self, missing: Sequence[str]) -> None:
        """Encode pieces of text that are not cached."""
        cut = list(map(self.split, missing))
        own = {m: m.encode() for ms in cut for m in ms}
        ids = self.encode_pieces(list(set(own.values())))
        listed, packed = self.listed, self.packed
        done = {m: (",".join([listed[i] for i in ids[p]]), b"".join([packed[i] for i in ids[p]])) for m, p in own.items()}
        for piece, matches in zip(missing, cut):
            if len(matches) == 1:
                self.cache[piece] = done[matches[0]]
            else:
                found = [done[m] for m in matches]
                self.cache[piece] = (",".join([a for a, _ in found]), b"".join([b for _, b in found]))

    def encode(self, texts: Sequence[str | None]) -> list[tuple[str, bytes]]:
        """Per text its ids as decimal text joined by commas and as little-endian 32-bit integers."""
        if len(self.cache) > CACHED:
            self.older, self.cache = self.cache, {}
        pieces = [PIECE.findall(t) if t else [] for t in texts]
        missing: set[str] = set()
        for p in pieces:
            missing.update(set(p).difference(self.cache))
        for p in missing & self.older.keys():
            self.cache[p] = self.older.pop(p)
            missing.discard(p)
        self.lookup(list(missing))
        out = []
        for p in pieces:
            pairs = list(map(self.cache.__getitem__, p))
            out.append((",".join([a for a, _ in pairs]), b"".join([b for _, b in pairs])))
        for p in missing:
            if len(p) > LONG:
                del self.cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids held as little-endian 32-bit integers."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(content: bytes, pattern: str) -> Vocabulary:
    """One vocabulary per worker process."""
    key = hashlib.md5(content).hexdigest(), pattern
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content, pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """``row`` (the input row), and struct ``bpe``: ``ids`` (binary, little-endian
    32-bit), ``listed`` (decimal ids joined by commas), ``n_tokens``."""
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def kernel(texts):
        found = vocabulary(held.value, pattern).encode(texts)
        return [b for _, b in found], [a for a, _ in found], [len(b) // 4 for _, b in found]

    return annotate(docs, kernel, "ids binary, listed string, n_tokens bigint", text_col, "bpe", 4 << 20)


def digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids; per row the token count and the digests of both."""
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def kernel(texts):
        v = vocabulary(held.value, pattern)
        found = v.encode(texts)
        return ([len(b) // 4 for _, b in found], [hashlib.sha256(a.encode()).hexdigest() for a, _ in found],
                [hashlib.sha256(v.decode(b)).hexdigest() for _, b in found])

    out = annotate(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), kernel,
                   "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text_col, "bpe", 4 << 20)
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), "bpe.*")
