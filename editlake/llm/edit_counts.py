"""Token counts that follow edits.

A document keeps its pre-tokens and their token counts in small buckets under a
segment tree of sums (characters, tokens). An edit ``(start, stop, text)``
replaces characters. The tree finds the pre-tokens that it touches in
O(log n); the region grows by boundary context to the nearest places, on both
sides and untouched by the edit, where white space begins after other
characters: there the split pattern always ends a match, whatever stands
further away. Only that region is split and encoded again; its buckets change,
and their sums go up the tree. The total is the root.

Edits of a document apply one after the other; offsets are in characters of
the text as it then stands.

Defined results: a null text is empty. A null edit list has no edits; offsets
beyond the text are moved to its end, a stop before its start to the start, a
null replacement is empty. Rows are independent, so rows with equal ids each
follow their own edits; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
import pyarrow as pa

from .byte_bpe import LONG, SPACE, Vocabulary
from .common import slices

BUCKET = 32          # pre-tokens of a new bucket
SPLIT = 8 * BUCKET   # a fuller bucket has the tree built anew
CACHED = 200_000     # pre-token counts kept per worker, and as many of the generation before
IS_SPACE = regex.compile(f"[{SPACE}]").match
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"


class Counter:
    """Token counts of pre-tokens by a rank vocabulary."""

    def __init__(self, content: bytes, pattern: str):
        self.vocabulary = Vocabulary(content, pattern)
        self.split = self.vocabulary.split
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def prepare(self, pieces: Sequence[Sequence[str]]) -> None:
        """Count what is not known yet, together."""
        if len(self.counts) > CACHED:
            self.older, self.counts = self.counts, {}
        missing: set[str] = set()
        for p in pieces:
            missing.update(set(p).difference(self.counts))
        for p in missing & self.older.keys():
            self.counts[p] = self.older.pop(p)
            missing.discard(p)
        data = {m: m.encode() for m in missing}
        ids = self.vocabulary.encode_pieces(list(data.values()))
        self.counts.update((m, len(ids[b])) for m, b in data.items())

    def of(self, pieces: Sequence[str]) -> list[int]:
        unknown = [p for p in pieces if p not in self.counts]
        if unknown:
            self.prepare([unknown])
        return [self.counts[p] if p in self.counts else self.of([p])[0] for p in pieces]

    def forget_long(self) -> None:
        for p in [p for p in self.counts if len(p) > LONG]:
            del self.counts[p]


class PreTokenTree:
    """Pre-tokens of one text under a segment tree of character and token sums."""

    def __init__(self, text: str, counter: Counter, pieces: list[str] | None = None):
        self.counter = counter
        self.encoded = 0  # pre-tokens encoded since the text was first read
        self._build(counter.split(text) if pieces is None else pieces)

    def _build(self, pieces: list[str], counts: list[int] | None = None) -> None:
        counts = self.counter.of(pieces) if counts is None else counts
        self.pieces = [pieces[i:i + BUCKET] for i in range(0, len(pieces), BUCKET)] or [[]]
        self.counts = [counts[i:i + BUCKET] for i in range(0, len(counts), BUCKET)] or [[]]
        n = len(self.pieces)
        self.size = size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, (p, c) in enumerate(zip(self.pieces, self.counts)):
            self.chars[size + i], self.tokens[size + i] = sum(map(len, p)), sum(c)
        for i in range(size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for bucket in self.pieces for p in bucket)

    def _refresh(self, bucket: int) -> None:
        i = self.size + bucket
        self.chars[i], self.tokens[i] = sum(map(len, self.pieces[bucket])), sum(self.counts[bucket])
        i >>= 1
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i >>= 1

    def _at(self, char: int) -> tuple[int, int, int]:
        """Bucket, place in it and start of the pre-token that holds a character."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if start + self.chars[i] <= char:
                start += self.chars[i]
                i += 1
        bucket = i - self.size
        for k, p in enumerate(self.pieces[bucket]):
            if start + len(p) > char:
                return bucket, k, start
            start += len(p)
        raise IndexError(char)

    def _before(self, bucket: int, k: int) -> tuple[int, int] | None:
        k -= 1
        while k < 0:
            bucket -= 1
            if bucket < 0:
                return None
            k = len(self.pieces[bucket]) - 1
        return bucket, k

    def _after(self, bucket: int, k: int) -> tuple[int, int] | None:
        k += 1
        while k >= len(self.pieces[bucket]):
            bucket, k = bucket + 1, 0
            if bucket >= len(self.pieces):
                return None
        return bucket, k

    def _opens(self, here: tuple[int, int], back: tuple[int, int]) -> bool:
        """Whether white space begins here after another character."""
        return bool(IS_SPACE(self.pieces[here[0]][here[1]])) and not IS_SPACE(self.pieces[back[0]][back[1]][-1])

    def edit(self, start: int, stop: int, text: str) -> None:
        n = self.n_chars
        start = min(max(0, start), n)
        stop = min(max(start, stop), n)
        # left: the last opening place whose two characters lie before the edit
        if start == 0 or n == 0:
            left, left_char = (0, 0), 0
        else:
            bucket, k, left_char = self._at(start - 1)
            left = bucket, k
            while (back := self._before(*left)) is not None and not self._opens(left, back):
                left = back
                left_char -= len(self.pieces[back[0]][back[1]])
            if self._before(*left) is None:
                left, left_char = (0, 0), 0
        # right: the first opening place whose two characters lie after it
        right = None
        if stop + 1 < n:
            bucket, k, at = self._at(stop + 1)
            here: tuple[int, int] | None = (bucket, k)
            if at < stop + 1:
                here = self._after(bucket, k)
            while here is not None:
                back = self._before(*here)
                if back is not None and self._opens(here, back):
                    right = here
                    break
                here = self._after(*here)
        b0, k0 = left
        b1, k1 = right if right is not None else (len(self.pieces) - 1, len(self.pieces[-1]))
        region = "".join(self.pieces[b0][k0:k1] if b0 == b1 else [
            *self.pieces[b0][k0:], *(p for b in range(b0 + 1, b1) for p in self.pieces[b]), *self.pieces[b1][:k1]])
        made = self.counter.split(region[:start - left_char] + text + region[stop - left_char:])
        counts = self.counter.of(made)
        self.encoded += len(made)
        head, tail = self.pieces[b0][:k0], self.pieces[b1][k1:]
        head_n, tail_n = self.counts[b0][:k0], self.counts[b1][k1:]
        if b0 == b1:
            self.pieces[b0], self.counts[b0] = head + made + tail, head_n + counts + tail_n
        else:
            self.pieces[b0], self.counts[b0] = head + made, head_n + counts
            for b in range(b0 + 1, b1):
                self.pieces[b], self.counts[b] = [], []
            self.pieces[b1], self.counts[b1] = tail, tail_n
        if len(self.pieces[b0]) > SPLIT:
            self._build([p for b in self.pieces for p in b], [c for b in self.counts for c in b])
        else:
            for b in range(b0, b1 + 1):
                self._refresh(b)


_LOADED: dict[tuple[str, str], Counter] = {}


def counter(content: bytes, pattern: str) -> Counter:
    key = hashlib.md5(content).hexdigest(), pattern
    if key not in _LOADED:
        _LOADED[key] = Counter(content, pattern)
    return _LOADED[key]


FIELDS = "n_edits bigint, n_before bigint, n_after bigint, n_pretokens bigint, n_encoded bigint"


def count(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``row`` (the input row) and struct ``counts``: tokens before and after the
    row's edits, pre-tokens after them, and how many were encoded for the edits."""
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(f"`{text_col}`").alias("text"), F.col(f"`{edits_col}`").cast(EDITS).alias("edits"))
    made = T.StructType.fromDDL(FIELDS)

    def run(batches):
        c = counter(held.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                split = [c.split(t) if t else [] for t in part.column("text").to_pylist()]
                c.prepare(split)
                rows = []
                for pieces, edits in zip(split, part.column("edits").to_pylist()):
                    tree = PreTokenTree("", c, pieces)
                    before = tree.n_tokens
                    edits = [e for e in edits or () if e is not None]
                    for e in edits:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    rows.append((len(edits), before, tree.n_tokens, sum(map(len, tree.pieces)), tree.encoded))
                c.forget_long()
                cols = list(zip(*rows))
                inner = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in cols], names=made.names)
                yield pa.RecordBatch.from_arrays([part.column("row"), inner], ["row", "counts"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("counts", made)]))


def with_edits(docs: DataFrame, edits: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with column ``edits`` from a table ``id_col, seq, start, stop, text``."""
    listed = (edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "text"))).alias("e"))
              .select(id_col, F.transform("e", lambda e: F.struct(e["start"], e["stop"], e["text"])).alias("edits")))
    return docs.join(listed, id_col, "left")


def revisions(docs: DataFrame, n: int = 4, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n`` edits a row that follow from the row alone (md5 of id and
    number): up to 11 characters at a hash-chosen place give way to up to 15
    characters from another place of the same text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = F.length(text)

    def number(i: int, use: str):
        digest = F.md5(F.concat_ws(":", F.lit("edit"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                                   F.lit(i), F.lit(use)))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

    edits = []
    for i in range(n):
        start = number(i, "start") % (size + 1)
        source = (number(i, "from") % (size + 1) + 1).cast("int")
        edits.append(F.struct(start.alias("start"), (start + number(i, "cut") % 12).alias("stop"),
                              F.substring(text, source, (number(i, "size") % 16).cast("int")).alias("text")))
    return docs.withColumn("edits", F.array(*edits))
