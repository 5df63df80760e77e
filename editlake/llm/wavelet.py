"""Token ids as one wavelet matrix per shard.

Texts are encoded with the tokenizers library and a document end id is added;
documents are range-partitioned by id, and each partition cuts its token stream
into shards of whole documents (a shard closes at the first document end past
``SHARD_TOKENS``). A shard is one row of a Parquet table (zstd inside), so the
write is Spark's own commit and works on any store:

- ``doc_ids``, ``ends``: documents of the shard and the running end offsets;
- ``width`` bit-planes, most significant first. Level k holds bit k of the
  sequence as stably partitioned by the bits above (zeros first), packed eight
  to a byte; ``zeros`` is the number of 0 bits of each level;
- ``ranks``: per level the count of 1 bits before each block of ``BLOCK`` bits.

``Shard`` answers from those planes alone: ``access`` (one token), ``rank``
(occurrences before a position), ``select`` (position of the k-th occurrence)
in O(width) block lookups, ``find`` (all positions of a token), ``tokens``
(everything, by undoing the stable partitions level by level).

Defined results: null or empty text holds only its end id. Rows with equal ids
stand next to each other, ordered by their texts. A null id sorts first. An
empty table has no shards and gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices
from .word_lookup import SIGNS, Words, spelled, spread_out, with_whole

SHARD_TOKENS = 1 << 21
BLOCK = 512         # bits between stored rank counts
PIECE = 1 << 16     # bits partitioned at once (whole bytes); their positions stay in the processor's cache
CACHED = 120_000    # words kept per worker, and as many of the generation before
SLICE = 2 << 20     # bytes of texts encoded together (one text at least)
#: Latin letters whose lower case is one letter, and signs after them (RE2).
PARTS = r"^(?P<core>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)(?P<tail>" + SIGNS + ")$"
#: Texts with these are encoded whole: the mark below, and what is white space to Python but not to the tokenizer.
ODD = "[\x01\x1c-\x1f]"
LAST = "\x01"  # stands for the end of a text
BLANKS = "[\t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

FILE_SCHEMA = ("partition int, shard int, doc_ids array<bigint>, ends array<bigint>, width int, n bigint, "
               "zeros array<bigint>, planes array<binary>, ranks array<binary>")


# --- the matrix -------------------------------------------------------------

def build(tokens: np.ndarray, width: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Zeros, packed planes and block ranks of each level."""
    zeros, planes, ranks = [], [], []
    seq = tokens
    for k in range(width - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << k)) != 0
        packed = np.packbits(bit, bitorder="little")
        pad = -len(packed) % (BLOCK // 8)
        blocks = np.concatenate([packed, np.zeros(pad, np.uint8)]).view("<u8").reshape(-1, BLOCK // 64)
        ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(blocks).sum(1))]).astype("<u4").tobytes())
        planes.append(packed.tobytes())
        n_low = len(seq) - int(np.count_nonzero(bit))
        zeros.append(n_low)
        down = np.empty_like(seq)
        low, high = 0, n_low
        for i in range(0, len(seq), PIECE):
            piece, one = seq[i:i + PIECE], np.flatnonzero(bit[i:i + PIECE])
            zero = np.flatnonzero(~bit[i:i + PIECE])
            # positions are in range; with "clip" numpy writes to ``out`` without a copy
            np.take(piece, one, out=down[high:high + len(one)], mode="clip")
            np.take(piece, zero, out=down[low:low + len(zero)], mode="clip")
            low, high = low + len(zero), high + len(one)
        seq = down
    return zeros, planes, ranks


class Shard:
    """Queries on one shard's planes."""

    def __init__(self, n: int, width: int, zeros: Sequence[int], planes: Sequence[bytes], ranks: Sequence[bytes]):
        if not len(zeros) == len(planes) == len(ranks) == width or any(len(p) != (n + 7) // 8 for p in planes):
            raise ValueError("damaged shard: planes do not match its length and width")
        self.n, self.width, self.zeros = n, width, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """1 bits of a level before position i."""
        block = i // BLOCK
        at, plane = block * (BLOCK // 8), self.planes[level]
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[at:i >> 3]).sum())
        if i & 7:
            count += (int(plane[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return count

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.width):
            bit, ones = self._bit(k, i), self._ones(k, i)
            token = token << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where occurrences before ``end`` stand below the last level."""
        a, b = 0, end
        for k in range(self.width):
            ones_a, ones_b = self._ones(k, a), self._ones(k, b)
            if token >> (self.width - 1 - k) & 1:
                a, b = self.zeros[k] + ones_a, self.zeros[k] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before position ``end``."""
        if token >> self.width or not 0 <= end <= self.n:
            return 0 if 0 <= end <= self.n else self.rank(token, min(max(end, 0), self.n))
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a level."""
        lo, hi = 0, self.n
        while lo < hi:  # the first position with more than k of them up to it
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        if token >> self.width:
            raise IndexError(k)
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _places(self, level: int, bit: int) -> np.ndarray:
        """Positions of all bits of one value on a level, in order."""
        bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
        return np.flatnonzero(bits if bit else bits ^ 1)

    def find(self, token: int) -> list[int]:
        """All positions of ``token``: its range below the last level, mapped up level by level as a whole."""
        if token >> self.width:
            return []
        a, b = self._range(token, self.n)
        at = np.arange(a, b)
        for level in range(self.width - 1, -1, -1):
            if not len(at):
                return []
            bit = token >> (self.width - 1 - level) & 1
            at = self._places(level, bit)[at - self.zeros[level] if bit else at]
        return at.tolist()

    def tokens(self) -> np.ndarray:
        """The whole sequence: the stable partitions undone from the last level up."""
        dtype = np.uint16 if self.width <= 16 else np.uint32
        seq = np.zeros(self.n, dtype)
        up = np.empty_like(seq)
        for k in range(self.width - 1, -1, -1):
            low, high = 0, self.zeros[k]
            seq[high:] |= dtype(1 << (self.width - 1 - k))
            for i in range(0, self.n, PIECE):
                piece = up[i:i + PIECE]
                bit = np.unpackbits(self.planes[k][i >> 3:(i + PIECE) >> 3], count=len(piece), bitorder="little").view(bool)
                one, zero = np.flatnonzero(bit), np.flatnonzero(~bit)
                piece[one] = seq[high:high + len(one)]
                piece[zero] = seq[low:low + len(zero)]
                low, high = low + len(zero), high + len(one)
            if low != self.zeros[k]:
                raise ValueError("damaged shard: a plane does not match its number of zeros")
            seq, up = up, seq
        return seq


# --- encoding ---------------------------------------------------------------

class WordEncoder:
    """The tokenizer over whole texts, with a lookup of white-space separated words.

    The tokenizer's normalizer and pre-tokenizer never join characters across
    white space, so the ids of a text are those of its words in order. That
    holds only for a tokenizer that drops white space; one that does not is
    refused. Texts with U+001C to U+001F, which Python would also split at, are
    encoded whole.

    Words are looked up (``word_lookup``). Those of Latin letters, less
    signs at their end, go in lower case through the tokenizer's
    model alone, as one text: such a word is one pre-token, spelled byte by byte
    here, and the ids are cut at the tokens that end a word. All others go one
    by one through the whole tokenizer.
    """

    def __init__(self, content: str, kind: str = "<u4"):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_str(content), kind
        plain = json.loads(content) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}
        self.model = Tokenizer.from_str(json.dumps(plain))
        for t in (self.tokenizer, self.model):
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # words reach it once; its own lookup only costs time
        for text in ("a b", "a  b", "a\n\tb"):
            if self._whole([text])[0] != self._whole(["a"])[0] + self._whole(["b"])[0]:
                raise ValueError("the tokenizer does not drop white space; encode whole texts")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        probe = ["Ox", "éÀa", "internationally"]
        self.plain = (self._letters([w.lower() for w in probe]) == self._packed(probe)
                      and self._whole(["ox., b"])[0] == sum(self._whole(["ox", ".,", "b"]), []))
        self.words = Words(PARTS if self.plain else r"^(?P<core>)(?P<tail>)$", self._letters,
                           self._packed, self._packed, lower=True, kept=CACHED)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self._whole(texts)]

    def _letters(self, found: list[str]) -> list[bytes]:
        """Words of Latin letters in lower case: one pre-token each, so one ending token each."""
        text = " ".join(found)
        ids = np.array(self.model.encode_batch_fast([text if text.isascii() else spelled(text, " ")], add_special_tokens=False)[0].ids, np.int64)
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) != len(found):
            return self._packed(found)
        size, data = np.dtype(self.kind).itemsize, ids.astype(self.kind).tobytes()
        return [data[a * size:b * size] for a, b in zip([0, *cuts], cuts)]

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[bytes, np.ndarray]:
        """Ids of all texts, each with ``end`` after it, as little-endian integers
        of ``kind`` one after the other; and where each text ends, in bytes."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(odd, "", texts)
        lines = pc.replace_substring(plain, "\n", " ")
        if pc.any(pc.match_substring_regex(lines, BLANKS)).as_py():
            lines = pc.replace_substring_regex(lines, BLANKS, " ")
        lists = pc.split_pattern(pc.binary_join_element_wise(lines, LAST, " "), " ")
        data, ends = spread_out(lists, lambda words: self._with_end(words, end))
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        return with_whole(data, ends, {i: b + end for i, b in zip(where, self._packed([texts[i].as_py() for i in where]))})

    def _with_end(self, words: pa.Array, end: bytes) -> pa.Array:
        found = self.words(words)
        at = pc.index(words, LAST).as_py()
        if at < 0:
            return found
        return pa.concat_arrays([found[:at], pa.array([end], pa.large_binary()), found[at + 1:]])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        data, ends = self.encode_all(pa.array(texts, pa.string()))
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


_LOADED: dict[str, WordEncoder] = {}


def _encoder(content: str, kind: str = "<u4") -> WordEncoder:
    key = hashlib.md5(content.encode()).hexdigest() + kind
    if key not in _LOADED:
        _LOADED[key] = WordEncoder(content, kind)
    return _LOADED[key]


def token_width(content: str, end_id: int) -> int:
    """Bits that hold every id of the tokenizer file."""
    d = json.loads(content)
    top = max([end_id, *d["model"]["vocab"].values(), *[a["id"] for a in d.get("added_tokens", [])]])
    return max(1, int(top).bit_length())


def encode_documents(docs: DataFrame, path: str, end_id: int = 1, *, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``: little-endian ids (16 bits where they fit) with the end id."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    held = docs.sparkSession.sparkContext.broadcast(content)  # one tokenizer file
    kind = "<u2" if token_width(content, end_id) <= 16 else "<u4"

    def run(batches):
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, ends = _encoder(held.value, kind).encode_all(part.column("text"), end)
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed], ["doc_id", "ids"])

    return (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, "doc_id bigint, ids binary"))


# --- files ------------------------------------------------------------------

def _shards(batches: Iterator[pa.RecordBatch], width: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    kind = "<u2" if width <= 16 else "<u4"
    partition = TaskContext.get().partitionId()
    ids: list[bytes] = []
    docs: list[int | None] = []
    ends: list[int] = []
    total = shard = 0

    def flush() -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(ids), kind)
        zeros, planes, ranks = build(tokens, width)
        row = {"partition": partition, "shard": shard, "doc_ids": docs, "ends": ends, "width": width,
               "n": len(tokens), "zeros": zeros, "planes": planes, "ranks": ranks}
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64(),
                 pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

    for batch in batches:
        size = 2 if width <= 16 else 4
        for doc, b in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            ids.append(b)
            docs.append(doc)
            total += len(b) // size
            ends.append(total)
            if total >= shard_tokens:
                yield flush()
                ids, docs, ends, total, shard = [], [], [], 0, shard + 1
    if docs:
        yield flush()


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1, *, id_col: str = "doc_id", text_col: str = "text",
          shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Encode and write shards in ascending id order (partition, then shard)."""
    with open(path, encoding="utf-8") as f:
        width = token_width(f.read(), end_id)
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts are range-partitioned before they are encoded: the sampling pass of
    # the range bounds would run the encoder a second time after it
    texts = (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
             .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))
    (encode_documents(texts, path, end_id)
     .mapInArrow(lambda batches: _shards(batches, width, shard_tokens), FILE_SCHEMA)
     .write.mode("overwrite").option("compression", "zstd").parquet(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: a running sum over shard lengths, first within
    partitions and then over one total per partition."""
    n = shards.select("partition", "shard", "n")
    inside = Window.partitionBy("partition").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy().orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    totals = (n.groupBy("partition").agg(F.sum("n").alias("total"))
              .withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total"))
    return (n.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "partition")
            .select("partition", "shard", (F.col("base") + F.col("inside")).cast("bigint").alias("first")))


def documents_of(shards: DataFrame) -> DataFrame:
    """Per document, from the shards' planes: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tokens = Shard(r["n"], r["width"], r["zeros"], r["planes"], r["ranks"]).tokens().astype("<u4")
                ends = np.array(r["ends"], np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(begin.tolist(), r["ends"])]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["partition"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32()),
                     pa.array(r["doc_ids"], pa.int64()), pa.array(begin, pa.int64()),
                     pa.array(ends - begin, pa.int64()), pa.array(crc, pa.int64())],
                    ["partition", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(run, "partition int, shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return (rows.join(starts(shards), ["partition", "shard"])
            .select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def lookup(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """Occurrences of some tokens in every shard, by rank and select: ``token, position`` in the whole stream."""
    wanted = list(tokens)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                s = Shard(r["n"], r["width"], r["zeros"], r["planes"], r["ranks"])
                for t in wanted:
                    at = s.find(t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["partition"]] * len(at), pa.int32()), pa.array([r["shard"]] * len(at), pa.int32()),
                         pa.array([t] * len(at), pa.int64()), pa.array(at, pa.int64())],
                        ["partition", "shard", "token", "inside"])

    rows = shards.mapInArrow(run, "partition int, shard int, token bigint, inside bigint")
    return (rows.join(starts(shards), ["partition", "shard"])
            .select("token", (F.col("first") + F.col("inside")).alias("position")))
