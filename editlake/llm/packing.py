"""Packing by power-of-two decomposition.

A document's ids (with its end id) are cut into pieces whose lengths are powers
of two: whole pieces of ``max_length`` first, then the binary digits of what is
left, large to small. Every piece is a sequence of its own, so no sequence
crosses documents and none needs padding. Pieces of equal length share a
bucket; a trainer reads batches of one length. Sequences are numbered bucket by
bucket, long ones first: a task counts its pieces per length, a running sum
over those counts (one row per length and task) gives each task its first
number, and no piece is shuffled.

Texts are encoded word by word where that is exact. The split pattern of
byte-level BPE ends a match before every run of white space, so the ids of a
text are those of its words in order, each with the one space or line feed
before it. Texts with other white space (runs of it, tabs, no-break spaces) are
encoded whole. Words met before are looked up; the lookup keeps two generations
of bounded size, which changes time but no result. A tokenizer that works
differently is refused.

Defined results: a null or empty text is its end id alone, one piece of length
1. Rows are independent, so repeated rows and null ids repeat their pieces; an
empty table gives an empty result. Strings of special tokens in a text are
ordinary text. A worker holds one slice of texts (4 MB, one text at least).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices
from .word_lookup import SIGNS, SPACE, Words, spelled, spread_out, with_whole

MAX_LENGTH = 1024
CACHED = 250_000        # words kept per worker, and as many of the generation before
SLICE = 4 << 20
FEW_COUNTS = 100_000    # rows of the numbering table that are broadcast; more are joined by a shuffle
#: Texts with these are encoded whole: runs of white space, other white space, and the marks below.
ODD = "[ \n][ \n]|[\\x00\\x01\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
FIRST, LAST = "\0", "\1"   # marks before the first word and for the end of a text
#: A word of letters, and signs after it that letters never join (RE2).
PARTS = r"^(?P<core>\pL+)(?P<tail>" + SIGNS + ")$"


class ByteEncoder:
    """Whole texts through a byte-level BPE tokenizer file, word by word."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words reach it once; its own lookup only costs time
        for text in ("an ox.", "an\nox, 1", "é 中\nx"):
            cut = re.findall(r"[ \n]?[^ \n]+", text)
            if self._whole([text])[0] != sum(self._whole(cut), []):
                raise ValueError("the tokenizer does not cut texts before white space")
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        # the same model behind a plainer split: for letters, whose bytes are spelled out here
        plain = json.loads(content) | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}
        self.model = Tokenizer.from_str(json.dumps(plain))
        if hasattr(self.model.model, "_resize_cache"):
            self.model.model._resize_cache(0)
        if self._letters(["ox", "Éé中"]) != self._packed([" ox", " Éé中"]):
            raise ValueError("the tokenizer does not spell bytes like byte-level BPE")
        self.words = Words(PARTS, self._letters, self._packed, self._others, kept=CACHED)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self._whole(texts)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters, each after a space: as one text, cut where a token begins with the space."""
        if not words:
            return []
        joined = "\n" + "\n".join(words)
        text = joined.replace("\n", "\n" + SPACE) if joined.isascii() else spelled(joined.replace("\n", "\n "), "\n")
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.begins[ids]).tolist()
        if len(cuts) != len(words):
            return self._packed([" " + w for w in words])
        data = ids.tobytes()
        return [data[4 * a:4 * b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]

    def _others(self, words: list[str]) -> list[bytes]:
        """``word`` stands for a space and the word, ``\\nword`` for a line feed
        and the word, ``\\0word`` for a word that begins a text."""
        return self._packed([w[1:] if w[:1] == FIRST else w if w[:1] == "\n" else " " + w for w in words])

    def encode(self, texts: pa.Array, end: bytes) -> tuple[bytes, np.ndarray]:
        """Ids of all texts, each with ``end`` after it, as little-endian unsigned
        32-bit integers one after the other; and where each text ends, in bytes."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(odd, "", texts)
        lists = pc.split_pattern(pc.replace_substring(
            pc.binary_join_element_wise(FIRST, plain, " " + LAST, ""), "\n", " \n"), " ")
        data, ends = spread_out(lists, lambda words: self._with_end(words, end))
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        return with_whole(data, ends, {i: b + end for i, b in zip(where, self._packed([texts[i].as_py() for i in where]))})

    def _with_end(self, words: pa.Array, end: bytes) -> pa.Array:
        found = self.words(words)
        at = pc.index(words, LAST).as_py()
        if at < 0:
            return found
        return pa.concat_arrays([found[:at], pa.array([end], pa.large_binary()), found[at + 1:]])


_LOADED: dict[str, ByteEncoder] = {}


def _encoder(content: str) -> ByteEncoder:
    key = hashlib.md5(content.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteEncoder(content)
    return _LOADED[key]


def lengths_of(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """``n`` as whole pieces of ``max_length`` (a power of two) and binary digits, large to small."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 1, -1, -1) if rest >> b & 1]


def split_pieces(docs: DataFrame, path: str, end_id: int, *, max_length: int = MAX_LENGTH, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and cut: ``doc_id, start, length, ids_crc32, doc_tokens``, the task and
    the place among its pieces of that length (``part``, ``place``), and ``ids``."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    with open(path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # one tokenizer file
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {id_type}, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, part int, place bigint"
    parts_of: dict[int, np.ndarray] = {}

    def pieces(n: int) -> np.ndarray:
        rest = n % max_length
        if rest not in parts_of:
            parts_of[rest] = np.array(lengths_of(rest, max_length), np.int64)
        return np.concatenate([np.full(n // max_length, max_length, np.int64), parts_of[rest]])

    def run(batches):
        from pyspark import TaskContext
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(max_length.bit_length(), np.int64)
        for batch in batches:
            for some in slices(batch, "text", SLICE):
                ids, ends = _encoder(held.value).encode(some.column("text"), end)
                tokens = np.diff(ends, prepend=0) >> 2
                cuts = [pieces(n) for n in tokens.tolist()]
                count = np.array([len(c) for c in cuts], np.int64)
                doc, length = np.repeat(np.arange(len(cuts)), count), np.concatenate(cuts)
                first = np.cumsum(length) - length
                start = first - np.repeat(np.cumsum(tokens) - tokens, count)
                data = memoryview(ids)
                spans = list(zip((4 * first).tolist(), (4 * (first + length)).tolist()))
                place = np.empty(len(length), np.int64)
                for b in range(len(seen)):
                    at = np.flatnonzero(length == 1 << b)
                    place[at] = seen[b] + np.arange(len(at))
                    seen[b] += len(at)
                cols = [some.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)),
                        pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64()), pa.array(tokens[doc]),
                        pa.array(np.full(len(length), part, np.int32)), pa.array(place)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
                if keep_ids:
                    cols, names = [*cols, pa.array([data[a:b].tobytes() for a, b in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, fields + (", ids binary" if keep_ids else "")))


def pack(docs: DataFrame, path: str, end_id: int, *, max_length: int = MAX_LENGTH, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces with ``sequence_id`` (gapless, long sequences first) and ``offset`` (0)."""
    made = cut_lineage(split_pieces(docs, path, end_id, max_length=max_length, id_col=id_col, text_col=text_col, keep_ids=keep_ids))
    # one row per length and task: rows before it in the order (length down, task up)
    tally = cut_lineage(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    inside = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.partitionBy().orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = tally.groupBy("length").agg(F.sum("n").alias("n")).select(
        "length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))  # a row per length, at most 11
    first = (tally.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
             .join(F.broadcast(buckets), "length")
             .select("length", "part", (F.col("base") + F.col("inside")).alias("first")))
    if tally.count() <= FEW_COUNTS:
        first = F.broadcast(first)
    return (made.join(first, ["length", "part"])
            .withColumn("sequence_id", F.col("first") + F.col("place")).withColumn("offset", F.lit(0).cast("bigint"))
            .drop("first", "place", "part"))


def write(packed: DataFrame, folder: str) -> None:
    """Sequences as Parquet, one folder per length (``length=1024``, ``length=512``, ...)."""
    packed.write.mode("overwrite").option("compression", "zstd").partitionBy("length").parquet(folder)


def read(spark, folder: str, length: int | None = None) -> DataFrame:
    """Written sequences; of one length, only that bucket's files are read."""
    found = spark.read.parquet(folder)
    return found if length is None else found.where(F.col("length") == length)
