"""Stupid-backoff language-model scores, computed relationally.

The model counts words and word pairs of all documents; a start mark precedes
the first word of each. A word b after a scores ``c(ab) / c(a.)`` where the
pair was found ``CUTOFF`` times or more, and ``ALPHA * c(b) / N`` elsewhere;
``c(a.)`` counts a as history, N counts all words. A document's score is the
sum of the logarithms.

1. Word counts ``U``: per slice of texts, then summed by word hash.
2. Hot words are found (as word or as history) in 1 / ``HOT`` of all places or
   in ``BUCKET_PAIRS`` places, whichever is less, so one word brings a bucket
   fewer than ``BUCKET_PAIRS`` pairs at any scale, and there are at most
   2 ``HOT`` or 2 N / ``BUCKET_PAIRS`` of them; hot pairs likewise, and both
   words of a hot pair are hot. Their counts are broadcast; hot pairs are scored where the
   text is, and pairs with a hot second word spread by the hash of the pair.
3. All other pairs are exploded and partitioned by the hash of the second word.
   A partition holds every occurrence of its pairs, so it has ``c(ab)`` and
   ``c(b)`` and resolves the pairs that back off, and those with a hot history.
4. What is left meets ``U``, partitioned by the same hash, for ``c(a.)``.
5. Partial sums meet per document, one row each; until then they travel as
   blocks, too, and are added up within every task.

Exploded pairs travel in small column blocks, one per slice and hash bucket,
with repeated values written once (a few bytes a pair); the number of buckets
grows with N, so a bucket holds ``BUCKET_PAIRS`` pairs on average at any scale,
words below the hot count add less than that each, and a task holds one bucket
at a time. Words are told apart by their 64-bit hash.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case.

Defined results: a null text, or one without words, has 0 words and score 0.
Every row has a result row, repeated ones too. An empty table gives an empty
result. Texts are numbered in the order in which their task reads them, so the
input must come in the same order when a task runs again (files, a checkpoint).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, slices

ALPHA, CUTOFF = 0.4, 2
HOT = 1000
BUCKET_PAIRS = 1 << 21
SLICE = 12 << 20
START = np.uint64(0)   # hash of the start mark; a word that hashes to 0 becomes 1


# --- blocks -------------------------------------------------------------------

def _planes(column: np.ndarray) -> bytes:
    """Byte by byte of all values: the high bytes of small or rising values compress well."""
    return column.view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes()


def pack(**columns: np.ndarray) -> bytes:
    """Arrays as one compressed block; 64-bit integers as a sorted table of their
    values (as differences) and places in it."""
    head, data = [], []
    for name, column in columns.items():
        if column.dtype == np.uint64:
            table, at = np.unique(column, return_inverse=True)
            made = [(name + ".t", np.diff(table, prepend=np.uint64(0))),
                    (name, at.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32))]
        else:
            made = [(name, column)]
        for key, array in made:
            head.append([key, array.dtype.str, len(array)])
            data.append(_planes(np.ascontiguousarray(array)))
    top = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(top).to_bytes(4, "little") + top + b"".join(data))


def unpack(block: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at = 4 + int.from_bytes(raw[:4], "little")
    found = {}
    for name, dtype, n in json.loads(raw[4:at]):
        size = np.dtype(dtype).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        found[name] = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
        at += n * size
    return {name: np.cumsum(found[name + ".t"], dtype=np.uint64)[v] if name + ".t" in found else v
            for name, v in found.items() if not name.endswith(".t")}


def mix_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b >> np.uint64(32)) ^ (b << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns (first is the major one) and where groups of equals start."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


# --- texts ----------------------------------------------------------------------

def read_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising hashes of the start mark and the different words, the numbers
    there of all words one after the other, and words per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0   # blanks at the ends of a text leave empty words
    lengths = np.diff(np.append(0, np.cumsum(full))[lists.offsets.to_numpy()])
    coded = words.filter(pa.array(full)).dictionary_encode()
    hashes = [START, *(xxhash.xxh64_intdigest(w) or 1 for w in coded.dictionary.to_numpy(zero_copy_only=False))]
    h, place = np.unique(np.array(hashes, np.uint64), return_inverse=True)
    return h, place[1:][coded.indices.to_numpy()], lengths


def histories(word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The number of the word before each word; 0, the start mark, before a text's first."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    first = np.cumsum(lengths) - lengths
    before[first[lengths > 0]] = 0
    return before


def pair_counts(word: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Word, history, text and times found of each pair of each text, in this
    order; words and histories are numbers under ``size``, far below 2^31."""
    pair, own = word * size + histories(word, lengths), np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(pair, kind="stable")   # the places of a pair stay in the order of the texts
    pair, own = pair[order], own[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    b, a = np.divmod(pair[at], size)
    return b, a, own[at], np.diff(np.append(at, len(pair))).astype(np.uint32)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def word_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``h, n, p``: word hash, times found, times as history."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, word, lengths = read_texts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.bincount(word, minlength=len(h))),
                     pa.array(np.bincount(histories(word, lengths), minlength=len(h)))], ["h", "n", "p"])

    return (docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "h bigint, n bigint, p bigint")
            .groupBy("h").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))


class Hot:
    """Counts of hot words and pairs, looked up by hash."""

    def __init__(self, rows, pairs):
        rows = sorted(rows)
        self.h = np.array([r[0] for r in rows], np.uint64)
        self.n = np.array([r[1] for r in rows], np.float64)
        self.p = np.array([r[2] for r in rows], np.float64)
        pairs = sorted(pairs)
        self.pair = np.array([a * len(rows) + b for a, b, _ in pairs], np.int64)
        self.c = np.array([c for _, _, c in pairs], np.float64)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Number of a hot word, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def pair_count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Count of hot pairs of hot words, or 0."""
        if not len(self.pair):
            return np.zeros(len(a))
        key = a * len(self.h) + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair[at] == key), self.c[at], 0)


def _hot_pairs(docs: DataFrame, hot, text_col: str) -> DataFrame:
    """``a, b, c``: numbers of hot words and the count of their pair."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, word, lengths = read_texts(part.column("text"))
                place = hot.value.place(h)
                a, b = place[histories(word, lengths)], place[word]
                both = (a >= 0) & (b >= 0)
                key, c = np.unique(a[both] * len(hot.value.h) + b[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // max(1, len(hot.value.h))), pa.array(key % max(1, len(hot.value.h))),
                                                  pa.array(c)], ["a", "b", "c"])

    return (docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "a bigint, b bigint, c bigint")
            .groupBy("a", "b").agg(F.sum("c").alias("c")))


#: kinds: 0 pairs, 1 sums, 2 histories to divide by, 3 word counts, 4 texts
ROWS = "bucket bigint, kind int, block binary"
HELD_SUMS = 1 << 21    # partial sums that a task adds up before it passes them on


def _rows(bucket, kind: int, blocks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([kind] * len(blocks), pa.int32()),
                                       pa.array(blocks, pa.binary())], ["bucket", "kind", "block"])


def _dealt(bucket: np.ndarray, kind: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block per bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield _rows([int(bucket[at[0]])], kind, [pack(**{k: v[at] for k, v in columns.items()})])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows sorted by bucket to one list per bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, kind, block in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((kind, block))
    if held:
        yield now, held


def _gather(blocks: list[bytes]) -> dict[str, np.ndarray]:
    found = [unpack(b) for b in blocks]
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def home(text: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket where everything about a text meets in the end; 256 texts that
    follow each other share one, which keeps the blocks few."""
    near = text >> np.uint64(8)
    return (mix_hash(near, np.full_like(near, 7)) % np.uint64(buckets)).astype(np.int64)


class Sums:
    """Partial sums per text, added up within a task and dealt to the texts' buckets in blocks."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, key: np.ndarray, score: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        table, at = np.unique(key, return_inverse=True)
        self.held.append((table, np.bincount(at, weights=score, minlength=len(table)),
                          np.bincount(at, weights=n, minlength=len(table)).astype(np.uint32)))
        self.size += len(table)
        if self.size > HELD_SUMS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            key, score, n = (np.concatenate(c) for c in zip(*self.held))
            table, at = np.unique(key, return_inverse=True)
            yield from _dealt(home(table, self.buckets), 1, key=table, score=np.bincount(at, weights=score),
                              n=np.bincount(at, weights=n).astype(np.uint32))
        self.held, self.size = [], 0


def hot_count(total: int, hot_share: int = HOT, bucket_pairs: int = BUCKET_PAIRS) -> int:
    """Places from which on a word or pair is hot; never more than ``bucket_pairs``, however many words there are."""
    return min(-(-total // hot_share), bucket_pairs)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA,
          cutoff: int = CUTOFF, hot_share: int = HOT, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``doc_id, n_words, log_score`` per row; the model is of all rows."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "word-counts")
    word_counts(docs, text_col=text_col).write.parquet(folder)
    counts = spark.read.parquet(folder)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return _texts(docs, id_col, text_col).select("doc_id", F.lit(0).cast("bigint").alias("n_words"),
                                                     F.lit(0.0).alias("log_score"))
    hot_from = hot_count(total, hot_share, bucket_pairs)
    words = [(r.h % (1 << 64), r.n, r.p) for r in
             counts.where(F.greatest("n", "p") >= hot_from).collect()]  # at most 2 * total / hot_from
    first = spark.sparkContext.broadcast(Hot(words, []))
    pairs = [(r.a, r.b, r.c) for r in _hot_pairs(docs, first, text_col).where(F.col("c") >= hot_from).collect()]
    hot = spark.sparkContext.broadcast(Hot(words, pairs))
    buckets = max(parts, -(-total // bucket_pairs))
    log_total = float(np.log(total))

    def explode(batches):
        from pyspark import TaskContext
        # texts are numbered within the task; the numbers travel instead of ids
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, word, lengths = read_texts(part.column("text"))
                ids = part.column("doc_id")
                mine = np.arange(number, number + part.num_rows, dtype=np.uint64)
                number += part.num_rows
                yield from _dealt(home(mine, buckets), 4, text=mine,
                                  valid=np.asarray(ids.is_valid()).astype(np.uint8), doc_id=ids.fill_null(0).to_numpy())
                b, a, own, n = pair_counts(word, lengths, len(h))
                place = hot.value.place(h)
                pa_, pb, a, b, own = place[a], place[b], h[a], h[b], mine[own]
                c = hot.value.pair_count(pa_, pb)
                known = c > 0
                s = np.zeros(len(c))
                s[known] = np.log(c[known]) - np.log(hot.value.p[pa_[known]])
                sums = Sums(buckets)
                yield from sums.add(own[known], (s * n)[known], n[known])
                yield from sums.flush()
                rest = ~known
                spread = np.where(pb >= 0, mix_hash(a, b), b)[rest]
                yield from _dealt((spread % np.uint64(buckets)).astype(np.int64), 0,
                                  b=b[rest], a=a[rest], text=own[rest], n=n[rest])

    def resolve(batches):
        sums = Sums(buckets)
        for bucket, held in _by_bucket(batches):
            for kind, block in held:
                if kind == 1:
                    f = unpack(block)
                    yield from sums.add(f["key"], f["score"], f["n"])
                elif kind == 4:
                    yield _rows([bucket], 4, [block])
            blocks = [b for kind, b in held if kind == 0]
            if not blocks:
                continue
            f = _gather(blocks)
            order, at = groups(f["b"], f["a"])
            a, b, text, n = f["a"][order], f["b"][order], f["text"][order], f["n"][order].astype(np.int64)
            size = np.diff(np.append(at, len(a)))
            c = np.repeat(np.add.reduceat(n, at), size)
            words_at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            cb = np.repeat(np.add.reduceat(n, words_at), np.diff(np.append(words_at, len(b)))).astype(float)
            pb, pa_ = hot.value.place(b), hot.value.place(a)
            if len(hot.value.n):
                cb = np.where(pb >= 0, hot.value.n[pb], cb)
            seen = c >= cutoff
            s = np.log(alpha) + np.log(cb) - log_total
            s[seen] = np.log(c[seen])
            now = seen & (pa_ >= 0)
            s[now] -= np.log(hot.value.p[pa_[now]])
            yield from sums.add(text, s * n, n)
            # the count of other histories is subtracted after the join with U
            left = seen & (pa_ < 0)
            order, at = groups(a[left], text[left])
            if len(order):
                la, lt, ln = a[left][order], text[left][order], n[left][order]
                yield from _dealt((la[at] % np.uint64(buckets)).astype(np.int64), 2,
                                  a=la[at], text=lt[at], n=np.add.reduceat(ln, at).astype(np.uint32))
        yield from sums.flush()

    def send_counts(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield from _dealt((h % np.uint64(buckets)).astype(np.int64), 3, h=h,
                              p=batch.column("p").to_numpy().astype(np.uint32 if total < 1 << 32 else np.uint64))

    def divide(batches):
        sums = Sums(buckets)
        for bucket, held in _by_bucket(batches):
            for kind, block in held:
                if kind == 1:
                    f = unpack(block)
                    yield from sums.add(f["key"], f["score"], f["n"])
                elif kind == 4:
                    yield _rows([bucket], 4, [block])
            blocks = [b for kind, b in held if kind == 2]
            if not blocks:
                continue
            u, f = _gather([b for kind, b in held if kind == 3]), _gather(blocks)
            order = np.argsort(u["h"])
            p = u["p"][order][np.searchsorted(u["h"][order], f["a"])].astype(float)
            yield from sums.add(f["text"], -np.log(p) * f["n"], np.zeros(len(p)))
        yield from sums.flush()

    def finish(batches):
        for _, held in _by_bucket(batches):
            f = _gather([b for kind, b in held if kind == 4])
            order = np.argsort(f["text"])
            score, n = np.zeros(len(order)), np.zeros(len(order), np.int64)
            for kind, block in held:
                if kind == 1:
                    part = unpack(block)
                    at = np.searchsorted(f["text"], part["key"], sorter=order)
                    score[at] += part["score"]
                    n[at] += part["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f["doc_id"][order], pa.int64(), mask=f["valid"][order] == 0), pa.array(n), pa.array(score)],
                ["doc_id", "n_words", "log_score"])

    texts = _texts(docs, id_col, text_col)
    met = (texts.mapInArrow(explode, ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket")
           .mapInArrow(resolve, ROWS))
    divided = (met.unionByName(counts.mapInArrow(send_counts, ROWS)).repartition(parts, "bucket")
               .sortWithinPartitions("bucket").mapInArrow(divide, ROWS))
    return (divided.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(finish, "doc_id bigint, n_words bigint, log_score double"))
