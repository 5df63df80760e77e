"""Text vectors and vector checks: E1-E4.

E1 runs as an iterator Arrow UDF so the encoder is built once per Python
worker and fed whole Arrow batches (64 prompts per encoder call by default).
The encoder is a parameter; the built-in one is a hashed-token encoder that
needs no weights. E3/E4 are native array expressions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SEQ_LEN = 32
_TOKEN = re.compile(r"\w+|[^\w\s]", re.UNICODE)


class HashedTokenEncoder:
    """Deterministic text encoder: every token gets a fixed pseudo-random unit
    vector (seeded by its hash) plus a position signal; output is
    ``(seq_len, dim)`` float32 per text, zero-padded. Texts longer than
    ``seq_len`` tokens are not cut: the last slot holds the mean of every
    remaining token, so the whole text contributes. ``cut=True`` drops what is
    beyond ``seq_len`` tokens instead, as fixed-length encoders do."""

    def __init__(self, dim: int = 64, seq_len: int = SEQ_LEN, cut: bool = False):
        self.dim, self.seq_len, self.cut = dim, seq_len, cut
        pos = np.arange(seq_len)[:, None] / np.power(10000.0, np.arange(dim)[None, :] / dim)
        self.position = (0.1 * np.where(np.arange(dim) % 2 == 0, np.sin(pos), np.cos(pos))).astype(np.float32)

    @lru_cache(maxsize=200_000)
    def token_vector(self, token: str) -> np.ndarray:
        rng = np.random.default_rng(xxhash.xxh64_intdigest(token))
        v = rng.standard_normal(self.dim)
        return (v / np.linalg.norm(v)).astype(np.float32)

    def encode(self, texts: list[str]) -> np.ndarray:
        """One token table per batch, then vectorised scatter: head tokens go
        to their slots, the rest of a long text is averaged into the last."""
        n, head_len = len(texts), self.seq_len - 1
        out = np.zeros((n, self.seq_len, self.dim), dtype=np.float32)
        toks = [_TOKEN.findall((t or "").lower()) for t in texts]
        if self.cut:
            toks = [ts[:self.seq_len] for ts in toks]
            head_len = self.seq_len
        vocab = {}
        for ts in toks:
            for tok in ts:
                vocab.setdefault(tok, len(vocab))
        if not vocab:
            return out
        table = np.stack([self.token_vector(t) for t in vocab])
        lens = np.fromiter((len(ts) for ts in toks), np.int64, n)
        ids = np.fromiter((vocab[t] for ts in toks for t in ts), np.int64, int(lens.sum()))
        row = np.repeat(np.arange(n), lens)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        head = pos < head_len
        out[row[head], pos[head]] = table[ids[head]] + self.position[pos[head]]
        tail = ~head
        if tail.any():
            sums = np.zeros((n, self.dim), dtype=np.float64)
            np.add.at(sums, row[tail], table[ids[tail]])
            extra = np.maximum(lens - head_len, 0)
            has = extra > 0
            out[has, head_len] = (sums[has] / extra[has, None]).astype(np.float32) + self.position[head_len]
        return out


def embed_text(df: DataFrame, text_col: str, out_col: str = "vectors", *, dim: int = 64,
               seq_len: int = SEQ_LEN, batch_size: int = 64, cut: bool = False, encoder_factory=None) -> DataFrame:
    """Batch-encode a text column into ``array<array<float>>`` (seq_len x dim).

    Longer texts end in the mean of their remaining tokens, or are cut off
    after ``seq_len`` tokens with ``cut`` (built-in encoder).

    ``encoder_factory()`` must return an object with ``encode(list[str]) ->
    ndarray[n, seq_len, dim]``; it is called once per Python worker process.
    """
    factory = encoder_factory or (lambda: HashedTokenEncoder(dim, seq_len, cut))

    @arrow_udf("array<array<float>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = factory()
        for batch in batches:
            texts = batch.to_pylist()
            parts = [enc.encode(texts[i:i + batch_size]) for i in range(0, len(texts), batch_size)]
            arr = np.concatenate(parts) if parts else np.zeros((0, seq_len, dim), np.float32)
            n, slots, width = arr.shape
            steps = lambda count, size: np.arange(0, count * size + 1, max(size, 1), dtype=np.int32)[:count + 1]
            rows = pa.ListArray.from_arrays(steps(n * slots, width), pa.array(np.ascontiguousarray(arr, np.float32).reshape(-1)))
            yield pa.ListArray.from_arrays(steps(n, slots), rows)

    return df.withColumn(out_col, encode(F.coalesce(F.col(text_col), F.lit(""))))


CURRENT = "CURRENT"


def current_version(spark: SparkSession, root: str) -> str | None:
    """Folder of the published version under ``root``; none yet: null."""
    from ..sources.corpus import path_exists
    pointer = f"{root.rstrip('/')}/{CURRENT}"
    if not path_exists(spark, pointer):
        return None
    return f"{root.rstrip('/')}/{spark.read.option('wholetext', 'true').text(pointer).first()[0]}"


def read_version(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The published vectors and the meta records that belong to them."""
    version = current_version(spark, root)
    if version is None:
        raise ValueError(f"no version is published under {root}")
    return spark.read.parquet(f"{version}/vectors"), spark.read.parquet(f"{version}/meta")


def _point_to(spark: SparkSession, root: str, name: str) -> None:
    """Replace the pointer by one rename over the old one (atomic on HDFS and on mounts)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    pointer, staged = path(f"{root.rstrip('/')}/{CURRENT}"), path(f"{root.rstrip('/')}/.{CURRENT}-{uuid.uuid4().hex}")
    out = staged.getFileSystem(conf).create(staged)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf)
    context.rename(context.makeQualified(staged), context.makeQualified(pointer), over)


def refresh_version(prompts: DataFrame, meta: DataFrame, root: str, *, key=("shard", "row_id"), text_col: str = "instruction",
                    dim: int = 64, seq_len: int = SEQ_LEN, encoder: str = "hashed-token", keep_old: bool = False, **kw) -> DataFrame:
    """Recompute the vectors of a stored corpus and publish them together
    with the updated meta records; images are never touched.

    Vectors and meta go into a folder of their own; readers see them when the
    pointer file under ``root`` is replaced, the last step. A run that fails
    before it leaves the old version as it is. Refuses when the prompts of a
    shard are not as many as its meta record says. The version before the last
    one is kept for readers that still hold it; with ``keep_old`` all are.
    """
    spark = prompts.sparkSession
    have = prompts.groupBy(key[0]).agg(F.count(F.lit(1)).alias("_have"))
    said = meta.select(F.struct(key[0]).alias("_k"), "n")
    odd = (have.select(F.struct(key[0]).alias("_k"), "_have").join(said, "_k", "full")
           .where(~F.col("_have").eqNullSafe(F.col("n"))))
    wrong = odd.limit(3).collect()
    if wrong:
        raise ValueError("refusing to re-embed: " + "; ".join(f"shard {r._k[0]} has {r._have} prompts, its meta says {r.n}" for r in wrong))
    before = current_version(spark, root)
    name = f"v-{uuid.uuid4().hex}"
    folder = f"{root.rstrip('/')}/{name}"
    # narrow rows are dealt by key range and sorted first: a file holds the shards of a range (a folder a shard
    # would cost a file each), a large shard is many tasks, and the statistics of a file tell its shards. The
    # count is given because the narrow rows' size, by which it would be chosen, says nothing of the vectors'.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = prompts.select(*key, text_col).repartitionByRange(tasks, *key).sortWithinPartitions(*key)
    embed_text(dealt, text_col, dim=dim, seq_len=seq_len, **kw).drop(text_col).write.parquet(f"{folder}/vectors")
    refresh_meta(meta, dim, seq_len, encoder).write.parquet(f"{folder}/meta")
    _point_to(spark, root, name)
    if not keep_old:
        _drop_versions(spark, root, {name, before.rsplit("/", 1)[1] if before else name})
    return read_version(spark, root)[0]


def _drop_versions(spark: SparkSession, root: str, keep: set[str]) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in files.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("v-") and name not in keep:
            files.delete(f.getPath(), True)


def refresh_embeddings(prompts: DataFrame, meta_n: int, out_path: str, *, key=("shard", "row_id"),
                       text_col: str = "instruction", **kw) -> DataFrame:
    """E2 without meta records: as ``refresh_version``, for a corpus of ``meta_n`` rows in all."""
    n = prompts.count()
    if n != meta_n:
        raise ValueError(f"{n} prompts but the corpus says n={meta_n}; refusing to re-embed")
    per_shard = prompts.groupBy(key[0]).agg(F.count(F.lit(1)).alias("n"))
    meta = per_shard.select(key[0], "n", F.to_json(F.struct("n")).alias("meta_json"))
    return refresh_version(prompts, meta, out_path, key=key, text_col=text_col, **kw)


def refresh_meta(meta: DataFrame, dim: int, seq_len: int, encoder: str) -> DataFrame:
    """E2's meta update: ``meta_json`` of every shard with the new vectors' shape
    and encoder name; all other fields stay as they are."""
    fields = "n bigint, val_n bigint, res bigint, source string, counts map<string,bigint>"
    m = F.from_json("meta_json", fields)
    return meta.withColumn("meta_json", F.to_json(F.struct(
        *[m[f.split()[0]].alias(f.split()[0]) for f in fields.split(", ")],
        F.lit(dim).alias("text_dim"), F.lit(seq_len).alias("seq_len"), F.lit(encoder).alias("encoder"))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def label_centroids(emb: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Mean vector per label: (label, centroid array<double>).

    Vectors are exploded to (label, pos, value) and averaged with a partial
    aggregate, so a label holding a third of the rows is still combined
    map-side; each centroid has ``dim`` entries, bounded by the vector size.
    """
    long = emb.select(label_col, F.posexplode(vec_col).alias("pos", "v"))
    means = long.groupBy(label_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def cond_sensitivity(emb: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                     id_col: str = "vec_id") -> DataFrame:
    """Cosine and relative difference norm of each vector against its
    label's centroid (the conditional vs the unconditional direction)."""
    c = label_centroids(emb, vec_col, label_col)
    j = emb.select(id_col, label_col, vec_col).join(c, label_col)
    a, b = F.col(vec_col), F.col("centroid")
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y)
    return j.select(id_col, label_col,
                    F.round(_dot(a, b) / (norm(a) * norm(b)), 6).alias("cosine"),
                    F.round(norm(diff) / norm(b), 6).alias("rel_diff"))


def vector_health(emb: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id",
                  min_norm: float = 1e-6) -> DataFrame:
    """Per vector, non-finite entries, all-zero, norm and too-small norm."""
    v = F.col(vec_col)
    bad = F.size(F.filter(v, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    n = norm(v)
    return emb.select(id_col, bad.cast("bigint").alias("n_nonfinite"),
                      F.forall(v, lambda x: x == 0).alias("all_zero"),
                      F.round(n, 6).alias("norm"), (n < min_norm).alias("tiny"))
