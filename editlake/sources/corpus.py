"""Corpus sources and sinks: S1, S3 (JSON sink), S6-S9, S11, S12.

Everything here is a plain DataFrame reader or writer: Parquet scans with
column pruning and file metadata, JSON sidecars parsed with ``from_json`` +
``posexplode``, and commit-protocol writes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_COLUMNS = ["edit_type", "edit_instruction", "image_file", "edited_file"]
_SHARD_RE = r"(\d+)-of-\d+"


def scan_corpus(spark: SparkSession, path: str | list[str], *, tolerant: bool = False, shard_of: str = "number") -> DataFrame:
    """S1 (+ S12): read only type, instruction and the two image columns of
    a Parquet corpus, with the shard number from the file name and a stable
    ``row_id``: the row's position in its file (``_metadata.row_index``), so
    (shard, row_id) is the same key on every run, unlike an id generated at
    read time.

    Catalyst prunes the scan to these four columns (the captions are never
    read). An unreadable file fails the job; with ``tolerant`` it is skipped,
    and ``skipped_files`` tells which files gave no rows. A file whose name
    carries no shard number (Spark's own part files) is a shard of its own: its
    number is negative and a hash of its path, so no row has a null ``shard``.

    Files with equal numbers (``add/00000-of-00010``, ``replace/00000-of-00010``)
    would share row keys, so they are refused; ``shard_of="path"`` keys every
    file by a hash of its path instead. A shard that is a folder holds one file.
    """
    if shard_of not in ("number", "path"):
        raise ValueError(f"shard_of is number or path, not {shard_of}")
    reader = spark.read
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    if shard_of == "number":
        seen: dict[int, str] = {}
        for name in df.inputFiles():  # the planner's own list of files
            if found := re.search(_SHARD_RE, name):
                place = name[:found.end()]  # of a shard that is a folder, the folder
                if (first := seen.setdefault(int(found[1]), place)) != place:
                    raise ValueError(f"two files are shard {int(found[1])}: {first} and {place}; pass shard_of='path'")
    return df.select(*CORPUS_COLUMNS,
                     _shard(F.col("_metadata.file_path"), shard_of).alias("shard"),
                     F.col("_metadata.row_index").cast("bigint").alias("row_id"),
                     F.col("_metadata.file_name").alias("file_name"))


def _shard(path: Column, shard_of: str) -> Column:
    """The shard of a file: the number in its path, or a negative hash of the path."""
    number = F.regexp_extract(path, _SHARD_RE, 1)
    own = F.xxhash64(path).bitwiseOR(F.lit(-(1 << 63)))
    return F.when((number != "") & F.lit(shard_of == "number"), number.cast("bigint")).otherwise(own)


def shard_rows(corpus: DataFrame, shard_of: str = "number") -> DataFrame:
    """(shard, rows) of every file with rows of a ``scan_corpus`` (``shard_of`` as
    given there; not a tolerant one), from the footers: for corpora of very many
    small files, where a scan's cost is that of opening each in a task."""
    from urllib.parse import unquote

    import pyarrow as pa
    import pyarrow.parquet as pq

    from .packed import store

    def count(batches):
        stores = {}
        for b in batches:
            rows = []
            for name in b.column("value").to_pylist():
                folder, _, last = name.rpartition("/")
                folder = unquote(folder) if name.startswith("file:") else folder  # other stores take URIs
                if folder not in stores:
                    stores[folder] = store(folder)
                files, at = stores[folder]
                rows.append(pq.read_metadata(f"{at}/{unquote(last)}", filesystem=files).num_rows)
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(rows, pa.int64())], names=["value", "rows"])

    names = corpus.sparkSession.createDataFrame(sorted(corpus.inputFiles()), "string")  # the planner's own list of files
    path = F.regexp_replace("value", "^([^/:]+):///", "$1:/")  # as the scan's metadata column writes it
    return (names.mapInArrow(count, "value string, rows bigint").where("rows > 0")
            .select(_shard(path, shard_of).alias("shard"), "rows"))



def write_files(rows: DataFrame, path: str, name_col: str) -> int:
    """A Parquet file ``<path>/<name>.parquet`` for every value of ``name_col``, from
    rows that are partitioned and sorted by it; returns the number of files.

    For corpora of very many small files: tasks write the files in place, row
    batches as they come, where ``write.partitionBy`` makes a folder each and
    moves it when the job commits. A file appears under its name when it is
    whole; the job's end tells that all are there. ``path`` is a folder that all
    executors have, or a store that pyarrow opens.
    """
    import uuid

    import pyarrow as pa
    import pyarrow.parquet as pq

    from .packed import store

    def write(batches):
        files, at = store(path)
        files.create_dir(at, recursive=True)
        current, writer, staged, n = None, None, f"{at}/.{uuid.uuid4().hex}", 0

        def close():
            if writer is not None:
                writer.close()
                files.move(staged, f"{at}/{current}.parquet")

        try:
            for b in batches:
                values = b.column(name_col).to_pylist()
                cuts = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)] if values else []
                content = b.drop_columns([name_col])
                for first, end in zip(cuts, cuts[1:]):
                    if writer is None or values[first] != current:
                        close()
                        current, n = values[first], n + 1
                        writer = pq.ParquetWriter(staged, content.schema, filesystem=files)
                    writer.write_batch(content.slice(first, end - first))
            close()
        except BaseException:
            if writer is not None:
                writer.close()
                files.delete_file(staged)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_shard_map(shard_json: DataFrame, path: str) -> None:
    """S3 sink: one JSON line per shard (``{"shard": .., "rows": .., "types": {..}}``)."""
    (shard_json.select("shard", F.from_json("entry_json", "rows bigint, types map<string,bigint>")
                       .alias("e"))
     .select("shard", "e.rows", "e.types").write.mode("overwrite").json(path))


def skipped_files(spark: SparkSession, path: str, scanned: DataFrame) -> DataFrame:
    """S12 files: Parquet files under ``path`` that gave no row to ``scanned``
    (a tolerant ``scan_corpus``): (file_name, length). Lists names and lengths
    only; no content is read."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").load(path)
              .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length"))
    return listed.join(scanned.select("file_name").distinct(), "file_name", "left_anti")


def sidecar_arrays(corpus: DataFrame, value_col: str, order_col: str = "row_id",
                   key: str = "shard") -> DataFrame:
    """One JSON array per shard of ``value_col`` in row order (the sidecar
    file format of a packed shard). A shard's array is one record, as in the
    format itself, and has one slot per row: a null value is a null slot, so
    later values keep their positions."""
    arr = corpus.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order_col, value_col))).alias("a"))
    return arr.select(key, F.to_json(F.transform("a", lambda s: s[value_col]), {"ignoreNullFields": "false"}).alias("json"))


def read_sidecar(json_arrays: DataFrame, name: str, key: str = "shard") -> DataFrame:
    """JSON array per shard -> (shard, pos, value), pos 0-based."""
    return json_arrays.select(key, F.posexplode(F.from_json("json", "array<string>")).alias("pos", name)) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def join_sidecars(prompts: DataFrame, types: DataFrame, mode: str = "train",
                  key: str = "shard") -> DataFrame:
    """Prompts and types joined by position. ``train`` pads a short
    types list with '' (left join); ``probe`` truncates to the shorter list."""
    if mode == "train":
        j = prompts.join(types, [key, "pos"], "left")
        return j.withColumn("edit_type", F.coalesce(F.col("edit_type"), F.lit("")))
    return prompts.join(types, [key, "pos"], "inner")


def sidecar_default(corpus: DataFrame, col: str = "edit_type_nullable", mode: str = "probe") -> DataFrame:
    """A missing type reads as '?' (probe) or null (train)."""
    label = F.coalesce(F.col(col), F.lit("?")) if mode == "probe" else F.col(col)
    return corpus.withColumn("label", label)


def write_meta(corpus: DataFrame, want_val: int, res: int, source: str,
               key: str = "shard") -> DataFrame:
    """{n, val_n, res, source, counts} per output shard, as JSON text.
    ``val_n = least(want_val, n div 10)``; counts has one entry per type."""
    per_type = corpus.groupBy(key, "edit_type").agg(F.count(F.lit(1)).cast("bigint").alias("c"))
    meta = per_type.groupBy(key).agg(
        F.sum("c").cast("bigint").alias("n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("edit_type", "c")))).alias("counts"))
    meta = meta.select(key, "n", F.least(F.lit(want_val).cast("bigint"),
                                         F.floor(F.col("n") / 10).cast("bigint")).alias("val_n"),
                       F.lit(res).cast("bigint").alias("res"), F.lit(source).alias("source"), "counts")
    return meta.select(key, "n", "val_n", "res", "source",
                       F.to_json(F.struct("n", "val_n", "res", "source", "counts")).alias("meta_json"))



def union_shards(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Every shard output under ``root`` read as one logical table, each
    row tagged with the shard number of the last path segment that names one. Shards with
    extra columns are aligned by name (missing ones are null)."""
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").format(fmt).load(root)
    num = F.regexp_extract(F.col("_metadata.file_path"), r".*/[^/]*shard[=_-]?(\d+)", 1)
    return df.withColumn("source_shard", F.when(num != "", num.cast("bigint")))


def skip_if_complete(spark: SparkSession, target: str, n: int, fmt: str = "parquet") -> bool:
    """True when ``target`` already holds at least ``n`` rows (nothing to do).

    A missing target is not complete; any other failure to read it is raised."""
    if not path_exists(spark, target):
        return False
    return spark.read.format(fmt).load(target).count() >= n


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that Spark would read it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def run_unless_complete(spark: SparkSession, target: str, n: int, make, fmt: str = "parquet") -> DataFrame:
    """S11 as a job: write ``make()`` to ``target`` unless it already holds
    ``n`` rows; returns the table either way."""
    if not skip_if_complete(spark, target, n, fmt):
        make().write.mode("overwrite").format(fmt).save(target)
    return spark.read.format(fmt).load(target)



def tolerant_decode(df: DataFrame, cell_col: str, keep: tuple[str, ...] = ("img_id",), name: str = "decode"):
    """S12 rows: decode image cells, drop the unreadable ones, and report how
    many rows were read and how many were dropped.

    Returns ``(good_rows, observation)``; ``observation.get`` holds
    ``{"rows": .., "bad": ..}`` once an action has run on ``good_rows``. The
    counts come from the same pass that produces the rows (``df.observe``),
    not from a second scan.
    """
    from pyspark.sql import Observation

    from ..operators.images import decode_images
    obs = Observation(name)
    decoded = decode_images(df, cell_col, keep).observe(
        obs, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("ok")).alias("bad"))
    return decoded.where(F.col("ok")), obs


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """I1 for image files: Spark's ``image`` source decodes PNG/JPEG/...; its
    pixels are BGR(A), row-interleaved, so one Arrow batch job turns them into
    RGB CHW bytes. Unreadable files stay as rows with ``ok = false``.

    Returns (path, ok, height, width, px BINARY CHW RGB).
    """
    import numpy as np
    import pyarrow as pa

    img = (spark.read.format("image").option("dropInvalid", "false").load(path)
           .select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"),
                   F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"),
                   F.col("image.data").alias("data")))

    def run(batches):
        for b in batches:
            hs, ws, cs = (b.column(k).to_pylist() for k in ("h", "w", "c"))
            datas = b.column("data").to_pylist()
            oks, pxs = [], []
            for h, w, c, d in zip(hs, ws, cs, datas):
                if h is None or h <= 0 or not d or len(d) != h * w * c:
                    oks.append(False)
                    pxs.append(None)
                    continue
                a = np.frombuffer(d, np.uint8).reshape(h, w, c)
                rgb = a[..., [2, 1, 0]] if c >= 3 else np.repeat(a[..., :1], 3, axis=2)
                oks.append(True)
                pxs.append(np.ascontiguousarray(rgb.transpose(2, 0, 1)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), pa.array(oks, pa.bool_()), b.column("h"), b.column("w"),
                 pa.array(pxs, pa.binary())], names=["path", "ok", "height", "width", "px"])

    return img.mapInArrow(run, "path string, ok boolean, height int, width int, px binary")
