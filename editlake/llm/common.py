"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Characters that separate words in the contracts: space and U+0009 to U+000D.
BLANK = "\x20\x09-\x0D"
WORD = re.compile(f"[^{BLANK}]+")
#: The other characters that str.split() would also split at.
_SPLIT_ONLY = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Text handed to a batch kernel at once, in bytes; bounds a worker's memory.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: str | None) -> list[str]:
    """The matches of ``[^\\x20\\x09-\\x0D]+`` (null: none)."""
    if not text:
        return []
    if text.isascii():
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return WORD.findall(text)
        return text.split()
    return WORD.findall(text) if _SPLIT_ONLY.search(text) else text.split()


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that ``column`` holds about ``max_bytes`` a slice
    (one row at least), whatever the lengths of its texts."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // max_bytes
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def annotate(df: DataFrame, kernel: Callable[[list], list], fields: str, text_col: str = "text",
             name: str = "out", max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``df`` as struct column ``row`` beside struct column ``name`` with what
    ``kernel(texts)`` returns: one list or array per field of ``fields`` (DDL).

    The input row travels as one struct, so its own column names never clash
    with the new ones; no join is needed to bring decisions back to rows.
    """
    spark = df.sparkSession
    made = T.StructType.fromDDL(fields)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField(name, made, True)])
    from pyspark.sql.pandas.types import to_arrow_type
    inner = [pa.field(f.name, to_arrow_type(f.dataType)) for f in made]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", max_bytes):
                cols = kernel(part.column("text").to_pylist())
                arrays = [pa.array(c, type=f.type) for c, f in zip(cols, inner)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.StructArray.from_arrays(arrays, fields=inner)], ["row", name])

    return packed.mapInArrow(run, schema)


class Numbering(dict):
    """Word -> dense number, handed out on first sight (``map(n.__getitem__, words)``)."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``new_folder`` named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
