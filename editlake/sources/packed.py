"""Packed pair files as a Spark data source: S4 (read), S5 (write), S10 (vectors).

Format of one output shard ``<prefix>``:

- ``<prefix>_images.bin``: fixed records of ``2*3*res*res`` bytes (before CHW,
  then after CHW), record k = row k;
- ``<prefix>_prompts.json`` / ``<prefix>_types.json``: JSON string arrays,
  joined to records by position;
- ``<prefix>_text.bin``, optional: float32 ``seq_len x text_dim`` per row;
- ``<prefix>_meta.json``: ``{n, val_n, res, source, counts}``, with vectors
  ``seq_len`` and ``text_dim``, and the index ``ranges``: for every ``records``
  rows the byte offsets in the two arrays and the edit types that occur.

The reader plans record ranges (one input partition each) and yields Arrow
batches, so a 10 GB file is read lazily by many tasks; with the index a task
reads its own bytes of every file, and ranges without a wanted edit type or row
are not planned. Filters on ``edit_type``, ``row`` and ``prefix`` are taken from
the query (``spark.sql.python.filterPushdown.enabled``) and applied before rows
are made. Shards without the index (written elsewhere) are read whole. A file
that does not hold exactly its ``n`` records is an error.

The writer takes whole Arrow batches, one shard per task under names of its
own, and ``commit`` makes all of them visible at once by replacing
``_manifest.json``, the list of published prefixes (a folder without one is read
by its meta files). Concurrent writers to one folder are not supported.
``reencode_vectors`` writes new vectors beside the pairs and publishes them and
their shape with the same single replacement.

Paths name their file system: a plain or ``file:`` path is a mount that the
driver and every executor have, other URIs go to the store that pyarrow opens
for their scheme. Parquet (``df.write.partitionBy('shard')``) remains the
default sink for everything that is not an export.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.types import StructType

FORMAT = "packedpairs"
SUFFIXES = ("_images.bin", "_prompts.json", "_types.json", "_meta.json", "_text.bin")
MANIFEST = "_manifest.json"
INDEX_RECORDS = 512       # rows of an index entry
MOST_PARTITIONS = 1024    # input partitions planned, about; a partition then reads several record ranges in turn
SLICE_ROWS = 1_500_000    # rows of a slice of a corpus that is written slice by slice, about
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def record_bytes(res: int) -> int:
    return 2 * 3 * res * res


# --- stores --------------------------------------------------------------------

def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"packed pairs need a path on a shared mount or in a store that pyarrow opens, not {path}: {e}") from e


def _exists(path: str) -> bool:
    files, at = store(path)
    return files.get_file_info(at).type == pafs.FileType.File


def _read(path: str, start: int = 0, size: int | None = None) -> bytes:
    files, at = store(path)
    with files.open_input_file(at) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def _put(path: str, data: bytes) -> None:
    """Replace a small file at once: by a rename on a mount, by one put elsewhere."""
    files, at = store(path)
    local = isinstance(files, pafs.LocalFileSystem)
    staged = f"{posixpath.dirname(at)}/.{posixpath.basename(at)}-{uuid.uuid4().hex[:8]}" if local else at
    with files.open_output_stream(staged) as f:
        f.write(data)
    if local:
        files.move(staged, at)


def _remove(prefix: str) -> None:
    files, at = store(prefix)
    for s in SUFFIXES:
        if files.get_file_info(at + s).type == pafs.FileType.File:
            files.delete_file(at + s)


def _join(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def _manifest(path: str) -> list[dict] | None:
    """Published shards: ``name`` and what overrides their meta records."""
    where = _join(path, MANIFEST)
    if not _exists(where):
        return None
    return [e if isinstance(e, dict) else {"name": e} for e in json.loads(_read(where))]


def find_shards(path: str) -> list[tuple[str, dict]]:
    """Prefix of every shard under ``path`` (a prefix or a folder), with overrides of its meta record."""
    entries = _manifest(path)
    if entries is not None:
        return [(_join(path, e["name"]), {k: v for k, v in e.items() if k != "name"}) for e in entries]
    if _exists(path + "_meta.json"):
        return [(path, {})]
    files, at = store(path)
    if files.get_file_info(at).type != pafs.FileType.Directory:
        return []
    found = files.get_file_info(pafs.FileSelector(at, recursive=True))
    names = sorted(f.path for f in found if f.path.endswith("_meta.json"))
    return [(_join(path, posixpath.relpath(n, at))[:-len("_meta.json")], {}) for n in names]


def find_prefixes(path: str) -> list[str]:
    return [prefix for prefix, _ in find_shards(path)]


def shard_meta(prefix: str, overrides: dict) -> dict:
    return json.loads(_read(prefix + "_meta.json")) | overrides


# --- reading -------------------------------------------------------------------

class _Range(InputPartition):
    def __init__(self, prefix: str, meta: dict, start: int, count: int, spans: dict[str, list[int]], step: int = 1, skip: int = 0):
        self.prefix, self.start, self.count = prefix, start, count
        self.spans, self.step, self.skip = spans, step, skip  # offsets of every step rows, which begin skip rows earlier
        self.res = int(meta["res"])
        self.text = (meta.get("text", posixpath.basename(prefix) + "_text.bin"), int(meta.get("seq_len") or 0), int(meta.get("text_dim") or 0))

    def pieces(self, records: int) -> Iterator[_Range]:
        """The range cut into ranges of at most ``records`` rows."""
        for k in range(0, self.count, records):
            part = copy(self)
            part.start, part.count = self.start + k, min(records, self.count - k)
            a, b = (self.skip + k) // self.step, -(-(self.skip + k + part.count) // self.step)
            part.spans, part.skip = {name: at[a:b + 1] for name, at in self.spans.items()}, (self.skip + k) % self.step
            yield part


@lru_cache(maxsize=4)
def _whole_list(path: str) -> list | None:
    """A sidecar without an index, parsed once per worker for all ranges of its shard."""
    return json.loads(_read(path)) if _exists(path) else None


def _fixed(data: bytes, rows: int, width: int, kind: pa.DataType) -> pa.Array:
    offsets = pa.py_buffer(np.arange(0, (rows + 1) * width, max(width, 1), dtype=np.int32)[:rows + 1].tobytes())
    return pa.Array.from_buffers(kind, rows, [None, offsets, pa.py_buffer(data)])


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.records = int(options.get("recordsPerPartition", "4096"))
        self.images = options.get("images", "true") == "true"
        self.vectors = options.get("vectors", "false") == "true"
        self.types: set | None = None      # wanted edit types
        self.prefixes: set | None = None
        self.low, self.high, self.rows = 0, None, None

    def partitions(self):
        parts, shards = [], []
        for prefix, overrides in find_shards(self.path):
            if self.prefixes is None or prefix in self.prefixes:
                shards.append((prefix, overrides, int(shard_meta(prefix, overrides)["n"])))
        # the driver holds every planned partition, so their number does not grow with the files
        ranges = max(1, sum(n for _, _, n in shards) // self.records // MOST_PARTITIONS)
        for prefix, overrides, n in shards:
            meta = shard_meta(prefix, overrides)
            res = int(meta["res"])
            if self.images:
                files, at = store(prefix + "_images.bin")
                size = files.get_file_info(at).size or 0
                if size != n * record_bytes(res):
                    raise ValueError(f"{prefix}_images.bin has {size} bytes; {n} records of {res} px need {n * record_bytes(res)}")
            parts += self._ranges(prefix, meta, n, ranges)
        return parts or [_Range("", {"res": 0}, 0, 0, {})]

    def _ranges(self, prefix: str, meta: dict, n: int, ranges: int = 1) -> list[_Range]:
        """Partitions of at most ``ranges`` times as many rows as are read at once."""
        index = meta.get("ranges")
        step = int(index["records"]) if index else self.records
        per = max(1, self.records // step) * ranges
        blocks = [k for k in range(-(-n // step)) if self._wanted(k * step, min(n, (k + 1) * step), index["edit_types"][k] if index else None)]
        out, start = [], 0
        for i in range(1, len(blocks) + 1):
            if i == len(blocks) or blocks[i] != blocks[i - 1] + 1 or i - start == per:
                a, b = blocks[start], blocks[i - 1] + 1
                spans = {name: index[name][a:b + 1] for name in ("prompts", "types")} if index else {}
                first, end = a * step, min(n, b * step)
                size = self.records * ranges if self.records < step else end - first
                whole = _Range(prefix, meta, first, end - first, spans, step)
                out += whole.pieces(size)
                start = i
        return out

    def _at_once(self, step: int) -> int:
        """Rows read at once: whole index entries where the wanted number holds one."""
        return self.records if self.records < step else self.records // step * step

    def _wanted(self, first: int, end: int, types: list | None) -> bool:
        if first > (end if self.high is None else self.high) or end <= self.low:
            return False
        if self.rows is not None and not any(first <= r < end for r in self.rows):
            return False
        return self.types is None or types is None or not self.types.isdisjoint(types)

    def _list(self, part: _Range, name: str, pad: str | None) -> list:
        path = f"{part.prefix}_{name}.json"
        if name in part.spans:
            a, b = part.spans[name][0], part.spans[name][-1]
            found = json.loads(b"[" + _read(path, a, b - a - 1) + b"]")  # less the comma or bracket at its end
            return found[part.skip:part.skip + part.count]
        found = _whole_list(path)
        if found is None:
            return [pad] * part.count
        return [found[i] if i < len(found) else "" for i in range(part.start, part.start + part.count)]

    def read(self, part: _Range):
        for piece in part.pieces(self._at_once(part.step)):
            yield from self._rows(piece)

    def _rows(self, part: _Range):
        types = self._list(part, "types", None)
        keep = np.ones(part.count, bool)
        if self.types is not None:
            keep &= np.array([t in self.types for t in types])
        at = np.arange(part.start, part.start + part.count)
        keep &= (at >= self.low) & (at <= (part.start + part.count if self.high is None else self.high))
        if self.rows is not None:
            keep &= np.isin(at, sorted(self.rows))
        if not keep.any():
            return
        rows = np.flatnonzero(keep)
        take = lambda values: [values[i] for i in rows.tolist()]
        cols = {"prefix": pa.array([part.prefix] * len(rows)), "row": pa.array(at[rows])}
        if self.images:
            rb = record_bytes(part.res)
            data = np.frombuffer(_read(part.prefix + "_images.bin", part.start * rb, part.count * rb), np.uint8).reshape(part.count, rb)[rows]
            for name, half in (("before", data[:, :rb // 2]), ("after", data[:, rb // 2:])):
                cols[name] = _fixed(np.ascontiguousarray(half).tobytes(), len(rows), rb // 2, pa.binary())
        cols["res"] = pa.array(np.full(len(rows), part.res, np.int32))
        cols["instruction"] = pa.array(take(self._list(part, "prompts", "")), pa.string())
        cols["edit_type"] = pa.array(take(types), pa.string())
        if self.vectors:
            cols["vectors"] = self._vectors(part, rows)
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def _vectors(self, part: _Range, rows: np.ndarray) -> pa.Array:
        name, seq, dim = part.text
        kind = pa.list_(pa.list_(pa.float32()))
        if not seq * dim:
            return pa.nulls(len(rows), kind)
        width = 4 * seq * dim
        data = _read(_join(posixpath.dirname(part.prefix), name), part.start * width, part.count * width)
        if len(data) != part.count * width:
            raise ValueError(f"{name} holds fewer than {part.start + part.count} rows of {seq} x {dim}")
        flat = pa.array(np.frombuffer(data, "<f4").reshape(part.count, -1)[rows].reshape(-1))
        inner = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dim, dtype=np.int32), flat)
        return pa.ListArray.from_arrays(np.arange(0, len(inner) + 1, seq, dtype=np.int32), inner)


class PushedReader(PackedReader):
    """The reader when the session hands filters down; what is taken here is applied exactly."""

    def pushFilters(self, filters):
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f) -> bool:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        values = {f.value} if isinstance(f, (EqualTo, EqualNullSafe)) else set(f.value) if isinstance(f, In) else None
        if values is not None and None in values:
            return False
        both = lambda held: values if held is None else held & values
        if name == "edit_type" and values is not None:
            self.types = both(self.types)
        elif name == "prefix" and values is not None:
            self.prefixes = both(self.prefixes)
        elif name == "row" and values is not None:
            self.rows = both(self.rows)
        elif name == "row" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif name == "row" and isinstance(f, (LessThan, LessThanOrEqual)):
            most = f.value - isinstance(f, LessThan)
            self.high = most if self.high is None else min(self.high, most)
        else:
            return False
        return True


# --- writing -------------------------------------------------------------------

class _Written(WriterCommitMessage):
    def __init__(self, names: list[str], n: int):
        self.names, self.n = names, n


class _JsonArray:
    """A JSON array of strings, written bit by bit, with the byte offset of every ``INDEX_RECORDS``-th value."""

    def __init__(self, stream):
        self.stream, self.size, self.n, self.offsets = stream, 1, 0, []
        stream.write(b"[")

    def add(self, values: list) -> None:
        out = []
        for v in values:
            text = ("," if self.n else "") + json.dumps(v)
            if self.n % INDEX_RECORDS == 0:
                self.offsets.append(self.size + (1 if self.n else 0))
            self.size += len(text)  # json.dumps gives ASCII
            self.n += 1
            out.append(text)
        self.stream.write("".join(out).encode())

    def close(self) -> list[int]:
        self.stream.write(b"]")
        self.stream.close()
        return [*self.offsets, self.size + 1]


class PackedWriter(DataSourceArrowWriter):
    """One task = one output shard; files appear only when the job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        store(self.path)
        self.write_id = uuid.uuid4().hex[:8]
        self.want_val = int(options.get("valN", "300"))
        self.source = options.get("source", "")
        self.prefix_name = options.get("prefixName", "part")
        self.overwrite = overwrite

    def write(self, batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        # a name of its own for every attempt: the manifest says which one counts
        name = f"{self.prefix_name}-{self.write_id}-{pid:05d}-{uuid.uuid4().hex[:8]}"
        files, at = store(self.path)
        files.create_dir(at, recursive=True)
        try:
            n = self._write_shard(_join(self.path, name), batches)
        except BaseException:
            _remove(_join(self.path, name))
            raise
        return _Written([name] if n else [], n)

    def _write_shard(self, prefix: str, batches: Iterator[pa.RecordBatch]) -> int:
        files, at = store(prefix)
        out = {s: files.open_output_stream(at + s) for s in ("_images.bin", "_prompts.json", "_types.json")}
        prompts, types = _JsonArray(out["_prompts.json"]), _JsonArray(out["_types.json"])
        n, res, shape, counts, kinds = 0, None, None, {}, []
        text = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                res = _resolution(batch.column("res"), res)
                out["_images.bin"].write(np.concatenate([_pixels(batch.column(c), res) for c in ("before", "after")], axis=1).tobytes())
                prompts.add([p or "" for p in batch.column("instruction").to_pylist()])
                found = batch.column("edit_type").to_pylist()
                for i, t in enumerate(found, n):
                    if i % INDEX_RECORDS == 0:
                        kinds.append(set())
                    kinds[-1].add(t)
                    counts[t] = counts.get(t, 0) + 1
                types.add(found)
                if "vectors" in batch.schema.names:
                    flat, this = _flat_vectors(batch.column("vectors"))
                    if shape not in (None, this):
                        raise ValueError(f"vectors of {this} in a shard of {shape}")
                    shape = this
                    text = text or files.open_output_stream(at + "_text.bin")
                    text.write(flat.astype("<f4").tobytes())
                n += batch.num_rows
        finally:
            out["_images.bin"].close()
            spans = {"prompts": prompts.close(), "types": types.close()}
            if text is not None:
                text.close()
        meta = {"n": n, "val_n": min(self.want_val, n // 10), "res": res or 0, "source": self.source, "counts": counts}
        if shape:
            meta |= {"seq_len": shape[0], "text_dim": shape[1]}
        meta["ranges"] = {"records": INDEX_RECORDS, **spans, "edit_types": [sorted(k, key=lambda t: (t is None, t)) for k in kinds]}
        if not n:
            _remove(prefix)
            return 0
        _put(prefix + "_meta.json", json.dumps(meta).encode())
        return n

    def commit(self, messages):
        files, at = store(self.path)
        files.create_dir(at, recursive=True)
        mine = f"{self.prefix_name}-{self.write_id}-"
        old = _manifest(self.path)
        if old is None:
            old = [{"name": p[len(self.path.rstrip("/")) + 1:]} for p in find_prefixes(self.path) if not posixpath.basename(p).startswith(mine)]
        made = [{"name": name} for name in sorted(name for m in messages for name in m.names)]
        publish(self.path, made if self.overwrite else old + made)  # the moment of publication
        if self.overwrite:
            for e in old:
                _remove(_join(self.path, e["name"]))
                _drop_text(self.path, e)

    def abort(self, messages):
        for m in messages or []:
            for name in m.names if m is not None else []:
                _remove(_join(self.path, name))


def publish(path: str, entries: list[dict]) -> None:
    _put(_join(path, MANIFEST), json.dumps([e["name"] if len(e) == 1 else e for e in entries]).encode())


def _drop_text(path: str, entry: dict) -> None:
    if "text" in entry and _exists(where := _join(posixpath.dirname(_join(path, entry["name"])), entry["text"])):
        files, at = store(where)
        files.delete_file(at)


def _resolution(col: pa.Array, res: int | None) -> int:
    found = col.unique().to_pylist()
    if len(found) != 1 or found[0] is None or res not in (None, found[0]):
        raise ValueError(f"rows of {sorted(map(str, found))} px in a {res or found[0]} px shard")
    return int(found[0])


def _pixels(col: pa.Array, res: int) -> np.ndarray:
    """A column of CHW bytes as a matrix; every value must have the shard's size."""
    col, width = col.cast(pa.large_binary()), 3 * res * res
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1])
    if col.null_count or (sizes != width).any():
        odd = "a null image" if col.null_count else f"an image of {sizes[sizes != width][0]}"
        raise ValueError(f"row with {odd} bytes in a {res} px shard")
    first = np.frombuffer(col.buffers()[1], np.int64)[col.offset]
    return np.frombuffer(col.buffers()[2], np.uint8)[first:first + len(col) * width].reshape(len(col), width)


def _flat_vectors(col: pa.Array) -> tuple[np.ndarray, tuple[int, int]]:
    if col.null_count:
        raise ValueError("a row without vectors in a shard that has them")
    inner = col.flatten()
    seq, dim = set(np.diff(col.offsets.to_numpy()).tolist()), set(np.diff(inner.offsets.to_numpy()).tolist())
    flat = inner.flatten()
    if len(seq) != 1 or len(dim) != 1 or flat.null_count:
        raise ValueError("vectors of a shard must have one shape and no nulls")
    return flat.to_numpy(zero_copy_only=False), (seq.pop(), dim.pop())


class PackedPairsDataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        images = "before binary, after binary, " if self.options.get("images", "true") == "true" else ""
        vectors = ", vectors array<array<float>>" if self.options.get("vectors", "false") == "true" else ""
        return f"prefix string, row bigint, {images}res int, instruction string, edit_type string{vectors}"

    def reader(self, schema: StructType):
        # Spark refuses a reader that takes filters while handing them down is switched off
        return (PushedReader if self.options.get("pushdown") == "true" else PackedReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return PackedWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(PackedPairsDataSource)


def read_packed_pairs(spark, path: str, records_per_partition: int = 4096, *, images: bool = True,
                      vectors: bool = False) -> DataFrame:
    """Packed shards under ``path`` (a prefix or a folder) as rows. Where the
    session hands filters down (``spark.sql.python.filterPushdown.enabled``),
    ``where`` on edit type, row and prefix prunes ranges. Without ``images`` no
    pixel is read; ``vectors`` adds the text vectors (null where a shard has none)."""
    register(spark)
    return (spark.read.format(FORMAT).option("path", path).option("pushdown", spark.conf.get(PUSHDOWN, "false").lower())
            .option("images", str(images).lower()).option("vectors", str(vectors).lower())
            .option("recordsPerPartition", str(records_per_partition)).load())


def write_packed_pairs(df: DataFrame, path: str, *, shards: int | None = None, want_val: int = 300,
                       source: str = "", mode: str = "append") -> None:
    """Rows (before, after BINARY, res, instruction, edit_type, and perhaps
    vectors) -> packed shards, one per partition (``shards`` repartitions first,
    keeping row order within each shard by ``row_id`` when present)."""
    register(df.sparkSession)
    out = df
    if shards is not None:
        out = out.repartitionByRange(shards, "row_id") if "row_id" in df.columns else out.repartition(shards)
    if "row_id" in df.columns:
        out = out.sortWithinPartitions("row_id")
    extra = [c for c in ("vectors",) if c in df.columns]
    (out.select("before", "after", "res", "instruction", "edit_type", *extra).write.format(FORMAT)
     .mode(mode).option("path", path).option("valN", str(want_val)).option("source", source).save())


def row_slices(df: DataFrame, most: int | None = None) -> list[Column]:
    """Conditions that cut the rows of ``df`` by ``row_id`` into slices of about
    ``most`` rows; every row, also one without an id, meets exactly one. A corpus
    written slice by slice shuffles and sorts one slice at a time."""
    most = SLICE_ROWS if most is None else most
    n, row = -(-df.count() // most), F.col("row_id")
    if n <= 1:
        return [F.lit(True)]
    cuts = sorted(set(df.agg(F.percentile_approx("row_id", [i / n for i in range(1, n)])).first()[0] or []))
    if not cuts:
        return [F.lit(True)]
    return [row.isNull() | (row <= cuts[0]), *((row > a) & (row <= b) for a, b in zip(cuts, cuts[1:])), row > cuts[-1]]


def read_vectors(spark, path: str, records_per_partition: int = 4096) -> DataFrame:
    """The vectors beside packed pairs: ``prefix, row, vectors``; no pixel is read."""
    return read_packed_pairs(spark, path, records_per_partition, images=False, vectors=True).select("prefix", "row", "vectors")


def reencode_vectors(spark, path: str, encoder_factory, *, batch_size: int = 64, encoder: str = "") -> None:
    """Encode the prompts of every packed shard anew and publish the vectors, their
    shape and the encoder's name at once; images and prompts are not touched.

    A shard is one task, which reads its prompts and writes its vectors range by
    range. A shard whose prompts do not match its ``n`` fails the job, and a
    failed job publishes nothing: readers keep the old vectors.
    """
    shards = find_shards(path)
    if not shards:
        raise ValueError(f"no packed shards under {path}")
    version = uuid.uuid4().hex[:8]
    names = spark.createDataFrame([(p, json.dumps(o)) for p, o in shards], "prefix string, overrides string")

    def run(batches):
        made = encoder_factory()
        for batch in batches:
            for prefix, overrides in zip(batch.column("prefix").to_pylist(), batch.column("overrides").to_pylist()):
                yield _encode_shard(prefix, shard_meta(prefix, json.loads(overrides)), made, batch_size, version)

    done = (names.repartition(len(shards), "prefix")
            .mapInArrow(run, "prefix string, text string, seq_len int, text_dim int").collect())  # a row per shard
    by_prefix = {r.prefix: {"text": r.text, "seq_len": r.seq_len, "text_dim": r.text_dim, "encoder": encoder} for r in done}
    root = path.rstrip("/")
    if _manifest(path) is None and not all(p.startswith(root + "/") for p in by_prefix):
        raise ValueError("vectors are published through a folder's manifest; give the folder")
    publish(path, [{"name": p[len(root) + 1:]} | by_prefix[p] for p, _ in shards])
    for prefix, old in shards:
        _drop_text(path, {"name": prefix[len(root) + 1:], **old})


def _encode_shard(prefix: str, meta: dict, made, batch_size: int, version: str) -> pa.RecordBatch:
    reader = PackedReader({"path": prefix})
    name = f"{posixpath.basename(prefix)}-{version}_text.bin"
    files, at = store(_join(posixpath.dirname(prefix), name))
    n, shape = 0, (0, 0)
    with files.open_output_stream(at) as out:
        for part in reader._ranges(prefix, meta, int(meta["n"])):
            prompts = reader._list(part, "prompts", "")
            if len(prompts) != part.count or (not part.spans and len(_whole_list(prefix + "_prompts.json") or []) != int(meta["n"])):
                raise ValueError(f"{prefix}: the prompts do not match n={meta['n']}; refusing to re-embed")
            for i in range(0, len(prompts), batch_size):
                vectors = np.ascontiguousarray(made.encode(prompts[i:i + batch_size]), "<f4")
                shape = vectors.shape[1:]
                out.write(vectors.tobytes())
                n += len(vectors)
    if n != int(meta["n"]):
        raise ValueError(f"{prefix}: {n} vectors but n={meta['n']}")
    return pa.RecordBatch.from_arrays([pa.array([prefix]), pa.array([name]), pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32())],
                                      names=["prefix", "text", "seq_len", "text_dim"])
