"""Image jobs: I1 decode, I2 resize, I3 pack, I5 exact edits, I9 registration.

Pixels travel as BINARY (packed uint8 CHW, ``3*res*res`` bytes). Every job is
one ``mapInArrow`` over Arrow record batches: the bytes of a whole batch are
viewed as one NumPy array without per-row Python work, edits are applied per
(type, resolution) group with vectorised NumPy, and the result goes back as
Arrow arrays. Filter rows *before* these jobs; Catalyst cannot push a filter
through them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import pixels as PX
from ..functions import png

# ------------------------------------------------------------------ kernels


def _luma(x: np.ndarray) -> np.ndarray:
    """x: (n, 3, h, w) -> (n, 1, h, w)."""
    return (PX.LUMA[0] * x[:, 0] + PX.LUMA[1] * x[:, 1] + PX.LUMA[2] * x[:, 2])[:, None]


def _tint(values) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(1, 3, 1, 1)


def _clamp(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, -1.0), 1.0)


@lru_cache(maxsize=64)
def blur_matrix(side: int, sigma: float) -> np.ndarray:
    """(side, side) matrix of a 1-D Gaussian with reflect padding (no edge
    repeat): out = M @ in along one axis. Needs side > radius."""
    radius = max(1, int(3 * sigma))
    if side <= radius:
        raise ValueError(f"reflect padding needs side > {radius}, got {side}")
    xs = np.arange(-radius, radius + 1, dtype=np.float64)
    k = np.exp(-(xs ** 2) / (2 * sigma ** 2))
    k = k / k.sum()
    m = np.zeros((side, side), dtype=np.float64)
    for o in range(side):
        for j, d in enumerate(range(-radius, radius + 1)):
            i = o + d
            if i < 0:
                i = -i
            elif i >= side:
                i = 2 * (side - 1) - i
            m[o, i] += k[j]
    return m


def blur(x: np.ndarray, sigma: float = PX.BLUR_SIGMA) -> np.ndarray:
    """Separable Gaussian: horizontal pass, then vertical (two matrix products)."""
    m = blur_matrix(x.shape[-1], sigma)
    h = x @ m.T
    mv = blur_matrix(x.shape[-2], sigma)
    return np.einsum("ij,ncjw->nciw", mv, h)


def sharpen(x: np.ndarray) -> np.ndarray:
    return _clamp(x + (x - blur(x, PX.SHARPEN_SIGMA)) * PX.SHARPEN_AMOUNT)


EDITS = {
    "black_and_white": lambda x: np.repeat(_luma(x), 3, axis=1),
    "sepia_vintage": lambda x: _clamp(_luma(x) * _tint(PX.SEPIA_TINT)),
    "brighter": lambda x: _clamp(x * PX.BRIGHTER[0] + PX.BRIGHTER[1]),
    "darker": lambda x: _clamp(x * PX.DARKER[0] + PX.DARKER[1]),
    "more_colorful": lambda x: _clamp(_luma(x) + (x - _luma(x)) * PX.MORE_COLORFUL),
    "less_colorful": lambda x: _clamp(_luma(x) + (x - _luma(x)) * PX.LESS_COLORFUL),
    "blur_background": lambda x: blur(x, PX.BLUR_SIGMA),
    "sharper": sharpen,
    "warmer": lambda x: _clamp(x * _tint(PX.WARM_TINT)),
    "cooler": lambda x: _clamp(x * _tint(PX.COOL_TINT)),
    "inverted": lambda x: -x,
    "high_contrast": lambda x: _clamp(x * PX.HIGH_CONTRAST),
    "low_contrast": lambda x: x * PX.LOW_CONTRAST,
}
assert list(EDITS) == tx.SYNTHETIC_TYPES


def normalize_u8(u8: np.ndarray) -> np.ndarray:
    return u8.astype(np.float64) / 127.5 - 1.0


def denormalize_u8(x: np.ndarray) -> np.ndarray:
    """I4's inverse, which cuts off; for checks and previews, not for storing."""
    return np.floor((_clamp(x) + 1.0) * 127.5).astype(np.uint8)


def stored_u8(x: np.ndarray) -> np.ndarray:
    """Rounded bytes, the storage form of edited images: an edit that returns
    its input gives the same bytes."""
    return np.floor((_clamp(x) + 1.0) * 127.5 + 0.5).astype(np.uint8)


# ------------------------------------------------------------ arrow helpers


def _binary_matrix(col: pa.Array, width: int, rows: np.ndarray) -> np.ndarray:
    """Rows of a BINARY column whose values all have ``width`` bytes, as one
    (len(rows), width) uint8 matrix (a copy of the selected rows only)."""
    col = col.cast(pa.large_binary()) if col.type != pa.large_binary() else col
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)
    starts = offsets[rows]
    if width == 0 or not len(rows):
        return np.zeros((len(rows), width), np.uint8)
    if (np.diff(starts) == width).all():  # one stretch of the buffer
        return data[starts[0]:starts[0] + width * len(rows)].reshape(len(rows), width).copy()
    return np.lib.stride_tricks.sliding_window_view(data, width)[starts]


def _list_of_doubles(mat: np.ndarray) -> pa.Array:
    n, w = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1), type=pa.float64()))


def _binary_rows(mat: np.ndarray) -> pa.Array:
    n, w = mat.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32).tobytes())
    data = pa.py_buffer(np.ascontiguousarray(mat, dtype=np.uint8).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])


BATCH_BYTES = 32 << 20


def bounded(batches, max_bytes: int = BATCH_BYTES):
    """Arrow batches cut to slices of about ``max_bytes`` (one row at least), so
    a kernel's float copies are bounded whatever the image size."""
    for b in batches:
        step = max(1, int(b.num_rows * max_bytes // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _as_list_array(col: pa.Array) -> pa.Array:
    return pa.concat_arrays([col]) if col.offset else col


def array_to_u8(df: DataFrame, src: str, dst: str) -> DataFrame:
    """array<int 0..255> column -> BINARY column, one vectorised cast per
    Arrow batch (the list's value buffer becomes the bytes)."""
    fields = [f for f in df.schema.fields if f.name not in (src, dst)]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{dst}` binary"])

    def run(batches):
        for b in bounded(batches):
            col = _as_list_array(b.column(src))
            offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[: len(col) + 1]
            values = col.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.uint8)
            out = pa.Array.from_buffers(pa.binary(), len(col),
                                        [col.buffers()[0], pa.py_buffer((offsets - offsets[0]).tobytes()),
                                         pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [out], names=names + [dst])

    return df.mapInArrow(run, schema)



def _round_half_away(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)



# ------------------------------------------------------------------- I5 job


def synthetic_pairs(df: DataFrame, px_col: str = "px", res_col: str = "res",
                    type_col: str = "edit_type", out: str = "u8",
                    keep: tuple[str, ...] = ("img_id",),
                    compare_col: str | None = None) -> DataFrame:
    """Exact edits of ``px`` for the type in ``type_col`` (one of the 13).

    Output: ``keep`` columns, ``type_col`` and ``after`` as BINARY uint8 CHW
    (``out='u8'``, the storage form) or as array<double> in [-1, 1]
    (``out='float'``, for checks). ``out='digest'`` gives the exact
    integer digest (s1, s2) instead of the pixels; ``out='error'`` with
    ``compare_col`` (stored after-image bytes) gives ``e_truth`` and
    ``e_input``, the summed squared differences of the stored image against
    the exact edit and against the input, plus ``n``. Rows of one batch are
    grouped by (type, res) so each edit runs once per group on a stacked array.
    """
    keep = tuple(keep)
    extra = (compare_col,) if out == "error" else ()
    sel = df.select(*keep, type_col, px_col, res_col, *extra)
    after_type = {"u8": "binary", "float": "array<double>", "digest": "s1 bigint, s2 bigint",
                  "error": "e_truth double, e_input double, n bigint"}[out]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in sel.schema.fields if f.name in keep)
    schema = (f"{fields + ', ' if fields else ''}`{type_col}` string, "
              + (after_type if out in ("digest", "error") else f"after {after_type}"))

    def run(batches):
        for b in bounded(batches):
            n = b.num_rows
            if n == 0:
                continue
            types = np.asarray(b.column(type_col).to_pylist(), dtype=object).astype(str)
            res = np.asarray(b.column(res_col).fill_null(0).to_numpy(zero_copy_only=False),
                             dtype=np.int64)
            px = b.column(px_col)
            known = np.isin(types, list(EDITS)) & (res > 0) & np.asarray(px.is_valid())
            uniform = known.all() and len(np.unique(res)) == 1
            width0 = 3 * int(res[0]) * int(res[0])
            if out in ("digest", "error") and not uniform:
                raise ValueError(f"{out} output needs one known type and resolution per row")
            if out == "error":
                ref = normalize_u8(_binary_matrix(b.column(compare_col), width0, np.arange(n)))
                inp = normalize_u8(_binary_matrix(px, width0, np.arange(n)))
            full = np.empty((n, width0), dtype=np.uint8 if out == "u8" else np.float64) \
                if uniform else None
            outs: list = [None] * n
            for r in np.unique(res[known]):
                r = int(r)
                width = 3 * r * r
                for t in np.unique(types[known & (res == r)]):
                    rows = np.nonzero(known & (types == t) & (res == r))[0]
                    x = normalize_u8(_binary_matrix(px, width, rows)).reshape(-1, 3, r, r)
                    y = EDITS[t](x).reshape(len(rows), width)
                    y = stored_u8(y) if out == "u8" else y
                    if uniform:
                        full[rows] = y
                    else:
                        for j, i in enumerate(rows):
                            outs[i] = y[j]
            cols = [b.column(k) for k in keep] + [b.column(type_col)]
            if out == "error":
                e_t = ((ref - full) ** 2).sum(axis=1)
                e_i = ((ref - inp) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(e_t), pa.array(e_i), pa.array(np.full(n, width0, np.int64))],
                    names=list(keep) + [type_col, "e_truth", "e_input", "n"])
                continue
            if out == "digest":
                q = _round_half_away(full * 1e6).astype(np.int64)
                pos = np.arange(1, full.shape[1] + 1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(cols + [pa.array(q.sum(axis=1)), pa.array(q @ pos)],
                                                 names=list(keep) + [type_col, "s1", "s2"])
                continue
            if uniform:
                after = _binary_rows(full) if out == "u8" else _list_of_doubles(full)
            elif out == "u8":
                after = pa.array([None if o is None else o.tobytes() for o in outs], type=pa.binary())
            else:
                after = pa.array(outs, type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols + [after], names=list(keep) + [type_col, "after"])

    return sel.mapInArrow(run, schema)


def synthetic_cross(images: DataFrame, type_col: str = "edit_type") -> DataFrame:
    """Every image paired with each of the 13 synthetic types.

    A bounded fan-out (x13) written as ``explode`` of a literal array, so each
    image row expands in place inside its own task: no join, no shuffle.
    """
    types = F.array(*[F.lit(t) for t in tx.SYNTHETIC_TYPES])
    return images.withColumn(type_col, F.explode(types)).withColumn(
        "type_id", F.array_position(types, F.col(type_col)).cast("bigint"))


# ------------------------------------------------------------------- I1 job


def raw_rgb_decoder(data: bytes):
    """Test codec: raw interleaved RGB, square. Returns (h, w, HWC uint8)."""
    n = len(data)
    side = math.isqrt(n // 3) if n >= 3 else 0
    if side <= 0 or 3 * side * side != n:
        raise ValueError(f"not a square RGB image: {n} bytes")
    return side, side, np.frombuffer(data, dtype=np.uint8).reshape(side, side, 3)


def _pil_decoder(data: bytes):
    import io

    from PIL import Image, UnidentifiedImageError  # a codec; not needed for raw cells
    try:
        arr = np.asarray(Image.open(io.BytesIO(data)).convert("RGB"), dtype=np.uint8)
    except (UnidentifiedImageError, OSError, SyntaxError) as e:  # what PIL raises for damaged data
        raise ValueError(str(e)) from e
    return arr.shape[0], arr.shape[1], arr


#: First bytes of the compressed formats that need a codec from outside.
MAGIC = (b"\xff\xd8\xff", b"GIF8", b"RIFF", b"BM")


def default_decoder(data: bytes):
    """One cell; the codec follows from the first bytes: PNG is decoded here,
    another compressed format by PIL (whose absence is an error, not a bad
    cell), anything else is raw RGB."""
    if data.startswith(png.SIGNATURE):
        found = png.decode([data])[0]
        if isinstance(found, ValueError):
            raise found
        return found.shape[0], found.shape[1], found
    return _pil_decoder(data) if data.startswith(MAGIC) else raw_rgb_decoder(data)


def _cell_bytes(cell) -> bytes | None:
    if cell is None:
        return None
    data = cell.get("bytes")
    if data is None and cell.get("path"):
        with open(cell["path"], "rb") as fh:
            data = fh.read()
    return data


def decode_images(df: DataFrame, cell_col: str, keep: tuple[str, ...] = ("img_id",),
                  decoder=None, prefix: str = "", errors: bool = False) -> DataFrame:
    """struct<bytes, path> cells -> (ok, height, width, px CHW BINARY).

    Bytes are tried first, then the path. PNG cells of a batch are decoded
    together; a JPEG (or any other) codec is a ``decoder(bytes)``, which gets
    every cell, returns (height, width, HWC uint8) and raises ``ValueError`` for
    data it cannot decode: such a cell, and one without bytes and path, gives
    ``ok = false`` and null pixels, and with ``errors`` the reason in a column
    ``error``. Anything else (a missing codec, a failed read, a bug) fails the
    task. A path is opened as a file, so it must lie on a mount that every
    executor has.
    """
    keep = tuple(keep)
    sel = df.select(*keep, F.col(cell_col).alias("_cell"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in sel.schema.fields if f.name in keep)
    p = prefix
    schema = (f"{fields + ', ' if fields else ''}`{p}ok` boolean, `{p}height` int, "
              f"`{p}width` int, `{p}px` binary") + (f", `{p}error` string" if errors else "")

    def decoded(cells: list[bytes | None]) -> list:
        """(height, width, pixels) or the error of each cell."""
        out: list = [ValueError("no bytes and no path") if c is None else None for c in cells]
        pngs = [i for i, c in enumerate(cells) if decoder is None and c is not None and c.startswith(png.SIGNATURE)]
        for i, found in zip(pngs, png.decode([cells[i] for i in pngs])):
            out[i] = found if isinstance(found, ValueError) else (*found.shape[:2], found)
        for i, c in enumerate(cells):
            if out[i] is None:
                try:
                    out[i] = (decoder or default_decoder)(c)
                except ValueError as e:  # undecodable cell: reported, not fatal
                    out[i] = e
        return out

    def run(batches):
        for b in bounded(batches):
            rows = decoded([_cell_bytes(c) for c in b.column("_cell").to_pylist()])
            good = [None if isinstance(r, ValueError) else r for r in rows]
            cols = [b.column(k) for k in keep] + [
                pa.array([r is not None for r in good], pa.bool_()),
                pa.array([None if r is None else r[0] for r in good], pa.int32()),
                pa.array([None if r is None else r[1] for r in good], pa.int32()),
                pa.array([None if r is None else np.ascontiguousarray(r[2].transpose(2, 0, 1)).tobytes() for r in good],
                         pa.binary())]
            names = [*keep, f"{p}ok", f"{p}height", f"{p}width", f"{p}px"]
            if errors:
                cols.append(pa.array([str(r) if isinstance(r, ValueError) else None for r in rows], pa.string()))
                names.append(f"{p}error")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return sel.mapInArrow(run, schema)


def png_cells(df: DataFrame, px_col: str = "px", height_col: str = "height", width_col: str = "width",
              keep: tuple[str, ...] = ("img_id",), kinds: tuple[int, ...] = (png.PAETH,), out_col: str = "image_file") -> DataFrame:
    """CHW pixels -> ``struct<bytes, path>`` cells holding PNG files (lossless), the
    form in which corpora store images; row y of an image uses filter ``kinds[y % len(kinds)]``."""
    sel = df.select(*keep, F.col(px_col).alias("_px"), F.col(height_col).cast("int").alias("_h"), F.col(width_col).cast("int").alias("_w"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sel.schema.fields if f.name in keep)

    def run(batches):
        for b in bounded(batches):
            files = [None if px is None else png.encode(np.frombuffer(px, np.uint8).reshape(3, h, w).transpose(1, 2, 0), kinds)
                     for px, h, w in zip(b.column("_px").to_pylist(), b.column("_h").to_pylist(), b.column("_w").to_pylist())]
            cell = pa.StructArray.from_arrays([pa.array(files, pa.binary()), pa.nulls(len(files), pa.string())], ["bytes", "path"])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], cell], names=[*keep, out_col])

    return sel.mapInArrow(run, f"{fields + ', ' if fields else ''}`{out_col}` struct<bytes:binary,path:string>")


# ------------------------------------------------------------------- I2 job


def _lanczos(x: np.ndarray, a: int = 3) -> np.ndarray:
    out = np.sinc(x) * np.sinc(x / a)
    return np.where(np.abs(x) < a, out, 0.0)


@lru_cache(maxsize=64)
def lanczos_matrix(n_in: int, n_out: int, a: int = 3) -> np.ndarray:
    """(n_out, n_in) resampling weights: support widened by the scale when
    shrinking, pixel centres at +0.5, each row normalised to sum 1."""
    scale = n_in / n_out
    fscale = max(scale, 1.0)
    support = a * fscale
    m = np.zeros((n_out, n_in), dtype=np.float64)
    for o in range(n_out):
        center = (o + 0.5) * scale
        lo = max(int(center - support + 0.5), 0)
        hi = min(int(center + support + 0.5), n_in)
        xs = np.arange(lo, hi)
        w = _lanczos((xs - center + 0.5) / fscale, a)
        s = w.sum()
        m[o, lo:hi] = w / s if s != 0 else w
    return m


def resize_chw(u8: np.ndarray, out_side: int) -> np.ndarray:
    """(n, 3, side, side) uint8 -> (n, 3, out, out) uint8 (see ``resize_hw``)."""
    return resize_hw(u8, out_side)


def resize_hw(u8: np.ndarray, out_side: int) -> np.ndarray:
    """(n, 3, h, w) uint8 of any h, w -> (n, 3, out, out) uint8: horizontal
    pass, 8-bit intermediate, vertical pass (rounded and clipped after each)."""
    n, c, h, w = u8.shape
    x = u8.astype(np.float64)
    if w != out_side:
        x = np.clip(np.floor(x @ lanczos_matrix(w, out_side).T + 0.5), 0, 255)
    if h != out_side:
        x = np.clip(np.floor(lanczos_matrix(h, out_side) @ x + 0.5), 0, 255)
    return x.astype(np.uint8)


def resize_columns(df: DataFrame, out_side: int, images: dict[str, tuple[str, str, str]],
                   keep: tuple[str, ...]) -> DataFrame:
    """I2 over several decoded images per row: ``images`` maps an output
    column to its (px, height, width) input columns; every image (any shape)
    becomes ``out_side`` x ``out_side`` CHW bytes. Rows are grouped by input
    shape inside each Arrow batch and resized as stacked arrays."""
    src = sorted({c for spec in images.values() for c in spec})
    sel = df.select(*keep, *[c for c in src if c not in keep])
    fields = [f for f in sel.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + [f"`{o}` binary" for o in images] + ["res int"])

    def run(batches):
        for b in bounded(batches):
            n = b.num_rows
            outs = []
            for out, (pc, hc, wc) in images.items():
                hs = np.asarray(b.column(hc).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                ws = np.asarray(b.column(wc).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                col = b.column(pc)
                valid = np.asarray(col.is_valid()) & (hs > 0) & (ws > 0)
                res_col = [None] * n
                for h, w in {(int(h), int(w)) for h, w in zip(hs[valid], ws[valid])}:
                    rows = np.nonzero(valid & (hs == h) & (ws == w))[0]
                    stack = _binary_matrix(col, 3 * h * w, rows).reshape(-1, 3, h, w)
                    y = resize_hw(stack, out_side)
                    for j, i in enumerate(rows):
                        res_col[i] = y[j].tobytes()
                outs.append(pa.array(res_col, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in fields] + outs + [pa.array([out_side] * n, pa.int32())],
                names=[f.name for f in fields] + list(images) + ["res"])

    return sel.mapInArrow(run, schema)


def resize_images(df: DataFrame, out_side: int, px_col: str = "px", res_col: str = "res",
                  keep: tuple[str, ...] = ("img_id",)) -> DataFrame:
    """Square CHW uint8 images resized to ``out_side`` (Lanczos, a = 3)."""
    keep = tuple(keep)
    sel = df.select(*keep, px_col, res_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in sel.schema.fields if f.name in keep)
    schema = f"{fields + ', ' if fields else ''}px binary, res int"

    def run(batches):
        for b in bounded(batches):
            n = b.num_rows
            if n == 0:
                continue
            res = np.asarray(b.column(res_col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            outs: list = [None] * n
            for r in np.unique(res):
                if r <= 0:
                    continue
                rows = np.nonzero(res == r)[0]
                x = _binary_matrix(b.column(px_col), 3 * int(r) * int(r), rows)
                y = resize_chw(x.reshape(-1, 3, int(r), int(r)), out_side).reshape(len(rows), -1)
                for j, i in enumerate(rows):
                    outs[i] = y[j].tobytes()
            cols = [b.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(outs, pa.binary()),
                        pa.array([out_side if o is not None else None for o in outs], pa.int32())],
                names=list(keep) + ["px", "res"])

    return sel.mapInArrow(run, schema)


# ------------------------------------------------------------------- I9


def pixel_digest():
    """``PX.digest`` as an Arrow function of an array<double> column:
    struct<s1, s2>; null where the array is null or holds a null or NaN."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("s1 bigint, s2 bigint")
    def digest(x: pa.Array) -> pa.Array:
        valid = np.asarray(x.is_valid())
        lengths = np.where(valid, x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        y = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 1e6
        ends = np.cumsum(lengths)
        starts = ends - lengths
        odd = np.isnan(y)
        if odd.any():
            rows = np.repeat(np.arange(len(x)), lengths)
            valid[rows[odd]] = False
            y[odd] = 0
        whole = np.trunc(y)
        q = (whole + np.trunc((y - whole) * 2)).astype(np.int64)  # halves away from zero
        place = np.arange(1, len(q) + 1, dtype=np.int64) - np.repeat(starts, lengths)
        sums = []
        for values in (q, q * place):
            total = np.concatenate([[0], np.cumsum(values)])
            sums.append(pa.array(total[ends] - total[starts], mask=~valid))
        return pa.StructArray.from_arrays(sums, ["s1", "s2"])

    return digest


def register_edits(spark, prefix: str = "edit_") -> list[str]:
    """Each exact edit as a SQL function ``edit_<name>(array<double>, side)``
    (a vectorised Arrow UDF), plus the table function ``synthetic_edits(px,
    side)`` for a lateral join, which is called row by row and gives one row per
    edit (for tables see ``register_edit_rows``). Returns the registered names."""
    from pyspark.sql.functions import arrow_udf, udtf

    names = []
    for name, fn in EDITS.items():
        def make(fn=fn):
            @arrow_udf("array<double>")
            def edit(x: pa.Array, side: pa.Array) -> pa.Array:
                sides = np.where(np.asarray(x.is_valid()), side.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), 0)
                parts, order = [], []
                for s in np.unique(sides[sides > 0]).tolist():  # images of one size run stacked
                    rows = np.flatnonzero(sides == s)
                    chosen = x if len(rows) == len(x) else x.take(pa.array(rows))
                    odd = np.flatnonzero(chosen.value_lengths().to_numpy(zero_copy_only=False) != 3 * s * s)
                    if len(odd):
                        raise ValueError(f"image of {len(chosen[int(odd[0])])} values, not 3 x {s} x {s}")
                    stack = chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 3, s, s)
                    parts.append(_list_of_doubles(fn(stack).reshape(len(rows), -1)))
                    order.append(rows)
                if len(parts) == 1 and len(order[0]) == len(x):
                    return parts[0]
                place = np.full(len(x), -1)  # rows without pixels or size stay null
                if order:
                    place[np.concatenate(order)] = np.arange(sum(map(len, order)))
                made = pa.concat_arrays([*parts, pa.nulls(0, pa.list_(pa.float64()))])
                return made.take(pa.array(place, mask=place < 0))
            return edit
        spark.udf.register(prefix + name, make())
        names.append(prefix + name)

    @udtf(returnType="edit_type string, type_id int, after array<double>")
    class SyntheticEdits:
        def eval(self, px, side):
            if px is None:
                return
            arr = np.asarray(px, dtype=np.float64).reshape(1, 3, int(side), int(side))
            for name, fn in EDITS.items():
                yield name, tx.TYPE_ID[name], fn(arr).reshape(-1).tolist()

    spark.udtf.register("synthetic_edits", SyntheticEdits)
    names.append("synthetic_edits")
    return names


def register_edit_rows(spark) -> str:
    """I9 for tables: ``synthetic_edit_rows(TABLE(SELECT id, px, side ...))`` takes
    whole Arrow batches and gives one row per image and edit."""
    from pyspark.sql.functions import arrow_udtf

    @arrow_udtf(returnType="id bigint, edit_type string, type_id int, after array<double>")
    class SyntheticEditRows:
        def eval(self, batch: pa.RecordBatch):
            for part in bounded([batch]):
                ids, px = part.column("id").cast(pa.int64()), part.column("px")
                sides = np.where(np.asarray(px.is_valid()), part.column("side").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), 0)
                for s in np.unique(sides[sides > 0]).tolist():  # images of one size run stacked
                    rows = pa.array(np.flatnonzero(sides == s))
                    stack = px.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 3, s, s)
                    for name, fn in EDITS.items():
                        yield pa.table({"id": ids.take(rows), "edit_type": pa.array([name] * len(rows)),
                                        "type_id": pa.array(np.full(len(rows), tx.TYPE_ID[name], np.int32)),
                                        "after": _list_of_doubles(fn(stack).reshape(len(rows), -1))})

    spark.udtf.register("synthetic_edit_rows", SyntheticEditRows)
    return "synthetic_edit_rows"
