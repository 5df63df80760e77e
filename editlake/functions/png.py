"""PNG pixels for whole batches: zlib, the five row filters, all colour types.

The slow part of a PNG is undoing the row filters: a byte depends on the bytes
to the left, above, and above left. Here images of equal size in a batch are
undone together along anti-diagonals (all pixels with the same x + y): each
needs the two diagonals before it only, so one NumPy step covers a diagonal of
every image, whatever filters their rows use.

Result: RGB, 8 bits. Grey is repeated, palettes are looked up, 16-bit samples
keep their high byte, 1-, 2- and 4-bit grey is spread over 0..255, and alpha and
transparency are dropped (pixels are not blended). Interlaced files, damaged
data and chunks with a wrong checksum are refused by a ``ValueError`` that says so.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
NONE, SUB, UP, AVERAGE, PAETH = range(5)

#: Larger images are refused before anything is inflated.
MOST_PIXELS = 1 << 28
#: Images undone at once; more no longer fit a core's cache.
TOGETHER = 64


class Header(NamedTuple):
    width: int
    height: int
    depth: int
    kind: int

    @property
    def row_bytes(self) -> int:
        return (self.width * CHANNELS[self.kind] * self.depth + 7) // 8

    @property
    def step(self) -> int:
        """Bytes from a byte to the one "left" of it, for the filters."""
        return max(1, CHANNELS[self.kind] * self.depth // 8)


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8:at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise ValueError("PNG cut short")
        if zlib.crc32(body, zlib.crc32(name)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"PNG chunk {name!r} has a wrong checksum")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + size
    raise ValueError("PNG cut short")


def inflate(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[Header, np.ndarray, np.ndarray | None]:
    """Header, filtered rows ``(height, 1 + row_bytes)`` and palette of a file."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    header, palette, parts = None, None, []
    for name, body in _chunks(data):
        if header is None:
            if name != b"IHDR" or len(body) != 13:
                raise ValueError("PNG without a header")
            width, height, depth, kind, packing, filters, interlace = struct.unpack(">IIBBBBB", body)
            if kind not in CHANNELS or depth not in DEPTHS[kind] or packing or filters or interlace > 1 or not width or not height:
                raise ValueError("PNG header is damaged")
            if interlace:
                raise ValueError("interlaced PNG is not supported")
            if width * height > most_pixels:
                raise ValueError(f"PNG of {width} x {height} pixels is too large")
            header = Header(width, height, depth, kind)
        elif name == b"PLTE":
            if len(body) % 3 or not 3 <= len(body) <= 768:
                raise ValueError("PNG palette is damaged")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
    if header is None or (header.kind == 3 and palette is None):
        raise ValueError("PNG without a header or palette")
    size = header.height * (1 + header.row_bytes)
    try:
        raw = zlib.decompressobj().decompress(b"".join(parts), size)
    except zlib.error as e:
        raise ValueError(f"PNG data is damaged: {e}") from e
    if len(raw) != size:
        raise ValueError("PNG cut short")
    rows = np.frombuffer(raw, np.uint8).reshape(header.height, 1 + header.row_bytes)
    if rows[:, 0].max() > PAETH:
        raise ValueError("PNG row filter is unknown")
    return header, rows, palette


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """``(n, height, 1 + row_bytes)`` filtered rows of n images -> their bytes."""
    kinds, raw = rows[:, :, 0], rows[:, :, 1:]
    n, h, w = raw.shape
    if not kinds.any():
        return raw
    if kinds.max() <= SUB and w % step == 0:
        summed = np.cumsum(raw.reshape(n, h, w // step, step), axis=2, dtype=np.uint8).reshape(n, h, w)
        return np.where((kinds == SUB)[:, :, None], summed, raw)
    cols = -(-w // step)
    padded = np.zeros((n, h, cols * step), np.uint8)
    padded[:, :, :w] = raw
    pixels = padded.reshape(n, h, cols, step)
    y = np.arange(h)
    skewed = np.zeros((h + cols + 1, h + 1, n, step), np.int16)  # [x + y + 2, y + 1]: two empty diagonals, an empty row
    x = np.arange(cols)
    skewed[(y[:, None] + x[None, :] + 2), y[:, None] + 1] = pixels.transpose(1, 2, 0, 3)
    of_kind = [np.ascontiguousarray((kinds == k).T[:, :, None]).astype(np.int16) for k in range(5)]
    any_average, any_paeth = of_kind[AVERAGE].any(), of_kind[PAETH].any()
    for t in range(h + cols - 1):
        a, b = max(0, t - cols + 1), min(t, h - 1) + 1  # rows that this diagonal crosses
        left, up, corner = skewed[t + 1, a + 1:b + 1], skewed[t + 1, a:b], skewed[t, a:b]
        guess = of_kind[SUB][a:b] * left + of_kind[UP][a:b] * up
        if any_average:
            guess += of_kind[AVERAGE][a:b] * ((left + up) >> 1)
        if any_paeth:
            p = left + up - corner
            from_left, from_up, from_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            best = np.where((from_left <= from_up) & (from_left <= from_corner), left,
                            np.where(from_up <= from_corner, up, corner))
            guess += of_kind[PAETH][a:b] * best
        line = skewed[t + 2, a + 1:b + 1]
        line += guess
        line &= 255
    out = skewed[(y[:, None] + x[None, :] + 2), y[:, None] + 1].transpose(2, 0, 1, 3).astype(np.uint8)
    return out.reshape(n, h, cols * step)[:, :, :w]


def to_rgb(header: Header, data: np.ndarray, palette: np.ndarray | None) -> np.ndarray:
    """Unfiltered bytes ``(height, row_bytes)`` -> ``(height, width, 3)``."""
    h, w, c = header.height, header.width, CHANNELS[header.kind]
    if header.depth == 16:
        data = data[:, ::2]
    elif header.depth < 8:
        bits = np.unpackbits(np.ascontiguousarray(data), axis=1)[:, :w * header.depth].reshape(h, w, header.depth)
        data = bits @ (1 << np.arange(header.depth - 1, -1, -1)).astype(np.uint8)
        if header.kind == 0:
            data = data * np.uint8(255 // ((1 << header.depth) - 1))
    px = data.reshape(h, w, c)
    if header.kind == 3:
        if px.max() >= len(palette):
            raise ValueError("PNG palette index out of range")
        return palette[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, axis=2) if c < 3 else np.ascontiguousarray(px[:, :, :3])


def decode(files: Sequence[bytes]) -> list[np.ndarray | ValueError]:
    """RGB pixels ``(height, width, 3)`` of each file, or why it can't be read."""
    out: list = [None] * len(files)
    alike: dict[Header, list[tuple[int, np.ndarray, np.ndarray | None]]] = {}
    for i, data in enumerate(files):
        try:
            header, rows, palette = inflate(data)
            alike.setdefault(header, []).append((i, rows, palette))
        except ValueError as e:
            out[i] = e
    for header, all_members in alike.items():
        for first in range(0, len(all_members), TOGETHER):
            members = all_members[first:first + TOGETHER]
            data = unfilter(np.stack([rows for _, rows, _ in members]), header.step)
            for (i, _, palette), one in zip(members, data):
                try:
                    out[i] = to_rgb(header, one, palette)
                except ValueError as e:
                    out[i] = e
    return out


def _filtered(px: np.ndarray, step: int, kinds: Sequence[int]) -> bytes:
    """Rows of bytes with their filters applied; row y uses ``kinds[y % len(kinds)]``."""
    x = px.astype(np.int16)
    left = np.zeros_like(x)
    left[:, step:] = x[:, :-step]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    corner = np.zeros_like(x)
    corner[1:, step:] = x[:-1, :-step]
    p = left + up - corner
    from_left, from_up, from_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    paeth = np.where((from_left <= from_up) & (from_left <= from_corner), left, np.where(from_up <= from_corner, up, corner))
    guesses = np.stack([np.zeros_like(x), left, up, (left + up) >> 1, paeth])
    kind = np.array(kinds)[np.arange(len(x)) % len(kinds)]
    rows = ((x - guesses[kind, np.arange(len(x))]) & 255).astype(np.uint8)
    return np.concatenate([kind[:, None].astype(np.uint8), rows], axis=1).tobytes()


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))


def encode(px: np.ndarray, kinds: Sequence[int] = (PAETH,), level: int = 6) -> bytes:
    """``(height, width, channels)`` bytes as a PNG file of 8 bits (1 to 4 channels:
    grey, grey and alpha, RGB, RGBA); row y uses the filter ``kinds[y % len(kinds)]``."""
    h, w, c = px.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    body = zlib.compress(_filtered(np.ascontiguousarray(px, np.uint8).reshape(h, w * c), c, kinds), level)
    return (SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
            + chunk(b"IDAT", body) + chunk(b"IEND", b""))
