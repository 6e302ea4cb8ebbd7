"""Pixels of PNG images: luminance, what P2 asks of it, and runs of dark pixels.

An image is decoded where its row is, turned as its orientation says, and leaves as
a few numbers and as runs along its rows and columns; pixels themselves are never
rows.  JPEG images are decoded by the recogniser's host, not here.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from . import structure as S

#: Luminance under which a pixel is dark, and pixels of an image at most.
DARK, MOST_PIXELS = 180, 100_000_000
#: Images whose numbers and runs are handed on together; their pixels never are.
TOGETHER = 64


def unfiltered(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Scanlines with their filters undone; ``step``: bytes to the same sample of the pixel before."""
    lines = raw[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)  # a line of zeros stands above the first
    for y in range(height):
        kind, x, up, to = lines[y, 0], lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            to[:] = x
        elif kind == 1:
            for k in range(step):
                to[k::step] = np.cumsum(x[k::step], dtype=np.uint8)
        elif kind == 2:
            np.add(x, up, out=to)
        elif kind in (3, 4):
            _sequential(kind, x.tolist(), up.tolist(), to, step)
        else:
            raise ValueError(f"filter {kind}")
    return out[1:]


def _sequential(kind: int, x: list[int], up: list[int], to: np.ndarray, step: int) -> None:
    """Average and Paeth, where each byte needs the one before it."""
    done = [0] * step  # what stands left of the line
    put = done.append
    if kind == 3:
        for v, left, above in zip(x, done, up, strict=False):
            put((v + ((left + above) >> 1)) & 255)
    else:
        for v, left, above, corner in zip(x, done, up, [0] * step + up, strict=False):
            # the one of the three that is closest to left + above - corner, in this order
            if above == corner:
                near = left
            elif left == corner:
                near = above
            else:
                to_left, to_above, to_corner = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
                near = left if to_left <= to_above and to_left <= to_corner else above if to_above <= to_corner else corner
            put((v + near) & 255)
    to[:] = done[step:]


def _samples(lines: np.ndarray, width: int, depth: int, per: int) -> np.ndarray:
    """height x width x samples, 8 bits each but for palette places and small grays."""
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        lines = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return lines[:, : width * per].reshape(len(lines), width, per)


def pixels(data: bytes) -> np.ndarray:
    """height x width x 1 or 3, of 0 to 255; alpha is left out, as nothing is behind the page."""
    head, palette, packed = None, b"", []
    for name, at, size, ok in S.png_chunks(data):
        body = data[at : at + size]
        if not ok:
            raise ValueError(f"chunk {name}")
        if name == "IHDR":
            head = (int.from_bytes(body[:4]), int.from_bytes(body[4:8]), body[8], body[9], body[12])
        elif name == "PLTE":
            palette = body
        elif name == "IDAT":
            packed.append(body)
    if head is None or 0 in head[:2] or head[0] * head[1] > MOST_PIXELS or head[3] not in S.SAMPLES:
        raise ValueError("header")
    width, height, depth, colour, interlaced = head
    per, want = S.SAMPLES[colour], S.png_bytes(*head)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), want), np.uint8)
    if len(raw) < want:
        raise ValueError("pixels are missing")
    out, at = np.zeros((height, width, per), np.uint8), 0
    for x0, y0, dx, dy, w, h in S.png_passes(width, height, interlaced):
        stride = (w * per * depth + 7) // 8
        lines = unfiltered(raw[at:], h, stride, max(1, per * depth // 8))
        out[y0::dy, x0::dx] = _samples(lines, w, depth, per)
        at += h * (stride + 1)
    if colour == 3:
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette) // 3] = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        out = table[out[:, :, 0]]
    elif depth < 8:
        out = out * np.uint8(255 // (2**depth - 1))
    return out[:, :, : 3 if out.shape[2] >= 3 else 1]


def luminance(data: bytes) -> np.ndarray:
    """height x width of 0 to 255."""
    out = pixels(data)
    if out.shape[2] == 1:
        return out[:, :, 0]
    # The weights of red, green and blue in 65,536ths.
    return ((out.astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16).astype(np.uint8)


def encoded_anew(data: bytes) -> bytes | None:
    """A PNG of the same pixels, as red, green and blue, and nothing else; None where it can't be decoded."""
    try:
        out = pixels(data)
    except (ValueError, zlib.error):
        return None
    return written(np.repeat(out, 3, axis=2) if out.shape[2] == 1 else out, (0,))


@F.arrow_udf(BinaryType())
def clean_png(content: pa.Array) -> pa.Array:
    return pa.array([None if x is None else encoded_anew(x) for x in content.to_pylist()], pa.binary())


def turned(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image as it is looked at, from how it is stored."""
    if orientation >= 5:
        image = image.T
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image


def runs(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line, first, last of the runs of dark pixels along the rows."""
    edge = np.zeros((dark.shape[0], dark.shape[1] + 2), np.int8)
    edge[:, 1:-1] = dark
    line, at = np.nonzero(np.diff(edge, axis=1))
    return line[::2], at[::2], at[1::2] - 1


_RUN = StructType([StructField(n, IntegerType()) for n in ("line", "first", "last")])
RASTER = StructType([StructField(n, IntegerType()) for n in ("width", "height", "low", "high")] + [StructField("variance", DoubleType())] + [StructField(n, ArrayType(_RUN)) for n in ("rows", "columns")])


def measured(data: bytes, with_runs: bool = True) -> tuple | None:
    """width, height, low, high, variance, and the runs by row and by column."""
    try:
        image = luminance(data)
    except (ValueError, zlib.error):
        return None
    none = (np.zeros(0, np.int64),) * 3
    if with_runs:
        image = turned(image, S.described(data)["orientation"] or 1)
    else:  # the rest needs the sides alone
        across = (S.described(data)["orientation"] or 1) >= 5
        image = image.T if across else image
    dark = image < DARK if with_runs else None
    return image.shape[1], image.shape[0], int(image.min()), int(image.max()), float(image.var()), runs(dark) if with_runs else none, runs(dark.T) if with_runs else none


def _run_lists(found: list[tuple | None], at: int) -> pa.Array:
    """The runs of images as lists of structs, null where an image couldn't be decoded."""
    mine = [f[at] if f else None for f in found]
    ends = np.cumsum([0, *(len(m[0]) if m else 0 for m in mine)]).astype(np.int32)
    parts = [np.concatenate([np.zeros(0, np.int64), *(m[k] for m in mine if m)]).astype(np.int32) for k in range(3)]
    values = pa.StructArray.from_arrays([pa.array(p) for p in parts], ["line", "first", "last"])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([m is None for m in mine]))


def rasters(files: DataFrame, key: str = "page_id", with_runs: bool = True) -> DataFrame:
    """key, width, height, low, high, variance, rows, columns of files(key, content): the
    extremes and the variance of each PNG's luminance, and its dark runs by row and by
    column (line, first, last).  All are null where an image can't be decoded; without
    ``with_runs`` no run is looked for."""
    kind = files.schema[key].dataType.simpleString()
    schema = StructType([*StructType.fromDDL(f"`{key}` {kind}").fields, *RASTER.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 4 + [pa.float64()]
        for batch in batches:
            for begun in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(begun, TOGETHER)
                found = [measured(x.as_py() or b"", with_runs) for x in part.column(1)]
                numbers = [pa.array([f[k] if f else None for f in found], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, _run_lists(found, 5), _run_lists(found, 6)], [key, *RASTER.names])

    return files.select(key, "content").mapInArrow(run, schema)


def runs_of(seen: DataFrame, axis: str, key: str = "page_id") -> DataFrame:
    """key, line, first, last: the dark runs of ``axis`` (rows or columns) as rows."""
    return seen.select(key, F.explode(axis).alias("r")).select(key, "r.line", "r.first", "r.last")


def written(image: np.ndarray, filters: tuple[int, ...] = (0, 1, 2, 3, 4), orientation: int = 1) -> bytes:
    """A PNG of a height x width or height x width x 3 array, the filters taken in turn;
    an orientation other than 1 is put into an Exif chunk."""
    height, width = image.shape[:2]
    per = 1 if image.ndim == 2 else image.shape[2]
    lines = image.reshape(height, width * per).astype(np.int16)
    zeros = np.zeros((1, width * per), np.int16)
    up = np.concatenate((zeros, lines[:-1]))
    left, corner = np.zeros_like(lines), np.zeros_like(lines)
    left[:, per:], corner[:, per:] = lines[:, :-per], up[:, :-per]
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    by = [np.zeros_like(lines), left, up, (left + up) >> 1, paeth]
    kinds = [filters[y % len(filters)] for y in range(height)]
    raw = b"".join(bytes([k]) + (lines[y] - by[k][y]).astype(np.uint8).tobytes() for y, k in enumerate(kinds))
    chunk = lambda name, body: len(body).to_bytes(4) + name + body + zlib.crc32(name + body).to_bytes(4)
    head = width.to_bytes(4) + height.to_bytes(4) + bytes([8, 0 if per == 1 else 2, 0, 0, 0])
    # an Exif block of one entry: tag, type (a 16-bit number), count, value
    exif = b"II*\0\x08\0\0\0\x01\0" + (0x0112).to_bytes(2, "little") + b"\x03\0\x01\0\0\0" + bytes([orientation, 0, 0, 0]) + bytes(4)
    return S.PNG + chunk(b"IHDR", head) + (chunk(b"eXIf", exif) if orientation != 1 else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
