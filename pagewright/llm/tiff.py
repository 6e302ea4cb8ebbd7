"""TIFF columns: writing sample grids as TIFF, and reading TIFF into pages.

The reader walks the chain of image directories of either byte order and gives
one row per page: strips and tiles, chunky and planar samples, uncompressed,
PackBits, LZW and deflate data, horizontal and floating-point predictors undone.
A page that can't be read keeps its row, with the reason in ``error``; a file
that isn't TIFF gives one such row.

The writer stores a byte payload as 8-bit RGB pages of ``WIDTH`` columns; how a
page is laid out and compressed follows from the payload's checksum, so equal
payloads give equal files.

Defined cases: a null file has no pages; an empty one gives a row with an error;
directories that form a loop are read once each; a page that declares more than
its bytes can hold is an error, and nothing beyond what it declares is unpacked;
long files and texts are read and stored whole, one to a batch; null and empty
texts are stored as one row of blanks; equal texts are stored alike, so ties and
repeated rows need no order and stay rows of their own; other columns are kept,
and one that is called like a page's goes by its name with _file behind it; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, documents_only, slices, utf8

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
PAGE_ROWS = 512
STRIP_ROWS = 64
TILE_ROWS = 16
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: By checksum: compression, predictor, tiled.
FORMS = ((DEFLATE, 2, False), (LZW, 1, False), (PACKBITS, 1, True), (DEFLATE, 1, True))


# ---- codecs


#: No codec here makes more bytes of one; a page that declares more can't be whole.
MOST_EXPANSION = 4096


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that grow one early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, prev = list(base), [], b""
    acc = bits = 0
    width, limit = 9, 511
    for byte in data:
        acc = acc << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code < 256 or code > 257:
            if not prev:
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = prev + prev[:1]
                else:
                    raise ValueError("LZW code out of range")
                table.append(prev + entry[:1])
                if len(table) >= limit and width < 12:
                    width += 1
                    limit = (1 << width) - 1
            out.append(entry)
            prev = entry
        elif code == 256:
            table, prev, width, limit = list(base), b"", 9, 511
        else:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, out = {}, bytearray()
    acc, bits, width, free = 256, 9, 9, 258
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = codes.get(key)
        if code is not None:
            prefix = code
            continue
        acc = acc << width | prefix
        bits += width
        if bits >= 64:
            out += (acc >> bits % 8).to_bytes(bits // 8, "big")
            bits %= 8
            acc &= (1 << bits) - 1
        codes[key] = free
        free += 1
        prefix = byte
        if free == 4094:
            acc = (acc << width | 256)
            bits += width
            codes, width, free = {}, 9, 258
        elif free + 1 > 1 << width:
            width += 1
    if prefix >= 0:
        acc = acc << width | prefix
        bits += width
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    acc = acc << width | 257
    bits += width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def packbits_decode(data: bytes) -> bytes:
    out, at, end = [], 0, len(data)
    while at < end:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def plain(stop: int) -> None:
        for i in range(at, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(bytes((len(part) - 1,)) + part)

    for m in _RUN.finditer(data):
        plain(m.start())
        out.append(bytes((257 - (m.end() - m.start()), data[m.start()])))
        at = m.end()
    plain(len(data))
    return b"".join(out)


def decompress(data: bytes, how: int, most: int) -> bytes:
    """The first ``most`` bytes of a strip or tile: what is declared beyond them isn't unpacked."""
    if how == NONE:
        return data
    if how == LZW:
        return lzw_decode(data)
    if how in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, most)
    if how == PACKBITS:
        return packbits_decode(data)
    raise ValueError(f"compression {how}")


def compress(data: bytes, how: int) -> bytes:
    if how == PACKBITS:  # a row at a time, as the format asks
        return b"".join(packbits_encode(data[i : i + ROW]) for i in range(0, len(data), ROW))
    return lzw_encode(data) if how == LZW else zlib.compress(data, 1) if how == DEFLATE else data


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind == "u":
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("=")).astype(block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        raw = np.cumsum(block.view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        planes = raw.transpose(0, 2, 1)  # most significant byte first
        planes = planes if order == ">" else planes[:, :, ::-1]
        return np.ascontiguousarray(planes).view(block.dtype).reshape(rows, columns, samples)
    raise ValueError(f"predictor {predictor}")


# ---- reader

#: The size of each field type.
_TYPE = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and fields of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack(order + "I", data[4:8]), set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise ValueError("directory out of range")
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            code = _TYPE.get(kind)
            if code is None:
                continue
            size = struct.calcsize("=" + code) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if where + size > len(data):
                raise ValueError(f"field {tag} out of range")
            fields[tag] = [data[where : where + count]] if code == "s" else list(struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, where))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, order: str, f: dict[int, list]) -> dict:
    one = lambda tag, default: (f.get(tag) or [default])[0]
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    bits, how, predictor, planar = one(258, 1), one(259, 1), one(317, 1), one(284, 1)
    tiled = 322 in f
    page = {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor, "tiled": tiled}
    if bits not in (8, 16, 32, 64) or any(b != bits for b in f.get(258, [bits])):
        raise ValueError(f"{bits} bits a sample")
    dtype = np.dtype(f"{order}{'f' if one(339, 1) == 3 else 'u'}{bits // 8}")
    w, h = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height) or height)
    if not (width and height and samples and w and h):
        raise ValueError("no size")
    offsets, counts = f[324 if tiled else 273], f[325 if tiled else 279]
    across, down = -(-width // w), -(-height // h)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("strips or tiles are missing")
    if height * width * samples * dtype.itemsize > MOST_EXPANSION * len(data):
        raise ValueError("data is cut off")
    out = np.zeros((height, width, samples), dtype)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        need = rows * w * deep * dtype.itemsize
        raw = decompress(data[offsets[k] : offsets[k] + counts[k]], how, need)
        if len(raw) < need:
            raise ValueError("data is cut off")
        block = undo_predictor(np.frombuffer(raw[:need], dtype).reshape(rows, w, deep), predictor, order)
        own = block[: height - y, : width - x]
        if planar == 2:
            out[y : y + own.shape[0], x : x + own.shape[1], plane] = own[:, :, 0]
        else:
            out[y : y + own.shape[0], x : x + own.shape[1]] = own
    pixels = np.ascontiguousarray(out)
    return page | {"pixels": pixels.tobytes(), "mean": float(pixels.mean(dtype=np.float64)), "dhash": difference_hash(pixels)}


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether brightness rises from one to the next of 9 cells, in 8 bands."""
    gray = pixels.mean(axis=2, dtype=np.float64)
    rows = np.linspace(0, gray.shape[0], 9).astype(int)
    columns = np.linspace(0, gray.shape[1], 10).astype(int)
    total = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    total[1:, 1:] = gray.cumsum(axis=0).cumsum(axis=1)
    cell = total[np.ix_(rows[1:], columns[1:])] - total[np.ix_(rows[:-1], columns[1:])] - total[np.ix_(rows[1:], columns[:-1])] + total[np.ix_(rows[:-1], columns[:-1])]
    area = np.maximum(np.diff(rows)[:, None] * np.diff(columns)[None, :], 1)
    return np.packbits(np.diff(np.round(cell / area, 6), axis=1) > 0).tobytes().hex()


PAGE = "page int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, mean double, dhash string, error string"
_NAMES = [x.split()[0] for x in PAGE.split(", ")]
_ARROW = pa.struct(list(zip(_NAMES, [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.binary(), pa.float64(), pa.string(), pa.string()], strict=True)))


def read(data: bytes | None) -> list[dict]:
    """The pages of a file."""
    if data is None:
        return []
    out = []
    try:
        for order, fields in directories(data):
            page = {"page": len(out)}
            try:
                page |= read_page(data, order, fields)
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error, MemoryError) as e:
                page["error"] = str(e) or type(e).__name__
            out.append(page)
    except (ValueError, struct.error) as e:
        out.append({"page": len(out), "error": str(e)})
    return [{k: p.get(k) for k in _NAMES} for p in out]


def _apart(files: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """Column f, a struct of the other columns of ``files``, and column m, the files; the others' names."""
    others = [c for c in files.columns if c != column]
    rest = boxed(files.select(*(F.col(f"`{c}`") for c in others)), "f") if others else F.struct(F.lit(0).alias("none")).alias("f")
    return files.select(rest, F.col(f"`{column}`").alias("m")), others


def _mapped(rows: DataFrame, found: list[tuple[str, T.DataType]], run) -> DataFrame:
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in found)]))


def with_pages(files: DataFrame, column: str, name: str = "pages") -> DataFrame:
    """``files`` with an array of its pages as column ``name``, in place of a column of that name."""
    rows, others = _apart(files, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "m", 4 << 20):
            yield b.append_column("p", pa.array([read(x) for x in b.column(1).to_pylist()], pa.list_(_ARROW)))

    inner = ",".join(f"{n}:{t}" for n, t in (x.split() for x in PAGE.split(", ")))
    found = _mapped(rows, [("p", T._parse_datatype_string(f"array<struct<{inner}>>"))], run)
    kept = [F.col("m").alias(c) if c == column else F.col(f"f.`{c}`").alias(c) for c in files.columns if c.lower() != name.lower()]
    return found.select(*kept, F.col("p").alias(name))


def tiff_pages(files: DataFrame, column: str) -> DataFrame:
    """One row per page: the other columns of ``files``, then those of PAGE.

    A column of ``files`` that is called like one of PAGE is kept under its name
    with ``_file`` behind it.  A null file has no page; a damaged one has a page
    that says what is wrong in error, after those that could be read.
    """
    page = {n.lower() for n in _NAMES}
    rows, kept = _apart(files, column)
    names = [f"{c}_file" if c.lower() in page else c for c in kept]
    return with_pages(rows, "m").select("f", F.explode("pages").alias("p")).select(*(F.col(f"f.`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), "p.*")


# ---- writer


def _directory(at: int, fields: list[tuple[int, int, list[int]]], after: bool) -> bytes:
    """A little-endian directory at offset ``at``, its long values behind it."""
    head, extra = [], b""
    behind = at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            where = struct.pack("<I", behind + len(extra))
            extra += raw
        else:
            where = raw.ljust(4, b"\0")
        head.append(struct.pack("<HHI", tag, kind, len(values)) + where)
    following = behind + len(extra) if after else 0
    return struct.pack("<H", len(fields)) + b"".join(head) + struct.pack("<I", following) + extra


def write(payload: bytes) -> bytes:
    """A TIFF file of the payload, whose length is a positive multiple of ROW."""
    rows, form = len(payload) // ROW, zlib.crc32(payload)
    starts = list(range(0, rows, PAGE_ROWS))
    pages = []
    for p, first in enumerate(starts):
        how, predictor, tiled = FORMS[(form + p) % len(FORMS)]
        height = min(PAGE_ROWS, rows - first)
        block = np.frombuffer(payload, np.uint8, height * ROW, first * ROW).reshape(height, WIDTH, SAMPLES)
        if predictor == 2:
            block = np.diff(block, axis=1, prepend=np.zeros((height, 1, SAMPLES), np.uint8))
        step = TILE_ROWS if tiled else STRIP_ROWS
        raw = block.tobytes()
        parts = [raw[i * ROW : (i + step) * ROW] for i in range(0, height, step)]
        if tiled:
            parts[-1] = parts[-1].ljust(step * ROW, b"\0")
        pages.append((height, how, predictor, tiled, step, [compress(x, how) for x in parts]))
    data, at = [], 8
    places = []
    for *_, parts in pages:
        own = []
        for x in parts:
            own.append(at)
            data.append(x)
            at += len(x)
        places.append(own)
    first = at + at % 2
    if at % 2:
        data.append(b"\0")
    at = first
    for p, (height, how, predictor, tiled, step, parts) in enumerate(pages):
        fields = [(256, 4, [WIDTH]), (257, 4, [height]), (258, 3, [8] * SAMPLES), (259, 3, [how]), (262, 3, [2]), (277, 3, [SAMPLES]), (284, 3, [1]), (317, 3, [predictor])]
        sizes = [len(x) for x in parts]
        fields += [(322, 4, [WIDTH]), (323, 4, [step]), (324, 4, places[p]), (325, 4, sizes)] if tiled else [(273, 4, places[p]), (278, 4, [step]), (279, 4, sizes)]
        one = _directory(at, sorted(fields), p + 1 < len(pages))
        data.append(one)
        at += len(one)
    return b"II*\0" + struct.pack("<I", first) + b"".join(data)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text, padded with blanks to whole rows, as TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            texts = utf8(b.column(1))
            media = [write(t.ljust(max(ROW, -(-len(t) // ROW) * ROW))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents_only(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def with_payload(files: DataFrame, column: str) -> DataFrame:
    """``files`` with payload, all pages' pixels in order, and feature, a summary of
    each page; both in one pass over the bytes."""
    names = ["width", "height", "samples", "compression", "dhash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "m", 4 << 20):
            found = [read(x) for x in b.column(1).to_pylist()]
            payload = [b"".join(p["pixels"] or b"" for p in pages) for pages in found]
            feature = [";".join(":".join(str(p[n]) for n in names if p[n] is not None) for p in pages) for pages in found]
            yield b.append_column("payload", pa.array(payload, pa.binary())).append_column("feature", pa.array(feature, pa.string()))

    rows, others = _apart(files, column)
    found = _mapped(rows, [("payload", T.BinaryType()), ("feature", T.StringType())], run)
    return found.select(*(F.col("m").alias(c) if c == column else F.col(f"f.`{c}`").alias(c) for c in files.columns), "payload", "feature")


def op1_tiff_pages(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, computed from what is read back."""
    found = with_payload(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
