"""What PDF, PNG and JPEG files are made of, read from their bytes.

``file_parts`` gives a row for each part of a file: the chunks of a PNG with their
checksums, the segments of a JPEG, the objects and trailers of a PDF (those packed
in object streams included).  ``structure`` condenses them to one value a file:
pages, size, orientation, whether it is locked, and what is wrong with it.

Objects of a PDF are found by walking the file, not by its cross-reference table, so
a file whose table is lost still opens; of objects with one number the last counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

PNG, JPEG, PDF = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"%PDF-"


class Part(NamedTuple):
    """``at`` is -1 for what lies inside another part; ``value`` differs by kind."""

    kind: str
    at: int
    size: int
    ok: bool
    value: tuple[int, ...] = ()


# ---- PNG

#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_passes(width: int, height: int, interlaced: int) -> list[tuple[int, int, int, int, int, int]]:
    """x0, y0, step x, step y, width, height of the images a PNG stores."""
    if not interlaced:
        return [(0, 0, 1, 1, width, height)]
    grid = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    found = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in grid]
    return [p for p in found if p[4] > 0 and p[5] > 0]


def png_bytes(width: int, height: int, depth: int, colour: int, interlaced: int) -> int:
    """Bytes that the scanlines of a PNG inflate to."""
    bits = depth * SAMPLES.get(colour, 0)
    return sum(h * (1 + (w * bits + 7) // 8) for *_, w, h in png_passes(width, height, interlaced))


def png_chunks(data: bytes) -> Iterator[tuple[str, int, int, bool]]:
    """name, place of the body, its length, whether it is whole and its checksum right."""
    at = len(PNG)
    while at < len(data):
        size = int.from_bytes(data[at : at + 4])
        name, body = data[at + 4 : at + 8], at + 8
        whole = body + size + 4 <= len(data)
        yield name.decode("latin-1"), body, size, whole and zlib.crc32(data[at + 4 : body + size]) == int.from_bytes(data[body + size : body + size + 4])
        if not whole or name == b"IEND":
            return
        at = body + size + 4


def _png(data: bytes) -> Iterator[Part]:
    head: tuple[int, ...] = ()
    inflate, made, broken = zlib.decompressobj(), 0, False
    for name, body, size, ok in png_chunks(data):
        value: tuple[int, ...] = ()
        if name == "IHDR" and size == 13:
            h = data[body : body + 13]
            head = value = (int.from_bytes(h[:4]), int.from_bytes(h[4:8]), h[8], h[9], h[12])
        elif name == "eXIf":
            value = (orientation(data[body : body + size]),)
        elif name == "IDAT" and not broken:
            try:
                made += len(inflate.decompress(data[body : body + size]))
            except zlib.error:
                broken = True
        yield Part(f"chunk {name}", body, size, ok, value)
    want = png_bytes(*head) if head and 0 not in head[:2] else 0
    yield Part("pixels", -1, made, bool(want) and made >= want and not broken, (want,))


# ---- JPEG


def orientation(tiff: bytes) -> int:
    """The orientation tag (1 to 8) of an Exif block, 1 where there is none."""
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    at = number(4, 4)
    for i in range(number(at, 2)):
        entry = at + 2 + 12 * i
        if entry + 12 > len(tiff):
            break
        if number(entry, 2) == 0x0112:
            found = number(entry + 8, 2)
            return found if 1 <= found <= 8 else 1
    return 1


_MARKER = re.compile(rb"\xff+([\x01-\xcf\xd8-\xfe])")  # neither a stuffed byte nor a restart


def _jpeg(data: bytes) -> Iterator[Part]:
    at, exif = 2, b"Exif\0\0"
    while at + 1 < len(data):
        if data[at] != 0xFF:
            yield Part("rubbish", at, len(data) - at, False)
            return
        code, body = data[at + 1], at + 2
        if code == 0xFF:
            at += 1
            continue
        if code == 0xD9:
            yield Part("marker D9", body, 0, True)
            return
        if code == 0x01 or 0xD0 <= code <= 0xD8:
            at = body
            continue
        size = int.from_bytes(data[body : body + 2])
        ok = size >= 2 and body + size <= len(data)
        value: tuple[int, ...] = ()
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC) and ok and size >= 8:
            value = (int.from_bytes(data[body + 5 : body + 7]), int.from_bytes(data[body + 3 : body + 5]), data[body + 2], data[body + 7])
        elif code == 0xE1 and data.startswith(exif, body + 2):
            value = (orientation(data[body + 8 : body + size]),)
        yield Part(f"marker {code:02X}", body, size, ok, value)
        if not ok:
            return
        at = body + size
        if code == 0xDA:  # what follows a scan's header is coded data, up to the next marker
            end = _MARKER.search(data, at)
            yield Part("scan", at, (end.start() if end else len(data)) - at, end is not None)
            if end is None:
                return
            at = end.start()


# ---- PDF

_TOKEN = re.compile(rb"<<|>>|[\[\]]|/[^\x00\t\n\f\r /<>\[\](){}%]*|\(|<[0-9A-Fa-f\s]*>|%[^\r\n]*|[^\x00\t\n\f\r /<>\[\](){}%]+")
_PAREN = re.compile(rb"\\.|[()]", re.S)
_NEXT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b|\btrailer\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")


def _entries(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    """The dictionary that begins at or after ``at``, its values unread, and where it ends."""
    found: dict[bytes, bytes] = {}
    depth, name, begun = 0, None, 0
    while m := _TOKEN.search(data, at):
        token, at = m.group(), m.end()
        if token == b"(":
            level = 1
            while level and (p := _PAREN.search(data, at)):
                level += {b"(": 1, b")": -1}.get(p.group(), 0)
                at = p.end()
            if level:
                break
        elif token in (b"<<", b"["):
            depth += 1
        elif token in (b">>", b"]"):
            depth -= 1
            if depth == 0:
                if name is not None:
                    found[name] = data[begun : m.start()].strip()
                return found, at
        elif depth == 0:  # another object than a dictionary
            return {}, m.start()
        if depth == 1 and token[:1] == b"/" and (name is None or data[begun : m.start()].strip()):
            if name is not None:
                found[name] = data[begun : m.start()].strip()
            name, begun = token, at
    return found, len(data)


def _numbers(value: bytes) -> tuple[int, ...]:
    return tuple(int(x) for x in _REF.findall(value))


def _described(number: int, entries: dict[bytes, bytes], at: int, size: int, ok: bool) -> Part:
    kind = entries.get(b"/Type", b"")[1:].decode("latin-1")
    refs = _numbers(entries.get(b"/Kids" if kind == "Pages" else b"/Pages" if kind == "Catalog" else b"/Root", b""))
    return Part(f"object {kind}".strip(), at, size, ok, (number, int(b"/Encrypt" in entries), *refs))


def _packed(entries: dict[bytes, bytes], stream: bytes) -> Iterator[Part]:
    """The objects of an object stream."""
    try:
        if b"FlateDecode" in entries.get(b"/Filter", b""):
            stream = zlib.decompressobj().decompress(stream)
        first, n = int(entries[b"/First"]), int(entries[b"/N"])
        head = [int(x) for x in stream[:first].split()[: 2 * n]]
    except (zlib.error, KeyError, ValueError):
        return
    for number, at in zip(head[::2], head[1::2], strict=False):
        yield _described(number, _entries(stream, first + at)[0], -1, 0, True)


def _pdf(data: bytes) -> Iterator[Part]:
    at = 0
    while m := _NEXT.search(data, at):
        entries, end = _entries(data, m.end()) if b"<<" in data[m.end() : m.end() + 64] else ({}, m.end())
        if m[1] is None:
            yield Part("trailer", m.start(), end - m.start(), bool(entries), (0, int(b"/Encrypt" in entries), *_numbers(entries.get(b"/Root", b""))))
            at = max(end, m.end())
            continue
        if opened := re.compile(rb"\s*stream\r?\n?").match(data, end):
            size = entries.get(b"/Length", b"")
            stop = opened.end() + int(size) if size.isdigit() else -1
            if stop < 0 or data.find(b"endstream", stop, stop + 16) < 0:  # no length, or a wrong one
                stop = data.find(b"endstream", opened.end())
            stop = len(data) if stop < 0 else stop
            if entries.get(b"/Type") == b"/ObjStm":
                yield from _packed(entries, data[opened.end() : stop])
            end = stop
        close = data.find(b"endobj", end)
        another = _NEXT.search(data, end)
        ok = close >= 0 and (another is None or close < another.start())
        yield _described(int(m[1]), entries, m.start(), end - m.start(), ok)
        at = close + 6 if ok else max(end, m.end())


def _pages(parts: list[Part]) -> int | None:
    """Leaves of the page tree, None where no tree can be reached."""
    of = {p.value[0]: p for p in parts if p.kind.startswith("object")}
    roots = [r for p in parts if p.kind in ("trailer", "object XRef") for r in p.value[2:]]
    catalog = next((of[r] for r in reversed(roots) if r in of and of[r].kind == "object Catalog"), None)
    catalog = catalog or next((p for p in reversed(parts) if p.kind == "object Catalog"), None)
    if catalog is None or not any(r in of for r in catalog.value[2:]):
        return None
    pages, seen, open_ = 0, set(), list(catalog.value[2:])
    while open_:
        p = of.get(n := open_.pop())
        if p is None or n in seen:
            continue
        seen.add(n)
        pages += p.kind == "object Page"
        open_ += p.value[2:] if p.kind == "object Pages" else ()
    return pages


# ---- columns and rows


def parts_of(data: bytes) -> list[Part]:
    walk = _png if data.startswith(PNG) else _jpeg if data.startswith(JPEG) else _pdf if data.startswith(PDF) else None
    return list(walk(data)) if walk else []


def described(data: bytes) -> dict:
    """pages, width, height, orientation, locked, fault of a file of one of the three types."""
    out = dict.fromkeys(("pages", "width", "height", "orientation", "locked", "fault"))
    parts = parts_of(data)
    if data.startswith(PDF):
        out["locked"] = any(p.value[1] for p in parts if p.kind in ("trailer", "object XRef"))
        out["pages"] = _pages(parts)
        out["fault"] = "damaged_pdf" if out["pages"] is None and not out["locked"] else None
        return out
    if not parts:
        return out | {"fault": "unsupported_type"}
    is_frame = lambda p: len(p.value) >= 4  # noqa: E731  a header chunk or a frame marker
    frame = next((p for p in parts if is_frame(p)), None)
    out |= {"pages": 1, "locked": False, "orientation": next((p.value[0] for p in parts if p.kind in ("chunk eXIf", "marker E1") and p.value), 1)}
    if frame:
        out |= {"width": frame.value[0], "height": frame.value[1]}
    whole = all(p.ok for p in parts) and (parts[0].kind == "chunk IHDR" and parts[-2].kind == "chunk IEND" if data.startswith(PNG) else parts[-1].kind == "marker D9" and any(p.kind == "scan" for p in parts))
    if not frame or not whole:
        return out | {"fault": "damaged_image"}
    return out | {"fault": "no_area" if 0 in frame.value[:2] else None}


STRUCTURE = StructType([StructField(n, BooleanType() if n == "locked" else StringType() if n == "fault" else IntegerType()) for n in ("pages", "width", "height", "orientation", "locked", "fault")])


@F.arrow_udf(STRUCTURE)
def structure(content: pa.Array) -> pa.Array:
    kinds = {"locked": pa.bool_(), "fault": pa.string()}
    got = [described(x or b"") for x in content.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([g[n] for g in got], kinds.get(n, pa.int32())) for n in STRUCTURE.names], STRUCTURE.names)


def file_parts(files: DataFrame, key: str = "path") -> DataFrame:
    """key, seq, kind, at, size, ok, value: the parts of files(key, content), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        for batch in batches:
            for i, content in enumerate(batch.column(1)):
                parts = parts_of(content.as_py() or b"")
                own = batch.column(0).slice(i, 1).take(pa.array([0] * len(parts), pa.int32()))
                columns = [pa.array([p[c] for p in parts], k) for c, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([own, pa.array(range(len(parts)), pa.int32()), *columns], [key, "seq", "kind", "at", "size", "ok", "value"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, seq int, kind string, at long, size long, ok boolean, value array<long>")


def oriented_size(width: Column, height: Column, turned: Column) -> Column:
    """struct(width, height) of an image as it is looked at."""
    across = turned.between(5, 8)
    return F.struct(F.when(across, height).otherwise(width).alias("width"), F.when(across, width).otherwise(height).alias("height"))


def orienting(width: Column, height: Column, turned: Column) -> Column:
    """The affine transform (a, b, tx, c, d, ty) from stored to looked-at coordinates."""
    w, h = width.cast("double"), height.cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    # a, b, tx, c, d, ty for the orientations 1 to 8
    rows = [(one, zero, zero, zero, one, zero), (-one, zero, w, zero, one, zero), (-one, zero, w, zero, -one, h), (one, zero, zero, zero, -one, h), (zero, one, zero, one, zero, zero), (zero, -one, h, one, zero, zero), (zero, -one, h, -one, zero, w), (zero, one, zero, -one, zero, w)]
    as_struct = lambda r: F.struct(*(v.alias(n) for v, n in zip(r, ("a", "b", "tx", "c", "d", "ty"), strict=True)))
    return F.element_at(F.array(*map(as_struct, rows)), F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce(turned, F.lit(1)))).cast("int"))
