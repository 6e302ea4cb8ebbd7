"""File structures and pixels: hand-made files of each kind, damaged ones, and brute force."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import geometry, layout
from pagewright.sources import files, raster
from pagewright.sources import structure as S


def pdf(pages=3, locked=False, packed=False, kids=2, table=True):
    """A PDF with a page tree of ``kids`` children a node, its objects plain or in an object stream."""
    objects, todo, number = {}, [], 3
    for _ in range(pages):
        objects[number] = b"<< /Type /Page /Resources << /Font << /F << /Type /Font >> >> >> /Note (a \\) (b >>) [) >>"
        todo.append(number)
        number += 1
    while len(todo) > kids:
        level, todo = todo, []
        for i in range(0, len(level), kids):
            objects[number] = b"<< /Kids [%s] /Type /Pages >>" % b" ".join(b"%d 0 R" % k for k in level[i : i + kids])
            todo.append(number)
            number += 1
    objects[2] = b"<< /Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(b"%d 0 R" % k for k in todo), pages)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    out = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"]
    if packed:
        head, body = b"", b""
        for n, o in objects.items():
            head += b"%d %d " % (n, len(body))
            body += o + b" "
        z = zlib.compress(head + body)
        out.append(b"900 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(objects), len(head), len(z), z))
        out.append(b"901 0 obj << /Type /XRef /Root 1 0 R %s /W [1 2 1] /Length 3 >> stream\nabc\nendstream endobj\n" % (b"/Encrypt 9 0 R" if locked else b""))
    else:
        out += [b"%d 0 obj %s endobj\n" % (n, o) for n, o in objects.items()]
        out.append(b"800 0 obj << /Length 801 0 R >> stream\n7 0 obj << /Type /Page >> endobj\nendstream endobj\n")
        if table:
            out.append(b"trailer << /Root 1 0 R %s >>\n" % (b"/Encrypt << /Filter /Standard >>" if locked else b""))
    return b"".join(out) + b"startxref\n0\n%%EOF"


def exif(orientation, order="<"):
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HIHHHIHHHHIHHI", 42, 8, 2, 0x0100, 3, 1, 7, 0, 0x0112, 3, 1, orientation, 0, 0)


def jpeg(width=6, height=4, orientation=None, order="<", end=True):
    seg = lambda code, body: bytes([0xFF, code]) + (len(body) + 2).to_bytes(2) + body
    out = b"\xff\xd8" + (seg(0xE1, b"Exif\0\0" + exif(orientation, order)) if orientation else seg(0xE0, b"JFIF\0"))
    out += seg(0xC0, bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([1, 1, 0x11, 0]))
    return out + seg(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\x00\x34\xff\xd0\x56" + (b"\xff\xd9" if end else b"")


def chunk(name, body):
    return len(body).to_bytes(4) + name + body + zlib.crc32(name + body).to_bytes(4)


IMAGE = np.random.default_rng(1).integers(0, 256, (13, 11, 3), dtype=np.uint8)
PNG = raster.written(IMAGE)


def with_chunk(png, extra):
    return png[:33] + extra + png[33:]


def test_pdf_pages():
    for n in (0, 1, 3, 9):
        for packed in (False, True):
            assert S.described(pdf(n, packed=packed)) == {"pages": n, "width": None, "height": None, "orientation": None, "locked": False, "fault": None}
    assert S.described(pdf(5, table=False))["pages"] == 5  # no trailer: the catalogue is found
    assert S.described(pdf(2, locked=True))["locked"] and S.described(pdf(2, locked=True, packed=True))["locked"]
    changed = pdf(4) + b"\n2 0 obj << /Type /Pages /Kids [3 0 R 2 0 R 3 0 R 99 0 R] >> endobj"
    assert S.described(changed)["pages"] == 1  # the last definition counts; cycles and missing objects don't
    for bad in (b"%PDF-1.4 nothing", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj", pdf(3)[:60]):
        assert S.described(bad)["fault"] == "damaged_pdf"


def test_images():
    assert S.described(PNG) == {"pages": 1, "width": 11, "height": 13, "orientation": 1, "locked": False, "fault": None}
    flipped = bytearray(PNG)
    flipped[50] ^= 1
    no_end, short = PNG[:-12], raster.S.PNG + chunk(b"IHDR", (5).to_bytes(4) * 2 + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0" * 29)) + chunk(b"IEND", b"")
    for bad in (bytes(flipped), no_end, PNG[:40], short, S.PNG):
        assert S.described(bad)["fault"] == "damaged_image"
    assert S.described(with_chunk(PNG, chunk(b"eXIf", exif(6))))["orientation"] == 6
    assert S.described(jpeg()) == {"pages": 1, "width": 6, "height": 4, "orientation": 1, "locked": False, "fault": None}
    assert [S.described(jpeg(orientation=o, order=e))["orientation"] for o in (1, 3, 8, 9) for e in "<>"] == [1, 1, 3, 3, 8, 8, 1, 1]
    assert S.described(jpeg(end=False))["fault"] == S.described(jpeg()[:30])["fault"] == "damaged_image"
    assert S.described(jpeg(width=0))["fault"] == "no_area"
    assert S.described(b"GIF89a")["fault"] == S.described(b"")["fault"] == "unsupported_type"


def test_parts_as_rows(spark):
    made = spark.createDataFrame([("a", PNG), ("b", jpeg(orientation=6)), ("c", pdf(2)), ("d", b""), ("e", None)], "path string, content binary")
    got = S.file_parts(made).collect()
    of = lambda p: [r.kind for r in sorted((r for r in got if r.path == p), key=lambda r: r.seq)]
    assert of("a") == ["chunk IHDR", "chunk IDAT", "chunk IEND", "pixels"]
    assert of("b") == ["marker E1", "marker C0", "marker DA", "scan", "marker D9"]
    assert of("c") == ["object Page", "object Page", "object Pages", "object Catalog", "object", "trailer"] and not of("d") and not of("e")
    assert all(r.ok for r in got)


def test_validation(spark):
    rows = [("pdf", pdf(4)), ("locked", pdf(1, locked=True)), ("broken", b"%PDF-1.4 x"), ("png", PNG), ("cut", PNG[:50]), ("jpeg", jpeg(orientation=8)), ("text", b"hello"), ("empty", b""), ("none", None)]
    got = {r.path: r for r in files.validated_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {p: r.error for p, r in got.items()} == {"pdf": None, "locked": "encrypted", "broken": "damaged_pdf", "png": None, "cut": "damaged_image", "jpeg": None, "text": "unsupported_type", "empty": "empty", "none": "missing"}
    assert {p: r.page_count for p, r in got.items() if r.valid} == {"pdf": 4, "png": 1, "jpeg": 1}
    assert (got["jpeg"].width, got["jpeg"].height) == (4, 6)  # as it is looked at


def test_raster_is_page_one(spark):
    checked = files.validated_files(spark.createDataFrame([("a", PNG), ("b", jpeg(orientation=5)), ("c", pdf(3))], "path string, content binary"))
    numbered = lambda *a, **k: sorted((r.path, r.page_id) for r in files.file_pages(checked, *a, **k).collect() if r.page_id)
    assert numbered() == [("a", 1), ("b", 1), ("c", 1), ("c", 2), ("c", 3)]
    assert numbered(2, 9) == [("c", 2), ("c", 3)] and numbered(only=[1, 3]) == [("a", 1), ("b", 1), ("c", 1), ("c", 3)]
    status = {r.path: (r.status, r.total_pages, r.processed_pages) for r in files.page_totals(checked, 2, 9).collect()}
    assert status == {"a": ("completed", 1, 0), "b": ("completed", 1, 0), "c": ("completed", 3, 2)}


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)])
def test_filters(filters):
    want = ((IMAGE.astype(int) @ [19595, 38470, 7471] + 0x8000) >> 16).astype(np.uint8)
    assert (raster.luminance(raster.written(IMAGE, filters)) == want).all()
    gray = IMAGE[:, :, 0]
    assert (raster.luminance(raster.written(gray, filters)) == gray).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("colour", [0, 3, 4])
@pytest.mark.parametrize("interlaced", [0, 1])
def test_depths_palettes_and_interlacing(depth, colour, interlaced):
    if colour == 3 and depth == 16 or colour == 4 and depth < 8:
        return
    rng = np.random.default_rng(depth)
    h, w, per = 9, 13, S.SAMPLES[colour]
    v = rng.integers(0, 2**depth, (h, w, per))
    raw = b""
    for x0, y0, dx, dy, pw, ph in S.png_passes(w, h, interlaced):
        for line in v[y0::dy, x0::dx].reshape(ph, pw * per):
            bits = "".join(f"{x:0{depth}b}" for x in line)
            raw += b"\0" + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    table = rng.integers(0, 256, (256, 3), dtype=np.uint8)
    png = S.PNG + chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + bytes([depth, colour, 0, 0, interlaced])) + chunk(b"PLTE", table.tobytes()) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert S.described(png)["fault"] is None
    first = v[:, :, 0]
    if colour == 3:
        want = (table[first].astype(int) @ [19595, 38470, 7471] + 0x8000) >> 16
    else:
        want = first >> 8 if depth == 16 else first * (255 // (2**depth - 1))
    assert (raster.luminance(png) == want).all()


def test_orientations_turn_images_and_boxes_alike(spark):
    """The eight matrices against turning the pixels themselves."""
    image = np.full((7, 5), 255, np.uint8)
    image[1:3, 2:5] = 0  # rows 1-2, columns 2-4
    rows = [(o, with_chunk(raster.written(image), chunk(b"eXIf", exif(o)))) for o in range(1, 9)]
    docs = spark.createDataFrame(rows, "page_id long, content binary")
    seen = {r.page_id: r for r in raster.rasters(docs).collect()}
    m = S.orienting(F.lit(5), F.lit(7), F.col("page_id"))
    corner = lambda x, y: geometry.applied(m, F.lit(float(x)), F.lit(float(y)))
    for r in docs.select("page_id", corner(2, 1).alias("a"), corner(5, 3).alias("b"), S.oriented_size(F.lit(5), F.lit(7), F.col("page_id")).alias("s")).collect():
        got = seen[r.page_id]
        assert (got.width, got.height) == (r.s.width, r.s.height)
        box = (min(r.a.x, r.b.x), min(r.a.y, r.b.y), max(r.a.x, r.b.x), max(r.a.y, r.b.y))
        dark = [(x, run.line) for run in got.rows for x in range(run.first, run.last + 1)]
        assert box == (min(x for x, _ in dark), min(y for _, y in dark), max(x for x, _ in dark) + 1, max(y for _, y in dark) + 1)


def brute_grid(image):
    height, width = image.shape
    dark = image < raster.DARK

    def longest(values):
        runs, last, begun = 0, None, 0
        for i in np.flatnonzero(values):
            if last is None or i - last > 3:
                begun = i
            last = i
            runs = max(runs, i - begun + 1)
        return runs

    def clusters(at):
        groups = []
        for v in at:
            if groups and v - groups[-1][-1] <= 4:
                groups[-1].append(v)
            else:
                groups.append([v])
        return [round(sum(g) / len(g)) for g in groups]

    ys = clusters([y for y in range(height) if longest(dark[y]) >= 0.18 * width])
    xs = clusters([x for x in range(width) if longest(dark[:, x]) >= 0.05 * height])
    if min(len(xs), len(ys)) < 3:
        return []
    hit = lambda x, y: dark[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any()
    ys = [y for y in ys if sum(hit(x, y) for x in xs) >= 0.7 * len(xs)]
    xs = [x for x in xs if sum(hit(x, y) for y in ys) >= 0.7 * len(ys)]
    if min(len(xs), len(ys)) < 3:
        return []
    return sorted((r, c, xs[c], ys[r], xs[c + 1], ys[r + 1]) for r in range(len(ys) - 1) for c in range(len(xs) - 1))


def test_grids_of_images_against_brute_force(spark):
    rng = random.Random(2)
    images = []
    for i in range(25):
        h, w = rng.randrange(60, 140), rng.randrange(60, 140)
        image = np.full((h, w), 255, np.uint8)
        for _ in range(rng.randrange(2, 7)):
            y, x0 = rng.randrange(h), rng.randrange(w // 3)
            image[y : y + rng.randrange(1, 4), x0 : w - rng.randrange(w // 3)] = rng.choice((0, 120, 200))
            x, y0 = rng.randrange(w), rng.randrange(h // 3)
            image[y0 : h - rng.randrange(h // 3), x : x + rng.randrange(1, 3)] = 0
        if i % 3 == 0:  # gaps and specks
            image[:, :: rng.randrange(5, 9)] = 255
            image[rng.randrange(h), rng.randrange(w)] = 0
        images.append(image)
    docs = spark.createDataFrame([(i, raster.written(x)) for i, x in enumerate(images)], "page_id long, content binary")
    seen = raster.rasters(docs)
    cells = layout.grid_cells(seen).collect()
    # the longest run of each row as by the table of runs
    by_table = {(r.page_id, r.line): r.longest for r in geometry.longest_runs(raster.runs_of(seen, "rows")).collect()}
    by_page = {(r.page_id, x.line): x.longest for r in seen.select("page_id", layout._longest_by_line(F.col("rows")).alias("x")).collect() for x in r.x}
    assert by_page == by_table
    got = {i: sorted((r.row_index, r.column_index, r.x0, r.y0, r.x1, r.y1) for r in cells if r.page_id == i) for i in range(len(images))}
    assert got == {i: brute_grid(x) for i, x in enumerate(images)}
    assert sum(bool(x) for x in got.values()) >= 5


def test_blank_pages_from_pixels(spark):
    flat, speck, text = np.full((40, 40), 250, np.uint8), np.full((40, 40), 250, np.uint8), np.full((40, 40), 250, np.uint8)
    speck[3, 3], text[10:20, 5:30] = 240, 0
    docs = spark.createDataFrame([(i, raster.written(x)) for i, x in enumerate((flat, speck, text))] + [(3, PNG[:60]), (4, None)], "page_id long, content binary")
    got = raster.rasters(docs).select("page_id", T.visually_blank(F.col("low"), F.col("high"), F.col("variance")).alias("b"), "width").collect()
    assert {r.page_id: r.b for r in got if r.width} == {0: True, 1: True, 2: False} and {r.page_id for r in got if r.width is None} == {3, 4}
