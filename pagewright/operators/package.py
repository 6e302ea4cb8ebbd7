"""EPUB packages: built deterministically, one a document, and checked."""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from html import escape
from itertools import accumulate, chain, groupby
from operator import itemgetter
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .html import events

MIMETYPE = "application/epub+zip"
REQUIRED = ("mimetype", "META-INF/container.xml", "OEBPS/content.opf", "OEBPS/nav.xhtml")
CONTAINER, OPF = REQUIRED[1:3]
EPOCH = (1980, 1, 1, 0, 0, 0)
CSS = "body{line-height:1.5}table{border-collapse:collapse}td,th{border:1px solid}.pre-wrap{white-space:pre-wrap}.page-marker{color:gray}"
COVERS = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff"}
#: Elements that run or load something.
ACTIVE = frozenset("script iframe object svg math form button textarea select template".split())
_PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{0}</title><link rel="stylesheet" type="text/css" href="book.css"/></head><body>{1}</body></html>'
_CONTROL = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ufffe\uffff]")
# what a body with a named heading has to hold
_HEADING, _NAMED = re.compile("<h[1-3]", re.I), re.compile(r"id\s*=", re.I)


def plain(text: str) -> str:
    """Text as XML can hold it: control characters out, then markup characters escaped."""
    return escape(_CONTROL.sub("", text))


def headings(body: str) -> list[tuple[int, str, str]]:
    """(level, id, text) of the headings of a chapter's body that have an id."""
    if "=" not in body or not (_HEADING.search(body) and _NAMED.search(body)):
        return []
    out: list[list] = []
    inside = False
    for e in events(body):
        if e.kind == "open" and e.name in ("h1", "h2", "h3"):
            name = dict(e.attrs).get("id")
            inside = bool(name)
            if inside:
                out.append([int(e.name[1]), name, ""])
        elif e.kind == "close" and e.name in ("h1", "h2", "h3"):
            inside = False
        elif e.kind == "text" and inside:
            out[-1][2] += e.name
    return [(level, name, text.strip()) for level, name, text in out]


def contents(chapters: list[tuple[str, str, str]]) -> str:
    """The nested list of (file, title, body) chapters: a chapter's first heading is
    itself, each other one stands under the nearest before it of a lower level."""

    def shown(entries: list[tuple[int, str, str]]) -> str:
        """Entries (level, href, label): the first of a run takes those of a higher level after it."""
        out, at = "", 0
        while at < len(entries):
            level, href, label = entries[at]
            end = next((k for k in range(at + 1, len(entries)) if entries[k][0] <= level), len(entries))
            under = shown(entries[at + 1 : end])
            out += f'<li><a href="{escape(href)}">{plain(label)}</a>{f"<ol>{under}</ol>" if under else ""}</li>'
            at = end
        return out

    every = []
    for name, title, body in chapters:
        found = headings(body)
        every.append((0, name + (f"#{found[0][1]}" if found else ""), title))
        every += [(level, f"{name}#{anchor}", label) for level, anchor, label in found[1:]]
    return f"<ol>{shown(every)}</ol>"


def cover_type(cover: bytes | None) -> str | None:
    return next((k for k, magic in COVERS.items() if cover and cover.startswith(magic)), None)


def build(doc: str, title: str, chapters: list[tuple[str, str]], cover: bytes | None = None, language: str = "und") -> bytes:
    """A package of (title, body XHTML) chapters, with a cover page if there is a PNG or
    JPEG image for it; equal input gives equal bytes."""
    own = [(f"chapter-{i + 1:04d}.xhtml", t, _CONTROL.sub("", body)) for i, (t, body) in enumerate(chapters)]
    kind = cover_type(cover)
    items = [f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, *_) in enumerate(own)]
    spine = [f'<itemref idref="c{i}"/>' for i in range(len(own))]
    files: dict[str, str | bytes] = {}
    if kind:
        image = f"cover.{kind}"
        files = {f"OEBPS/{image}": cover, "OEBPS/cover.xhtml": _PAGE.format(plain(title), f'<section><img src="{image}" alt="{plain(title)}"/></section>')}
        items = [f'<item id="cover-image" href="{image}" media-type="image/{kind}" properties="cover-image"/>', '<item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>', *items]
        spine = ['<itemref idref="cover"/>', *spine]
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{plain(doc)}</dc:identifier><dc:title>{plain(title)}</dc:title><dc:language>{plain(language)}</dc:language><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="book.css" media-type="text/css"/>{"".join(items)}</manifest><spine>{"".join(spine)}</spine></package>'
    )
    files = {
        "mimetype": MIMETYPE,
        "META-INF/container.xml": f'<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{OPF}" media-type="application/oebps-package+xml"/></rootfiles></container>',
        OPF: opf,
        "OEBPS/nav.xhtml": _PAGE.format(plain(title), f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc">{contents(own)}</nav>'),
        "OEBPS/book.css": CSS,
    } | files | {f"OEBPS/{n}": _PAGE.format(plain(t), body) for n, t, body in own}
    return zipped({n: text if isinstance(text, bytes) else text.encode() for n, text in files.items()})


#: Fields of a member's header, of its entry in the directory and of the directory's end.
_HEAD, _ENTRY, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
_DATE = EPOCH[0] - 1980 << 9 | EPOCH[1] << 5 | EPOCH[2]
#: Bytes and members up to which all fields of an archive have 32 or 16 bits.
_SMALL = ((1 << 31) - (1 << 24), 65_000)


@functools.lru_cache(16)
def _fixed(content: bytes) -> bytes:
    return _deflated(content)


def _deflated(content: bytes) -> bytes:
    z = zlib.compressobj(-1, zlib.DEFLATED, -15)
    return z.compress(content) + z.flush()


def zipped(files: dict[str, bytes]) -> bytes:
    """An archive of members with ASCII names, byte for byte what ``zipfile`` writes, which
    takes over where fields need 64 bits; ``mimetype`` is stored, the others are deflated."""
    if sum(map(len, files.values())) > _SMALL[0] or len(files) > _SMALL[1]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in files.items():
                info = zipfile.ZipInfo(name, EPOCH)
                info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
                z.writestr(info, content)
        return out.getvalue()
    parts, entries, at = [], [], 0
    for name, content in files.items():
        own, stored = name.encode("ascii"), name == "mimetype"
        data = content if stored else _fixed(content) if name in _SAME else _deflated(content)
        method, check = 0 if stored else 8, zlib.crc32(content)
        parts += (_HEAD.pack(b"PK\3\4", 20, 0, method, 0, _DATE, check, len(data), len(content), len(own), 0), own, data)
        entries += (_ENTRY.pack(b"PK\1\2", 20 | 3 << 8, 20, 0, method, 0, _DATE, check, len(data), len(content), len(own), 0, 0, 0, 0, 0o600 << 16, at), own)
        at += _HEAD.size + len(own) + len(data)
    return b"".join((*parts, *entries, _END.pack(b"PK\5\6", 0, 0, len(files), len(files), sum(map(len, entries)), at, 0)))


#: Members that are the same in every package.
_SAME = frozenset((CONTAINER, "OEBPS/book.css"))


def preview(title: str, chapters: list[tuple[str, str]]) -> str:
    """The chapters in one page, without anything that has to be loaded."""
    parts = "".join(f'<section id="chapter-{i + 1:03d}">{_CONTROL.sub("", body)}</section>' for i, (_, body) in enumerate(chapters))
    links = "".join(f'<li><a href="#chapter-{i + 1:03d}">{plain(t)}</a></li>' for i, (t, _) in enumerate(chapters))
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{plain(title)}</title><style>{CSS}</style></head><body><nav><ol>{links}</ol></nav>{parts}</body></html>"


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def plain_members(data: bytes) -> dict[str, tuple] | None:
    """name: (deflated, first byte, end, checksum, size) of the members of an archive, if
    they lie one after another with nothing between, before or after them, in the order of
    the directory, under different ASCII names, and nothing is encrypted or has extra fields."""
    if len(data) < _END.size or data[-_END.size :][:4] != b"PK\5\6":
        return None
    _, disk, first, here, n, size, start, comment = _END.unpack_from(data, len(data) - _END.size)
    if disk or first or comment or here != n or n == 0xFFFF or start + size + _END.size != len(data):
        return None
    out: dict[str, tuple] = {}
    at, place = start, 0
    for _ in range(n):
        if at + _ENTRY.size > len(data):
            return None
        sign, _, version, flags, method, _, _, check, packed, whole, named, extra, comment, disk, _, _, offset = _ENTRY.unpack_from(data, at)
        own = data[at + _ENTRY.size : at + _ENTRY.size + named]
        if sign != b"PK\1\2" or version & 255 > 20 or flags or method not in (0, 8) or extra or comment or disk or offset != place or not own.isascii() or b"\0" in own:
            return None
        if place + _HEAD.size + named + packed > start:
            return None
        head = _HEAD.unpack_from(data, place)
        begins = place + _HEAD.size + named
        if head[0] != b"PK\3\4" or head[2] or head[9] != named or head[10] or data[begins - named : begins] != own:
            return None
        at, place = at + _ENTRY.size + named, begins + packed
        out[own.decode("ascii")] = (method == 8, begins, place, check, whole)
    return out if at == start + size and place == start and len(out) == n else None


def _plain_content(data: bytes, deflated: bool, begins: int, end: int, check: int, size: int) -> bytes | None:
    """A member's bytes, or nothing where they aren't as the directory says."""
    content = data[begins:end]
    if deflated:
        z = zlib.decompressobj(-15)
        try:
            content = z.decompress(content, size + 1)
        except zlib.error:
            return None
        if not z.eof or z.unused_data:
            return None
    return content if len(content) == size and zlib.crc32(content) == check else None


@functools.lru_cache(16)
def _short_content(packed: bytes, deflated: bool, check: int, size: int) -> bytes | None:
    return _plain_content(packed, deflated, 0, len(packed), check, size)


def _plain_member(data: bytes, name: str, member: tuple) -> bytes | None:
    deflated, begins, end, check, size = member
    if name in _SAME and end - begins < _SHORT and size < _SHORT:
        return _short_content(data[begins:end], deflated, check, size)
    return _plain_content(data, *member)


def _base(member: str, ref: str) -> str:
    """What a reference is seen from: its file if it leads into it, the file's folder otherwise."""
    return member if ref[:1] in ("", "#", "?") else member.rpartition("/")[0]


def read_package(data: bytes | None, most_bytes: int, most_entries: int) -> dict:
    """The members of an archive, and what its XML files declare and refer to.

    ``items`` (id, href, properties), ``spine`` and ``roots`` are those of the package and
    container files; ``anchors`` (member#id), ``refs`` (what it is seen from, reference; each
    once) and ``active`` (members that run something) those of the pages.  Only the list of
    members is read of an archive that isn't safe to unpack; ``broken`` has what can't be
    read and ``css`` the style sheets that load something.
    """
    out: dict = {k: [] for k in _SHAPE} | {"mimetype": None, "size": len(data or b"")}
    if out["size"] > most_bytes:
        return out
    z, plain = None, plain_members(data or b"")
    if plain is None:
        try:
            z = zipfile.ZipFile(io.BytesIO(data or b""))
        except (zipfile.BadZipFile, ValueError, OSError):
            return out | {"broken": [("", "not_a_zip")]}
        out["members"] = [(i.filename, i.compress_type == zipfile.ZIP_STORED, i.file_size) for i in z.infolist()]
    else:
        out["members"] = [(name, not m[0], m[4]) for name, m in plain.items()]
    if len(out["members"]) > most_entries or sum(m[2] for m in out["members"]) > most_bytes:
        return out
    refs: dict[tuple[str, str], None] = {}
    for name in dict.fromkeys(m[0] for m in out["members"]):
        content = _plain_member(data, name, plain[name]) if plain else None
        if content is None:
            z = z or zipfile.ZipFile(io.BytesIO(data))
            try:
                content = z.read(name)  # checks the sum, too
            except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError, ValueError):  # an offset may be negative
                out["broken"].append((name, "corrupt"))
                continue
        if name == "mimetype":
            out["mimetype"] = content.decode("latin-1")
        elif name.endswith(".css"):
            if _loads(content):
                out["css"].append(name)
        elif name.endswith((".xml", ".opf", ".xhtml")):
            found = _known(content) if name == CONTAINER and len(content) < _SHORT else elements(content)
            if found is None:
                out["broken"].append((name, "invalid_xml"))
            elif name in (OPF, CONTAINER):
                _declared(name, found[1], out)
            elif name.endswith(".xhtml"):
                _referred(name, *found, out, refs)
    return out | {"refs": list(refs)}


def elements(content: bytes) -> tuple[frozenset[str], list[tuple[str, dict[str, str]]]] | None:
    """The local names of an XML file's elements, and (local name, attributes) of those that
    have any, in their order; nothing where it isn't well-formed or has an entity from elsewhere."""
    parser, names, found = expat.ParserCreate(namespace_separator="}"), set(), []

    def begins(name: str, attributes: dict[str, str]) -> None:
        names.add(name)
        if attributes:
            found.append((name, attributes))

    parser.StartElementHandler, parser.SkippedEntityHandler, parser.ExternalEntityRefHandler = begins, _elsewhere, lambda *_: 0
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, ValueError, LookupError):  # the latter two by encodings
        return None
    finally:  # it refers to itself by what it calls
        parser.StartElementHandler = parser.SkippedEntityHandler = parser.ExternalEntityRefHandler = None
    local = {name: _local(name) for name in names}
    return frozenset(local.values()), [(local[name], _attributes(a)) for name, a in found]


def _elsewhere(name: str, parameter: bool) -> None:
    if not parameter:
        raise ValueError(name)


def _attributes(own: dict[str, str]) -> dict[str, str]:
    """By local names; of equal ones the first counts."""
    if "}" not in "".join(own):
        return own
    found: dict[str, str] = {}
    for k, v in own.items():
        found.setdefault(_local(k), v)
    return found


def _declared(name: str, found: list[tuple[str, dict[str, str]]], out: dict) -> None:
    for tag, a in found:
        if name == CONTAINER and tag == "rootfile":
            out["roots"].append(a.get("full-path", ""))
        elif name == OPF and tag == "item":
            out["items"].append((a.get("id", ""), a.get("href", ""), a.get("properties", "")))
        elif name == OPF and tag == "itemref":
            out["spine"].append(a.get("idref", ""))


def _referred(name: str, tags: frozenset[str], found: list[tuple[str, dict[str, str]]], out: dict, refs: dict[tuple[str, str], None]) -> None:
    active = not tags.isdisjoint(ACTIVE)
    for _, a in found:
        active = active or any(k[:2].lower() == "on" for k in a)
        if a.get("id"):
            out["anchors"].append(f"{name}#{a['id']}")
        for k in ("href", "src"):
            if k in a:
                refs[_base(name, a[k]), a[k]] = None
    if active:
        out["active"].append(name)


_LOADS = re.compile(rb"@import|\burl\s*\(", re.I)
#: Bytes up to which what was found in members that are mostly the same is kept for the next package.
_SHORT = 1 << 14
_known = functools.lru_cache(16)(elements)


@functools.lru_cache(16)
def _short_loads(content: bytes) -> bool:
    return bool(_LOADS.search(content))


def _loads(content: bytes) -> bool:
    return _short_loads(content) if len(content) < _SHORT else bool(_LOADS.search(content))


_CONTENTS = "struct<size:long,mimetype:string,members:array<struct<name:string,stored:boolean,bytes:long>>,items:array<struct<id:string,href:string,properties:string>>,spine:array<string>,roots:array<string>,anchors:array<string>,refs:array<struct<base:string,ref:string>>,active:array<string>,broken:array<struct<member:string,why:string>>,css:array<string>>"


def safe_path(name: Column) -> Column:
    """A path that stays where it is unpacked: relative, no drive, no step up, nothing empty."""
    return (name != "") & ~name.startswith("/") & ~F.contains(name, F.lit("\\")) & ~F.contains(name, F.lit(":")) & ~F.rtrim(name, F.lit("/")).rlike(r"(^|/)(\.{1,2})?(/|$)")


def resolved(folder: Column, path: Column) -> Column:
    """A relative path as seen from a folder, its steps taken; steps up beyond the top stay."""
    up = F.lit("..")

    def step(acc: Column, part: Column) -> Column:
        above = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == up)
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part.isin("", "."), acc).when((part == up) & ~above, shorter).otherwise(F.array_append(acc, part))

    whole = F.when((folder == "") | path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    joined = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    # most have no step that is empty or made of dots
    return F.when(~whole.rlike(r"(^|/)\.{0,2}(/|$)"), whole).when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def package_faults(packages: DataFrame, contents: str, most_bytes: int = 100 << 20, most_entries: int = 1000) -> DataFrame:
    """``packages`` with errors (array<string>) in place of ``contents``, as ``read_package`` gives them.

    Sets of names are compared: required against there, declared against there,
    spine against manifest, references against members and anchors.  If an archive's
    size, number of members or paths aren't safe, that is all that is told.  What is
    compared with each element is a column of its own, so it is made once a package.
    """
    c, columns = F.col(contents), [x for x in packages.columns if x != contents]
    none = F.array().cast("array<string>")
    said = lambda word, names: F.transform(names, lambda n: F.concat(F.lit(f"{word}: "), n))
    told = lambda word, bad: F.array_compact(F.array(F.when(bad, F.lit(word))))
    repeated = lambda xs: F.size(F.array_distinct(xs)) < F.size(xs)
    broken = lambda why: F.transform(F.filter(c["broken"], lambda b: b["why"] == why), lambda b: b["member"])
    item = lambda i: F.struct(i["id"], i["href"], resolved(F.lit(OPF.rpartition("/")[0]), i["href"]).alias("path"), F.split(i["properties"], r"\s+").alias("properties"))
    rows = packages.withColumns(
        {
            "_listed": F.transform(c["members"], lambda m: m["name"]),
            "_bytes": F.aggregate(c["members"], F.lit(0).cast("long"), lambda acc, m: acc + m["bytes"]),
            "_torn": broken("corrupt"),
            "_unparsed": broken("invalid_xml"),
            "_zip": F.size(broken("not_a_zip")) == 0,
            "_items": F.transform(c["items"], item),
            "_spine": c["spine"],
            "_roots": c["roots"],
            "_anchors": c["anchors"],
            "_refs": F.transform(c["refs"], lambda r: F.struct(r["base"], r["ref"], r["ref"].rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)").alias("outside"), F.regexp_extract(r["ref"], "^[^?#]*", 0).alias("path"))),
            "_active": c["active"],
            "_first": F.get(c["members"], F.lit(0)),
            "_size": c["size"],
            "_css": c["css"],
            "_mimetype": c["mimetype"],
        }
    )
    # the members and anchors that the references of a package's pages to itself lead to
    rows = rows.withColumn("_names", F.array_distinct("_listed")).drop(contents)
    place = lambda r: F.struct(F.when(r["path"] == "", r["base"]).otherwise(resolved(r["base"], r["path"])).alias("path"), F.regexp_extract(r["ref"], "#(.*)$", 1).alias("anchor"))
    rows = rows.withColumn("_local", F.transform(F.filter("_refs", lambda r: ~r["outside"]), place))
    rows = rows.withColumn("_absent", F.array_except(F.transform("_local", lambda r: r["path"]), F.col("_names")))

    names, unparsed = F.col("_names"), F.col("_unparsed")
    readable = (F.col("_size") <= most_bytes) & F.col("_zip")
    outer = F.concat(
        told("too_large", F.col("_size") > most_bytes),
        told("not_a_zip", ~F.col("_zip")),
        told("empty", readable & (F.size("_listed") == 0)),
        told("too_many_entries", F.size("_listed") > most_entries),
        told("duplicate_names", repeated(F.col("_listed"))),
        told("too_large_unpacked", F.col("_bytes") > most_bytes),
        said("unsafe_path", F.filter(names, lambda n: ~safe_path(n))),
    )
    parsed = lambda member: F.array_contains(names, member) & ~F.array_contains(unparsed, member)
    ids, declared = F.transform("_items", lambda i: i["id"]), F.transform("_items", lambda i: i["path"])
    whole = lambda i: (i["id"] != "") & (i["href"] != "") & safe_path(i["path"])
    fixed = F.array(*map(F.lit, ("mimetype", CONTAINER, OPF)))
    manifest = F.concat(
        told("duplicate_ids", repeated(ids)),
        said("manifest_item", F.transform(F.filter("_items", lambda i: ~whole(i)), lambda i: F.when(i["id"] == "", "?").otherwise(i["id"]))),
        said("declared_missing", F.array_except(F.transform(F.filter("_items", whole), lambda i: i["path"]), names)),
        said("spine", F.array_except(F.col("_spine"), ids)),
        said("undeclared", F.array_sort(F.array_except(names, F.concat(declared, fixed)))),
        told("no_nav", ~F.exists("_items", lambda i: F.array_contains(i["properties"], "nav"))),
    )
    # how often an anchor stands in a sorted list shows where its neighbour is the same
    again = F.transform(F.filter(F.arrays_zip(F.array_sort("_anchors").alias("a"), F.slice(F.array_sort("_anchors"), 2, 1 << 30).alias("b")), lambda p: p["a"] == p["b"]), lambda p: F.substring_index(p["a"], "#", 1))
    led = F.filter("_local", lambda r: (r["anchor"] != "") & ~F.array_contains("_absent", r["path"]))
    documents = F.concat(
        said("duplicate_anchors", F.array_distinct(again)),
        said("active_content", F.col("_active")),
        said("external", F.array_distinct(F.transform(F.filter("_refs", lambda r: r["outside"]), lambda r: r["ref"]))),
        said("missing_reference", F.col("_absent")),
        said("missing_fragment", F.array_except(F.transform(led, lambda r: F.concat(r["path"], F.lit("#"), r["anchor"])), F.col("_anchors"))),
    )
    inner = F.concat(
        said("corrupt", F.col("_torn")),
        said("missing", F.array_except(F.array(*map(F.lit, REQUIRED)), names)),
        told("mimetype_not_first_and_stored", ~((F.col("_first.name") == "mimetype") & F.col("_first.stored"))),
        told("mimetype_content", F.array_contains(names, "mimetype") & ~F.col("_mimetype").eqNullSafe(F.lit(MIMETYPE))),
        said("unsafe_css", F.col("_css")),
        said("invalid_xml", unparsed),
        F.when(parsed(OPF), manifest).otherwise(none),
        told("container_rootfile", parsed(CONTAINER) & (F.col("_roots") != F.array(F.lit(OPF)))),
        documents,
    )
    return rows.select(*(F.col(f"`{x}`") for x in columns), F.when(F.size(outer) > 0, outer).otherwise(inner).alias("errors"))


def package_errors(files: DataFrame, column: str = "content", most_bytes: int = 100 << 20, most_entries: int = 1000) -> DataFrame:
    """``files`` with errors (array<string>) in place of the packages in ``column``."""
    others = [f for f in files.columns if f != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(contents)
        for b in batches:
            packages, rows, begun, size = b.column(len(others)), [], 0, 0
            for i, x in enumerate(packages):
                rows.append(read_package(x.as_py(), most_bytes, most_entries))
                size += rows[-1]["size"]
                if size > TOGETHER or i + 1 == len(packages):
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(begun, i + 1 - begun) for k in range(len(others))), _columnar(rows, kind)], [*others, "_contents"])
                    rows, begun, size = [], i + 1, 0

    contents = StructType.fromDDL(f"c {_CONTENTS}")["c"].dataType
    rows = files.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{column}`"))
    schema = StructType([*(files.schema[c] for c in others), StructField("_contents", contents)])
    return package_faults(rows.mapInArrow(run, schema), "_contents", most_bytes, most_entries)


#: Bytes of packages whose contents are handed on together.
TOGETHER = 1 << 20
_SHAPE = ("size", "mimetype", "members", "items", "spine", "roots", "anchors", "refs", "active", "broken", "css")


def _columnar(rows: list[dict], kind: pa.StructType) -> pa.StructArray:
    """What was read of packages, field by field; lists of tuples as flat columns with offsets."""

    def column(field: pa.Field) -> pa.Array:
        own, t = [r[field.name] for r in rows], field.type
        if not (pa.types.is_list(t) and pa.types.is_struct(t.value_type)):
            return pa.array(own, t)
        flat = list(zip(*chain.from_iterable(own), strict=True)) or [()] * t.value_type.num_fields
        values = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, t.value_type, strict=True)], fields=list(t.value_type))
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, own))], pa.int32()), values, type=t)

    return pa.StructArray.from_arrays([column(f) for f in kind], fields=list(kind))


def missing_files(names: DataFrame) -> DataFrame:
    """package_id, name: the required files that packages (package_id, name) lack."""
    required = names.select("package_id").distinct().select("package_id", F.explode(F.array(*map(F.lit, REQUIRED))).alias("name"))
    return required.join(names, ["package_id", "name"], "left_anti")


def packages(chapters: DataFrame) -> DataFrame:
    """doc_id, package of chapters(doc_id, chapter, title, body), a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, made, size = [], [], 0
        pieces = (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256))
        rows = (row for p in pieces for row in zip(*(p.column(k).to_pylist() for k in range(4)), strict=True))
        for doc, own in groupby(rows, key=itemgetter(0)):
            chapters = sorted(row[1:] for row in own)
            docs.append(doc)
            made.append(build(f"doc-{doc}", chapters[0][1], [row[1:] for row in chapters]))
            size += len(made[-1])
            if size > TOGETHER:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "package"])
                docs, made, size = [], [], 0
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "package"])

    # building costs more than bytes tell, so small partitions mustn't be put together: dealt by
    # a number of its own, as a repartition by doc_id is left out where rows already lie by it
    spark = chapters.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = chapters.select(F.col("doc_id").cast("long").alias("doc_id"), "chapter", "title", "body", F.xxhash64("doc_id").alias("_deal")).repartition(parts, "_deal").drop("_deal")
    return dealt.sortWithinPartitions("doc_id").mapInArrow(run, "doc_id long, package binary")
