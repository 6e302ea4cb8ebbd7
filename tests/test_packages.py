"""How packages are written, read and dealt: against the standard library's archives, and by the plan."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.operators import package
from pagewright.plans import registry

CHAPTERS = [("One & two", '<h1 id="a">One</h1><p>é</p>'), ("", "<p>2</p>"), ("x" * 300, "<p>y</p>" * 3000)]


def written(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            info = zipfile.ZipInfo(name, package.EPOCH)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


@pytest.mark.parametrize("cover", [None, b"\x89PNG\r\n\x1a\nrest"])
def test_packages_are_written_as_by_the_standard_library(cover, monkeypatch):
    data = package.build("d", "T", CHAPTERS, cover)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and data == written({n: z.read(n) for n in z.namelist()})
    monkeypatch.setattr(package, "_SMALL", (0, 0))
    assert data == package.build("d", "T", CHAPTERS, cover)
    assert package.zipped({}) == written({})


def test_packages_are_read_the_same_member_by_member(monkeypatch):
    data = package.build("d", "T", CHAPTERS)
    other = io.BytesIO(data)
    with zipfile.ZipFile(other, "a") as z:
        z.writestr("late.xhtml", '<a xmlns:x="u" x:href="1" href="2" id="" ONE="3"><b src=""/></a>')
    turned = bytearray(data)
    turned[data.index(b"chapter-0003") + 40] ^= 255
    cases = [data, other.getvalue(), bytes(turned), data + b"x", b"x" + data, data[:-1], data[20:], b"", b"PK\5\6" + bytes(18), None, written({"a.xhtml": b"<a>", "b.css": b"@import"})]
    assert package.plain_members(data) is not None and package.plain_members(data + b"x") is None
    got = [package.read_package(x, 1 << 20, 100) for x in cases]
    monkeypatch.setattr(package, "plain_members", lambda data: None)
    assert got == [package.read_package(x, 1 << 20, 100) for x in cases]
    assert got[1]["refs"][-2:] == [("", "1"), ("late.xhtml", "")]
    assert got[1]["active"] == ["late.xhtml"] and [n for n, _ in got[2]["broken"]] == ["OEBPS/chapter-0003.xhtml"]


def test_small_partitions_are_not_put_together(spark):
    rows = spark.range(400).select((F.col("id") % 100).alias("doc_id"), F.col("id").alias("key"))
    numbered = rows.withColumn("chapter", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")))
    made = package.packages(numbered.select("doc_id", "chapter", F.lit("t").alias("title"), F.lit("<p>1</p>").alias("body")))
    got = made.select("doc_id", "package", F.spark_partition_id().alias("p")).collect()
    assert {r.doc_id: bytes(r.package) for r in got} == {n: package.build(f"doc-{n}", "t", [("t", "<p>1</p>")] * 4) for n in range(100)}
    assert len({r.p for r in got}) >= 8


def test_faults_are_judged_once(spark):
    plan = registry.queries()["V4_package_faults"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x.split("(")[0] and "_contents" in x]


XML = [
    b"", b"<a>", b"<a/>", b"<a/><b/>", b"<a>&nbsp;</a>", b"<!DOCTYPE a><a>&nbsp;</a>", b'<!DOCTYPE a PUBLIC "x" "y.dtd"><a>&nbsp;</a>', b'<!DOCTYPE a PUBLIC "x" "y.dtd"><a href="&nbsp;q"/>',
    b'<!DOCTYPE a [<!ENTITY e "<b id=\'1\' href=\'2\'/>">]><a>&e;&e;</a>', b'<!DOCTYPE a [<!ENTITY e SYSTEM "x">]><a>&e;</a>', b'<!DOCTYPE a [<!ENTITY % p SYSTEM "x"> %p;]><a href="z"/>', b'<!DOCTYPE a [<!ATTLIST a href CDATA "d">]><a/>',
    b'<?xml version="1.0" encoding="cp1252"?><a href="\x80"/>', b'<?xml version="1.0" encoding="shift_jis"?><a/>', b"\xff\xfe<\0a\0/\0>\0", b"<a href='\xff'/>", b"<a>\0</a>", b'<x:a/>', b'<a href="1" href="2"/>',
    b'<x:a xmlns:x="u" x:href="1" href="2" x:id="3"/>', b'<a xmlns:x="u}v" x:ONLOAD="1"><x:script/></a>', b'<?pi?><a><!-- <b id="1"/> --><![CDATA[<b id="2"/>]]></a>', b"<a id='1'><b id='1'/></a>t",
]


@pytest.mark.parametrize("content", XML)
def test_elements_are_those_of_the_standard_librarys_tree(content):
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(content)
    except (ElementTree.ParseError, ValueError):
        assert package.elements(content) is None
        return
    local = lambda name: name.rsplit("}", 1)[-1]
    names, found = package.elements(content)
    assert names == {local(e.tag) for e in root.iter()}
    assert found == [(local(e.tag), {local(k): v for k, v in [*e.attrib.items()][::-1]}) for e in root.iter() if e.attrib]


def test_members_of_all_packages_are_parsed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(package, "expat", type("Seen", (), {"ExpatError": package.expat.ExpatError, "ParserCreate": lambda *a, real=package.expat, **k: seen.append(1) or real.ParserCreate(*a, **k)}))
    both = [package.read_package(package.build(d, "T", [("t", "<p>1</p>")]), 1 << 20, 100) for d in "ab"]
    assert both[0]["roots"] == both[1]["roots"] == [package.OPF] and len(seen) <= 7


def test_texts_are_sorted_once_for_all_windows(spark):
    from pagewright.operators import layout

    blocks = spark.createDataFrame([(1, 0, "p", 1, "a"), (1, 1, "h1", 1, "b"), (1, 2, "p", 2, "c"), (2, 0, "h1", 1, "d"), (2, 5, "h1", 1, "e"), (3, 1, "p", 1, "f"), (3, 2, "h2", 3, "g")], "doc_id long, ord int, tag string, page int, text string")
    got = layout.chapters(blocks)
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window [") and got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.doc_id, r.chapter, r.n_blocks, r.title) for r in got.collect()) == [(1, 0, 1, layout.PAGE_TITLE + "1"), (1, 1, 2, "b"), (2, 0, 1, "d"), (2, 1, 1, "e"), (3, 0, 1, layout.PAGE_TITLE + "1"), (3, 1, 1, "g")]
