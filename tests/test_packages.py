"""Packages filled and read again, what is refused, and a compound file built by hand."""

import struct
import zipfile
import zlib

import pytest

from formloom.sources import compound, markup, packages
from formloom.sources import containers as C

DOC = '<w:p><w:r><w:t>Dear {{na</w:t></w:r><w:r><w:t a="1>2">me}}, &lt;{{x}}&gt;</w:t><w:br/></w:r></w:p><w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t a="1">as it is &#65;</w:t><w:tab/></w:r></w:p>'


def docx(body, **more):
    parts, _ = C.open_archive(packages.simple_package([], "docx", body))
    return C.write_archive([*parts, *((k.replace("__", "/").replace("_xml", ".xml"), v) for k, v in more.items())])


def texts(content, form):
    return [p.text for _, _, ps in packages.field_parts(C.open_package(content, form), form) for p in ps]


def test_fill_across_runs():
    content = docx(DOC, word__styles_xml=b"<a/>")
    out, error = packages.fill_package(content, {"name": "x & co\ttab", "x": "1\r\n2"}, "docx")
    assert error is None and texts(out, "docx") == ["Dear x & co\ttab, <1\n2>\n", "as it is A\t"]
    before, after = dict(C.open_archive(content)[0]), dict(C.open_archive(out)[0])
    assert {k for k in before if before[k] != after[k]} == {"word/document.xml"}
    # the second paragraph keeps every byte
    assert after["word/document.xml"].endswith(DOC[DOC.index("</w:p>") :].encode() + b"</w:body></w:document>")


FLOW = '<w:p w14:paraId="1" w:rsidR="2" xmlns:w14="v"><w:pPr><w:pStyle w:val="a"/><w:jc w:val="left"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>To {{x}} and {{</w:t></w:r><w:r><w:t>y}}.</w:t><w:br/></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p>'
CELL = '<w:tbl><w:tr><w:trPr><w:trHeight w:val="9" w:hRule="exact"/></w:trPr><w:tc><w:p><w:pPr/><w:r><w:t>{{x}}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{{y}}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'


def test_flow():
    out, error = packages.fill_package(docx(FLOW), {"x": "1\r\n2\t3", "y": "a\nb"}, "docx", flow=True)
    assert error is None and texts(out, "docx") == ["To 1", "2\t3 and a", "b.\n", "end"]
    body = dict(C.open_archive(out)[0])["word/document.xml"].decode()
    assert body.count("w14:paraId") == 1 and body.count('w:rsidR="2"') == 3 and body.count("<w:b/>") == 3
    assert body.count('<w:pStyle w:val="a"/><w:keepNext w:val="0"/><w:keepLines w:val="0"/><w:pageBreakBefore w:val="0"/><w:jc w:val="left"/>') == 2
    out, error = packages.fill_package(docx(CELL), {"x": "1", "y": "2\n3"}, "docx", flow=True)
    assert error is None and texts(out, "docx") == ["1", "2", "3"]
    body = dict(C.open_archive(out)[0])["word/document.xml"].decode()
    assert '<w:trPr><w:cantSplit w:val="0"/><w:trHeight w:val="9" w:hRule="atLeast"/></w:trPr>' in body and '<w:pPr><w:keepNext w:val="0"/><w:keepLines w:val="0"/></w:pPr>' in body
    nested = CELL.replace("<w:tc><w:p>", f"<w:tc>{CELL}<w:p>", 1)
    bad = [FLOW.replace("<w:jc ", '<w:numPr/><w:jc '), FLOW.replace("<w:br/>", "<w:drawing/>"), f"<w:sdt>{FLOW}</w:sdt>", nested]
    assert [packages.fill_package(docx(b), {"x": "1\n2", "y": "3"}, "docx", flow=True)[1] for b in bad] == ["E_LAYOUT"] * 4
    assert packages.fill_package(packages.simple_package(["{{x}}"], "hwpx"), {"x": "1"}, "hwpx", flow=True) == (None, "E_LAYOUT")


def test_fields():
    rows = packages.field_parts(C.open_package(docx(DOC), "docx"), "docx")
    assert [[(f["name"], f["start"], f["stop"]) for f in p.fields] for p in rows[-1][2]] == [[("name", 5, 13), ("x", 16, 21)], []]


P = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"


@pytest.mark.parametrize(
    "content, values, code",
    [
        (docx(P("{{x}}")), {}, "E_FIELDS"),
        (docx(P("{{x}}")), {"x": "1", "y": "2"}, "E_FIELDS"),
        (docx(P("{{x}}")), {"x": "\x01"}, "E_FIELDS"),
        (docx(P("none")), {}, "E_FIELDS"),
        (docx(P("{{x")), {"x": "1"}, "E_FIELDS"),
        (docx(P("{{1 a}}")), {"1 a": "1"}, "E_UNSUPPORTED"),
        (docx("<w:p><w:r><w:t>{{x</w:t></w:r></w:p><w:p><w:r><w:t>}}</w:t></w:r></w:p>"), {"x": "1"}, "E_FIELDS"),
        (docx("<w:p><w:r><w:x>{{x}}</w:x></w:r></w:p>"), {"x": "1"}, "E_UNSUPPORTED"),
        (docx(P("{{x}}"), word__other_xml=b"<a>{{z}}</a>"), {"x": "1"}, "E_UNSUPPORTED"),
        (docx(P("{{x}}") + "<w:p>"), {"x": "1"}, "E_INPUT"),
        (docx(P("{{x}}"), word__vba_xml=b"<!-- " + b"x" * 6000 + b"--><!DocType a><a/>"), {"x": "1"}, "E_UNSUPPORTED"),
        (docx(P("{{x}}"), word__wide_xml='<?xml version="1.0" encoding="utf-16"?><!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'.encode("utf-16")), {"x": "1"}, "E_UNSUPPORTED"),
        (C.write_archive([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", b"<a/>")]), {}, "E_UNSUPPORTED"),
        (C.write_archive([("word/document.xml", b"<a/>")]), {}, "E_INPUT"),
        (b"", {}, "E_INPUT"),
        (None, {}, "E_INPUT"),
    ],
)
def test_refusals(content, values, code):
    assert packages.fill_package(content, values, "docx") == (None, code)


def archive(name=b"a.xml", body=b"<a/>", **change):
    """One stored entry, with fields of its headers changed."""
    x = {"flags": 0, "method": 0, "crc": zlib.crc32(body), "stored": len(body), "size": len(body), "local": name, "count": 1, "disk": 0, "comment": b""} | change
    head = C.LOCAL.pack(b"PK\3\4", 20, x["flags"], x["method"], 0, 0, x["crc"], x["stored"], x["size"], len(x["local"]), 0) + x["local"] + body
    entry = C.CENTRAL.pack(b"PK\1\2", 20, 20, x["flags"], x["method"], 0, 0, x["crc"], x["stored"], x["size"], len(name), 0, 0, 0, 0, 0, 0) + name
    return head + entry + C.END.pack(b"PK\5\6", x["disk"], x["disk"], x["count"], x["count"], len(entry), len(head), len(x["comment"])) + x["comment"]


def test_directory():
    assert C.open_archive(archive()) == ([("a.xml", b"<a/>")], None)
    assert C.open_archive(archive(comment=b"PK\5\6 here")) == ([("a.xml", b"<a/>")], None)
    bomb = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = bomb.compress(bytes(1 << 20)) + bomb.flush()
    codes = [C.open_archive(a)[1] for a in (archive(crc=1), archive(size=5), archive(flags=1), archive(method=9), archive(local=b"b.xml"), archive(count=2), archive(disk=1), archive(name=b"../a", local=b"../a"), archive(name=b"C:a", local=b"C:a"), archive(name=b"word/VBAproject.bin", local=b"word/VBAproject.bin"), archive(body=packed, method=8, size=9), archive()[:-1], archive() + b"x")]
    assert codes == ["E_INPUT", "E_INPUT", "E_UNSUPPORTED", "E_UNSUPPORTED", "E_INPUT", "E_INPUT", "E_UNSUPPORTED", "E_INPUT", "E_INPUT", "E_UNSUPPORTED", "E_INPUT", "E_INPUT", "E_INPUT"]
    twice = C.write_archive([("a", b"1"), ("b", b"2")]).replace(b"b", b"a")
    assert C.open_archive(twice)[1] == "E_INPUT"


HP = '<hp:p id="1"><hp:run><hp:ctrl><hp:fieldBegin id="7" type="CLICK_HERE" name="who"/></hp:ctrl><hp:t>fill</hp:t><hp:t> in</hp:t><hp:ctrl><hp:fieldEnd beginIDRef="7"/></hp:ctrl><hp:t> and {{x}}</hp:t></hp:run><hp:linesegarray><hp:lineseg/></hp:linesegarray></hp:p>'


def test_click_here():
    content = packages.simple_package([], "hwpx", HP + "<hp:p><hp:run><hp:t>a<hp:lineBreak/>b<hp:tab/></hp:t></hp:run><hp:linesegarray/></hp:p>")
    out, error = packages.fill_package(content, {"who": "me & you", "x": "1\n2"}, "hwpx")
    assert error is None and texts(out, "hwpx") == ["me & you and 1\n2", "a\nb\t"]
    body = dict(C.open_archive(out)[0])["Contents/section0.xml"].decode()
    assert 'dirty="1"' in body and body.count("linesegarray") == 1 and "<hp:t>me &amp; you</hp:t><hp:t></hp:t>" in body
    bad = [HP.replace('beginIDRef="7"', 'beginIDRef="8"'), HP.replace('name="who"', 'name="1 a"'), HP.replace(" and {{x}}", "<hp:pic/>{{x}}"), HP.replace('id="1"', 'id="2"').replace("<hp:t> in</hp:t>", '<hp:ctrl><hp:fieldBegin id="9" type="CLICK_HERE" name="in"/></hp:ctrl><hp:t> in</hp:t><hp:ctrl><hp:fieldEnd beginIDRef="9"/></hp:ctrl>')]
    codes = [packages.fill_package(packages.simple_package([], "hwpx", b), {"who": "1", "x": "1"}, "hwpx")[1] for b in bad]
    assert codes == ["E_PRESERVATION", "E_FIELDS", "E_PRESERVATION", "E_PRESERVATION"]
    assert packages.fill_package(C.write_archive([("mimetype", b"text"), ("Contents/section0.xml", b"<a/>")]), {}, "hwpx")[1] == "E_INPUT"
    assert packages.fill_package(C.write_archive([("mimetype", b"application/hwp+zip"), ("META-INF/signatures.xml", b"<a/>"), ("Contents/section0.xml", b"<a/>")]), {}, "hwpx")[1] == "E_UNSUPPORTED"


def test_nodes(spark):
    body = '<a xmlns="u" x="1&gt;"><b y=\'>\'>t&amp;<![CDATA[<c>]]></b><!-- <d> --><?e <f>?><g/>é</a>'.encode()
    nodes = markup.nodes_of(body)
    assert [(n["local"], n["parent"], n["depth"], n["text"]) for n in nodes] == [("a", None, 0, None), ("b", 0, 1, None), ("#text", 1, 2, "t&<c>"), ("g", 0, 1, None), ("#text", 0, 1, "é")]
    assert [body[n["start"] : n["stop"]] for n in nodes if n["local"] == "b"] == [body[body.index(b"<b") : body.index(b"<!--")]]
    assert [body[n["start"] : n["stop"]] for n in nodes if n["local"] == "g"] == [b"<g/>"]
    assert [(n["start"], n["stop"]) for n in markup.nodes_of(b"<a><b><c/></b></a>")] == [(0, 18), (3, 14), (6, 10)]
    assert nodes[0]["attrs"] == {"xmlns": "u", "x": "1>"} and {n["ns"] for n in nodes if n["local"] != "#text"} == {"u"}
    rows = spark.createDataFrame([("p", "1", bytearray(body)), ("p", "2", bytearray(b"<a>")), ("p", "3", None)], "path string, part string, body binary")
    got = markup.node_rows(rows).collect()
    assert sorted((r.part, r.local or "", r.error or "") for r in got) == [("1", "#text", ""), ("1", "#text", ""), ("1", "a", ""), ("1", "b", ""), ("1", "g", ""), ("2", "", "E_INPUT"), ("3", "", "E_INPUT")]


def test_fill_packages(spark):
    one = packages.simple_package(["{{x}}", "y"], "hwpx")
    docs = spark.createDataFrame([("a", "hwpx", bytearray(one)), ("b", "hwpx", bytearray(one)), ("c", "docx", None)], "path string, format string, content binary")
    values = spark.createDataFrame([("a", {"x": "1\n2"}), ("c", {"x": "1"})], "path string, values map<string,string>")
    got = {r.path: r for r in packages.fill_packages(docs, values).collect()}
    assert texts(bytes(got["a"].filled), "hwpx") == ["1\n2", "y"]
    assert [got[k].error for k in "abc"] == [None, "E_FIELDS", "E_INPUT"]
    rows = {(r.path, r.para_no): (r.text, r.error) for r in packages.package_rows(docs).collect()}
    assert rows == {("a", 0): ("{{x}}", None), ("a", 1): ("y", None), ("b", 0): ("{{x}}", None), ("b", 1): ("y", None), ("c", None): (None, "E_INPUT")}


def built(big: bytes, small: bytes) -> bytes:
    """Sectors: 0 table, 1 directory, 2 table of small sectors, 3 small sectors, from 4 on the large stream."""
    n = -(-len(big) // 512)
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    fat = [0xFFFFFFFD, end, end, end, *range(5, 4 + n), end]
    entry = lambda name, kind, left, right, child, start, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    tree = entry("Root Entry", 5, free, free, 1, 3, 64) + entry("Body", 1, free, 3, 2, 0, 0) + entry("Section0", 2, free, free, free, 4, len(big)) + entry("Head", 2, free, free, free, 0, len(small))
    head = bytes.fromhex(C.COMPOUND) + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, 2, 1, end, 0, 0) + struct.pack("<I", free) * 108
    return head + struct.pack("<128I", *fat, *[free] * (128 - len(fat))) + tree + struct.pack("<128I", end, *[free] * 127) + small.ljust(512, b"\0") + big.ljust(512 * n, b"\0")


def test_compound(spark):
    big, small = bytes(range(256)) * 20, b"tiny"
    data = built(big, small)
    assert compound.streams(data) == [("Body/Section0", big), ("Head", small)]
    docs = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:3000])), ("c", None)], "path string, content binary")
    got = compound.compound_streams(docs).collect()
    assert sorted((r.path, r.stream or "", r.error or "") for r in got) == [("a", "Body/Section0", ""), ("a", "Head", ""), ("b", "", "E_INPUT"), ("c", "", "E_INPUT")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(packages.simple_package(["x"], "docx"))
    (tmp_path / "b.PDF").write_bytes(b"no pdf")
    (tmp_path / "c.txt").write_bytes(b"text")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.error) for r in C.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("docx", None), "b.PDF": ("pdf", "E_INPUT"), "c.txt": ("txt", "E_UNSUPPORTED")}
    assert zipfile.is_zipfile(tmp_path / "a.docx")
