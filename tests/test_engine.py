"""The whole way of documents: inventories, profiles, manifests, compound files, publication, catalogs in folders, the command line."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from test_packages import built

from formloom import cli
from formloom.operators import catalog as K
from formloom.plans import engine
from formloom.sources import hwp, packages, pdf


def frame(spark, *docs):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in docs], "path string, content binary")


ONE = packages.simple_package(["Dear {{name}}", "{{name}}, {{note}}"], "docx")
SHA = hashlib.sha256(ONE).hexdigest()


def inventory(sha=SHA, **change):
    slots = [{"id": "1", "location": "p", "status": "filled", "evidence": {"kind": "fields", "fields": ["name", "note"]}}, {"id": "2", "location": "q", "status": "blocked", "reason": "r", "nextAction": "n"}]
    return json.dumps({"version": 1, "templateSha256": sha, "slots": slots} | change)


def test_inspect(spark):
    docs = frame(spark, ("a.docx", ONE), ("b.docx", ONE), ("c.docx", ONE), ("d.docx", ONE), ("e.pdf", b"%PDF-1.4 ..."), ("f.txt", b"x"), ("g.docx", b""))
    cover = spark.createDataFrame([("a.docx", inventory()), ("b.docx", inventory("0" * 64)), ("c.docx", "no json")], "path string, inventory string")
    prof = spark.createDataFrame([("d.docx", json.dumps({"version": 1, "format": "hwpx", "templateSha256": SHA}), False)], "path string, profile string, registered boolean")
    got = {r.path: r for r in engine.inspect(docs, cover, prof).collect()}
    assert {k: (r.code, r.reason) for k, r in got.items()} == {"a.docx": (None, None), "b.docx": ("E_TEMPLATE_CHANGED", "template-hash"), "c.docx": ("E_COVERAGE", "invalid-version"), "d.docx": ("E_UNSUPPORTED", None), "e.pdf": ("E_INPUT", None), "f.txt": ("E_UNSUPPORTED", None), "g.docx": ("E_INPUT", None)}
    a = got["a.docx"]
    assert [(f.name, f.type, f.occurrences, f.max_length, f.required) for f in a.fields] == [("name", "text", 2, 10000, True), ("note", "text", 1, 10000, True)]
    assert (a.completion.status, a.completion.field_linked, a.completion.blocked, a.completion.full_document_complete) == ("incomplete", 1, 1, False)


def test_fill_with_manifest(spark):
    docs = frame(spark, ("a.docx", ONE), ("b.docx", ONE))
    field = lambda n, k, m: {"name": n, "type": "text", "occurrences": k, "max_length": m}
    manifests = spark.createDataFrame([("a.docx", [field("note", 1, 3), field("name", 2, 50)]), ("b.docx", [field("name", 1, 50)])], f"path string, fields array<{K.V.FIELD}>")
    values = json.dumps({"name": "A & B", "note": "long"})
    asked = spark.createDataFrame([("a.docx", values, "o.docx", None, None), ("b.docx", values, "o.docx", None, None)], "path string, values string, output string, overflow string, output_exists boolean")
    report, _ = engine.fill(docs, asked, manifests=manifests)
    got = {r.path: (r.code, r.reason, r.field) for r in report.collect()}
    assert got == {"a.docx": ("E_FIELDS", "length", "note"), "b.docx": ("E_TEMPLATE_CHANGED", None, None)}
    wrong = asked.withColumn("overflow", F.lit("shrink"))
    assert [r.code for r in engine.fill(docs, wrong)[0].collect()] == ["E_INPUT"] * 2


def record(tag, level, data):
    size = len(data)
    return struct.pack("<I", tag | level << 10 | min(size, 4095) << 20) + (struct.pack("<I", size) if size >= 4095 else b"") + data


def paragraph(text):
    return record(66, 0, bytes(22)) + record(67, 1, (text + "\r").encode("utf-16-le")) + record(68, 1, bytes(8)) + record(69, 1, bytes(36))


HEAD = b"HWP Document File".ljust(35, b"\0") + b"\5" + struct.pack("<I", 1)


def compressed(data, trailer=b""):
    worker = zlib.compressobj(9, zlib.DEFLATED, -15)
    return worker.compress(data) + worker.flush() + trailer


def streams_of(monkeypatch, own):
    monkeypatch.setattr(hwp, "streams", lambda data: sorted(own.items()))


def test_compound_document(monkeypatch):
    body, info = paragraph("Dear {{who}}") + paragraph("plain" * 900), b"styles"
    good = {"FileHeader": HEAD, "DocInfo": compressed(info, struct.pack("<II", zlib.crc32(info), len(info))), "BodyText/Section0": compressed(body)}
    streams_of(monkeypatch, good)
    own, flags = hwp.container(b"")
    assert (own["DocInfo"], own["BodyText/Section0"], flags) == (info, body, 1)
    rs = hwp.records(body)
    assert [(t, lv, p) for t, lv, p, *_ in rs] == [(66, 0, 0), (67, 1, 0), (68, 1, 0), (69, 1, 0), (66, 0, 1), (67, 1, 1), (68, 1, 1), (69, 1, 1)]
    assert hwp.text_of(rs[5][5]) == "plain" * 900 and rs[5][4] == 8
    script = {p: compressed(bytes.fromhex(x)) for p, x in hwp.SCRIPTS.items()}
    bad = [
        ({"FileHeader": HEAD[:36] + struct.pack("<I", 2)}, "E_UNSUPPORTED"), ({"FileHeader": b"x"}, "E_INPUT"), ({"BinData/a.exe": b""}, "E_UNSUPPORTED"), ({"BinData/a.png": b""}, None), ({"DocHistory/x": b""}, "E_UNSUPPORTED"), (script, None), ({"Scripts/JScriptVersion": b""}, "E_UNSUPPORTED"),
        (script | {"Scripts/DefaultJScript": compressed(b"alert()")}, "E_UNSUPPORTED"), ({"DocInfo": compressed(info, b"12345678")}, "E_PRESERVATION"), ({"BodyText/Section0": b"\xff\xff"}, "E_INPUT"),
    ]
    for change, code in bad:
        streams_of(monkeypatch, good | change)
        if code is None:
            hwp.container(b"")
        else:
            with pytest.raises(hwp.Refused, match=code):
                hwp.container(b"")
    for data, code in ((record(66, 0, b"a")[:-1], "E_INPUT"), (record(67, 0, b""), "E_UNSUPPORTED"), (record(66, 0, b"") + record(67, 2, b""), "E_INPUT"), (b"", "E_INPUT"), (record(66, 0, b"") + record(67, 65, b""), "E_INPUT")):
        with pytest.raises(hwp.Refused, match=code):
            hwp.records(data)


def test_record_rows(spark):
    head = struct.pack("<I", 0)
    body = paragraph("a {{x}} b") + paragraph("second")
    assert len(body) < 4096
    # a file of two streams has neither header nor styles
    docs = spark.createDataFrame([("a.hwp", "hwp", bytearray(built(body.ljust(4097, b"\0"), head))), ("b.hwp", "hwp", None)], "path string, format string, content binary")
    assert sorted((r.path, r.error) for r in hwp.record_rows(docs).collect()) == [("a.hwp", "E_INPUT"), ("b.hwp", "E_INPUT")]
    assert {(r.path, r.error) for r in hwp.paragraph_rows(docs).collect()} == {("a.hwp", "E_INPUT"), ("b.hwp", "E_INPUT")}


def test_publish(spark, tmp_path):
    (tmp_path / "there").write_bytes(b"old")
    files = frame(spark, (str(tmp_path / "new"), b"1"), (str(tmp_path / "there"), b"2"), (str(tmp_path / "no" / "folder" / "x"), b"3"))
    got = {r.path.rsplit("/", 1)[1]: r.error for r in K.publish(files).collect()}
    assert got == {"new": None, "there": "E_OUTPUT_EXISTS", "x": "E_IO"}
    assert (tmp_path / "there").read_bytes() == b"old" and sorted(p.name for p in tmp_path.iterdir()) == ["new", "there"]
    # a task that runs again finds its own file
    assert {r.error for r in K.publish(files.filter(F.col("path").endswith("new"))).collect()} == {None}


def template(folder, name, content=ONE, **change):
    own = folder / name
    own.mkdir(parents=True)
    m = {"schemaVersion": 1, "id": name, "title": "T", "format": "docx", "file": "template.docx", "sha256": hashlib.sha256(content).hexdigest(), "fields": [{"name": "name", "type": "text", "occurrences": 2, "maxLength": 20}, {"name": "note", "type": "text", "maxLength": 9}]} | change
    (own / "manifest.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(m).encode())
    (own / "template.docx").write_bytes(content)


def test_command_line(spark, tmp_path, capsys):
    bundled, library = tmp_path / "bundled", tmp_path / "library"
    template(bundled, "report-docx")
    template(bundled, "letter")
    template(bundled, ".hidden")
    template(bundled, "wrong", id="other")
    (bundled / "broken").mkdir()
    (bundled / "broken" / "manifest.json").write_bytes(b'{"id": "\xff"}')
    template(library, "letter")
    template(library, "own")
    (tmp_path / "plain.docx").write_bytes(ONE)
    (tmp_path / "values.json").write_text(json.dumps({"name": "N", "note": "x\ny"}))

    def run(*args):
        code = cli.main([*map(str, args), "--bundled", str(bundled)], spark)
        said = capsys.readouterr()
        return code, json.loads(said.out or said.err)

    code, out = run("templates", "list", "--library", library)
    assert code == 0 and [(t["id"], t["origin"], t["fields"]) for t in out["templates"]] == [("letter", "bundled", 2), ("report-docx", "bundled", 2), ("own", "user", 2)]
    assert sorted((w["id"], w["reason"]) for w in out["warnings"]) == [("broken", "E_INPUT"), ("letter", "E_INPUT"), ("wrong", "E_INPUT")]
    assert run("templates", "show", "own", "--library", library)[1]["id"] == "own"
    assert run("templates", "show", "none", "--library", library)[1] == {"ok": False, "error": {"code": "E_INPUT"}}
    code, out = run("inspect", tmp_path / "plain.docx")
    assert code == 0 and [f["name"] for f in out["fields"]] == ["name", "note"]
    assert run("validate", tmp_path / "plain.docx")[1]["checks"] == ["docx-container", "xml-well-formed"]
    target = tmp_path / "out.docx"
    code, out = run("fill", "own", "--data", tmp_path / "values.json", "--output", target, "--library", library, "--dry-run")
    assert code == 0 and out["dry_run"] and not target.exists()
    code, out = run("fill", "own", "--data", tmp_path / "values.json", "--output", target, "--library", library)
    assert code == 0 and out["output_sha256"] == hashlib.sha256(target.read_bytes()).hexdigest() and out["completion"]["verified_fields"] == 2
    assert run("fill", "own", "--data", tmp_path / "values.json", "--output", target, "--library", library) == (1, {"ok": False, "error": {"code": "E_OUTPUT_EXISTS"}})
    (library / "own" / "template.docx").write_bytes(ONE + b"x")
    assert run("fill", "own", "--data", tmp_path / "values.json", "--output", tmp_path / "o2.docx", "--library", library)[1]["error"]["code"] == "E_TEMPLATE_CHANGED"
    code, out = run("templates", "register", tmp_path / "plain.docx", "--id", "new-one", "--title", " My form ", "--library", library)
    assert code == 0 and out["manifest"]["title"] == "My form"
    assert run("templates", "show", "new-one", "--library", library)[1]["sha256"] == SHA
    assert run("templates", "register", tmp_path / "plain.docx", "--id", "letter", "--title", "x", "--library", library)[1]["error"]["code"] == "E_OUTPUT_EXISTS"
    for wrong in (["validate", "x", "--coverage", "c"], ["templates", "list", "more"], ["fill", "own"], ["dance"], ["templates", "list", "--layout-profile", "p"], ["inspect", "a", "b"]):
        assert run(*wrong)[1]["error"]["code"] == "E_INPUT"
    code, out = run("doctor")
    assert code == 1 and {f: x["ready"] for f, x in out["formats"].items()} == {"docx": True, "hwp": False, "hwpx": False, "pdf": False}


def test_forms(spark):
    good = pdf.simple_form([("name", "Tx"), ("Straße 1", "Tx"), ("ok", "Btn"), ("sign", "Sig")], "/MaxLen 12")
    packed = zlib.compress(b"4 0 <</FT/Tx/T(inner)/Rect[0 0 9 9]/Subtype/Widget>>")
    stream = good.replace(b"4 0 obj", b"9 0 obj\n<</Type/ObjStm/N 1/First 4/Filter/FlateDecode/Length %d>>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\n40 0 obj")
    docs = frame(spark, ("a.pdf", good), ("b.pdf", pdf.simple_form([("x", "Tx")], "/AA<</S/JavaScript>>")), ("c.pdf", pdf.simple_form([("x", "Tx")], "/Ff 1")), ("d.pdf", pdf.simple_form([("x", "Tx"), ("x", "Tx")])), ("e.pdf", pdf.simple_form([("x", "Ch")])), ("f.pdf", good[:-7]), ("g.pdf", good.replace(b"/Size", b"/Encrypt 8 0 R/Size")), ("h.pdf", pdf.simple_form([("s", "Sig")], "/V<</Type/Sig>>")), ("i.pdf", stream))
    got = {r.path: (r.code, [(f.name, f.type, f.max_length) for f in r.fields]) for r in engine.inspect(docs).collect()}
    alias = "field_" + hashlib.sha256("Straße 1".encode()).hexdigest()[:12]
    assert got["a.pdf"] == (None, [("name", "text", 12), (alias, "text", 12), ("ok", "checkbox", 10000)])
    assert {k: c for k, (c, _) in got.items() if k != "a.pdf"} == {"b.pdf": "E_UNSUPPORTED", "c.pdf": "E_UNSUPPORTED", "d.pdf": "E_FIELDS", "e.pdf": "E_UNSUPPORTED", "f.pdf": "E_INPUT", "g.pdf": "E_UNSUPPORTED", "h.pdf": "E_UNSUPPORTED", "i.pdf": None}
    assert [f for f, _, _ in got["i.pdf"][1]] == ["inner", alias, "ok"]
    rows = {(r.path, r.name): (r.kind, r.pages, r.widgets, r.visible) for r in pdf.field_rows(docs.filter("path = 'a.pdf'")).collect()}
    assert rows["a.pdf", "sign"] == ("signature", [1], 1, True)


def test_reader():
    read = lambda b: pdf.Reader(b).value()
    assert read(b" <</A#20b [1 -2.5 true null (a\\(\\051\\101(x)\\n) <4a4>] % note\n/C 7 0 R>>") == {"A b": [1, -2.5, True, None, b"a()A(x)\n", b"J@"], "C": 7}
    for bad in (b"<</A", b"(open", b"[1 2", b"<4x>", b"<<1 2>>", b"[" * 100):
        with pytest.raises(pdf.Refused):
            read(bad)


def test_stream(spark, tmp_path):
    from formloom.streaming import fill_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "one.json").write_text('{"id": 1, "name": "A {{b}}"}\n{"id": 2}\n')
    rows = spark.readStream.schema("id long, name string").json(str(source))
    filled = fill_stream.fill_stream(rows, "Dear {{name}}", ["name"], "id")
    q = filled.writeStream.format("memory").queryName("filled_rows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert sorted((r.id, r.filled) for r in spark.table("filled_rows").collect()) == [(1, "Dear A {{b}}"), (2, None)]
