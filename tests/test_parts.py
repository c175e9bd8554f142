"""Archives as a data source, publication in two phases, texts from nodes, edits as rows, and what may not flow, on small documents."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo
from pyspark.sql.types import StructType

from formloom.operators import projection, splicing
from formloom.plans import engine, parts
from formloom.sources import containers, package_source, packages, pdf, publish_sink
from formloom.sources.markup import node_rows


class Counted:
    """A file that counts what is read of it."""

    reads: list = []

    def __init__(self, file):
        self.file = file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def size(self):
        return self.file.size()

    def read_at(self, n, at):
        Counted.reads.append((at, n))
        return self.file.read_at(n, at)


def archive(path, members, comment=b""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
        z.comment = comment
    return str(path)


def test_reader_reads_what_is_asked(spark, tmp_path, monkeypatch):
    big = os.urandom(300_000)
    archive(tmp_path / "a.zip", [("one.bin", big), ("two.bin", big[:1000]), ("é/three.xml", b"<x/>" * 9)])
    monkeypatch.setattr(package_source, "opened", lambda p, f=package_source.opened: Counted(f(p)))
    names = package_source.PartReader({"path": str(tmp_path)}, StructType.fromDDL("path string, part string, size long"))
    Counted.reads = []
    rows = [r for p in names.partitions() for r in names.read(p)]
    assert [r[1:] for r in rows] == [("one.bin", 300_000), ("two.bin", 1000), ("é/three.xml", 36)]
    assert sum(n for _, n in Counted.reads) <= package_source.TAIL and len(Counted.reads) == 1
    one = package_source.PartReader({"path": str(tmp_path)}, StructType.fromDDL("part string, body binary"))
    assert list(one.pushFilters([EqualTo(("part",), "two.bin"), EqualTo(("size",), 5)])) == [EqualTo(("size",), 5)]
    Counted.reads = []
    assert [r for p in one.partitions() for r in one.read(p)] == [("two.bin", big[:1000])]
    assert sum(n for _, n in Counted.reads) < package_source.TAIL + 3000
    gone = package_source.PartReader({"path": str(tmp_path)}, StructType.fromDDL("path string"))
    list(gone.pushFilters([EqualTo(("path",), "elsewhere")]))
    assert [r for p in gone.partitions() for r in gone.read(p)] == []


def test_plans_hold_few_bytes_a_package(tmp_path):
    """What planning hands on is a few bytes for each package, folders below included, and names them all."""
    import pickle

    (tmp_path / "in" / "er").mkdir(parents=True)
    names = [f"{'in/er/' if k % 3 == 0 else ''}é{k}.{'zip' if k % 5 else 'txt'}" for k in range(3000)]
    for n in names:
        (tmp_path / n).touch()
    for folder, ahead in ((str(tmp_path), str(tmp_path)), (f"file://{tmp_path}/", f"file://{tmp_path}")):
        plan = package_source.PartReader({"path": folder}, StructType().add("path", "string")).partitions()
        assert sorted(x for p in plan for x in p.paths) == sorted(f"{ahead}/{n}" for n in names if n.endswith("zip"))
        assert len(plan) == 3 and sum(len(pickle.dumps(p)) for p in plan) < 10 * len(names)


def test_directories_are_judged_as_rows(spark, tmp_path):
    archive(tmp_path / "fine.zip", [("a.xml", b"1"), ("b.xml", b"2")], comment=b"PK\5\6 not the end")
    archive(tmp_path / "climbs.zip", [("../a", b"1")])
    with pytest.warns(UserWarning):
        archive(tmp_path / "twice.zip", [("a", b"1"), ("a", b"2")])
    (tmp_path / "torn.zip").write_bytes((tmp_path / "fine.zip").read_bytes()[:60])
    (tmp_path / "empty.zip").write_bytes(b"")
    archive(tmp_path / "none.zip", [])
    data = bytearray((tmp_path / "climbs.zip").read_bytes())
    locked = data.replace(b"../a", b"xx/a")
    locked[locked.index(b"PK\1\2") + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(locked)
    rows = package_source.package_parts(spark, str(tmp_path), ("path", "part", "method", "flags", "size", "entries", "archive", "problem"))
    got = {os.path.basename(r.path): (r.code, r.reason) for r in package_source.directory_verdict(rows).collect()}
    assert got == {"fine.zip": (None, None), "climbs.zip": ("E_INPUT", "unsafe-name"), "twice.zip": ("E_INPUT", "duplicate-name"), "torn.zip": ("E_INPUT", "unreadable"), "empty.zip": ("E_INPUT", "unreadable"), "locked.zip": ("E_UNSUPPORTED", "encrypted")} | {k: v for k, v in got.items() if k == "none.zip"}


def documents(spark, rows):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary")


def test_publication_is_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    publish_sink.publish(documents(spark, [("a", b"1"), ("b", b"22")]), folder)
    seen = lambda: sorted(f for f in os.listdir(folder) if not f.startswith("_published"))
    assert seen() == ["a", "b"] and not [f for f in os.listdir(folder) if f.startswith("_staged")]
    for bad in ([("c", b"3"), ("b", b"other")], [("c", b"3"), ("c", b"4")], [("c", b"3"), ("../d", b"4")]):
        with pytest.raises(Exception, match="E_OUTPUT_EXISTS|E_INPUT"):
            publish_sink.publish(documents(spark, bad), folder)
        assert seen() == ["a", "b"] and (tmp_path / "out" / "b").read_bytes() == b"22"
        assert not [f for f in os.listdir(folder) if f.startswith("_staged")]


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")

    def fails(batches):
        for b in batches:
            yield b
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        publish_sink.publish(documents(spark, [("a", b"1")]).coalesce(1).mapInPandas(fails, "name string, content binary"), folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []


def test_a_task_that_ran_twice_counts_once(tmp_path):
    w = publish_sink.Publisher({"path": str(tmp_path / "out")})
    first, again = w.write(iter([{"name": "a", "content": b"1"}])), w.write(iter([{"name": "a", "content": b"1"}]))
    assert first != again
    w.commit([again])
    assert sorted(f.split("-")[0] for f in os.listdir(tmp_path / "out")) == ["_published", "a"]


def test_commit_messages_do_not_grow_with_the_documents(tmp_path, monkeypatch):
    """Names go by sorted lists in files, which are merged in rounds; duplicates are found and what was put down is taken back across lists."""
    import pickle

    monkeypatch.setattr(publish_sink, "RUN", 7)
    monkeypatch.setattr(publish_sink, "WAYS", 3)
    rows = [{"name": f"{k * 37 % 400}é.docx", "content": b"x" * (k % 5)} for k in range(400)]
    folder = tmp_path / "out"
    w = publish_sink.Publisher({"path": str(folder)})
    w.commit([w.write(iter(rows[:250])), None, w.write(iter(rows[250:])), w.write(iter([]))])
    said = json.loads((folder / f"_published-{w.job}.json").read_text())["documents"]
    assert [x["name"] for x in said] == sorted(r["name"] for r in rows) and all((folder / x["name"]).stat().st_size == x["bytes"] for x in said)
    before = sorted(os.listdir(folder))
    for more, taken in (([{"name": "zz", "content": b""}, {"name": "zz", "content": b"1"}], "zz"), ([{"name": "0a", "content": b""}, {"name": "7é.docx", "content": b""}], "7é.docx")):
        again = publish_sink.Publisher({"path": str(folder)})
        with pytest.raises(publish_sink.Taken, match=taken):
            again.commit([again.write(iter([r])) for r in more])
        assert sorted(os.listdir(folder)) == before
    monkeypatch.setattr(publish_sink, "RUN", 50_000)
    w = publish_sink.Publisher({"path": str(tmp_path / "two")})
    assert len(pickle.dumps(w.write(iter(rows)))) < 1000


def test_two_writers_of_one_id(tmp_path):
    one, two = (publish_sink.Publisher({"path": str(tmp_path), "id": "letter"}) for _ in range(2))
    mine, other = one.write(iter([{"name": "t.docx", "content": b"1"}])), two.write(iter([{"name": "t.docx", "content": b"2"}]))
    two.commit([other])
    with pytest.raises(publish_sink.Taken):
        one.commit([mine])
    said = json.loads((tmp_path / "letter" / "manifest.json").read_text())
    assert said["job"] == two.job and (tmp_path / "letter" / two.job / "t.docx").read_bytes() == b"2" and not (tmp_path / "letter" / one.job).exists()
    # what a job left that died before its manifest blocks nothing
    (tmp_path / "free" / "abandoned").mkdir(parents=True)
    three = publish_sink.Publisher({"path": str(tmp_path), "id": "free"})
    three.commit([three.write(iter([{"name": "t", "content": b"3"}]))])
    assert json.loads((tmp_path / "free" / "manifest.json").read_text())["documents"][0]["name"] == "t"


@pytest.mark.parametrize("form", ["docx", "hwpx"])
def test_projection_equals_the_model(spark, form):
    """Texts and fields from node rows are those of package_rows, for nested and empty paragraphs, breaks, tabs and split markers."""
    docs = spark.createDataFrame([(f"1.{form}", form, parts.BODIES[form]), (f"2.{form}", form, "")], "path string, format string, body string")
    made = packages.make_packages(docs)
    want = sorted((r.path, r.para_no, r.text, [(f.name, f.start, f.stop) for f in r.fields]) for r in packages.package_rows(made).collect() if r.part)
    got = projection.fields(projection.paragraphs(parts.field_nodes(made, form), form)).collect()
    place = {}
    mine = []
    for r in sorted(got, key=lambda r: (r.path, r.p)):
        place[r.path] = place.get(r.path, -1) + 1
        mine.append((r.path, place[r.path], r.text, sorted(((f.name, f.start, f.stop) for f in r.fields), key=lambda f: f[1])))
    assert sorted(mine) == want and any(f for *_, f in mine)


def test_splice(spark):
    body = "<a><b x='1'/>é</a>".encode()
    n = len(body)
    bodies = spark.createDataFrame([(p, "s", bytearray(body)) for p in "xyz"], "path string, part string, body binary")
    segments = spark.createDataFrame([("x", "s", 0, 0, 3), ("x", "s", 1, 3, 13), ("x", "s", 2, 3, 13), ("x", "s", 3, 13, n), ("y", "s", 0, 0, n), ("z", "s", 0, 0, n)], "path string, part string, segment int, start int, stop int")
    schema = "path string, part string, segment int, start int, stop int, replacement binary, attributes map<string,string>, content_of string"
    edits = spark.createDataFrame([("x", "s", 1, 3, 13, None, {"x": "2", "y": "3"}, None), ("x", "s", 2, 3, 13, bytearray(b"in"), None, "b"), ("x", "s", 3, 13, 15, bytearray(b"e"), None, None), ("y", "s", 0, 3, 13, bytearray(b""), None, None), ("y", "s", 0, 3, 3, bytearray(b"+"), None, None), ("z", "s", 0, 2, 5, bytearray(b""), None, None), ("z", "s", 0, 4, 6, bytearray(b""), None, None)], schema)
    got = {r.path: (r.body and bytes(r.body), r.error) for r in splicing.splice(bodies, segments, edits).collect()}
    assert got == {"x": (b'<a><b x="2" y="3"/><b x=\'1\'>in</b>e</a>', None), "y": ("<a>+é</a>".encode(), None), "z": (None, "E_PRESERVATION")}


@pytest.mark.parametrize("form", ["docx", "hwpx"])
def test_enclosing_is_the_innermost(spark, form):
    nodes = parts.field_nodes(packages.make_packages(spark.createDataFrame([(f"1.{form}", form, parts.BODIES[form])], "path string, format string, body string")), form)
    rows = nodes.collect()
    by = {r.node: r for r in rows}

    def up(r, kind):
        while r is not None and not (r.local == kind):
            r = by.get(r.parent)
        return r and r.node

    for r in projection.enclosing(nodes, {"p": F.col("local") == "p", "tbl": F.col("local") == "tbl"}).collect():
        assert (r.p, r.tbl) == (up(by[r.node], "p"), up(by[r.node], "tbl"))


def test_engine_refuses_what_may_not_flow(spark):
    bodies = [*parts.UNFIT, *[(b, None) for b in parts.FIT[:1] + parts.FIT[2:]]]
    docs = packages.make_packages(spark.createDataFrame([(f"/d/{i}.docx", "docx", b + parts.SECTION) for i, (b, _) in enumerate(bodies)], "path string, format string, body string")).select("path", "content")
    requests = docs.select("path", F.lit(json.dumps({"x": "one\ntwo"})).alias("values"), F.regexp_replace("path", "docx", "new.docx").alias("output"), F.lit("flow").alias("overflow"), F.lit(False).alias("output_exists"))
    report, filled = engine.fill(docs, requests)
    got = {int(r.path.split("/")[-1].split(".")[0]): (r.code, r.reason, r.field) for r in report.collect()}
    for i, (_, reason) in enumerate(bodies):
        assert got[i] == (("E_LAYOUT", reason, "x") if reason else (None, None, None)), (i, got[i], reason)
    assert filled.count() == 2


def test_damaged_forms_are_rows(spark):
    """Whatever is wrong in a file, the others are read."""
    base = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R/AcroForm<</Fields[4 0 R]>>>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Annots[4 0 R]/MediaBox[0 0 9 9]>>endobj\n4 0 obj<</FT/Tx/T(a)/Subtype/Widget/Rect[0 0 5 5]/P 3 0 R>>endobj\ntrailer<</Root 1 0 R/Size 5>>\n%%EOF"
    r = random.Random(4)
    files = [base, base.replace(b"/Kids[3 0 R]", b"/Kids[99 0 R]"), base.replace(b"/FT/Tx", b"/FT[/Tx]"), base.replace(b"/Rect[0 0 5 5]", b"/Rect 7")]
    for _ in range(400):
        x = bytearray(base)
        for _ in range(r.randint(1, 4)):
            x[r.randrange(9, len(x))] = r.choice(b"0123456789<>[]/()RTxabc %\n")
        files.append(bytes(x))
    docs = spark.createDataFrame([(f"{i}.pdf", bytearray(f)) for i, f in enumerate(files)], "path string, content binary")
    assert {r.path for r in pdf.entry_rows(docs).collect()} == {f"{i}.pdf" for i in range(len(files))}
    assert pdf.field_rows(docs).count() > 100


def test_values_are_not_lost_in_repeated_rows(spark):
    """Every number of records that a template of three body rows can meet."""
    made = packages.make_packages(spark.createDataFrame([(f"{n}.hwpx", "hwpx", parts.grid(parts.SOUND)) for n in (1, 2, 3, 4, 6)], "path string, format string, body string"))
    records = spark.createDataFrame([(f"{n}.hwpx", i, {"no": f"{n}/{i}", "priority": "<&>"}) for n in (1, 2, 3, 4, 6) for i in range(n)], "path string, record int, values map<string,string>")
    all_parts = containers.parts(made)
    nodes = node_rows(all_parts.filter("part like '%section0.xml'")).drop("error")
    new, judged = parts.repeat_fill.filled_parts(nodes, all_parts, parts.region(made), records)
    assert {r.reason for r in judged.collect()} == {None}
    out = parts.repeat_fill.repacked(all_parts, new).withColumn("format", F.lit("hwpx"))
    said = {}
    for r in sorted(packages.package_rows(out).collect(), key=lambda r: (r.path, r.para_no)):
        said.setdefault(r.path, []).append(r.text)
    for n in (1, 2, 3, 4, 6):
        cells = [x for i in range(n) for x in (f"{n}/{i}", "<&>")]
        assert [x for x in said[f"{n}.hwpx"] if x != ""] == ["Orders of one customer", "No", "Priority", *cells, "sum", "&c", "the end"]


def test_cuts_follow_widths_and_keep_marks():
    import numpy as np

    from formloom.functions.widths import cuts

    codes, known = np.array([ord("W"), ord("i")], np.uint32), np.array([4, 1])
    text = "iii WW \u00e1 b \u0301c d"
    for budget in range(1, 40):
        got = cuts(text, budget, codes, known, 2)
        places = [0, 4, 7, 9, 14, 15]
        wide = lambda a, b: sum({"i": 1, "W": 4}.get(c, 2) for c in text[a:b])
        want, at = [], 0
        while at < len(text):
            fits = [p for p in places if p > at and wide(at, p) <= budget]
            if not fits:
                want = None
                break
            at = max(fits)
            want.append(at)
        assert got == want, budget
    assert cuts("", 5, codes, known, 2) == [] and cuts("WW", 7, codes, known, 2) is None


def test_subtree_hashes_tell_subtrees_apart(spark):
    r = random.Random(8)

    def grown(depth):
        name = r.choice("ab")
        kids = "".join(grown(depth - 1) for _ in range(r.randint(0, 3))) if depth else ""
        return f'<hp:{name} id="{r.random()}" x="{r.randint(0, 1)}">{r.choice(["", "t"])}{kids}</hp:{name}>'

    nodes = parts.field_nodes(packages.make_packages(spark.createDataFrame([(f"{i}.hwpx", "hwpx", "".join(grown(4) for _ in range(6))) for i in range(4)], "path string, format string, body string")), "hwpx")
    rows = {(n.path, n.node): n for n in nodes.collect()}
    kids = {}
    for (path, _), n in sorted(rows.items()):
        kids.setdefault((path, n.parent), []).append(n)

    def said(n):
        return (n.local, tuple(sorted((k, v) for k, v in n.attrs.items() if k != "id")), n.text or "", tuple(said(k) for k in kids.get((n.path, n.node), [])))

    by_hash, by_tree = {}, {}
    got = parts.repeat_fill.T.subtree_hashes(nodes).collect()
    for h in got:
        shape = said(rows[h.path, h.node])
        assert by_hash.setdefault((h.h1, h.h2), shape) == shape and by_tree.setdefault(shape, (h.h1, h.h2)) == (h.h1, h.h2)
    assert len(got) > 100 and 10 < len(by_hash) < len(got)


def test_boxes_of_all_sizes(spark):
    from formloom.operators.records import boxes_overlap

    r = random.Random(2)
    boxes = [(i % 2, i, r.randint(-50, 400), r.randint(-50, 400), r.choice([1, 3, 7, 40, 300]), r.choice([1, 2, 9, 64, 200])) for i in range(300)]
    got = sorted((x.page, x.a, x.b) for x in boxes_overlap(spark.createDataFrame(boxes, "page int, id int, x int, y int, w int, h int"), "page").collect())
    want = sorted((a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5])
    assert got == want and len(got) > 500


def test_style_chains_that_break(spark):
    from formloom.operators.records import style_properties

    rows = [("d", "a", "p", None, {"x": "1", "y": "1"}, False), ("d", "b", "p", "a", {"y": "2"}, False), ("d", "c", "p", "b", {"z": "3"}, None), ("d", "t", "t", "a", {}, False), ("d", "u", "t", "t", {}, False), ("d", "gone", "p", "none", {}, False)]
    rows += [("d", "two", "p", "a", {}, False), ("d", "two", "p", "b", {}, False), ("d", "on_two", "p", "two", {}, False), ("d", "l", "p", "m", {}, False), ("d", "m", "p", "l", {}, False), ("d", "to_l", "p", "l", {}, False), ("d", "self", "p", "self", {}, False), ("d", "if", "p", "a", {}, True), ("e", "a", "p", None, None, False)]
    got = {(r.doc, r.id): (r.reason, r.props) for r in style_properties(spark.createDataFrame(rows, "doc string, id string, type string, parent string, props map<string,string>, conditional boolean"), "doc").collect()}
    assert got["d", "c"] == (None, {"x": "1", "y": "2", "z": "3"}) and got["e", "a"] == (None, {})
    said = {"t": "ambiguous-style", "u": "ambiguous-style", "gone": "missing-style", "two": "ambiguous-style", "on_two": "ambiguous-style", "l": "cyclic-style", "m": "cyclic-style", "to_l": "cyclic-style", "self": "cyclic-style", "if": "conditional-style", "b": None}
    assert {k: got["d", k][0] for k in said} == said


def test_engine_fills_repeated_rows(spark):
    """A profile acts: its region takes a record's rows, the other field its text; each thing that is wrong has its own code."""
    body = parts.grid(parts.SOUND) + "<hp:p><hp:run><hp:t>for {{who}}</hp:t></hp:run></hp:p>"
    made = packages.make_packages(spark.createDataFrame([(f"/d/{i}.hwpx", "hwpx", body if i != 5 else body.replace('noAdjust="0"', 'noAdjust="1"')) for i in range(7)], "path string, format string, body string")).select("path", "content")
    sha = {r.path: r.sha for r in made.select("path", F.sha2("content", 256).alias("sha")).collect()}
    region = {"name": "orders", "part": "Contents/section0.xml", "tableId": "rep", "headerRows": [0], "bodyRows": {"start": 1, "end": 3}, "prototypeRow": 2, "insertBeforeRow": 3, "maxRows": 6, "columns": [{"name": "no", "column": 0, "maxLength": 9}, {"name": "priority", "column": 1, "maxLength": 20}]}
    profile = lambda i, **more: json.dumps({"version": 1, "format": "hwpx", "templateSha256": sha[f"/d/{i}.hwpx"], "repeatRegions": [region | more]})
    profiles = spark.createDataFrame([(f"/d/{i}.hwpx", profile(i, **({"columns": []} if i == 3 else {})) if i != 4 else profile(i).replace(sha["/d/4.hwpx"], "0" * 64)) for i in range(7)], "path string, profile string")
    row = lambda n: {"no": str(n), "priority": "a & b\tc"}
    values = {0: {"orders": [row(1)], "who": "x"}, 1: {"orders": [row(n) for n in range(5)], "who": "y & z"}, 2: {"orders": [row(n) for n in range(7)], "who": "x"}, 3: {}, 4: {}, 5: {"orders": [row(1)], "who": "x"}, 6: {"orders": [{"no": "1"}], "who": "x"}}
    report, filled = engine.fill_repeated(made, profiles, spark.createDataFrame([(f"/d/{i}.hwpx", json.dumps(v)) for i, v in values.items()], "path string, values string"))
    got = {int(r.path[3]): r for r in report.collect()}
    assert {i: r.code for i, r in got.items()} == {0: None, 1: None, 2: "E_FIELDS", 3: "E_INPUT", 4: "E_TEMPLATE_CHANGED", 5: "E_LAYOUT", 6: "E_FIELDS"}, got
    assert (got[1].records, got[1].reused, got[1].cloned, got[1].removed) == (5, 3, 2, 0) and (got[0].reused, got[0].removed) == (1, 2)
    assert (got[5].reason, got[5].field) == ("unsupported-anchor", "orders")
    texts = {}
    for r in sorted(packages.package_rows(filled.withColumn("format", F.lit("hwpx"))).collect(), key=lambda r: (r.path, r.para_no)):
        texts.setdefault(int(r.path[3]), []).append(r.text)
    assert [x for x in texts[1] if x] == ["Orders of one customer", "No", "Priority", *[x for n in range(5) for x in (str(n), "a & b\tc")], "sum", "&c", "the end", "for y & z"]
    assert [x for x in texts[0] if x][3:5] == ["1", "a & b\tc"] and set(texts) == {0, 1}


def test_borders_of_a_single_record(spark):
    """Its row takes the last row's border: that may differ in the bottom line alone, and each border is defined once."""
    head = lambda fills: f'<hh:head xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head">{fills}</hh:head>'.encode()
    fill = lambda k, left="1", bottom="1": f'<hh:borderFill id="{k}"><hh:leftBorder w="{left}"/><hh:bottomBorder w="{bottom}"/></hh:borderFill>'
    fine = fill(0) + fill(1) + fill(2) + fill(3, bottom="9") + fill(4)
    heads = {"fine": fine, "left": fine.replace(fill(3, bottom="9"), fill(3, left="2")), "twice": fine + fill(1), "none": fine.replace(fill(4), "")}
    docs = []
    for name, fills in heads.items():
        entries, _ = containers.open_archive(packages.simple_package([], "hwpx", parts.grid(parts.SOUND)))
        docs.append((f"{name}.hwpx", "hwpx", bytearray(containers.write_archive([*entries, ("Contents/header.xml", head(fills))]))))
    made = spark.createDataFrame(docs, "path string, format string, content binary")
    records = spark.createDataFrame([(f"{n}.hwpx", 0, {"no": "1", "priority": "p"}) for n in heads], "path string, record int, values map<string,string>")
    every = containers.parts(made)
    nodes, headers = (node_rows(every.filter(f"part = 'Contents/{p}.xml'")).drop("error") for p in ("section0", "header"))
    new, judged = parts.repeat_fill.filled_parts(nodes, every, parts.region(made), records, headers)
    assert {r.path.split(".")[0]: r.reason for r in judged.collect()} == {"fine": None, "left": "incompatible-single-row-border", "twice": "ambiguous-style", "none": "ambiguous-style"}
    body = [bytes(r.body).decode() for r in new.collect()]
    assert len(body) == 1 and body[0].count('borderFillIDRef="3"') == 2 and 'borderFillIDRef="1"' not in body[0]
