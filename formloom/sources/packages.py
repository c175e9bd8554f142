"""Packages of XML: their paragraphs and fields as rows, and filling them without touching any other byte of their parts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions.text import MARKER, NAME, RESERVED
from formloom.operators.lineage import spread
from formloom.sources.containers import FIELD_PARTS, PARAGRAPH, WORD, Refused, need, open_package, write_archive
from formloom.sources.markup import nodes_of, spliced

SPACE = {"docx": WORD, "hwpx": PARAGRAPH}
#: Stands for an element within a text that has no characters.
OBJECT = "￼"


def legal(name: str) -> bool:
    return bool(re.fullmatch(NAME[2:-2], name)) and name not in RESERVED


class Paragraph:
    """Text, texts (node, start, stop, safe) and fields of a paragraph. Runs are transparent, an inner paragraph has its own."""

    def __init__(self, node: dict):
        self.node, self.text, self.runs, self.fields = node, "", [], []

    def add(self, text: str, node: dict | None = None, safe: bool = True) -> None:
        if node is not None:
            self.runs.append((node, len(self.text), len(self.text) + len(text), safe))
        self.text += text


def paragraphs_of(body: bytes, form: str) -> tuple[list[dict], list[Paragraph]]:
    """Nodes and paragraphs of a part: text elements joined, breaks as line ends, tabs as tabs (tab stops aren't text)."""
    nodes, space = nodes_of(body), SPACE[form]
    own = lambda n, *local: n["ns"] == space and n["local"] in local
    parent = lambda n: nodes[n["parent"]] if n["parent"] is not None else None
    holder: list[int | None] = []
    out: dict[int, Paragraph] = {}
    kids: dict[int, list[dict]] = {}
    for n in nodes:
        holder.append(n["node"] if own(n, "p") else holder[n["parent"]] if n["parent"] is not None else None)
        kids.setdefault(n["parent"], []).append(n)
        if own(n, "p"):
            out[n["node"]] = Paragraph(n)
    for n in nodes:
        up, p = parent(n), out.get(holder[n["node"]])
        if p is None or up is None:
            continue
        if own(n, "t") and (form == "hwpx" or own(up, "r")):
            pieces = kids.get(n["node"], [])
            said = {"lineBreak": "\n", "tab": "\t"}
            safe = form == "docx" or all(k["local"] == "#text" or own(k, *said) for k in pieces)
            p.add("".join(k["text"] if k["local"] == "#text" else said.get(k["local"], OBJECT) if form == "hwpx" else "" for k in pieces), n, safe)
        elif form == "docx" and own(up, "r"):
            p.add("\n" if own(n, "br", "cr") else "\t" if own(n, "tab") else "")
    for n in nodes:
        n["paragraph"] = holder[n["node"]]
    return nodes, list(out.values())


def markers(text: str, illegal: str) -> list[tuple[str, int, int]]:
    found = [(m[1], m.start(), m.end()) for m in re.finditer(MARKER, text)]
    need(all(legal(name) for name, _, _ in found), illegal)
    need(not re.search(r"\{\{|\}\}", re.sub(MARKER, "", text)), "E_FIELDS")
    return found


def click_here(nodes: list[dict], paragraphs: list[Paragraph]) -> None:
    """Adds the fields that stand between a begin and an end mark of one paragraph. They may neither nest nor overlap."""
    by_node = {p.node["node"]: p for p in paragraphs}
    begins = [n for n in nodes if n["ns"] == PARAGRAPH and n["local"] == "fieldBegin"]
    ends: dict[str, list[dict]] = {}
    for n in nodes:
        if n["ns"] == PARAGRAPH and n["local"] == "fieldEnd":
            ends.setdefault(n["attrs"].get("beginIDRef", ""), []).append(n)
    for b in begins:
        if b["attrs"].get("type", "").upper() != "CLICK_HERE":
            continue
        own = [e for e in ends.get(b["attrs"].get("id") or "\0", []) if e["start"] > b["stop"]]
        need(len(own) == 1 and b["paragraph"] is not None and own[0]["paragraph"] == b["paragraph"], "E_PRESERVATION")
        need(not any(b["start"] < o["start"] < own[0]["start"] for o in begins), "E_PRESERVATION")
        p = by_node[b["paragraph"]]
        runs = [r for r in p.runs if r[0]["start"] >= b["stop"] and r[0]["stop"] <= own[0]["start"]]
        need(bool(runs) and all(r[3] for r in runs), "E_PRESERVATION")
        start, stop = runs[0][1], runs[-1][2]
        need(not any(f["stop"] > start and f["start"] < stop for f in p.fields), "E_PRESERVATION")
        need(legal(b["attrs"].get("name", "")), "E_FIELDS")
        p.fields.append({"name": b["attrs"]["name"], "start": start, "stop": stop, "runs": runs, "begin": b})


def model(body: bytes, form: str, part: str) -> tuple[list[dict], list[Paragraph]]:
    """Nodes and paragraphs with their fields. Markers where the form has no fields are refused."""
    nodes, paragraphs = paragraphs_of(body, form)
    held = bool(re.fullmatch(FIELD_PARTS[form], part))
    if form == "docx":
        for n in nodes:
            if n["local"] == "#text" and re.search(r"\{\{|\}\}", n["text"]):
                up = nodes[n["parent"]]
                need(up["ns"] == WORD and up["name"] == "w:t", "E_UNSUPPORTED")
    elif held:
        click_here(nodes, paragraphs)
    else:
        return nodes, []
    for p in paragraphs:
        text = p.text
        for f in p.fields:  # explicit fields are no text in which markers could stand
            text = text[: f["start"]] + " " * (f["stop"] - f["start"]) + text[f["stop"] :]
        for name, start, stop in markers(text, "E_UNSUPPORTED" if form == "docx" else "E_FIELDS"):
            need(held, "E_UNSUPPORTED")
            runs = [r for r in p.runs if r[2] > start and r[1] < stop]
            need(bool(runs) and all(r[3] for r in runs), "E_PRESERVATION")
            inner = lambda n: runs[0][0]["start"] < n["start"] and n["stop"] < runs[-1][0]["stop"]  # noqa: B023, E731
            need(form == "docx" or not any(inner(n) and n["local"] in ("ctrl", "tbl", "pic", "fieldBegin", "fieldEnd") for n in nodes), "E_PRESERVATION")
            p.fields.append({"name": name, "start": start, "stop": stop, "runs": runs, "begin": None})
    return nodes, paragraphs


def field_parts(parts: dict[str, bytes], form: str) -> list[tuple[str, list[dict], list[Paragraph]]]:
    """The parts that hold fields or could, sections by number."""
    number = lambda name: int((re.findall(r"\d+", name) or ["0"])[0])
    names = [n for n in parts if n.endswith(".xml") and (form == "docx" or re.fullmatch(FIELD_PARTS[form], n))]
    names.sort(key=(lambda n: 0) if form == "docx" else number)
    return [(n, *model(parts[n], form, n)) for n in names]


def expected(p: Paragraph, values: dict[str, str]) -> str:
    """The text of a paragraph when its fields are filled."""
    out, at = [], 0
    for f in sorted(p.fields, key=lambda f: f["start"]):
        out += [p.text[at : f["start"]], re.sub(r"\r\n?", "\n", values[f["name"]])]
        at = f["stop"]
    return "".join([*out, p.text[at:]])


def filled_part(body: bytes, form: str, nodes: list[dict], paragraphs: list[Paragraph], values: dict[str, str]) -> bytes:
    """Markers may span runs: the first takes the value, the others lose their part. Values are never searched for markers."""
    edits = []
    for p in paragraphs:
        if not p.fields:
            continue
        for node, start, stop, _ in p.runs:
            own = sorted((f for f in p.fields if any(r[0] is node for r in f["runs"])), key=lambda f: f["start"])
            if not own:
                continue
            text, at = [], start
            for f in own:
                text += [p.text[at : max(at, f["start"])], values[f["name"]] if f["runs"][0][0] is node else ""]
                at = min(f["stop"], stop)
            edits.append((node["start"], node["stop"], element(body, node, re.sub(r"\r\n?", "\n", "".join([*text, p.text[at:stop]])), form)))
        for f in p.fields:
            if f["begin"]:
                edits.append((f["begin"]["start"], f["begin"]["open_end"], attribute(body[f["begin"]["start"] : f["begin"]["open_end"]], "dirty", "1")))
        # what was laid out for the old text
        edits += [(n["start"], n["stop"], b"") for n in nodes if n["local"] == "linesegarray" and n["paragraph"] == p.node["node"]]
    return spliced(body, edits)


# The order in which the schema wants the properties of a paragraph and of a row, and what keeps a paragraph from being split.
ORDER = {
    "pPr": "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange".split(),
    "trPr": "cnfStyle divId gridBefore gridAfter wBefore wAfter cantSplit trHeight tblHeader tblCellSpacing jc hidden ins del trPrChange".split(),
}
UNSPLIT = {"numPr", "outlineLvl", "sectPr", "framePr", "pPrChange", "rPrChange", "ins", "del", "moveFrom", "moveTo"}
RUN_PARTS = {"rPr", "t", "br", "cr", "tab", "lastRenderedPageBreak"}
#: Stands for a line end of a value, which no text may hold.
END = "\0"


class Tree:
    """Children of the elements of a part."""

    def __init__(self, nodes: list[dict]):
        self.nodes, self.kids = nodes, {}
        for n in nodes:
            if n["local"] != "#text":
                self.kids.setdefault(n["parent"], []).append(n)

    def children(self, node: dict, local: str | None = None) -> list[dict]:
        return [k for k in self.kids.get(node["node"], []) if local is None or (k["ns"] == WORD and k["local"] == local)]

    def above(self, node: dict, local: str) -> dict | None:
        while node["parent"] is not None:
            node = self.nodes[node["parent"]]
            if node["ns"] == WORD and node["local"] == local:
                return node
        return None

    def below(self, node: dict) -> list[dict]:
        return [n for n in self.nodes[node["node"] :] if n["start"] < node["stop"] and n["local"] != "#text"]


def with_properties(body: bytes, tree: Tree, owner: dict, kind: str, updates: dict[str, dict[str, str]]) -> tuple[int, int, bytes]:
    """An edit that gives an element's property container these properties: set in place, or put in where the schema wants them."""
    found = tree.children(owner, kind)
    need(len(found) < 2, "E_LAYOUT")
    new = {k: f"<w:{k}" + "".join(f' {a}="{v}"' for a, v in attrs.items()) + "/>" for k, attrs in updates.items()}
    rank = ORDER[kind].index
    if not found:
        first = tree.children(owner, "tblPrEx") if kind == "trPr" else []
        at = first[0]["stop"] if first else owner["open_end"]
        return at, at, f"<w:{kind}>{''.join(new[k] for k in sorted(new, key=rank))}</w:{kind}>".encode()
    box = found[0]
    edits = []
    own = tree.children(box)
    for k in sorted(new, key=rank):
        same = [c for c in own if c["ns"] == WORD and c["local"] == k]
        need(len(same) < 2, "E_LAYOUT")
        if same:
            tag = body[same[0]["start"] : same[0]["open_end"]]
            for a, v in updates[k].items():
                tag = attribute(tag, a, v)
            edits.append((same[0]["start"], same[0]["open_end"], tag))
        else:
            later = [c["start"] for c in own if c["local"] in ORDER[kind] and rank(c["local"]) > rank(k)]
            edits.append((later[0] if later else box["close_start"], None, new[k].encode()))
    if box["stop"] == box["open_end"]:  # it closes itself
        opening = re.sub(rb"\s*/\s*>$", b">", body[box["start"] : box["open_end"]])
        return box["start"], box["stop"], opening + b"".join(e[2] for e in edits) + f"</{box['name']}>".encode()
    put: dict[int, bytes] = {}
    for at, stop, text in edits:
        if stop is None:
            put[at] = put.get(at, b"") + text
    inner = [(at - box["start"], at - box["start"], text) for at, text in put.items()] + [(a - box["start"], b - box["start"], text) for a, b, text in edits if b is not None]
    return box["start"], box["stop"], spliced(body[box["start"] : box["stop"]], inner)


def flowed_paragraph(body: bytes, tree: Tree, p: Paragraph, values: dict[str, str]) -> tuple[list[tuple[int, int, bytes]], int]:
    """Edits that fill a paragraph whose text may run on to other pages, and how many paragraphs it becomes: one for each line of its values. What stands before
    the first value stays in the first one, what stands after the last in the last; runs keep their properties."""
    node, up = p.node, tree.nodes[p.node["parent"]]
    table = tree.above(node, "tbl")
    home = up["local"] == "tc" and tree.nodes[table["parent"]]["local"] == "body" if table else up["local"] == "body"
    need(up["ns"] == WORD and home and not (table and tree.above(table, "tbl")), "E_LAYOUT")
    texts = {}
    for run, start, stop, _ in p.runs:
        own = sorted((f for f in p.fields if any(r[0] is run for r in f["runs"])), key=lambda f: f["start"])
        if own:
            out, at = [], start
            for f in own:
                value = re.sub(r"\r\n?|\n", END, values[f["name"]]) if f["runs"][0][0] is run else ""
                out += [p.text[at : max(at, f["start"])], value]
                at = min(f["stop"], stop)
            texts[run["node"]] = "".join([*out, p.text[at:stop]])
    off = {"w:val": "0"}
    edits = []
    if table:
        row = tree.above(node, "tr")
        height = [h for c in tree.children(row, "trPr") for h in tree.children(c, "trHeight")]
        more = {"trHeight": {"w:hRule": "atLeast"}} if height and height[0]["attrs"].get("w:hRule") == "exact" else {}
        edits.append(with_properties(body, tree, row, "trPr", {"cantSplit": off} | more))
    if not any(END in x for x in texts.values()):
        edits += [(tree.nodes[k]["start"], tree.nodes[k]["stop"], element(body, tree.nodes[k], x, "docx")) for k, x in texts.items()]
        return [*edits, with_properties(body, tree, node, "pPr", {"keepNext": off, "keepLines": off})], 1
    need(not any(n["ns"] == WORD and n["local"] in UNSPLIT for n in tree.below(node)), "E_LAYOUT")
    need(all(c["ns"] == WORD and c["local"] in ("pPr", "r") for c in tree.children(node)), "E_LAYOUT")
    made: list[list[bytes]] = [[]]
    for run in tree.children(node, "r"):
        need(all(c["ns"] == WORD and c["local"] in RUN_PARTS for c in tree.children(run)), "E_LAYOUT")
        segments = [b""]
        for c in tree.children(run):
            if c["local"] in ("rPr", "lastRenderedPageBreak"):
                continue
            if c["node"] not in texts:
                segments[-1] += body[c["start"] : c["stop"]]
                continue
            first, *rest = texts[c["node"]].split(END)
            segments[-1] += element(body, c, first, "docx")
            segments += [element(body, c, x, "docx") for x in rest]
        opening = re.sub(rb"\s*/\s*>$", b">", body[run["start"] : run["open_end"]]) + b"".join(body[c["start"] : c["stop"]] for c in tree.children(run, "rPr"))
        for i, segment in enumerate(segments):
            if i:
                made.append([])
            made[-1].append(opening + segment + f"</{run['name']}>".encode())
    opening = body[node["start"] : node["open_end"]]
    later = re.sub(rb"\s[A-Za-z0-9]+:(paraId|textId)\s*=\s*(\"[^\"]*\"|'[^']*')", b"", opening)
    first_properties = with_properties(body, tree, node, "pPr", {"keepNext": off, "keepLines": off})[2]
    later_properties = with_properties(body, tree, node, "pPr", {"keepNext": off, "keepLines": off, "pageBreakBefore": off})[2]
    close = f"</{node['name']}>".encode()
    whole = b"".join((later if i else opening) + (later_properties if i else first_properties) + b"".join(runs) + close for i, runs in enumerate(made))
    return [*edits, (node["start"], node["stop"], whole)], len(made)


def flowed_part(body: bytes, nodes: list[dict], paragraphs: list[Paragraph], values: dict[str, str]) -> tuple[bytes, list[int]]:
    """The filled part, and how many paragraphs each paragraph became. Rows that hold several fields are changed once."""
    tree, edits, counts = Tree(nodes), {}, []
    for p in paragraphs:
        own, n = flowed_paragraph(body, tree, p, values) if p.fields else ([], 1)
        edits |= {e[:2]: e for e in own}
        counts.append(n)
    return spliced(body, list(edits.values())), counts


def attribute(tag: bytes, name: str, value: str) -> bytes:
    """An opening tag with an attribute set in place, or added."""
    new, n = re.subn(rb"(\s" + name.encode() + rb"\s*=\s*)(\"[^\"]*\"|'[^']*')", lambda m: m[1] + b'"' + value.encode() + b'"', tag, count=1)
    return new if n else re.sub(rb"\s*(/?>)$", lambda m: b" " + name.encode() + b'="' + value.encode() + b'"' + m[1], tag)


def element(body: bytes, node: dict, text: str, form: str) -> bytes:
    """A text element with a new text, its line ends and tabs as elements."""
    opening = re.sub(rb"\s*/\s*>$", b">", body[node["start"] : node["open_end"]])
    name, prefix = node["name"], node["name"][: -len(node["local"])]
    if form == "docx":
        opening = attribute(opening, "xml:space", "preserve")
        put = lambda what: f"</{name}><{prefix}{what}/>" + opening.decode()
        broken = escape(text).replace("\n", put("br")).replace("\t", put("tab"))
    else:
        broken = escape(text).replace("\n", f"<{prefix}lineBreak/>").replace("\t", f"<{prefix}tab/>")
    return opening + broken.encode() + f"</{name}>".encode()


def fill_package(content: bytes | None, values: dict[str, str], form: str, flow: bool = False) -> tuple[bytes | None, str | None]:
    """The filled package, or a code. The result is opened and read again: every paragraph must be what it should, other parts the same bytes.
    With flow, text may run on to other pages, and each line of a value is a paragraph (word-processing packages only)."""
    try:
        need(not flow or form == "docx", "E_LAYOUT")
        parts = open_package(content, form)
        models = field_parts(parts, form)
        names = {f["name"] for _, _, ps in models for p in ps for f in p.fields}
        need(bool(names) and all(isinstance(values.get(n), str) for n in names) and set(values) <= names, "E_FIELDS")
        need(not any(re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", values[n]) for n in names), "E_FIELDS")
        new, counts = {}, {}
        for name, nodes, ps in models:
            if any(p.fields for p in ps):
                need(not flow or name == "word/document.xml", "E_LAYOUT")
                new[name], counts[name] = flowed_part(parts[name], nodes, ps, values) if flow else (filled_part(parts[name], form, nodes, ps, values), [1] * len(ps))
        out = write_archive([(n, new.get(n, b)) for n, b in parts.items()])
        again = open_package(out, form)
        need(set(again) == set(parts) and all(again[n] == b for n, b in parts.items() if n not in new), "E_PRESERVATION")
        for name, _, ps in models:
            if name in new:
                got = iter([p.text for p in paragraphs_of(again[name], form)[1]])
                need(all("\n".join(x for _, x in zip(range(n), got, strict=False)) == expected(p, values) for p, n in zip(ps, counts[name], strict=True)) and next(got, None) is None, "E_PRESERVATION")
        return out, None
    except Refused as e:
        return None, e.args[0]
    except UnicodeError:
        return None, "E_INPUT"


FIELDS = "array<struct<name:string,start:int,stop:int,explicit:boolean>>"


def package_rows(docs: DataFrame) -> DataFrame:
    """path, part, part_no, para_no, text, fields, error of packages (path, format, content): one row a paragraph, or one with the error."""

    def rows(path: str, form: str, content: bytes | None) -> list[tuple]:
        try:
            models = field_parts(open_package(content, form), form)
        except Refused as e:
            return [(path, None, None, None, None, None, e.args[0])]
        return [(path, name, i, k, p.text, [{"name": f["name"], "start": f["start"], "stop": f["stop"], "explicit": f["begin"] is not None} for f in sorted(p.fields, key=lambda f: f["start"])], None) for i, (name, _, ps) in enumerate(models) for k, p in enumerate(ps)] or [(path, None, None, None, None, None, None)]

    field = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("explicit", pa.bool_())]))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), field, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, form, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                out += rows(path, form, content.as_py())
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate(kinds)], NAMES)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate(kinds)], NAMES)

    return docs.filter("format in ('docx', 'hwpx')").select("path", "format", "content").mapInArrow(run, f"path string, part string, part_no int, para_no int, text string, fields {FIELDS}, error string")


NAMES = ["path", "part", "part_no", "para_no", "text", "fields", "error"]


def fill_packages(docs: DataFrame, values: DataFrame) -> DataFrame:
    """path, filled, error of packages (path, format, content) and their values (path, values map, flow if there is such a column). A package without
    values has error E_FIELDS."""
    none = F.create_map().cast("map<string,string>")
    flow = F.coalesce("flow", F.lit(False)) if "flow" in values.columns else F.lit(False)
    own = values.select("path", "values", flow.alias("flow"))
    # a package costs far more time than bytes: its work is spread by number, not by size
    both = spread(docs.select("path", "format", "content"), "path").join(own, "path", "left").select("path", "format", "content", F.coalesce("values", none).alias("values"), F.coalesce("flow", F.lit(False)).alias("flow"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for path, form, content, v, flow in zip(*batch.columns, strict=True):
                out.append((path.as_py(), *fill_package(content.as_py(), dict(v.as_py()), form.as_py(), flow.as_py())))
                held += len(out[-1][1] or b"")
                if held > 16 << 20:
                    yield packed(out)
                    out, held = [], 0
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate((pa.string(), pa.binary(), pa.string()))], ["path", "filled", "error"])

    return both.mapInArrow(run, "path string, filled binary, error string")


# A package with one body, for tests and for templates that are made from a table.
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'


def simple_package(lines: list[str], form: str, body: str | None = None) -> bytes:
    """A package of one paragraph a line (or with this body)."""
    if form == "docx":
        inner = body if body is not None else "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
        return write_archive([("[Content_Types].xml", TYPES.encode()), ("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{inner}</w:body></w:document>'.encode())])
    inner = body if body is not None else "".join(f"<hp:p><hp:run><hp:t>{escape(x)}</hp:t></hp:run></hp:p>" for x in lines)
    return write_archive([("mimetype", b"application/hwp+zip"), ("Contents/section0.xml", f'<hs:sec xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="{PARAGRAPH}">{inner}</hs:sec>'.encode())])


def make_packages(docs: DataFrame, dealt: bool = False) -> DataFrame:
    """path, format, content of packages made from rows (path, format, and lines, or body: the markup within the part's root). dealt: the rows are dealt to tasks already, so that markup needn't be
    shuffled."""
    inner = "body" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            made = [simple_package([], form, said or "") if inner else simple_package([x or "" for x in said or []], form) for form, said in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["path", "format", "content"])

    rows = docs.select("path", "format", "body" if inner else "lines")
    return (rows if dealt else spread(rows, "path")).mapInArrow(run, "path string, format string, content binary")
