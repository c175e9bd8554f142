"""Forms in PDF files: objects of the file, entries that it may not hold, and its fields with their widgets as rows. No pages are drawn."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from formloom.sources.containers import MAX_ENTRY, Refused, need

# Limits, and the bits of a field's and a widget's flags.
MAX_OBJECTS, MAX_DEPTH = 100_000, 64
#: Rows that are packed at once.
ROWS = 20_000
READ_ONLY, MULTILINE, PASSWORD, FILE, COMB, RICH, PUSH, HIDDEN = 1, 1 << 12, 1 << 13, 1 << 20, 1 << 24, 1 << 25, 1 << 16, 3

WHITE = rb"[\x00\t\n\f\r ]"
SPACE = re.compile(rb"(?:" + WHITE + rb"|%[^\r\n]*)*")
WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]*")
REFERENCE = re.compile(rb"(\d+)" + WHITE + rb"+(\d+)" + WHITE + rb"+R(?![A-Za-z0-9])")
OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})" + WHITE + rb"+(\d{1,5})" + WHITE + rb"+obj")


class Name(str):
    """A name, without its slash."""


@lru_cache(4096)
def name_of(word: bytes) -> Name:
    """The names of a file are few, and one object for each is enough."""
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word).decode("latin-1"))


class Ref(int):
    """The number of an object."""


class Reader:
    """Values of PDF syntax from a place in some bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def blank(self) -> None:
        self.at = SPACE.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        need(depth < MAX_DEPTH, "E_INPUT")
        self.blank()
        d, c = self.data, self.data[self.at : self.at + 1]
        if d[self.at : self.at + 2] == b"<<":
            return self.dictionary(depth)
        if c == b"/":
            word = WORD.match(d, self.at + 1)
            self.at = word.end()
            return name_of(word[0])
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.blank()
                need(self.at < len(d), "E_INPUT")
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if c == b"(":
            return self.text()
        if c == b"<":
            end = d.find(b">", self.at)
            digits = re.sub(WHITE, b"", d[self.at + 1 : end])
            need(end > 0 and bool(re.fullmatch(rb"[0-9A-Fa-f]*", digits)), "E_INPUT")
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if ref := REFERENCE.match(d, self.at):
            self.at = ref.end()
            return Ref(ref[1])
        word = WORD.match(d, self.at)
        need(bool(word[0]), "E_INPUT")
        self.at = word.end()
        return {b"true": True, b"false": False, b"null": None}.get(word[0], number(word[0]))

    def dictionary(self, depth: int) -> dict:
        self.at += 2
        out = {}
        while True:
            self.blank()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.value(depth + 1)
            need(isinstance(key, Name), "E_INPUT")
            out[key] = self.value(depth + 1)

    def text(self) -> bytes:
        out, nesting, d = bytearray(), 1, self.data
        self.at += 1
        escapes = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
        while nesting:
            need(self.at < len(d), "E_INPUT")
            c = d[self.at]
            self.at += 1
            if c == 92:
                octal = re.match(rb"[0-7]{1,3}", d[self.at : self.at + 3])
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at += octal.end()
                else:
                    if d[self.at : self.at + 1] not in (b"\r", b"\n"):
                        out.append(escapes.get(d[self.at], d[self.at]) if self.at < len(d) else 0)
                    self.at += 1
                continue
            nesting += (c == 40) - (c == 41)
            if nesting:
                out.append(c)
        return bytes(out)


def number(word: bytes):
    try:
        return int(word)
    except ValueError:
        try:
            return float(word)
        except ValueError:
            return Name("?" + word.decode("latin-1"))


def string(v) -> str | None:
    if not isinstance(v, bytes):
        return None
    return v[2:].decode("utf-16-be", "replace") if v[:2] == b"\xfe\xff" else v.decode("latin-1")


class File:
    """The objects of a file; the last definition of a number holds."""

    def __init__(self, data: bytes | None):
        data = data or b""
        need(data[:5] == b"%PDF-" and bool(re.search(rb"%%EOF\s*\Z", data[-1024:])), "E_INPUT")
        self.objects: dict[int, object] = {}
        self.trailers = []
        packed = []
        for m in OBJECT.finditer(data):
            r = Reader(data, m.end())
            try:
                v = r.value()
            except (Refused, IndexError, ValueError):
                continue  # what looks like an object inside of a stream
            self.objects[int(m[1])] = v
            need(len(self.objects) <= MAX_OBJECTS, "E_UNSUPPORTED")
            if isinstance(v, dict) and v.get("Type") in ("ObjStm", "XRef"):
                r.blank()
                start = re.compile(rb"stream\r?\n").match(data, r.at)
                if v["Type"] == "XRef":
                    self.trailers.append(v)
                elif start:
                    packed.append((v, data[start.end() : data.find(b"endstream", start.end())]))
        for v, body in packed:
            self.unpack(v, body)
        for m in re.finditer(rb"trailer", data):
            try:
                v = Reader(data, m.end()).value()
            except (Refused, IndexError, ValueError):
                continue
            if isinstance(v, dict):
                self.trailers.append(v)
        need(bool(self.trailers), "E_INPUT")
        need(not any("Encrypt" in t for t in self.trailers), "E_UNSUPPORTED")
        self.root = self.get(next((t["Root"] for t in reversed(self.trailers) if "Root" in t), None))
        need(isinstance(self.root, dict), "E_INPUT")

    def unpack(self, v: dict, body: bytes) -> None:
        if v.get("Filter") in ("FlateDecode", ["FlateDecode"]):
            worker = zlib.decompressobj()
            try:
                body = worker.decompress(body, MAX_ENTRY + 1)
            except zlib.error:
                raise Refused("E_INPUT") from None
            need(len(body) <= MAX_ENTRY, "E_INPUT")
        n, first = v.get("N"), v.get("First")
        need(isinstance(n, int) and isinstance(first, int), "E_INPUT")
        head = Reader(body)
        places = [(head.value(), head.value()) for _ in range(n)]
        for k, at in places:
            need(isinstance(k, int) and isinstance(at, int), "E_INPUT")
            self.objects.setdefault(k, Reader(body, first + at).value())
            need(len(self.objects) <= MAX_OBJECTS, "E_UNSUPPORTED")

    def get(self, v):
        for _ in range(MAX_DEPTH):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(int(v))
        raise Refused("E_INPUT")

    def pages(self) -> list[tuple[int, dict]]:
        out, seen = [], set()
        todo = [self.root.get("Pages")]
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref):
                need(int(ref) not in seen, "E_INPUT")
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += reversed(kids)
            else:
                out.append((int(ref) if isinstance(ref, Ref) else 0, node))
        return out

    def entries(self) -> Iterator[tuple[int, str, str | None, bool]]:
        """object, key, the value where it is a name, and whether the dictionary is a signature field without a value."""
        for k, v in self.objects.items():
            todo = [(v, 0)]
            while todo:
                x, depth = todo.pop()
                need(depth < MAX_DEPTH, "E_INPUT")
                if isinstance(x, list):
                    todo += [(y, depth + 1) for y in x]
                elif isinstance(x, dict):
                    empty = x.get("FT") == "Sig" and self.get(x.get("V")) is None
                    for key, y in x.items():
                        yield k, str(key), str(y) if isinstance(y, Name) else None, empty
                        todo.append((y, depth + 1))

    def fields(self) -> Iterator[dict]:
        """Fields of the form with their widgets, the pages that show them and their flags."""
        shown: dict[int, list[int]] = {}
        for no, (_, page) in enumerate(self.pages(), 1):
            for a in self.get(page.get("Annots")) or []:
                if isinstance(a, Ref):
                    shown.setdefault(int(a), []).append(no)
        form = self.get(self.root.get("AcroForm"))
        todo = [(r, "", {}, 0) for r in reversed(self.get(form.get("Fields")) or [])] if isinstance(form, dict) else []
        while todo:
            ref, above, inherited, depth = todo.pop()
            node = self.get(ref)
            need(isinstance(node, dict) and depth < MAX_DEPTH, "E_INPUT")
            own = inherited | {k: self.get(node[k]) for k in ("FT", "Ff", "MaxLen", "V", "DA") if k in node}
            part = string(self.get(node.get("T")))
            name = above if part is None else f"{above}.{part}" if above else part
            kids = [k for k in self.get(node.get("Kids")) or []]
            inner = [k for k in kids if isinstance(self.get(k), dict) and "T" in self.get(k)]
            if inner:
                todo += [(k, name, own, depth + 1) for k in reversed(inner)]
                continue
            widgets = kids or [ref]
            flags = own.get("Ff") if isinstance(own.get("Ff"), int) else 0
            kind = {"Tx": "text", "Sig": "signature", "Ch": "choice"}.get(own.get("FT"), "checkbox" if own.get("FT") == "Btn" and not flags & (PUSH | 1 << 15) else "button")
            places, visible, rect = set(), True, None
            for w in widgets:
                d = self.get(w)
                box = [self.get(x) for x in self.get(d.get("Rect")) or []]
                at = shown.get(int(w), []) if isinstance(w, Ref) else []
                sound = len(box) == 4 and all(isinstance(x, (int, float)) for x in box) and box[2] > box[0] and box[3] > box[1]
                hidden = d.get("F") if isinstance(d.get("F"), int) else 0
                visible = visible and bool(at) and sound and not hidden & HIDDEN
                rect = rect or ([float(x) for x in box] if sound else None)
                places |= set(at)
            yield {"name": name, "kind": kind, "read_only": bool(flags & READ_ONLY), "rich": bool(flags & RICH), "password": bool(flags & PASSWORD), "file": bool(flags & FILE), "comb": bool(flags & COMB), "multiline": bool(flags & MULTILINE), "max_units": own.get("MaxLen") if isinstance(own.get("MaxLen"), int) else None, "widgets": len(widgets), "visible": visible, "pages": sorted(places), "value": string(own.get("V"))}


FIELD_ROW = "path string, no int, name string, kind string, read_only boolean, rich boolean, password boolean, file boolean, comb boolean, multiline boolean, max_units int, widgets int, visible boolean, pages array<int>, value string, error string"
ENTRY_ROW = "path string, object int, key string, value string, signature_empty boolean, error string"
TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def rows_of(docs: DataFrame, schema: str, rows) -> DataFrame:
    """Rows that a function gives for a File, or one with the error: whatever reading a damaged file raises concerns that file alone."""
    names, kinds = zip(*[(c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")], strict=True)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine: list[tuple] = []
                large: list[pa.RecordBatch] = []
                try:
                    for r in rows(File(content.as_py())):
                        mine.append((path, *r, None))
                        if len(mine) >= ROWS:
                            large.append(packed(mine))
                            mine = []
                except Exception as e:
                    large, mine = [], [(path, *[None] * (len(names) - 2), e.args[0] if isinstance(e, Refused) else "E_INPUT")]
                yield from large
                out += mine
                if len(out) > ROWS:
                    yield packed(out)
                    out = []
            yield packed(out)

    return docs.select("path", "content").mapInArrow(run, schema)


def field_rows(docs: DataFrame) -> DataFrame:
    """FIELD_ROW of files (path, content): one row a field."""
    return rows_of(docs, FIELD_ROW, lambda f: ((i, *x.values()) for i, x in enumerate(f.fields())))


def entry_rows(docs: DataFrame) -> DataFrame:
    """ENTRY_ROW of files (path, content): one row a dictionary entry. A file without pages is an error."""

    def rows(f: File) -> Iterator[tuple]:
        need(bool(f.pages()), "E_INPUT")
        yield from f.entries()

    return rows_of(docs, ENTRY_ROW, rows)


def simple_form(fields: list[tuple[str, str]], extra: str = "", catalog: str = "") -> bytes:
    """A file of one page with these fields (name, kind Tx or Btn or Sig), for tests and for templates that are made from a table."""
    refs = " ".join(f"{4 + i} 0 R" for i in range(len(fields)))
    out = bytearray(b"%PDF-1.7\n")
    put = lambda i, x: out.extend(f"{i} 0 obj\n{x}\nendobj\n".encode("latin-1"))
    for i, x in enumerate((f"<</Type/Catalog/Pages 2 0 R/AcroForm<</Fields[{refs}]>>{catalog}>>", "<</Type/Pages/Kids[3 0 R]/Count 1>>", f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 500 700]/Annots[{refs}]>>"), 1):
        put(i, x)
    for i, (name, kind) in enumerate(fields):
        said = name.encode("utf-16-be").hex()
        put(4 + i, f"<</Type/Annot/Subtype/Widget/FT/{kind}/T<feff{said}>/Rect[50 {600 - 30 * i} 150 {620 - 30 * i}]/P 3 0 R{extra}>>")
    return bytes(out) + f"trailer\n<</Root 1 0 R/Size {len(fields) + 4}>>\n%%EOF\n".encode("latin-1")


def make_forms(docs: DataFrame) -> DataFrame:
    """path, content of files made from rows (path, fields array of name and kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, fields in enumerate(batch.column(1)):
                own = list(zip(*(fields.values.field(k).to_pylist() for k in ("name", "kind")), strict=True)) if fields.is_valid else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([simple_form(own)], pa.binary())], ["path", "content"])

    return docs.select("path", "fields").mapInArrow(run, "path string, content binary")
