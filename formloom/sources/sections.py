"""The tables of sections as rows, with the places of their rows, cells and texts: one pass over a part's markup, of which nothing but what stands in tables is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from formloom.sources.containers import PARAGRAPH
from formloom.sources.markup import Refused, walk
from formloom.sources.packages import OBJECT

SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
TEXT = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("name", pa.string())])
RUN = pa.struct([*TEXT, ("texts", pa.list_(TEXT))])
NUMBERS = ("row_addr", "col_addr", "addr_start", "addr_end", "row_span", "col_span", "width", "height")
CELL = pa.struct([("start", pa.int32()), ("open_end", pa.int32()), ("border", pa.string()), *[(c, pa.int32()) for c in NUMBERS], ("text", pa.string()), ("runs", pa.list_(RUN)), ("lines", pa.list_(SPAN))])
ROW = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cells", pa.list_(CELL))])
ATTRIBUTES = pa.map_(pa.string(), pa.string())
#: An element within a table: how many of them there are, and where the first is.
CHILD = pa.struct([("n", pa.int32()), ("start", pa.int32()), ("open_end", pa.int32()), ("attrs", ATTRIBUTES)])
TABLE = pa.schema([
    ("path", pa.string()), ("part", pa.string()), ("table", pa.int32()), ("table_id", pa.string()), ("up", pa.string()), ("nested", pa.bool_()), ("start", pa.int32()), ("open_end", pa.int32()), ("size", pa.int32()),
    ("attrs", ATTRIBUTES), ("sz", CHILD), ("pos", CHILD), ("around", pa.list_(SPAN)), ("rows", pa.list_(ROW)),
])
TABLES = (
    "path string, part string, table int, table_id string, up string, nested boolean, start int, open_end int, size int, attrs map<string,string>, "
    + "".join(f"{c} struct<n:int,start:int,open_end:int,attrs:map<string,string>>, " for c in ("sz", "pos"))
    + "around array<struct<start:int,stop:int>>, rows array<struct<start:int,stop:int,cells:array<struct<start:int,open_end:int,border:string,"
    + "".join(f"{c}:int," for c in NUMBERS)
    + "text:string,runs:array<struct<start:int,stop:int,name:string,texts:array<struct<start:int,stop:int,name:string>>>>,lines:array<struct<start:int,stop:int>>>>>>"
)
#: Breaks within a text.
SAID = {"lineBreak": "\n", "tab": "\t"}
#: Tables that are packed at once, about: by their cells.
CELLS = 2_000


def whole(node: dict, name: str) -> int | None:
    value = node["attrs"].get(name, "")
    return int(value) if re.fullmatch("[0-9]{1,9}", value) else None


class Scan:
    """What is open at a place: of each element its kind and what is kept of it, and the innermost table, cell and paragraph."""

    def __init__(self):
        self.tables: list[dict] = []
        #: kind, what is kept, local name; the table, cell and paragraph around it
        self.open: list[tuple] = [(None, None, None, None, None, None)]
        self.table = self.cell = self.p = None

    def entered(self, n: dict) -> None:
        kind = n["local"] if n["ns"] == PARAGRAPH else None
        up, held, name, *_ = self.open[-1]
        around, mine = (self.table, self.cell, self.p), None
        if kind == "p":
            self.p = mine = {"up": name, "said": [], "lines": []}
            if self.cell:
                self.cell["ps"].append(mine)
        elif kind == "run":
            if self.cell:
                self.cell["runs"].append(mine := {"texts": []})
        elif kind == "t":
            if up == "run" and held:
                held["texts"].append(n)
        elif kind == "tc":
            self.cell = mine = {"ps": [], "runs": [], "lines": []}
            if up == "tr" and held:
                held["cells"].append(mine)
        elif kind in ("cellAddr", "cellSpan", "cellSz"):
            if up == "tc":
                held.setdefault(kind, n)
        elif kind == "linesegarray":
            if self.cell:
                self.cell["lines"].append(n)
            if up == "p":
                held["lines"].append(n)
        elif kind == "tr":
            if up == "tbl":
                held["rows"].append(mine := {"cells": []})
        elif kind in ("sz", "pos"):
            if up == "tbl":
                held[kind].append(n)
        elif kind == "tbl":
            mine = {"n": n, "p": self.p, "nested": self.table is not None, "sz": [], "pos": [], "rows": []}
            if self.table:
                self.table["nested"] = True
            self.tables.append(mine)
            self.table, self.cell = mine, None
        if up == "t" and self.p:
            self.p["said"].append(SAID.get(kind, OBJECT))
        self.open.append((kind, mine, n["local"], *around))

    def said(self, n: dict) -> None:
        if self.open[-1][0] == "t" and self.p:
            self.p["said"].append(n)

    def left(self, n: dict) -> None:
        """Of what has ended, places and texts stay."""
        kind, mine, _, self.table, self.cell, self.p = self.open.pop()
        if mine is None:
            return
        if kind == "p":
            mine["said"] = "".join([x if isinstance(x, str) else x["text"] for x in mine["said"]])
        elif kind == "run":
            mine |= {"start": n["start"], "stop": n["stop"], "name": n["name"], "texts": [{"start": t["start"], "stop": t["stop"], "name": t["name"]} for t in mine["texts"]]}
        elif kind == "tr":
            mine |= {"start": n["start"], "stop": n["stop"]}
        elif kind == "tc":
            ps = mine.pop("ps")
            mine |= {"start": n["start"], "open_end": n["open_end"], "border": n["attrs"].get("borderFillIDRef"), "text": "\n".join([p["said"] for p in ps]) if ps else None, "lines": spans(mine["lines"])}
            if addr := mine.pop("cellAddr", None):
                mine |= {"row_addr": whole(addr, "rowAddr"), "col_addr": whole(addr, "colAddr"), "addr_start": addr["start"], "addr_end": addr["open_end"]}
            if span := mine.pop("cellSpan", None):
                mine |= {"row_span": whole(span, "rowSpan"), "col_span": whole(span, "colSpan")}
            if size := mine.pop("cellSz", None):
                mine |= {"width": whole(size, "width"), "height": whole(size, "height")}

    def rows(self, path: str, part: str, size: int) -> Iterator[dict]:
        child = lambda found: {"n": len(found)} | ({"start": found[0]["start"], "open_end": found[0]["open_end"], "attrs": list(found[0]["attrs"].items())} if found else {})
        for t in self.tables:
            n, p = t["n"], t["p"]
            yield {
                "path": path, "part": part, "table": n["node"], "table_id": n["attrs"].get("id"), "up": p and p["up"], "nested": t["nested"], "start": n["start"], "open_end": n["open_end"], "size": size,
                "attrs": list(n["attrs"].items()), "sz": child(t["sz"]), "pos": child(t["pos"]), "around": spans(p["lines"]) if p else [], "rows": t["rows"],
            }


def spans(nodes: list[dict]) -> list[dict]:
    return [{"start": n["start"], "stop": n["stop"]} for n in nodes]


def table_rows(parts: DataFrame) -> DataFrame:
    """TABLES of parts (path, part, body): one row a table, with its rows and their cells, so that a row is bounded by its part. Malformed parts have none.

    table: the number of its node; up: what the paragraph around it stands in; nested: whether it stands in a table or holds one; size: the part's bytes; around: laid-out lines of the paragraph around
    it. A cell has the texts of its paragraphs, joined by line ends (null without any), its runs with their text elements, and its laid-out lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for path, part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                scan, body = Scan(), body.as_py() or b""
                try:
                    walk(body, scan.entered, scan.left, scan.said)
                except Refused:
                    continue
                for row in scan.rows(path, part, len(body)):
                    out.append(row)
                    held += sum(len(r["cells"]) for r in row["rows"])
                    if held > CELLS:
                        yield pa.RecordBatch.from_pylist(out, TABLE)
                        out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, TABLE)

    return parts.select("path", "part", "body").mapInArrow(run, TABLES)
