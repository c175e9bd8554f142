"""XML with the places of its elements in the source, so that parts can be changed without touching any other byte. A parser that
knows no document types reads it; elements and texts become rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

#: A tag, with its quoted attributes.
TAG = re.compile(rb"""<(?:[^'">]++|"[^"]*"|'[^']*')*+>""")
NODES = "path string, part string, node int, parent int, depth int, name string, local string, ns string, attrs map<string,string>, start int, open_end int, close_start int, stop int, text string"


class Refused(ValueError):
    """The argument is the error code."""


def has_doctype(body: bytes) -> bool:
    """A document type or entity, in whatever encoding the part is and wherever it stands."""
    found = []
    if b"<!doctype" in (low := body.lower()) or b"<!entity" in low:
        return True
    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler = lambda *a: found.append(a)
    parser.EntityDeclHandler = lambda *a: found.append(a)
    try:
        parser.Parse(body, True)
    except expat.ExpatError:
        pass  # malformed parts are found by those who read them
    return bool(found)


#: Rows that are packed at once.
ROWS = 20_000


def nodes_of(body: bytes) -> list[dict]:
    """Elements (with name, attributes and places) and texts (local `#text`) of a part in the order of the source, places in bytes of UTF-8."""
    return sorted(ended_nodes(body, None), key=lambda n: n["node"])


def ended_nodes(body: bytes, pack: Callable[[list[dict]], None] | None) -> list[dict]:
    """The same nodes in the order in which they end. Of a large part, pack gets them whenever there are ROWS of them, and what is left is returned: dicts take far more memory than what is packed."""
    done: list[dict] = []

    def left(node: dict) -> None:
        nonlocal done
        done.append(node)
        if pack and len(done) >= ROWS:
            pack(done)
            done = []

    walk(body, lambda node: None, left, lambda node: done.append(node))
    return done


def walk(body: bytes, entered: Callable[[dict], None], left: Callable[[dict], None], said: Callable[[dict], None]) -> None:
    """Hands over the nodes of a part: elements when they open (not yet knowing where they end) and when they have ended, texts when they begin (more may be added to them until the next node)."""
    last: dict | None = None
    count = 0
    stack: list[dict] = []
    spaces: list[dict] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes, parser.buffer_text = 1, True

    def refuse(*_):
        raise Refused("E_UNSUPPORTED")

    def opened(name: str, attributes: list[str]) -> None:
        nonlocal last, count
        attrs = dict(zip(attributes[::2], attributes[1::2], strict=True))
        own = {k[6:] if k != "xmlns" else "": v for k, v in attrs.items() if k[:5] == "xmlns" and k[5:6] in ("", ":")}
        spaces.append(spaces[-1] | own if own else spaces[-1])
        prefix, _, local = name.rpartition(":")
        at = parser.CurrentByteIndex
        end = TAG.match(body, at).end()
        node = {"node": count, "parent": stack[-1]["node"] if stack else None, "depth": len(stack), "name": name, "local": local, "ns": spaces[-1].get(prefix, ""), "attrs": attrs, "start": at, "open_end": end, "close_start": end, "stop": end, "text": None}
        last, count = node, count + 1
        stack.append(node)
        entered(node)

    def closed(_: str) -> None:
        node, at = stack.pop(), parser.CurrentByteIndex
        spaces.pop()
        if body[node["open_end"] - 2 : node["open_end"]] != b"/>":  # of what closes itself, the parser gives the place after it
            node["close_start"], node["stop"] = at, body.index(b">", at) + 1
        left(node)

    def characters(text: str) -> None:
        nonlocal last, count
        if stack:
            if last["local"] == "#text" and last["parent"] == stack[-1]["node"]:
                last["text"] += text
            else:
                at = parser.CurrentByteIndex
                last = {"node": count, "parent": stack[-1]["node"], "depth": len(stack), "name": "#text", "local": "#text", "ns": "", "attrs": {}, "start": at, "open_end": at, "close_start": at, "stop": at, "text": text}
                count += 1
                said(last)

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, characters
    try:
        body = body.removeprefix(b"\xef\xbb\xbf")
        parser.Parse(body, True)
    except (expat.ExpatError, UnicodeDecodeError, ValueError) as e:
        raise Refused(e.args[0] if isinstance(e, Refused) else "E_INPUT") from None


def node_rows(parts: DataFrame) -> DataFrame:
    """NODES and error of parts (path, part, body): one row a node; a malformed part gives one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                large: list[pa.RecordBatch] = []
                mine = lambda nodes: [(path, part, *n.values(), None) for n in nodes]  # noqa: B023, E731
                try:
                    rest = ended_nodes(body.as_py() or b"", lambda nodes: large.append(packed(mine(nodes))))  # noqa: B023
                    rows += mine(sorted(rest, key=lambda n: n["node"]))
                    yield from large  # all of the part is sound
                except Refused as e:
                    rows.append((path, part, *[None] * 12, e.args[0]))
                if len(rows) > ROWS:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 3, *[pa.string()] * 3, pa.map_(pa.string(), pa.string()), *[pa.int32()] * 4, pa.string(), pa.string()]
        columns = [pa.array([list(r[k].items()) if k == 8 and r[k] is not None else r[k] for r in rows], x) for k, x in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODES.split(", ")] + ["error"])

    return parts.select("path", "part", "body").mapInArrow(run, NODES + ", error string")


def spliced(body: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """body with the edits (start, stop, replacement); they may not overlap or leave it."""
    out, at = [], 0
    for start, stop, new in sorted(edits, key=lambda e: e[:2]):
        if not at <= start <= stop <= len(body):
            raise Refused("E_PRESERVATION")
        out += [body[at:start], new]
        at = stop
    return b"".join([*out, body[at:]])
