"""Compound word-processing files: header and stream checks, inflated sections, records, paragraphs and their fields as rows."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from formloom.functions.text import MARKER
from formloom.sources.compound import streams
from formloom.sources.containers import HWP_SECTIONS, MAX_ENTRY, MAX_TOTAL, Refused, inflated, need
from formloom.sources.packages import FIELDS, NAMES, markers

# Limits, the tags of a paragraph's records, and the two script streams that do nothing.
MAX_RECORDS, MAX_LEVEL, MAX_PARAGRAPHS, MAX_CHARACTERS = 100_000, 64, 10_000, 1_000_000
HEADER_TAG, TEXT_TAG, SHAPE_TAG, LINE_TAG = 66, 67, 68, 69
REFUSED = r"(?i)(^|/)(ViewText|DocHistory|XMLTemplate|_xmlsignatures|signatures|ObjectPool)(/|$)"
IMAGES = r"(?i)\.(png|jpe?g|gif|bmp|tiff?)$"
SCRIPTS = {"Scripts/JScriptVersion": "0100000000000000", "Scripts/DefaultJScript": "00000000000000000000000000000000ffffffff"}
RECORD = "section int, record int, tag int, level int, paragraph int, offset int, header int, data binary"


def with_trailer(body: bytes, limit: int, code: str) -> bytes:
    """Raw deflate with nothing after it, or the checksum and size of what it holds."""
    worker = zlib.decompressobj(-15)
    try:
        out = worker.decompress(body, limit + 1)
    except zlib.error:
        raise Refused(code) from None
    rest = worker.unused_data
    need(len(out) <= limit and worker.eof and (not rest or rest == struct.pack("<II", zlib.crc32(out), len(out))), code)
    return out


def container(data: bytes | None) -> tuple[dict[str, bytes], int]:
    """Streams of a file and its flags, or Refused: version, features that aren't supported, objects that aren't pictures, scripts, sizes."""
    try:
        found = streams(data or b"")
    except (ValueError, struct.error, UnicodeDecodeError):
        raise Refused("E_INPUT") from None
    own = dict(found)
    need(len(own) == len(found), "E_INPUT")
    head = own.get("FileHeader", b"")
    need(len(head) >= 40 and head[:17] == b"HWP Document File" and head[35] == 5, "E_INPUT")
    (flags,) = struct.unpack_from("<I", head, 36)
    need(not flags & ~1, "E_UNSUPPORTED")
    need(not any(re.search(REFUSED, p) for p in own), "E_UNSUPPORTED")
    need(all(re.search(IMAGES, p) for p in own if p.lower().startswith("bindata/")), "E_UNSUPPORTED")
    scripts = {p: b for p, b in own.items() if re.search(r"(?i)(^|/)Scripts(/|$)", p)}
    if scripts:
        need(flags == 1 and set(scripts) == set(SCRIPTS), "E_UNSUPPORTED")
        need(all(with_trailer(b, len(SCRIPTS[p]) // 2, "E_UNSUPPORTED").hex() == SCRIPTS[p] for p, b in scripts.items()), "E_UNSUPPORTED")
    sections = [p for p in own if re.fullmatch(HWP_SECTIONS, p)]
    need(bool(sections) and "DocInfo" in own, "E_INPUT")
    total = 0
    for p, b in own.items():
        need(len(b) <= MAX_ENTRY, "E_INPUT")
        if flags & 1 and (p in sections or p == "DocInfo"):
            own[p] = with_trailer(b, MAX_ENTRY, "E_PRESERVATION") if p == "DocInfo" else inflated(b, MAX_ENTRY)
        total += len(own[p])
        need(total <= MAX_TOTAL, "E_INPUT")
    return own, flags


def records(section: bytes) -> list[tuple[int, int, int, int, int, bytes]]:
    """tag, level, paragraph, offset, header size and payload of a record stream: 10 + 10 + 12 bits, the size 4095 has the true one after it.
    Levels rise by one at most, and every record at level 0 begins a paragraph."""
    at, out, paragraph, before = 0, [], -1, -1
    while at < len(section):
        need(len(out) < MAX_RECORDS and at + 4 <= len(section), "E_INPUT")
        (word,) = struct.unpack_from("<I", section, at)
        tag, level, size, head = word & 1023, word >> 10 & 1023, word >> 20, 4
        if size == 4095:
            need(at + 8 <= len(section), "E_INPUT")
            size, head = struct.unpack_from("<I", section, at + 4)[0], 8
        need(level <= min(MAX_LEVEL, before + 1) and at + head + size <= len(section), "E_INPUT")
        if level == 0:
            need(tag == HEADER_TAG, "E_UNSUPPORTED")
            paragraph += 1
        out.append((tag, level, paragraph, at, head, section[at + head : at + head + size]))
        before, at = level, at + head + size
    need(bool(out), "E_INPUT")
    return out


def section_number(path: str) -> int:
    return int(path.removeprefix("BodyText/Section"))


def sections(own: dict[str, bytes]) -> Iterator[tuple[int, list[tuple]]]:
    for path in sorted((p for p in own if re.fullmatch(HWP_SECTIONS, p)), key=section_number):
        yield section_number(path), records(own[path])


def text_of(data: bytes) -> str:
    return data.decode("utf-16-le", "replace").removesuffix("\r")


def record_rows(docs: DataFrame) -> DataFrame:
    """path, RECORD, error of compound files (path, content): one row a record of each section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(path, s, i, *r, None) for s, rs in sections(container(content.as_py())[0]) for i, r in enumerate(rs)]
                except Refused as e:
                    rows = [(path, *[None] * 8, e.args[0])]
                for start in range(0, len(rows), 20_000):
                    out += rows[start : start + 20_000]
                    if len(out) >= 20_000:
                        yield packed(out)
                        out = []
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int32()] * 7, pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], ["path", *[c.split()[0] for c in RECORD.split(", ")], "error"])

    return docs.select("path", "content").mapInArrow(run, f"path string, {RECORD}, error string")


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """The same rows as of packages, of compound files (path, format, content): top-level paragraphs and the fields in them, each once."""
    field = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("explicit", pa.bool_())]))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), field, pa.string())

    def rows(path: str, content: bytes | None) -> list[tuple]:
        try:
            out, total, seen = [], 0, set()
            for s, rs in sections(container(content)[0]):
                texts = {p: text_of(d) for tag, level, p, _, _, d in rs if tag == TEXT_TAG and level == 1}
                for p in range(rs[-1][2] + 1):
                    text = texts.get(p, "")
                    total += len(text)
                    need(len(out) < MAX_PARAGRAPHS and total <= MAX_CHARACTERS, "E_UNSUPPORTED")
                    found = markers(text, "E_FIELDS")
                    need(not seen & {f[0] for f in found} and len({f[0] for f in found}) == len(found), "E_PRESERVATION")
                    seen |= {f[0] for f in found}
                    out.append((path, f"BodyText/Section{s}", s, p, text, [{"name": n, "start": a, "stop": b, "explicit": False} for n, a, b in found], None))
                # markers elsewhere, as in cells, aren't supported
                need(not any(re.search(MARKER, text_of(d)) for tag, level, _, _, _, d in rs if tag == TEXT_TAG and level != 1), "E_PRESERVATION")
            return out
        except Refused as e:
            return [(path, *[None] * 5, e.args[0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = rows(path, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate(kinds)], NAMES)

    return docs.filter("format = 'hwp'").select("path", "content").mapInArrow(run, f"path string, part string, part_no int, para_no int, text string, fields {FIELDS}, error string")
