"""Document containers: binary scan, signatures, archives whose directory is walked here, packages and what they must hold."""

from __future__ import annotations

import io
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.sources import markup

# Limits, signatures, and what the formats call their parts.
MAX_DOCUMENT = 50 << 20
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 4096, 32 << 20, 128 << 20
COMPOUND = "d0cf11e0a1b11ae1"
FIELD_PARTS = {"docx": r"word/(document|header\d+|footer\d+|footnotes|endnotes)\.xml", "hwpx": r"Contents/section\d+\.xml"}
HWP_SECTIONS = r"BodyText/Section\d+"
ACTIVE = r"(?i)(^|/)(vbaProject\.bin|embeddings/|Scripts/)"
SIGNED = r"(?i)(^|/)(signatures?|_xmlsignatures|encrypted-package)(/|\.)"
MAIN_PART = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARAGRAPH = "http://www.hancom.co.kr/hwpml/2011/paragraph"
REFUSED_ELEMENTS = {"script", "ole", "encryption-data", "Signature"}
FORMATS = ("hwp", "hwpx", "docx", "pdf")

Refused = markup.Refused


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, format, sha256, content, signature, error of the files under path: files of illegal size come without their content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fine = F.col("length").between(1, MAX_DOCUMENT)
    kept = F.when(fine, F.col("content"))
    form = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return raw.select("path", form.alias("format"), F.sha2(kept, 256).alias("sha256"), kept.alias("content"), signature(kept).alias("signature"), document_verdict(form, F.col("length"), kept).alias("error"))


def signature(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == COMPOUND.upper(), "compound").when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), "zip").otherwise("unknown")


def document_verdict(form: Column, length: Column, content: Column) -> Column:
    """Null, or E_INPUT for the wrong size or a signature that isn't the format's, E_UNSUPPORTED for another format."""
    kind = F.when(form == "hwp", "compound").when(form == "pdf", "pdf").otherwise("zip")
    return F.when(~F.coalesce(form.isin(*FORMATS), F.lit(False)), "E_UNSUPPORTED").when(~length.between(1, MAX_DOCUMENT), "E_INPUT").when(signature(content) != kind, "E_INPUT")


END, CENTRAL, LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


def need(ok: bool, code: str) -> None:
    if not ok:
        raise Refused(code)


def directory(data: bytes) -> list[tuple]:
    """name, method, crc, stored size, size and place of the data of each entry, as the directory at the end says. Local headers must agree."""
    need(len(data) <= MAX_DOCUMENT, "E_INPUT")
    at = len(data) - END.size
    while at >= max(0, len(data) - END.size - 0xFFFF):  # the comment after it may hold what looks like the end
        found = END.unpack_from(data, at)
        if found[0] == b"PK\5\6" and at + END.size + found[7] == len(data):
            break
        at -= 1
    else:
        raise Refused("E_INPUT")
    _, disk, first_disk, here, count, size, pos, _ = found
    need(0 < count <= MAX_ENTRIES and here == count and disk == first_disk == 0 and pos + size == at, "E_UNSUPPORTED")
    start, seen, out, total = pos, set(), [], 0
    for _ in range(count):
        need(pos + CENTRAL.size <= at, "E_INPUT")
        mark, _, _, flags, method, _, _, crc, stored, length, n, extra, comment, _, _, _, local = CENTRAL.unpack_from(data, pos)
        raw = data[pos + CENTRAL.size : pos + CENTRAL.size + n]
        pos += CENTRAL.size + n + extra + comment
        need(mark == b"PK\1\2" and n > 0 and pos <= at, "E_INPUT")
        name = unicodedata.normalize("NFC", raw.decode("utf-8", "replace"))
        need(safe_name(name) and name not in seen, "E_INPUT")
        seen.add(name)
        need(not flags & 1 and method in (0, 8), "E_UNSUPPORTED")
        total += length
        need(length <= MAX_ENTRY and total <= MAX_TOTAL and local + LOCAL.size <= start, "E_INPUT")
        head = LOCAL.unpack_from(data, local)
        body = local + LOCAL.size + head[9] + head[10]
        need(head[0] == b"PK\3\4" and data[local + LOCAL.size :][: head[9]] == raw and body + stored <= start, "E_INPUT")
        out.append((name, method, crc, stored, length, body))
    need(pos == at, "E_INPUT")
    return out


def safe_name(name: str) -> bool:
    return not ("\\" in name or "\0" in name or name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"))


def inflated(data: bytes, limit: int) -> bytes:
    """Raw deflate, never beyond the limit."""
    worker = zlib.decompressobj(-15)
    try:
        out = worker.decompress(data, limit + 1)
    except zlib.error:
        raise Refused("E_INPUT") from None
    need(len(out) <= limit and worker.eof, "E_INPUT")
    return out


def open_archive(data: bytes | None) -> tuple[list[tuple[str, bytes]], str | None]:
    """Entries of an archive, or a code: paths, duplicates, encryption, sizes, checksums, active parts and document types are checked."""
    try:
        out = []
        for name, method, crc, stored, length, at in directory(data or b""):
            body = data[at : at + stored]
            body = inflated(body, min(length, MAX_ENTRY)) if method == 8 else body
            need(len(body) == length, "E_INPUT")
            need(not re.search(ACTIVE, name), "E_UNSUPPORTED")
            need(zlib.crc32(body) == crc, "E_INPUT")
            if re.search(r"(?i)\.(xml|rels)$", name):
                need(not markup.has_doctype(body), "E_UNSUPPORTED")
            if not name.endswith("/"):
                out.append((name, body))
        return out, None
    except Refused as e:
        return [], e.args[0]


def open_package(data: bytes | None, form: str) -> dict[str, bytes]:
    """The parts of a package of this form, or Refused: what the form must hold and must not."""
    entries, error = open_archive(data)
    need(not error, error)
    parts = dict(entries)
    if form == "docx":
        need("[Content_Types].xml" in parts and "word/document.xml" in parts, "E_INPUT")
        types = {n["attrs"].get("PartName"): n["attrs"].get("ContentType") for n in markup.nodes_of(parts["[Content_Types].xml"]) if n["local"] == "Override"}
        need(types.get("/word/document.xml") == MAIN_PART, "E_UNSUPPORTED")
        root = markup.nodes_of(parts["word/document.xml"])[0]
        need((root["ns"], root["name"]) == (WORD, "w:document"), "E_UNSUPPORTED")
    else:
        need(parts.get("mimetype") == b"application/hwp+zip", "E_INPUT")
        need(not any(re.search(SIGNED, name) for name in parts), "E_UNSUPPORTED")
        for name, body in parts.items():
            if re.search(r"(?i)\.(xml|hpf|rdf)$", name):
                need(not any(n["local"] in REFUSED_ELEMENTS for n in markup.nodes_of(body)), "E_UNSUPPORTED")
        need(any(re.fullmatch(FIELD_PARTS["hwpx"], name) for name in parts), "E_INPUT")
    return parts


def part_order(part: Column) -> Column:
    """Sections by their number, not by their name."""
    return F.regexp_extract(part, r"(\d+)", 1).try_cast("int")


def parts(docs: DataFrame) -> DataFrame:
    """path, part, body, error of zip documents: one row a part, or one with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entries, error = open_archive(content.as_py())
                for name, body in entries or [(None, None)]:
                    out.append((path, name, body, error))
                    held += len(body or b"")
                    if held > 16 << 20:
                        yield batch_of(out)
                        out, held = [], 0
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], ["path", "part", "body", "error"])

    return docs.select("path", "content").mapInArrow(run, "path string, part string, body binary, error string")


def write_archive(entries: list[tuple[str, bytes]]) -> bytes:
    """A package: `mimetype` first and stored, all others deflated."""
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in sorted(entries, key=lambda e: e[0] != "mimetype"):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return b.getvalue()
