"""Compound files (sector chains with a directory): their streams as rows. The layout is the public one of [MS-CFB]."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from formloom.sources.containers import COMPOUND, MAX_ENTRY, MAX_TOTAL

# Marks in allocation tables above which no sector is meant, and kinds of directory entries.
LAST, STORAGE, STREAM, ROOT = 0xFFFFFFFA, 1, 2, 5


def chain(table: list[int], first: int) -> list[int]:
    out = []
    while first < LAST:
        if first >= len(table) or len(out) > len(table):
            raise ValueError("chain leaves its table or never ends")
        out.append(first)
        first = table[first]
    return out


def streams(data: bytes) -> list[tuple[str, bytes]]:
    """Path and bytes of every stream. ValueError if the file is damaged or beyond the limits."""
    if len(data) < 512 or data[:8].hex() != COMPOUND:
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    if shift not in (9, 12) or mini_shift != 6:
        raise ValueError("sector size")
    first_dir, cutoff, first_mini, _, first_more, _ = struct.unpack_from("<IxxxxIIIII", data, 48)
    size = 1 << shift
    sectors = (len(data) - 1) // size

    def sector(n: int) -> bytes:
        if n >= sectors:
            raise ValueError("sector beyond the end")
        return data[(n + 1) * size : (n + 2) * size].ljust(size, b"\0")

    ints = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b))
    holders, seen = list(struct.unpack_from("<109I", data, 76)), set()
    while first_more < LAST:
        if first_more in seen:
            raise ValueError("endless table")
        seen.add(first_more)
        *more, first_more = ints(sector(first_more))
        holders += more
    fat = [x for h in holders if h < LAST for x in ints(sector(h))]
    whole = lambda first: b"".join(map(sector, chain(fat, first)))
    directory = whole(first_dir)
    entries = []
    for at in range(0, len(directory), 128):
        e = directory[at : at + 128]
        n, kind = struct.unpack_from("<HB", e, 64)
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        entries.append((e[: max(0, min(n, 64) - 2)].decode("utf-16-le"), kind, left, right, child, start, length if shift == 12 else length & 0xFFFFFFFF))
    if not entries or entries[0][1] != ROOT:
        raise ValueError("no root")
    mini_fat, mini = ints(whole(first_mini)), whole(entries[0][5])
    out, total, todo, visited = [], 0, [(entries[0][4], "")], set()
    while todo:
        i, above = todo.pop()
        if i >= LAST:
            continue
        if i >= len(entries) or i in visited:
            raise ValueError("directory isn't a tree")
        visited.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, above), (right, above)]
        if kind == STORAGE:
            todo.append((child, f"{above}{name}/"))
        elif kind == STREAM:
            total += length
            if length > MAX_ENTRY or total > MAX_TOTAL:
                raise ValueError("too large")
            body = b"" if not length else b"".join(mini[64 * s : 64 * s + 64] for s in chain(mini_fat, start)) if length < cutoff else whole(start)
            if len(body) < length:
                raise ValueError("cut stream")
            out.append((above + name, body[:length]))
    return sorted(out)


def compound_streams(docs: DataFrame) -> DataFrame:
    """path, stream, body, error of documents (path, content): one row a stream, or one with the error E_INPUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                try:
                    rows, error = streams(content.as_py() or b""), None
                except (ValueError, struct.error):
                    rows, error = [(None, None)], "E_INPUT"
                for name, body in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((path.as_py(), pa.string()), (name, pa.string()), (body, pa.binary()), (error, pa.string()))], ["path", "stream", "body", "error"])

    return docs.select("path", "content").mapInArrow(run, "path string, stream string, body binary, error string")
