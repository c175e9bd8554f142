"""Archives as a data source: `spark.read.format("package_parts")` has a row for each part of each archive under a folder. Only an archive's
directory is read, at its end; a part's bytes are read and inflated where the schema asks for `body`, and filters on path and part decide
before that which. Columns (ask for those you need by schema): path, part, no, method, flags, crc, stored, size, local, entries, archive, problem, body.

What an archive must not be is judged on its rows, as columns (`directory_verdict`), so a directory that can't be read at all is the
only thing that the reader says itself (problem)."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from formloom.operators.lineage import registered
from formloom.sources.containers import MAX_DOCUMENT, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL

SCHEMA = "path string, part string, no int, method int, flags int, crc long, stored long, size long, local long, entries int, archive long, problem string, body binary"
#: Bytes of archives that a task reads at least, as far as their directories and wanted parts go.
SLICE = 64 << 20
#: Longest end of an archive: its end record and a comment.
TAIL = 22 + 0xFFFF


def opened(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def end_record(tail: bytes) -> tuple[int, int, int] | None:
    """entries, size and place of the directory that the last sound end record in the tail names."""
    at = tail.rfind(b"PK\5\6")
    while at >= 0:
        if at + 22 <= len(tail):
            entries, size, place, comment = struct.unpack_from("<HLLH", tail, at + 10)
            if at + 22 + comment == len(tail):
                return entries, size, place
        at = tail.rfind(b"PK\5\6", 0, at)
    return None


def entries_of(listing: bytes) -> Iterator[dict]:
    """The rows of a directory, as far as it can be read."""
    at, no = 0, 0
    while listing[at : at + 4] == b"PK\1\2" and at + 46 <= len(listing):
        flags, method, crc, stored, size, name, extra, comment = struct.unpack_from("<HH4xLLLHHH", listing, at + 8)
        raw = listing[at + 46 : at + 46 + name]
        yield {"no": no, "part": unicodedata.normalize("NFC", raw.decode("utf-8", "replace")), "flags": flags, "method": method, "crc": crc, "stored": stored, "size": size, "local": struct.unpack_from("<L", listing, at + 42)[0]}
        at, no = at + 46 + name + extra + comment, no + 1


def body_of(file, row: dict) -> bytes | None:
    """A part's bytes by its local header; None if they aren't what the directory says."""
    head = file.read_at(30, row["local"])
    if head[:4] != b"PK\3\4" or row["size"] > MAX_ENTRY or row["flags"] & 1:
        return None
    name, extra = struct.unpack_from("<HH", head, 26)
    data = file.read_at(row["stored"], row["local"] + 30 + name + extra)
    if row["method"] == 8:
        worker = zlib.decompressobj(-15)
        try:
            data = worker.decompress(data, row["size"] + 1)
        except zlib.error:
            return None
        if not worker.eof:
            return None
    return data if len(data) == row["size"] and zlib.crc32(data) == row["crc"] else None


def files_below(store, top: str) -> Iterator[tuple[str, str, int]]:
    """Path below top, name and size of each file. A local folder's entries come one at a time, so that a large folder isn't held; other stores list a folder at once."""
    from pyarrow import fs

    todo = [""]
    while todo:
        below = todo.pop()
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(f"{top}/{below}") as found:
                for e in found:
                    if e.is_dir():
                        todo.append(f"{below}{e.name}/")
                    elif e.is_file():
                        yield below + e.name, e.name, e.stat().st_size
            continue
        for f in store.get_file_info(fs.FileSelector(f"{top}/{below}".rstrip("/"))):
            if f.type == fs.FileType.Directory:
                todo.append(f"{below}{f.base_name}/")
            elif f.type == fs.FileType.File:
                yield below + f.base_name, f.base_name, f.size


class Archives(InputPartition):
    """Paths below a folder, packed: the process that plans holds all of these."""

    def __init__(self, folder: str, below: list[str]):
        self.folder, self.packed = folder, zlib.compress("\0".join(sorted(below)).encode("utf-8", "surrogateescape")) if below else b""

    @property
    def paths(self) -> list[str]:
        return [f"{self.folder}/{x}" for x in zlib.decompress(self.packed).decode("utf-8", "surrogateescape").split("\0")] if self.packed else []


class PartReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.columns = options["path"], schema.fieldNames()
        self.pattern = re.compile(options.get("pattern", r".*\.(docx|hwpx|zip)"), re.IGNORECASE)
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality, lists, beginnings and ends of path and part are decided here; all others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("path",), ("part",)):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, column: str, value: str) -> bool:
        mine = [f for f in self.tests if f.attribute == (column,)]
        held = {EqualTo: lambda f: value == f.value, In: lambda f: value in f.value, StringStartsWith: lambda f: value.startswith(f.value), StringEndsWith: lambda f: value.endswith(f.value)}
        return all(held[type(f)](f) for f in mine)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        there = "://" in self.folder or self.folder.startswith("file:")
        store, at = fs.FileSystem.from_uri(self.folder) if there else (fs.LocalFileSystem(), self.folder)
        prefix = self.folder.rstrip("/")
        out: list[InputPartition] = []
        held, size = [], 0
        for below, name, n in files_below(store, at.rstrip("/")):
            if self.pattern.fullmatch(name) and self.wanted("path", f"{prefix}/{below}"):
                held.append(below)
                size += n + (1 << 16)
            if size >= SLICE:
                out.append(Archives(prefix, held))
                held, size = [], 0
        return [*out, Archives(prefix, held)] if held or not out else out

    def read(self, partition: Archives) -> Iterator[tuple]:
        for path in partition.paths:
            for row in self.rows(path):
                yield tuple(row.get(c) for c in self.columns)

    def rows(self, path: str) -> Iterator[dict]:
        with opened(path) as file:
            size = file.size()
            base = {"path": path, "archive": size}
            start = max(0, size - TAIL)
            tail = file.read_at(size - start, start)
            end = end_record(tail)
            if end is None or end[2] + end[1] > size:
                yield base | {"problem": "E_INPUT"}
                return
            entries, length, place = end
            listing = tail[place - start : place - start + length] if place >= start else file.read_at(length, place)
            for row in entries_of(listing):
                if self.wanted("part", row["part"]):
                    row |= base | {"entries": entries}
                    if "body" in self.columns:
                        row["body"] = body_of(file, row)
                        row["problem"] = None if row["body"] is not None else "E_INPUT"
                    yield row


class PackageParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PartReader(self.options, schema)


def package_parts(spark: SparkSession, folder: str, columns: tuple[str, ...], pattern: str | None = None) -> DataFrame:
    """Rows of the parts of all archives under folder. Without `body` among the columns, no part is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    registered(spark, PackageParts)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    reader = spark.read.format("package_parts").schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return (reader.option("pattern", pattern) if pattern else reader).load(folder)


def name_problem(part: Column) -> Column:
    """What makes a part's name unsafe."""
    climbs = F.array_contains(F.split(part, "/"), "..")
    return F.when(part.contains("\\") | part.contains("\0") | part.startswith("/") | part.rlike(r"\A[A-Za-z]:") | climbs | (part == ""), "unsafe-name")


def directory_verdict(rows: DataFrame) -> DataFrame:
    """path, parts, total, code, reason of archives from the rows of their directories: the first of what can't be read, sizes, the number of entries, names,
    duplicates, encryption and methods, and the bytes that all parts together would be. One sum and one count a name; no part is read."""
    each = Window.partitionBy("path", "part")
    x = rows.withColumn("same", F.count("*").over(each)).withColumn("bad", name_problem(F.col("part")))
    per = x.groupBy("path").agg(
        F.count("part").alias("parts"), F.sum("size").alias("total"), F.max("size").alias("largest"), F.first("entries", ignorenulls=True).alias("entries"), F.first("archive").alias("archive"), F.min("problem").alias("problem"), F.min("bad").alias("bad"),
        F.max("same").alias("same"), F.bool_or(F.col("flags").bitwiseAND(1) == 1).alias("locked"), F.bool_or(~F.col("method").isin(0, 8)).alias("odd"),
    )
    steps = [
        (F.col("archive") > MAX_DOCUMENT, "E_INPUT", "archive-size"), (F.col("problem").isNotNull(), "E_INPUT", "unreadable"), ((F.col("entries") == 0) | (F.col("entries") > MAX_ENTRIES), "E_UNSUPPORTED", "entry-count"), (F.col("entries") != F.col("parts"), "E_INPUT", "unreadable"),
        (F.col("bad").isNotNull(), "E_INPUT", "unsafe-name"), (F.col("same") > 1, "E_INPUT", "duplicate-name"), (F.col("locked"), "E_UNSUPPORTED", "encrypted"), (F.col("odd"), "E_UNSUPPORTED", "method"), ((F.col("largest") > MAX_ENTRY) | (F.col("total") > MAX_TOTAL), "E_INPUT", "expanded-size"),
    ]
    verdict = None
    for holds, code, reason in steps:
        said = F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
        verdict = F.when(F.coalesce(holds, F.lit(False)), said) if verdict is None else verdict.when(F.coalesce(holds, F.lit(False)), said)
    return per.select("path", "parts", F.coalesce("total", F.lit(0)).alias("total"), verdict["code"].alias("code"), verdict["reason"].alias("reason"))
