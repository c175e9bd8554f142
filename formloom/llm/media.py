"""Media columns: texts stored as 8-bit images in archives, read back by a Spark data source.

Each task writes one archive: members one after another, each a losslessly compressed grey image (PNG, WIDTH
samples a row, one byte a sample), then a directory of fixed-size entries and a footer. The data source
`formloom_media` plans byte ranges over the archives of a folder; a partition reads the directory entries whose members
start in its range and streams each one's stored form and payload through Arrow as binary columns, in batches of bounded bytes. Every
member is read on its own by offset and retried on its own, so one bad read doesn't repeat the rest. Digests and features are made
from these columns by whoever asks for them.

Defined results: a null text is the empty text and is stored as one row of blanks; a null doc_id stays null; equal
texts give equal members; an empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH = 192
BLANK = b" "
#: Bytes of an archive that one partition reads.
SPLIT_BYTES = 16 << 20
#: Payload bytes of a batch, but for a single larger member.
BATCH_BYTES = 8 << 20
RETRIES = 3
ENTRY = "<qQQQIB3x"  # doc_id, offset, stored bytes, text bytes, crc32 of the stored bytes, doc_id is there
FOOTER = "<QQ8s"  # offset of the directory, members, magic
MAGIC = b"FLMEDIA1"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary"


def padded(data: bytes) -> bytes:
    """At least one row, and whole rows."""
    return data + BLANK * (WIDTH - len(data) % WIDTH if not data or len(data) % WIDTH else 0)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """PNG, 8-bit grey, no row filter."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_image(image: bytes) -> np.ndarray:
    """Samples of a PNG as to_image writes them: rows of WIDTH bytes."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, height, body = 8, 0, []
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        part = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", part)[1]
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("row filters aren't used here")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, spread and a four-bin histogram of the samples; whole numbers, so equal everywhere."""
    n, total = samples.size, int(samples.sum(dtype=np.int64))
    square = int(np.square(samples.astype(np.int64)).sum())
    bins = np.bincount(samples.reshape(-1) >> 6, minlength=4)
    return f"gray8 {WIDTH}x{n // WIDTH} mean={total * 1000 // n} var={(square * n - total * total) * 1000 // (n * n)} hist={','.join(map(str, bins.tolist()))}"


def write_archives(docs: DataFrame, directory: str) -> int:
    """Writes archives of all documents; returns how many documents. Each task puts its archive in place by a rename."""
    fs, path = common.filesystem(directory)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = common.filesystem(directory)
        name, entries, at, f = f"{path}/archive-{task.partitionId():06d}.flm", [], 0, None
        temporary = f"{name}.{task.taskAttemptId()}.tmp"
        try:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    f = f or fs.open_output_stream(temporary)
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    image = to_image(padded(data))
                    f.write(image)
                    entries.append(struct.pack(ENTRY, doc.as_py() or 0, at, len(image), len(data), zlib.crc32(image), doc.is_valid))
                    at += len(image)
            if f:
                f.write(b"".join(entries) + struct.pack(FOOTER, at, len(entries), MAGIC))
        finally:
            if f:
                f.close()
        if f:
            fs.move(temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([len(entries)], pa.int64())], ["n"])

    written = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(write, "n long")
    return written.groupBy().sum("n").first()[0] or 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def read_directory(fs, path: str) -> tuple[np.ndarray, int]:
    """Entries of an archive, and where its members end."""
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - struct.calcsize(FOOTER))
        at, n, magic = struct.unpack(FOOTER, f.read(struct.calcsize(FOOTER)))
        if magic != MAGIC or at + n * struct.calcsize(ENTRY) + struct.calcsize(FOOTER) != size:
            raise ValueError("not a media archive")
        f.seek(at)
        kind = np.dtype([("doc", "<i8"), ("at", "<u8"), ("stored", "<u8"), ("bytes", "<u8"), ("crc", "<u4"), ("there", "u1"), ("pad", "V3")])
        return np.frombuffer(f.read(n * struct.calcsize(ENTRY)), kind), at


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        """Byte ranges of all archives; only sizes are read here."""
        from pyarrow import fs as pafs

        fs, path = common.filesystem(self.directory)
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".flm"))
        return [Range(p, i, i + self.split) for p, size in found for i in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs = common.filesystem(self.directory)[0]
        entries, _ = read_directory(fs, partition.path)
        mine = entries[(entries["at"] >= partition.start) & (entries["at"] < partition.stop)]
        rows, held = [], 0
        source = [fs.open_input_file(partition.path)]
        try:
            for e in mine:
                image = self.member(fs, source, partition.path, int(e["at"]), int(e["stored"]), int(e["crc"]))
                payload = from_image(image).tobytes()
                rows.append((int(e["doc"]) if e["there"] else None, int(e["bytes"]), image, payload))
                held += len(payload) + len(image)
                if held >= BATCH_BYTES or len(rows) >= 4096:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)
        finally:
            source[0].close()

    @staticmethod
    def member(fs, source: list, path: str, at: int, size: int, crc: int) -> bytes:
        """The bytes of one member; a failed or damaged read opens the archive anew and reads this member again."""
        for attempt in range(RETRIES + 1):
            try:
                source[0].seek(at)
                image = source[0].read(size)
                if len(image) == size and zlib.crc32(image) == crc:
                    return image
                why = "its checksum differs"
            except OSError as e:
                why = str(e)
            time.sleep(0.05 * attempt)
            source[0].close()
            source[0] = fs.open_input_file(path)
        raise OSError(f"member at {at} of {path}: {why}")

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class MediaArchives(DataSource):
    """spark.read.format("formloom_media").load(folder): one row a member, with its stored form and its payload."""

    @classmethod
    def name(cls) -> str:
        return "formloom_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchives)


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload of all documents, stored as media and read back."""
    spark = docs.sparkSession
    directory = common.shared_dir(spark)
    write_archives(docs, directory)
    register(spark)
    return spark.read.format("formloom_media").load(directory)


def with_feature(media: DataFrame, payload: str = "payload") -> DataFrame:
    """media with the feature of its payload column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(payload))
            out = [feature(np.frombuffer(x.as_buffer(), np.uint8)) if x.is_valid else None for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "feature"])

    return media.mapInArrow(run, T.StructType([*media.schema.fields, T.StructField("feature", T.StringType())]))


def media_columns(docs: DataFrame) -> DataFrame:
    """Digests and features of the media of all documents."""
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    length = lambda c: F.octet_length(c).cast("long").alias(f"{c}_bytes")
    tail = F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32")
    rows = stored_media(docs).select("doc_id", "n_bytes", length("payload"), digest("payload"), tail, length("media"), digest("media"), "payload")
    return with_feature(rows).drop("payload")
