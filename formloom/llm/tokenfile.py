"""Token ids in binary files: canonical length-limited Huffman coding from global counts.

Code lengths come from package-merge over the counts of the whole corpus, so one table serves every file. A file
holds the ids of the documents of one range of doc_id, in ascending order (null ids first), as independent blocks of
BLOCK tokens; a checkpoint gives the bit offset at which each block starts, so any block can be decoded alone, and all
blocks of a file are decoded side by side through one lookup table.

File: b"FLT1", header length (u32), header JSON, then zlib(code lengths), doc_ids (i64), validity (u8), tokens of each
document (i64), checkpoints (u64) and the bit stream (64-bit big-endian words). A task writes a file whenever it holds FILE_TOKENS, so
it never holds more than that and one document; rows of one doc_id may fill several tasks and files. Codes are of MAX_BITS bits, or of
as many more as it takes to tell the used ids apart.

Defined results: a null text is the empty text and gives the end id alone; equal doc_ids stand in the order of a hash of
their ids; an empty table writes no file and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .bpe import Encoder, library, vocabulary

BLOCK = 256
MAX_BITS = 16
#: Tokens from which on a file is full.
FILE_TOKENS = 8_000_000
#: Files of one task, at most.
TASK_FILES = 1 << 20
MAGIC = b"FLT1"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Package-merge: lengths of an optimal prefix code with no code over max_bits; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    max_bits = code_bits(n, max_bits)
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        even = len(row) // 2 * 2
        packages = row[0:even:2] + row[1:even:2]
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def code_bits(used: int, max_bits: int = MAX_BITS) -> int:
    """Longest code for so many used ids; the decoding table has an entry for each value of so many bits."""
    bits = max(max_bits, (used - 1).bit_length())
    if bits > 25:
        raise ValueError(f"{used} ids don't fit codes of 25 bits")
    return bits


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    # each code starts where the spans of the shorter ones, seen as numbers of the longest, end
    bits = int(size.max(initial=0))
    span = np.int64(1) << (bits - size)
    codes[used] = ((np.cumsum(span) - span) >> (bits - size)).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset of every BLOCK-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    size, code = lengths[ids].astype(np.int64), codes[ids]
    if len(ids) % 2:
        size, code = np.append(size, 0), np.append(code, np.uint64(0))
    # neighbours as one code of up to 50 bits
    code = (code[::2] << size[1::2].astype(np.uint64)) | code[1::2]
    size = size[::2] + size[1::2]
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
    word, bit = at >> 6, at & 63
    over = bit + size - 64  # bits that go into the next word
    fits = over <= 0
    first = np.where(fits, code << np.where(fits, -over, 0).astype(np.uint64), code >> np.where(fits, 0, over).astype(np.uint64))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[starts]] = np.add.reduceat(first, starts)
    spill = np.flatnonzero(~fits)
    words[word[spill] + 1] += code[spill] << (64 - over[spill]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[:: BLOCK // 2].astype(np.uint64)


def lookup(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next bits: the id and its length."""
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    span = 1 << (bits - lengths[used].astype(np.int64))
    end = int(span.sum())
    ids[:end], size[:end] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, size


def unpack(stream: bytes, checkpoints: np.ndarray, n: int, tables: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """All blocks side by side: step k decodes the k-th id of every block."""
    if n == 0:
        return np.zeros(0, np.uint32)
    ids, size = tables
    b = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    mask = np.uint32((1 << bits) - 1)
    at = checkpoints.astype(np.int64)
    out = np.zeros((BLOCK, len(at)), np.uint32)
    full = n // BLOCK
    for k in range(BLOCK):
        live = len(at) if k < n - full * BLOCK or full == len(at) else full
        if not live:
            break
        p = at[:live]
        v = (window[p >> 3] >> (32 - bits - (p & 7)).astype(np.uint32)) & mask
        out[k, :live] = ids[v]
        at[:live] += size[v]
    return out.T.reshape(-1)[:n]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, kind: str) -> Encoder:
    """Ids by the tokenizers library's model, which encodes each distinct word once (while it is cached)."""
    model = library(path).model
    return Encoder(vocabulary(path), lambda piece: [t.id for t in model.tokenize(piece)], kind)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, n (tokens with the end id), ids (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width, end = library_encoder(tokenizer_path, kind), np.dtype(kind).itemsize, np.array([end_id], kind).tobytes()
        for batch in batches:
            packed = [enc.encode(t.as_py() or "") + end for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // width for p in packed], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, ids binary")


def flat(column: pa.Array, kind: str) -> np.ndarray:
    """All packed ids of a column of a batch, without copying."""
    if not len(column):
        return np.zeros(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def counted(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs; each task adds up its own rows first, so at most size rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "count"])

    rows = ids.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:  # one row for each id of the vocabulary at most
        out[r["id"]] = r["count"]
    return out


def write_tokens(docs: DataFrame, directory: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the files and returns file, n_docs, n_tokens of each (already written)."""
    spark = docs.sparkSession
    size = len(vocabulary(tokenizer_path).strings)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    numbered = encoded(docs, tokenizer_path, end_id, kind).withColumn("row", F.monotonically_increasing_id())
    ids = common.stored(numbered, "snappy")
    counts = counted(ids, size, kind)
    lengths = code_lengths(counts)
    bits = code_bits(int((counts > 0).sum()))
    table = zlib.compress(lengths.tobytes())
    parts = max(common.shuffle_parts(spark), -(-int(counts.sum()) // FILE_TOKENS))
    common.filesystem(directory)[0].create_dir(common.filesystem(directory)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = common.filesystem(directory)
        own = np.frombuffer(zlib.decompress(table), np.uint8)
        codes = canonical_codes(own)
        done = []

        def flush(doc: pa.Array, n: np.ndarray, tokens: np.ndarray) -> None:
            stream, checkpoints = pack(tokens, own, codes)
            head = json.dumps({"docs": len(doc), "tokens": len(tokens), "block": BLOCK, "bits": bits, "table": len(table), "stream": len(stream)}).encode()
            body = [MAGIC, struct.pack("<I", len(head)), head, table, np.asarray(doc.fill_null(0)).astype("<i8").tobytes(), np.asarray(doc.is_valid()).astype("u1").tobytes(), n.astype("<i8").tobytes(), checkpoints.astype("<u8").tobytes(), stream]
            file = task.partitionId() * TASK_FILES + len(done)
            name = f"{path}/ids-{file}.flt"
            temporary = f"{name}.{task.taskAttemptId()}.tmp"
            try:
                with fs.open_output_stream(temporary) as f:
                    for x in body:
                        f.write(x)
                fs.move(temporary, name)  # a repeated task puts the same bytes there
            except BaseException:
                if fs.get_file_info(temporary).is_file:
                    fs.delete_file(temporary)
                raise
            done.append((file, len(doc), len(tokens)))

        docs_, n, packed, held = [], [], [], 0
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            docs_.append(batch.column(0))
            n.append(np.asarray(batch.column(1)))
            packed.append(flat(batch.column(2), kind).copy())
            held += len(packed[-1])
            if held >= FILE_TOKENS:
                flush(pa.chunked_array(docs_).combine_chunks(), np.concatenate(n), np.concatenate(packed))
                docs_, n, packed, held = [], [], [], 0
        if sum(map(len, n)):
            flush(pa.chunked_array(docs_).combine_chunks(), np.concatenate(n), np.concatenate(packed))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], pa.int64()) for k in range(3)], ["file", "n_docs", "n_tokens"])

    # the row number only parts rows that are equal in all else
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc(), F.col("row").asc()]
    ranged = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.stored(ranged.mapInArrow(write, "file long, n_docs long, n_tokens long"))


def read_tokens(files: DataFrame, directory: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as packed u32, if asked for) of every document, from the files alone.

    files is what write_tokens returned: one row a file, its order that of the ranges; start adds up earlier files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(directory)
        tables: dict[bytes, tuple] = {}
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/ids-{file}.flt") as f:
                    data = f.read()
                if data[:4] != MAGIC:
                    raise ValueError("not a token file")
                (k,) = struct.unpack_from("<I", data, 4)
                head = json.loads(data[8 : 8 + k])
                at, docs_, tokens = 8 + k, head["docs"], head["tokens"]
                table, at = data[at : at + head["table"]], at + head["table"]
                doc, at = np.frombuffer(data, "<i8", docs_, at), at + 8 * docs_
                valid, at = np.frombuffer(data, "u1", docs_, at), at + docs_
                n, at = np.frombuffer(data, "<i8", docs_, at), at + 8 * docs_
                blocks = -(-tokens // head["block"])
                checkpoints, at = np.frombuffer(data, "<u8", blocks, at), at + 8 * blocks
                if table not in tables:
                    tables = {table: lookup(np.frombuffer(zlib.decompress(table), np.uint8), head["bits"])}
                raw = unpack(data[at : at + head["stream"]], checkpoints, tokens, tables[table], head["bits"]).astype("<u4").tobytes()
                ends = np.cumsum(n)
                starts = ends - n
                for i in range(0, docs_, 1024):
                    part = [raw[4 * a : 4 * b] for a, b in zip(starts[i : i + 1024].tolist(), ends[i : i + 1024].tolist(), strict=True)]
                    cols = [pa.array(doc[i : i + 1024], pa.int64(), mask=valid[i : i + 1024] == 0), pa.array(starts[i : i + 1024] + base), pa.array(n[i : i + 1024]), pa.array([zlib.crc32(x) for x in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(part, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    # one row a file: a running sum over the files, few beside the documents
    based = files.select("file", (F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens")).alias("base"))
    spread = based.repartition(common.shuffle_parts(files.sparkSession), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    directory = common.shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, directory, tokenizer_path), directory)


