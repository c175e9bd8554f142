"""Removal of byte strings that occur elsewhere: distributed suffix sorting on a content-defined cover.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another. Two
suffixes matter here only if they share LENGTH bytes, so the cover need not be arithmetic: the places of the least
CORE-byte hash in each window of LENGTH bytes (chosen by content alone) put a sampled place at the same offset into any two
equal windows. This keeps the property of a difference cover with about two samples in a hundred bytes instead of two
in three, which is what lets it run within a few bytes of shuffle for each byte of input.

1. Sampled tuples: each sampled place gives the hash of its CORE bytes and the hash of its context, i.e. of all bytes
   that windows with this place can hold. Each batch adds up its own equal tuples, then one shuffle names them by core.
2. A core met once decides all its windows (single); a context met twice does too (repeated). What is left are the edges
   of repeats: groups of different contexts with the same core, which bring their bytes along.
3. Suffixes of such a group start in step (the core has the same place in all), and are sorted in bounded blocks of whole
   groups: 8-byte tuples at sampled places get names by rank, names are sorted in pairs again and again (8, 16, ... 128, 192
   bytes), the remaining suffixes are merged by (bytes before the sample, name, bytes after), and
   adjacent ones are compared. All of this is exact, on bytes.
4. Groups of more than GROUP contexts are split instead: by sub-ranges of windows, whose longer common core and whole
   span decide most of them by counting, then by single windows; all are sums that combine before the shuffle.

Defined results: a null text is empty; documents shorter than LENGTH keep everything; rows equal in doc_id and text are
separate documents that repeat each other, and each appears in the result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LENGTH = 200
CORE = 64
#: Window starts for one sampled place, and bytes of its whole context.
STARTS = LENGTH - CORE + 1
SLOT = STARTS - 1 + LENGTH
#: Contexts of a core that one task compares at most; larger groups are split.
GROUP = 1500
#: Contexts that are sorted at once.
BLOCK = 16_000
#: Window starts in a sub-range of a split group.
RANGE = 18
WHERE = np.dtype([("k", "<i8"), ("d", "<i8"), ("pos", "<i4")])
HELD = "k long, d long, pos int, core long, nn long, hot boolean, before int, after int, bytes binary"


#: Places of a document that are hashed at once, so that a very long text needs no more memory than this takes.
SEGMENT = 1 << 20


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places of a document and the hashes of their CORE bytes: the least hash of each window of STARTS."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = []
    for a in range(0, n - CORE + 1, SEGMENT):
        b = min(a + SEGMENT, n - CORE + 1)
        # windows that hold a place of a..b reach STARTS - 1 places to both sides
        low, high = max(0, a - STARTS + 1), min(n - CORE + 1, b + STARTS - 1)
        at, h = least_places(data[low : high + CORE - 1])
        own = (at + low >= a) & (at + low < b)
        found.append((at[own] + low, h[own]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def least_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    size, power = 1, 0x9E3779B97F4A7C15
    while size < CORE:  # hashes of twice as many bytes from two neighbours
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = size * 2, power * power & (2**64 - 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)

    def slide(x: np.ndarray, op) -> np.ndarray:
        size = 1
        while size * 2 <= STARTS:
            x = op(x[:-size], x[size:])
            size *= 2
        rest = STARTS - size
        return op(x[:-rest], x[rest:]) if rest else x

    least = slide(h, np.minimum)
    edge = np.zeros(STARTS - 1, np.uint64)
    reach = slide(np.concatenate([edge, least, edge]), np.maximum)
    at = np.flatnonzero(h == reach)
    return at, h[at]


def sampled(docs: DataFrame) -> DataFrame:
    """core, ctx, n, places of the sampled tuples, added up within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, ctx, key, doc, pos = [], [], [], [], []
            for k, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                at, h = places(np.frombuffer(data, np.uint8))
                if not len(at):
                    continue
                core.append(h)
                # the seed tells a cut context from a whole one
                ctx += [xxhash.xxh3_64_intdigest(data[max(0, p - STARTS + 1) : p + LENGTH], min(p, STARTS - 1)) for p in at.tolist()]
                key.append(np.full(len(at), k))
                doc.append(np.full(len(at), d))
                pos.append(at)
            if not core:
                continue
            where = np.zeros(len(ctx), WHERE)
            where["k"], where["d"], where["pos"] = np.concatenate(key), np.concatenate(doc), np.concatenate(pos)
            c, x = np.concatenate(core), np.array(ctx, np.uint64)
            order = np.lexsort((x, c))
            c, x, raw = c[order], x[order], where[order].tobytes()
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (x[1:] != x[:-1])]))
            ends = np.append(first[1:], len(c))
            offsets = pa.py_buffer(np.append(first, len(c)).astype(np.int32) * WHERE.itemsize)
            lists = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(c[first].view(np.int64)), pa.array(x[first].view(np.int64)), pa.array(ends - first), lists], ["core", "ctx", "n", "places"])

    return docs.select("k", "d", "text").mapInArrow(run, "core long, ctx long, n long, places binary")


def named(tuples: DataFrame) -> DataFrame:
    """Tuples of cores met more than once: nn (places of the same context), contexts (different ones of the core), lead
    (one row a context), open (the core has a context met once)."""
    context = Window.partitionBy("core", "ctx")
    core = Window.partitionBy("core")
    rows = tuples.withColumn("nn", F.sum("n").over(context)).withColumn("lead", F.row_number().over(context.orderBy("places")) == 1)
    rows = rows.withColumn("total", F.sum("n").over(core)).withColumn("contexts", F.sum(F.col("lead").cast("int")).over(core)).withColumn("open", F.min("nn").over(core) == 1)
    return rows.filter("total > 1").select("core", "ctx", "nn", "lead", "contexts", "open", "places")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """k, d, spans of the places whose whole context is repeated, merged within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.frombuffer(b"".join(batch.column(0).to_pylist()), WHERE)
            yield packed_spans(where["k"], where["d"], where["pos"].astype(np.int64) - (STARTS - 1), where["pos"].astype(np.int64) + LENGTH)

    return rows.filter("nn > 1").select("places").mapInArrow(run, "k long, d long, spans binary")


def packed_spans(k: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """One row a document (k, d): its spans, joined where they touch, as packed i4 pairs."""
    out_k, out_d, out = [], [], []
    if len(k):
        order = np.lexsort((lo, d, k))
        k, d, lo, hi = k[order], d[order], np.maximum(lo[order], 0), hi[order]
        cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(d) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
            out_k.append(int(k[a]))
            out_d.append(int(d[a]))
            out.append(np.stack(union(lo[a:b], hi[a:b]), axis=1).astype("<i4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out_k, pa.int64()), pa.array(out_d, pa.int64()), pa.array(out, pa.binary())], ["k", "d", "spans"])


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals sorted by their starts."""
    top = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:], len(lo)) - 1]


def contexts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of one place for each context of the cores that are open."""
    first = rows.filter("lead and open").select("core", "nn", (F.col("contexts") > GROUP).alias("hot"), F.substring("places", 1, WHERE.itemsize).alias("p"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.frombuffer(b"".join(batch.column(3).to_pylist()), WHERE)
            yield pa.RecordBatch.from_arrays([*[pa.array(p[c].copy()) for c in ("k", "d", "pos")], *batch.columns[:3]], ["k", "d", "pos", "core", "nn", "hot"])

    asked = first.mapInArrow(unpack, "k long, d long, pos int, core long, nn long, hot boolean").groupBy("k", "d").agg(F.collect_list(F.struct("pos", "core", "nn", "hot")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            held = 0
            for k, d, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    p = w["pos"]
                    before, after = min(p, STARTS - 1), min(LENGTH, len(data) - p)
                    piece = data[p - before : p + after]
                    held += len(piece)
                    for col, x in zip(out, (k, d, p, w["core"], w["nn"], w["hot"], before, after, piece), strict=True):
                        col.append(x)
                if held > 8 << 20:
                    yield held_batch(out)
                    out, held = [[] for _ in range(9)], 0
            yield held_batch(out)

    return docs.join(asked, ["k", "d"]).select("k", "d", "text", "asked").mapInArrow(cut, HELD)


def held_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in HELD.split(", ")])


def ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(keys.shape).astype(np.uint64)


def repeated_starts(slots: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each context (a row of SLOT bytes) and window start x in lo..hi: does another row have the same LENGTH bytes at x?

    Names of sampled places (every 8th byte) double their depth by sorting pairs; a window is then the name of 192 bytes
    at the first sampled place in it and the 8 bytes that this leaves out on both sides."""
    m = len(slots)
    name = ranks(np.ascontiguousarray(slots).view(">u8").astype(np.uint64))
    depth, names = 1, {}
    while True:
        names[depth] = name
        if depth == 16:
            break
        name = ranks((name[:, :-depth] << np.uint64(32)) | name[:, depth:])
        depth *= 2
    deep = names[16][:, : names[8].shape[1] - 16]
    deep = ranks((deep << np.uint64(32)) | names[8][:, 16:][:, : deep.shape[1]])
    out = np.zeros((m, STARTS), bool)
    for x in range(STARTS):
        rows = np.flatnonzero((lo <= x) & (x <= hi))
        if len(rows) < 2:
            continue
        b = -(-x // 8)
        rest = np.concatenate([slots[rows, x : 8 * b], slots[rows, 8 * b + 192 : x + LENGTH]], axis=1)
        rest = np.ascontiguousarray(rest).view(">u8").reshape(-1).astype(np.uint64)
        by = deep[rows, b]
        order = np.lexsort((rest, by))
        same = (by[order][1:] == by[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        out[rows[order[1:][same]], x] = True
        out[rows[order[:-1][same]], x] = True
    return out


def edge_spans(held: DataFrame) -> DataFrame:
    """k, d, spans from groups of at most GROUP contexts: suffix sorting of whole groups in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[pa.Table]:
            kept: list[pa.RecordBatch] = []
            n = 0
            for batch in batches:
                kept.append(batch)
                n += len(batch)
                if n >= BLOCK:
                    t = pa.Table.from_batches(kept).combine_chunks()
                    core = np.asarray(t["core"])
                    last = int(np.searchsorted(core, core[-1], "left"))  # the last group may go on
                    if last:
                        yield t.slice(0, last)
                    kept = t.slice(last).to_batches()
                    n = t.num_rows - last
            if n:
                yield pa.Table.from_batches(kept).combine_chunks()

        for t in blocks():
            before, after = np.asarray(t["before"]).astype(np.int64), np.asarray(t["after"]).astype(np.int64)
            slots = np.zeros((len(before), SLOT), np.uint8)
            for i, x in enumerate(t["bytes"].to_pylist()):
                a = STARTS - 1 - int(before[i])
                slots[i, a : a + len(x)] = np.frombuffer(x, np.uint8)
            found = repeated_starts(slots, STARTS - 1 - before, STARTS - 1 + after - LENGTH)
            found[np.asarray(t["nn"]) > 1] = False  # decided already
            row, x = np.nonzero(found)
            at = np.asarray(t["pos"]).astype(np.int64)[row] - (STARTS - 1) + x
            yield packed_spans(np.asarray(t["k"])[row], np.asarray(t["d"])[row], at, at + LENGTH)

    grouped = held.filter("not hot").repartition(common.shuffle_parts(held.sparkSession), "core").sortWithinPartitions("core")
    return grouped.mapInArrow(run, "k long, d long, spans binary")


def split_spans(held: DataFrame) -> DataFrame:
    """k, d, spans from larger groups. Sub-ranges of windows first: one whose common bytes are met once has no repeat, one whose
    whole span is met twice is all repeated. Then the windows of what remains, one by one, beside one sub-range of each repeated span."""
    hot = held.filter("hot")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k, d, p, _, _, _, before, after, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = STARTS - 1 - before
                for j in range(0, STARTS, RANGE):
                    top = min(j + RANGE, STARTS) - 1
                    lo, hi = max(j, start), min(top, STARTS - 1 + after - LENGTH)
                    if lo > hi:
                        continue
                    shared = x[top - start : j + LENGTH - start]
                    span = x[lo - start : hi + LENGTH - start]
                    whole = lo == j and hi == top
                    for col, y in zip(out, (k, d, p, lo, hi, xxhash.xxh3_64_intdigest(shared, j) - 2**63, xxhash.xxh3_64_intdigest(span, j) - 2**63 if whole else None), strict=True):
                        col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["k", "d", "pos", "lo", "hi", "shared", "span"])

    parts = common.stored(hot.mapInArrow(ranges, "k long, d long, pos int, lo int, hi int, shared long, span long"))
    twice = lambda c: parts.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"), F.min(F.struct("k", "d", "pos")).alias("first")).filter("n > 1")
    live = parts.join(twice("shared").select("shared"), "shared")
    judged = common.stored(live.join(twice("span").select("span", "first"), "span", "left").select("k", "d", "pos", "lo", "hi", F.col("first").isNotNull().alias("all"), (F.col("first") == F.struct("k", "d", "pos")).alias("speaks")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, d, p, lo, hi = (np.asarray(c).astype(np.int64) for c in batch.columns)
            yield packed_spans(k, d, p - (STARTS - 1) + lo, p - (STARTS - 1) + hi + LENGTH)

    sure = judged.filter("all").select("k", "d", "pos", "lo", "hi").mapInArrow(whole, "k long, d long, spans binary")
    unsure = judged.filter("not all or speaks").select("k", "d", "pos", "lo", "hi")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for k, d, p, lo, hi, before, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = STARTS - 1 - before
                for w in range(lo, hi + 1):
                    for col, y in zip(out, (k, d, p - (STARTS - 1) + w, xxhash.xxh3_128_digest(x[w - start : w + LENGTH - start], w)), strict=True):
                        col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["k", "d", "at", "h"])

    each = unsure.join(hot.select("k", "d", "pos", "before", "bytes"), ["k", "d", "pos"]).select("k", "d", "pos", "lo", "hi", "before", "bytes").mapInArrow(windows, "k long, d long, at int, h binary")
    each = common.stored(each)
    again = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(2)).astype(np.int64)
            yield packed_spans(np.asarray(batch.column(0)), np.asarray(batch.column(1)), at, at + LENGTH)

    return sure.unionByName(each.join(again, "h").select("k", "d", "at").mapInArrow(single, "k long, d long, spans binary"))


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with text cut down: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary)."""
    own = spans.groupBy("k", "d").agg(F.collect_list("spans").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, spans_ in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs, kept = [], data
                if spans_.is_valid:
                    s = np.frombuffer(b"".join(spans_.as_py()), "<i4").reshape(-1, 2).astype(np.int64)
                    s = s[np.argsort(s[:, 0], kind="stable")]
                    lo, hi = union(s[:, 0], np.minimum(s[:, 1], len(data)))
                    runs = list(zip(lo.tolist(), hi.tolist(), strict=True))
                    ends = [0, *[b for _, b in runs]]
                    kept = b"".join(data[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(data)], strict=True))
                for col, x in zip(out, (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(own, ["k", "d"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document."""
    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").withColumn("k", common.row_key("doc_id", "text")).withColumn("d", F.coalesce("doc_id", F.lit(0)))
    names = common.stored(named(sampled(plain)))
    held = common.stored(contexts(plain, names))
    spans = repeated_spans(names).unionByName(edge_spans(held))
    if held.filter("hot").limit(1).count():
        spans = spans.unionByName(split_spans(held))
    spans = common.stored(spans)
    common.dropped(names, held)
    return removed(plain, spans)


def remove_repeats(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a table of all windows, for small inputs."""
    seen: dict[bytes, int] = defaultdict(int)
    data = {k: (t or "").encode("utf-8", "surrogatepass") for k, t in texts.items()}
    for b in data.values():
        for i in range(len(b) - LENGTH + 1):
            seen[b[i : i + LENGTH]] += 1
    out = {}
    for k, b in data.items():
        cover = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                cover[i] += 1
                cover[i + LENGTH if i + LENGTH <= len(b) else len(b)] -= 1
        gone = np.cumsum(cover)[:-1] > 0 if len(b) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out
