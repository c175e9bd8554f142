"""Line dedup with a log-template tree.

A line is a list of tokens; tokens that hold a digit are variable fields from the start. The tree has a fixed depth: the
number of tokens, then the DEPTH leading tokens. In a leaf, a line's fields after these are ordered by how many documents hold the same token in that place of the leaf's
lines, and as many of the rarest as SIMILAR leaves are variable too (of equally rare ones the first). Lines of a leaf have one template if all else is the same. A template recurs if its lines stand in at
least MIN_DOCUMENTS documents with different texts (exact copies of a document count once), and so does a line of over LONG tokens
by itself that stands in LONG_DOCUMENTS; its lines are dropped everywhere but
at its first place (smallest doc_id, then line number), so one copy of every passage stays.

What is variable follows from sums alone, so it doesn't depend on how a leaf's lines are dealt. Leaves are worked out in blocks of whole leaves. The tokens of a leaf with over LEAF different
lines are counted by an exchange of its own instead, with the same result. Counting is by sums that combine before the shuffle.

Defined results: a null text is empty and stays null; blank lines are never dropped; line ends are LF; a null doc_id comes last; rows equal
in doc_id and text are one place each and lose the same lines; an empty table gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEPTH = 3
SIMILAR = 0.7
MIN_DOCUMENTS = 5
#: Lines of over LONG tokens that are equal but for fields with digits recur from LONG_DOCUMENTS documents on.
LONG = 50
LONG_DOCUMENTS = 2
LEAF = 4000
BLOCK = 20_000
CACHED_WORDS = 400_000
LAST = 2**63 - 1
DIGIT = re.compile(r"\d")


class Tokens(dict):
    """Token to a 16-bit fingerprint from 1 on; 0 for a variable field. Fills itself, bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = self[token] = 0 if DIGIT.search(token) else xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) % 65535 + 1
        return got


def signed(x: int) -> int:
    return x - (1 << 63)


def name_of(line: str, words: list[str]) -> int:
    """Hash of a line with its variable fields masked."""
    if DIGIT.search(line):
        words = ["\0" if DIGIT.search(w) else w for w in words]
    return signed(xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "replace")))


def line_name(line: str, tokens: Tokens) -> tuple[int, int, bytes] | None:
    """Leaf, name and token fingerprints of a line; None for a blank one. The name is of the whole masked line."""
    words = line.split()
    if not words:
        return None
    marks = np.fromiter(map(tokens.__getitem__, words), "<u2", len(words))
    raw = marks.tobytes()
    return signed(xxhash.xxh3_64_intdigest(raw[: 2 * DEPTH], len(words))), name_of(line, words), raw


def line_table(docs: DataFrame) -> DataFrame:
    """k, doc, print (of the text), no, leaf, line, marks: the first place of each line in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for k, doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                seen = set()
                for no, line in enumerate((text.as_py() or "").split("\n")):
                    got = line_name(line, tokens)
                    if got and got[1] not in seen:
                        seen.add(got[1])
                        held += len(got[2])
                        for col, x in zip(out, (k, LAST if doc is None else doc, mark, no, *got), strict=True):
                            col.append(x)
                if held > 4 << 20:
                    yield packed(out)
                    out, held = [[] for _ in range(7)], 0
            yield packed(out)

    def packed(cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "doc", "print", "no", "leaf", "line", "marks"])

    return docs.select("k", "doc_id", F.xxhash64("text").alias("print"), "text").mapInArrow(run, "k long, doc long, print long, no int, leaf long, line long, marks binary")


def template_of(line: int, leaf: int, marks: np.ndarray, held: np.ndarray) -> int:
    """The template of a line: its leaf and its marks without the rarest ones. held: documents that hold each mark in its place of the leaf."""
    free = int((1 - SIMILAR) * len(marks) + 1e-9)
    open_ = DEPTH + np.flatnonzero(marks[DEPTH:])
    if not free or not len(open_):
        return line
    kept = marks.copy()
    kept[open_[np.argsort(held[open_], kind="stable")[:free]]] = 0
    return signed(xxhash.xxh3_64_intdigest(kept.astype("<u2").tobytes() + leaf.to_bytes(8, "little", signed=True)))


def packed_templates(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["line", "template"])


def of_small(leaf_lines: DataFrame) -> DataFrame:
    """line, template of leaves that each fit a task; leaf_lines: leaf, line, documents, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            leaf, line, weight, marks = np.asarray(t["leaf"]), np.asarray(t["line"]), np.asarray(t["documents"]), t["marks"].to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)] if len(leaf) else [0]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = np.frombuffer(b"".join(marks[a:b]), "<u2").reshape(b - a, -1)
                held = np.zeros(rows.shape, np.int64)
                for k in range(DEPTH, rows.shape[1]):  # the leading tokens are those of the leaf
                    _, at = np.unique(rows[:, k], return_inverse=True)
                    held[:, k] = np.bincount(at, weights=weight[a:b])[at]
                out += [(n, template_of(n, int(leaf[a]), row, x)) for n, row, x in zip(line[a:b].tolist(), rows, held, strict=True)]
            return packed_templates(out)

        n = 0
        for batch in batches:
            kept.append(batch)
            n += len(batch)
            if n >= BLOCK:
                t = pa.Table.from_batches(kept).combine_chunks()
                leaf = np.asarray(t["leaf"])
                last = int(np.searchsorted(leaf, leaf[-1], "left"))
                if last:
                    yield done(t.slice(0, last))
                kept, n = t.slice(last).to_batches(), t.num_rows - last
        if n:
            yield done(pa.Table.from_batches(kept).combine_chunks())

    dealt = leaf_lines.select("leaf", "line", "documents", "marks").repartition(common.shuffle_parts(leaf_lines.sparkSession), "leaf").sortWithinPartitions("leaf", "line")
    return dealt.mapInArrow(run, "line long, template long")


def of_large(leaf_lines: DataFrame) -> DataFrame:
    """line, template of leaves of any size: each token of each place is a row, counted over all lines of its leaf."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.frombuffer(m, "<u2") for m in batch.column(3).to_pylist()]
            size = [max(0, len(m) - DEPTH) for m in marks]
            each = [np.repeat(np.asarray(batch.column(k)), size) for k in range(3)]
            at = np.concatenate([np.arange(DEPTH, DEPTH + n) for n in size] or [np.zeros(0)])
            mark = np.concatenate([m[DEPTH:] for m in marks] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(at, pa.int32()), pa.array(mark, pa.int32())], ["leaf", "line", "documents", "at", "mark"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, line, marks, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                m = np.frombuffer(marks, "<u2")
                held = np.zeros(len(m), np.int64)
                for x in counts or []:
                    held[x["at"]] = x["n"]
                out.append((line, template_of(line, leaf, m, held)))
            yield packed_templates(out)

    large = leaf_lines.select("leaf", "line", "documents", "marks")
    tokens = large.mapInArrow(placed, "leaf long, line long, documents long, at int, mark int").filter("mark != 0")
    counts = tokens.groupBy("leaf", "at", "mark").agg(F.sum("documents").alias("n"))
    each = tokens.join(counts, ["leaf", "at", "mark"]).groupBy("line").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    return large.join(each, "line", "left").select("leaf", "line", "marks", "counts").mapInArrow(named, "line long, template long")


def templates(leaf_lines: DataFrame) -> DataFrame:
    """line, template of all lines of each leaf; leaf_lines: leaf, line, documents, marks, n (lines of the leaf)."""
    small = of_small(leaf_lines.filter(F.col("n") <= LEAF))
    large = leaf_lines.filter(F.col("n") > LEAF)
    return small.unionByName(of_large(large)) if large.limit(1).count() else small


def recurring(table: DataFrame, min_documents: int) -> DataFrame:
    """line, first (doc, k, no): lines of recurring templates and the place that keeps one."""
    lines = table.groupBy("line", "print").agg(F.min(F.struct("doc", "k", "no")).alias("first"), F.min("leaf").alias("leaf"), (F.max(F.length("marks")) > 2 * LONG).alias("long"))
    lines = common.stored(lines.groupBy("line").agg(F.count("*").alias("documents"), F.min("first").alias("first"), F.min("leaf").alias("leaf"), F.max("long").alias("long")))
    # a leaf matters if all its lines together could recur, and needs clustering if it has several
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("documents").alias("all")).filter(F.col("all") >= min_documents)
    several = lines.join(leaves.filter("n > 1").select("leaf", "n"), "leaf")
    marks = table.select("line", F.struct("doc", "k", "no").alias("first"), "marks")
    open_ = common.stored(several.join(marks, ["line", "first"]).select("leaf", "line", "documents", "first", "marks", "n"))
    of = common.stored(templates(open_))
    joined = of.groupBy("template").agg(F.count("*").alias("n")).filter("n > 1").select("template")
    merged = of.join(joined, "template")
    # templates of several lines: count their documents anew
    wide = table.select("line", "print", "doc", "k", "no").join(merged, "line")
    counted = wide.groupBy("template", "print").agg(F.min(F.struct("doc", "k", "no")).alias("first")).groupBy("template").agg(F.count("*").alias("documents"), F.min("first").alias("first"))
    from_merged = merged.join(counted.filter(F.col("documents") >= min_documents), "template").select("line", "first")
    needed = F.when(F.col("long"), min(min_documents, LONG_DOCUMENTS)).otherwise(min_documents)
    alone = lines.filter(F.col("documents") >= needed).select("line", "first").join(from_merged.select("line"), "line", "left_anti")
    return alone.unionByName(from_merged)


def dropped_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc, k and drop: the lines (names) that go from each document, each with the line number that stays or -1. docs: doc_id, text, k."""
    table = common.stored(line_table(docs))
    lines = recurring(table, min_documents)
    places = table.select("doc", "k", "line").join(lines, "line")
    keep = F.when((F.col("first.k") == F.col("k")) & (F.col("first.doc") == F.col("doc")), F.col("first.no")).otherwise(-1)
    out = common.stored(places.groupBy("doc", "k").agg(F.collect_set(F.struct("line", keep.alias("no"))).alias("drop")))
    common.dropped(table)
    return out


def cut_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, text: str = "text") -> DataFrame:
    """docs with the recurring lines cut out of text, and _lines, _cut: how many lines there were and how many went. Own columns of
    such names get the prefix __formloom."""
    clash = {c: f"__formloom{c}" for c in ("_lines", "_cut", "_doc", "_key", "_drop") if c in docs.columns}
    base = docs.withColumnsRenamed(clash)
    slim = base.select("doc_id", F.col(text).alias("text"), common.row_key("doc_id", text).alias("k"))
    cuts = dropped_lines(slim, min_documents).select(F.col("doc").alias("_doc"), F.col("k").alias("_key"), F.col("drop").alias("_drop"))
    marked = base.withColumn("_key", common.row_key("doc_id", text)).withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).join(cuts, ["_doc", "_key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kept, lines, cut = batch.schema.get_field_index(text), [], [], []
            drops = batch.column(batch.schema.get_field_index("_drop"))
            for value, drop in zip(batch.column(at), drops, strict=True):
                t = value.as_py()
                parts = (t or "").split("\n")
                lines.append(len(parts) if t else 0)
                if not drop.is_valid:
                    kept.append(t)
                    cut.append(0)
                    continue
                go = {d["line"]: d["no"] for d in drop.as_py()}
                rest = [p for no, p in enumerate(parts) if not ((words := p.split()) and go.get(name_of(p, words), no) != no)]
                kept.append("\n".join(rest))
                cut.append(len(parts) - len(rest))
            cols = [pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "_drop"]
            names = [n for n in batch.schema.names if n != "_drop"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(cut, pa.int64())], [*names, "_lines", "_cut"])

    wanted = marked.select(*base.columns, "_drop")
    fields = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in base.schema.fields]
    return wanted.mapInArrow(run, T.StructType([*fields, T.StructField("_lines", T.LongType()), T.StructField("_cut", T.LongType())]))


def line_dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with recurring lines cut out; documents that lost all of their text go. Columns as before."""
    out = cut_lines(docs, min_documents)
    kept = out.filter("_cut = 0 or trim(text) != ''").drop("_lines", "_cut")
    return kept.withColumnsRenamed({f"__formloom{c}": c for c in docs.columns if f"__formloom{c}" in kept.columns})


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 of every document."""
    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    out = cut_lines(plain)
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_cut").alias("n_dropped"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
