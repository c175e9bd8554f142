"""Merkle manifest of a table of documents: a leaf for each row, a tree for each source, one root over the sources.

A tree is built from blocks of ARITY ** LEVELS neighbouring leaves. A block is walked in postorder: the walk of a subtree returns
its digest, and while it unwinds, the siblings of each child go to all leaves that the child holds. Block roots are the leaves
of the next round, until every source has one node; the same rounds run over the sources' roots. Then the rounds are unwound
from the top: each block gets the path of its own root and hands it down with what it adds. A block is walked once on the
way up, for its root alone, and once on the way down, so siblings (ARITY - 1 for each level) are never shuffled for each leaf.

Places in a source come from a range partitioning of the 32-byte leaves: rows are numbered within partitions, and the counts of
earlier partitions are added (a row for each source and partition). So a source with any share of the rows is spread over tasks, and
no task holds more than one block.

Defined results: a null field is `-`; rows without a source have a tree of their own, which comes first, and rows without doc_id come first in a
source; rows equal in doc_id stand in the order of their leaves; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ARITY = 16
#: Levels of a block.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NODE = "g string, pos long, n long, digest binary, id long, name string, other binary"
#: The path of a leaf: for each level, bottom first, its place in its run, the length of the run, and the others' digests.
PATHED = "g string, pos long, digest binary, id long, name string, other binary, top binary, path binary"


def joined(digests: list[bytes]) -> bytes:
    """Digest of a run: of its digests as hexadecimal text."""
    return sha256(b"".join(digests).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def walk(leaves: list[bytes], lo: int, hi: int, level: int, paths: list[list[bytes]] | None) -> bytes:
    """Digest of the subtree over leaves lo to hi; paths of the leaves get each level's siblings on the way back."""
    if not level:
        return leaves[lo]
    step = ARITY ** (level - 1)
    starts = range(lo, hi, step)
    children = [walk(leaves, a, min(a + step, hi), level - 1, paths) for a in starts]
    if paths is not None:
        for i, a in enumerate(starts):
            others = bytes((i, len(children))) + b"".join(children[:i] + children[i + 1 :])
            for leaf in range(a, min(a + step, hi)):
                paths[leaf].append(others)
    return joined(children)


def runs(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The levels of a path: place in the run, and the siblings."""
    at = 0
    while at < len(path):
        place, size = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(size - 1)]
        at += 2 + 32 * (size - 1)


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for place, others in runs(path):
        leaf = joined([*others[:place], leaf, *others[place:]])
    return leaf


def proof_digest(path: bytes) -> str:
    """Digest of all siblings of a path, bottom first, left to right."""
    return sha256("".join(x.hex() for _, others in runs(path) for x in others).encode()).hexdigest()


def leaf_digest(row: Callable[[str], Column] = F.col) -> Column:
    """Digest of a row of documents: each field with its length in bytes before it."""

    def field(name: str) -> Column:
        text = row(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, FIELDS)), 256))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with pos, their place in g by order, and n, the size of g."""
    spark = nodes.sparkSession
    ranged = nodes.repartitionByRange(common.shuffle_parts(spark), "g", *order).sortWithinPartitions("g", *order)
    rows = common.stored(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = rows.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(of).alias("n"))
    out = rows.withColumn("part", part).join(counts, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    out = common.stored(out.select("g", "pos", "n", "digest", "id", "name", "other"))
    common.dropped(rows)
    return out


def in_blocks(rows: DataFrame, each: Callable[[list[tuple]], list[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """each of the rows of every block (g, block) in the order of pos, as tuples. rows: g, block, pos and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        held: list[tuple] = []
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:2] != held[0][:2]:
                    out += each(held)
                    held = []
                    if len(out) >= 2000:
                        yield packed()
                        out = []
                held.append(row)
        if held:
            out += each(held)
        yield packed()

    dealt = rows.repartition(common.shuffle_parts(rows.sparkSession), "g", "block").sortWithinPartitions("g", "block", "pos")
    return dealt.mapInArrow(run, schema)


def block_of(pos: str) -> Column:
    return F.floor(F.col(pos) / ARITY**LEVELS).alias("block")


def block_roots(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks, as nodes of the next round."""

    def each(rows: list[tuple]) -> list[tuple]:
        g, block, _, n, _ = rows[0]
        root = walk([r[4] for r in rows], 0, len(rows), min(LEVELS, height(n)), None)
        return [(g, block, -(-n // ARITY**LEVELS), root, None, None, None)]

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary()]
    return in_blocks(nodes.select("g", block_of("pos"), "pos", "n", "digest"), each, NODE, kinds)


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes, their block roots, and so on until each g has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(common.stored(block_roots(out[-1])))
    return out


def with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with path and top. above: g, block, top, path of the blocks' roots."""

    def each(rows: list[tuple]) -> list[tuple]:
        *_, top, upper = rows[0]
        leaves = [r[4] for r in rows[1:]]
        paths: list[list[bytes]] = [[] for _ in leaves]
        walk(leaves, 0, len(leaves), min(LEVELS, height(rows[1][3])), paths)
        return [(r[0], r[2], *r[4:8], top, b"".join(p) + upper) for r, p in zip(rows[1:], paths, strict=True)]

    below = nodes.select("g", block_of("pos"), "pos", "n", "digest", "id", "name", "other", F.lit(None).cast("binary").alias("top"), F.lit(None).cast("binary").alias("path"))
    none = {"n": "long", "digest": "binary", "id": "long", "name": "string", "other": "binary"}
    heads = above.select("g", "block", F.lit(-1).cast("long").alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "top", "path")
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return in_blocks(below.unionByName(heads), each, PATHED, kinds)


def unwound(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest round with their paths."""
    for nodes in reversed(levels[:-1] or levels):
        out = with_paths(nodes, above)
        if nodes is not levels[0]:
            above = common.stored(out.select("g", F.col("pos").alias("block"), "top", "path"))
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """g, id, digest (leaf), top (subroot), root, path, other of every leaf. leaves: g (order of the trees is its UTF-8 bytes), id, digest, other."""
    spark = leaves.sparkSession
    nodes = leaves.select("g", "digest", "id", F.lit(None).cast("string").alias("name"), "other")
    kept = common.stored(nodes)
    trees = rounds(placed(kept, ["id", "digest", "other"]))
    common.dropped(kept)
    tops = trees[-1].select(F.lit("").alias("g"), "digest", "id", F.col("g").alias("name"), "other")
    over = rounds(placed(tops, ["name"]))
    root = over[-1].first()
    digest = bytes(root["digest"]) if root else b""
    start = spark.createDataFrame([("", 0, digest, b"")] if root else [], "g string, block long, top binary, path binary")
    subroots = common.stored(unwound(over, start))
    out = unwound(trees, subroots.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("top"), "path"))
    common.dropped(*over, *(trees[1:-1]))
    return out.withColumn("root", F.lit(digest))


def document_leaves(docs: DataFrame, other: Column) -> DataFrame:
    """Leaves of a table of documents, with another digest beside each."""
    g = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("id"), leaf_digest().alias("digest"), other.alias("other"))


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of every row: what a dataset is published with."""
    out = manifest(document_leaves(docs, F.lit(None).cast("binary")))
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("source"), hexed("digest").alias("leaf"), hexed("top").alias("subroot"), hexed("root").alias("root"), "path")


def verified(claims: DataFrame) -> DataFrame:
    """claims with proof_sha256, and folded_root: where the digest `other` (else `digest`) and the path lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            leaf, other, path = (batch.column(at(c)).to_pylist() for c in ("digest", "other", "path"))
            ends = [folded(x if x is not None else a, p).hex() for a, x, p in zip(leaf, other, path, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(proof_digest, path), pa.string()), pa.array(ends, pa.string())], [*batch.schema.names, "proof_sha256", "folded_root"])

    from pyspark.sql import types as T

    return claims.mapInArrow(run, T.StructType([*claims.schema.fields, T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())]))


def tamper_audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, each row's proof, and whether a row whose text was lower-cased (where 5 divides the crc32 of its id) still
    leads to the root."""
    lower = leaf_digest(lambda c: F.translate(F.col(c).cast("string"), UPPER, UPPER.lower()) if c == "text" else F.col(c))
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = verified(manifest(document_leaves(docs, F.when(touched, lower))))
    hexed = lambda c: F.lower(F.hex(c))
    columns = [F.col("id").alias("doc_id"), hexed("digest").alias("leaf"), hexed("top").alias("subroot"), hexed("root").alias("root"), "proof_sha256", "folded_root"]
    return out.select(*columns, (F.col("folded_root") == hexed("root")).alias("verified"))


def sql(levels: int = 6) -> str:
    """The same rows for tables of up to 16 ** levels rows a source and sources."""
    enc = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(enc(text if c == 'text' else c) for c in FIELDS)})"
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    byte = "[ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0]"
    crc = f"(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: {byte}))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    out = [
        f"d as (select doc_id, source, {leaf('text')} as leaf, case when xor({crc}, 4294967295) % 5 = 0 then {leaf(lower)} else {leaf('text')} end as other from documents)",
        "p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from d)",
        "s0 as (select source as g, pos, leaf as h, count(*) over (partition by source) as n from p)",
    ]

    def up(name: str) -> None:
        for k in range(levels):
            run = f"partition by g, pos // {ARITY} order by pos"
            out.append(f"{name}x{k} as (select g, pos, coalesce(string_agg(h, '') over ({run} rows between unbounded preceding and 1 preceding), '') as pre, coalesce(string_agg(h, '') over ({run} rows between 1 following and unbounded following), '') as post from {name}{k} where n > 1)")
            out.append(f"{name}{k + 1} as (select g, pos // {ARITY} as pos, case when max(n) > 1 then sha256(string_agg(h, '' order by pos)) else min(h) end as h, (max(n) + {ARITY - 1}) // {ARITY} as n from {name}{k} group by g, pos // {ARITY})")

    up("s")
    out.append(f"t0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as pos, h, count(*) over () as n, g as source from s{levels})")
    up("t")
    at = "select p.doc_id, p.source, p.pos, t0.pos as place, p.leaf, t0.h as subroot, '' as proof, p.other as f from p join t0 on t0.source is not distinct from p.source"
    out.append(f"q0 as ({at})")
    for k in range(2 * levels):
        name, g, pos = ("s", "q.source", "q.pos") if k < levels else ("t", "0", "q.place")
        k2 = k % levels
        out.append(f"q{k + 1} as (select q.* replace (q.proof || coalesce(x.pre || x.post, '') as proof, case when x.pos is null then q.f else sha256(x.pre || q.f || x.post) end as f) from q{k} as q left join {name}x{k2} as x on x.g is not distinct from {g} and x.pos = {pos} // {ARITY**k2})")
    root = f"(select h from t{levels})"
    return "with " + ",\n".join(out) + f"\nselect doc_id, leaf, subroot, {root} as root, sha256(proof) as proof_sha256, f as folded_root, f = {root} as verified from q{2 * levels}"
