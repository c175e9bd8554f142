"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents are sets of 5-word shingles (64-bit hashes of whole texts). Equal sets become one node first. Nodes that share a
band of their signature are candidates. A candidate pair's signatures are compared in batches of 32: after each, the
posterior of the similarity (uniform prior, so a Beta) says how likely it is to reach the threshold; pairs below MISS are
pruned. Survivors are verified on their full sets.

Buckets are never expanded into all pairs. First every bucket compares one pivot, the node that lies in the most populous
buckets (in a group of copies that is the text they derive from), with its other members; verified links merge
components, and buckets with one component left are done, so large groups of copies cost about one comparison a member. What
is left is compared by signatures in blocks of at most 2 * CHUNK members, inside the tasks: pairs of different components, each in the
first bucket that they share only. Pairs that pass are joined to the sets, unless a block has more of them than members:
such a block gets the sets itself and verifies as it connects its members, so that only links are rows. So every candidate pair is
compared unless its two texts are connected already.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6, and is pruned with at most 3 * MISS.

Defined results: null or blank texts have an empty set, link to nothing and are their own class; a null doc_id has a null
class and is kept; equal doc_ids with different texts are separate nodes, and each text has the class of its own set; rows equal in doc_id
and text are all reported, and one of them is kept; an empty table gives no rows; extra columns are ignored by the report and kept by keep_first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Similarity threshold as a fraction of whole numbers.
NUM, DEN = 75, 100
#: A pair is pruned when its chance to reach the threshold is below this.
MISS = 1e-5
BATCH = 32
#: Members of a bucket in one part of a block.
CHUNK = 512
CACHED_WORDS = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """Word (bytes) to a 64-bit hash; fills itself, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of fewer words, one hash of them all. Words are runs of bytes other
    than space and 09-0D with A-Z lowered, just as bytes.lower() and bytes.split() see them."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = len(w) - SHINGLE + 1
    out = h[:n].copy()
    for k in range(1, SHINGLE):
        out = mixed(out * MIX + h[k : k + n])
    return np.unique(out)


@functools.lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the hash functions, from a fixed rule."""
    raw = [int.from_bytes(hashlib.sha256(f"minhash {k}".encode()).digest()[:16], "little") for k in range(HASHES)]
    return np.array([(x & (2**64 - 1)) | 1 for x in raw], np.uint64)[:, None], np.array([x >> 64 for x in raw], np.uint64)[:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each; long sets in blocks."""
    a, b = permutations()
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, (a * s[None, i : i + 1024] + b).min(axis=1), out=low)
    return (mixed(low) >> np.uint64(32)).astype("<u4")


@functools.lru_cache(maxsize=1)
def least_matches() -> tuple[int, ...]:
    """After each batch: with fewer matches than this, P(similarity >= threshold | matches) is below MISS."""
    t, out = NUM / DEN, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:  # Beta(m+1, n-m+1) above t is the chance of at most m successes in n+1 trials
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
            m += 1
        out.append(m)
    return tuple(out)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, node (128-bit digest of the set; null if empty) and signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            n, node, sig = [], [], []
            last: dict[bytes, bytes] = {}
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                if not len(s):
                    node.append(None)
                    sig.append(None)
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                if d not in last:
                    last[d] = signature(s).tobytes()
                node.append(d)
                sig.append(last[d])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "t", "n_shingles", "node", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n_shingles long, node binary, sig binary")


def set_table(docs: DataFrame) -> DataFrame:
    """node, again and its set (packed hashes), of the rows whose text is that node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            node, again, items = [], [], []
            seen = set()
            for text, d, more in zip(batch.column(0), *[c.to_pylist() for c in batch.columns[1:]], strict=True):
                if d in seen:
                    continue
                raw = shingles(text.as_py(), words).tobytes()
                if xxhash.xxh3_128_digest(raw) == d:
                    seen.add(d)
                    node.append(d)
                    again.append(more)
                    items.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(again, pa.bool_()), pa.array(items, pa.binary())], ["node", "again", "items"])

    return docs.select("text", "node", "again").mapInArrow(run, "node binary, again boolean, items binary")


def bucket_members(sigs: DataFrame) -> DataFrame:
    """bucket, band, node: memberships in buckets of at least two nodes."""
    key = lambda k: F.xxhash64(F.lit(k), F.substring("sig", k * ROWS * 4 + 1, ROWS * 4))
    each = sigs.select("node", F.posexplode(F.array(*[key(k) for k in range(BANDS)])).alias("band", "bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return each.join(shared, "bucket").select("bucket", "band", "node", "n")


def pruned(pairs: DataFrame) -> DataFrame:
    """Pairs a, b, sig_a, sig_b whose similarity may reach the threshold, as far as the signatures tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = least_matches()
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, HASHES)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(-1, HASHES)
            live, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, least in enumerate(need):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[live] += (x[live, part] == y[live, part]).sum(axis=1)
                live = live[matches[live] >= least]
            got = batch.take(pa.array(live))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) reach the threshold."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return DEN * shared >= NUM * (len(both) - shared)


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs a, b, items_a, items_b whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if alike(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)):
                    keep.append(i)
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["a", "b"])

    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(run, "a binary, b binary")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of all nodes in links, by taking the smallest neighbour's class and then its
    class in turn, until nothing changes. Each round is stored."""
    edges = common.stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = common.stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = label.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = common.stored(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        common.dropped(label)
        done = not new.filter("old != comp").limit(1).count()
        label, new = new, None
        if done:
            common.dropped(edges)
            return label.select("node", "comp")


def link_nodes(spark: SparkSession, sigs: DataFrame, sets_of) -> DataFrame | None:
    """Verified links a, b between nodes that span all components. sigs: node, n_shingles, sig, one row a node;
    sets_of(nodes) gives node, items."""
    members = common.stored(bucket_members(sigs))
    if not members.limit(1).count():
        return None
    some = members.select("node").distinct()
    candidates = common.stored(sigs.join(some, "node"))
    sets = sets_of(candidates.select("node"))
    # the pivot lies in the most populous buckets, i.e. it is what most others resemble
    weight = members.groupBy("node").agg(F.sum("n").alias("k"))
    best = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("k", "node")).alias("p"))
    pivots = common.stored(best.select("bucket", F.col("p.node").alias("pivot")))
    pairs = members.join(pivots, "bucket").filter("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    pairs = common.stored(pairs.distinct())
    side = lambda x: candidates.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)")
    links = exact(pruned(sized), sets)
    # pivots have met all others of their buckets, and leave
    label = components(spark, links)
    rest = members.join(pivots.withColumnRenamed("pivot", "node"), ["bucket", "node"], "left_anti")
    rest = common.stored(rest.join(label, "node", "left").select("bucket", "band", "node", F.coalesce("comp", "node").alias("comp")))
    several = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    parts = rest.join(several.select("bucket", "n"), "bucket").join(candidates.select("node", "n_shingles", "sig"), "node")
    blocks = common.stored(dealt(parts))
    found = common.stored(block_pairs(blocks))
    light = exact(found.filter("a is not null").select("a", "b").distinct(), sets)
    heavy = found.filter("a is null").select("bucket", "i", "j")
    return common.stored(links.union(light).union(block_links(blocks.join(heavy, ["bucket", "i", "j"]).join(sets, "node"))))


def exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b among the pairs, verified on whole sets (stored)."""
    items = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
    return common.stored(verified(common.stored(pairs).join(items("a"), "a").join(items("b"), "b")))


GROUP = ["bucket", "i", "j"]


def dealt(members: DataFrame) -> DataFrame:
    """Members (bucket, band, node, comp, n of the bucket, n_shingles, sig) at the blocks (i, j) of their part, one a part of the bucket."""
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = members.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "comp", "n_shingles", "sig")


class Block:
    """The members of one block as arrays."""

    def __init__(self, t: pa.Table):
        self.node, self.n = t["node"].to_pylist(), np.asarray(t["n_shingles"])
        self.comp = np.unique(np.array(t["comp"].to_pylist(), object), return_inverse=True)[1]
        self.own, self.across, self.band = np.asarray(t["own"]), t["i"][0].as_py() != t["j"][0].as_py(), t["band"][0].as_py()
        self.sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(-1, HASHES)

    def partners(self, x: int) -> np.ndarray:
        """Later members of other components that the signatures don't rule out as partners of x, likeliest first, but for those that
        share an earlier band, whose bucket has them."""
        n, own, sig, band = self.n, self.own, self.sig, self.band
        y = np.arange(x + 1, len(n))
        y = y[(self.comp[y] != self.comp[x]) & (DEN * np.minimum(n[y], n[x]) >= NUM * np.maximum(n[y], n[x])) & ((own[y] != own[x]) if self.across else True)]
        matches = np.zeros(len(y), np.int64)
        for k, least in enumerate(least_matches()):
            if not len(y):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (sig[y, part] == sig[x, part]).sum(axis=1)
            y, matches = y[matches >= least], matches[matches >= least]
        if len(y) and band:
            fresh = ~(sig[y, : band * ROWS] == sig[x, : band * ROWS]).reshape(len(y), band, ROWS).all(axis=2).any(axis=1)
            y, matches = y[fresh], matches[fresh]
        return y[np.argsort(-matches, kind="stable")]


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks out of sorted batches, several at once: the last one of what was read may go on."""
    kept: list[pa.RecordBatch] = []
    n, size = 0, 0
    for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
        kept.append(batch)
        n, size = n + len(batch), size + batch.nbytes
        if n >= 8192 or size > 32 << 20:
            t = pa.Table.from_batches(kept).combine_chunks()
            keys = np.stack([np.asarray(t[c]).astype(np.int64) for c in GROUP])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield t.slice(0, last)
            kept, n, size = t.slice(last).to_batches(), t.num_rows - last, 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()


def each_block(t: pa.Table) -> Iterator[pa.Table]:
    keys = np.stack([np.asarray(t[c]).astype(np.int64) for c in GROUP])
    cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), t.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield t.slice(a, b - a)


def spread(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(common.shuffle_parts(blocks.sparkSession), *GROUP).sortWithinPartitions(*GROUP, "node")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs a, b that the signatures don't rule out, of blocks with no more of them than members; a block with more gives one row
    without a pair. No set is needed here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            out: list[tuple] = []
            for block in each_block(t):
                key = tuple(block[c][0].as_py() for c in GROUP)
                b, pairs = Block(block), []
                for x in range(len(b.n) - 1):
                    pairs += [(*key, min(b.node[x], b.node[z]), max(b.node[x], b.node[z])) for z in b.partners(x).tolist()]
                    if len(pairs) > len(b.n):
                        pairs = [(*key, None, None)]
                        break
                out += pairs
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate(kinds)], [*GROUP, "a", "b"])

    return spread(blocks).mapInArrow(run, "bucket long, i int, j int, a binary, b binary")


def block_links(blocks: DataFrame) -> DataFrame:
    """Links a, b between different components, as many as it takes to connect a block's members: what the signatures don't
    rule out is verified on the sets (items), unless the block has connected it."""

    def compared(t: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        b, items = Block(t), [np.frombuffer(i.as_py(), np.uint64) for i in t["items"]]
        for x in range(len(b.n) - 1):
            for z in b.partners(x).tolist():
                if b.comp[z] != b.comp[x] and alike(items[x], items[z]):
                    b.comp[b.comp == b.comp[z]] = b.comp[x]
                    yield min(b.node[x], b.node[z]), max(b.node[x], b.node[z])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            out = [p for block in each_block(t) for p in compared(block)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], ["a", "b"])

    return spread(blocks).mapInArrow(run, "a binary, b binary")


def classified(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n_shingles, node) of every document, and the classes: node, comp (a node of the class), component (smallest doc_id)."""
    spark = plain.sparkSession
    rows = common.stored(nodes(plain))
    own = rows.filter("node is not null and doc_id is not null").groupBy("node", "doc_id").agg(F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    least = F.min(F.struct("doc_id", (F.col("n") > 1).alias("again")))
    sigs = own.groupBy("node").agg(least.alias("m"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    sigs = common.stored(sigs.select("node", F.col("m.doc_id").alias("first"), F.col("m.again").alias("again"), "n_shingles", "sig"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        which = wanted.join(sigs.select("node", "first", "again"), "node").select(F.col("first").alias("doc_id"), "node", "again")
        # a doc_id may stand for several texts: the set's digest settles which is meant
        every = common.stored(set_table(plain.join(which, "doc_id")))
        # rows that repeat a doc_id and text may bring their set more than once
        once = common.stored(every.filter("again").groupBy("node").agg(F.first("items").alias("items")))
        return every.filter("not again").select("node", "items").unionByName(once)

    links = link_nodes(spark, sigs.select("node", "n_shingles", "sig"), sets_of)
    slim = rows.select("doc_id", "t", "n_shingles", "node")
    if links is None:
        return slim, sigs.select("node", F.col("node").alias("comp"), F.col("first").alias("component"))
    label = components(spark, links)
    of = common.stored(sigs.select("node", "first").join(label, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp")))
    return slim, of.join(of.groupBy("comp").agg(F.min("first").alias("component")), "comp").select("node", "comp", "component")


def plain_rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    rows, classes = classified(plain_rows(docs))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(classes.drop("comp"), "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that with the smallest doc_id, of several texts of that doc_id in the class the one with the
    least hash, of equal rows one. Documents without words or doc_id stay. Columns as before."""
    rows, classes = classified(plain_rows(docs))
    speaks = rows.join(classes.filter("comp is not null"), "node").filter("doc_id = component").groupBy("comp", "doc_id", "t").agg(F.count("*").alias("n"))
    chosen = speaks.groupBy("comp").agg(F.min(F.struct("t", "doc_id", "n")).alias("c")).select(F.col("c.doc_id").alias("__formloom_doc"), F.col("c.t").alias("__formloom_text"), F.col("c.n").alias("__formloom_copies"))
    chosen = common.stored(chosen)
    keyed = docs.withColumn("__formloom_d", F.col("doc_id").cast("long")).withColumn("__formloom_t", F.xxhash64(F.col("text").cast("string")))
    no_words = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \t-\r]")
    alone = keyed.filter(F.col("__formloom_d").isNull() | no_words).select(*docs.columns)
    kept = keyed.filter(F.col("__formloom_d").isNotNull() & ~no_words).join(chosen, (F.col("__formloom_d") == F.col("__formloom_doc")) & (F.col("__formloom_t") == F.col("__formloom_text")))
    single = kept.filter("__formloom_copies = 1").select(*docs.columns)
    whole = F.struct(*docs.columns)
    order = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if docs.schema[c].dataType.typeName() in ("string", "long", "integer", "double", "boolean")])
    repeated = kept.filter("__formloom_copies > 1").groupBy("__formloom_d", "__formloom_t").agg(F.min_by(whole, order).alias("r")).select("r.*")
    return alone.unionByName(single).unionByName(repeated)
