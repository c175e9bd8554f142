"""Hierarchical Pitman-Yor language model of word pairs: each word is a restaurant for the words that follow it, and all of these
share one parent, whose own parent is the uniform base 1 / (V + 1).

    P(w)     = (c_w - d0 t_w + (s0 + d0 T) / (V + 1)) / (s0 + C)
    P(w | u) = (c_uw - d1 t_uw + (s1 + d1 T_u) P(w)) / (s1 + c_u)

c counts customers, t tables; a table of a context is a customer of the parent. Seatings are sampled by Gibbs: a customer gets up
and sits down again by the Chinese restaurant's odds. P(w | u) is the mean over the samples of the last round.

How it runs. Texts become blocks of about BLOCK tokens, each with its own words and word pairs. Words get ids from one count over all
blocks, bucket by bucket. Pairs go to owners (about OWNER tokens each): by the first word, and, where that one is frequent, by its second word as well, so no
context is kept whole by a task. The parent's dishes belong to owners by word. Owners of pairs and owners of words exchange tables and
parent's rates once in each of ROUNDS rounds; in between, seatings of one owner move with the other owners' tables as they were (one for each dish at first). At last each block
asks the owners for its own pairs and words, and adds up its documents' scores. What goes between owners are packed arrays in
sorted order, so an answer needs no keys. All rows count; nothing is cut off by rarity. A word that occurs once has one table everywhere and is never sent.

Discounts come from the counts of counts (n1 / (n1 + 2 n2)); strengths are fixed. In a sweep a dish moves each of its customers once on average; one of over
MOVES customers seats all of them at once, from the exact distribution of the number of its tables. The start is about the expected number. Draws depend on owner and round alone: a task that is run
again draws the same.

Defined results: a null or empty text is its end alone; a null doc_id is learned from; repeated rows count as documents of their own; a text of any length
is one row of ids in its block; without any training document all scores and base scores are those of V = 0, log10(1) = 0; an empty table gives no rows; extra columns are
ignored. A bucket numbers its words itself, so over 2^31 ids are refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 2_000_000
OWNER = 1_000_000
#: Customers of a context for each owner that has a part of it.
PIECE = 250_000
ROUNDS = 1
#: Sweeps of a round before the first sample, and samples (a sweep each).
BURN = 2
SAMPLES = 3
#: Dishes of up to so many customers move them one by one; larger ones draw the number of their tables.
MOVES = 16
STRENGTH = 1.0
#: Bit of the ids of words that occur once; id of words that training doesn't know.
ONCE = np.uint64(1 << 31)
UNKNOWN = np.uint64(0xFFFFFFFF)
#: A-Z lower-cased; the blanks of bytes.split() are those between words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

PARCEL = "kind string, owner long, peer long, keys binary, a binary, b binary, total double"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
NAMES = [f.split()[0] for f in PARCEL.split(", ")]


def put(x: np.ndarray) -> bytes:
    return x.dtype.char.encode() + zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def get(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x[1:]), x[:1].decode())


def put_sorted(x: np.ndarray) -> bytes:
    """Ascending ids, as differences."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return put(d.astype(np.uint32) if len(d) and int(d.max()) < 1 << 32 else d)


def get_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(get(x).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def split(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Owners and the places of what is theirs, in order."""
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        yield int(owner[order[a]]), order[a:b]


def word_owner(ids: np.ndarray, owners: int) -> np.ndarray:
    return (mixed(ids) % np.uint64(owners)).astype(np.int64)


def pair_owner(u: np.ndarray, w: np.ndarray, count: np.ndarray, owners: int) -> np.ndarray:
    """A context goes to one owner, a frequent one to several by the word that follows."""
    pieces = (1 + count // PIECE).astype(np.uint64)
    return (mixed(u << np.uint64(20) ^ mixed(w) % pieces) % np.uint64(owners)).astype(np.int64)


def parcels(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in KINDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], NAMES)


def by_owner(rows: DataFrame, each: Callable[[int, dict[str, list[dict]]], Iterator[tuple]]) -> DataFrame:
    """each of all parcels of an owner, by kind and in the order of their peers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["owner"] != at and held:
                    for out in each(at, held):
                        yield parcels([out])
                    held = {}
                at = row["owner"]
                held.setdefault(row["kind"], []).append(row)
        if held:
            for out in each(at, held):
                yield parcels([out])
        yield parcels([])

    dealt = rows.repartition(common.shuffle_parts(rows.sparkSession), "owner").sortWithinPartitions("owner", "kind", "peer")
    return dealt.mapInArrow(run, PARCEL)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


#: Documents whose pairs are packed together.
TOGETHER = 2000


def text_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Parcels of each block: `text` (TOGETHER documents each; a: their word pairs, as places in the block's list), `pairs` (keys: the pairs as
    numbers of words; a: how often in training) and for each bucket `spell` (the block's words there; a: how often in training). Words are
    numbered bucket by bucket. The end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, held, size = TaskContext.get().partitionId() << 32, Words({b"": 0}), [], 0

        def ended() -> Iterator[tuple]:
            if not held:
                return
            spelled = list(words)
            bucket = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled)) % buckets
            number = np.empty(len(spelled), np.uint64)
            number[np.argsort(bucket, kind="stable")] = np.arange(len(spelled), dtype=np.uint64)
            ids = number[np.concatenate([x[2] for x in held])]
            lengths = np.array([len(x[2]) for x in held])
            learned = np.repeat([not x[1] for x in held], lengths)
            before = np.concatenate([number[:1], ids[:-1]])
            before[np.cumsum(lengths)[:-1]] = number[0]
            keys, at = np.unique(before << np.uint64(32) | ids, return_inverse=True)
            n = np.bincount(ids[learned].astype(np.int64), minlength=len(words)).astype(np.uint32)
            for owner, mine in split(bucket):
                yield "spell", owner, block, zstandard.compress(b"\n".join([spelled[i] for i in mine.tolist()]), 1), put(n[number[mine].astype(np.int64)]), None, None
            trained = np.bincount(at[learned], minlength=len(keys)).astype(np.uint32)
            yield "pairs", block, -1, put_sorted(keys), put(trained), None, None
            # a score is a sum, so the order of a text's pairs doesn't matter: their places ascend, and are stored as gaps
            ends = np.cumsum(lengths)
            places = np.sort(np.repeat(np.arange(len(held)), lengths) << 32 | at) & 0xFFFFFFFF
            gaps = np.diff(places, prepend=0)
            gaps[ends - lengths] = places[ends - lengths]
            for a in range(0, len(held), TOGETHER):
                some, b = held[a : a + TOGETHER], min(a + TOGETHER, len(held))
                of = np.array([(doc or 0, doc is not None, out, n) for (doc, out, _), n in zip(some, lengths[a:b], strict=True)], np.int64)
                own = gaps[ends[a] - lengths[a] : ends[b - 1]].astype("<u4").view(np.uint8).reshape(-1, 4).T  # byte by byte, the high ones are mostly 0
                yield "text", block, a, None, put(own), put(of), None

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = (text.as_py() or "").encode().translate(LOWER).split()
                tokens.append(b"")
                held.append((doc, out, np.fromiter(map(words.__getitem__, tokens), np.uint32, len(tokens))))
                size += len(tokens)
                if size >= BLOCK:
                    for row in ended():
                        yield parcels([row])
                    block, words, held, size = block + 1, Words({b"": 0}), [], 0
        for row in ended():
            yield parcels([row])
        yield parcels([])

    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, PARCEL)


def numbered(spelled: DataFrame, buckets: int) -> DataFrame:
    """`named`: ids and counts of a block's words of a bucket, frequent words first; `tokens`, `words`, `once`, `twice`: totals of the bucket."""

    def each(bucket: int, got: dict[str, list[dict]]) -> Iterator[tuple]:
        index, at = Words(), []
        for r in got["spell"]:
            words = zstandard.decompress(r["keys"]).split(b"\n")
            at.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        c = np.bincount(np.concatenate(at), weights=np.concatenate([get(r["a"]) for r in got["spell"]]), minlength=len(index)).astype(np.int64)
        if len(c) * buckets >= 1 << 31:
            raise ValueError("over 2^31 word ids")
        ids = np.empty(len(c), np.uint64)
        ids[np.argsort(-c, kind="stable")] = np.arange(len(c), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        ids = np.where(c == 0, UNKNOWN, np.where(c == 1, ids | ONCE, ids)).astype(np.uint32)
        for r, mine in zip(got["spell"], at, strict=True):
            yield "named", r["peer"], bucket, None, put(ids[mine]), put(c[mine].astype(np.uint32) if c.max() < 1 << 32 else c[mine]), None
        for kind, n in (("tokens", c.sum()), ("words", (c > 0).sum()), ("once", (c == 1).sum()), ("twice", (c == 2).sum())):
            yield kind, bucket, -1, None, None, None, float(n)

    return by_owner(spelled, each)


def requests(pairs: DataFrame, named: DataFrame, owners: int) -> DataFrame:
    """What each block asks for: `lexicon` (owner: the block itself; ids and counts of its words), `ask` (pairs, of their owner), `want` (words, of theirs)."""

    def each(block: int, got: dict[str, list[dict]]) -> Iterator[tuple]:
        ids, counts = (np.concatenate([get(r[k]) for r in got["named"]]) for k in "ab")
        yield "lexicon", block, -1, put(ids), put(counts), None, None
        ids, counts = ids.astype(np.uint64), counts.astype(np.int64)
        keys, trained = get_sorted(got["pairs"][0]["keys"]), get(got["pairs"][0]["a"])
        for owner, mine, places in routed(keys, ids, counts, owners):
            yield "ask", owner, block, put_sorted(mine), put(trained[places]), None, None
        for owner, wanted in wanted_words(ids, owners):
            yield "want", owner, block, put_sorted(wanted), None, None, None

    return by_owner(pairs.unionByName(named), each)


def routed(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """owner, pairs of ids in ascending order, and their places in keys: of all pairs whose words training knows."""
    first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    u, w = ids[first], ids[second]
    places = np.flatnonzero((u != UNKNOWN) & (w != UNKNOWN))
    u, w, count = u[places], w[places], counts[first[places]]
    pairs = u << np.uint64(32) | w
    order = np.argsort(pairs)
    places, pairs = places[order], pairs[order]
    for owner, at in split(pair_owner(u[order], w[order], count[order], owners)):
        yield owner, pairs[at], places[at]


def wanted_words(ids: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """owner and ids, ascending, of the words that occur more than once."""
    ids = np.unique(ids[ids < ONCE])
    for owner, at in split(word_owner(ids, owners)):
        yield owner, ids[at]


def expected_tables(c: np.ndarray, rate: np.ndarray, discount: float) -> np.ndarray:
    """About how many tables c customers of a dish take, where a new one has the weight rate: steps of growing length."""
    t, k = np.ones(len(c)), np.ones(len(c))
    while len(c) and (k < c).any():
        step = np.minimum(np.maximum(1.0, np.floor(k / 4)), c - k)
        t += step * rate / (rate + np.maximum(k - discount * t, 1e-9))
        k += step
    return np.clip(np.round(t), 1, c).astype(np.int64)


def one_large(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sizes of t tables a dish of c customers: all but the first have one."""
    sizes = np.ones(int(t.sum()), np.int64)
    sizes[np.cumsum(t) - t] += c - t
    return sizes


#: About the microseconds of a row of stirling_rows and of each number in it, and of a number of stirling_integrals.
ROW, CELL, INTEGRAL = 8.0, 0.003, 7.0
#: Points of an integral; numbers whose points are held at once.
POINTS = 32
AT_ONCE = 512


def stirling(discount: float, c: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """For each c (ascending, distinct): logarithms of the generalised Stirling numbers of c and 1..k, less that of c and 1. Small c go row by row up to the largest of them, those beyond by
    integrals, which cost the same for any c: a walk over all rows grows with the largest dish times the number of its tables."""
    widest = np.maximum.accumulate(np.maximum(1, k))
    cost = np.concatenate([[0.0], c * (ROW + CELL * widest)]) + INTEGRAL * np.concatenate([np.cumsum(k[::-1])[::-1], [0]])
    few = int(np.argmin(cost))
    out = [None] * few + stirling_integrals(discount, c[few:], k[few:])
    rest = np.array([i for i, x in enumerate(out) if x is None], np.int64)
    for i, x in zip(rest.tolist(), stirling_rows(discount, c[rest], k[rest]), strict=True):
        out[i] = x
    return out


def stirling_rows(discount: float, c: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """Rows follow one another by the ratio of neighbours, q(c + 1, t) = (1 + (c - d t) q(c, t)) / (1 / q(c, t - 1) + c - d (t - 1)): all terms are positive, so nothing cancels or overflows."""
    width = max(1, int(k.max(initial=1)) - 1)
    q, top, under, dt = np.zeros(width), np.empty(width), np.empty(width), discount * np.arange(2, width + 2)
    out, row = [], 1
    for many, upto in zip(c.tolist(), k.tolist(), strict=True):
        for n in range(row, many):
            m = min(n, width)
            a, b, x = top[:m], under[:m], q[:m]
            np.subtract(n, dt[:m], out=b)
            np.multiply(b, x, out=a)
            a += 1.0
            b += discount
            if m > 1:
                np.divide(1.0, q[: m - 1], out=x[: m - 1])
                b[1:] += x[: m - 1]
            np.divide(a, b, out=x)
        row = many
        out.append(np.concatenate([[0.0], np.cumsum(np.log(q[: upto - 1]))]))
    return out


def stirling_integrals(discount: float, c: np.ndarray, k: np.ndarray) -> list[np.ndarray | None]:
    """The same numbers one by one: S(c, t) is c! / (t! d^t) times the coefficient of x^c in (1 - (1 - x)^d)^t, an integral around 0. Its path, with w = 1 - x, is the parabola w = w0 (1 + iy)^2
    through the point w0 where the integrand is least on the real line; there steps of 0.4 of its width leave an error far below that of the floating-point numbers. Every second
    point alone must give nearly the same and the last point nothing, for all t of a c, else None."""
    many, t = np.repeat(c, k).astype(np.float64), np.concatenate([np.arange(1.0, n + 1) for n in k.tolist()] or [np.zeros(0)])
    parts = [coefficients(discount, many[i : i + AT_ONCE], t[i : i + AT_ONCE]) for i in range(0, len(t), AT_ONCE)]
    whole, sure = (np.concatenate([p[i] for p in parts] or [np.zeros(0)]) for i in range(2))
    below = np.cumsum(np.log(np.arange(1.0, int(k.max(initial=0)) + 1) * discount))  # t! d^t
    ends = np.cumsum(k).tolist()
    return [whole[a:b] - whole[a] - (below[: b - a] - below[0]) if sure[a:b].all() else None for a, b in zip([0, *ends], ends, strict=False)]


def log_less(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary part of log(1 - x - iy), exact for small x and y as well."""
    return 0.5 * np.log1p(x * (x - 2) + y * y), np.arctan2(-y, 1 - x)


def coefficients(d: float, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the coefficients of x^c in (1 - (1 - x)^d)^t, which are t d / c times those of x^(c - 1) in (1 - x)^(d - 1) (1 - (1 - x)^d)^(t - 1); which are sure."""
    with np.errstate(all="ignore"):  # what goes wrong is not sure
        # log w0 by Newton's steps: c w / (1 - w) = 1 + (t - 1) d w^d / (1 - w^d)
        at = np.minimum(np.log(0.5), np.maximum(0.0, np.log(np.maximum(1.0, t * d * c**-d)) / (1 - d)) - np.log(c))
        for _ in range(8):
            w, wd = np.exp(at), np.exp(d * at)
            pull = (t - 1) * d * wd / (1 - wd)
            off = np.log(c * w / (1 - w)) - np.log1p(pull)
            at = np.minimum(at - off / (1 / (1 - w) - pull * d / (1 - wd) / (1 + pull)), at / 4)
        w, wd = np.exp(at), np.exp(d * at)
        bend = 4 * (c * w / (1 - w) ** 2 - (t - 1) * d * d * wd / (1 - wd) ** 2)
        step = 0.4 / np.sqrt(bend)
        y = step[:, None] * np.arange(POINTS)
        square = y * y
        long, turn = np.log1p(square), 2 * np.arctan(y)  # of (1 + iy)^2: logarithm of its length, and its angle
        real, imaginary = log_less(w[:, None] * (1 - square), 2 * w[:, None] * y)
        size, angle = wd[:, None] * np.exp(d * long), d * turn
        real_d, imaginary_d = log_less(size * np.cos(angle), size * np.sin(angle))
        tall = (t - 1) * np.log1p(-wd) - c * np.log1p(-w)
        height = (t[:, None] - 1) * real_d - c[:, None] * real + (d - 0.5) * long - tall[:, None]
        value = np.exp(height) * np.cos((t[:, None] - 1) * imaginary_d - c[:, None] * imaginary + (d - 0.5) * turn)
        value[:, 0] /= 2
        all_, second = value.sum(axis=1), 2 * value[:, ::2].sum(axis=1)
        sure = (np.abs(second - all_) < 1e-5 * all_) & (np.exp(height[:, -1]) < 1e-12 * all_)
        return np.log(t / c * all_ * step) + d * at + tall, sure


class Restaurants:
    """Seatings of dishes with two customers or more: c customers each, dishes in falling order of c; size of each table, tables
    of a dish next to each other; room is the dish's restaurant, tables the number of tables in each room (those of others included).

    A sweep moves every dish as a whole. Dishes of up to MOVES customers move them one by one. The customers of a larger dish are seated at once: the number of their tables is drawn from its
    distribution given all other dishes, P^t (s + d T)...(s + d (T + t - 1)) S(c, t) with T tables of others. Only that number matters, so their sizes are noted as one large table and single customers."""

    def __init__(self, c: np.ndarray, room: np.ndarray, tables: np.ndarray, discount: float, seed: int, sizes: np.ndarray | None = None, t: np.ndarray | None = None, parent: np.ndarray | None = None):
        self.c, self.room, self.discount, self.rng = c.astype(np.int64), room, discount, np.random.default_rng(seed)
        self.tables = tables.astype(np.float64)
        if sizes is None:
            t = expected_tables(self.c, (STRENGTH + discount * self.tables[room]) * parent, discount)
            sizes = one_large(self.c, t)
            np.add.at(self.tables, room, t - 1)  # each dish counted as one table so far
        self.sizes, self.t = sizes.astype(np.int64), t.astype(np.int64)
        self.large = int(np.searchsorted(-self.c, -MOVES, "left"))
        # dishes that take turns: the first large one of each room, then the second ones
        of = self.room[: self.large]
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        turn = np.empty(self.large, np.int64)
        turn[order] = np.arange(self.large) - np.repeat(first, np.diff([*first, self.large]))
        self.turns = [at for _, at in split(turn)]
        self.kinds, self.kind = np.unique(self.c[: self.large], return_inverse=True)
        self.reach = np.zeros(len(self.kinds), np.int64)
        self.known(np.minimum(self.c[: self.large], 2 * self.t[: self.large] + 32), np.arange(self.large))

    def known(self, reach: np.ndarray, dishes: np.ndarray) -> None:
        """Stirling numbers of these dishes up to reach tables."""
        before = self.reach.copy()
        np.maximum.at(self.reach, self.kind[dishes], reach)
        if (self.reach > before).any():
            rows = stirling(self.discount, self.kinds, self.reach)
            self.place = np.cumsum(self.reach) - self.reach
            self.stirling = np.concatenate(rows)
            self.steps = self.discount * np.arange(int(self.reach.max()), dtype=np.float64)

    def sweep(self, parent: np.ndarray) -> None:
        n = self.large
        few, rest = self.sizes[int(self.t[:n].sum()) :], []
        for at in self.turns:
            self.drawn(at, parent)
        for i in range(min(MOVES, int(self.c[n:].max(initial=0)))):
            m = int(np.searchsorted(-self.c, -i, "left"))  # dishes with more than i customers
            end = int(self.t[n:m].sum())
            rest.append(few[end:])
            few = self.moved(few[:end], slice(n, m), parent)
        self.sizes = np.concatenate([one_large(self.c[:n], self.t[:n]), few, *rest[::-1]])

    def drawn(self, at: np.ndarray, parent: np.ndarray) -> None:
        """Numbers of tables of these dishes, each in a room of its own."""
        if len(at) == 1:
            return self.drawn_alone(int(at[0]), parent)
        others = self.tables[self.room[at]] - self.t[at]
        chance, new = self.rng.random(len(at)), np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            dishes = at[todo]
            k = self.reach[self.kind[dishes]]
            starts = np.cumsum(k) - k
            own = np.repeat(np.arange(len(todo)), k)
            t = np.arange(len(own)) - starts[own]  # tables less one
            step = np.log((STRENGTH + self.discount * np.maximum(0.0, others[todo])[own] + self.discount * t) * parent[dishes][own])
            run = np.cumsum(step)
            weight = run - (run - step)[starts][own] + self.stirling[self.place[self.kind[dishes]][own] + t]
            weight -= np.maximum.reduceat(weight, starts)[own]
            # what lies beyond is counted in as well, until it can't matter
            short = (weight[starts + k - 1] > -40) & (k < self.c[dishes])
            mass = np.cumsum(np.exp(weight))
            before = (mass - np.exp(weight))[starts]
            goal = before + chance[todo] * (mass[starts + k - 1] - before)
            got = np.minimum(np.searchsorted(mass, goal, "right"), starts + k - 1) - starts + 1
            new[todo[~short]] = got[~short]
            todo = todo[short]
            if len(todo):
                self.known(np.minimum(self.c[at[todo]], 2 * k[short]), at[todo])
        self.tables[self.room[at]] += new - self.t[at]  # every room once
        self.t[at] = new

    def drawn_alone(self, dish: int, parent: np.ndarray) -> None:
        """The same for one dish: a room with many large dishes has most turns to itself."""
        room, kind, before = self.room[dish], self.kind[dish], self.t[dish]
        others, chance = max(0.0, self.tables[room] - before), self.rng.random()
        while True:
            k, place = self.reach[kind], self.place[kind]
            weight = self.steps[:k] + (STRENGTH + self.discount * others)
            weight *= parent[dish]
            np.log(weight, out=weight)
            np.add.accumulate(weight, out=weight)
            weight += self.stirling[place : place + k]
            weight -= np.maximum.reduce(weight)
            if weight[-1] <= -40 or k >= self.c[dish]:
                break
            self.known(np.minimum(self.c[dish : dish + 1], 2 * k), np.array([dish]))
        np.exp(weight, out=weight)
        mass = np.add.accumulate(weight, out=weight)
        new = min(int(mass.searchsorted(chance * mass[-1], "right")) + 1, int(k))
        self.tables[room] += new - before
        self.t[dish] = new

    def moved(self, sizes: np.ndarray, of: slice, parent: np.ndarray) -> np.ndarray:
        """One customer of each of these dishes gets up and sits down; sizes: of their tables."""
        d, c, t, room = self.discount, self.c[of], self.t[of], self.room[of]
        m = len(c)
        ends = np.cumsum(t)
        people = np.cumsum(sizes)
        start = np.cumsum(c) - c
        at = np.searchsorted(people, start + (self.rng.random(m) * c).astype(np.int64), "right")
        sizes[at] -= 1
        gone = sizes[at] == 0
        new_weight = np.maximum(0.0, STRENGTH + d * (self.tables[room] - gone)) * parent[of]
        new = self.rng.random(m) * (new_weight + c - 1 - d * (t - gone)) < new_weight
        todo = np.flatnonzero(~new)
        people = np.cumsum(sizes)
        start = np.cumsum(c - 1) - (c - 1)
        while len(todo):  # a table by its people, then by what the discount leaves
            pick = np.searchsorted(people, start[todo] + (self.rng.random(len(todo)) * (c[todo] - 1)).astype(np.int64), "right")
            took = self.rng.random(len(todo)) * sizes[pick] < sizes[pick] - d
            # who sits down counts in the odds of nobody else: each dish moves one
            chosen = pick[took]
            at[todo[took]] = chosen
            todo = todo[~took]
        sizes[at[~new]] += 1
        back = new & gone
        sizes[at[back]] = 1
        fresh = new & ~gone
        grown = np.insert(sizes, ends[fresh], 1)
        change = fresh.astype(np.int64) - (gone & ~new)
        self.t[of] += change
        self.tables += np.bincount(room, weights=change, minlength=len(self.tables))
        return grown[grown > 0]


def sampled(house: Restaurants, parent: np.ndarray, last: bool) -> np.ndarray:
    """Mean number of tables of each dish over the samples, in the last round; else their number after the sweeps before."""
    for _ in range(BURN):
        house.sweep(parent)
    if not last:
        return house.t
    mean = np.zeros(len(house.c))
    for _ in range(SAMPLES):
        house.sweep(parent)
        mean += house.t
    return mean / SAMPLES


def contribution(keys: np.ndarray, t: np.ndarray, owners: int, peer: int) -> Iterator[tuple]:
    """`sum` parcels: tables in each context and customers of the parent's dishes, of words that occur more than once."""
    u, w = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    ids = np.unique(np.concatenate([u[u < ONCE], w[w < ONCE]]))
    both = []
    for x in (u, w):
        mine = x < ONCE
        both.append(np.bincount(np.searchsorted(ids, x[mine]), weights=t[mine], minlength=len(ids)))
    whole = t.dtype.kind != "f"
    for owner, at in split(word_owner(ids, owners)):
        yield "sum", owner, peer, put_sorted(ids[at]), *[put(x[at].astype(np.uint32 if whole else np.float32)) for x in both], None


def merged(asks: DataFrame, owners: int) -> DataFrame:
    """Each pair's customers over all blocks (`state`), one table each to begin with; what the parent gets (`sum`), and whose rates are needed (`want`)."""

    def each(owner: int, got: dict[str, list[dict]]) -> Iterator[tuple]:
        keys, at = np.unique(np.concatenate([get_sorted(r["keys"]) for r in got["ask"]]), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([get(r["a"]) for r in got["ask"]]), minlength=len(keys)).astype(np.int64)
        keys, c = keys[c > 0], c[c > 0]
        several = np.flatnonzero(c > 1)
        yield "state", owner, -1, put_sorted(keys), put(c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c), None, float(len(keys))
        yield "ones", owner, -1, None, None, None, float((c == 1).sum())
        yield "twos", owner, -1, None, None, None, float((c == 2).sum())
        yield from contribution(keys, np.ones(len(keys), np.int64), owners, owner)
        for to, wanted in wanted_words(np.concatenate([keys[several] >> np.uint64(32), keys[several] & np.uint64(0xFFFFFFFF)]), owners):
            yield "want", to, owner, put_sorted(wanted), None, None, None

    return by_owner(asks, each)


def parent_rates(sums: DataFrame, wants: DataFrame, discount: float, tables: float, base: float, turn: int) -> DataFrame:
    """The parent's seating given the tables below. `reply` to each want: tables of the word's own context, and its customers less the discount of their tables."""

    def each(owner: int, got: dict[str, list[dict]]) -> Iterator[tuple]:
        parts = [get_sorted(r["keys"]) for r in got.get("sum", [])]
        ids, at = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True)
        in_room, customers = (np.bincount(at, weights=np.concatenate([get(r[k]).astype(np.float64) for r in got.get("sum", [])] or [np.zeros(0)]), minlength=len(ids)) for k in "ab")
        c = np.maximum(1, np.round(customers)).astype(np.int64)
        t = np.ones(len(ids))
        order = np.argsort(-c, kind="stable")
        order = order[c[order] > 1]
        even = np.full(len(order), base)
        house = Restaurants(c[order], np.zeros(len(order), np.int64), np.array([tables]), discount, seed=owner * 1000 + turn, parent=even)
        if turn:  # known from the round before, tables of this owner included
            house.tables[:] = tables
        t[order] = sampled(house, even, turn == ROUNDS)
        yield "tables", owner, -1, None, None, None, float(t.sum())
        for r in got.get("want", []):
            at = np.searchsorted(ids, get_sorted(r["keys"]))
            yield "reply", r["peer"], owner, None, put(in_room[at].astype(np.float32)), put((customers - discount * t)[at].astype(np.float64)), None

    return by_owner(sums.unionByName(wants), each)


def replies(ids: np.ndarray, got: list[dict], owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables and customers less discount of all ids, from what came back for those that occur more than once. Ids that occur once: 1 and nan."""
    tables, left = np.ones(len(ids)), np.full(len(ids), np.nan)
    mine = np.flatnonzero(ids < ONCE)
    each, back = np.unique(ids[mine], return_inverse=True)
    a, b = np.empty(len(each)), np.empty(len(each))
    by = {r["peer"]: r for r in got}
    for owner, at in split(word_owner(each, owners)):
        a[at], b[at] = get(by[owner]["a"]), get(by[owner]["b"])
    tables[mine], left[mine] = a[back], b[back]
    return tables, left


class Parent:
    """P(w) from customers less discount."""

    def __init__(self, discount: float, customers: float, tables: float, words: int):
        self.discount, self.customers, self.rest = discount, customers, (STRENGTH + discount * tables) / (words + 1)

    def rate(self, left: np.ndarray) -> np.ndarray:
        """nan: a word that occurs once, so with one customer at one table."""
        return (np.where(np.isnan(left), 1 - self.discount, left) + self.rest) / (STRENGTH + self.customers)

    def unknown(self) -> float:
        return self.rest / (STRENGTH + self.customers)


def seated(states: DataFrame, answers: DataFrame, owners: int, parent: Parent, discount: float, turn: int, asks: DataFrame | None = None) -> DataFrame:
    """Seatings of the pairs given the parent's rates. New states and sums; with asks, the answers to them as well (`answer`: customers, mean tables)."""
    averaged = asks is not None

    def each(owner: int, got: dict[str, list[dict]]) -> Iterator[tuple]:
        state = got["state"][0]
        keys, c = get_sorted(state["keys"]), get(state["a"]).astype(np.int64)
        order = np.argsort(-c, kind="stable")
        order = order[c[order] > 1]
        u, w = keys[order] >> np.uint64(32), keys[order] & np.uint64(0xFFFFFFFF)
        rooms, room = np.unique(u, return_inverse=True)
        words, word = np.unique(np.concatenate([u, w]), return_inverse=True)
        in_room, left = replies(words, got.get("reply", []), owners)
        rate = parent.rate(left)[word[len(u) :]]
        tables = in_room[np.searchsorted(words, rooms)]
        before = None if state["b"] is None else get(state["b"])
        t = before[: len(order)] if before is not None else None
        house = Restaurants(c[order], room, tables, discount, owner * 1000 + 500 + turn, before[len(order) :] if before is not None else None, t, rate)
        mean = sampled(house, rate, averaged)
        every = np.ones(len(keys))
        every[order] = mean if averaged else house.t
        if not averaged:
            every = every.astype(np.int64)
        kept = (None, None, None) if averaged else (state["keys"], state["a"], put(np.concatenate([house.t, house.sizes]).astype(np.uint32)))
        yield "state", owner, -1, *kept, float(every.sum())
        yield from contribution(keys, every, owners, owner)
        for r in got.get("ask", []):
            pairs = get_sorted(r["keys"])
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            yield "answer", r["peer"], owner, None, put(np.where(there, c[at], 0).astype(np.uint32 if c.max(initial=0) < 1 << 32 else np.int64) if len(keys) else np.zeros(len(pairs), np.uint32)), put(np.where(there, every[at], 0).astype(np.float32) if len(keys) else np.zeros(len(pairs), np.float32)), None

    rows = states.unionByName(answers)
    return by_owner(rows.unionByName(asks) if averaged else rows, each)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(blocks: DataFrame, parcels_: DataFrame, owners: int, parent: Parent, discount: float, total: int, words: int) -> DataFrame:
    """Scores of the documents of each block, from its lexicon and the answers to it."""
    columns = ["kind", "owner", "peer", "keys", "a", "b"]
    texts, rest = blocks.select(*columns), parcels_.select(*columns)

    def of_pairs(got: dict[str, list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair of the block: whether its second word is known, its base score and its score."""
        keys = get_sorted(got["pairs"][0]["keys"])
        ids, counts = get(got["lexicon"][0]["keys"]).astype(np.uint64), get(got["lexicon"][0]["a"]).astype(np.int64)
        in_room, left = replies(ids, got.get("reply", []), owners)
        known = ids != UNKNOWN
        rate = np.where(known, parent.rate(left), parent.unknown())
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        c, t = np.zeros(len(keys)), np.zeros(len(keys))
        by = {r["peer"]: r for r in got.get("answer", [])}
        for owner, _, places in routed(keys, ids, counts, owners):
            c[places], t[places] = get(by[owner]["a"]), get(by[owner]["b"])
        seats = np.where(known, in_room, 0.0)[first]
        p = (c - discount * t + (STRENGTH + discount * seats) * rate[second]) / (STRENGTH + counts[first])
        return known[second], np.log10((counts[second] + 1) / (total + words + 1)), np.log10(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, model = None, {}, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["owner"] != at:
                    at, held, model = row["owner"], {}, None
                if row["kind"] != "text":
                    held.setdefault(row["kind"], []).append(row)
                    continue
                if model is None:
                    model, held = of_pairs(held), {}
                of = get(row["b"]).reshape(-1, 4)
                gaps = np.ascontiguousarray(get(row["a"]).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
                first = np.cumsum(of[:, 3]) - of[:, 3]  # every text has its end
                upto = np.cumsum(gaps)
                places = upto - np.repeat(upto[first] - gaps[first], of[:, 3])
                sums = [np.add.reduceat(x[places].astype(kind), first).tolist() for x, kind in zip(model, (np.int64, float, float), strict=True)]
                doc = [int(i) if there else None for i, there in of[:, :2].tolist()]
                out += zip(doc, (of[:, 2] == 1).tolist(), of[:, 3].tolist(), *sums, strict=True)
            cols = list(zip(*out, strict=True)) or [[] for _ in range(6)]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in SCORES.split(", ")])

    # texts come after all parcels of their block
    dealt = texts.unionByName(rest).repartition(common.shuffle_parts(blocks.sparkSession), "owner").sortWithinPartitions("owner", F.col("kind") == "text", "peer")
    return dealt.mapInArrow(run, SCORES)


def total_of(rows: DataFrame, kind: str) -> float:
    return rows.filter(F.col("kind") == kind).agg(F.sum("total")).first()[0] or 0.0


def discount_of(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.05


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    of = lambda rows, *kinds: rows.filter(F.col("kind").isin(*kinds))
    buckets = 4 * common.shuffle_parts(spark)
    blocks = common.stored(text_blocks(docs, buckets), by="kind")
    named = common.stored(numbered(of(blocks, "spell"), buckets))
    common.dropped_parts(blocks, "kind", "spell")
    total, words, once, twice = (int(total_of(named, kind)) for kind in ("tokens", "words", "once", "twice"))
    owners = max(1, -(-total // OWNER))
    asked = common.stored(requests(of(blocks, "pairs"), of(named, "named"), owners), by="kind")
    common.dropped(named)

    asks = of(asked, "ask")
    seats = first = common.stored(merged(asks, owners))
    inner, outer = discount_of(total_of(first, "ones"), total_of(first, "twos")), discount_of(once, twice)
    base, tables = 1 / (words + 1), float(words)

    def parent_of(seats: DataFrame, wants: DataFrame, turn: int) -> tuple[DataFrame, Parent]:
        nonlocal tables
        got = common.stored(parent_rates(of(seats, "sum"), wants, outer, tables, base, turn))
        tables = total_of(got, "tables") + once
        return of(got, "reply"), Parent(outer, total_of(seats, "state"), tables, words)

    old: list[DataFrame] = []
    for turn in range(ROUNDS):
        answers, parent = parent_of(seats, of(first, "want"), turn)
        last = asks if turn == ROUNDS - 1 else None
        after = common.stored(seated(of(seats, "state"), answers, owners, parent, inner, turn, last))
        if seats is not first:
            old.append(seats)
        seats = after
    common.dropped_parts(asked, "kind", "ask")
    answers, parent = parent_of(seats, of(asked, "want"), ROUNDS)
    common.dropped(first, *old)
    got = of(asked, "lexicon").unionByName(of(seats, "answer")).unionByName(answers)
    out = scores(of(blocks, "pairs", "text"), got, owners, parent, inner, total, words)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
