"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Inner product becomes distance by one more component, sqrt(M^2 - |v|^2) with M the greatest norm (0 for queries). Each of
PROJECTIONS hash functions is one Gaussian projection; a block of vectors keeps its values sorted, one array a projection.
A query's window in each array is centred on its own projection and grows by virtual rehashing: radius R = 1, C, C^2, ...
widens every window, and each vector counts the windows that hold it. Vectors whose count reaches the collision
threshold are verified with exact inner products. A vector at distance d is in a window of radius R with probability
erf(R / d / sqrt 2), so the distance of the K-th best verified vector tells the radius at which a vector as near as that has been
verified with probability 1 - MISS: a query stops there (the last step goes to that radius, if it is less than C times the one
before), or when all of the block is verified. Directions without any structure are the hardest case, in which over half of a
block gets verified; clustered vectors stop at a smaller radius.

Blocks of vectors meet blocks of queries, each pair one task group of bounded size, whose arrays are hashed and sorted once; the K best
of each block are merged by a grouped top-K. Equal vectors of a block are hashed and verified once and expand to their K + 1
smallest ids at the end (no answer needs more of them), so thousands of copies cost one.

Defined results: vectors null, of another length than the first valid one, zero, or with null or non-finite components take
no part; null ids neither; ties go to the smaller vec_id; with fewer candidates than K, all are returned; an empty table gives
no rows. Rows that share an id are separate queries and separate candidates: a query only leaves out its own row, so another row of its
id is found like any other; queries equal in id and vector have one answer, given once for each of them. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K = 20
PROJECTIONS = 32
#: Share of the projections in which a vector must fall into the window to be verified.
THRESHOLD = 0.5
C = 2.0
#: First radius of the windows, as a share of the greatest norm.
START = 0.25
#: Probability with which a vector as near as the K-th best of a block may stay unverified.
MISS = 0.02
#: Share of all values beyond which those that windows gain are counted by comparing every value.
WIDE = 0.05
DATA_BLOCK = 8192
QUERY_BLOCK = 8192
SEED = 20


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS)).astype(np.float32)


def reach(need: int) -> float:
    """Radius, as a multiple of a vector's distance, at which at least need of the windows hold it with probability 1 - MISS."""
    low, high = 0.0, 8.0
    for _ in range(40):
        x = (low + high) / 2
        p = math.erf(x / math.sqrt(2))
        missed = sum(math.comb(PROJECTIONS, i) * p**i * (1 - p) ** (PROJECTIONS - i) for i in range(need))
        low, high = (x, high) if missed > MISS else (low, x)
    return high


def search_block(ids: np.ndarray, copies: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, norm: float, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries (by position), vec ids and scores of the k best of this block for each query, by collision counting. copies: rows of each id and vector."""
    ids, v = np.repeat(ids, np.minimum(copies, k + 1)), np.repeat(v, np.minimum(copies, k + 1), axis=0)
    same = np.unique(v, axis=0, return_inverse=True)
    unique, of = same[0], same[1].reshape(-1)
    order = np.lexsort((ids, of))
    first = np.searchsorted(of[order], np.arange(len(unique)))
    last = np.append(first[1:], len(order))
    n = len(unique)
    wide = lambda x, extra: np.concatenate([x, extra[:, None]], axis=1)
    extra = np.sqrt(np.maximum(0, norm * norm - (unique * unique).sum(axis=1)))
    a = projections(v.shape[1] + 1)
    hashed = (wide(unique, extra) @ a).astype(np.float32)
    by = np.argsort(hashed, axis=0, kind="stable").T.copy()
    line = np.take_along_axis(hashed.T, by, axis=1).astype(np.float64)
    centres = (wide(q, np.zeros(len(q))) @ a).astype(np.float64)
    # all arrays end to end, each shifted past the one before, are one sorted array
    base = np.arange(PROJECTIONS)
    shift = base * (4 * (float(np.abs(line).max()) + float(np.abs(centres).max())) + 4)
    flat, by = (line + shift[:, None]).reshape(-1), by.reshape(-1)
    need = math.ceil(THRESHOLD * PROJECTIONS)
    unit, times = START * norm, reach(need)
    far = (q * q).sum(axis=1) + norm * norm
    bound = base * n
    values, near = hashed.T.copy(), centres.astype(np.float32)[:, :, None]
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        count, radius, done = np.zeros(n, np.int16), unit, np.zeros(n, bool)
        centre = centres[i] + shift
        lo = hi = np.clip(np.searchsorted(flat, centre), bound, bound + n)
        verified, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        total = 0
        while True:
            left = np.clip(np.searchsorted(flat, centre - radius, "left"), bound, lo)
            right = np.clip(np.searchsorted(flat, centre + radius, "right"), hi, bound + n)
            # what each window gained on its two sides
            start, size = np.concatenate([left, hi]), np.concatenate([lo - left, right - hi])
            ends = np.cumsum(size)
            if ends[-1] > WIDE * PROJECTIONS * n:  # comparing all values is cheaper than gathering so many
                count = (np.abs(values - near[i]) <= radius).sum(axis=0, dtype=np.int16)
            else:
                count += np.bincount(by[np.repeat(start - ends + size, size) + np.arange(ends[-1])], minlength=n).astype(np.int16)
            lo, hi = left, right
            new = np.flatnonzero((count >= need) & ~done)
            if len(new):
                done[new] = True
                verified.append(new)
                scores.append(unique[new] @ q[i])
                total += len(new)
            if total == n:
                break
            wanted = math.inf
            if total > k:  # one of them may be the query itself
                kth = np.partition(np.concatenate(scores), total - k - 1)[total - k - 1]
                wanted = times * math.sqrt(max(0.0, far[i] - 2 * kth))
            if radius >= wanted:
                break
            radius = min(C * radius, wanted)
        cand, score = np.concatenate(verified), np.concatenate(scores)
        top = np.argsort(-score, kind="stable")[: 4 * k + 4]
        cut = score[top[min(k, len(top) - 1)]] if len(top) else 0
        pick = cand[score >= cut] if len(top) else cand[:0]
        got = []
        for c in pick:
            held = ids[order[first[c] : last[c]]]
            if (own := np.flatnonzero(held == qids[i])).size and np.array_equal(unique[c], q[i]):
                held = np.delete(held, own[0])  # the query's own row
            got.append((float(unique[c] @ q[i]), held[:k]))
        s = np.concatenate([np.full(len(x), y) for y, x in got] or [np.zeros(0)])
        d = np.concatenate([x for _, x in got] or [np.zeros(0, np.int64)])
        best = np.lexsort((d, -s))[:k]
        out_q.append(np.full(len(best), i))
        out_v.append(d[best])
        out_s.append(s[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (as it came, if an array of float or double) and n (how often) of the rows that take part."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    fine = v.filter("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    return fine.groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id, embedding; a query isn't its own candidate."""
    spark = vectors.sparkSession
    v, q = common.stored(valid(vectors)), common.stored(valid(queries))
    peak = F.expr("array_max(transform(v, x -> abs(double(x))))")
    head = v.agg(F.count("*").alias("n"), F.min(F.struct("vec_id", F.size("v").alias("d"))).alias("one"), F.max(peak).alias("peak")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not head["n"]:
        return empty
    # squares of components beyond 1e100 or of nothing but tiny ones leave double precision: search what a power of two brings near 1, which changes no digit
    far = not 1e-100 < head["peak"] < 1e100
    down = 2.0 ** -max(-1000, min(1000, math.frexp(head["peak"])[1])) if far else 1.0
    dim, norm = head["one"]["d"], math.sqrt(v.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * down * (x * down)))).first()[0])
    v, q = v.filter(F.size("v") == dim), q.filter(F.size("v") == dim)
    m = q.count()
    if not m:
        return empty
    data_blocks, query_blocks = -(-head["n"] // DATA_BLOCK), -(-m // QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    data = v.select(block(data_blocks).alias("db"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "v", "n")
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))).alias("db"), block(query_blocks).alias("qb"), "vec_id", "v", "n", F.xxhash64("v").alias("of"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q, d, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            rows = lambda t: np.asarray(t["v"].combine_chunks().flatten()).reshape(-1, dim).astype(np.float64) * down
            q, d, s = search_block(np.asarray(left["vec_id"]), np.asarray(left["n"]), rows(left), np.asarray(right["vec_id"]), rows(right), norm, k)
        kept = {c: right[c].take(pa.array(q)) for c in ("vec_id", "of", "n")}
        return pa.table({"query_id": kept["vec_id"], "of": kept["of"], "n": kept["n"], "vec_id": pa.array(d, pa.int64()), "score": pa.array(s, pa.float64())})

    found = data.groupBy("db", "qb").cogroup(asked.groupBy("db", "qb")).applyInArrow(run, "query_id long, of long, n long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)
    again = best.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    # back to the vectors as they came; beyond double precision this is infinite, the order stays
    return again.select("query_id", "rank", "vec_id", (F.col("score") / F.lit(down) / F.lit(down)).alias("score"))
