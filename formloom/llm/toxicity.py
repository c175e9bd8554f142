"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that `labels` marks toxic; the unlabelled set are documents that `labels` covers, taken without looking at
what it says of them, so the class prior (the share of toxic ones there) is theirs. A linear
classifier on hashed word frequencies minimises the non-negative PU risk
    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])
in numpy: where the bracket would fall below zero, the step goes back up. FOLDS models are trained, each without one part of the rows. That part
places the cut that the score 0.7 stands for where the same risk, with the 0-1 loss, is least (within one standard error, its lower end); no label but
the confirmed toxic ones is used. The score is of the mean of the models' logits, each taken from its own cut.

The classifier is fitted on a bounded sample of labelled rows: POSITIVES, UNLABELLED (those with the smallest hash of doc_id) and
WORDS, the most frequent words of a row that take part; scoring reads every whole text and every word. What the bounds cost: words beyond WORDS of a sampled row and buckets
in fewer than MIN_DOCUMENTS sampled rows have no weight, and words that share one of BUCKETS buckets share their weight. A text of any length can be scored.

Defined results: null or empty texts have no words and get the score of the intercept alone; a null doc_id is never
held out; without any toxic label in the rows to learn from, all scores are 0; repeated rows get equal scores; of several texts with one
labelled doc_id the least is learned from; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed words; the model is one float32 for each, 512 KB in all.
BUCKETS = 1 << 17
POSITIVES = 3000
UNLABELLED = 6000
#: Buckets of a sampled row at most, the most frequent ones. A longer row is cut in the fit only.
WORDS = 8192
STEPS = 120
FOLDS = 4
#: Buckets in fewer sampled documents than this have no weight; others weigh by their rarity.
MIN_DOCUMENTS = 10
REJECT = 0.7
CACHED_WORDS = 400_000


class Buckets(dict):
    """Word to bucket; fills itself, bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = self[word] = zlib.crc32(word.strip(".,!?;:\"'()").encode("utf-8", "replace")) % BUCKETS
        return got


def features(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the square root of each one's share of the words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    i, n = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    return i, np.sqrt(n / len(words)).astype(np.float32)


class Rows:
    """Sparse rows, as flat arrays."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(pairs)
        self.col = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.val = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.float32)]).astype(np.float32)
        self.row = np.repeat(np.arange(self.n), [len(p[0]) for p in pairs])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * g[self.row], minlength=BUCKETS)


def rarity(*rows: Rows) -> np.ndarray:
    """Feature scale: half the log of how rare a bucket is among the rows, at most 3; 0 below MIN_DOCUMENTS."""
    df = np.bincount(np.concatenate([r.col for r in rows]), minlength=BUCKETS)
    n = sum(r.n for r in rows)
    return np.where(df >= min(MIN_DOCUMENTS, max(1, n // 20)), np.minimum(3.0, np.log(n / np.maximum(df, 1)) / 2), 0.0)


def train(positive: Rows, unlabelled: Rows, prior: float, steps: int = STEPS, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative PU risk with the logistic loss: Adam on full batches with a
    falling rate; the mean of the second half of the steps, as steps at the bound go back and forth."""
    scale = rarity(positive, unlabelled)
    ridge = 1e-4 * float(np.clip(np.sqrt(1500 / positive.n), 1, 4))
    w, b = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    mean_w, mean_b, n = np.zeros(BUCKETS), 0.0, 0
    for t in range(1, steps + 1):
        scaled = w * scale
        zp, zu = positive.dot(scaled) + b, unlabelled.dot(scaled) + b
        pp, pu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = -prior * pp / positive.n, pu / unlabelled.n
        if negative < 0:
            gp, gu = -gp, -gu
        else:
            gp = gp - prior * (1 - pp) / positive.n
        g, gb = (positive.back(gp) + unlabelled.back(gu)) * scale + ridge * w, float(gp.sum() + gu.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d, r = 1 - 0.9**t, 1 - 0.99**t, rate * (1 - 0.9 * t / steps)
        w -= r * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= r / 2 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
        if 2 * t > steps:
            mean_w, mean_b, n = mean_w + w, mean_b + b, n + 1
    return mean_w / n * scale, mean_b / n


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The least logit at which the non-negative PU risk with the 0-1 loss is within a standard error of its minimum."""
    z = np.unique(np.concatenate([positive, unlabelled]))
    if len(z) < 2:
        return float(z[0]) if len(z) else 0.0
    cuts = (z[1:] + z[:-1]) / 2
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    hit = above(positive)
    risk = prior * (1 - hit) + np.maximum(0, above(unlabelled) - prior * hit)
    low = float(risk.min())
    return float(cuts[np.flatnonzero(risk <= low + np.sqrt(low * (1 - low) / len(unlabelled)) + 1e-12)[0]])


class Model:
    """w, intercept, and the logit that the score REJECT stands for."""

    def __init__(self, w: np.ndarray, b: float, cut: float, slope: float = 1.5):
        self.w, self.b, self.cut, self.slope = w.astype(np.float32), b, cut, slope

    def score(self, i: np.ndarray, x: np.ndarray) -> float:
        z = float((x * self.w[i]).sum(dtype=np.float64)) + self.b
        return float(1 / (1 + np.exp(-min(max(self.slope * (z - self.cut) + np.log(REJECT / (1 - REJECT)), -30), 30))))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def sampled(docs: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """doc_id and text of the ids (distinct) with the smallest hashes: one row each, at most limit; they are broadcast."""
    few = ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))


def sample_rows(docs: DataFrame, ids: DataFrame, limit: int) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """part and features of the sampled rows: at most limit, of at most WORDS buckets each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            out = []
            for t in batch.column(1):
                i, x = features(t.as_py(), buckets)
                if len(i) > WORDS:
                    top = np.sort(np.argsort(-x, kind="stable")[:WORDS])
                    i, x = i[top], x[top]
                out.append((i.astype("<u4").tobytes(), x.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)]], ["part", "i", "x"])

    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = sampled(docs, ids, limit).select(part.alias("part"), "text").mapInArrow(run, "part int, i binary, x binary").collect()
    out = [(r["part"], (np.frombuffer(r["i"], "<u4").astype(np.int64), np.frombuffer(r["x"], np.float32))) for r in rows]
    return sorted(out, key=lambda r: (r[0], zlib.crc32(r[1][0].tobytes()), r[1][0].tobytes(), r[1][1].tobytes()))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """docs: doc_id, text. Labels of held-out rows are never looked at."""
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    learn = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = learn.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("k")).first()
    if not shares["k"] or shares["k"] == shares["n"]:
        return None
    return learned(sample_rows(docs, learn.filter("toxic = 1"), positives), sample_rows(docs, learn, unlabelled), shares["k"] / shares["n"])


def learned(positive: list, unlabelled: list, prior: float) -> Model | None:
    """The model of two samples of (part, features)."""
    of = lambda rows, part, within: Rows([x for at, x in rows if (at == part) == within])
    models = []
    for part in range(FOLDS):
        p, u, judge_p, judge_u = of(positive, part, False), of(unlabelled, part, False), of(positive, part, True), of(unlabelled, part, True)
        if p.n and u.n and judge_p.n and judge_u.n:
            w, b = train(p, u, prior)
            models.append((w, b - best_cut(judge_p.dot(w) + b, judge_u.dot(w) + b, prior)))
    if not models:  # too few rows to leave any out: they place their own cut
        p, u = Rows([x for _, x in positive]), Rows([x for _, x in unlabelled])
        if not p.n or not u.n:
            return None
        w, b = train(p, u, prior)
        models = [(w, b - best_cut(p.dot(w) + b, u.dot(w) + b, prior))]
    return Model(np.mean([w for w, _ in models], axis=0), float(np.mean([b for _, b in models])), 0.0)


def scored(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score, in the place of a column of that name. The model (BUCKETS floats) is broadcast once."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    base = docs.drop(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, buckets = held.value, Buckets()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = [m.score(*features(t.as_py(), buckets)) if m else 0.0 for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, score])

    from pyspark.sql import types as T

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(score, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    lab = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic")
    out = scored(plain, fit(plain, lab))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic; columns as before."""
    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    model = fit(plain, labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic"))
    score = "_toxicity"
    while score in map(str.lower, docs.columns):
        score += "_"
    return scored(docs, model, score=score).filter(F.col(score) < REJECT).drop(score)
