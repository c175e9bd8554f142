"""Mixing sources to target weights by soft membership, in DataFrame functions alone.

Domains come from the labels table: toxic, or else high or low quality. A naive Bayes classifier on the VOCABULARY most
informative words, fitted on a bounded sample of labelled documents, gives each document's domain posteriors p. Document
rates 0 <= r <= MOST then minimise, over all documents,
    1/2 sum_d e_d^2 + RIDGE / 2 sum_i s_i (r_i - 1)^2,    e_d = sum_i r_i s_i p_id - T_d
with s_i the document's share of all tokens and T the target shares of the domains, by projected gradients with momentum: rates are a column, a step sums up the
domains' errors over all documents (three numbers to the driver), takes every rate to r - gradient / (greatest curvature), held within 0 and MOST, and on by its last move
(Nesterov; from rest again after a step that made the errors greater). The column is stored every STORED steps. Steps end once the errors are within TOLERANCE, as they
get for targets that such rates can meet, or once PATIENCE steps bring the sum of their squares down by less than the share GAIN: farther on, targets out of reach would
zero most documents for a little gain.

The classifier is a bounded model by contract: words beyond the VOCABULARY most informative, or in fewer than MIN_DOCUMENTS of the LABELLED documents, have no weight in any
posterior; counts, errors and rates take all documents.

Defined results: a null or blank text has no tokens, the prior as its posterior, and a rate like any other; documents
without a label are scored alike; with labels of one domain only, posteriors are 1 there; without labels, or in an empty
table, every rate is 1; repeated rows are documents of their own; extra columns are ignored by the report and kept by the mixer.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DOMAINS = ("high", "low", "toxic")
#: Target share of the tokens of each domain.
TARGETS = {"high": 0.88, "low": 0.10, "toxic": 0.02}
#: Labelled documents that the classifier learns from at most (those with the smallest hash of doc_id).
LABELLED = 20_000
VOCABULARY = 4096
#: Least labelled documents that hold a word of the vocabulary.
MIN_DOCUMENTS = 8
#: Documents of the prior that each word's counts are smoothed with.
SMOOTH = 20.0
#: Scales summed word weights before the softmax: words of a text aren't independent.
TEMPER = 0.5
#: Pull of the rates to 1.
RIDGE = 1e-6
#: Greatest rate: how often one document may be drawn.
MOST = 8.0
#: Largest error of a domain, as a share of all tokens.
TOLERANCE = 1e-4
#: Steps at most, each a sum over all documents; the column is stored each STORED.
STEPS = 200
GAIN = 0.02
PATIENCE = 3
STORED = 8
MARKS = "\t\n\r.,!?;:"


def words_of(text: Column) -> Column:
    """Lower-case words: runs without blanks and MARKS."""
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), MARKS, " " * len(MARKS)), " "), "")


def domain(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labelled documents; of several rows for one, the greatest toxic and quality count."""
    known = labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    return one.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))


def classifier(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[DataFrame, list[float]] | None:
    """Word weights (w, one column a domain; at most VOCABULARY + 1 rows, stored) and log priors."""
    few = domain(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("domain", F.explode(F.concat(F.array_distinct(words_of(F.col("text"))), F.array(F.lit("")))).alias("word"))
    hits = [F.sum((F.col("domain") == d).cast("int")).cast("double").alias(d) for d in DOMAINS]
    counts = common.stored(sample.groupBy("word").agg(*hits))
    totals = counts.filter("word = ''").first()  # every document counts once there
    if totals is None:
        return None
    n = [totals[d] for d in DOMAINS]
    prior = [(x + 0.5) / (sum(n) + 1.5) for x in n]
    held = sum((F.col(d) for d in DOMAINS), F.lit(0.0))
    weight = [F.log((F.col(d) + SMOOTH * p) / (held + SMOOTH) / p) for d, p in zip(DOMAINS, prior, strict=True)]
    share = [(F.col(d) + 0.5) / (held + 1.5) for d in DOMAINS]
    gain = held * sum((s * F.log(s / p) for s, p in zip(share, prior, strict=True)), F.lit(0.0))
    chosen = counts.filter(f"word != '' and {' + '.join(DOMAINS)} >= {MIN_DOCUMENTS}").orderBy(gain.desc(), "word").limit(VOCABULARY)
    model = chosen.select(F.xxhash64("word").alias("w"), *[x.alias(d) for x, d in zip(weight, DOMAINS, strict=True)])
    blank = counts.filter("word = ''").select(F.xxhash64("word").alias("w"), *[F.lit(0.0).alias(d) for d in DOMAINS])
    return common.stored(model.union(blank)), [math.log(p) if x else -1e9 for p, x in zip(prior, n, strict=True)]


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, k, doc_id, n_tokens and p_<domain> of every document (stored)."""
    fitted = classifier(docs, labels)
    base = docs.select(F.monotonically_increasing_id().alias("row"), common.row_key("doc_id", "text").alias("k"), "doc_id", words_of(F.col("text")).alias("words")).withColumn("n_tokens", F.size("words").cast("long"))
    if fitted is None:
        return common.stored(base.select("row", "k", "doc_id", "n_tokens", *[F.lit(1 / len(DOMAINS)).alias(f"p_{d}") for d in DOMAINS]))
    model, prior = fitted
    each = base.select("row", "k", "doc_id", "n_tokens", F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("word"))
    found = each.select("row", "k", "doc_id", "n_tokens", F.xxhash64("word").alias("w")).join(F.broadcast(model), "w")
    sums = found.groupBy("row", "k", "doc_id", "n_tokens").agg(*[F.sum(d).alias(d) for d in DOMAINS])
    logit = [F.col(d) * TEMPER + p for d, p in zip(DOMAINS, prior, strict=True)]
    top = F.greatest(*logit)
    total = sum((F.exp(x - top) for x in logit), F.lit(0.0))
    return common.stored(sums.select("row", "k", "doc_id", "n_tokens", *[F.round(F.exp(x - top) / total, 9).alias(f"p_{d}") for x, d in zip(logit, DOMAINS, strict=True)]))


def fitted_rates(members: DataFrame, targets: dict[str, float], steps: int = STEPS) -> DataFrame:
    """members with rate, by projected gradients over all rows."""
    size = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not size:
        return members.withColumn("rate", F.lit(1.0))
    scale = sum(targets.values())
    target = np.array([targets.get(d, 0.0) / scale for d in DOMAINS])
    p = [F.col(f"p_{d}") for d in DOMAINS]
    share = F.col("n_tokens") / size
    pairs = [(i, j) for i in range(len(p)) for j in range(i + 1)]
    second = np.zeros((len(p), len(p)))
    moments = members.agg(*[F.sum(share * p[i] * p[j]).alias(f"_{i}_{j}") for i, j in pairs]).first()
    for (i, j), x in zip(pairs, moments, strict=True):
        second[i, j] = second[j, i] = x
    length = 1 / (float(np.linalg.eigvalsh(second)[-1]) + RIDGE)
    keep = 1 - length * RIDGE

    # rate: where the gradient is taken; _last: where the step before ended
    now, held = members.withColumn("rate", F.lit(1.0)).withColumn("_last", F.lit(1.0)), None
    momentum, squares = 1.0, []
    for step in range(1, steps + 1):
        totals = now.agg(*[F.sum(share * F.col("rate") * x).alias(f"_{i}") for i, x in enumerate(p)]).first()
        error = np.array([float(x) for x in totals]) - target
        squares.append(float(error @ error))
        if np.abs(error).max() <= TOLERANCE or (step > PATIENCE and min(squares[-PATIENCE:]) > (1 - GAIN) * min(squares[:-PATIENCE])):
            break
        if squares[-1] > squares[max(0, step - 2)]:
            momentum = 1.0
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        on, momentum = (momentum - 1) / after, after
        slope = sum((x * float(length * g) for x, g in zip(p, error, strict=True)), F.lit(0.0))
        now = now.withColumn("_new", F.least(F.lit(MOST), F.greatest(F.lit(0.0), F.col("rate") * keep + (1 - keep) - slope)))
        now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("_new") + (F.col("_new") - F.col("_last")) * on)).withColumn("_last", F.col("_new")).drop("_new")
        if step % STORED == 0:
            now = common.stored(now)
            common.dropped(held)
            held = now
    out = common.stored(now.drop("_last").withColumn("rate", F.round(F.least("rate", F.lit(MOST)), 9)))
    common.dropped(held)
    return out


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return fitted_rates(posteriors(plain, labels), targets)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, p_high, p_low, p_toxic, rate of every document."""
    return rates(docs, labels, targets).select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], F.round("rate", 6).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs drawn at their rates: each document stands floor(rate + u) times, u a fixed fraction from its hash. Columns as before."""
    last = F.lit(2**63 - 1)
    own = rates(docs, labels, targets).groupBy(F.coalesce("doc_id", last).alias("__formloom_doc"), F.col("k").alias("__formloom_key")).agg(F.max("rate").alias("__formloom_rate"))
    u = F.pmod(F.xxhash64(F.lit("mix"), "__formloom_key"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.col("__formloom_rate") + u).cast("int")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.withColumn("__formloom_key", key).withColumn("__formloom_doc", F.coalesce(F.col("doc_id").cast("long"), last))
    drawn = keyed.join(own, ["__formloom_doc", "__formloom_key"]).withColumn("__formloom_times", times).filter("__formloom_times > 0")
    return drawn.withColumn("__formloom_copy", F.explode(F.sequence(F.lit(1), F.col("__formloom_times")))).select(*docs.columns)
