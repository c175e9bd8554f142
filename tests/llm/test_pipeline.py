"""Learnt operators, line dedup and every pipeline stage against plain Python, with nulls, empties, repeated rows and an empty table."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from formloom.llm import lines, mixing, toxicity
from formloom.llm.queries import tokenizer
from test_operators import prose

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(11)
    out = []
    for i in range(160):
        text = prose(300 + i, 60)
        if i % 8 == 0:
            text += " idiot moron scum vile trash" * 2
        if i % 5 == 0:
            text += "\nregards from station %d in the north of town" % i
        if i % 6 == 0:
            text += "\nwritten by " + prose(900 + i, 1) + " for the readers of this page and others"
        if i in (31, 33):
            text += "\n" + prose(77, 60)
        out.append((i, text))
    for i in range(160, 170):  # near copies
        w = out[i - 159][1].split(" ")
        w[r.randrange(40)] = "other"
        out.append((i, " ".join(w)))
    out += [(200, out[3][1]), (201, None), (202, ""), (203, " \n "), (204, "two words"), (3, out[3][1]), (3, out[3][1]), (7, out[9][1]), (7, prose(5, 50)), (None, None), (None, out[11][1]), (None, "alone")]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows()], SCHEMA).write.parquet(f"{where}/documents.parquet")
    labels = [(i, i % 2, int(i % 8 == 0)) for i in range(0, 160) if i % 7] + [(None, 1, 1), (16, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def bag(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def plain_lines(docs):
    """The template tree in plain Python: what each (doc_id, text) keeps."""
    token = lambda w: None if any(c.isdigit() for c in w) else w
    first, documents, seen = {}, defaultdict(set), {}
    for i, t in sorted(set(docs), key=repr):
        k = (lines.LAST if i is None else i, t)
        for no, line in enumerate((t or "").split("\n")):
            words = tuple(map(token, line.split()))
            if words and (k, words) not in seen:
                seen[k, words] = no
                documents[words].add(t)
    place = lambda ks: min(ks, key=lambda x: (x[0][0], lines_key(x[0]), x[1]))
    keys = {}

    def lines_key(k):
        return keys.setdefault(k, k[1])

    leaves = defaultdict(list)
    for words in documents:
        leaves[len(words), words[: lines.DEPTH]].append(words)
    drop = {}
    for leaf in leaves.values():
        held = Counter()
        for words in leaf:
            held.update({(at, w): len(documents[words]) for at, w in enumerate(words)})
        families = defaultdict(list)
        for words in leaf:
            places = sorted((held[at, w], at) for at, w in enumerate(words) if at >= lines.DEPTH and w is not None)
            gone = {at for _, at in places[: int((1 - lines.SIMILAR) * len(words) + 1e-9)]}
            families[tuple(None if at in gone else w for at, w in enumerate(words)) if gone else (words,)].append(words)
        templates = [(None, members) for members in families.values()]
        for _, members in templates:
            union = set().union(*(documents[m] for m in members))
            places = [(k, seen[k, ws]) for k, ws in seen if ws in members]
            if len(union) >= lines.MIN_DOCUMENTS and (len(members) > 1 or len(documents[members[0]]) >= lines.MIN_DOCUMENTS):
                for m in members:
                    drop[m] = place(places)
            else:
                for m in members:
                    if len(m) > lines.LONG and len(documents[m]) >= lines.LONG_DOCUMENTS:
                        drop[m] = place([(k, no) for k, no in places if (k, m) in seen])
    out = {}
    for i, t in set(docs):
        k = (lines.LAST if i is None else i, t)
        kept = [x for no, x in enumerate((t or "").split("\n")) if (ws := tuple(map(token, x.split()))) not in drop or not ws or drop[ws] == (k, no)]
        out[i, t] = None if t is None else "\n".join(kept)
    return out


def test_line_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain_lines(rows())
    kept = Counter()
    for i, t in rows():
        new = want[i, t]
        if new == t or (new or "").strip(" "):
            kept[i, new] += 1
    got = corpus_pipeline.dedup_lines(spark, docs, folder)
    assert got.columns == COLUMNS and bag(got) == kept
    assert sum(want[k] != k[1] for k in want) > 30


def test_toxicity_stage(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.toxicity(docs, labels).collect()
    assert len(scores) == len(rows()) and all(r.predicted == int(r.score >= 0.7) for r in scores)
    low = sorted(r.score for r in scores)
    assert low[0] >= 0 and low[-1] <= 1
    by_id = defaultdict(list)
    for r in scores:
        by_id[r.doc_id].append(r)
    held = [r for r in scores if r.held_out and r.doc_id is not None and r.doc_id < 160]
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in held) >= 0.9 * len(held)
    got = corpus_pipeline.remove_toxic(spark, docs, folder)
    assert got.columns == COLUMNS
    # each text's own prediction decides
    assert sum(bag(got).values()) == sum(r.predicted == 0 for r in scores)
    assert {t for _, t in bag(got)} >= {t for i, t in rows() if t and i is not None and len(by_id[i]) == 1 and by_id[i][0].predicted == 0}


def risk(w, b, p, u, prior):
    lp, lu = p @ w + b, u @ w + b
    return prior * np.logaddexp(0, -lp).mean() + max(0.0, np.logaddexp(0, lu).mean() - prior * np.logaddexp(0, lp).mean())


def test_nnpu(monkeypatch):
    """The trained model reaches the non-negative risk of plain gradient descent on the same rows."""
    monkeypatch.setattr(toxicity, "BUCKETS", 40)
    r = np.random.default_rng(5)
    p = np.abs(r.normal(0.2, 0.2, (60, 40)))
    p[:, :5] += 1
    u = np.abs(r.normal(0.2, 0.2, (200, 40)))
    u[:40, :5] += 1
    sparse = lambda m: toxicity.Rows([(np.arange(40), x.astype(np.float32)) for x in m])
    monkeypatch.setattr(toxicity, "rarity", lambda *rows: np.ones(40))
    w, b = toxicity.train(sparse(p), sparse(u), 0.2)
    wp, bp = np.zeros(40), float(np.log(0.25))
    best = risk(wp, bp, p, u, 0.2)
    for _ in range(3000):
        sp, su = 1 / (1 + np.exp(-(p @ wp + bp))), 1 / (1 + np.exp(-(u @ wp + bp)))
        gp = -0.2 * (1 - sp) / len(p)
        gn, gu = -0.2 * sp / len(p), su / len(u)
        if np.logaddexp(0, u @ wp + bp).mean() - 0.2 * np.logaddexp(0, p @ wp + bp).mean() < 0:
            gp, gn, gu = 0 * gp, -gn, -gu
        wp -= 0.5 * (p.T @ (gp + gn) + u.T @ gu + 1e-4 * wp)
        bp -= 0.5 * float((gp + gn).sum() + gu.sum())
        best = min(best, risk(wp, bp, p, u, 0.2))
    assert risk(w, b, p, u, 0.2) <= best + 0.02
    z = u @ w + b
    assert (z[:40] > z[40:].max()).mean() > 0.95


def test_cut():
    r = np.random.default_rng(6)
    p, u = r.normal(2, 1, 50), np.concatenate([r.normal(2, 1, 40), r.normal(-2, 1, 160)])
    cut = toxicity.best_cut(p, u, 0.2)
    z = np.unique(np.concatenate([p, u]))
    cost = lambda c: 0.2 * (p < c).mean() + max(0, (u >= c).mean() - 0.2 * (p >= c).mean())
    costs = {c: cost(c) for c in (z[1:] + z[:-1]) / 2}
    low = min(costs.values())
    assert cut == min(c for c, x in costs.items() if x <= low + np.sqrt(low * (1 - low) / len(u)) + 1e-12)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "hot row")] * 150 + [(i, f"row {i}") for i in range(2, 42)], "doc_id long, text string")
    assert toxicity.sampled(docs, docs.select("doc_id").distinct(), 10).count() == 10
    assert len(toxicity.sample_rows(docs, docs.select("doc_id").distinct(), 100)) == 41


def test_near_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = [(i, t) for i, t in set(rows()) if i is not None and (t or "").split()]
    shingled = lambda t: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w := t.lower().split()) >= 5 else {tuple(w)}
    sets = {k: shingled(k[1]) for k in own}
    root = {k: k for k in own}
    for _ in range(4):
        for a in own:
            for b in own:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    groups = defaultdict(list)
    for k in own:
        groups[root[k]].append(k)
    got = corpus_pipeline.dedup_near(spark, docs, folder)
    assert got.columns == COLUMNS
    found = bag(got)
    for members in groups.values():
        kept = {k: n for k, n in found.items() if k in members}
        assert len(kept) == 1 and set(kept.values()) == {1} and next(iter(kept))[0] == min(members)[0]
    rest = Counter(x for x in rows() if x not in set(own))
    assert Counter({k: n for k, n in found.items() if k not in set(own)}) == rest


def test_mixing_stage(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rates = mixing.rates(docs, labels).collect()
    n = np.array([r.n_tokens for r in rates], float)
    p, rate = np.array([[r.p_high, r.p_low, r.p_toxic] for r in rates]), np.array([r.rate for r in rates])
    # targets that plain projected gradients meet are met; else the errors fall, and no rate leaves the others far behind
    target, share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]), n / n.sum()
    error = lambda x: p.T @ (share * x) - target
    x = np.ones(len(n))
    for _ in range(20_000):
        x = np.clip(x - 0.5 * (p @ error(x) + mixing.RIDGE * (x - 1)), 0, mixing.MOST)
    if np.abs(error(x)).max() < 1e-3:
        assert np.abs(error(rate)).max() < 1e-3
    else:
        assert (error(rate) ** 2).sum() < (error(np.ones(len(n))) ** 2).sum() and rate.max() <= mixing.MOST
    got = corpus_pipeline.mix(spark, docs, folder)
    times = {r.k: int(np.floor(r.rate + t.u)) for r, t in zip(rates, spark.createDataFrame([(r.k,) for r in rates], "k long").selectExpr("pmod(xxhash64('mix', k), 1048576) / 1048576D u").collect(), strict=True)}
    assert got.columns == COLUMNS and got.count() == sum(times[r.k] for r in rates)


def test_run(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
    t = Tokenizer.from_file(tokenizer())
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want


def test_empty(spark, tmp_path):
    where = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0
