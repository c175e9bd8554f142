"""Manifest, divergence audit and language model against plain Python, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from formloom.llm import divergence, language_model, merkle
from test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, path string, term string"


def rows():
    r = random.Random(5)
    out = [(i, prose(i, r.randint(1, 40)).title(), r.choice(["en", "de", None]), "big" if i % 3 else f"s{i % 7}", i, "g", 1, "p", "t") for i in range(700)]
    out += [(5, "twice", "en", "big", 1, "g", 1, "p", "t")] * 3 + [(None, "no id", "en", None, None, "g", 1, "p", "t"), (None, None, None, None, None, None, None, None, None)]
    out += [(900, None, "en", "", 0, "g", 1, "p", "t"), (901, "", "", "é", 0, "g", 1, "p", "t"), (902, "Word " * 30000, "en", "big", 0, "g", 1, "p", "t"), (903, "alone", "fr", "single", 0, "g", 1, "p", "t")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs):
    """leaf, subroot, root, proof and folded root of every row by lists and indexes."""
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    by = {}
    for i, text, lang, source, n, *_ in docs:
        leaf = H(*map(enc, (i, source, lang, n, text)))
        touched = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by.setdefault(source, []).append((i, leaf, H(*map(enc, (i, source, lang, n, text and text.translate(lower)))) if touched else leaf))

    def climb(level, at):
        """The top of a list of digests, and the siblings of its at-th entry."""
        path = []
        while len(level) > 1:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            path.append((run[: at % 16], run[at % 16 + 1 :]))
            level = [H(*level[k : k + 16]) for k in range(0, len(level), 16)]
            at //= 16
        return level[0], path

    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [climb([x[1] for x in by[s]], 0)[0] for s in order]
    for k, s in enumerate(order):
        root, above = climb(tops, k)
        for at, (i, leaf, other) in enumerate(by[s]):
            path = climb([x[1] for x in by[s]], at)[1] + above
            f = other
            for before, after in path:
                f = H(*before, f, *after)
            yield i, leaf, tops[k], root, H(*[x for pair in path for part in pair for x in part]), f, f == root


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest(docs, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    got = sorted(map(tuple, merkle.tamper_audit(docs).collect()), key=repr)
    assert got == sorted(plain_manifest(rows()), key=repr)


def test_manifest_of_little(docs):
    assert merkle.tamper_audit(docs.limit(0)).collect() == []
    one = merkle.dataset_manifest(docs.filter("doc_id = 903")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == b"" and one["source"] == "single"
    two = docs.filter("doc_id in (900, 901)")
    paths = {r["doc_id"]: bytes(r["path"]) for r in merkle.dataset_manifest(two).collect()}
    assert [place for place, _ in merkle.runs(paths[900])] == [0] and [place for place, _ in merkle.runs(paths[901])] == [1]


def plain_divergence(docs):
    count, held, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    lower = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    for _, text, lang, source, *_ in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        count[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
        of_lang[lang or ""].add(source or "")
    for lang, sources in of_lang.items():
        kept = [w for w, n in held[lang].items() if n >= divergence.MIN_DOCUMENTS]
        rate = {}
        for s in [*sources, None]:
            c = {w: sum(count[lang, x][w] for x in (sources if s is None else [s])) for w in kept}
            total = sum(c.values())
            rate[s] = {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(f(rate[s][w], rate[x][w]) for w in kept), x) for x in sources if x != s)
            terms = sorted((-f(rate[s][w], rate[None][w]), w) for w in kept if count[lang, s][w] and rate[s][w] > rate[None][w])[:10]
            for part, ranked in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(ranked, 1):
                    yield lang, s, part, item, -value, rank


@pytest.mark.parametrize("cells", [1 << 21, 12])
def test_divergence(spark, docs, cells, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", cells)  # few cells: many shards of few words
    r = random.Random(9)
    word = lambda: r.choice(["the", "Over", "UNDER", "été", "ab", "it's", "x9y", "漢字", "in"])
    more = [(i, " ".join(word() for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), f"s{r.randint(0, 10)}", 0, "g", 1, "p", "t") for i in range(300)]
    got = divergence.divergence_audit(docs.unionByName(spark.createDataFrame(more, SCHEMA)))
    want = sorted(plain_divergence(rows() + more))
    assert sorted(map(tuple, got.collect())) == want and len({x[4] for x in want}) > 50
    assert divergence.divergence_audit(docs.limit(0)).collect() == []


def test_rates_are_exact_beyond_64_bits():
    n = np.array([[10**13, 5], [7, 0]])
    got = divergence.rates(n, n.sum(axis=1), 2)
    assert got.tolist() == [[1 + 10**9 * (x + 2) // (sum(row) + 4) for x in row] for row in n.tolist()]


def test_every_two_seats_meet_once(spark):
    seats = spark.range(divergence.SEATS).selectExpr("cast(id as int) seat")
    met = Counter()
    for turn in range(divergence.SEATS - 1):
        for r in seats.withColumn("at", divergence.opponent("seat", turn)).collect():
            met[frozenset(r)] += 1
    assert set(met.values()) == {2} and len(met) == divergence.SEATS * (divergence.SEATS - 1) // 2


LM = [(i, prose(i % 40, 5 + i % 9).title() + " The\u00a0End\tof  it. " * (i % 3), "en", "s", 0, "g", 1, "p", "t") for i in range(120)]
LM += [(200, None, "en", "s", 0, "g", 1, "p", "t"), (201, "", "en", "s", 0, "g", 1, "p", "t"), (202, " \n ", "en", "s", 0, "g", 1, "p", "t"), (3, "same id", "en", "s", 0, "g", 1, "p", "t"), (None, "no id", "en", "s", 0, "g", 1, "p", "t")]
LM += [(7, "twice twice", "en", "s", 0, "g", 1, "p", "t")] * 3 + [(204, "long " * 20000, "en", "s", 0, "g", 1, "p", "t")]


def plain_base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base score."""
    lower = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), ""]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK", 150)
    monkeypatch.setattr(language_model, "OWNER", 9000)
    monkeypatch.setattr(language_model, "ROUNDS", 2)
    got = language_model.language_model_scores(spark.createDataFrame(LM, SCHEMA)).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key((*r[:5], round(r[5], 6)) for r in got) == key(plain_base(LM))
    for out in (False, True):
        of = [r for r in got if r["held_out"] == out]
        assert of and sum(r["score"] for r in of) > sum(r["base_score"] for r in of)
    assert all(r["score"] < 0 for r in got)
    assert language_model.language_model_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    held = language_model.language_model_scores(spark.createDataFrame([r for r in LM if r[0] in (205, 206, 2, 9, 14)][:1] or LM[:1], SCHEMA))
    assert held.count() == 1


def test_language_model_without_training(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = language_model.language_model_scores(spark.createDataFrame([(i, "a b", "en", "s", 0, "g", 1, "p", "t")], SCHEMA)).first()
    assert tuple(got)[2:] == (3, 0, 0, 0.0, 0.0)


def test_language_model_sums_to_one(spark, monkeypatch):
    """Over all words of the vocabulary and the unknown one, after every context."""
    held = {}
    scores = language_model.scores
    monkeypatch.setattr(language_model, "OWNER", 4000)
    monkeypatch.setattr(language_model, "scores", lambda *a: held.setdefault("a", a) and scores(*a))
    language_model.language_model_scores(spark.createDataFrame(LM, SCHEMA).coalesce(1))
    _, rows, owners, parent, discount, total, words = held["a"]
    got = defaultdict(list)
    for r in rows.collect():
        got[r["kind"]].append(r.asDict())
    assert owners > 1 and len(got["lexicon"]) == 1
    ids = language_model.get(got["lexicon"][0]["keys"]).astype(np.uint64)
    counts = language_model.get(got["lexicon"][0]["a"]).astype(np.int64)
    ids, counts = ids[counts > 0], counts[counts > 0]
    assert len(ids) == words and counts.sum() == total
    tables, left = language_model.replies(ids, got["reply"], owners)
    rate = parent.rate(left)
    assert abs(rate.sum() + parent.unknown() - 1) < 1e-6
    seen = language_model.get_sorted(held["a"][0].filter("kind = 'pairs'").first()["keys"])
    # the block asked for its own pairs only; all others have no customers
    lexicon = language_model.get(got["lexicon"][0]["keys"]).astype(np.uint64)
    every = language_model.get(got["lexicon"][0]["a"]).astype(np.int64)
    c, t = np.zeros((len(lexicon), len(lexicon))), np.zeros((len(lexicon), len(lexicon)))
    by = {r["peer"]: r for r in got["answer"]}
    for owner, _, places in language_model.routed(seen, lexicon, every, owners):
        u, w = (seen[places] >> np.uint64(32)).astype(int), (seen[places] & np.uint64(0xFFFFFFFF)).astype(int)
        c[u, w], t[u, w] = language_model.get(by[owner]["a"]), language_model.get(by[owner]["b"])
    known = np.flatnonzero(every > 0)
    c, t = c[np.ix_(known, known)], t[np.ix_(known, known)]
    assert (c.sum(axis=1) == counts).all() and np.abs(t.sum(axis=1) - tables).max() < 1e-3
    p = (c - discount * t + (1 + discount * tables[:, None]) * rate) / (1 + counts[:, None])
    unknown = (1 + discount * tables) * parent.unknown() / (1 + counts)
    assert np.abs(p.sum(axis=1) + unknown - 1).max() < 1e-5


@pytest.mark.parametrize(("c", "rate", "d"), [(2, 0.01, 0.6), (6, 0.3, 0.5), (20, 0.05, 0.8)])
def test_seating_has_the_posterior(c, rate, d):
    """One dish a room: tables t weigh rate^t times (1)(1 + d)...(1 + (t - 1) d) times the generalised Stirling number of c and t."""
    s = [1.0]
    for k in range(1, c):
        s = [(s[t - 1] if t else 0) + ((k - d * (t + 1)) * s[t] if t < len(s) else 0) for t in range(len(s) + 1)]
    weight, rise = [], 1.0
    for t in range(1, c + 1):
        rise *= rate * (1 + d * (t - 1))
        weight.append(rise * s[t - 1])
    want = sum(t * x for t, x in enumerate(weight, 1)) / sum(weight)
    n = 4000
    house = language_model.Restaurants(np.full(n, c), np.arange(n), np.ones(n), d, 1, parent=np.full(n, rate))
    for _ in range(12):
        house.sweep(np.full(n, rate))
        assert (house.tables == house.t).all() and house.sizes.sum() == n * c and (house.sizes > 0).all() and len(house.sizes) == house.t.sum()
    assert abs(house.t.mean() - want) < 0.03 * want + 0.02


@pytest.mark.parametrize(("c", "rate", "d", "others"), [(120, 0.9, 0.5, 0), (150, 0.02, 0.7, 90)])
def test_one_sweep_seats_all_customers(c, rate, d, others):
    """From a start with all customers at one table, one sweep gives the posterior, however many there are."""
    s = [1.0]
    for k in range(1, c):
        s = [(s[t - 1] if t else 0) + ((k - d * (t + 1)) * s[t] if t < len(s) else 0) for t in range(len(s) + 1)]
    weight, rise = [], 1.0
    for t in range(1, c + 1):
        rise *= rate * (1 + d * (others + t - 1))
        weight.append(rise * s[t - 1])
    want = sum(t * x for t, x in enumerate(weight, 1)) / sum(weight)
    n = 4000
    house = language_model.Restaurants(np.full(n, c), np.arange(n), np.full(n, 1.0 + others), d, 1, np.full(n, c), np.ones(n))
    house.sweep(np.full(n, rate))
    assert want > 2 and abs(house.t.mean() - want) < 0.03 * want
    assert (house.tables == house.t + others).all() and house.sizes.sum() == n * c and len(house.sizes) == house.t.sum()
    drawn = []
    for _ in range(n):  # a dish that has its turn to itself
        house.drawn_alone(0, np.full(1, rate))
        drawn.append(house.t[0])
    assert abs(np.mean(drawn) - want) < 0.04 * want


def test_frequent_contexts_are_split():
    u, w = np.zeros(9000, np.uint64), np.arange(9000, dtype=np.uint64)
    assert len(set(language_model.pair_owner(u, w, np.full(9000, 10), 50))) == 1
    assert len(set(language_model.pair_owner(u, w, np.full(9000, 160 * language_model.PIECE), 50))) > 25


def test_stirling_numbers_are_exact():
    c, k = np.array([17, 18, 60, 300, 2500]), np.array([17, 3, 60, 300, 40])
    row, exact = [0, 1], {}  # 4^(c - t) times the numbers for d = 3 / 4
    for n in range(1, 2501):
        if n in c:
            exact[n] = row
        row = [0, *(row[t - 1] + ((4 * n - 3 * t) * row[t] if t < len(row) else 0) for t in range(1, min(n + 1, 300 if n < 300 else 40) + 1))]
    by_rows = language_model.stirling_rows(0.75, c, k)
    by_integrals = language_model.stirling_integrals(0.75, c, k)
    assert by_integrals[4] is not None and by_integrals[3] is None  # as many tables as customers: left to the rows
    for got in (language_model.stirling(0.75, c, k), by_rows, by_integrals):
        for n, m, x in zip(c.tolist(), k.tolist(), got, strict=True):
            want = [math.log(exact[n][t]) - math.log(exact[n][1]) + (t - 1) * math.log(4) for t in range(1, m + 1)]
            assert x is None or np.allclose(x, want, rtol=1e-11, atol=1e-9)


def test_a_dish_costs_the_same_however_many_customers():
    """Before, a walk over all customers: 2 million of them took some 17 s."""
    start = time.process_time()
    house = language_model.Restaurants(np.array([2_000_000, 300]), np.zeros(2, np.int64), np.array([1000.0]), 0.7, 1, parent=np.array([1e-6, 1e-6]))
    house.sweep(np.array([1e-6, 1e-6]))
    assert time.process_time() - start < 4
    assert (house.t >= 1).all() and house.sizes.sum() == 2_000_300
