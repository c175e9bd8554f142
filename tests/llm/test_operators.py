"""Each operator against brute force or an exact round trip, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from formloom.llm import ann, bpe, licenses, lines, media, minhash, mixing, suffix, tokenfile, toxicity
from formloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, k string, n_tokens long, bucket string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def texts():
    base = prose(1, 400)
    words = base.split()
    near = [" ".join(w if (i * 7 + s) % 60 else "edit%d" % s for i, w in enumerate(words)) for s in range(4)]
    out = [None, "", "  \n", "one two", base, base, *near, prose(2, 300) + " " + " ".join(words[50:150]), prose(3, 5000) + "\n" + prose(3, 40), "x" * 700, "é漢字 Released under the MIT License. Under CC BY-NC 4.0"]
    return out + ["Under the MIT license under the mit license", "<|endoftext|> it's 12,5!", "new letters \U000105c0 a\U00010940b \ua7dcx\u0897\u0323\u0301 Don't <|endoftext|>\U00010d50", "shared line number %d here" % 7 + "\n" + prose(8, 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "x", 5, "b") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "null id", "en", "s", "x", 5, "b")], SCHEMA)


#: Rows equal in id and text, ids that stand for two texts, null ids with null and with equal texts.
REPEATED = [(2, "near"), (5, "other"), (5, "near"), (7, "other"), (7, "other"), (7, "other"), (8, "near"), (8, "near"), (9, None), (9, None), (None, None), (None, "other"), (None, "other"), (4, ""), (4, "third")]


def repeated_rows():
    text = {"near": prose(41, 120), "other": prose(42, 120), "third": prose(43, 5)}
    return [(i, text.get(t, t)) for i, t in REPEATED]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame([(i, t, "en", "s", "x", 5, "b") for i, t in repeated_rows()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("group", [1, 1500])
def test_suffix(docs, empty, group, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", group)
    got = by_id(suffix.remove_repeats(docs))
    want = suffix.brute_force(dict(enumerate(texts())))
    assert {k: tuple(got[k])[1:] for k in want} == want
    assert suffix.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("group", [1, 1500])
def test_suffix_repeated(repeated, group, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = repeated_rows()
    want = suffix.brute_force({n: t for n, (_, t) in enumerate(rows)})
    got = suffix.remove_repeats(repeated).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *want[n])) for n, (i, _) in enumerate(rows))


def test_segments(monkeypatch):
    data = np.random.default_rng(2).integers(97, 105, 5000).astype(np.uint8)
    want = suffix.places(data)
    for size in (1, 64, 700):
        monkeypatch.setattr(suffix, "SEGMENT", size)
        got = suffix.places(data)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_licenses(docs, empty):
    got = by_id(licenses.license_scan(docs))
    for i, text in enumerate(texts()):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(s, label) for label, p in licenses.BASE for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (got[i].first_word, got[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert licenses.license_scan(empty).count() == 0


def test_licenses_equal_sql(spark, repeated):
    import duckdb
    import pandas as pd

    plain = lambda t: t.replace("[", "").replace("]", "")
    out = [plain(t) for _, t in licenses.TEMPLATES] + [prose(80 + i, 30) + " " + plain(t).upper() + "!" for i, (_, t) in enumerate(licenses.TEMPLATES)]
    # the phrase without what stands before it, phrases out of place, two licences at once
    out += ["GNU General Public License", "associated documentation files permission is hereby granted free of charge", "Licensed under CC BY-NC 4.0. " + plain(licenses.TEMPLATES[0][1])]
    rows = [*repeated_rows(), *((100 + i, t) for i, t in enumerate(out))]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = [tuple(r) for r in duckdb.sql(licenses.sql()).fetchall()]
    got = [tuple(r) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    labels = {r[0]: r[6] for r in got}
    assert all(label in labels[100 + i].split(",") for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    six, three, start = by_id(bpe.encode_decode(docs, tokenizer())), by_id(tokenfile.round_trip(docs, tokenizer())), 0
    start = three[None].n_tokens
    for i, text in enumerate(texts()):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert tuple(six[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        ids.append(1)
        assert tuple(three[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert bpe.encode_decode(empty, tokenizer()).count() == tokenfile.round_trip(empty, tokenizer()).count() == 0


def test_tokens_repeated(spark, repeated, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "FILE_TOKENS", 20)
    t, start = Tokenizer.from_file(tokenizer()), 0
    got = tokenfile.round_trip(repeated, tokenizer()).collect()
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    crc = lambda text: zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=repr) == sorted(((i, crc(x)) for i, x in repeated_rows()), key=repr)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_other_tokenizer(tmp_path):
    """A file with another normalisation goes through the library; another model is refused."""
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(tokenizer(), encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    t, enc = Tokenizer.from_file(str(other)), bpe.encoder(str(other))
    for text in filter(None, texts()):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    spec["model"]["type"] = "WordPiece"
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(other))


def test_many_ids():
    r = np.random.default_rng(4)
    counts = r.integers(1, 50, 70_000)
    lengths, bits = tokenfile.code_lengths(counts), tokenfile.code_bits(70_000)
    assert bits == 17 and lengths.max() <= 17
    ids = r.integers(0, 70_000, 3001)
    stream, at = tokenfile.pack(ids, lengths, tokenfile.canonical_codes(lengths))
    assert (tokenfile.unpack(stream, at, 3001, tokenfile.lookup(lengths, bits), bits) == ids).all()


def test_huffman():
    r = np.random.default_rng(0)
    counts = (1000 / np.arange(1, 3001) ** 2).astype(np.int64) + 1
    lengths = tokenfile.code_lengths(counts)
    assert lengths.max() <= tokenfile.MAX_BITS and (0.5 ** lengths.astype(float)).sum() <= 1
    for n in (0, 1, 255, 256, 257, 5001):
        ids = r.integers(0, 3000, n)
        stream, at = tokenfile.pack(ids, lengths, tokenfile.canonical_codes(lengths))
        assert (tokenfile.unpack(stream, at, n, tokenfile.lookup(lengths, 16), 16) == ids).all()


def test_nearest(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((600, 16))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    v[100:140] = v[0]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0], 1), (None, v[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for x in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    hits = 0
    for q, ranks in got.items():
        s = v @ v[q]
        want = sorted((j for j in range(600) if j != q), key=lambda j: (-round(float(s[j]), 12), j))[:20]
        assert sorted(ranks) == list(range(1, 21)) and all(abs(s[i] - x) < 1e-9 for i, x in ranks.values())
        hits += len({i for i, _ in ranks.values()} & set(want))
    assert len(got) == 30 and hits >= 0.9 * 600
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_repeated(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in ann.nearest(df, df.filter("vec_id = 0"), 3).collect())
    first, other = [(1, 3, 2.0), (2, 0, 1.0), (3, 0, 0.0)], [(1, 4, 3.0), (2, 0, 0.0), (3, 0, 0.0)]
    assert got == sorted((0, *x) for x in [*first, *first, *other])


@pytest.mark.parametrize("spread", ["plain", "tenth"])
def test_nearest_norms(spread):
    r = np.random.default_rng(1)
    v = r.standard_normal((600, 16))
    if spread == "tenth":
        v *= (1 + 0.1 * r.standard_normal((600, 1))) / np.sqrt((v * v).sum(axis=1, keepdims=True))
    ids = np.arange(600)
    q, d, _ = ann.search_block(ids, np.ones(600, np.int64), v, ids[::20], v[::20], float(np.sqrt((v * v).sum(axis=1).max())))
    hits = 0
    for i in ids[::20]:
        s = v @ v[i]
        s[i] = -np.inf
        hits += len(set(d[q == i // 20].tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 600


def test_minhash(docs, empty):
    got = by_id(minhash.near_duplicates(docs))
    sets = {}
    for i, text in enumerate(texts()):
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in sets} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(empty).count() == minhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("chunk", [1, 512])
def test_minhash_blocks(spark, chunk, monkeypatch):
    """Families of texts that share bands without being alike, and near copies within each; blocks of two members, too."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    r = random.Random(3)
    common_words = prose(60, 150).split()
    out = []
    for f in range(6):
        own = common_words[:110] + prose(70 + f, 40).split()
        for _ in range(7):
            w = list(own)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(w))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in out]
    root = list(range(len(out)))
    for _ in range(4):
        for a in range(len(out)):
            for b in range(len(out)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert [got[i].component_id for i in range(len(out))] == root


def test_keep_first(repeated):
    got = minhash.keep_first(repeated)
    assert got.columns == repeated.columns
    texts_ = {t: n for n, t in {"near": prose(41, 120), "other": prose(42, 120), "third": prose(43, 5)}.items()}
    kept = sorted(((r.doc_id, texts_.get(r.text, r.text)) for r in got.collect()), key=repr)
    assert kept == sorted([(2, "near"), (5, "other"), (9, None), (9, None), (None, None), (None, "other"), (None, "other"), (4, ""), (4, "third")], key=repr)
    rows = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(repeated).filter("doc_id is not null").collect())
    assert rows == sorted([(2, 2), (5, 5), (5, 2), (7, 5), (7, 5), (7, 5), (8, 2), (8, 2), (9, 9), (9, 9), (4, 4), (4, 4)])


def test_media(docs, empty):
    got = by_id(media.media_columns(docs))
    for i, text in enumerate(texts()):
        data = (text or "").encode()
        p = data + b" " * (-len(data) % 192 if data else 192)
        assert (got[i].n_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        image = media.to_image(p)
        samples = np.frombuffer(p, np.uint8).astype(int)
        hist = ",".join(str(int(((samples // 64) == k).sum())) for k in range(4))
        mean, var = int(samples.sum()) * 1000 // len(p), (int((samples**2).sum()) * len(p) - int(samples.sum()) ** 2) * 1000 // len(p) ** 2
        assert (got[i].payload_bytes, got[i].media_bytes, got[i].media_sha256) == (len(p), len(image), hashlib.sha256(image).hexdigest())
        assert got[i].feature == f"gray8 192x{len(p) // 192} mean={mean} var={var} hist={hist}"
    assert got[1].media_sha256 == got[0].media_sha256 and media.media_columns(empty).count() == 0


def test_media_ranges(spark, repeated, tmp_path, monkeypatch):
    where = str(tmp_path / "archives")
    assert media.write_archives(repeated.repartition(2), where) == len(REPEATED)
    media.register(spark)
    want = sorted(((i, (t or "").encode()) for i, t in repeated_rows()), key=repr)
    for split in (50, 1000, 1 << 24):
        rows = spark.read.format("formloom_media").option("split_bytes", split).load(where).collect()
        assert sorted(((r.doc_id, bytes(r.payload)[: r.n_bytes]) for r in rows), key=repr) == want
        assert all(media.from_image(bytes(r.media)).tobytes() == bytes(r.payload) for r in rows)
    # a read that fails twice is repeated for its member alone; a damaged member is an error
    (path,) = sorted(tmp_path.glob("archives/*.flm"))[:1]
    data = path.read_bytes()

    class Source:
        reads, opened = 0, 0

        def open_input_file(self, _):
            Source.opened += 1
            return self

        def close(self):
            pass

        def seek(self, at):
            self.at = at

        def read(self, n):
            Source.reads += 1
            return data[self.at : self.at + n - (Source.reads < 3)]

    entries, _ = media.read_directory(media.common.filesystem(str(path))[0], str(path))
    e = entries[0]
    assert media.ArchiveReader.member(Source(), [Source()], "x", int(e["at"]), int(e["stored"]), int(e["crc"])) == data[int(e["at"]) : int(e["at"]) + int(e["stored"])]
    assert (Source.reads, Source.opened) == (3, 2)
    with pytest.raises(OSError):
        media.ArchiveReader.member(Source(), [Source()], "x", int(e["at"]), int(e["stored"]), int(e["crc"]) ^ 1)


def test_lines(spark, empty):
    rows = [(i, f"{prose(i, 30)}\nitem {i} of the common footer line\n\n{prose(99, 12)}", "en", "s", "x", 5, "b") for i in range(8)]
    out = by_id(lines.cut_lines(spark.createDataFrame([*rows, (50, None, "", "", "", 0, "")], SCHEMA)))
    assert out[0].text == rows[0][1] and out[50].text is None
    assert all(out[i].text == prose(i, 30) + "\n" and out[i]._cut == 2 for i in range(1, 8))
    assert lines.line_report(empty).count() == 0


@pytest.mark.parametrize("leaf", [2, 400, 10000])
def test_large_leaf(spark, leaf, monkeypatch):
    monkeypatch.setattr(lines, "LEAF", leaf)
    user = [prose(1000 + i, 2).replace(" ", "q") for i in range(450)]
    rows = [(i, f"this page was written by {u} for our readers", "en", "s", "x", 5, "b") for i, u in enumerate(user)]
    rows += [(1000 + i, f"this page was {prose(2000 + i, 6)}", "en", "s", "x", 5, "b") for i in range(20)]
    out = by_id(lines.cut_lines(spark.createDataFrame(rows, SCHEMA)))
    assert {i for i, x in out.items() if x._cut} == set(range(1, 450))


def test_leaf_size_changes_nothing(spark, monkeypatch):
    """Three families in one leaf, a third of the fields free: the same lines go, whatever a large leaf is."""
    r = random.Random(3)
    kin = [[prose(70 + f, 9).split()[i] for i in range(9)] for f in range(3)]
    free = [r.sample(range(2, 9), 3) for _ in kin]

    def line():
        f = r.randrange(3)
        return " ".join(["lead", *[r.choice(kin[f] + ["x", "y"]) + "abcdefgh"[r.randrange(8)] if k in free[f] else w for k, w in enumerate(kin[f])]])

    rows = [(i, line(), "en", "s", "x", 5, "b") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for leaf in (2, 50, 400, 100_000):
        monkeypatch.setattr(lines, "LEAF", leaf)
        seen.append({(x.doc_id, x._cut) for x in lines.cut_lines(df).collect()})
    assert seen[0] == seen[1] == seen[2] == seen[3] and sum(n for _, n in seen[0]) > 1200


def test_long_lines(spark):
    rows = [(i, f"{prose(i, 30)}\n{prose(501, 51)}\n{prose(502, 50)}", "en", "s", "x", 5, "b") for i in range(2)]
    out = by_id(lines.cut_lines(spark.createDataFrame(rows, SCHEMA)))
    assert out[0].text == rows[0][1] and out[1].text == f"{prose(1, 30)}\n{prose(502, 50)}"


def test_keep_clean_keeps_columns(spark):
    d = spark.createDataFrame([(i, prose(i, 40) + (" idiot moron scum" * 2 if i % 8 == 0 else ""), 0.5, "x") for i in range(400)], "doc_id long, text string, _toxicity double, _Toxicity_ string")
    labels = spark.createDataFrame([(i, 0, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.keep_clean(d, labels)
    assert got.columns == d.columns and {r._toxicity for r in got.collect()} == {0.5}


@pytest.mark.parametrize("size", [1e200, 1e-200])
def test_vectors_of_any_size(spark, size):
    v = np.random.default_rng(3).normal(size=(100, 8))
    rows = [(i, [float(y) * size for y in x]) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(d, d.filter("vec_id < 10"), 5).collect()}
    dots = v @ v.T
    want = {(q, k + 1): i for q in range(10) for k, i in enumerate([i for i in np.argsort(-dots[q]) if i != q][:5])}
    assert len(got) == 50 and sum(got[k] == want[k] for k in want) >= 47


def test_learnt(spark, docs, empty):
    r = random.Random(5)
    rows = [(i, prose(i, 40) + (" idiot moron scum" * 2 if i % 8 == 0 else ""), "en", "s", "x", 5, "b") for i in range(900)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, r.randint(0, 1), int(i % 8 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(d, labels))
    held = [x for x in got.values() if x.held_out]
    assert sum(x.predicted == int(x.doc_id % 8 == 0) for x in held) >= 0.9 * len(held)
    rates = by_id(mixing.mixing_rates(d, labels))
    assert all(x.rate >= 0 and abs(x.p_high + x.p_low + x.p_toxic - 1) < 1e-6 for x in rates.values())
    assert rates[8].p_toxic > rates[9].p_toxic and sum(rates[i].rate for i in range(0, 900, 8)) / 113 < 0.2 * sum(x.rate for x in rates.values()) / 900
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count() == mixing.mixing_rates(docs, labels.limit(0)).count()
    assert toxicity.toxicity(empty, labels).count() == mixing.mixing_rates(empty, labels).count() == 0


def test_mixing_totals(spark):
    r = np.random.default_rng(7)
    p = r.dirichlet([2.0, 0.2, 0.3], 500)
    n = r.integers(1, 300, 500)
    schema = "n_tokens long, p_high double, p_low double, p_toxic double"

    def shares(p):
        rows = [(int(m), *map(float, x)) for m, x in zip(n, p, strict=True)]
        got = np.array([tuple(x) for x in mixing.fitted_rates(spark.createDataFrame(rows, schema), mixing.TARGETS).collect()])
        assert (got[:, 4] >= 0).all()
        return (got[:, 4:] * got[:, :1] * got[:, 1:4]).sum(axis=0) / n.sum(), got[:, 4]

    assert np.abs(shares(p)[0] - [0.88, 0.10, 0.02]).max() < 1e-4
    # out of reach: every document is a tenth toxic, so all get one rate, that of the least squares
    held = np.array([0.8, 0.1, 0.1])
    best = held @ [0.88, 0.10, 0.02] / (held @ held)
    assert np.abs(shares(np.tile(held, (500, 1)))[1] - best).max() < 1e-3