"""Source divergence audit: how far the word rates of each source lie from those of the other sources of its language, and which words
stand out.

Each (lang, source) group is a vector of rates over the words that at least MIN_DOCUMENTS documents of the language hold. Groups of a language sit on
SEATS seats. A seat stays in its partition; in each round of a round-robin tournament the compressed vectors of half of the seats
travel to the seat that they meet, both directions of the meeting are worked out there at once, and after SEATS - 1 rounds all seats
have met. Words are dealt into shards, so a seat's vectors are cut into blocks of at most about CELLS rates and no task ever holds a whole
vector; the parts add up. While a block is built, a heap keeps each group's TOP words of the shard; the heaps of the shards are merged.

All arithmetic is exact: counts become integer rates `1 + 10^9 (count + 2) div (N + 2 V)`, at most 10^9 + 1, and
a divergence is a sum of `(p - q)^2 div (p + q)`.

Defined results: null text, lang and source are empty strings; a group without words takes part with equal rates; a language without any kept word
gives pairs of value 0; a lone source has no pairs; repeated rows count as documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MIN_DOCUMENTS = 10
UNIT = 1_000_000_000
TOP = 10
SEATS = 8
#: Words of a shard, at most about; fewer where a seat has many groups.
WIDTH = 8192
CELLS = 1 << 21
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Counts from which 10^9 (count + 2) needs more than 64 bits.
WIDE = 9_000_000_000
#: Bytes of a word stay, A-Z lower-cased; all others become blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

KEYS = ["lang", "shard", "seat"]
BLOCK = "kind string, lang string, shard long, seat int, a int, b int, term string, value long, nos binary, rates binary"
KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, documents, n: partial counts, combined within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in held.items():
                words = list(n)
                cols = [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([documents[w] for w in words], pa.int64()), pa.array(n.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "documents", "n"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().encode().translate(LETTERS).split()
                n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                documents.update(set(words))
                size += len(n) - before
                if size >= HELD:
                    yield from packed()
                    held, size = {}, 0
        yield from packed()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, documents long, n long")


def rates(counts: np.ndarray, total: np.ndarray, words: int) -> np.ndarray:
    """Rates of rows of counts, whose totals over all words of the language are given."""
    if counts.max(initial=0) >= WIDE or total.max(initial=0) >= WIDE:
        counts, total = counts.astype(object), total.astype(object)
    return (1 + UNIT * (counts + 2) // (total + 2 * words)[:, None]).astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def met(at: tuple, nos: np.ndarray, mine: np.ndarray, others: np.ndarray, theirs: np.ndarray) -> list[tuple]:
    """The pairs of a meeting of two blocks, both directions."""
    out = []
    for a, p in zip(nos.tolist(), mine, strict=True):
        for b, value in zip(others.tolist(), apart(theirs, p).sum(axis=1).tolist(), strict=True):
            out += [("pair", *at, a, b, None, value, None, None), ("pair", *at, b, a, None, value, None, None)]
    return out


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[] for _ in KINDS], KINDS, strict=True)], [f.split()[0] for f in BLOCK.split(", ")])


def built(t: pa.Table) -> pa.Table:
    """A seat's block of a shard: its compressed rates, the pairs of its own groups, and each group's heap of words."""
    at = (t["lang"][0].as_py(), t["shard"][0].as_py(), t["seat"][0].as_py())
    part = np.asarray(t["part"])
    no, slot, n = (np.asarray(t[c].fill_null(0)) for c in ("no", "slot", "n"))
    member, word, cell = (np.flatnonzero(part == k) for k in range(3))
    member = member[np.argsort(no[member])]
    word = word[np.argsort(slot[word])]
    nos, total = no[member], n[member]
    words, whole = int(t["words"][int(member[0])].as_py()), np.array([int(t["whole"][int(member[0])].as_py())])
    counts = np.zeros((len(nos), len(word)), np.int64)
    counts[np.searchsorted(nos, no[cell]), slot[cell]] = n[cell]
    p, q = rates(counts, total, words or 1), rates(n[word][None, :], whole, words or 1)[0]
    terms = t["term"].take(pa.array(word)).to_pylist()
    out = [("block", *at, None, None, None, None, nos.astype("<i4").tobytes(), zlib.compress(p.astype("<u4").tobytes(), 1))]
    for i in range(len(nos) - 1):
        out += met(at, nos[i : i + 1], p[i : i + 1], nos[i + 1 :], p[i + 1 :])
    for a, mine, seen in zip(nos.tolist(), p, counts, strict=True):
        over = np.flatnonzero((seen > 0) & (mine > q))
        value = apart(mine[over], q[over])
        if len(over) > TOP:  # ties at the last value stay for the heap
            keep = value >= np.partition(value, len(value) - TOP)[len(value) - TOP]
            over, value = over[keep], value[keep]
        heap = heapq.nsmallest(TOP, ((-v, terms[k]) for v, k in zip(value.tolist(), over.tolist(), strict=True)))
        out += [("term", *at, a, None, term, -v, None, None) for v, term in heap]
    return table(out)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    nos = np.frombuffer(row["nos"], "<i4")
    return nos, np.frombuffer(zlib.decompress(row["rates"]), "<u4").astype(np.int64).reshape(len(nos), -1)


def meeting(stays: pa.Table, comes: pa.Table) -> pa.Table:
    """A round's meeting at one seat, for one shard."""
    if not stays.num_rows or not comes.num_rows:
        return table([])
    here, there = stays.to_pylist()[0], comes.to_pylist()[0]
    return table(met((here["lang"], here["shard"], here["seat"]), *opened(here), *opened(there)))


def opponent(seat: str, turn: int) -> Column:
    """Whom a seat meets in a round: the last seat stands still, the others go round."""
    last = SEATS - 1
    turning = F.pmod(F.lit(2 * turn) - F.col(seat), F.lit(last))
    return F.when(F.col(seat) == last, F.lit(turn)).when(F.col(seat) == turn, F.lit(last)).otherwise(turning).cast("int")


def tournament(blocks: DataFrame) -> DataFrame:
    """All meetings of different seats. The exchange of the blocks that stay is the same in every round, so Spark makes it once."""
    stays = blocks.groupBy(*KEYS)
    out = None
    for turn in range(SEATS - 1):
        at = opponent("seat", turn)
        # named anew: both sides of a cogroup must not share columns
        comes = blocks.filter(at < F.col("seat")).withColumn("seat", at).toDF(*[f"{c}_" for c in blocks.columns]).toDF(*blocks.columns)
        pairs = stays.cogroup(comes.groupBy(*KEYS)).applyInArrow(meeting, BLOCK)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def divergence_audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to all other groups of the language (`pair`), and the TOP words that
    it holds more often than its language (`term`)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    # one exchange by word serves the groups' counts and the language's
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    of_word = Window.partitionBy("lang", "term")
    counted = counted.withColumn("in_documents", F.sum("documents").over(of_word)).filter(F.col("in_documents") >= MIN_DOCUMENTS)
    cells = common.stored(counted.select("lang", "source", "term", "n", F.sum("n").over(of_word).alias("all"), (F.row_number().over(of_word.orderBy("source")) == 1).alias("first")))

    langs = cells.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("words"), F.sum("n").alias("whole"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "words", "whole"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("groups", F.count("*").over(Window.partitionBy("lang")))
    width = F.greatest(F.lit(1), F.least(F.lit(WIDTH), F.floor(F.lit(CELLS) / F.ceil(F.col("groups") / SEATS))))
    groups = common.stored(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("words") / width))).withColumn("seat", (F.col("no") % SEATS).cast("int")))

    shards = groups.filter("no = 0").select("lang", "shards", "groups")
    in_shard = Window.partitionBy("lang", "shard").orderBy("term")
    words = cells.filter("first").join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    words = common.stored(words.select("lang", "term", "shard", (F.row_number().over(in_shard) - 1).alias("slot"), F.col("all").alias("n"), F.least("groups", F.lit(SEATS)).alias("seats")))

    fields = [*KEYS, "part", "no", "slot", "n", "term", "words", "whole"]
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    members = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select(*KEYS, F.lit(0).alias("part"), "no", null("int", "slot"), F.col("total").alias("n"), null("string", "term"), "words", "whole")
    whole = words.withColumn("seat", F.explode(F.sequence(F.lit(0), (F.col("seats") - 1).cast("int")))).select(*KEYS, F.lit(1).alias("part"), null("int", "no"), "slot", "n", "term", null("long", "words"), null("long", "whole"))
    placed = cells.select("lang", "source", "term", "n").join(words.select("lang", "term", "shard", "slot"), ["lang", "term"]).join(groups.select("lang", "source", "no", "seat"), ["lang", "source"])
    placed = placed.select(*KEYS, F.lit(2).alias("part"), "no", "slot", "n", null("string", "term"), null("long", "words"), null("long", "whole"))
    laid = members.unionByName(whole).unionByName(placed).select(*fields)
    first = common.stored(laid.groupBy(*KEYS).applyInArrow(built, BLOCK))
    common.dropped(cells, words)

    pairs = common.stored(first.filter("kind = 'pair'").unionByName(tournament(first.filter("kind = 'block'"))).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    names = groups.select("lang", "no", "source")
    pairs = pairs.join(names.withColumnRenamed("no", "a"), ["lang", "a"]).join(names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    terms = first.filter("kind = 'term'").select("lang", F.col("a").alias("no"), F.col("term").alias("item"), "value").join(names, ["lang", "no"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value", F.row_number().over(by_value).alias("rank")]
    ranked = terms.withColumn("part", F.lit("term")).select(*out).filter(F.col("rank") <= TOP)
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(ranked)


def sql() -> str:
    """The same rows from sums over all words of all pairs of groups."""
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    rate = lambda n, total: f"(1 + ({UNIT}::hugeint * ({n} + 2)) // ({total} + 2 * v))"
    return rf"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
hold as (select lang, unnest(list_distinct(w)) as term from d),
k as (select lang, term from hold group by all having count(*) >= {MIN_DOCUMENTS}),
c as (select x.lang, source, x.term, count(*) as n from (select lang, source, unnest(w) as term from d) as x join k on k.lang = x.lang and k.term = x.term group by all),
g as (select g.lang, g.source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) as g left join c on c.lang = g.lang and c.source = g.source group by all),
l as (select g.lang, coalesce(any_value(k.v), 0) as v, sum(total) as whole from g left join (select lang, count(*) as v from k group by lang) as k on k.lang = g.lang group by g.lang),
q as (select k.lang, k.term, sum(n) as n from k join c on c.lang = k.lang and c.term = k.term group by all),
r as (select g.lang, g.source, q.term, coalesce(c.n, 0) as n, {rate("coalesce(c.n, 0)", "total")} as p, {rate("q.n", "whole")} as q
  from g join l on l.lang = g.lang join q on q.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = q.term),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum({f("x.p", "y.p")}) from r as x join r as y on x.lang = y.lang and x.term = y.term where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from g as a join g as b on a.lang = b.lang and a.source <> b.source),
term as (select lang, source, 'term' as part, term as item, {f("p", "q")}::bigint as value from r where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select * from ranked where part = 'pair' or rank <= {TOP}"""
