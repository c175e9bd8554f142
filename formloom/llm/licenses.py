"""License scans by a positional rare-token index, in DataFrame functions alone.

Each template is a run of words with phrases in it that must stand. One pass counts in how many documents each template word occurs. The
RARE words of a template's phrases with the greatest inverse document frequency are its postings (word, offset); the
index maps the first of them to the templates. In a document, the words of the index are looked up: one at place p proposes
the start p - offset, which the template's other postings must confirm at their relative places, and the start counts once all key
phrases stand word for word at theirs. Templates, postings and phrases are data in one literal, so the plan doesn't grow
with them; all of it happens inside the row, so nothing but the counts is shuffled.

Defined results: a null text has no words; words are the complement of WORD_GAP after lowering A-Z; base templates must
match whole, and overlapping places all count; other templates give labels when their key phrases are there, and score is
the greatest IDF-weighted share of a template's words that stand at their places; repeated rows give repeated results;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases asked for, with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Label and opening of public licences and of the notices that name them; what stands in brackets must be there.
TEMPLATES = [
    ("mit", "[Permission is hereby granted, free of charge], to any person obtaining a copy of this software and [associated documentation files]"),
    ("bsd", "[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the [following conditions are met]"),
    ("bsd-3", "[Neither the name of the copyright holder nor the names of its contributors] may be used to endorse or promote products derived from this software"),
    ("isc", "[Permission to use, copy, modify, and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed under the [GNU General Public License], version"),
    ("gpl", "This program is [free software: you can redistribute it and or modify] it under the terms of the [GNU General Public License]"),
    ("lgpl", "licensed under the [GNU Lesser General Public License], version"),
    ("agpl", "licensed under the [GNU Affero General Public License], version"),
    ("mpl-2", "This Source Code Form is [subject to the terms of the Mozilla Public License], v. 2.0"),
    ("epl", "made available under the terms of the [Eclipse Public License]"),
    ("apache-2", "Licensed under the [Apache License, Version 2.0]"),
    ("apache-2", "you may not use this file except in [compliance with the License]. You may obtain a [copy of the License at http www apache org licenses LICENSE 2.0]"),
    ("cc-by-nc", "licensed under [CC BY-NC 4.0]"),
    ("cc-by-nc", "licensed under a [Creative Commons Attribution-NonCommercial] 4.0 International License"),
    ("cc-by-sa", "licensed under a [Creative Commons Attribution-ShareAlike] 4.0 International License"),
    ("cc-by", "licensed under a [Creative Commons Attribution 4.0 International License]"),
    ("cc0", "To the extent possible under law, the author has [waived all copyright and related or neighboring rights]"),
    ("unlicense", "This is [free and unencumbered software released into the public domain]"),
    ("zlib", "This software is provided [as is, without any express or implied warranty]. In no event will the authors be held liable for any damages"),
    ("boost", "[Boost Software License], Version 1.0"),
    ("artistic-2", "[Artistic License] 2.0"),
    ("ofl", "This Font Software is [licensed under the SIL Open Font License], Version 1.1"),
    ("wtfpl", "[Do What The Fuck You Want To Public License]"),
    ("all-rights-reserved", "[All rights reserved]"),
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(low, WORD_GAP), "")


def parsed(label: str, text: str, base: bool = False) -> dict:
    """A template: its words, and the offset and words of each phrase in brackets."""
    import re

    words: list[str] = []
    keys = []
    for part in re.split(r"(\[[^\]]*\])", text):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.lower())
        if part.startswith("["):
            keys.append({"off": len(words), "words": own})
        words += own
    return {"label": label, "base": base, "words": words, "keys": keys}


def all_templates() -> list[dict]:
    return [parsed(label, f"[{p}]", True) for label, p in BASE] + [parsed(label, p) for label, p in TEMPLATES]


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each vocabulary word (a fixed list); counted over all of them."""
    own = F.array_distinct(F.filter(words_of(F.col("text")), lambda x: x.isin(vocabulary)))
    rows = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # one row a vocabulary word
    got = {r["w"]: r["count"] for r in rows}
    return got.pop("", 0), got


def with_postings(template: dict, idf: dict[str, float]) -> dict:
    """The template with weights and the first places of the RARE highest-IDF words of its phrases (ties: the earlier one)."""
    inside = sorted({k["off"] + i for k in template["keys"] for i in range(len(k["words"]))})
    chosen: list[dict] = []
    for i in sorted(inside, key=lambda i: (-idf[template["words"][i]], i)):
        if template["words"][i] not in [p["word"] for p in chosen]:
            chosen.append({"word": template["words"][i], "off": i})
    weight = [idf[w] for w in template["words"]]
    return template | {"postings": chosen[:RARE], "idf": weight, "total": sum(weight)}


SHAPE = "array<struct<label:string,base:boolean,words:array<string>,keys:array<struct<off:int,words:array<string>>>,postings:array<struct<word:string,off:int>>,idf:array<double>,total:double>>"


def license_scan(docs: DataFrame, templates: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    templates = all_templates() if templates is None else templates
    n, df = document_frequencies(plain, sorted({w for t in templates for w in t["words"]}))
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for t in templates for w in t["words"]}
    templates = [with_postings(t, idf) for t in templates]
    index: dict[str, list[dict]] = {}
    for i, t in enumerate(templates):
        index.setdefault(t["postings"][0]["word"], []).append({"t": i, "off": t["postings"][0]["off"]})
    known = F.from_json(F.lit(json.dumps(templates)), SHAPE)
    looked_up = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<t:int,off:int>>>")
    of = lambda c: F.get(known, c["t"])

    w = F.col("w")
    hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(sorted(index)), i)), lambda p: p.isNotNull())
    found = plain.select("doc_id", words_of(F.col("text")).alias("w")).withColumn("hits", hits)
    proposed = F.flatten(F.transform("hits", lambda p: F.transform(F.try_element_at(looked_up, F.get(w, p)), lambda e: F.struct(e["t"].alias("t"), (p - e["off"]).alias("start")))))

    def confirmed(c: Column) -> Column:
        postings = F.forall(of(c)["postings"], lambda q: F.coalesce(F.get(w, c["start"] + q["off"]) == q["word"], F.lit(False)))
        # a template may begin before the text does, its phrases may not
        phrase = lambda k: (c["start"] + k["off"] >= 0) & (F.slice(w, F.greatest(c["start"] + k["off"] + 1, F.lit(1)), F.size(k["words"])) == k["words"])
        return postings & F.forall(of(c)["keys"], phrase)

    def share(c: Column) -> Column:
        """The IDF-weighted share of the template's words at their places."""
        weight = F.zip_with(of(c)["words"], of(c)["idf"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        held = F.transform(weight, lambda e, j: F.when(F.get(w, c["start"] + j) == e["x"], e["y"]).otherwise(0.0))
        return F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / of(c)["total"]

    found = found.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), F.filter(proposed, confirmed).alias("stands"))
    base = F.filter("stands", lambda c: of(c)["base"])
    labels = lambda cs: F.array_join(F.array_sort(F.array_distinct(F.transform(cs, lambda c: of(c)["label"]))), ",")
    starts = F.transform(base, lambda c: c["start"])
    score = F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("stands", share)), F.lit(0.0))), 6)
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), labels(base).alias("base_labels"), labels(F.col("stands")).alias("labels"), score.alias("score"))


def sql() -> str:
    """The same for DuckDB: the templates as rows, phrases found word by word, scores from the counts over all documents."""
    quoted = lambda s: "'" + s + "'"
    listed = lambda ws: "[" + ", ".join(map(quoted, ws)) + "]"
    all_ = all_templates()
    t = ", ".join(f"({i}, {quoted(x['label'])}, {str(x['base']).lower()}, {listed(x['words'])})" for i, x in enumerate(all_))
    k = ", ".join(f"({i}, {j}, {key['off']}, {listed(key['words'])})" for i, x in enumerate(all_) for j, key in enumerate(x["keys"]))
    return rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t(t, label, base, words) as (values {t}), k(t, j, off, phrase) as (values {k}),
tw as (select t, unnest(words) as word, unnest(range(0, len(words))) as j from t),
tok as (select r, unnest(w) as word, unnest(range(0, len(w))) as p from d),
df as (select word, count(distinct r) as n from tok where word in (select word from tw) group by word),
idf as (select distinct tw.word, ln(((select count(*) from d) + 1) / (coalesce(df.n, 0) + 1)) + 1 as x from tw left join df on df.word = tw.word),
hit as (select tok.r, k.t, k.j, tok.p - k.off as s from tok join k on tok.word = k.phrase[1] join d on d.r = tok.r where d.w[tok.p + 1 : tok.p + len(k.phrase)] = k.phrase),
c as (select r, t, s from hit group by r, t, s having count(distinct j) = (select count(*) from k where k.t = hit.t)),
sc as (select c.r, c.t, c.s, sum(case when c.s + tw.j >= 0 and d.w[c.s + tw.j + 1] = tw.word then idf.x else 0 end) / sum(idf.x) as x from c join d on d.r = c.r join tw on tw.t = c.t join idf on idf.word = tw.word group by all),
g as (select sc.r, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(x) as x from sc join t on t.t = sc.t group by sc.r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(least(1.0, coalesce(x, 0.0)), 6)::double as score from d left join g on g.r = d.r"""
