"""Queries of the operators in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tokenizer() -> str:
    """The vocabulary file that the token queries use; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import tamper_audit

    return tamper_audit(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence_audit

    return divergence_audit(table(spark, sf_dir, "documents"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = [op1_suffix_array_dedup, op2_license_scans, op3_token_output, op4_nearest_neighbours, op5_line_dedup, op6_bpe, op7_toxicity, op8_minhash, op9_mixing, op10_media, op11_merkle_manifest, op12_source_divergence, op13_language_model]
    return {f.__name__: f for f in named}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Windows of LENGTH bytes by their digests; texts as hexadecimal digits, cut into blocks first because a place is found by counting from the start.
REPEATS = """with d as (select doc_id, hex(coalesce(text, '')) as h, strlen(coalesce(text, '')) as n from documents),
b as (select doc_id, place, substr(h, 2 * place + 1, 2 * (1000 + 199)) as h, least(1000, n - 199 - place) as m from (select *, unnest(range(0, n - 199, 1000)) as place from d)),
w as (select doc_id, place + q as p, md5_number(substr(h, 2 * q + 1, 400)) as x from (select *, unnest(range(0, m)) as q from b)),
again as (select x from w group by x having count(*) > 1),
hit as (select doc_id, p, coalesce(p > lag(p) over (partition by doc_id order by p) + 200, true)::int as fresh from w where x in (select x from again)),
s as (select doc_id, min(p) as lo, max(p) + 200 as hi from (select *, sum(fresh) over (partition by doc_id order by p) as run from hit) group by doc_id, run),
piece as (select doc_id, lo as stop, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as start from s union all
  select d.doc_id, d.n, coalesce(max(s.hi), 0) from d left join s on s.doc_id = d.doc_id group by d.doc_id, d.n),
kept as (select p.doc_id, string_agg(substr(d.h, 2 * start + 1, 2 * (stop - start)), '' order by start) as h from piece as p join d on d.doc_id = p.doc_id group by p.doc_id),
g as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans from s group by doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept.h)) as kept_sha256 from d join kept on kept.doc_id = d.doc_id left join g on g.doc_id = d.doc_id"""

#: Similarities from the shingles that two documents share, classes by following links.
NEAR = rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as x from d),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s as a join s as b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from pair join n as p on p.doc_id = a join n as q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, reach) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.reach),
k as (select doc_id, min(reach) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(k.component_id, d.doc_id) as component_id, d.doc_id = coalesce(k.component_id, d.doc_id) as kept from d left join n on n.doc_id = d.doc_id left join k on k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say. Tokens, images, trained models and their draws, templates and approximate neighbours are tested against plain Python instead."""
    from . import divergence, licenses, merkle

    return {"op1_suffix_array_dedup": REPEATS, "op2_license_scans": licenses.sql(), "op8_minhash": NEAR, "op11_merkle_manifest": merkle.sql(), "op12_source_divergence": divergence.sql()}
