"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; all but the last keep the columns of documents.

1. toxicity: documents predicted toxic go.
2. line dedup: lines of recurring templates go but for their first place; documents left without any text go.
3. near duplicates: one document of each group stays.
4. mixing: documents are drawn at rates that bring the expected domain tokens to the targets.
5. tokens: token ids of each document, and how its text decodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formloom.llm import bpe, common, lines, minhash, mixing, toxicity
from formloom.llm.queries import table, tokenizer


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.line_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer())


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", dedup_lines),
    ("near duplicates", dedup_near),
    ("mixing", mix),
    ("tokens", encode),
]

#: The learnt stages have no SQL; tests/llm checks the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
