"""Golden by construction: expectations come from the inputs."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.plans import registry
from formloom.sources import containers as C

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()


def rows(data, cols):
    out = []
    for r in data:
        out.append(tuple("~" if r[c] is None else f"{r[c]:.6f}" if isinstance(r[c], float) else str(r[c]) for c in cols))
    return sorted(out)


@pytest.fixture(scope="module")
def answers(spark, request):
    """Columns and rows of the queries that are tested, run side by side."""
    names = {i.callspec.params["name"] for i in request.session.items if "name" in getattr(getattr(i, "callspec", None), "params", {})}

    def run(name):
        df = registry.queries()[name](spark, DATA)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        return {name: pool.submit(run, name) for name in sorted(names)}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(answers, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    columns, got = answers[name].result()
    want = con.sql(registry.oracle_sql()[name])
    cols = sorted(columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], cols)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_names_and_verdicts(spark):
    assert [one(spark, n, X.valid_name) for n in ("a", "A_1", "1a", "a\n", "constructor", "a" * 65)] == [True, True, False, False, False, False]
    assert [one(spark, v, lambda c: X.text_verdict(c, 3)) for v in (None, " ﻿", "né😀", "abcd", "a\x01")] == ["missing", "blank", None, "length", "control"]
    assert one(spark, "a😀", X.utf16_length) == 3


def test_values_are_not_filled_again(spark):
    m = F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("$3"))
    assert one(spark, "{{a}}-{{b}}-{{a}}", lambda c: X.fill(c, m)) == "{{b}}-$3-{{b}}"


def test_parts_of_archives(spark):
    good = C.write_archive([("notes/one.xml", b"<p/>"), ("mimetype", b"x")])
    docs = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"no archive"))], "path string, content binary")
    assert sorted((r.path, r.part or "", r.error or "") for r in C.parts(docs).collect()) == [("a", "mimetype", ""), ("a", "notes/one.xml", ""), ("b", "", "E_INPUT")]
