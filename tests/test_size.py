"""What keeps large inputs off the driver and out of single tasks."""

from pyspark.sql import functions as F

from formloom.operators import tables as T
from formloom.operators.lineage import cut

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_verdict_joins_by_sorting(spark):
    """Rows that arrays give aren't in the sizes guessed ahead, so none of them may be broadcast."""
    from formloom.plans import grids

    assert "BroadcastHashJoin" not in plan_of(grids.repeat_region_verdict(spark, SF))


def test_stored_tables_join_by_sorting(spark):
    many = cut(spark.range(10).select("id", F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("n")))
    assert "BroadcastHashJoin" not in plan_of(spark.range(10).join(many.filter("n > 5"), "id"))


def test_continued_verdict_says_what_its_sql_says(spark, tmp_path):
    """A value longer than an entry may hold is a fault in both."""
    import duckdb

    from formloom.plans import forms, registry

    words = "word " * 500
    texts = [(i, words * (12 if i in (15, 113, 155) else 2), "en", "s", 1) for i in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(own.execute(f"select doc, reason from ({registry.SQL['pdf_continued_verdict']})").fetchall())
    assert {r.doc: r.reason for r in forms.pdf_continued_verdict(spark, str(tmp_path)).collect()} == want
    assert want[15] == want[13] == want[5] == "entry" and want[23] is None


def test_chunks_are_worked_out_once(spark):
    from formloom.plans import forms

    assert "regexp_extract_all" not in plan_of(forms.pdf_page_notes(spark, SF))


def test_cycles_end_when_a_round_ends_no_chain(spark, monkeypatch):
    """Rounds are as many as the longest chain needs, whatever the number of styles."""
    from formloom.operators import records

    stored = []
    monkeypatch.setattr(records, "cut", lambda df: stored.append(1) or cut(df))
    styles = [(10 * k + i, 10 * k + i - 1 if i else (10 * k + 9 if k % 2 else None)) for k in range(400) for i in range(10)]
    got = {r.id: (r.root, r.depth, r.cycle) for r in records.style_chains(spark.createDataFrame(styles, "id long, parent long")).collect()}
    assert all(got[i] == ((None, None, True) if i // 10 % 2 else (i // 10 * 10, i % 10, False)) for i, _ in styles)
    assert len(stored) <= 7


def test_enclosing_sorts_a_part_once(spark):
    from formloom.operators import projection
    from formloom.sources import markup

    nodes = spark.createDataFrame([], markup.NODES)
    plan = plan_of(projection.enclosing(nodes, {k: F.col("local") == k for k in ("p", "tbl", "tr", "tc")}))
    assert "Window" not in plan and plan.count("Sort ") == 1


def test_packages_are_made_by_many_tasks(spark):
    from formloom.sources import packages

    docs = spark.range(8).coalesce(1).select(F.col("id").cast("string").alias("path"), F.lit("docx").alias("format"), F.array(F.lit("x")).alias("lines"))
    assert packages.make_packages(docs).rdd.getNumPartitions() == 4


def test_fan_out_keeps_texts_out_of_exploded_rows(spark):
    from formloom.plans import documents

    plan = documents.paragraph_fan_out_reread(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "explode(sequence(first" in line]
    assert exploded and not any("text#" in line for line in exploded)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Each exchange of these queries has as many tasks as lines call for, not as the session shuffles to."""
    from formloom.operators import lineage
    from formloom.plans import grids, registry

    monkeypatch.setattr(lineage, "ROWS", 1000)
    for f in (registry.repeat_rows_fill, registry.nearest_ancestor, registry.subtree_size, grids.repeat_row_counts):
        dealt = [line for line in plan_of(f(spark, SF)).splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and all(", 6)" in line for line in dealt), f.__name__


def test_python_gets_few_bytes_at_once(spark):
    import pyarrow as pa

    from formloom.plans import registry

    got = registry.composed_text(spark, SF)
    assert "ArrowEvalPython" in plan_of(got) and got.count() > 0
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) <= 5


def test_runs_are_replaced_in_one_sweep(spark):
    """No join, and each table goes to its documents once; values and runs as by hand, for spans over many runs, of no length and at the ends."""
    from formloom.operators import records
    from formloom.plans import registry

    plan = plan_of(registry.multi_run_replacement(spark, SF))
    assert "Join" not in plan and plan.count("Exchange ") <= 3 and "size(regexp_extract_all" not in plan.split("FileScan")[-1]
    text = "".join(chr(97 + k % 26) for k in range(60))
    runs = [(doc, k, text[6 * k : 6 * k + 6]) for doc in (1, 2) for k in range(10)]
    spans = [(1, 0, 2, "A"), (1, 2, 3, "B"), (1, 5, 31, "C"), (1, 33, 33, "D"), (1, 59, 60, ""), (2, 0, 60, "all"), (3, 0, 1, "none")]
    r = records.run_offsets(spark.createDataFrame(runs, "doc int, run_no int, text string"), "doc", "run_no", "text", "text")
    got = {(x.doc, x.run_no): x.text for x in records.replaced_runs(spark.createDataFrame(spans, "doc int, start int, stop int, value string"), r, "doc").collect()}
    want = {(1, 0): "AB" + text[3:5] + "C", (1, 1): "", (1, 2): "", (1, 3): "", (1, 4): "", (1, 5): text[31:33] + "D" + text[33:36], (1, 9): text[54:59]} | {(1, k): text[6 * k : 6 * k + 6] for k in (6, 7, 8)}
    assert got == want | {(2, k): "" if k else "all" for k in range(10)}


def test_node_tree_reads_its_packages_once(spark):
    from formloom.plans import documents

    plan = plan_of(documents.node_tree(spark, SF))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_a_large_part_is_packed_as_it_is_read(monkeypatch):
    """Nodes leave their dicts while a part is still read, and yet none of a part that turns out to be malformed goes on."""
    import pyarrow as pa
    from formloom.sources import markup

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    bodies = [b"<r>" + b"<p a='1'>x&amp;y<b/>z</p>t" * 50 + end for end in (b"</r>", b"</s>")]
    batch = pa.RecordBatch.from_arrays([pa.array(["fine", "torn"]), pa.array(["p", "p"]), pa.array(bodies)], ["path", "part", "body"])
    most = []
    real = markup.ended_nodes
    monkeypatch.setattr(markup, "ROWS", 10)
    monkeypatch.setattr(markup, "ended_nodes", lambda body, pack: real(body, pack and (lambda nodes: (most.append(len(nodes)), pack(nodes)))))
    got = [r for b in markup.node_rows(Docs())(iter([batch])) for r in b.to_pylist()]
    want = markup.nodes_of(bodies[0])
    assert len(most) >= 40 and max(most) < 15
    assert sorted((r["node"], r["local"], r["start"], r["stop"], r["text"]) for r in got if r["path"] == "fine") == [(n["node"], n["local"], n["start"], n["stop"], n["text"]) for n in want]
    assert [(r["error"], r["node"]) for r in got if r["path"] == "torn"] == [("E_INPUT", None)]


def test_completion_reads_an_inventory_once(spark):
    """However many counts there are, an inventory's members, its slots and each slot's members are taken out once."""
    from formloom.plans import binding

    line = [x for x in plan_of(binding.inventory_completion(spark, SF)).splitlines() if "requires-review" in x]
    assert len(line) == 1 and line[0].count("variant_get(") <= 12


def test_rows_of_a_form_are_packed_as_they_come(monkeypatch):
    """No list holds all entries of a large form, names are one object each, and of a file that turns out to be damaged nothing but its error goes on."""
    import pyarrow as pa
    from formloom.sources import pdf

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    fine = pdf.simple_form([(f"n{i}", "Tx") for i in range(200)])
    torn = fine.replace(b"/Type/Catalog", b"/Type/Catalog/X" + b"[" * 62 + b"]" * 62)
    batch = pa.RecordBatch.from_arrays([pa.array(["fine", "torn"]), pa.array([fine, torn + b"" if torn != fine else None])], ["path", "content"])
    whole = [r for b in pdf.entry_rows(Docs())(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(pdf, "ROWS", 50)
    got = list(pdf.entry_rows(Docs())(iter([batch])))
    key = lambda r: tuple(str(x) for x in r.values())
    assert max(b.num_rows for b in got) <= 51 and sorted((r for b in got for r in b.to_pylist()), key=key) == sorted(whole, key=key) and sum(r["path"] == "fine" for r in whole) > 1200
    a, b = (pdf.File(fine).objects[k] for k in (4, 5))
    assert a["FT"] is b["FT"] and all(x is y for x, y in zip(a, b, strict=True))
