"""The text of paragraphs from rows of nodes (NODES of sources.markup), without a model of the document: one sorted pass keeps which element of each kind
is open at every place, however they nest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from formloom.functions import text as X
from formloom.operators.lineage import spread
from formloom.sources.containers import PARAGRAPH, WORD

PART = ["path", "part"]
SPACE = {"docx": WORD, "hwpx": PARAGRAPH}
#: Stands for an element within a text that has no characters.
OBJECT = "￼"


def enclosing(nodes: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """nodes with a column for each kind: the innermost element of that kind that holds the node (or is it), as a number of a node. kinds: what makes an element one.

    A part's nodes are put in order once, for all kinds; beside each stands what is open there, and nothing but that is held."""
    names, wanted = nodes.columns, list(kinds)
    mask = F.lit(0)
    for i, kind in enumerate(kinds.values()):
        mask = mask + F.when(F.coalesce(kind, F.lit(False)), 1 << i).otherwise(0)
    ordered = nodes.withColumn("_mask", mask)
    ordered = spread(ordered, *PART).sortWithinPartitions(*PART, "start", "node")
    number = nodes.schema["node"].dataType
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in nodes.schema.fields] + [T.StructField(k, number) for k in wanted])
    none = (None,) * len(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            said = []
            for *of, node, start, stop, kind in zip(*[batch.column(c).to_pylist() for c in (*PART, "node", "start", "stop", "_mask")], strict=True):
                if of != key:
                    key, held = of, []
                while held and held[-1][0] <= start:
                    held.pop()
                if kind:
                    outer = held[-1][1] if held else none
                    held.append((stop, tuple(node if kind >> i & 1 else o for i, o in enumerate(outer))))
                said.append(held[-1][1] if held else none)
            own = batch.schema.field("node").type
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array([s[i] for s in said], own) for i in range(len(wanted))]], [*names, *wanted])

    return ordered.mapInArrow(run, schema)


def pieces(nodes: DataFrame, form: str) -> DataFrame:
    """path, part, p, t, node, said, safe: what each text and break adds to its paragraph. p and t: paragraph and text element; safe: whether it can be written
    again as it was read."""
    space = SPACE[form]
    own = lambda *local: (F.col("ns") == space) & F.col("local").isin(*local)
    held = enclosing(nodes, {"p": own("p"), "t": own("t"), "r": own("r")})
    up = nodes.select(*PART, F.col("node").alias("parent"), F.col("ns").alias("up_ns"), F.col("local").alias("up"))
    x = held.join(up, [*PART, "parent"], "left").filter("p is not null")
    in_text = (F.col("up_ns") == space) & (F.col("up") == "t")
    is_text = F.col("local") == "#text"
    if form == "docx":
        # a text outside of a run isn't shown; breaks and tabs are children of runs, and what a text element holds beside text isn't text
        in_run = (F.col("up_ns") == space) & (F.col("up") == "r")
        said = F.when(is_text & in_text & F.col("r").isNotNull(), F.col("text")).when(own("br", "cr") & in_run, "\n").when(own("tab") & in_run, "\t").when(own("t") & in_run, "")
        safe = F.lit(True)
    else:
        said = F.when(is_text & in_text, F.col("text")).when(own("lineBreak") & in_text, "\n").when(own("tab") & in_text, "\t").when(in_text, OBJECT).when(own("t"), "")
        safe = ~in_text | is_text | own("lineBreak", "tab")
    return x.withColumn("said", said).withColumn("safe", safe).filter("said is not null").select(*PART, "p", F.when(in_text | own("t"), F.col("t")).alias("t"), "node", "said", "safe")


def paragraphs(nodes: DataFrame, form: str) -> DataFrame:
    """path, part, p, text, runs of each paragraph; runs: t (number of the text element), start, stop, safe, in the order of the text. A paragraph without text has
    the empty text and no runs."""
    order = Window.partitionBy(*PART, "p").orderBy("node")
    x = pieces(nodes, form).withColumn("stop", F.sum(F.length("said")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("start", (F.col("stop") - F.length("said")).cast("int"))
    run = x.groupBy(*PART, "p", "t").agg(F.min("node").alias("node"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.bool_and("safe").alias("safe"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "said"))), lambda s: s["said"]), "").alias("said"))
    # breaks between texts have no text element: they are pieces of their own
    loose = x.filter("t is null").select(*PART, "p", F.col("t").cast("int").alias("t"), "node", "start", "stop", "safe", "said")
    each = run.filter("t is not null").select(*loose.columns).unionByName(loose)
    listed = F.array_sort(F.collect_list(F.struct("node", "said", "t", "start", "stop", "safe")))
    own = each.groupBy(*PART, "p").agg(listed.alias("all"))
    runs = F.transform(F.filter("all", lambda s: s["t"].isNotNull()), lambda s: F.struct(s["t"].alias("t"), s["start"].alias("start"), s["stop"].alias("stop"), s["safe"].alias("safe")))
    own = own.select(*PART, "p", F.array_join(F.transform("all", lambda s: s["said"]), "").alias("text"), runs.alias("runs"))
    every = nodes.filter((F.col("ns") == SPACE[form]) & (F.col("local") == "p")).select(*PART, F.col("node").alias("p"))
    empty = F.array().cast(own.schema["runs"].dataType)
    return every.join(own, [*PART, "p"], "left").select(*PART, "p", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("runs", empty).alias("runs"))


def fields(of: DataFrame) -> DataFrame:
    """of (paragraphs) with fields: name, start, stop of each marker, the text elements it lies in, and reason where it can't be replaced: an illegal name, or an
    element in it that has no characters."""
    spans = X.spans(F.col("text"))
    touched = lambda s: F.filter("runs", lambda r: (r["stop"] > s["start"]) & (r["start"] < s["stop"]))

    def field(s: Column) -> Column:
        runs = touched(s)
        reason = F.when(~X.valid_name(s["name"]), "illegal-name").when((F.size(runs) == 0) | F.exists(runs, lambda r: ~r["safe"]), "unsafe-location")
        return F.struct(s["name"].alias("name"), s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"), F.transform(runs, lambda r: r["t"]).alias("texts"), reason.alias("reason"))

    return of.withColumn("fields", F.transform(spans, field))
