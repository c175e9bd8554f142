"""Whether the text of fields may flow on in a word-processing document, asked of the document's own nodes: what surrounds each field is gathered with
one pass over the part and handed to the verdicts of operators.tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.operators import projection as P
from formloom.operators import tables as T
from formloom.operators.lineage import cut
from formloom.sources.containers import WORD

PART = P.PART
#: Order in which the reasons of one field count.
STEPS = ("place", "paragraph", "section", "run", "row", "table", "merged", "tracked", "width", "expansion")


def own(*local: str) -> Column:
    return (F.col("ns") == WORD) & F.col("local").isin(*local)


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(f"w:{name}"))


def switched_on(value: Column) -> Column:
    """Whether a property is on; null for a value that says neither."""
    return F.when(value.isNull() | value.isin("1", "true", "on"), True).when(value.isin("0", "false", "off"), False)


def flow_reasons(nodes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """path, name, reason (the first in the order of STEPS) of every field of the parts of documents (NODES of all parts that may hold fields). lines: path, name of fields whose values
    have line ends."""
    kinds = {k: own(k) for k in ("p", "r", "tc", "tr", "tbl", "body", "pPr", "rPr", "tcPr", "tblPr", "trPr", "tblPrEx")}
    x = cut(P.enclosing(nodes, kinds))  # read many times from here on
    up = x.select(*PART, F.col("node").alias("parent"), F.col("local").alias("up"), F.col("parent").alias("above"))
    places = x.filter(own("p")).select(*PART, "p", "parent", "tc", "tbl", "tr", "body", "start").join(up.drop("above"), [*PART, "parent"], "left")
    tables = x.filter(own("tbl")).select(*PART, "tbl", "parent", F.col("start").alias("t_start"), F.col("stop").alias("t_stop")).join(up.select(*PART, "parent", F.col("up").alias("t_up")), [*PART, "parent"], "left").drop("parent")
    found = P.fields(P.paragraphs(nodes, "docx").filter("text like '%{{%'")).select(*PART, "p", F.explode("fields").alias("f")).select(*PART, "p", F.col("f.name").alias("name"), F.col("f.texts").alias("texts"))
    f = found.join(places, [*PART, "p"]).join(tables, [*PART, "tbl"], "left").withColumn("field", F.monotonically_increasing_id())
    in_table = F.col("tbl").isNotNull()
    out_of_place = (F.col("part") != "word/document.xml") | F.col("body").isNull() | F.when(in_table, (F.col("t_up") != "body") | F.col("tc").isNull() | (F.col("up") != "tc")).otherwise(F.col("up") != "body")
    inner = x.filter(own("tbl")).select(*PART, F.col("parent").alias("held_by")).join(x.filter(own("tc")).select(*PART, F.col("node").alias("held_by"), F.col("tc")), [*PART, "held_by"]).select(*PART, "tc").distinct().withColumn("inner", F.lit(True))
    f = cut(f.join(inner, [*PART, "tc"], "left"))
    reasons = [f.select("field", F.lit("place").alias("step"), T.first_reason((out_of_place, "fixed-container"), (F.col("inner"), "nested-table")).alias("reason"))]

    # properties by what they belong to; a change that is tracked holds old ones and says so by its name
    prop = x.withColumn("no", F.col("node")).withColumn("value", attr("val")).withColumn("on", switched_on(attr("val")))
    kept = [*PART, "no", "local", "value", "on"]

    def risk(step: str, owner: str, box: str, table: bool) -> DataFrame:
        mine = prop.filter(F.col(box).isNotNull() & F.col(owner).isNotNull()).select(*kept, F.col(owner).alias("_of"))
        keys = f.select("field", *PART, F.col(owner).alias("_of"))
        each = keys.join(mine, [*PART, "_of"]).withColumn("in_table", F.lit(table))
        return T.container_risk(each, "field").select("field", F.lit(step).alias("step"), "reason")

    runs = x.filter(own("t")).select(*PART, F.col("node").alias("text"), "r")
    of_runs = f.select("field", *PART, F.explode("texts").alias("text")).join(runs, [*PART, "text"])
    of_run = prop.filter(F.col("rPr").isNotNull() & F.col("r").isNotNull()).select(*kept, "r")
    run_risk = T.container_risk(of_runs.join(of_run, [*PART, "r"]).withColumn("in_table", F.lit(False)), "field")
    reasons += [risk("paragraph", "p", "pPr", False), run_risk.select("field", F.lit("run").alias("step"), "reason")]
    reasons += [T.container_risk(risk_rows(f, prop, kept), "field").select("field", F.lit("table").alias("step"), "reason")]

    # exceptions of rows: the element itself, and what stands in it
    kids = x.filter(F.col("tr").isNotNull())
    exception = kids.filter(own("tblPrEx")).select(*PART, "tr", F.col("node").alias("no"), F.lit("exception").alias("kind"), "local")
    ex_child = kids.join(kids.filter(own("tblPrEx")).select(*PART, F.col("node").alias("parent")), [*PART, "parent"]).select(*PART, "tr", F.col("node").alias("no"), F.lit("inner").alias("kind"), "local")
    children = kids.filter((F.col("parent") == F.col("tr")) & ~own("tblPrEx") & (F.col("local") != "#text")).select(*PART, "tr", F.col("node").alias("no"), F.lit("child").alias("kind"), "local").unionByName(exception).unionByName(ex_child)
    by_row = T.row_exception_verdict(children.withColumn("row", F.struct(*PART, "tr")), "row").select("row.*", "reason")
    reasons.append(f.select("field", *PART, "tr").join(by_row, [*PART, "tr"]).select("field", F.lit("row").alias("step"), "reason"))

    merged = x.filter(own("vMerge", "hMerge") & F.col("tcPr").isNotNull()).select(*PART, "tc").distinct()
    reasons.append(f.join(merged, [*PART, "tc"], "left_semi").select("field", F.lit("merged").alias("step"), F.lit("merged-cell").alias("reason")))
    tracked = x.filter(F.col("local").endswith("PrChange"))
    for owner, box in (("tbl", "tblPr"), ("tc", "tcPr"), ("tr", "trPr")):
        reasons.append(f.join(tracked.filter(F.col(box).isNotNull()).select(*PART, owner).distinct(), [*PART, owner], "left_semi").select("field", F.lit("tracked").alias("step"), F.lit("ambiguous-property").alias("reason")))

    sections = cut(section_of(x))
    reasons.append(f.join(sections, PART, "left").filter(F.col("direction").isNotNull() & ~F.col("direction").isin(*T.HORIZONTAL)).select("field", F.lit("section").alias("step"), F.lit("vertical-text").alias("reason")))
    reasons.append(f.select("field", *PART, "tbl").join(widths(x, sections), [*PART, "tbl"]).select("field", F.lit("width").alias("step"), "reason"))
    if lines is not None:
        of_field = f.join(lines.select("path", "name").distinct(), ["path", "name"])
        marks = of_field.select("field", *PART, "p").join(x.select(*PART, "p", "local", F.col("node").alias("_n"), attr("val").alias("value")), [*PART, "p"])
        reasons.append(T.expansion_verdict(of_field.select("field").withColumn("lines", F.lit(True)), marks.select("field", "local", "value"), "field").select("field", F.lit("expansion").alias("step"), "reason"))
    said = reasons[0]
    for r in reasons[1:]:
        said = said.unionByName(r)
    at = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step"))
    first = said.filter("reason is not null").groupBy("field").agg(F.min(F.struct(at.alias("at"), "reason"))["reason"].alias("reason"))
    each = f.select("field", "path", "name", "part", "p").join(first, "field", "left")
    return each.groupBy("path", "name").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("part", "p", "reason")))["reason"].alias("reason"))


def risk_rows(f: DataFrame, prop: DataFrame, kept: list[str]) -> DataFrame:
    """Properties of a field's table, then of its cell."""
    out = None
    for owner, box in (("tbl", "tblPr"), ("tc", "tcPr")):
        mine = prop.filter(F.col(box).isNotNull()).select(*kept, F.col(owner).alias("_of"))
        each = f.select("field", *PART, F.col(owner).alias("_of")).join(mine, [*PART, "_of"]).withColumn("in_table", F.lit(True))
        out = each if out is None else out.unionByName(each)
    return out


def section_of(x: DataFrame) -> DataFrame:
    """path, part, page, left, right, direction, sound of the last section of a body; documents with several are left to its first field."""
    up = x.filter(own("sectPr")).select(*PART, F.col("node").alias("parent"), F.col("node").alias("sect"))
    inner = x.join(up, [*PART, "parent"])
    number = lambda local, name: F.max(F.when(own(local), attr(name).try_cast("int")))
    odd = F.bool_or(own("bidi") | (own("cols") & (F.coalesce(attr("num"), F.lit("1")) != "1")) | (own("pgMar") & (F.coalesce(attr("gutter"), F.lit("0")) != "0")))
    per = inner.groupBy(*PART, "sect").agg(number("pgSz", "w").alias("page"), number("pgMar", "left").alias("left"), number("pgMar", "right").alias("right"), F.max(F.when(own("textDirection"), attr("val"))).alias("direction"), odd.alias("odd"))
    last = Window.partitionBy(*PART).orderBy(F.desc("sect"))
    one = per.withColumn("n", F.row_number().over(last)).filter("n = 1")
    return one.select(*PART, F.when(~F.col("odd"), F.col("page")).alias("page"), "left", "right", "direction")


def widths(x: DataFrame, sections: DataFrame) -> DataFrame:
    """path, part, tbl, reason of the tables of bodies, by their grids and cells."""
    key = F.struct(*PART, "tbl").alias("table")
    direct = lambda local: x.filter(own(local) & F.col("tblPr").isNotNull() & F.col("tc").isNull())
    one = lambda local, **cols: direct(local).groupBy(*PART, "tbl").agg(*[F.first(c).alias(k) for k, c in cols.items()])
    tables = x.filter(own("tbl")).select(*PART, "tbl")
    for part in (one("tblLayout", layout=attr("type")), one("tblW", width_type=attr("type"), width=attr("w").try_cast("long")), one("jc", align=attr("val")), one("tblInd", indent=attr("w").try_cast("long"))):
        tables = tables.join(part, [*PART, "tbl"], "left")
    tables = tables.join(sections.drop("direction"), PART, "left").select(key, "layout", "width_type", "width", "align", "indent", "page", "left", "right")
    order = Window.partitionBy(*PART, "tbl").orderBy("node")
    grid = x.filter(own("gridCol") & F.col("tc").isNull()).withColumn("no", F.row_number().over(order) - 1).select(key, "no", attr("w").try_cast("long").alias("w"))
    in_row = Window.partitionBy(*PART, "tr").orderBy("node")
    cells = x.filter(own("tc") & (F.col("parent") == F.col("tr"))).withColumn("no", F.row_number().over(in_row) - 1).select(*PART, "tbl", "tr", "tc", "no")
    per_cell = x.filter(F.col("tcPr").isNotNull()).groupBy(*PART, "tc").agg(F.max(F.when(own("gridSpan"), attr("val").try_cast("int"))).alias("span"), F.max(F.when(own("tcW"), attr("w").try_cast("long"))).alias("width"), F.max(F.when(own("tcW"), attr("type"))).alias("width_type"))
    shaped = cells.join(per_cell, [*PART, "tc"], "left").select(key, F.col("tr").alias("row"), "no", F.coalesce("span", F.lit(1)).alias("span"), "width", "width_type")
    return T.fixed_width(tables, grid, shaped).select("table.*", "reason")
