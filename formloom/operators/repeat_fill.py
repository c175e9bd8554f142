"""Filling a table whose rows repeat: tables of sections are rows (TABLES of sources.sections), the template's rows are judged, each record takes one of them, and the part is
copied row by row with its edits in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.functions import text as X
from formloom.operators import projection as P
from formloom.operators import splicing
from formloom.operators import tables as T
from formloom.operators.lineage import cut, large, spread
from formloom.operators.splicing import step
from formloom.sources.containers import write_archive
from formloom.sources.sections import table_rows

PART = P.PART
#: What a table must say of itself so that rows can be added to it.
TABLE, SIZE = {"textWrap": "TOP_AND_BOTTOM", "pageBreak": "CELL", "noAdjust": "0"}, {"widthRelTo": "ABSOLUTE", "heightRelTo": "ABSOLUTE", "protect": "0"}


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def says(of: str, wanted: dict[str, str]) -> Column:
    """Whether a map of attributes says all of this."""
    return F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in wanted.items()]), lambda e: F.coalesce(F.try_element_at(of, e["k"]) == e["v"], F.lit(False)))


def region_tables(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """The tables (TABLES) that regions (path, part, table_id, first, last, prototype, headers, columns: name and column; one a document) name, with their regions."""
    return large(with_regions(tables, regions).filter("named").drop("named"))


def with_regions(tables: DataFrame, regions: DataFrame, how: str = "inner") -> DataFrame:
    """Tables beside their document's region, dealt by the document; named: whether it is the region's table."""
    asked = regions.withColumnsRenamed({"part": "_part", "table_id": "_id"})
    both = large(spread(asked, "path")).join(large(spread(tables, "path")), "path", how)
    return both.withColumn("named", F.coalesce((F.col("part") == F.col("_part")) & (F.col("table_id") == F.col("_id")), F.lit(False))).drop("_part", "_id")


def cells_of(tables: DataFrame, *kept: str) -> DataFrame:
    """kept, row, no and text of each cell of the tables."""
    rows = tables.select(*kept, F.posexplode("rows").alias("row", "tr"))
    return rows.select(*kept, "row", F.posexplode("tr.cells").alias("no", "cell")).select(*kept, "row", "no", "cell.text")


def verdicts(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """path, reason of the regions: the table, the range of its rows, its anchor, then its rows and sizes. What is looked at of a table is one row; once that is dealt by the document, no step
    shuffles."""
    number = lambda m, k: F.try_element_at(m, F.lit(k)).try_cast("int")
    trs = F.size("rows")
    ok = (F.col("sz.n") == 1) & (F.col("pos.n") == 1) & says("attrs", TABLE) & says("sz.attrs", SIZE) & says("pos.attrs", T.ANCHOR) & F.coalesce(F.try_element_at("pos.attrs", F.lit("treatAsChar")).isin("0", "1"), F.lit(False)) & (F.col("up") == "sec") & ~F.col("nested")
    wanted = ("row_addr", "col_addr", "row_span", "col_span", "width", "height", "text")
    cells = F.flatten(F.transform("rows", lambda r, i: F.transform(r["cells"], lambda c, k: F.struct(i.alias("row"), k.alias("no"), *[c[w].alias(w) for w in wanted]))))
    looked = tables.select(*PART, "table_id", "table", F.when((trs > 0) & (number("attrs", "rowCnt") == trs), trs).alias("rows"), number("attrs", "colCnt").alias("table_columns"), number("sz.attrs", "width").alias("table_width"), number("sz.attrs", "height").alias("table_height"), F.coalesce(ok, F.lit(False)).alias("anchored"), cells.alias("cells"))
    asked = regions.select(*PART, "table_id", F.col("first").alias("start"), F.col("last").alias("stop"), "prototype", F.col("last").alias("insert_before"), "headers", "columns")
    x = with_regions(looked, asked, "left").withColumnRenamed("path", "region")
    x = x.withColumn("found", F.count_if("named").over(Window.partitionBy("region"))).filter("named or found = 0").withColumn("cells", F.when(F.col("named"), F.col("cells")))
    early = F.coalesce(T.early_reason(), F.when(~F.col("anchored"), "unsupported-anchor"))
    x = x.select("region", "start", "stop", F.col("columns").alias("names"), early.alias("early"), "table_columns", "table_width", "table_height", F.inline_outer("cells"))
    return T.cell_reasons(x).withColumnRenamed("region", "path")


def escaped(value: Column, prefix: Column) -> Column:
    """A value as content of a text element, its line ends and tabs as elements."""
    out = X.newlines(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in (("\n", "lineBreak"), ("\t", "tab")):
        out = F.replace(out, F.lit(a), F.concat(F.lit("<"), prefix, F.lit(f"{b}/>")))
    return out


def row_steps() -> Column:
    """The segment that a row of the plan is, with its edits. Of rows of the plan beside the template's row (tr)."""
    segment, none = F.col("segment"), F.array().cast(f"array<{splicing.STEP}>")

    def edits(c: Column, no: Column) -> Column:
        shift = step(segment, 1, c["addr_start"], c["addr_end"], attributes=F.create_map(F.lit("rowAddr"), F.col("addr").cast("string")))
        # the rows before the body repeat on each page; of a single record's row the last row's border
        border = F.get("last_borders", no)
        looks = F.when(F.col("row") < F.col("first"), F.create_map(F.lit("header"), F.lit("1"))).when((F.col("n") == 1) & F.col("record").isNotNull() & (border != c["border"]), F.create_map(F.lit("borderFillIDRef"), border))
        tag = step(segment, 1, c["start"], c["open_end"], attributes=looks)
        # a cell of the body has one paragraph of one run, which holds one text or none
        value = F.try_element_at("values", F.get("columns", no)["name"])
        nothing = F.array(F.lit(None).cast("struct<start:int,stop:int,name:string>"))
        texts = F.flatten(F.transform(c["runs"], lambda r: F.transform(F.when(F.size(r["texts"]) > 0, r["texts"]).otherwise(nothing), lambda t: written(r, t, value))))
        dropped = F.transform(c["lines"], lambda e: step(segment, 1, e["start"], e["stop"], F.lit(b"")))
        return F.concat(F.when(c["addr_start"].isNotNull(), F.array(shift)).otherwise(none), F.when(looks.isNotNull(), F.array(tag)).otherwise(none), F.when(F.col("record").isNotNull(), F.concat(texts, dropped)).otherwise(none))

    def written(r: Column, t: Column, value: Column) -> Column:
        prefix = F.regexp_extract(r["name"], r"\A(.*:)?", 0)
        said = escaped(value, prefix)
        inner = F.when(t.isNull(), F.concat(F.lit("<"), prefix, F.lit("t>"), said, F.lit("</"), prefix, F.lit("t>"))).otherwise(said)
        return step(segment, 1, F.coalesce(t["start"], r["start"]), F.coalesce(t["stop"], r["stop"]), inner.cast("binary"), content_of=F.coalesce(t["name"], r["name"]))

    return F.concat(F.array(step(segment, 0, F.col("tr.start"), F.col("tr.stop"))), F.flatten(F.transform("tr.cells", edits)))


def table_steps() -> Column:
    """What stands before and after the rows of a table (with its region and n records), and what its own tags say from now on."""
    first, stop, n = F.col("first"), F.col("last"), F.col("n")
    count = first + n + F.size("rows") - stop - 1
    last = (count + 1).cast("int")
    highest = F.transform("rows", lambda r: F.array_max(F.transform(r["cells"], lambda c: c["height"])))
    added = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    records = lambda h: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.get(h, T.source_row(i, n, first, stop, F.col("prototype"))))
    height = X.let(highest, lambda h: added(F.slice(h, F.lit(1), first)) + added(records(h)) + added(F.slice(h, stop + 2, F.size(h))))
    tag = lambda start, end, **said: step(F.lit(0), 1, start, end, attributes=F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v.cast("string"))]))
    begin, end = F.get("rows", F.lit(0))["start"], F.element_at("rows", -1)["stop"]
    own = tag(F.col("start"), F.col("open_end"), rowCnt=count, pageBreak=F.lit("TABLE"), repeatHeader=F.lit("1"))
    sizes = tag(F.col("sz.start"), F.col("sz.open_end"), height=height), tag(F.col("pos.start"), F.col("pos.open_end"), treatAsChar=F.lit("0"))
    # what the paragraph around the table was laid out as
    stale = F.transform("around", lambda e: step(F.when(e["start"] < begin, 0).otherwise(last), 1, e["start"], e["stop"], F.lit(b"")))
    return F.concat(F.array(step(F.lit(0), 0, F.lit(0), begin), step(last, 0, end, F.col("size")), own, *sizes), stale)


def repeat_plan(tables: DataFrame, records: DataFrame) -> DataFrame:
    """Which row of the template stands where: those before the body, one for each record, those after. tables: with their regions and n, the number of records."""
    of = tables.select(*PART, "table", "n", "first", "last", "prototype", F.size("rows").alias("trs"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    spot = lambda row, addr: [*PART, "table", (addr + 1).cast("int").alias("segment"), row.cast("int").alias("row"), addr.cast("int").alias("addr")]
    row, first, last = F.col("row"), F.col("first"), F.col("last")
    source = T.source_row(F.col("record"), F.col("n"), first, last, F.col("prototype"))
    body = large(records).join(large(of), "path").select(*spot(source, first + F.col("record")), "record", "values")
    kept = of.withColumn("row", F.explode(F.filter(F.sequence(F.lit(0), F.col("trs") - 1), lambda i: ~i.between(first, last))))
    kept = kept.select(*spot(row, F.when(row < first, row).otherwise(first + F.col("n") + row - last - 1)), null("int", "record"), null("map<string,string>", "values"))
    return body.unionByName(kept)


def border_verdict(headers: DataFrame, tables: DataFrame, filled: DataFrame) -> DataFrame:
    """path, reason of documents whose cells have a border that the header (NODES) doesn't define exactly once, or whose single record would take the last row's border though it differs in
    more than the bottom line. Documents without definitions aren't judged. filled: those of the tables that get records, with their number n."""
    x = cut(P.enclosing(headers, {"bottom": F.col("local") == "bottomBorder"}))
    fills = x.filter("local = 'borderFill'").select("path", "part", "node", attr("id").alias("border"))
    hashes = T.subtree_hashes(x.filter("bottom is null").drop("bottom")).select("path", "part", "node", F.struct("h1", "h2").alias("looks"))
    defined = cut(fills.join(hashes, ["path", "part", "node"]).groupBy("path", "border").agg(F.count("*").alias("times"), F.first("looks").alias("looks")))
    judged = defined.select("path").distinct()
    borders = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["border"]))))
    cells = large(tables.select("path", F.explode(borders).alias("border")).join(judged, "path", "left_semi"))
    unknown = cells.join(defined, ["path", "border"], "left").filter("times is null or times > 1").select("path", F.lit("ambiguous-style").alias("reason"))
    of = lambda row: F.transform(F.get("rows", F.col(row))["cells"], lambda c: c["border"])
    pairs = F.arrays_zip(of("first").alias("border"), of("last").alias("border2"))
    both = large(filled.filter("n = 1").select("path", F.inline(pairs)).filter("border != border2").join(judged, "path", "left_semi"))
    both = both.join(defined.select("path", "border", "looks"), ["path", "border"]).join(defined.select("path", F.col("border").alias("border2"), F.col("looks").alias("looks2")), ["path", "border2"])
    other = both.filter("looks != looks2").select("path", F.lit("incompatible-single-row-border").alias("reason"))
    return unknown.unionByName(other).groupBy("path").agg(F.min("reason").alias("reason"))


def filled_parts(nodes: DataFrame, bodies: DataFrame, regions: DataFrame, records: DataFrame, headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """filled_tables of the parts (path, part, body) that nodes are of."""
    mine = bodies.join(nodes.select(*PART).distinct(), PART, "left_semi")
    return filled_tables(table_rows(mine), bodies, regions, records, headers)


def filled_tables(tables: DataFrame, bodies: DataFrame, regions: DataFrame, records: DataFrame, headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Filled parts (path, part, body, error) and verdicts (path, reason) of regions (path, part, table_id, first, last, prototype, headers, columns: name and column) of tables (TABLES) and
    their records (path, record from 0, values). Regions with a reason, and those without records, give no part. headers: nodes of the parts that define borders."""
    of = cut(region_tables(regions, tables))
    judged = cut(verdicts(regions, of.select(*tables.columns)))
    n = large(records).groupBy("path").agg(F.count("*").alias("n"))
    filled = large(large(spread(of, "path").join(judged.filter("reason is null"), "path", "left_semi")).join(large(n), "path"))
    if headers is not None:
        borders = cut(border_verdict(headers, of, filled))
        judged = judged.join(borders.withColumnRenamed("reason", "border_reason"), "path", "left").select("path", F.coalesce("reason", "border_reason").alias("reason"))
        filled = large(filled.join(borders.select("path"), "path", "left_anti"))
    filled = cut(filled)
    borders = F.transform(F.get("rows", F.col("last"))["cells"], lambda c: c["border"])
    template = filled.select(*PART, "table", "first", "n", "columns", borders.alias("last_borders"), F.posexplode("rows").alias("row", "tr"))
    by = [*PART, "table", "row"]
    rows = large(spread(repeat_plan(filled, records), *by)).join(large(spread(template, *by)), by)
    script = rows.select(*PART, F.inline(row_steps())).unionByName(filled.select(*PART, F.inline(table_steps())))
    mine = large(bodies.join(filled.select(*PART).distinct(), PART, "left_semi"))
    return splicing.run_script(mine, script), judged


def repacked(parts: DataFrame, new: DataFrame) -> DataFrame:
    """path, content of packages of parts (path, part, body), some of them new. A package is written in one task, part after part."""
    changed = large(new).filter("error is null").select(*PART, F.col("body").alias("new"))
    whole_ = parts.join(changed, PART, "left").select("path", "part", F.coalesce("new", "body").alias("body"))
    # dealt by number before the join (a semi join would be pushed before that): behind it, the same dealing would be left out, and few bytes would go to few tasks
    whole_ = spread(whole_, "path").join(large(changed.select("path").distinct()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, []
        for batch in batches:
            for p, part, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != path and held:
                    yield packed(path, held)
                    held = []
                path = p
                held.append((part, body))
        if held:
            yield packed(path, held)

    def packed(path: str, held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([write_archive(held)], pa.binary())], ["path", "content"])

    return whole_.sortWithinPartitions("path", "part").mapInArrow(run, "path string, content binary")
