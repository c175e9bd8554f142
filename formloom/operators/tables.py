"""Tables in documents: regions whose rows repeat, grids, and whether a field's surroundings let its text flow. Input are rows of cells, rows,
columns and properties; each operator gives one verdict a region or field, the first that holds in a fixed order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.operators.lineage import large

# Reasons come from the formats' own checks, and the properties that make a container unfit.
FITTING, TEXT_FIT = ("fitText",), ("tcFitText", "noWrap")
HORIZONTAL = ("lrTb", "tb")
NO_EXPANSION = ("numPr", "outlineLvl", "sectPr", "framePr", "pPrChange", "rPrChange", "ins", "del", "moveFrom", "moveTo")
ROW_EXCEPTIONS = ("shd", "tblBorders", "tblLook")
ANCHOR = {"flowWithText": "1", "allowOverlap": "0", "holdAnchorAndSO": "0", "vertRelTo": "PARA", "horzRelTo": "COLUMN", "vertAlign": "TOP", "horzAlign": "LEFT", "vertOffset": "0", "horzOffset": "0"}


def first_reason(*steps: tuple[Column, str]) -> Column:
    out = None
    for holds, reason in steps:
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out


def column_cursor(cells: DataFrame, doc: str, row: str, no: str, span: str) -> DataFrame:
    """cells with col, the first column of each: spans to its left, added up."""
    w = Window.partitionBy(doc, row).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum(span).over(w), F.lit(0)).cast("int"))


def row_sums(cells: DataFrame, doc: str, row: str) -> DataFrame:
    """doc, row, width, columns, height of rows of cells (width, span, height)."""
    return cells.groupBy(doc, row).agg(F.sum("width").cast("long").alias("width"), F.sum("span").cast("long").alias("columns"), F.max("height").cast("long").alias("height"))


def region_verdict(regions: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """region, reason of regions (region, doc, table_id, start, stop, prototype, insert_before, headers, columns) in tables (doc, table_id, rows,
    columns, width, height) of cells (doc, table_id, row, no, row_addr, col_addr, row_span, col_span, width, height, text).

    In order: the table is missing or ambiguous; the range of rows (a header of at least one row before it, all its rows named; at least three body
    rows, the prototype strictly inside; new rows go in before the last; columns one by one); a cell's address or span; a body row that
    holds more than its markers; widths of rows; heights of all rows."""
    keys = ["doc", "table_id"]
    regions, tables, cells = large(regions), large(tables), large(cells)
    n = regions.select("region", *keys).join(tables.groupBy(*keys).agg(F.count("*").alias("found"), F.first("rows").alias("rows"), F.first("columns").alias("table_columns"), F.first("width").alias("table_width"), F.first("height").alias("table_height")), keys, "left")
    own = large(regions.join(n.drop(*keys), "region"))
    of = own.select("region", *keys, "start", "stop", F.col("columns").alias("names"), early_reason().alias("early"), "table_columns", "table_width", "table_height")
    return cell_reasons(of.join(cells, keys, "left"))


def early_reason() -> Column:
    """What a region and its table say before any cell is looked at. Columns: found (how many tables; null or 0: none), rows, table_columns of the table; start, stop, prototype, insert_before, headers,
    columns of the region."""
    start, stop = F.col("start"), F.col("stop")
    numbers = F.sequence(F.lit(0), F.greatest(F.size("columns") - 1, F.lit(0)))
    rows_ok = (start >= 1) & (stop < F.col("rows")) & (stop - start >= 2) & (start < F.col("prototype")) & (F.col("prototype") < stop) & (F.col("insert_before") == stop)
    heads_ok = F.col("headers") == F.when(start >= 1, F.sequence(F.lit(0), start - 1)).otherwise(F.array().cast("array<int>"))
    columns_ok = (F.size("columns") == F.col("table_columns")) & (F.transform("columns", lambda c: c["column"]) == numbers)
    return first_reason((F.coalesce("found", F.lit(0)) == 0, "missing-table"), (F.col("found") > 1, "ambiguous-table"), (~F.coalesce(rows_ok & heads_ok & columns_ok, F.lit(False)), "invalid-row-range"))


def cell_reasons(cells: DataFrame) -> DataFrame:
    """region, reason of regions by their cells: rows of cells with what their region says (early, which goes first; start, stop, names, table_columns, table_width, table_height), or one row
    without a cell. All steps group by the region, so cells that are dealt by it stay where they are."""
    placed = column_cursor(cells.withColumn("span", F.col("col_span")), "region", "row", "no", "span")
    body = F.col("row").between(F.col("start"), F.col("stop"))
    marker = F.concat(F.lit("{{"), F.get("names", F.col("no"))["name"], F.lit("}}"))
    text = F.when(F.col("row") == F.col("start"), marker).otherwise("")
    shape = ~((F.col("row_addr") == F.col("row")) & (F.col("col_addr") == F.col("col")) & (F.col("row_span") == 1) & (F.col("col_span") > 0) & (F.col("width") > 0) & (F.col("height") > 0)) | (body & (F.col("col_span") != 1))
    same = [F.first(c).alias(c) for c in ("early", "table_width", "table_columns", "table_height")]
    per_row = placed.groupBy("region", "row").agg(F.bool_or(F.coalesce(shape, F.lit(True))).alias("shape"), F.bool_or(body & (F.coalesce("text", F.lit("")) != text)).alias("filled"), F.sum("width").alias("w"), F.sum("col_span").alias("c"), F.max("height").alias("h"), *same)
    per = per_row.groupBy("region").agg(F.bool_or("shape").alias("shape"), F.bool_or("filled").alias("filled"), F.bool_or((F.col("w") != F.col("table_width")) | (F.col("c") != F.col("table_columns"))).alias("wide"), F.sum("h").alias("h"), *same)
    late = first_reason((F.col("shape"), "unsupported-row-shape"), (F.col("filled"), "nonempty-repeat-row"), (F.col("wide"), "inconsistent-column-width"), (F.col("h") != F.col("table_height"), "inconsistent-table-height"))
    return per.select("region", F.coalesce("early", late).alias("reason"))


def output_rows(records: DataFrame, region: str) -> DataFrame:
    """region, record, source of records (region, n, start, stop, prototype): the row of the template that each record takes. The first
    takes the first, the last the last, those between the rows in turn and then the prototype again and again."""
    each = records.withColumn("record", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return each.select(region, "record", source_row(F.col("record"), *map(F.col, ("n", "start", "stop", "prototype"))).alias("source"))


def source_row(record: Column, n: Column, start: Column, stop: Column, prototype: Column) -> Column:
    """The row of the template that one of n records takes."""
    inner = F.when(start + record < stop, start + record).otherwise(prototype)
    return F.when(record == 0, start).when(record == n - 1, stop).otherwise(inner).cast("int")


def repeat_counts(rows: DataFrame, region: str, body: DataFrame) -> DataFrame:
    """region, reused, cloned, removed of the rows that records take, for body (region, start, stop)."""
    n = rows.groupBy(region).agg(F.count("*").alias("n"), F.countDistinct("source").alias("reused"))
    size = (F.col("stop") - F.col("start") + 1).cast("long")
    return n.join(body, region).select(region, "reused", (F.col("n") - F.col("reused")).alias("cloned"), (size - F.col("reused")).alias("removed"))


def outside_region(occurrences: DataFrame, regions: DataFrame) -> DataFrame:
    """Occurrences (doc, table_id, row, name) that aren't in a body row of a region, and one field of type rows for each region."""
    body = regions.select("doc", "table_id", F.explode(F.sequence("start", "stop")).alias("row"))
    left = occurrences.join(body, ["doc", "table_id", "row"], "left_anti").select("doc", "name", F.lit("text").alias("type"))
    return left.unionByName(regions.select("doc", F.col("name"), F.lit("rows").alias("type")))


def one_page_verdict(targets: DataFrame, laid: DataFrame) -> DataFrame:
    """field, row, pages, reason of rows (doc, field, row, repeated) over laid-out cells (doc, row, page): each stands on exactly one page."""
    n = laid.groupBy("doc", "row").agg(F.countDistinct("page").alias("pages"))
    x = targets.join(n, ["doc", "row"], "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return x.select("doc", "field", "row", "pages", F.when(F.col("pages") != 1, F.when(F.col("repeated"), "record-requires-continuation").otherwise("repeat-profile-required")).alias("reason"))


def cell_layout_verdict(cells: DataFrame, rectangles: DataFrame, runs: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """doc, row, col, reason of cells (doc, row, col, text) with their rectangles (doc, row, col, x, y, w, h, page_w, page_h) and text runs
    (doc, row, col, no, text, x, y, w, h): no rectangle, outside the page, text outside its cell, or other text than the cell's."""
    key = ["doc", "row", "col"]
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    within = lambda x, y, w, h, X, Y, W, H: (x >= X - tolerance) & (y >= Y - tolerance) & (x + w <= X + W + tolerance) & (y + h <= Y + H + tolerance)
    r = rectangles.select(*key, *[F.col(c).alias(f"r{c}") for c in ("x", "y", "w", "h")], "page_w", "page_h")
    t = runs.join(r, key, "left")
    inside = within(*[F.col(c) for c in ("x", "y", "w", "h", "rx", "ry", "rw", "rh")])
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s["text"]), "")
    per = t.groupBy(*key).agg(F.bool_or((bare(F.col("text")) != "") & ~inside).alias("out"), shown.alias("shown"))
    both = cells.join(r, key, "left").join(per, key, "left")
    page = within(F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh"), F.lit(0), F.lit(0), F.col("page_w"), F.col("page_h"))
    reason = first_reason((F.col("rx").isNull(), "missing-cell-layout"), (~page, "table-outside-page"), (F.col("out"), "text-outside-cell"), (bare(F.coalesce("shown", F.lit(""))) != bare(F.col("text")), "missing-cell-text"))
    return both.select(*key, reason.alias("reason"))


def container_risk(properties: DataFrame, doc: str) -> DataFrame:
    """doc, reason of the properties (local, value, on, in_table) around each field: text that is squeezed, vertical, or in a frame of its own.
    on: whether the property is switched on; null if that can't be told."""
    local, on = F.col("local"), F.col("on")
    reason = first_reason((local.isin(*TEXT_FIT) & on.isNull(), "ambiguous-property"), (local.isin(*FITTING) | (local.isin(*TEXT_FIT) & on), "text-compression"), ((local == "textDirection") & ~F.coalesce(F.col("value").isin(*HORIZONTAL), F.lit(False)), "vertical-text"), ((local == "framePr") | (F.col("in_table") & (local == "tblpPr")), "fixed-container"))
    return properties.groupBy(doc).agg(F.min(F.when(reason.isNotNull(), F.struct("no", reason.alias("reason"))))["reason"].alias("reason"))


def expansion_verdict(paragraphs: DataFrame, marks: DataFrame, doc: str) -> DataFrame:
    """doc, reason of paragraphs that a value with line ends would split: not if they or their styles (marks: doc, local, value) number, outline, end a
    section, hold tracked changes or are headings."""
    heading = (F.col("local").isin("style", "name")) & F.coalesce(F.col("value").rlike(r"(?i)\Aheading\s*\d"), F.lit(False))
    bad = marks.filter(F.col("local").isin(*NO_EXPANSION) | heading).select(doc).distinct().withColumn("bad", F.lit(True))
    return paragraphs.join(bad, doc, "left").select(doc, F.when(F.col("lines") & F.col("bad"), "unsupported-paragraph-expansion").alias("reason"))


def row_exception_verdict(children: DataFrame, row: str) -> DataFrame:
    """row, reason of rows with their children (no, kind, local): an exception must come first and change the looks only."""
    is_first = F.min(F.when(F.col("kind") == "exception", F.col("no"))) > F.min("no")
    other = F.bool_or((F.col("kind") == "inner") & ~F.col("local").isin(*ROW_EXCEPTIONS))
    n = children.groupBy(row).agg(F.count_if(F.col("kind") == "exception").alias("n"), is_first.alias("late"), other.alias("other"))
    return n.select(row, first_reason((F.col("n") > 1, "ambiguous-property"), ((F.col("n") == 1) & (F.col("late") | F.col("other")), "unsupported-row-exception")).alias("reason"))


def fixed_width(tables: DataFrame, grid: DataFrame, cells: DataFrame) -> DataFrame:
    """table, total, reason of tables (table, layout, width_type, width, align, indent, page, left, right) with grid columns (table, no, w) and cells
    (table, row, no, span, width, width_type): what the table's width is fixed at. A fixed layout needs nothing (null, null).

    In order: a layout that is neither; no grid, or a column without a width; a row that doesn't fill the grid; a cell as wide as its columns; the table as
    wide as its grid; its alignment; whether it lies within the text."""
    g = grid.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("no", "w"))).alias("g"), F.bool_or(F.col("w").isNull() | (F.col("w") < 1)).alias("bad_grid"), F.sum("w").alias("total"))
    placed = column_cursor(cells, "table", "row", "no", "span").join(g.select("table", "g"), "table")
    sums = F.aggregate(F.slice("g", F.col("col") + 1, F.greatest("span", F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    off = (F.col("span") < 1) | (F.col("col") + F.col("span") > F.size("g")) | (F.col("width_type") != "dxa") | (F.col("width") != sums)
    per_row = placed.groupBy("table", "row").agg(F.bool_or(F.coalesce(off, F.lit(True))).alias("off"), (F.sum("span") != F.first(F.size("g"))).alias("short"))
    per = per_row.groupBy("table").agg(F.bool_or("off").alias("off"), F.bool_or("short").alias("short"))
    x = tables.join(g, "table", "left").join(per, "table", "left")
    own = ((F.col("width_type") == "auto") & (F.col("width") == 0)) | ((F.col("width_type") == "dxa") & (F.col("width") == F.col("total")))
    reason = first_reason(
        (F.col("layout").isNotNull() & (F.col("layout") != "autofit"), "ambiguous-layout"), (F.col("total").isNull() | F.col("bad_grid") | F.col("off").isNull(), "ambiguous-grid"), (F.col("off"), "inconsistent-cell-width"), (F.col("short"), "ambiguous-grid"),
        (F.col("width_type").isNotNull() & ~own, "inconsistent-table-width"), (F.col("align").isNotNull() & ~F.col("align").isin("left", "start"), "unsupported-horizontal-layout"), (F.col("page").isNull() | F.col("left").isNull() | F.col("right").isNull(), "ambiguous-section"),
        (F.col("total") + F.coalesce("indent", F.lit(0)) > F.col("page") - F.col("left") - F.col("right"), "table-outside-body"),
    )
    fixed = F.coalesce(F.col("layout") == "fixed", F.lit(False))
    reason = F.when(~fixed, reason)
    return x.select("table", F.when(~fixed & reason.isNull(), F.col("total").cast("long")).alias("total"), reason.alias("reason"))


def flow_verdict(fields: DataFrame) -> DataFrame:
    """field, reason, changes of fields with what surrounds them in one row (in_table, nested, in_list, row_span, direction, wrap, protect, text_wrap,
    page_break, no_adjust, width_rel, height_rel, size_protect, anchor map, inline, top_level, section_directions, keep_lines, keep_next, style_found)."""
    c = F.col
    table = c("in_table")
    anchored = F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in ANCHOR.items()]), lambda e: F.coalesce(F.try_element_at("anchor", e["k"]) == e["v"], F.lit(False)))
    reason = first_reason(
        (table & c("nested"), "nested-table"), (table & (~c("in_list") | (c("row_span") != "1")), "merged-cell"), (table & ((c("direction") != "HORIZONTAL") | (c("wrap") != "BREAK")), "vertical-text"), (table & (c("protect") != "0"), "fixed-container"),
        (table & ((c("text_wrap") != "TOP_AND_BOTTOM") | (c("page_break") != "CELL") | (c("no_adjust") != "0") | (c("width_rel") != "ABSOLUTE") | (c("height_rel") != "ABSOLUTE") | (c("size_protect") != "0")), "fixed-container"),
        (table & (~anchored | ~c("inline").isin("0", "1") | ~c("top_level")), "unsupported-anchor"), (~table & ~c("top_level"), "fixed-container"), (F.exists("section_directions", lambda x: x != "HORIZONTAL"), "vertical-text"), (~c("style_found") | ~c("keep_lines").isin("0", "1") | ~c("keep_next").isin("0", "1"), "ambiguous-style"),
    )
    changes = F.array_compact(F.array(F.lit("refresh-line-layout"), F.when(table, F.when(c("inline") == "1", "inline-table-to-flow").otherwise("existing-flow-table")), F.when((c("keep_lines") == "1") | (c("keep_next") == "1"), "clone-paragraph-flow-style")))
    return fields.select("field", reason.alias("reason"), F.when(reason.isNull(), changes).alias("changes"))


def declared_count(items: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """owner, reason: ids that aren't numbers, aren't distinct, or aren't as many as declared (n)."""
    n = items.groupBy(owner).agg(F.count("*").alias("found"), F.countDistinct("id").alias("distinct"), F.bool_or(~F.coalesce(F.col("id").rlike(r"\A\d+\z"), F.lit(False))).alias("odd"))
    x = owners.join(n, owner, "left")
    bad = F.coalesce("odd", F.lit(False)) | (F.coalesce("found", F.lit(0)) != F.coalesce("distinct", F.lit(0))) | (F.coalesce("found", F.lit(0)) != F.col("n"))
    return x.select(owner, F.when(bad, "ambiguous-style").alias("reason"))


def subtree_signatures(nodes: DataFrame, ignore: tuple[str, ...] = ("id",)) -> DataFrame:
    """path, node, signature of elements (path, node, depth, ns, local, attrs; nodes numbered in the order of the document): equal for equal subtrees,
    whatever the ignored attributes and the order of attributes are. Each node brings its own hash to its ancestors, one at each depth above
    it: the last one there that began before it. Rows grow with the depth, not with the square of the nodes."""
    attrs = F.array_join(F.transform(F.array_sort(F.filter(F.map_entries("attrs"), lambda e: ~e["key"].isin(*ignore))), lambda e: F.concat_ws("=", e["key"], e["value"])), "\u0001")
    own = nodes.select("path", "node", "depth", F.sha2(F.concat_ws("\u0002", "ns", "local", attrs), 256).alias("own"))
    levels = own.withColumn("level", F.explode(F.sequence(F.lit(0), "depth")))
    top = F.last(F.when(F.col("depth") == F.col("level"), F.col("node")), ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    held = levels.withColumn("top", top).groupBy("path", "top").agg(F.array_sort(F.collect_list(F.struct("node", (F.col("depth") - F.col("level")).alias("d"), "own"))).alias("inner"))
    text = F.array_join(F.transform("inner", lambda x: F.concat_ws(":", x["d"].cast("string"), x["own"])), ",")
    return held.select("path", F.col("top").alias("node"), F.sha2(text, 256).alias("signature"))


#: A prime, and pairs of numbers below it: bases for places and depths. Two pairs make a hash of 122 bits.
PRIME = (1 << 61) - 1
BASES = ((0x0F1E2D3C4B5A6978, 0x1B2C3D4E5F607182), (0x0A9B8C7D6E5F4031, 0x13579BDF02468ACE))


def subtree_hashes(nodes: DataFrame, ignore: tuple[str, ...] = ("id",)) -> DataFrame:
    """path, part, node, size, h1, h2 of elements (NODES: with their places and texts): equal for equal subtrees, whatever the ignored attributes and the order of
    attributes are.

    An Euler tour in one window: what opens and closes is put in order, and the sum of node hash * place power * depth power (in a prime field) is kept over what has
    opened. A subtree is what the sum gains between its opening and its closing, and dividing by the powers of its own place and depth makes equal subtrees equal wherever they
    stand. A node is one row at any depth; no row holds a subtree."""
    attrs = F.array_join(F.transform(F.array_sort(F.filter(F.map_entries("attrs"), lambda e: ~e["key"].isin(*ignore))), lambda e: F.concat_ws("=", e["key"], e["value"])), "\u0001")
    own = F.concat_ws("\u0002", "ns", "local", attrs, F.coalesce("text", F.lit("")))
    part = ["path", "part"]

    def power(base: int, sign: int):
        @F.pandas_udf("decimal(38,0)")
        def f(value: pd.Series, place: pd.Series, depth: pd.Series) -> pd.Series:
            from decimal import Decimal

            b, d = base
            return pd.Series([Decimal(int(v) % PRIME * pow(b, sign * int(i), PRIME) % PRIME * pow(d, sign * int(k), PRIME) % PRIME) for v, i, k in zip(value, place, depth, strict=True)], dtype=object)

        return f

    numbered = nodes.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("node")))
    for k, base in enumerate(BASES):
        value = F.pmod(F.xxhash64(F.lit(k), own), F.lit(PRIME)).cast("decimal(38,0)")
        numbered = numbered.withColumn(f"v{k}", power(base, 1)(value, F.col("place"), F.col("depth")))
    kept = [*part, "node", "place", "depth"]
    opens = numbered.select(*kept, F.lit(1).alias("turn"), F.col("start").alias("at"), F.lit(1).alias("one"), "v0", "v1")
    zero = F.lit(0).cast("decimal(38,0)")
    closes = numbered.filter("local != '#text'").select(*kept, F.lit(0).alias("turn"), F.col("stop").alias("at"), F.lit(0).alias("one"), zero.alias("v0"), zero.alias("v1"))
    before = Window.partitionBy(*part).orderBy("at", "turn", "node").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s_{c}") for c in ("one", "v0", "v1")]
    tour = opens.unionByName(closes).select(*kept, "turn", *sums)
    gained = lambda c: F.max(F.when(F.col("turn") == 0, F.col(f"s_{c}"))) - F.max(F.when(F.col("turn") == 1, F.col(f"s_{c}")))
    whole = tour.groupBy(*part, "node").agg(F.first("place").alias("place"), F.first("depth").alias("depth"), *[gained(c).alias(c) for c in ("one", "v0", "v1")]).filter("one is not null")
    field = lambda k: power(BASES[k], -1)(F.col(f"v{k}"), F.col("place"), F.col("depth")).cast("long").alias(f"h{k + 1}")
    return whole.select(*part, "node", F.col("one").cast("long").alias("size"), field(0), field(1))
