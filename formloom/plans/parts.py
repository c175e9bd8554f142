"""Queries on packages that are read part by part, as nodes: archive directories, text projection, repeated rows, what lets text flow. Each beside its SQL."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.functions.widths import width_chunks
from formloom.operators import flow_checks, projection, repeat_fill
from formloom.operators.lineage import cut, new_folder, spread
from formloom.plans.registry import query, t
from formloom.sources import containers, package_source, packages, publish_sink, sections
from formloom.sources.markup import node_rows

HEAD = f'<w:document xmlns:w="{containers.WORD}"><w:body>'
LINE = '<w:p><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>"
TAIL = "</w:body></w:document>"
#: The part that a letter of two lines is, as SQL.
LETTER = f"('{HEAD}{LINE[0]}' || c_name || '{LINE[1]}{LINE[0]}' || c_mktsegment || '{LINE[1]}{TAIL}')"


def letters(spark, d) -> str:
    """A folder with a package for each customer, published."""
    c = t(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".docx")).alias("path"), F.lit("docx").alias("format"), F.array("c_name", "c_mktsegment").alias("lines"))
    folder = new_folder(spark)
    publish_sink.publish(packages.make_packages(c).withColumnRenamed("path", "name"), folder)
    return folder


def key_of(path):
    return F.regexp_extract(path, r"(\d+)\.[a-z]+$", 1).cast("long")


@query(f"select c_custkey as id, part, size::bigint as size, 2::bigint as parts, (strlen({LETTER}) + {len(packages.TYPES)})::bigint as total, null::varchar as reason from (select *, unnest(['[Content_Types].xml', 'word/document.xml']) as part, unnest([{len(packages.TYPES)}, strlen({LETTER})]) as size from customer)")
def package_directory(spark, d):
    """Names and sizes of the parts of published packages, and the verdict on each directory; no part is read."""
    rows = package_source.package_parts(spark, letters(spark, d), ("path", "part", "no", "method", "flags", "stored", "size", "entries", "archive", "problem"))
    verdict = package_source.directory_verdict(rows)
    both = rows.select("path", "part", "size").join(verdict.drop("code"), "path")
    return both.select(key_of(F.col("path")).alias("id"), "part", "size", "parts", "total", "reason")


@query(f"select c_custkey as id, strlen({LETTER})::bigint as bytes, sha256({LETTER}) as sha from customer")
def package_part_bytes(spark, d):
    """One part of each package; the filter reaches the reader, so no other is inflated."""
    rows = package_source.package_parts(spark, letters(spark, d), ("path", "part", "body"))
    return rows.filter("part = 'word/document.xml'").select(key_of(F.col("path")).alias("id"), F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha"))


W = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
H = lambda x: f"<hp:run><hp:t>{x}</hp:t></hp:run>"
#: Bodies with markers split over runs, a paragraph in a table's cell and one within another paragraph's text; | is where a customer's name goes.
BODIES = {
    "docx": f"<w:p>{W('Dear {{na')}<w:r><w:t>me}}}}</w:t><w:tab/><w:t>of {{{{seg</w:t></w:r>{W('}}!')}</w:p><w:tbl><w:tr><w:tc><w:p>{W('| {{nr}}')}</w:p></w:tc></w:tr></w:tbl><w:p>{W('before ')}<w:r><w:txbx><w:p>{W('inner {{x}}')}</w:p></w:txbx></w:r>{W('{{af')}{W('ter}}')}</w:p><w:p/>".replace("}}}}", "}}").replace("{{{{", "{{"),
    "hwpx": f"<hp:p>{H('Dear {{na')}<hp:run><hp:t>me}}}}<hp:tab/>of {{{{seg</hp:t></hp:run>{H('}}!')}</hp:p><hp:p><hp:run><hp:tbl><hp:tr><hp:tc><hp:subList><hp:p>{H('| {{nr}}')}</hp:p></hp:subList></hp:tc></hp:tr></hp:tbl></hp:run></hp:p><hp:p>{H('before ')}<hp:run><hp:rect><hp:p>{H('inner {{x}}')}</hp:p></hp:rect></hp:run>{H('{{af')}{H('ter}}')}</hp:p><hp:p/>".replace("}}}}", "}}").replace("{{{{", "{{"),
}


def bodies(spark, d, form):
    name, rest = BODIES[form].split("|")
    c = t(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(f".{form}")).alias("path"), F.lit(form).alias("format"), F.concat(F.lit(name), F.col("c_name"), F.lit(rest)).alias("body"))
    return packages.make_packages(c)


def field_nodes(docs, form):
    parts = containers.parts(docs)
    return node_rows(parts.filter(F.col("part").rlike(f"^({containers.FIELD_PARTS[form]})$"))).filter("error is null").drop("error")


def field_tables(docs):
    """The tables in sections of packages."""
    return sections.table_rows(containers.parts(docs).filter(F.col("part").rlike(f"^({containers.FIELD_PARTS['hwpx']})$")))


@query("""with p as (select c_custkey as id, unnest(['docx', 'hwpx']) as form, c_name from customer),
x as (select id, form, unnest(case when form = 'docx' then [0, 1, 2, 3, 4] else [0, 1, 2, 3, 4, 5] end) as para, c_name from p),
y as (select id, form, case when form = 'docx' and para > 0 then para + 1 else para end as pos, para, c_name from x),
v as (select id, form, para, case pos when 0 then 'Dear {{name}}' || chr(9) || 'of {{seg}}!' when 1 then '' when 2 then c_name || ' {{nr}}' when 3 then 'before {{after}}' when 4 then 'inner {{x}}' else '' end as text,
  case pos when 0 then [{'name': 'name', 'start': 5, 'runs': 2}, {'name': 'seg', 'start': 17, 'runs': 2}] when 2 then [{'name': 'nr', 'start': length(c_name) + 1, 'runs': 1}] when 3 then [{'name': 'after', 'start': 7, 'runs': 2}] when 4 then [{'name': 'x', 'start': 6, 'runs': 1}] else [{'name': null, 'start': null, 'runs': null}] end as f from y)
select id, form, para::bigint as para, text, f.name as name, f.start::bigint as start, f.runs::bigint as runs from (select id, form, para, text, unnest(f) as f from v)""")
def projected_fields(spark, d):
    """Paragraphs of both package formats with their fields, from node rows alone."""
    out = None
    for form in BODIES:
        nodes = cut(field_nodes(bodies(spark, d, form), form))
        p = projection.fields(projection.paragraphs(nodes, form)).withColumn("para", F.row_number().over(Window.partitionBy("path").orderBy("p")) - 1)
        # two text elements of one run count once in the other model, so elements are counted here
        each = p.select(key_of(F.col("path")).alias("id"), F.lit(form).alias("form"), F.col("para").cast("long").alias("para"), "text", F.explode_outer("fields").alias("f"))
        one = each.select("id", "form", "para", "text", F.col("f.name").alias("name"), F.col("f.start").cast("long").alias("start"), F.size("f.texts").cast("long").alias("runs"))
        one = one.withColumn("runs", F.when(F.col("name").isNotNull(), F.col("runs")))
        out = one if out is None else out.unionByName(one)
    return out


CELL = '<hp:tc borderFillIDRef="{border}" header="0" protect="0"><hp:subList textDirection="HORIZONTAL" lineWrap="BREAK"><hp:p><hp:run>{text}</hp:run><hp:linesegarray/></hp:p></hp:subList><hp:cellAddr colAddr="{col}" rowAddr="{row}"/><hp:cellSpan colSpan="1" rowSpan="{span}"/><hp:cellSz width="1000" height="{height}"/></hp:tc>'
POSITION = "".join(f' {k}="{v}"' for k, v in repeat_fill.T.ANCHOR.items())


def grid(texts: list[list[str]], row_of=None, span: str = "1", place: str = "1", table_id: str = "rep") -> str:
    """A section's markup: a paragraph, a table of these cells, a paragraph."""
    row_of = row_of or (lambda r: r)
    cell = lambda r, c, x: CELL.format(border=r, text=f"<hp:t>{escape(x)}</hp:t>" if x else "", col=c, row=row_of(r), span=span if (r, c) == (2, 1) else "1", height=100 + r)
    rows = "".join("<hp:tr>" + "".join(cell(r, c, x) for c, x in enumerate(row)) + "</hp:tr>" for r, row in enumerate(texts))
    height = sum(100 + r for r in range(len(texts)))
    head = f'<hp:tbl id="{table_id}" rowCnt="{len(texts)}" colCnt="{len(texts[0])}" textWrap="TOP_AND_BOTTOM" pageBreak="CELL" noAdjust="0" repeatHeader="0"><hp:sz width="{1000 * len(texts[0])}" height="{height}" widthRelTo="ABSOLUTE" heightRelTo="ABSOLUTE" protect="0"/><hp:pos treatAsChar="{place}"{POSITION}/>'
    return f"<hp:p>{H('Orders of one customer')}</hp:p><hp:p><hp:run>{head}{rows}</hp:tbl></hp:run><hp:linesegarray/></hp:p><hp:p>{H('the end')}</hp:p>"


SOUND = [["No", "Priority"], ["{{no}}", "{{priority}}"], ["", ""], ["", ""], ["sum", "&c"]]


def region(docs):
    column = lambda n, i: F.struct(F.lit(n).alias("name"), F.lit(i).alias("column"))
    return docs.select("path", F.lit("Contents/section0.xml").alias("part"), F.lit("rep").alias("table_id"), F.lit(1).alias("first"), F.lit(3).alias("last"), F.lit(2).alias("prototype"), F.array(F.lit(0)).alias("headers"), F.array(column("no", 0), column("priority", 1)).alias("columns"))


def order_records(spark, d):
    """path, record, values: the orders of each customer, numbered."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = t(spark, d, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".hwpx")).alias("path"), n.cast("int").alias("record"), "o_orderkey", "o_orderpriority")
    return o.select("path", "record", F.create_map(F.lit("no"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" <&>\ttab")), F.lit("priority"), F.concat("o_orderpriority", F.lit("\r\nnext"))).alias("values"))


@query(r"""with o as (select o_custkey as id, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) as row, count(*) over (partition by o_custkey) as n from orders),
r as (select distinct id, n, unnest([0, n + 1]) as row from o)
select id, row::bigint as row, n::bigint + 2 as rows, o_orderkey || ' <&>' || chr(9) || 'tab' as first, o_orderpriority || chr(10) || 'next' as second from o
union all select id, row, n + 2, case when row = 0 then 'No' else 'sum' end, case when row = 0 then 'Priority' else '&c' end from r""")
def hwpx_repeat_fill(spark, d):
    """A table of each customer's orders: node rows to judged rows to edits to new packages, which are opened and read again."""
    records = order_records(spark, d)
    docs = spread(records.select("path"), "path").distinct()
    made = packages.make_packages(docs.select("path", F.lit("hwpx").alias("format"), F.lit(grid(SOUND)).alias("body")), dealt=True)
    parts = cut(containers.parts(made))
    new, _ = repeat_fill.filled_tables(sections.table_rows(parts.filter("part = 'Contents/section0.xml'")), parts, region(docs), records)
    filled = repeat_fill.repacked(parts, new)
    read = repeat_fill.region_tables(region(docs), field_tables(filled))
    rows = read.select("path", F.col("attrs.rowCnt").cast("long").alias("rows"), F.posexplode("rows").alias("row", "tr"))
    said = lambda no: F.when(F.get("tr.cells", F.lit(no))["row_addr"] == F.col("row"), F.get("tr.cells", F.lit(no))["text"])
    rows = rows.filter(F.exists("tr.cells", lambda c: c["row_addr"] == F.col("row")))
    return rows.select(key_of(F.col("path")).alias("id"), F.col("row").cast("long").alias("row"), "rows", said(0).alias("first"), said(1).alias("second"))


FAULTS = {
    1: (grid(SOUND, table_id="other"), "missing-table"), 2: (grid(SOUND, row_of=lambda r: r + (r == 3)), "unsupported-row-shape"), 3: (grid(SOUND, place="2"), "unsupported-anchor"),
    4: (grid([*SOUND[:2], ["x", ""], *SOUND[3:]]), "nonempty-repeat-row"), 5: (grid(SOUND, span="2"), "unsupported-row-shape"), 6: (grid(SOUND).replace('height="510"', 'height="9"'), "inconsistent-table-height"),
    7: (grid(SOUND).replace('rowCnt="5"', 'rowCnt="4"'), "invalid-row-range"), 8: (grid(SOUND) + grid(SOUND), "ambiguous-table"),
}


@query("select c_custkey as id, case c_custkey % 9 " + " ".join(f"when {k} then '{v[1]}'" for k, v in FAULTS.items()) + " end as reason from customer")
def hwpx_repeat_verdicts(spark, d):
    """Regions of documents, one in nine sound, judged from their nodes."""
    body = F.lit(grid(SOUND))
    for k, (markup, _) in FAULTS.items():
        body = F.when(F.col("c_custkey") % 9 == k, F.lit(markup)).otherwise(body)
    # keys are dealt, not the markup made of them
    docs = spread(t(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".hwpx")).alias("path"), F.lit("hwpx").alias("format"), body.alias("body"))
    judged = repeat_fill.verdicts(region(docs), field_tables(packages.make_packages(docs, dealt=True)))
    return judged.select(key_of(F.col("path")).alias("id"), "reason")


def flow_table(cell: str = "", row: str = "", table: str = "", width: str = "5000", marker: str = "{{x}}") -> str:
    """A table of one row of two cells, its field in the first, and a section of its own size."""
    tc = lambda pr, w, x: f'<w:tc><w:tcPr><w:tcW w:w="{w}" w:type="dxa"/>{pr}</w:tcPr><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>'
    return f'<w:tbl><w:tblPr>{table}</w:tblPr><w:tblGrid><w:gridCol w:w="5000"/><w:gridCol w:w="3000"/></w:tblGrid><w:tr>{row}{tc(cell, width, marker)}{tc("", "3000", "two")}</w:tr></w:tbl>'


SECTION = '<w:sectPr><w:pgSz w:w="12000" w:h="16000"/><w:pgMar w:left="1000" w:right="1000"/></w:sectPr>'
#: Bodies whose field may not flow, by the reason for which.
UNFIT = [
    (flow_table('<w:noWrap/>'), "text-compression"), (flow_table('<w:tcFitText w:val="1"/>'), "text-compression"), (flow_table('<w:textDirection w:val="btLr"/>'), "vertical-text"), (flow_table('<w:vMerge/>'), "merged-cell"),
    (flow_table(table='<w:tblpPr w:tblpX="1"/>'), "fixed-container"), ('<w:p><w:pPr><w:framePr w:w="9"/></w:pPr><w:r><w:t>{{x}}</w:t></w:r></w:p>', "fixed-container"), (flow_table(width="4000"), "inconsistent-cell-width"),
    (flow_table(row='<w:tblPrEx><w:tblW w:w="1" w:type="dxa"/></w:tblPrEx>'), "unsupported-row-exception"), (flow_table(cell='<w:tcPrChange/>'), "ambiguous-property"), (flow_table(marker="</w:t></w:r></w:p>" + flow_table() + "<w:p><w:r><w:t>").replace("{{x}}", "{{x}}", 1), "fixed-container"),
    (flow_table(table='<w:jc w:val="center"/>'), "unsupported-horizontal-layout"), (flow_table(table='<w:tblInd w:w="9000" w:type="dxa"/>'), "table-outside-body"), ('<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>{{x}}</w:t></w:r></w:p>', "unsupported-paragraph-expansion"),
]
FIT = [flow_table(), flow_table('<w:noWrap w:val="0"/>', row='<w:tblPrEx><w:shd/></w:tblPrEx>'), '<w:p><w:pPr><w:keepNext/></w:pPr><w:r><w:t>{{</w:t></w:r><w:r><w:t>x}}</w:t></w:r></w:p>']


@query(f"select c_custkey as id, 'x' as name, [{', '.join(repr(r) for _, r in UNFIT)}, {', '.join('null' for _ in FIT)}][c_custkey % {len(UNFIT) + len(FIT)} + 1] as reason from customer")
def flow_refusals(spark, d):
    """Fields of word-processing documents that may not flow, each for its own reason, among those that may; all values have line ends."""
    every = F.array(*[F.lit(b + SECTION) for b in [*(b for b, _ in UNFIT), *FIT]])
    c = t(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".docx")).alias("path"), F.lit("docx").alias("format"), F.get(every, (F.col("c_custkey") % (len(UNFIT) + len(FIT))).cast("int")).alias("body"))
    nodes = cut(field_nodes(packages.make_packages(c), "docx"))
    lines = nodes.select("path").distinct().withColumn("name", F.lit("x"))
    return flow_checks.flow_reasons(nodes, lines).select(key_of(F.col("path")).alias("id"), "name", "reason")


NARROW, BROAD = "fijlrt.,;:'!|", "mwMW"
WIDTHS = dict.fromkeys(NARROW, 1) | dict.fromkeys(BROAD, 3)
UNITS = f"(2 * length(x) + length(x) - length(translate(x, '{BROAD}', '')) - length(x) + length(translate(x, '{NARROW.replace(chr(39), chr(39) * 2)}', '')))"
PIECES = r"regexp_extract_all(text, '(?s).*?(?:\r\n|\r|\n|[ \t\x0B\f]+)|.+')"


@query(rf"""with recursive k as (select doc_id, text, 300 + doc_id % 7 * 100 as budget, {PIECES} as p from documents),
e as (select doc_id, budget, i, w, sum(n) over (partition by doc_id order by i) as stop, sum(w) over (partition by doc_id order by i) as far from (select doc_id, budget, unnest(range(0, len(p))) as i, unnest(list_transform(p, lambda x: length(x))) as n, unnest(list_transform(p, lambda x: {UNITS})) as w from k)),
bad as (select distinct doc_id from e where w > budget),
c(doc_id, no, start, stop, far) as (select doc_id, 0, 0::hugeint, max(stop), max(far) from e where far <= budget and doc_id not in (select doc_id from bad) group by doc_id
  union all select c.doc_id, c.no + 1, c.stop, (select max(stop) from e where e.doc_id = c.doc_id and e.far <= c.far + e.budget), (select max(far) from e where e.doc_id = c.doc_id and e.far <= c.far + e.budget) from c where exists (select 1 from e where e.doc_id = c.doc_id and e.stop > c.stop))
select c.doc_id, c.no::int as chunk_no, substr(text, (start + 1)::bigint, (stop - start)::bigint) as chunk from c join k on k.doc_id = c.doc_id union all select doc_id, null, null from bad""")
def chunk_by_width(spark, d):
    """Each document cut by the widths of its characters, with a budget of its own; one row without a piece where a word is wider."""
    x = t(spark, d, "documents").filter("text != ''").select("doc_id", width_chunks(F.col("text"), 300 + F.col("doc_id") % 7 * 100, WIDTHS, 2).alias("c"))
    return x.select("doc_id", F.posexplode_outer("c").alias("chunk_no", "chunk"))


@query("select c_mktsegment as segment, count(*) as n, 1::bigint as signatures, 5::bigint as size from customer group by 1")
def subtree_hash(spark, d):
    """Paragraphs of packages with their subtrees' hashes: equal exactly where what they say is, whatever their ids and wherever they stand."""
    key, said = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    flip = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<hp:p id="'), key, F.lit('" a="1" b="2">'))).otherwise(F.concat(F.lit('<hp:p b="2" a="1" id="'), key, F.lit('">')))
    para = F.concat(flip, F.lit("<hp:run><hp:t>"), said, F.lit('</hp:t><hp:ctrl x="1"/></hp:run></hp:p>'))
    c = t(spark, d, "customer").select(F.pmod(F.hash("c_custkey"), F.lit(50)).alias("g"), "c_custkey", para.alias("para"))
    docs = c.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "para"))), lambda s: s["para"]), "").alias("body"))
    nodes = cut(field_nodes(packages.make_packages(docs.select(F.concat(F.col("g").cast("string"), F.lit(".hwpx")).alias("path"), F.lit("hwpx").alias("format"), "body")), "hwpx"))
    mine = nodes.filter("local = 'p'").select("path", "part", "node", F.col("attrs.id").cast("long").alias("c_custkey"))
    h = repeat_fill.T.subtree_hashes(nodes).join(mine, ["path", "part", "node"]).join(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return h.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_distinct("h1", "h2").alias("signatures"), F.max("size").alias("size"))
