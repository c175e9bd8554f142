"""Queries on tables in documents, hierarchies and styles, each beside its SQL. Their inputs are made from keys so that every outcome is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.operators import records as R
from formloom.operators import tables as T
from formloom.operators.lineage import tasks_for
from formloom.plans.layout import LINES, lines
from formloom.plans.registry import query, t

SPANS = f"(select doc, no, no % 2 as row, n % 3 + 1 as span, n * 10 as width, n + 5 as height from {LINES})"


def spans(spark, d):
    x = lines(spark, d)
    return x.select("doc", "no", (F.col("no") % 2).alias("row"), (F.col("n") % 3 + 1).alias("span"), (F.col("n") * 10).alias("width"), (F.col("n") + 5).alias("height"))


@query(f"select doc, no, (coalesce(sum(span) over (partition by doc, row order by no rows between unbounded preceding and 1 preceding), 0))::int as col from {SPANS}")
def column_cursor(spark, d):
    return T.column_cursor(spans(spark, d), "doc", "row", "no", "span").select("doc", "no", "col")


@query(f"select doc, row, sum(width)::bigint as width, sum(span)::bigint as columns, max(height)::bigint as height from {SPANS} group by doc, row")
def grid_row_sums(spark, d):
    return T.row_sums(spans(spark, d), "doc", "row")


KINDS = ["missing-table", "ambiguous-table", "invalid-row-range", "invalid-row-range", "invalid-row-range", "unsupported-row-shape", "unsupported-row-shape", "nonempty-repeat-row", "inconsistent-column-width", "inconsistent-table-height", None]


@query("select c_custkey as region, case c_custkey % 11 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(KINDS) if x) + " end as reason from customer")
def repeat_region_verdict(spark, d):
    c = t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 11).alias("k"))
    k = F.col("k")
    column = lambda name, i: F.struct(F.lit(name).alias("name"), F.lit(i).alias("column"))
    regions = c.select(F.col("c_custkey").alias("region"), F.col("c_custkey").alias("doc"), F.lit("t").alias("table_id"), F.lit(1).alias("start"), F.when(k == 2, 7).otherwise(5).alias("stop"), F.when(k == 3, 5).otherwise(3).alias("prototype"), F.when(k == 2, 7).otherwise(5).alias("insert_before"), F.array(F.lit(0)).alias("headers"), F.array(column("a", 0), column("b", 1)).alias("columns"))
    regions = regions.withColumn("headers", F.when(F.col("region") % 11 == 4, F.array(F.lit(1))).otherwise(F.col("headers")))
    tables = c.filter("k > 0").withColumn("copy", F.explode(F.when(k == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(F.col("c_custkey").alias("doc"), F.lit("t").alias("table_id"), F.lit(7).alias("rows"), F.lit(2).alias("columns"), F.lit(100).alias("width"), F.when(k == 9, 71).otherwise(70).alias("height"))
    cells = c.select("c_custkey", "k", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("row")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("no"))
    row, no = F.col("row"), F.col("no")
    text = F.when(row == 1, F.when(no == 0, "{{a}}").otherwise("{{b}}")).when((row == 3) & (k == 7), "x").when(row.between(2, 5), "").otherwise("head")
    cells = cells.select(F.col("c_custkey").alias("doc"), F.lit("t").alias("table_id"), "row", "no", F.when((k == 5) & (row == 2), 9).otherwise(row).alias("row_addr"), no.alias("col_addr"), F.when((k == 6) & (row == 4), 2).otherwise(1).alias("row_span"), F.lit(1).alias("col_span"), F.when((k == 8) & (row == 6) & (no == 1), 40).otherwise(50).alias("width"), F.lit(10).alias("height"), text.alias("text"))
    return T.region_verdict(regions, tables, cells)


COUNTS = "(select l_orderkey as region, count(*) as n from lineitem group by l_orderkey)"


@query(f"select region, i::int as record, (case when i = 0 then 2 when i = n - 1 then 6 when 2 + i < 6 then 2 + i else 4 end)::int as source from (select region, n, unnest(range(0, n)) as i from {COUNTS})")
def repeat_source_rows(spark, d):
    return T.output_rows(repeats(spark, d), "region")


def repeats(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("region"))
    n = lines.repartition(tasks_for(lines), "region").groupBy("region").agg(F.count("*").alias("n"))
    return n.select("region", "n", F.lit(2).alias("start"), F.lit(6).alias("stop"), F.lit(4).alias("prototype"))


@query(f"select region, least(n, 5) as reused, greatest(n - 5, 0) as cloned, greatest(5 - n, 0) as removed from {COUNTS}")
def repeat_row_counts(spark, d):
    """From the rows themselves: the first, the last and those between are used once, the prototype again and again."""
    x = repeats(spark, d)
    return T.repeat_counts(T.output_rows(x, "region"), "region", x.select("region", "start", "stop"))


@query("select c_nationkey as doc, 'f' || c_custkey as name, 'text' as type from customer where not (c_custkey % 7 = c_nationkey % 3 and c_custkey % 10 between 3 and 5) union all select n_nationkey, 'rows', 'rows' from nation")
def outside_repeat_region(spark, d):
    o = t(spark, d, "customer").select(F.col("c_nationkey").alias("doc"), (F.col("c_custkey") % 7).alias("table_id"), (F.col("c_custkey") % 10).cast("int").alias("row"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("name"))
    r = t(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), (F.col("n_nationkey") % 3).cast("long").alias("table_id"), F.lit(3).alias("start"), F.lit(5).alias("stop"), F.lit("rows").alias("name"))
    return T.outside_region(o, r)


@query("with p as (select l_orderkey as doc, l_linenumber as row, count(distinct l_suppkey % 3) as pages from lineitem where l_linenumber <> 3 group by all) select o_orderkey as doc, 'f' as field, r.row::int as row, coalesce(pages, 0) as pages, case when coalesce(pages, 0) <> 1 then case when o_orderkey % 2 = 0 then 'record-requires-continuation' else 'repeat-profile-required' end end as reason from orders cross join (select unnest([1, 2, 3]) as row) as r left join p on p.doc = o_orderkey and p.row = r.row")
def one_row_one_page(spark, d):
    laid = t(spark, d, "lineitem").filter("l_linenumber <> 3").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 3).alias("page"))
    targets = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("f").alias("field"), (F.col("o_orderkey") % 2 == 0).alias("repeated"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("row"))
    return T.one_page_verdict(targets, laid)


@query("select p_partkey as doc, 0 as row, 0 as col, case when p_partkey % 6 = 0 then 'missing-cell-layout' when p_partkey % 6 = 1 then 'table-outside-page' when p_partkey % 6 = 2 then 'text-outside-cell' when p_partkey % 6 = 3 then 'missing-cell-text' end as reason from part")
def cell_layout(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.lit(0).alias("row"), F.lit(0).alias("col"), (F.col("p_partkey") % 6).alias("k"), F.col("p_name").alias("text"))
    k = F.col("k")
    f = lambda x: F.lit(float(x))
    rect = p.filter("k > 0").select("doc", "row", "col", f(10).alias("x"), f(10).alias("y"), F.when(k == 1, 500.0).otherwise(100.0).alias("w"), f(20).alias("h"), f(200).alias("page_w"), f(300).alias("page_h"))
    half = F.expr("substring(text, 1, 5)"), F.expr("substring(text, 6)")
    runs = p.withColumn("r", F.explode(F.array(F.struct(F.lit(0).alias("no"), half[0].alias("t")), F.struct(F.lit(1).alias("no"), F.when(k == 3, "?").otherwise(half[1]).alias("t"))))).select("doc", "row", "col", F.col("r.no").alias("no"), F.col("r.t").alias("text"), F.when(k == 2, 105.0).otherwise(10.1).alias("x"), f(12).alias("y"), f(20).alias("w"), f(10).alias("h"))
    return T.cell_layout_verdict(p.select("doc", "row", "col", "text"), rect, runs)


@query("select s_suppkey as field, case s_suppkey % 8 when 0 then 'ambiguous-property' when 1 then 'text-compression' when 2 then 'text-compression' when 3 then 'vertical-text' when 4 then 'fixed-container' when 5 then 'fixed-container' end as reason from supplier")
def docx_container_risk(spark, d):
    k = F.col("s_suppkey") % 8
    bad = F.struct(F.lit(2).alias("no"), F.when(k.isin(0, 1, 6), "noWrap").when(k == 2, "fitText").when(k == 3, "textDirection").when(k == 4, "framePr").when(k == 5, "tblpPr").otherwise("textDirection").alias("local"), F.when(k == 3, "btLr").when(k == 7, "lrTb").alias("value"), F.when(k == 1, True).when(k == 6, False).alias("on"), F.lit(True).alias("in_table"))
    fine = F.struct(F.lit(1).alias("no"), F.lit("spacing").alias("local"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("on"), F.lit(False).alias("in_table"))
    return T.container_risk(t(spark, d, "supplier").select(F.col("s_suppkey").alias("field"), F.inline(F.array(fine, bad))), "field")


@query("select s_suppkey as doc, case when s_suppkey % 2 = 0 and s_suppkey % 6 in (0, 2) then 'unsupported-paragraph-expansion' end as reason from supplier")
def docx_paragraph_expansion(spark, d):
    k = F.col("s_suppkey") % 6
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), (F.col("s_suppkey") % 2 == 0).alias("lines"), k.alias("k"))
    marks = s.select("doc", F.when(F.col("k") == 0, "numPr").when(F.col("k") == 2, "name").when(F.col("k") == 4, "name").otherwise("jc").alias("local"), F.when(F.col("k") == 2, "Heading 1").when(F.col("k") == 4, "Headline").alias("value"))
    return T.expansion_verdict(s, marks, "doc")


@query("select s_suppkey as row, case s_suppkey % 5 when 0 then 'ambiguous-property' when 1 then 'unsupported-row-exception' when 2 then 'unsupported-row-exception' end as reason from supplier")
def docx_row_exception(spark, d):
    k = F.col("s_suppkey") % 5
    e = lambda no, kind, local: F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), local.alias("local"))
    late = F.struct(F.when(k == 1, 3).otherwise(0).alias("no"), F.lit("exception").alias("kind"), F.lit("tblPrEx").alias("local"))
    own = F.array_compact(F.array(e(1, "cell", F.lit("tc")), F.when(k == 0, e(2, "exception", F.lit("tblPrEx"))), F.when(k < 4, late), e(4, "inner", F.when(k == 2, "tblW").otherwise("shd"))))
    return T.row_exception_verdict(t(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), F.inline(own)), "row")


WIDTHS = [("fixed", None, None), ("odd", "ambiguous-layout", None), (None, "ambiguous-grid", None), (None, "inconsistent-cell-width", None), (None, "ambiguous-grid", None), (None, "inconsistent-table-width", None), (None, "unsupported-horizontal-layout", None), (None, "ambiguous-section", None), (None, "table-outside-body", None), (None, None, 300), ("autofit", None, 300)]


@query("select p_partkey as \"table\", case p_partkey % 11 " + " ".join(f"when {i} then {x}" for i, (_, _, x) in enumerate(WIDTHS) if x) + " end::bigint as total, case p_partkey % 11 " + " ".join(f"when {i} then '{x}'" for i, (_, x, _) in enumerate(WIDTHS) if x) + " end as reason from part")
def docx_fixed_width(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("table"), (F.col("p_partkey") % 11).alias("k"))
    k = F.col("k")
    layout = F.when(k == 0, "fixed").when(k == 1, "odd").when(k == 10, "autofit")
    tables = p.select("table", layout.alias("layout"), F.when(k == 9, "auto").otherwise("dxa").alias("width_type"), F.when(k == 5, 299).when(k == 9, 0).otherwise(300).alias("width"), F.when(k == 6, "center").when(k == 10, "left").alias("align"), F.when(k == 10, 20).alias("indent"), F.when(k != 7, F.when(k == 8, 340).otherwise(400)).alias("page"), F.lit(30).alias("left"), F.lit(40).alias("right"))
    grid = p.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("table", "no", F.when(~((k == 2) & (F.col("no") == 1)), 100).alias("w"))
    cells = p.withColumn("c", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(n).alias("no")) for r in (0, 1) for n in (0, 1)])))
    span = F.when(F.col("c.no") == 0, F.when((k == 4) & (F.col("c.row") == 1), 1).otherwise(2)).otherwise(1)
    cells = cells.select("table", F.col("c.row").alias("row"), F.col("c.no").alias("no"), span.alias("span"), (span * 100 + F.when((k == 3) & (F.col("c.no") == 1), 1).otherwise(0)).alias("width"), F.lit("dxa").alias("width_type"))
    return T.fixed_width(tables, grid, cells)


FLOWS = ["nested-table", "merged-cell", "vertical-text", "fixed-container", "fixed-container", "unsupported-anchor", "unsupported-anchor", "fixed-container", "vertical-text", "ambiguous-style"]


@query("select p_partkey as field, case p_partkey % 13 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(FLOWS)) + " end as reason, case p_partkey % 13 when 10 then 'refresh-line-layout,inline-table-to-flow' when 11 then 'refresh-line-layout,existing-flow-table,clone-paragraph-flow-style' when 12 then 'refresh-line-layout' end as changes from part")
def hwpx_flow_verdict(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("field"), (F.col("p_partkey") % 13).alias("k"))
    k = F.col("k")
    anchor = F.create_map(*[F.lit(x) for kv in T.ANCHOR.items() for x in kv])
    s = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    x = p.select("field", (~k.isin(7, 12)).alias("in_table"), (k == 0).alias("nested"), F.lit(True).alias("in_list"), s(1, "2", "1").alias("row_span"), s(2, "VERTICAL", "HORIZONTAL").alias("direction"), F.lit("BREAK").alias("wrap"), s(3, "1", "0").alias("protect"), s(4, "SQUARE", "TOP_AND_BOTTOM").alias("text_wrap"), F.lit("CELL").alias("page_break"), F.lit("0").alias("no_adjust"), F.lit("ABSOLUTE").alias("width_rel"), F.lit("ABSOLUTE").alias("height_rel"), F.lit("0").alias("size_protect"), F.when(k == 5, F.map_concat(F.map_filter(anchor, lambda a, _: a != "vertAlign"), F.create_map(F.lit("vertAlign"), F.lit("CENTER")))).otherwise(anchor).alias("anchor"), s(10, "1", "0").alias("inline"), (~k.isin(6, 7)).alias("top_level"), F.when(k == 8, F.array(F.lit("VERTICAL"))).otherwise(F.array(F.lit("HORIZONTAL"))).alias("section_directions"), s(11, "1", "0").alias("keep_lines"), F.lit("0").alias("keep_next"), (k != 9).alias("style_found"))
    return T.flow_verdict(x).select("field", "reason", F.array_join("changes", ",").alias("changes"))


@query("with n as (select c_nationkey as owner, count(*) as found, count(distinct case when c_nationkey % 5 = 2 then c_custkey % 2 else c_custkey end) as ids, bool_or(c_nationkey % 5 = 1) as odd from customer group by 1) select n_nationkey as owner, case when coalesce(odd, false) or coalesce(found, 0) <> coalesce(ids, 0) or coalesce(found, 0) <> coalesce(found, 0) + case when n_nationkey % 5 = 3 then 1 else 0 end then 'ambiguous-style' end as reason from nation left join n on n.owner = n_nationkey")
def declared_item_count(spark, d):
    k = F.col("c_nationkey") % 5
    items = t(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.when(k == 1, "x").when(k == 2, (F.col("c_custkey") % 2).cast("string")).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    n = items.groupBy("owner").agg(F.count("*").alias("n"))
    owners = t(spark, d, "nation").select(F.col("n_nationkey").alias("owner")).join(n, "owner", "left").select("owner", (F.coalesce("n", F.lit(0)) + F.when(F.col("owner") % 5 == 3, 1).otherwise(0)).alias("n"))
    return T.declared_count(items, owners, "owner")


@query("select o_orderpriority as kind, o_orderstatus as shade, count(*) as n, 1::bigint as signatures from orders group by all")
def subtree_signature(spark, d):
    """A paragraph with one run for each order: subtrees are equal exactly where kind and shade are."""
    o = t(spark, d, "orders").select(F.concat(F.lit("p"), (F.col("o_orderkey") % 100).cast("string")).alias("path"), F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderstatus")
    attrs = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    id_ = F.col("k").cast("string")
    flip = F.when(F.col("k") % 2 == 0, attrs("id", id_, "kind", F.col("o_orderpriority"), "a", "1")).otherwise(attrs("a", "1", "kind", F.col("o_orderpriority"), "id", id_))
    nodes = o.select("path", F.inline(F.array(F.struct((F.col("k") * 2).alias("node"), F.lit(1).alias("depth"), F.lit("u").alias("ns"), F.lit("p").alias("local"), flip.alias("attrs")), F.struct((F.col("k") * 2 + 1).alias("node"), F.lit(2).alias("depth"), F.lit("u").alias("ns"), F.lit("r").alias("local"), attrs("shade", F.col("o_orderstatus")).alias("attrs")))))
    top = o.select("path").distinct().select("path", F.lit(-1).cast("long").alias("node"), F.lit(0).alias("depth"), F.lit("u").alias("ns"), F.lit("sec").alias("local"), attrs("x", "y").alias("attrs"))
    s = T.subtree_signatures(nodes.unionByName(top))
    mine = o.select("path", (F.col("k") * 2).alias("node"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("shade"))
    one = mine.join(s, ["path", "node"]).groupBy("signature").agg(F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("shade").alias("shade"), F.count_distinct("kind", "shade").alias("pairs"))
    return one.groupBy("kind", "shade").agg(F.sum("n").alias("n"), F.count("*").alias("signatures")).filter("n > 0")


@query(f"select doc as parent, case when count(*) filter (n % 4 = 0) = 1 then min(no) filter (n % 4 = 0) end as child, case when count(*) filter (n % 4 = 0) = 0 then 'missing' when count(*) filter (n % 4 = 0) > 1 then 'ambiguous' end as verdict from {LINES} group by doc")
def single_child(spark, d):
    x = lines(spark, d).select(F.col("doc").alias("parent"), F.col("no").alias("id"), (F.col("n") % 4).cast("string").alias("kind"))
    return R.single_child(x, "parent", "kind", "0")


@query(f"""with c as (select doc, no as depth, case when n % 3 = 0 then n end as value, n % 11 = 0 as conditional from {LINES}), f as (select doc, min(depth) filter (value is not null) as d, min_by(value, depth) filter (value is not null) as v, min(depth) filter (conditional) as c from c group by doc),
o as (select o_orderkey as doc, case when o_orderkey % 4 = 0 then 7 end as own from orders)
select doc, case when own is not null then own when c is not null and c <= coalesce(d, c) then null else v end::bigint as value, case when own is not null then 'direct' when c is not null and c <= coalesce(d, c) then 'ambiguous' when v is not null then 'style' else 'none' end as source from o full join f using (doc)""")
def effective_property(spark, d):
    chain = lines(spark, d).select("doc", F.col("no").alias("depth"), F.when(F.col("n") % 3 == 0, F.col("n")).alias("value"), (F.col("n") % 11 == 0).alias("conditional"))
    direct = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 4 == 0, 7).cast("long").alias("value"))
    return R.effective_property(chain, direct, "doc")


@query("select o_orderkey as paragraph, o_custkey % 40 + 1 as style from orders where o_custkey % 40 + 1 not in (select s_suppkey from supplier where s_suppkey % 3 <> 0)")
def dangling_style(spark, d):
    refs = t(spark, d, "orders").select(F.col("o_orderkey").alias("paragraph"), (F.col("o_custkey") % 40 + 1).alias("style"))
    return R.dangling(refs, t(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("style")), ["style"]).select("paragraph", "style")


@query("with recursive e as (select l_orderkey as id, case when l_orderkey % 10 = 9 then l_orderkey - 9 when l_orderkey % 10 = 0 and l_orderkey % 20 = 0 then l_orderkey + 9 when l_orderkey % 10 = 0 then null else l_orderkey - 1 end as parent from (select distinct o_orderkey as l_orderkey from orders)), k as (select id, case when parent in (select id from e) then parent end as up, parent from e), c(id, cur, depth) as (select id, id, 0 from k union all select c.id, k.up, c.depth + 1 from c join k on k.id = c.cur where k.up is not null and c.depth < 12), m as (select id, max(depth) as depth, max_by(cur, depth) as last from c group by id) select m.id, case when m.depth < 12 then coalesce(k.parent, m.last) end as root, case when m.depth < 12 then m.depth + case when k.parent is not null then 1 else 0 end end as depth, m.depth >= 12 as cycle from m join k on k.id = m.last")
def style_cycles(spark, d):
    """Chains of ten styles: some end, some at a style that isn't defined, some come back to themselves."""
    k = F.col("o_orderkey")
    parent = F.when(k % 10 == 9, k - 9).when((k % 10 == 0) & (k % 20 == 0), k + 9).when(k % 10 == 0, None).otherwise(k - 1)
    return R.style_chains(t(spark, d, "orders").select(k.alias("id"), parent.alias("parent"))).select("id", F.when(~F.col("cycle"), F.col("root")).alias("root"), "depth", "cycle")
