"""Queries on compound records, continued pages and forms, each beside its SQL. Their inputs are made from keys so that every outcome is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.operators import flow as W
from formloom.operators import pages as P
from formloom.operators import records as R
from formloom.operators.lineage import cut
from formloom.plans.registry import CHUNKS, query, t
from formloom.sources import pdf as D


def le(n, size=4):
    """A number as little-endian bytes."""
    raw = F.lpad(F.hex(F.when(n < 0, n + (1 << 32)).otherwise(n)) if size == 4 else F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(raw, 2 * k + 1, 2) for k in reversed(range(size))]))


def zeros(n):
    return F.unhex(F.repeat(F.lit("00"), n))


def line(start, height=900, vertical=0):
    at = lambda x: le(x if not isinstance(x, int) else F.lit(x))
    return F.concat(at(start), at(vertical), at(height), at(700), zeros(12), at(4000), zeros(4))


def paragraphs(spark, d):
    """Three paragraphs a supplier: a target, a later one, and one in another section."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), (F.col("s_suppkey") % 12).alias("k"), F.concat(F.lit("Dear {{x}} "), F.col("s_name")).alias("old"), F.concat(F.lit("Dear "), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "\n").otherwise(""), F.col("s_name"), F.lit("\U0001f600")).alias("new"))
    return s


def header(text, lines, flags):
    return F.concat(le(X.utf16_length(text) + 1 + F.lit(1 << 31)), le(flags), zeros(8), le(lines, 2), zeros(8))


def section(x, text, lines, flags, header_tail=None, wrong=None):
    head = header(text, lines, flags) if header_tail is None else F.concat(F.substring(header(text, lines, flags), 1, 18), header_tail)
    two = F.concat(line(0), line(F.lit(5)))
    return head, W.as_text_record(text), F.concat(le(F.lit(0)), le(F.lit(7))), two


def rec(section_, record, tag, level, paragraph, data):
    f = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.struct(f(section_).alias("section"), f(record).alias("record"), f(tag).alias("tag"), f(level).alias("level"), f(paragraph).alias("paragraph"), data.alias("data"))


TARGETS = ["unsupported-anchor", "unsupported-anchor", "fixed-container", "unsupported-character", "unsupported-record", "mixed-character-styles", "mixed-character-styles"]


@query("select s_suppkey as doc, case s_suppkey % 12 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(TARGETS)) + " end as reason from supplier")
def hwp_target_verdict(spark, d):
    x, k = paragraphs(spark, d), F.col("k")
    h, text, shape, lines = section(x, F.col("old"), F.lit(1), F.lit(0))
    shape = F.when(k == 5, F.concat(le(F.lit(0)), zeros(4), le(F.lit(9)), zeros(4))).when(k == 6, F.concat(le(F.lit(0)), zeros(4), le(F.lit(0)), zeros(4))).otherwise(shape)
    own = F.array(rec(0, 0, 66, 0, 0, h), rec(0, 1, 67, 1, 0, F.when(k == 1, F.concat(text, zeros(2))).otherwise(text)), rec(0, 2, 68, 1, 0, shape), rec(0, 3, F.when(k == 0, 70).otherwise(69), 1, 0, F.when(k == 4, zeros(35)).otherwise(line(0))))
    records = x.select("doc", F.inline(own))
    targets = x.select("doc", F.lit(0).alias("section"), F.lit(0).alias("paragraph"), F.col("old").alias("text"), F.lit(5).alias("first_field"), F.lit(False).alias("single_line"), (k == 2).alias("keep_lines"), F.lit(False).alias("keep_next"), F.when(k == 3, "a\tb").otherwise("ab").alias("value"))
    return W.target_verdict(targets, records).select("doc", "reason")


CHANGES = [None, "record-count", "record-structure", "target-header", "target-text", "target-lines", "later-lines", "other-record", None, "target-header", "target-lines", None]


@query("select s_suppkey as doc, case s_suppkey % 12 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(CHANGES) if x) + " end as reason from supplier")
def hwp_record_changes(spark, d):
    x, k = paragraphs(spark, d), F.col("k")
    old, new = F.col("old"), F.col("new")
    h0, t0, s0, l0 = section(x, old, F.lit(2), F.lit(3))
    bit = F.when(F.contains(new, F.lit("\n")), 1 << 10).otherwise(0)
    h1 = header(new, F.when(k == 9, 3).otherwise(2), F.lit(3) + bit + F.when(k == 3, 4).otherwise(0))
    _, t1, s1, _ = section(x, new, F.lit(2), F.lit(3))
    t1 = F.when(k == 4, W.as_text_record(old)).otherwise(t1)
    l1 = F.when(k == 5, F.concat(line(0), line(0))).when(k == 10, F.concat(line(0), line(F.lit(5), height=0))).otherwise(F.concat(line(0), line(F.lit(6), vertical=50)))
    later0, later1 = F.concat(line(0), line(F.lit(4))), F.when(k == 6, F.concat(line(0), line(F.lit(3)))).otherwise(F.concat(line(0, vertical=77), line(F.lit(4), vertical=99)))
    fixed = F.lit("fixed").cast("binary")
    before = F.array(rec(0, 0, 66, 0, 0, h0), rec(0, 1, 67, 1, 0, t0), rec(0, 2, 68, 1, 0, s0), rec(0, 3, 69, 1, 0, l0), rec(0, 4, 66, 0, 1, fixed), rec(0, 5, 69, 1, 1, later0), rec(1, 0, 66, 0, 0, fixed))
    after = F.array(rec(0, 0, 66, 0, 0, h1), rec(0, 1, 67, 1, 0, t1), rec(0, 2, F.when(k == 2, 70).otherwise(68), 1, 0, s1), rec(0, 3, 69, 1, 0, l1), rec(0, 4, 66, 0, 1, fixed), rec(0, 5, 69, 1, 1, later1), rec(1, 0, 66, 0, 0, F.when(k == 7, F.lit("other").cast("binary")).otherwise(fixed)), rec(1, 1, 66, 0, 1, fixed))
    kept = F.when(k == 1, after).otherwise(F.slice(after, 1, 7))
    targets = x.select("doc", F.lit(0).alias("section"), F.lit(0).alias("paragraph"), F.col("new").alias("text"))
    found = W.record_changes(x.select("doc", F.inline(before)), x.select("doc", F.inline(kept)), targets).groupBy("doc").agg(F.min(F.struct("section", "record", "reason"))["reason"].alias("reason"))
    return x.select("doc").join(found, "doc", "left")


@query("select s_suppkey as doc, 'section' || i as stream, sha256(case when i = s_suppkey % 3 then 'new ' || s_name else 'old ' || s_name end) as sha, i = s_suppkey % 3 as changed from supplier cross join (select unnest([0, 1, 2]) as i)")
def hwp_grafted_streams(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), "s_name", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("i"))
    name = F.concat(F.lit("section"), F.col("i").cast("string")).alias("stream")
    old, new = s.select("doc", name, F.concat(F.lit("old "), "s_name").alias("body")), s.select("doc", name, F.concat(F.lit("new "), "s_name").alias("body"))
    changed = s.filter("i = doc % 3").select("doc", name)
    return W.grafted(old, new, changed, ["doc", "stream"]).select("doc", "stream", F.sha2("body", 256).alias("sha"), "changed")


@query(CHUNKS.replace("{budget}", "400") + ", n as (select doc_id, count(*) as pages from c group by doc_id) select k.doc_id as doc, case when k.doc_id % 6 = 4 and coalesce(pages, 0) > 0 then pages when length(text) = 0 then 0 else coalesce(pages, 0) - case when k.doc_id % 6 = 1 then 1 else 0 end end::bigint as pages, case when coalesce(pages, 0) = 0 then null when k.doc_id % 6 = 0 then 'page-overflow' when k.doc_id % 6 = 1 then 'no-progress' when k.doc_id % 6 in (2, 3) then 'ambiguous-field' end as reason from k left join n on n.doc_id = k.doc_id")
def hwp_page_coverage(spark, d):
    """Chunks of the documents laid out one a page, with a run outside, a missing one, one twice and one of another text."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 6).alias("k"), "text")
    c = docs.select("doc", "k", F.posexplode(X.greedy_chunks(F.col("text"), 400)).alias("page", "chunk"))
    run = R.run_offsets(c, "doc", "page", "chunk").select("doc", "page", F.col("start").alias("char_start")).join(c, ["doc", "page"])
    k = F.col("k")
    kept = run.filter("not (k = 1 and page = 0)")
    again = F.when((k == 2) & (F.col("page") == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    runs = kept.withColumn("copy", F.explode(again)).select("doc", F.lit(0).alias("paragraph"), F.lit(None).cast("int").alias("parent"), F.col("page").alias("page"), F.col("char_start").cast("int").alias("char_start"), F.when((k == 3) & (F.col("page") == 0), F.concat(F.lit("~"), F.substring("chunk", F.lit(2), F.length("chunk")))).otherwise(F.col("chunk")).alias("text"), F.lit(10.0).alias("x"), F.lit(10.0).alias("y"), F.when((k == 0) & (F.col("page") == 0), 900.0).otherwise(100.0).alias("w"), F.lit(9.0).alias("h"), F.lit(200.0).alias("page_w"), F.lit(300.0).alias("page_h"))
    inner = runs.filter("doc % 6 = 4 and page = 0").withColumn("parent", F.lit(7))  # a cell's paragraph of the same number
    return W.character_coverage(docs.select("doc", F.lit(0).alias("paragraph"), "text"), runs.unionByName(inner)).select("doc", "pages", "reason")


@query("select l_orderkey as doc, 'f' || l_linenumber as name, l_linenumber * 20 + coalesce(sum(l_quantity::int - 5) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0)::bigint + l_quantity::bigint - 1 as at from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by all)")
def hwp_last_characters(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    f = x.select("doc", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_linenumber") * 20).alias("start"), (F.col("l_linenumber") * 20 + 5).alias("stop"), F.expr("repeat('x', q)").alias("value"))
    return W.last_characters(f, "doc")


@query("select c_custkey as k, case when c_custkey % 3 = 0 then 'a' when c_custkey % 3 = 1 then 'b' end as strict_style, 'b' as flow_style from customer where c_custkey % 3 < 2 union all select c_custkey, null, case when c_custkey % 3 = 2 then null end from customer where c_custkey % 3 = 2")
def hwp_tail_style(spark, d):
    k = F.col("c_custkey") % 3
    styles = lambda *x: F.array(*map(F.lit, x))
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(k == 0, styles("a", "a", "a")).when(k == 1, styles("b", "b", "b")).otherwise(styles("a", "b", "c")).alias("styles"), F.lit(1).alias("first_field"))
    strict = W.tail_style(p, ["k"], False).select("k", F.col("style").alias("strict_style"))
    mixed = p.withColumn("styles", F.when(F.col("k") % 3 == 0, styles("a", "b", "b")).otherwise(F.col("styles")))
    return strict.join(W.tail_style(mixed, ["k"], True).select("k", F.col("style").alias("flow_style")), "k")


@query("with b as (select c_nationkey as doc, c_mktsegment as text, count(*) as n, min(c_custkey) as block from customer where c_custkey % 3 <> 0 group by all) select s_suppkey as paragraph, case when n = 1 then block end as block, case when coalesce(n, 0) <> 1 then 'ambiguous-field' end as reason from (select s_suppkey, s_nationkey, ['BUILDING', 'MACHINERY', 'FURNITURE'][s_suppkey % 3 + 1] as text from supplier) as s left join b on b.doc = s.s_nationkey and b.text = s.text")
def hwp_unique_blocks(spark, d):
    b = t(spark, d, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("block"), F.when(F.col("c_custkey") % 3 == 0, "list").when(F.col("c_custkey") % 3 == 1, "heading").otherwise("paragraph").alias("kind"), F.col("c_mktsegment").alias("text"))
    p = t(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("paragraph"), F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("text"))
    return W.unique_blocks(p, b, "doc").select("paragraph", "block", "reason")


@query("select s_suppkey as doc, case s_suppkey % 4 when 0 then 'strict' when 1 then 'flow' end as fields, case when s_suppkey % 4 = 1 then 'flow' end as required, case s_suppkey % 4 when 2 then 'E_PRESERVATION' when 3 then 'E_INPUT' end as error from supplier")
def hwp_flow_fallback(spark, d):
    k, s = F.col("s_suppkey") % 4, t(spark, d, "supplier")
    strict = s.select(F.col("s_suppkey").alias("doc"), F.when(k == 0, "strict").alias("fields"), F.when(k.isin(1, 2), "E_PRESERVATION").when(k == 3, "E_INPUT").alias("error"))
    flow = s.select(F.col("s_suppkey").alias("doc"), F.lit("flow").alias("fields"), F.when(k == 2, "E_LAYOUT").alias("error"))
    return W.with_fallback(strict, flow, "doc")


BOX = lambda x, y, w, h: F.struct(*[(v if not isinstance(v, (int, float)) else F.lit(float(v))).alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)])


def geometry(k, page=1):
    """A field's columns: k of 0 to 9 breaks one thing each."""
    on = lambda i, bad, good: F.when(k == i, bad).otherwise(good)
    return [on(0, "checkbox", "text").alias("kind"), (k == 1).alias("read_only"), (k != 2).alias("multiline"), on(3, 2, 1).alias("widgets"), F.when(k == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("pages"), F.lit(page).alias("page"), BOX(on(5, 1.0, 0.0), 0, 500, 700).alias("media"), BOX(0, 0, 500, 700).alias("crop"), on(6, 90, 0).alias("rotation"), on(7, 90, 0).alias("widget_rotation"), BOX(on(8, 480.0, 50.0), 400, 100, 50).alias("rect"), on(9, -1.0, 1.0).alias("border")]


@query("select p_partkey as id, p_partkey % 11 not in (0, 1, 3, 4, 5, 6, 7, 8, 9) as supported from part")
def pdf_geometry(spark, d):
    return t(spark, d, "part").select("p_partkey", *geometry(F.col("p_partkey") % 11)).select(F.col("p_partkey").alias("id"), P.supported_geometry().alias("supported"))


PROFILES = ["invalid-profile", "invalid-profile", "invalid-profile", "invalid-profile", "unsupported-geometry", "invalid-label-box", "invalid-label-box", "invalid-label-box", "invalid-repeat-field", "invalid-repeat-field", None, None]


@query("select s_suppkey as doc, case s_suppkey % 12 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(PROFILES) if x) + " end as reason from supplier")
def pdf_continuation_profile(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), (F.col("s_suppkey") % 12).alias("k"))
    k = F.col("k")
    settings = s.select("doc", F.lit(0).alias("no"), F.lit("body").alias("field"), F.when(k == 0, 3).otherwise(1).alias("page"), F.when(k == 8, F.array(F.lit("body"))).when(k == 9, F.array(F.lit("none"))).otherwise(F.array(F.lit("date"))).alias("repeat_fields"), F.when(k == 1, "a\nb").when(k == 2, F.repeat(F.lit("x"), 81)).otherwise("Body").alias("label"), BOX(F.when(k == 5, 450.0).otherwise(50.0), 20, 100, 15).alias("label_box"), F.when(k.isin(3, 6, 11), "foot").alias("footer"), F.when(k == 6, BOX(100, 25, 100, 15)).when(k == 11, BOX(300, 20, 100, 15)).alias("footer_box"), BOX(50, F.when(k == 7, 430.0).otherwise(60.0), 100, 15).alias("source_box"))
    f = s.withColumn("field", F.explode(F.array(F.lit("body"), F.lit("date"))))
    fields = f.select("doc", "field", *geometry(F.when(F.col("field") == "body", F.when(k == 4, 2).otherwise(10)).otherwise(2)))
    widgets = s.select("doc", F.lit(1).alias("page"), F.inline(F.array(F.struct(BOX(50, 400, 100, 50).alias("rect")), F.struct(BOX(50, 600, 100, 20).alias("rect")))))
    pages = s.select("doc", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), BOX(0, 0, 500, 700).alias("crop"))
    return P.profile_verdict(settings, fields, widgets, pages).select("doc", "reason")


PLAN = CHUNKS.replace("{budget}", "2000") + ", n as (select doc_id, count(*) as n, arg_min(stop, no) as prefix from c group by doc_id), p as (select k.doc_id, text, n, prefix, case when k.doc_id % 7 = 0 then 'continuation-template-required' when coalesce(n, 0) < 2 then 'unrepresentable-layout' end as reason from k left join n on n.doc_id = k.doc_id)"


def plans(spark, d):
    docs = t(spark, d, "documents")
    v = docs.select((F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("no"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("field"), F.col("text").alias("value"), (F.col("doc_id") % 7 != 0).alias("planned"))
    return cut(P.continuation(v, 2000))  # its chunks are read several times


@query(PLAN + " select doc_id, reason, case when reason is null then n end::int as chunks, case when reason is null then prefix end::int as prefix_length, length(text)::int as length, sha256(text) as sha256 from p")
def pdf_continuation_plan(spark, d):
    """Lengths count UTF-16 units; the texts hold no characters beyond the basic plane."""
    return plans(spark, d).select(F.col("no").alias("doc_id"), "reason", F.size("chunks").alias("chunks"), "prefix_length", "length", "sha256").withColumn("chunks", F.when(F.col("chunks") > 0, F.col("chunks")))


@query(PLAN + """, b as (select doc_id, n, coalesce(sum(n - 1) over (partition by doc_id % 50 order by doc_id rows between unbounded preceding and 1 preceding), 0) as base from p where reason is null)
select b.doc_id % 50 as doc, 'f' || b.doc_id as field, c.no as part, (3 + base + c.no)::bigint as page, 'continuation_' || substr(sha256('f' || b.doc_id), 1, 24) || '_' || c.no as name, 'L' || b.doc_id || ' - part ' || (c.no + 1) || ' of ' || n || ' - original form page ' || (b.doc_id % 3 + 1) as label, sha256(substr(k.text, (start + 1)::bigint, (stop - start)::bigint)) as sha from b join c on c.doc_id = b.doc_id join k on k.doc_id = b.doc_id where c.no > 0""")
def pdf_added_pages(spark, d):
    return chunk_rows(spark, d)[1].select("doc", "field", "part", "page", "name", "label", F.sha2("chunk", 256).alias("sha"))


def chunk_rows(spark, d):
    p = plans(spark, d).filter("reason is null").withColumn("label", F.concat(F.lit("L"), F.col("no").cast("string"))).withColumn("source_page", F.col("no") % 3 + 1)
    documents = p.select("doc").distinct().withColumn("pages", F.lit(3))
    return p, P.added_chunks(p, documents)


@query(PLAN + """, b as (select doc_id, n, coalesce(sum(n - 1) over (partition by doc_id % 50 order by doc_id rows between unbounded preceding and 1 preceding), 0) as base from p where reason is null)
select doc_id % 50 as doc, doc_id % 3 + 1 as page, string_agg('L' || doc_id || ': page ' || (3 + base + 1)::bigint, '|' order by doc_id) as notes from b group by all""")
def pdf_page_notes(spark, d):
    p, chunks = chunk_rows(spark, d)
    return P.page_notes(p, chunks).select("doc", "page", F.array_join("notes", "|").alias("notes"))


@query(PLAN + f""", v as (select doc_id % 50 as doc, arg_min(length(text), doc_id) as own, max(length(text)) as longest from p where reason is null group by 1)
select doc, case when own > {P.MAX_VALUE} or doc % 8 = 0 then 'entry' when doc % 8 = 1 then 'prefix' when doc % 8 = 2 then 'name' when doc % 8 = 3 then 'page' when doc % 8 = 4 then 'value' when doc % 8 = 6 then 'empty-chunk' when longest > {P.MAX_VALUE} then 'entry' when doc % 8 = 5 then 'page-count' end as reason from v""")
def pdf_continued_verdict(spark, d):
    """The first entry of each document is wrong in its own way; a value longer than an entry may hold makes any other wrong as well."""
    p, chunks = chunk_rows(spark, d)
    first = p.groupBy("doc").agg(F.min("no").alias("first"), F.sum(F.size("chunks") - 1).alias("added"))
    k, own = F.col("doc") % 8, F.col("no") == F.col("first")
    hit = lambda i: (k == i) & own
    e = p.join(first, "doc")
    entries = e.select("doc", "no", F.col("field").alias("origin"), F.when(hit(0), 9).otherwise(F.col("source_page")).alias("source_page"), F.when(hit(1), F.concat(F.get("chunks", 0), F.lit("x"))).otherwise(F.get("chunks", 0)).alias("prefix"), "prefix_length", "length", F.when(hit(4), F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    c = chunks.join(e.select("doc", "field", "no", "first"), ["doc", "field"])
    one = F.col("part") == 1
    parts = c.select("doc", F.col("field").alias("origin"), "part", F.when(hit(2) & one, "other").otherwise(F.col("name")).alias("name"), (F.col("page") + F.when(hit(3) & one, 1).otherwise(0)).alias("page"), F.when(hit(6) & one, "").otherwise(F.col("chunk")).alias("text"))
    documents = first.select("doc", F.lit(3).alias("original_pages"), (3 + F.col("added") + F.when(k == 5, 1).otherwise(0)).alias("pages"))
    return P.continued_verdict(entries, parts, documents)


@query("select c_custkey as doc, 'a' as field from customer where c_custkey % 5 = 0")
def pdf_overflowing_repeat(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.lit("a").alias("field"), F.array(F.lit("b"), F.lit("c")).alias("repeat_fields"))
    over = c.filter("doc % 5 = 0").select("doc", F.lit("c").alias("field")).unionByName(c.filter("doc % 5 = 1").select("doc", F.lit("a").alias("field")))
    return P.overflowing_repeats(c, over)


@query("select o_custkey as doc, case when length(m) <= 500 then md5(m) end as mapping, case when length(m) > 500 then 'E_LAYOUT' end as code from (select o_custkey, '[' || string_agg('{\"no\":' || o_orderkey || ',\"origin\":\"' || o_orderpriority || '\"}', ',' order by o_orderkey) || ']' as m from orders group by 1)")
def pdf_mapping(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("no"), F.col("o_orderpriority").alias("origin"))
    return P.mapping(o, "doc", 500).select("doc", F.md5("mapping").alias("mapping"), "code")


@query("select c_custkey as doc, case when c_custkey % 5 = 0 then 'unknown' when c_custkey % 5 = 1 then 'origin-or-twice' when c_custkey % 5 = 2 then 'changed' when c_custkey % 5 = 3 then 'bindings' end as reason from customer")
def pdf_repeat_contexts(spark, d):
    k, c = F.col("c_custkey") % 5, t(spark, d, "customer")
    x = c.select(F.col("c_custkey").alias("doc"), F.when(k == 1, "body").otherwise("date").alias("name"), F.lit("body").alias("origin"), F.sha2(F.when(k == 2, "x").otherwise(F.col("c_name")), 256).alias("value_sha256"), F.when(k == 3, 1).otherwise(2).alias("bindings"), F.lit(2).alias("added"))
    fields = c.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("doc"), F.explode(F.array(F.lit("date"), F.lit("body"))).alias("name"), F.col("c_name").alias("value"))
    return P.repeat_contexts(x, fields).select("doc", "reason")


@query("select p_partkey as id, case when p_partkey % 5 < 3 then 'unsupported-appearance' end as reason from part")
def pdf_appearance_coordinates(spark, d):
    k = F.col("p_partkey") % 5
    f = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, f(0, 0, 100)).when(k == 1, f(0, 0, 100.02, 20)).otherwise(f(0.005, 0, 100, 20.009)).alias("bbox"), F.when(k == 2, f(1, 0, 0, 1, 0, 5)).when(k == 3, f(1, 0, 0, 1, 0, 0)).alias("matrix"), BOX(50, 50, 100, 20).alias("rect"))
    return P.appearance_coordinates(rows)


@query("select c_nationkey as doc, c_custkey as widget, case c_custkey % 6 when 0 then 'two-fields' when 1 then 'no-field' when 2 then 'no-page' when 3 then 'two-pages' when 4 then 'other-parent' end as reason from customer")
def pdf_widget_graph(spark, d):
    return P.widget_graph(*graph(spark, d))


def graph(spark, d):
    k, c = F.col("c_custkey") % 6, t(spark, d, "customer")
    own = c.withColumn("copy", F.explode(F.when(k == 0, F.array(F.lit(0), F.lit(1))).when(k == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))))
    widgets = own.select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("widget"), (F.col("c_custkey") % 20).alias("field"))
    placed = c.withColumn("page", F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).when(k == 2, F.array().cast("array<int>")).otherwise(F.array((F.col("c_custkey") % 4).cast("int")))))
    return widgets, placed.select(F.col("c_nationkey").alias("doc"), "page", F.col("c_custkey").alias("widget"), F.when(k == 4, F.lit(-1)).otherwise(F.col("c_custkey") % 20).alias("field_ref"))


@query("with p as (select c_nationkey as doc, c_custkey % 20 as field, unnest(case when c_custkey % 6 = 3 then [1, 2] else [(c_custkey % 4)::int] end) as page from customer where c_custkey % 6 not in (1, 2)) select doc, field, string_agg(distinct page::varchar, ',' order by page::varchar) as pages from p group by all")
def pdf_field_pages(spark, d):
    return P.field_pages(*graph(spark, d)).select("doc", "field", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("select s_suppkey as doc, case s_suppkey % 7 when 0 then 'E_FIELDS' when 1 then 'E_FIELDS' when 2 then 'E_UNSUPPORTED' when 3 then 'E_UNSUPPORTED' when 4 then 'E_UNSUPPORTED' end as code from supplier")
def pdf_field_list(spark, d):
    k = F.col("s_suppkey") % 7
    f = lambda no, name, kind, ro, comb, n, seen: F.struct(F.lit(no).alias("no"), name.alias("name"), kind.alias("kind"), ro.alias("read_only"), F.lit(False).alias("rich"), F.lit(False).alias("password"), F.lit(False).alias("file"), comb.alias("comb"), n.alias("widgets"), seen.alias("visible"))
    yes, no_, one = F.lit(True), F.lit(False), F.lit(1)
    own = F.array(f(0, F.lit("a"), F.lit("text"), k == 2, no_, one, yes), f(1, F.when(k == 0, "a").when(k == 1, "").otherwise("b"), F.when(k == 3, "choice").otherwise("checkbox"), no_, no_, one, k != 4), f(2, F.lit("s"), F.lit("signature"), yes, no_, F.lit(0), no_))
    return P.field_verdict(t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.inline(own)), "doc")


@query("select event_id % 500 as doc, case when bool_or(event_id % 997 = 0 or event_id % 1009 = 1 or event_id % 1013 = 2) then 'E_UNSUPPORTED' end as code from events group by 1")
def pdf_active_content(spark, d):
    k = F.col("event_id")
    e = t(spark, d, "events").select((k % 500).alias("doc"), F.when(k % 997 == 0, "OpenAction").when(k % 1009 == 1, "S").when(k % 1013 == 2, "FT").when(k % 3 == 0, "FT").otherwise("Kids").alias("key"), F.when(k % 1009 == 1, "Launch").when(k % 1013 == 2, "Sig").when(k % 3 == 0, "Sig").otherwise("Tx").alias("value"), ((k % 1013 != 2) & (k % 3 == 0)).alias("signature_empty"))
    return P.active_content(e, "doc")


@query(r"with n as (select c_nationkey as doc, case when c_custkey % 3 = 0 then 'name_' || c_custkey when c_custkey % 3 = 1 then 'field ' || c_custkey else 'field_' || substr(sha256('field ' || (c_custkey - 25)), 1, 12) end as name from customer), l as (select doc, name, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]{0,63}') as legal from n) select doc, name, case when legal then name when exists (select 1 from l as o where o.doc = l.doc and o.name = 'field_' || substr(sha256(l.name), 1, 12)) then 'field_' || substr(sha256(name), 1, 16) else 'field_' || substr(sha256(name), 1, 12) end as alias from l")
def pdf_alias_collisions(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("name_"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("field "), k.cast("string"))).otherwise(F.concat(F.lit("field_"), F.substring(F.sha2(F.concat(F.lit("field "), (k - 25).cast("string")), 256), 1, 12)))
    return P.aliases(t(spark, d, "customer").select(F.col("c_nationkey").alias("doc"), name.alias("name")), "doc")


@query("select c_custkey as doc, case c_custkey % 8 when 0 then 'type' when 1 then 'length' when 2 then 'glyph' when 3 then 'line-end' when 4 then 'overflow' when 5 then 'type' end as reason, case c_custkey % 8 when 2 then 'E_UNSUPPORTED' when 6 then null when 7 then null else 'E_FIELDS' end as code from customer")
def pdf_value_verdict(spark, d):
    k, c = F.col("c_custkey") % 8, t(spark, d, "customer")
    v = c.select(F.col("c_custkey").alias("doc"), F.lit("f").alias("field"), F.when(k.isin(5, 6), "checkbox").otherwise("text").alias("kind"), F.when(k == 0, None).when(k == 1, F.repeat(F.lit("\U0001f600"), 20)).when(k == 2, F.concat("c_name", F.lit("中"))).when(k == 3, F.concat(F.lit("a\n"), F.lit("b"))).when(k == 4, F.repeat(F.lit("a"), 39)).otherwise(F.substring("c_name", 1, 9)).alias("value"), F.when(k == 6, False).alias("checked"), F.lit(39).alias("max_units"), (k != 3).alias("multiline"), F.lit(10).alias("columns"), F.lit(3).alias("lines"))
    glyphs = c.select(F.explode(F.split(F.concat("c_name", F.lit("ab\U0001f600")), "")).alias("ch")).distinct()
    return P.value_verdict(v, glyphs).select("doc", "reason", "code")


@query("select s_suppkey as id, case when s_suppkey % 3 = 0 or length(s_name) * 5 > 80 + s_suppkey % 7 * 5 then 'label-overflow' end as reason from supplier")
def pdf_label_verdict(spark, d):
    s = t(spark, d, "supplier")
    labels = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("中")).otherwise(F.col("s_name")).alias("text"), BOX(0, 0, (80 + F.col("s_suppkey") % 7 * 5).cast("double"), 12).alias("box"))
    return P.label_verdict(labels, s.select(F.explode(F.split("s_name", "")).alias("ch")).distinct())


@query("select c_nationkey as doc, c_custkey as field, case c_custkey % 5 when 0 then 'no-appearance' when 1 then 'no-font' when 2 then 'no-appearance' end as reason from customer")
def pdf_appearances(spark, d):
    k = F.col("c_custkey") % 5
    w = t(spark, d, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("field"), F.when(k.isin(2, 3), "checkbox").otherwise("text").alias("kind"), F.when(k == 2, "On").otherwise("Yes").alias("state"), F.array(F.lit("Off"), F.lit("Yes")).alias("states"), F.when(k == 0, 0).otherwise(9).alias("bytes"), (k != 1).alias("embedded"))
    return P.appearances(w)


@query("select p_partkey as doc, case p_partkey % 6 when 0 then 'changed' when 1 then 'added' when 2 then 'removed' when 3 then 'changed' end as reason from part")
def pdf_page_changes(spark, d):
    p, k = t(spark, d, "part").select(F.col("p_partkey").alias("doc"), "p_name"), F.col("doc") % 6
    stream = lambda no, x: F.struct(F.lit(no).alias("no"), F.sha2(x if not isinstance(x, str) else F.lit(x), 256).alias("sha256"))
    name = F.col("p_name")
    before = p.filter("doc % 6 <> 1").select("doc", F.lit(1).alias("page"), F.inline(F.array(stream(0, name), stream(1, "b"))))
    noted = F.array(stream(0, "q"), stream(1, name), stream(2, "b"), stream(3, "Q"), stream(4, "note"))
    after = p.filter("doc % 6 <> 2").select("doc", F.lit(1).alias("page"), F.inline(F.when(k.isin(3, 4), noted).when(k == 0, F.array(stream(0, "x"), stream(1, "b"))).otherwise(F.array(stream(0, name), stream(1, "b")))))
    return P.page_changes(before, after, p.filter("doc % 6 = 4").select("doc", F.lit(1).alias("page"))).select("doc", "reason")


@query("select p_partkey as id, p_partkey % 3 = 0 as same from part")
def canonical_dictionary(spark, d):
    k = F.col("p_partkey")
    a = F.create_map(F.lit("x"), F.col("p_name"), F.lit("y"), F.col("p_brand"))
    b = F.create_map(F.lit("y"), F.col("p_brand"), F.lit("x"), F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("!"))))
    return t(spark, d, "part").select(k.alias("id"), (P.canonical(a) == P.canonical(b)).alias("same"))


@query("select c_custkey as k, c_custkey % 2 = 0 and c_custkey > 0 as monotone from customer")
def monotone_starts(spark, d):
    k = F.col("c_custkey")
    n = F.when(k % 2 == 0, F.array(F.lit(0).cast("long"), k, k + 1)).otherwise(F.array(F.lit(0).cast("long"), k, k))
    return t(spark, d, "customer").select(k.alias("k"), W.rising(n).alias("monotone"))


def forms(spark, d):
    """A form for each brand: parts of type Tx or Btn, one of them a choice or twice where the brand says so."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "Btn").when((F.col("p_brand") == "Brand#11") & (k % 50 == 1), "Ch").otherwise("Tx")
    name = F.when(k % 2 == 0, F.concat(F.lit("part "), k.cast("string"))).otherwise(F.concat(F.lit("part_"), k.cast("string")))
    fields = F.array_sort(F.collect_list(F.struct(k.alias("k"), name.alias("name"), kind.alias("kind"))))
    return t(spark, d, "part").groupBy(F.concat("p_brand", F.lit(".pdf")).alias("path")).agg(fields.alias("fields"))


@query("select p_brand || '.pdf' as path, case when p_partkey % 2 = 0 then 'part ' else 'part_' end || p_partkey as name, case when p_partkey % 3 = 0 then 'checkbox' when p_brand = 'Brand#11' and p_partkey % 50 = 1 then 'choice' else 'text' end as kind, row_number() over (partition by p_brand order by p_partkey) - 1 as no, true as visible from part")
def pdf_form_fields(spark, d):
    return D.field_rows(D.make_forms(forms(spark, d))).select("path", "name", "kind", F.col("no").cast("long").alias("no"), "visible")


@query("select p_brand || '.pdf' as path, case when bool_or(p_brand = 'Brand#11' and p_partkey % 50 = 1 and p_partkey % 3 <> 0) then 'E_UNSUPPORTED' end as code, case when not bool_or(p_brand = 'Brand#11' and p_partkey % 50 = 1 and p_partkey % 3 <> 0) then count(*) else 0 end as fields from part group by 1")
def pdf_inspect(spark, d):
    from formloom.plans import engine

    return engine.inspect(D.make_forms(forms(spark, d))).select("path", "code", F.size("fields").cast("long").alias("fields"))
