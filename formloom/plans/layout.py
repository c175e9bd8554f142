"""Queries of the positional operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.operators import layout as L
from formloom.operators import records as R
from formloom.plans.registry import query, t

LINES = "(select l_orderkey as doc, l_linenumber::bigint as no, max(l_quantity)::bigint as n from lineitem group by all)"


def lines(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("no")).agg(F.max("l_quantity").cast("long").alias("n"))


@query(f"""with b as (select doc, no % 5 as id, no * 10 as start from {LINES}), e as (select doc, no % 5 as id, no * 10 + case when no % 3 = 0 then 12 when no % 2 = 0 then -1 else 5 end as stop from {LINES} where no % 4 <> 0),
g as (select doc, id, count(start) as b, count(stop) as e, min(start) as start, min(stop) as stop from (select doc, id, start, null as stop from b union all select doc, id, null, stop from e) group by all),
v as (select *, case when b > 1 or e > 1 then 'duplicate' when b = 0 or e = 0 then 'unpaired' when stop <= start then 'reversed' end as own from g)
select doc, id, start, stop, coalesce(own, case when exists (select 1 from v as p where p.doc = v.doc and p.own is null and p.start < v.start and p.stop > v.start) then 'overlap' end) as verdict from v""")
def click_here_pairs(spark, d):
    x = lines(spark, d)
    no, key = F.col("no"), (F.col("no") % 5).alias("id")
    b = x.select("doc", key, (no * 10).alias("start"))
    e = x.filter("no % 4 <> 0").select("doc", key, (no * 10 + F.when(no % 3 == 0, 12).when(no % 2 == 0, -1).otherwise(5)).alias("stop"))
    return L.paired_fields(b, e, "doc")


@query("""select coalesce(c.k, o.k) as k, coalesce(o.n, 0)::bigint as n_left, coalesce(c.n, 0)::bigint as n_right, case when o.n is null or c.n is null then 'orphan' when o.n > 1 or c.n > 1 then 'duplicate' end as verdict
from (select o_custkey as k, count(*) as n from orders group by 1) as o full join (select c_custkey as k, count(*) as n from customer group by 1) as c on o.k = c.k""")
def widget_one_to_one(spark, d):
    return L.one_to_one(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("select p_partkey, case when p_partkey % 13 = 0 then 'removed' else 'changed' end as verdict from part where (p_partkey % 13 = 0 or p_partkey % 10 = 0) and p_partkey % 20 <> 0 union all select -p_partkey, 'added' from part where p_partkey % 17 = 0 and p_partkey % 20 <> 0")
def unchanged_parts(spark, d):
    p, k = t(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey")
    after = p.filter("p_partkey % 13 <> 0").withColumn("p_name", F.when(k % 10 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    more = p.filter("p_partkey % 17 = 0").select((-k).alias("p_partkey"), "p_name")
    may = p.filter("p_partkey % 20 = 0").select("p_partkey").unionByName(p.filter("p_partkey % 20 = 0").select((-k).alias("p_partkey")))
    return L.difference(p, after.unionByName(more), ["p_partkey"], "p_name", may)


@query(f"select doc, no, coalesce(sum(n) over w, 0)::bigint as first, (coalesce(sum(n) over w, 0) + n - 1)::bigint as last from {LINES} window w as (partition by doc order by no rows between unbounded preceding and 1 preceding)")
def paragraph_fan_out(spark, d):
    return L.fan_out(lines(spark, d), "doc", "no", "n")


@query(f"with m as (select doc, no * 25 as start, no as mark from {LINES}) select doc, no as id, no * 10 as start, (select min(mark) from m where m.doc = x.doc and m.start > x.no * 10) as mark from {LINES} as x")
def following_section(spark, d):
    x, no = lines(spark, d), F.col("no")
    return L.following(x.select("doc", no.alias("id"), (no * 10).alias("start")), x.select("doc", (no * 25).alias("start"), no.alias("mark")), "doc")


@query("with p as (select distinct conv_id, turn + turn // 3 as page from conversations) select conv_id, page, coalesce(page = lag(page) over (partition by conv_id order by page) + 1, true) as ok from p")
def consecutive_pages(spark, d):
    p = t(spark, d, "conversations").select("conv_id", F.expr("turn + turn div 3").alias("page")).distinct()
    return L.consecutive(p, "conv_id", "page")


@query("with s as (select c_nationkey as doc, c_mktsegment as style, max(c_custkey) as m from customer group by all) select doc, style, (max(m) over (partition by doc) + row_number() over (partition by doc order by style))::bigint as new_id from s")
def clone_style_ids(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("style"), "c_custkey")
    return L.style_clones(c, "doc", "style", "c_custkey")


@query(f"select doc, no, row_number() over (partition by doc order by no) - 1 as row_addr, coalesce(sum(n) over (partition by doc order by no rows between unbounded preceding and 1 preceding), 0)::bigint as top, (sum(n) over (partition by doc))::bigint as table_height from {LINES}")
def row_readdressing(spark, d):
    return L.readdressed(lines(spark, d), "doc", ["no"], "n")


@query("select user_id, sum(n - 1)::bigint as added, sum(n - 1) > 256 as over from (select user_id, event_type, count(*) as n from events group by all) group by user_id")
def added_page_count(spark, d):
    return L.added_pages(t(spark, d, "events"), "user_id", "event_type")


@query(f"select doc, min(no) filter (n > 30) as before from {LINES} group by doc")
def property_insertion(spark, d):
    return L.insert_before(lines(spark, d), "doc", "no", "n", 30)


@query("select c_custkey as k, coalesce(s_name, p_name) as name, case when s_name is not null then 'file' when p_name is not null then 'catalog' end as origin from customer left join supplier on c_custkey = s_suppkey left join part on c_custkey * 3 = p_partkey")
def fill_target_lookup(spark, d):
    part = t(spark, d, "part").filter("p_partkey % 3 = 0").select(F.expr("p_partkey div 3").alias("k"), F.col("p_name").alias("name"))
    return L.lookup(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), part, "k", "name")


@query("select doc_id, sha256(substr(text, 1, 3) || repeat(' ', greatest(0, least(5, length(text) - 3))) || substr(text, 9)) as sha from documents")
def masked_discovery(spark, d):
    taken = F.array(F.struct(F.lit(3).alias("start"), F.lit(8).alias("stop")))
    return t(spark, d, "documents").select("doc_id", F.sha2(X.mask(F.col("text"), taken).cast("binary"), 256).alias("sha"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'marker' end as verdict from customer")
def strict_value_verdict(spark, d):
    v = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("{{"), F.col("c_name"))).otherwise(F.col("c_name"))
    return t(spark, d, "customer").select("c_custkey", X.strict_verdict(v).alias("verdict"))


@query("select p_partkey, case when p_partkey % 5 > 0 then (p_size % 7 + 0.5)::double end as size from part")
def last_font_size(spark, d):
    size = (F.col("p_size") % 7 + F.lit(0.5)).cast("string")
    tf = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("/F1 99 Tf 0 g /F2 "), size, F.lit(" Tf"))).otherwise("0 g")
    return t(spark, d, "part").select("p_partkey", X.last_font_size(tf).alias("size"))


@query("select p_partkey, p_size % 4 = p_partkey % 4 and p_partkey % 11 <> 0 as balanced from part")
def graphics_balance(spark, d):
    k = F.col("p_partkey")
    stream = F.concat(F.expr("repeat('q ', p_size % 4)"), F.lit("1 0 0 rg "), F.expr("repeat('Q ', int(p_partkey % 4))"), F.when(k % 11 == 0, "BI ").otherwise(""))
    return t(spark, d, "part").select("p_partkey", X.balanced_state(stream).alias("balanced"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then '<tc dirty="' || p_size || '&amp;$1"/>' else '<tc id="3" dirty="' || p_size || '&amp;$1">' end as tag from part""")
def attribute_patch(spark, d):
    tag = F.when(F.col("p_partkey") % 2 == 0, '<tc dirty="0"/>').otherwise('<tc id="3">')
    return t(spark, d, "part").select("p_partkey", X.set_attribute(tag, "dirty", F.concat(F.col("p_size").cast("string"), F.lit("&$1"))).alias("tag"))


OUT = "case when s_suppkey % 5 = 0 then 'out/' || s_name || '.pdf' when s_suppkey % 3 = 0 then 'in/' || s_name || '.docx' else 'out/' || s_name || '.DOCX' end"


@query(f"select s_suppkey, case when lower(regexp_extract(o, '\\.([A-Za-z0-9]+)$', 1)) <> 'docx' then 'extension' when o = 'in/' || s_name || '.docx' then 'same-path' when s_suppkey % 7 = 0 then 'exists' end as verdict from (select *, {OUT} as o from supplier)")
def output_preconditions(spark, d):
    source = F.concat(F.lit("in/"), "s_name", F.lit(".docx"))
    return t(spark, d, "supplier").select("s_suppkey", X.output_verdict(source, F.expr(OUT), F.col("s_suppkey") % 7 == 0).alias("verdict"))


#: Styles in trees of twenty parts: a part's parent is half its number, but for a few that point nowhere, to another type or in a circle.
STYLES = """(select p_partkey // 1000 as doc, p_partkey as id, case when p_partkey % 97 = 0 then 'character' else 'paragraph' end as type,
  case when p_partkey % 1000 < 2 then null when p_partkey % 89 = 0 then -p_partkey when p_partkey % 1000 in (700, 701) then 1401 - p_partkey % 1000 + p_partkey - p_partkey % 1000 else p_partkey - p_partkey % 1000 + p_partkey % 1000 // 2 end as parent,
  p_partkey % 3 = 0 as bold, p_size as size, p_partkey % 5 = 0 as sized, p_brand as brand, p_partkey % 7 = 0 as branded, p_partkey % 101 = 0 as conditional from part)"""


@query(f"""with recursive s as {STYLES},
l as (select s.*, p.id is null and s.parent is not null as lost, coalesce(p.type <> s.type, false) as other from s left join s as p on p.doc = s.doc and p.id = s.parent),
w as (select *, case when conditional then 'conditional-style' when lost then 'missing-style' when other then 'ambiguous-style' end as own from l),
r(doc, id, nxt, depth, bold, size, brand, reason, round) as (select doc, id, case when own is null then parent end, 0::bigint, case when bold then '1' end, case when sized then size::varchar end, case when branded then brand end, own, false from w
  union all select r.doc, r.id, case when w.own is null then w.parent end, r.depth + 1, coalesce(r.bold, case when w.bold then '1' end), coalesce(r.size, case when w.sized then w.size::varchar end), coalesce(r.brand, case when w.branded then w.brand end), w.own, r.depth > 30
  from r join w on w.doc = r.doc and w.id = r.nxt where not r.round)
select doc, id, case when not round then depth end as depth, case when not round then bold end as bold, case when not round then size end as size, case when not round then brand end as brand, case when round then 'cyclic-style' else reason end as reason from r where nxt is null or round""")
def style_properties(spark, d):
    """All properties of all styles, with what makes a style's chain ambiguous."""
    k, size = F.col("p_partkey"), F.lit(1000)
    low = k % size
    parent = F.when(low < 2, None).when(k % 89 == 0, -k).when(low.isin(700, 701), 1401 - low + k - low).otherwise(k - low + F.floor(low / 2))
    entry = lambda name, value, holds: F.when(holds, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    props = F.map_concat(entry("b", F.lit("1"), k % 3 == 0), entry("sz", F.col("p_size").cast("string"), k % 5 == 0), entry("brand", F.col("p_brand"), k % 7 == 0))
    styles = t(spark, d, "part").select(F.floor(k / size).cast("long").alias("doc"), k.alias("id"), F.when(k % 97 == 0, "character").otherwise("paragraph").alias("type"), parent.cast("long").alias("parent"), props.alias("props"), (k % 101 == 0).alias("conditional"))
    held = lambda name: F.try_element_at("props", F.lit(name))
    return R.style_properties(styles, "doc").select("doc", "id", "depth", held("b").alias("bold"), held("sz").alias("size"), held("brand").alias("brand"), "reason")
