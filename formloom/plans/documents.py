"""Queries on whole documents: packages are made from table rows, opened, inspected, filled and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.operators import catalog as K
from formloom.operators import layout as L
from formloom.operators.lineage import cut
from formloom.plans import engine
from formloom.plans.registry import query, t
from formloom.sources import containers, markup, packages

# One expression for both engines: the lines of each customer's document, its format, and the values that are asked for.
FORM = "case when c_custkey % 2 = 0 then 'docx' else 'hwpx' end"
PATH = f"'in/' || c_custkey || '.' || {FORM}"
SECOND = "case c_custkey % 9 when 1 then 'open {{name' when 2 then '{{1 a}}' when 3 then 'no more' when 4 then '}}' else 'To {{name}}: {{note}} <&> {{name}}' end"
FIRST = "case when c_custkey % 9 in (3, 8) then 'plain' else 'Re {{number}}' end"


def made(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.expr(PATH).alias("path"), F.expr(FORM).alias("format"), F.array(F.expr(FIRST), F.expr(SECOND)).alias("lines"))
    return cut(packages.make_packages(c))  # read by several readers


CODE = f"case c_custkey % 9 when 1 then 'E_FIELDS' when 2 then case when {FORM} = 'docx' then 'E_UNSUPPORTED' else 'E_FIELDS' end when 4 then 'E_FIELDS' end"
FIELDS = "case c_custkey % 9 when 1 then '' when 2 then '' when 4 then '' when 3 then '' when 8 then 'name:2,note:1' else 'number:1,name:2,note:1' end"


@query(f"select {PATH} as path, {FORM} as format, {CODE} as code, {FIELDS} as fields, 'incomplete' as status from customer")
def inspect_report(spark, d):
    r = engine.inspect(made(spark, d))
    listed = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["occurrences"].cast("string"))), ",")
    return r.select("path", "format", "code", listed.alias("fields"), F.col("completion.status").alias("status"))


VALUES = """case when c_custkey % 11 = 1 then '{"name": "x"}' when c_custkey % 11 = 2 then 'not json' when c_custkey % 11 = 3 then '{"name": "' || c_name || '", "note": " ", "number": "1"}' when c_custkey % 9 = 8 then '{"name": "' || c_name || '", "note": "a' || chr(92) || 'nb"}' else '{"name": "' || c_name || '", "note": "' || c_mktsegment || '", "number": "' || c_custkey || '"}' end"""
OUTPUT = f"case when c_custkey % 13 = 1 then 'out/' || c_custkey || '.pdf' when c_custkey % 13 = 2 then {PATH} else 'out/' || c_custkey || '.' || {FORM} end"
REQUEST = f"""(select c_custkey, c_name, c_mktsegment, {PATH} as path, {FORM} as form, {OUTPUT} as output, {FIRST} as first, {SECOND} as second, coalesce({CODE}, case when c_custkey % 9 = 3 then 'E_FIELDS' when c_custkey % 11 in (1, 2, 3) then 'E_FIELDS' when c_custkey % 13 = 1 then 'E_INPUT' when c_custkey % 13 = 2 or c_custkey % 17 = 1 then 'E_OUTPUT_EXISTS' end) as code,
case when {CODE} is null and c_custkey % 9 <> 3 then case c_custkey % 11 when 1 then 'missing' when 2 then 'not-object' when 3 then case when c_custkey % 9 = 8 then 'unknown-field' else 'blank' end end end as reason from customer)"""


def asked(spark, d):
    return t(spark, d, "customer").select(F.expr(PATH).alias("path"), F.expr(VALUES).alias("values"), F.expr(OUTPUT).alias("output"), F.lit("preserve").alias("overflow"), (F.col("c_custkey") % 17 == 1).alias("output_exists"))


@query(f"""select path, code, case when code = 'E_FIELDS' then reason end as reason, case when code is null then output end as output, case when code is null then case when form = 'docx' then 'field-values-reread,untouched-package-parts' else 'exact-field-values,untouched-entries' end else '' end as checks, case when code is null then case when c_custkey % 9 = 8 then 2 else 3 end else 0 end as verified from {REQUEST}""")
def fill_report(spark, d):
    report, _ = engine.fill(made(spark, d), asked(spark, d))
    return report.select("path", "code", "reason", "output", F.coalesce(F.array_join("checks", ","), F.lit("")).alias("checks"), F.col("completion.verified_fields").alias("verified"))


@query(f"""select output as path, unnest([replace(first, '{{{{number}}}}', c_custkey::varchar), replace(replace(second, '{{{{name}}}}', c_name), '{{{{note}}}}', case when c_custkey % 9 = 8 then 'a' || chr(10) || 'b' else c_mktsegment end)]) as text, unnest([0, 1]) as para_no from {REQUEST} where code is null""")
def fill_reread(spark, d):
    _, filled = engine.fill(made(spark, d), asked(spark, d))
    again = packages.package_rows(filled.withColumn("format", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))))
    return again.filter("text is not null").select("path", "text", "para_no")


@query(f"select {PATH} as path, {CODE} is null or {CODE} = 'E_FIELDS' as fine, case when {CODE} is null or {CODE} = 'E_FIELDS' then case when {FORM} = 'docx' then 'docx-container,xml-well-formed' else 'hwpx-structure' end end as checks, 'structure-only' as scope from customer")
def validate_report(spark, d):
    return engine.validate(made(spark, d)).select("path", F.col("code").isNull().alias("fine"), F.array_join("checks", ",").alias("checks"), F.col("completion.verification_scope").alias("scope"))


@query("select doc_id, 'p' as local, 1::bigint as depth_from_body, count(*) as n, sum(length(x))::bigint as chars from (select doc_id, unnest(string_split(text, chr(10))) as x from documents) group by doc_id")
def node_tree(spark, d):
    """Paragraph elements of packages made from the documents, and the characters of their texts by way of parents."""
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("docx").alias("format"), F.split("text", "\n", -1).alias("lines"))
    bodies = containers.parts(packages.make_packages(docs)).filter("part = 'word/document.xml'")
    n = markup.node_rows(bodies)
    # a part has one body: one pass over the nodes, which nothing stores
    of = lambda local, c: F.when(F.col("local") == local, c)
    per = n.groupBy("path").agg(F.count(of("p", F.lit(1))).alias("n"), (F.max(of("p", F.col("depth"))) - F.max(of("body", F.col("depth")))).cast("long").alias("depth_from_body"), F.sum(of("#text", F.length("text"))).alias("chars"))
    return per.filter("depth_from_body is not null").select(F.col("path").cast("long").alias("doc_id"), F.lit("p").alias("local"), "depth_from_body", "n", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))


FIELD = """'{"name": "title", "type": "text", "maxLength": ' || (p_size + 10) || '}'"""
MANIFEST = f"""case when p_partkey % 13 = 0 then '{{bad' else '{{"schemaVersion": ' || case when p_partkey % 17 = 0 then 2 else 1 end || ', "id": "' || case when p_partkey % 19 = 0 then 'Other Id' when p_partkey % 23 = 0 then 'elsewhere' else 't-' || (p_partkey % 150) end || '", "title": "' || case when p_partkey % 29 = 0 then ' ' else p_name end || '", "format": "docx", "file": "template.' || case when p_partkey % 31 = 0 then 'pdf' else 'docx' end || '", "sha256": "' || sha || '", "fields": [' || case when p_partkey % 37 = 0 then '' else {FIELD} end || ']}}' end"""
ORIGIN = "case when p_partkey % 3 = 0 then 'user' else 'bundled' end"
ENTRIES = f"""(select p_partkey, p_name, name, origin, warning, case when warning is null and row_number() over (partition by name, warning is null order by origin <> 'bundled', folder) > 1 then 'E_INPUT' end as dup from (select p_partkey, p_name, 't-' || (p_partkey % 150) as name, {ORIGIN} as origin, 'x/' || lpad(p_partkey::varchar, 9, '0') || '/' as folder,
case when p_partkey % 13 = 0 or p_partkey % 17 = 0 or p_partkey % 19 = 0 or p_partkey % 29 = 0 or p_partkey % 31 = 0 then 'E_INPUT' when p_partkey % 37 = 0 then 'E_FIELDS' when p_partkey % 23 = 0 then 'E_INPUT' end as warning from part))"""


def manifests(spark, d):
    p = t(spark, d, "part").withColumn("sha", F.sha2(F.col("p_name").cast("binary"), 256))
    json = F.expr(MANIFEST)
    text = F.when(F.try_parse_json(json).isNotNull(), json)
    rows = p.select(F.concat(F.lit("t-"), (F.col("p_partkey") % 150).cast("string")).alias("name"), F.expr(ORIGIN).alias("origin"), text.alias("json"), F.concat(F.lit("x/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("/")).alias("folder"))
    return K.entries(rows)


@query(f"select name as id, p_name as title, 'docx' as format, origin, 'x/' || lpad(p_partkey::varchar, 9, '0') || '/template.docx' as file, 1 as fields from {ENTRIES} where warning is null and dup is null")
def templates_list(spark, d):
    return K.listing(manifests(spark, d))


@query(f"select 'W_INVALID_TEMPLATE' as code, name as id, coalesce(warning, dup) as reason, count(*) as n from {ENTRIES} where coalesce(warning, dup) is not null group by all")
def templates_warnings(spark, d):
    return K.warnings(manifests(spark, d)).groupBy("code", "id", "reason").agg(F.count("*").alias("n"))


@query(f"with e as (select * from {ENTRIES} where warning is null and dup is null) select w.id, e.p_name as title, e.origin, case when e.name is null then 'E_INPUT' end as error from (select 't-' || s_suppkey as id from supplier) as w left join e on e.name = w.id")
def templates_show(spark, d):
    wanted = t(spark, d, "supplier").select(F.concat(F.lit("t-"), F.col("s_suppkey").cast("string")).alias("id"))
    return K.show(manifests(spark, d), wanted).select("id", F.col("manifest.title").alias("title"), "origin", "error")


@query(f"""with e as (select name from {ENTRIES} where warning is null and dup is null), n as (select case when c_custkey % 10 = 0 then 'No Id' else 't-' || (c_custkey % 400) end as id, case when c_custkey % 7 = 0 then ' ' when c_custkey % 11 = 0 then repeat('x', 201) else c_name end as title, sha256(c_name) as sha, c_custkey % 12 = 0 as bare from customer),
r as (select *, row_number() over (partition by id order by sha, title) as nth from n)
select id, case when id = 'No Id' or trim(title) = '' or length(title) > 200 then 'E_INPUT' when id in (select name from e) or nth > 1 then 'E_OUTPUT_EXISTS' when bare then 'E_FIELDS' end as error, case when id = 'No Id' or trim(title) = '' or length(title) > 200 or id in (select name from e) or nth > 1 or bare then null else title end as title from r""")
def templates_register(spark, d):
    k = F.col("c_custkey")
    field = F.from_json(F.lit('[{"name": "a", "type": "text"}]'), f"array<{K.V.FIELD}>")
    id_ = F.when(k % 10 == 0, "No Id").otherwise(F.concat(F.lit("t-"), (k % 400).cast("string")))
    title = F.when(k % 7 == 0, " ").when(k % 11 == 0, F.repeat(F.lit("x"), 201)).otherwise(F.col("c_name"))
    new = t(spark, d, "customer").select(id_.alias("id"), title.alias("title"), F.lit("docx").alias("format"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha256"), F.when(k % 12 == 0, F.array().cast(f"array<{K.V.FIELD}>")).otherwise(field).alias("fields"))
    return K.registration(new, manifests(spark, d)).select("id", "error", F.col("manifest.title").alias("title"))


@query("select unnest(['docx', 'hwp', 'hwpx', 'pdf']) as format, unnest([true, false, false, true]) as ready, unnest([null, 'E_INPUT', 'E_FIELDS', null]) as code")
def doctor(spark, d):
    """A manifest for each region: two of one id, one whose format isn't its file's, one without fields."""
    k = F.col("r_regionkey")
    form = F.element_at(F.array(*map(F.lit, ("docx", "hwp", "hwpx", "pdf", "docx"))), (k + 1).cast("int"))
    fields = F.when(k == 2, "").otherwise('{"name": "a", "type": "text"}')
    json = F.concat(F.lit('{"schemaVersion": 1, "title": "Report", "id": "report-'), form, F.lit('", "format": "'), form, F.lit('", "file": "template.'), F.when(k == 1, "pdf").otherwise(form), F.lit('", "sha256": "'), F.sha2(F.col("r_name").cast("binary"), 256), F.lit('", "fields": ['), fields, F.lit("]}"))
    rows = t(spark, d, "region").select(F.concat(F.lit("report-"), form).alias("name"), F.lit("bundled").alias("origin"), json.alias("json"), F.concat(F.lit("x"), k.cast("string"), F.lit("/")).alias("folder"))
    return K.doctor(K.entries(rows))


@query("select s_suppkey as id, s_suppkey % 7 in (0, 1) as changed from supplier")
def source_unchanged(spark, d):
    s, k = t(spark, d, "supplier"), F.col("s_suppkey")
    before = s.select(k.alias("path"), F.col("s_name").cast("binary").alias("content"))
    after = s.filter("s_suppkey % 7 <> 1").select(k.alias("path"), F.when(k % 7 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).cast("binary").alias("content"))
    return engine.unchanged(before, after).select(F.col("path").alias("id"), F.col("code").isNotNull().alias("changed"))


PROFILE = """case s_suppkey % 8 when 0 then '[]' when 1 then '{"version": 2, "format": "hwpx", "templateSha256": "' || sha || '"}' when 2 then '{"version": 1, "format": "docx", "templateSha256": "' || sha || '"}' when 3 then '{"version": 1, "format": "pdf", "templateSha256": "' || sha || '"}' when 4 then '{"version": 1, "format": "hwpx", "templateSha256": "' || repeat('a', 64) || '"}' when 5 then '{"version": 1, "format": "hwpx", "templateSha256": "x"}' else '{"version": 1, "format": "hwpx", "templateSha256": "' || sha || '"}' end"""


@query("select s_suppkey, case s_suppkey % 8 when 0 then 'E_INPUT' when 1 then 'E_INPUT' when 2 then 'E_INPUT' when 3 then 'E_UNSUPPORTED' when 4 then 'E_TEMPLATE_CHANGED' when 5 then 'E_INPUT' when 6 then 'E_UNSUPPORTED' end as code from supplier")
def profile_verdict(spark, d):
    s = t(spark, d, "supplier").withColumn("sha", F.sha2(F.col("s_name").cast("binary"), 256))
    return s.select("s_suppkey", engine.profile_verdict(F.try_parse_json(F.expr(PROFILE)), F.lit("hwpx"), F.col("sha"), F.col("s_suppkey") % 8 == 6).alias("code"))


@query("select user_id, min_by(code, event_id) as code from (select user_id, event_id, case event_id % 6 when 0 then 'E_IO' when 1 then 'E_ENGINE' end as code from events) where code is not null group by user_id")
def first_failure(spark, d):
    """The earliest failure decides; a code that isn't public is an engine failure."""
    code = F.when(F.col("event_id") % 6 == 0, "E_IO").when(F.col("event_id") % 6 == 1, "TypeError")
    e = t(spark, d, "events").select("user_id", "event_id", engine.public_code(code).alias("code"))
    return engine.first_failures(e, "user_id", "event_id", "code")


@query("select s_suppkey as id, case when s_suppkey % 5 in (0, 1, 2, 3) then 'E_PRESERVATION' end as loss, case when s_suppkey % 2 = 0 then 'E_UNSUPPORTED' end as parts from supplier")
def preservation_reports(spark, d):
    k = F.col("s_suppkey")
    report = F.when(k % 5 == 0, '{"count": 1, "losses": []}').when(k % 5 == 1, '{"count": 0, "losses": [{"part": "x"}]}').when(k % 5 == 2, '{"count": 0}').when(k % 5 == 3, "[]").otherwise('{"count": 0, "losses": []}')
    parts = F.when(k % 2 == 0, F.array(F.lit("word/document.xml"), F.lit("word/comments.xml"))).otherwise(F.array(F.lit("word/document.xml")))
    handled = F.array(F.lit("word/document.xml"), F.lit("word/footer1.xml"))
    return t(spark, d, "supplier").select(k.alias("id"), K.V.loss_verdict(F.try_parse_json(report)).alias("loss"), K.V.unhandled(parts, handled).alias("parts"))


@query("""with f as (select p_brand, p_partkey, 'part_' || p_partkey as name, p_name as label, p_size as n from part)
select p_brand as id, 'Form ' || p_brand || chr(10) || string_agg(label || ': {{' || name || '}}', chr(10) order by p_partkey) as lines, count(*)::int as fields, '{' || string_agg('"' || name || '":"' || substr('Example ' || label, 1, n) || '"', ',' order by p_partkey) || '}' as example from f group by p_brand""")
def generated_templates(spark, d):
    field = F.struct("p_partkey", F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("label"), F.col("p_size").alias("max_length"))
    x = t(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_list(field)).alias("fields")).withColumn("title", F.concat(F.lit("Form "), "id")).withColumn("format", F.lit("docx"))
    return K.generated(x).select("id", F.array_join("lines", "\n").alias("lines"), F.size("fields").alias("fields"), "example")


@query("select doc_id as doc, case when doc_id % 5 = 0 then 0 else len(string_split(text, chr(10))) + 1 end::bigint as no, case when doc_id % 5 = 0 then 'changed' else 'left-over' end as reason from documents where doc_id % 5 < 2")
def paragraph_fan_out_reread(spark, d):
    """A text that became as many paragraphs as it has lines, and one after it; some changed, some with one more."""
    docs, k = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), F.col("doc") % 5
    lines = F.split("text", "\n", -1)
    before = docs.select("doc", F.inline(F.array(F.struct(F.lit(0).alias("no"), F.col("text").alias("text"), F.size(lines).alias("n")), F.struct(F.lit(1).alias("no"), F.lit("end").alias("text"), F.lit(1).alias("n")))))
    now = F.concat(F.when(k == 0, F.concat(F.array(F.lit("other")), F.slice(lines, 2, F.size(lines)))).otherwise(lines), F.array(F.lit("end")), F.when(k == 1, F.array(F.lit("more"))).otherwise(F.array().cast("array<string>")))
    return L.fan_out_changes(before, docs.select("doc", F.posexplode(now).alias("no", "text")), "doc")


@query("select format, count(*) as documents, count(*) filter (code is null) as fine from (select 'pdf' as format, case when bool_or(p_brand = 'Brand#11' and p_partkey % 50 = 1 and p_partkey % 3 <> 0) then 'E_UNSUPPORTED' end as code from part group by p_brand union all select " + FORM + ", " + CODE + " from customer) group by format")
def inspect_formats(spark, d):
    """Documents of several formats in one table: each goes to the reader of its format."""
    from formloom.plans import forms
    from formloom.sources import pdf

    all_ = made(spark, d).select("path", "content").unionByName(pdf.make_forms(forms.forms(spark, d)))
    return engine.inspect(all_).groupBy("format").agg(F.count("*").alias("documents"), F.count_if(F.col("code").isNull()).alias("fine"))
