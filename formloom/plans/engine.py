"""The whole way of a document: inspect, fill, validate. Each is one plan from tables to a table of reports, a row a document; failures are
codes in it. Checks that need no parsing come first, as in the order of a single document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.functions import text as X
from formloom.functions import values as V
from formloom.operators import coverage as C
from formloom.operators import flow_checks, repeat_fill
from formloom.operators import pages as P
from formloom.operators import tables as T
from formloom.operators.lineage import cut
from formloom.sources import containers, markup, packages, sections
from formloom.sources import hwp as H
from formloom.sources import pdf as D

# Codes that callers may see, and the checks that say that values were read again.
CODES = ("E_INPUT", "E_FIELDS", "E_COVERAGE", "E_LAYOUT", "E_TEMPLATE_CHANGED", "E_UNSUPPORTED", "E_PRESERVATION", "E_OUTPUT_EXISTS", "E_IO", "E_ENGINE")
REREAD = ("field-values-reread", "exact-field-values")
CHECKS = {"docx": ["docx-container", "xml-well-formed"], "hwpx": ["hwpx-structure"], "hwp": ["hwp-reopen"], "pdf": ["pdf-structure"]}
FILL_CHECKS = {"docx": ["field-values-reread", "untouched-package-parts"], "hwpx": ["exact-field-values", "untouched-entries"]}


def public_code(code: Column) -> Column:
    """Codes outside the list are engine failures."""
    return F.when(code.isNull() | code.isin(*CODES), code).otherwise("E_ENGINE")


def envelope(report: Column, code: Column, details: Column) -> Column:
    """What a caller gets as JSON: the report (JSON, too) or an error with its code and details (names and numbers only)."""
    fine = F.concat(F.lit('{"ok":true,"report":'), report, F.lit("}"))
    failed = F.concat(F.lit('{"ok":false,"error":'), F.to_json(F.struct(public_code(code).alias("code"), details.alias("details"))), F.lit("}"))
    return F.when(code.isNull(), fine).otherwise(failed)


def profile_verdict(profile: Column, form: Column, sha256: Column, registered: Column) -> Column:
    """A layout profile (variant): its shape, its format, the document's hash, and that a registered id has none for repeated rows."""
    said = V.string_of(C.get(profile, "templateSha256"))
    named = V.string_of(C.get(profile, "format"))
    version = F.try_variant_get(C.get(profile, "version"), "$", "double")
    shaped = V.is_object(profile) & F.coalesce(version == 1, F.lit(False)) & F.coalesce(named.isin("hwpx", "pdf"), F.lit(False)) & F.coalesce(said.rlike(C.HASH), F.lit(False))
    code = F.when(~shaped, "E_INPUT").when(named != form, "E_UNSUPPORTED").when(said != sha256, "E_TEMPLATE_CHANGED").when(registered & (form == "hwpx"), "E_UNSUPPORTED")
    return F.when(profile.isNotNull(), code)


def discovered(docs: DataFrame) -> DataFrame:
    """path, fields (name, occurrences in the order of their first places), problem of the documents that can be parsed."""
    rows = packages.package_rows(docs).unionByName(H.paragraph_rows(docs)).unionByName(form_rows(docs))
    each = rows.select("path", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.coalesce("para_no", F.lit(0)).alias("para_no"), "text", "error", F.posexplode_outer("fields").alias("k", "f"))
    one = each.groupBy("path", F.col("f.name").alias("name")).agg(F.count("f.name").alias("occurrences"), F.min(F.struct("part_no", "para_no", "k")).alias("at"), F.min("error").alias("error"), F.min(F.when(F.col("text").isNull(), F.col("f.stop")).otherwise(0)).alias("stop"))
    listed = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at", "name", F.col("occurrences").cast("int").alias("occurrences"), "stop"))))
    return one.groupBy("path").agg(listed.alias("found"), F.min("error").alias("problem")).select("path", F.transform("found", as_field).alias("fields"), "problem")


def form_rows(docs: DataFrame) -> DataFrame:
    """The same rows of forms: a field is as many occurrences as it has widgets, under its alias. Active content and fields of other kinds are refused first."""
    own = docs.filter("format = 'pdf'").select("path", "content")
    entries = cut(D.entry_rows(own))
    bad = entries.filter("error is not null").select("path", F.col("error").alias("code")).unionByName(P.active_content(entries.filter("error is null"), "path").filter("code is not null"))
    fields = cut(D.field_rows(own.join(bad, "path", "left_anti")))
    bad = bad.unionByName(fields.filter("error is not null").select("path", F.col("error").alias("code"))).unionByName(P.field_verdict(fields.filter("error is null"), "path").filter("code is not null"))
    fine = fields.filter("kind in ('text', 'checkbox')").join(bad, "path", "left_anti")
    named = fine.join(P.aliases(fine, "path"), ["path", "name"])
    occurrence = F.struct(F.col("alias").alias("name"), F.lit(0).alias("start"), F.when(F.col("kind") == "checkbox", -1).otherwise(F.coalesce("max_units", F.lit(0))).alias("stop"), F.lit(True).alias("explicit"))
    part = lambda c: c.cast("string")
    rows = named.select("path", part(F.lit(None)).alias("part"), F.lit(0).alias("part_no"), F.col("no").alias("para_no"), part(F.lit(None)).alias("text"), F.array_repeat(occurrence, F.col("widgets")).alias("fields"), part(F.lit(None)).alias("error"))
    failed = bad.groupBy("path").agg(F.min("code").alias("error"))
    return rows.unionByName(failed.select("path", part(F.lit(None)).alias("part"), F.lit(0).alias("part_no"), F.lit(0).alias("para_no"), part(F.lit(None)).alias("text"), F.lit(None).cast(packages.FIELDS).alias("fields"), "error"))


def as_field(f: Column) -> Column:
    """Explicit fields of forms carry their kind and limit in the place of their end."""
    none = F.lit(None)
    return F.struct(f["name"].alias("name"), F.when(f["stop"] < 0, "checkbox").otherwise("text").alias("type"), f["occurrences"].alias("occurrences"), F.when(f["stop"] > 0, F.least(f["stop"], F.lit(X.MAX_LENGTH))).alias("max_length"), none.cast("int").alias("max_rows"), none.cast(f"array<{V.COLUMN}>").alias("columns"))


def inspect(docs: DataFrame, coverage: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """path, format, sha256, fields (normalised), completion, code, reason of documents (path, content), with their inventories (path, inventory as
    JSON) and layout profiles (path, profile as JSON, registered) where there are any."""
    form = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    own = F.when(F.octet_length("content").between(1, containers.MAX_DOCUMENT), F.col("content"))
    base = docs.select("path", form.alias("format"), own.alias("content"), containers.document_verdict(form, F.octet_length("content"), own).alias("first"), F.sha2(own, 256).alias("sha256"))
    more = base.withColumn("inventory", F.lit(None).cast("variant")) if coverage is None else base.join(coverage.select("path", F.coalesce(F.try_parse_json("inventory"), F.parse_json(F.lit("null"))).alias("inventory")), "path", "left")
    if profiles is None:
        more = more.withColumn("bad_profile", F.lit(None).cast("string"))
    else:
        p = profiles.select("path", F.coalesce(F.try_parse_json("profile"), F.parse_json(F.lit("null"))).alias("profile"), "registered")
        more = more.join(p, "path", "left").withColumn("bad_profile", profile_verdict(F.col("profile"), F.col("format"), F.col("sha256"), F.coalesce("registered", F.lit(False)))).drop("profile", "registered")
    empty = F.array().cast(f"array<{V.FIELD}>")
    found = discovered(more.filter("first is null and bad_profile is null"))
    joined = more.drop("content").join(found, "path", "left").withColumn("fields", F.coalesce("fields", empty))
    # an inventory's shape is checked before the document is opened, its links to fields after that
    early = C.inventory_verdict(F.col("inventory"), F.col("sha256"), F.transform("fields", lambda f: f["name"]))
    judged = joined.withColumn("cover", early)
    linked = F.col("cover.reason").isin("unknown-field", "duplicate-field", "unmapped-fields")
    code = F.coalesce("first", F.when(~linked, F.col("cover.code")), "bad_profile", "problem", "cover.code")
    reason = F.when(F.col("first").isNull() & (~linked | (F.col("bad_profile").isNull() & F.col("problem").isNull())), F.col("cover.reason"))
    return judged.select("path", "format", "sha256", V.normalized(F.col("fields")).alias("fields"), C.completion(F.col("inventory")).alias("completion"), code.alias("code"), reason.alias("reason"))


def fill(docs: DataFrame, requests: DataFrame, coverage: DataFrame | None = None, manifests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports and filled documents (path, content) of requests (path, values as JSON, output, overflow, output_exists) for documents (path, content).

    In order: policy, the document's own inspection, at least one field, the manifest (path, fields) where it is a registered template, the
    values, the output path; then filling, which reads its result again and compares. Nothing is published here."""
    info = inspect(docs, coverage)
    asked = requests.select("path", F.try_parse_json("values").alias("v"), "output", F.coalesce("overflow", F.lit("preserve")).alias("overflow"), F.coalesce("output_exists", F.lit(False)).alias("output_exists"))
    x = asked.join(info, "path", "left")
    if manifests is None:
        x = x.withColumn("mismatch", F.lit(False))
    else:
        own = manifests.select("path", F.col("fields").alias("declared"))
        x = x.join(own, "path", "left").withColumn("mismatch", F.coalesce(~V.manifest_matches(F.col("fields"), F.col("declared")), F.lit(False))).withColumn("fields", F.when(F.col("declared").isNotNull() & ~F.col("mismatch"), V.normalized(F.col("declared"))).otherwise(F.col("fields"))).drop("declared")
    strict = F.col("format").isin("hwp", "hwpx")
    x = x.withColumn("bound", V.bind_verdict(F.coalesce("v", F.parse_json(F.lit("null"))), F.col("fields"), strict))
    place = F.when(F.lower(F.regexp_extract("output", r"\.([A-Za-z0-9]+)$", 1)) != F.col("format"), "E_INPUT").when((F.col("output") == F.col("path")) | F.col("output_exists"), "E_OUTPUT_EXISTS")
    policy = F.when(~F.col("overflow").isin("preserve", "flow"), "E_INPUT")
    earlier = F.coalesce(policy, F.when(F.col("sha256").isNull(), "E_INPUT"), "code", F.when(F.size("fields") == 0, "E_FIELDS"), F.when(F.col("mismatch"), "E_TEMPLATE_CHANGED"))
    x = x.withColumn("earlier", earlier).withColumn("bound", F.when(F.col("earlier").isNull(), F.col("bound")))
    # what was decided is read several times from here on
    ready = cut(x.withColumn("before", F.coalesce("earlier", "bound.code", F.when(~F.col("format").isin("docx", "hwpx"), "E_UNSUPPORTED"), place)))
    ready = flow_checked(docs, ready)
    todo = ready.filter("before is null").select("path", V.strings(F.col("v")).alias("values"), (F.col("overflow") == "flow").alias("flow"))
    form = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    # the report and the documents both come from what is filled here, once
    made = cut(packages.fill_packages(docs.withColumn("format", form).join(todo.select("path"), "path"), todo))
    r = ready.join(made, "path", "left").withColumn("failed", F.coalesce("before", "error"))
    names = F.transform("fields", lambda f: f["name"])
    checks = F.when(F.col("failed").isNull(), F.map_values(F.map_filter(check_map(FILL_CHECKS), lambda k, _: k == F.col("format"))))
    n = F.when(F.exists(F.flatten(checks), lambda c: c.isin(*REREAD)), F.size("fields"))
    done = F.col("completion").dropFields("verification", "verified_fields")
    completion = F.struct(*[done[c].alias(c) for c in ("scope", "status", "full_document_complete", "inventory", "verification_scope", "declared", "field_linked", "external", "excluded", "not_applicable", "blocked")], F.when(n > 0, "candidate-reread").otherwise("not-performed").alias("verification"), F.coalesce(n, F.lit(0)).alias("verified_fields"))
    report = r.select("path", F.lit("field-fill").alias("operation"), "format", F.col("sha256").alias("template_sha256"), names.alias("fields"), F.flatten(checks).alias("checks"), completion.alias("completion"), "overflow", F.when(F.col("failed").isNull(), F.col("output")).alias("output"), F.sha2("filled", 256).alias("output_sha256"), F.col("failed").alias("code"), F.coalesce("bound.reason", "reason", "flow_reason").alias("reason"), F.coalesce("bound.field", "flow_field").alias("field"))
    return report, r.filter("failed is null").select(F.col("output").alias("path"), F.col("filled").alias("content"))


def flow_checked(docs: DataFrame, ready: DataFrame) -> DataFrame:
    """ready with E_LAYOUT, and the field and the reason, where a word-processing document's own nodes say that the text of a field may not flow."""
    none = F.lit(None).cast("string")
    flowing = ready.filter("before is null and overflow = 'flow' and format = 'docx'").select("path", V.strings(F.col("v")).alias("values"))
    if not flowing.limit(1).count():
        return ready.withColumn("flow_field", none).withColumn("flow_reason", none)
    own = containers.parts(docs.join(flowing.select("path"), "path", "left_semi")).filter(F.col("part").rlike(f"^({containers.FIELD_PARTS['docx']})$"))
    nodes = cut(markup.node_rows(own).filter("error is null").drop("error"))
    lines = flowing.select("path", F.explode("values").alias("name", "value")).filter(F.col("value").rlike(r"[\r\n]"))
    bad = flow_checks.flow_reasons(nodes, lines).filter("reason is not null").groupBy("path").agg(F.min(F.struct("name", "reason")).alias("flow"))
    x = ready.join(bad, "path", "left").withColumn("before", F.coalesce("before", F.when(F.col("flow").isNotNull(), "E_LAYOUT")))
    return cut(x.withColumn("flow_field", F.col("flow.name")).withColumn("flow_reason", F.col("flow.reason")).drop("flow"))


#: A layout profile of repeated rows.
PROFILE = "struct<version:int,format:string,templateSha256:string,repeatRegions:array<struct<name:string,part:string,tableId:string,headerRows:array<int>,bodyRows:struct<start:int,end:int>,prototypeRow:int,insertBeforeRow:int,maxRows:int,columns:array<struct<name:string,column:int,maxLength:int>>>>>"


def repeated_regions(profiles: DataFrame) -> DataFrame:
    """path, profile_code, region and its fields of profiles (path, profile as JSON): exactly one region, in a section's part, with all of its numbers and columns."""
    p = profiles.select("path", F.from_json("profile", PROFILE).alias("p"))
    r = F.get("p.repeatRegions", F.lit(0))
    whole = (F.size("p.repeatRegions") == 1) & r["part"].rlike(f"^({containers.FIELD_PARTS['hwpx']})$") & (F.length(r["tableId"]) > 0) & (F.size(r["columns"]) > 0)
    numbers = r["bodyRows"]["start"].isNotNull() & r["bodyRows"]["end"].isNotNull() & r["prototypeRow"].isNotNull() & (r["insertBeforeRow"] == r["bodyRows"]["end"]) & r["headerRows"].isNotNull() & r["maxRows"].isNotNull()
    columns = F.array_sort(F.transform(r["columns"], lambda c: F.struct(c["column"].alias("column"), c["name"].alias("name"), c["maxLength"].alias("max_length"))))
    x = p.select("path", F.when(~F.coalesce(whole & numbers, F.lit(False)), "E_INPUT").alias("profile_code"), r.alias("r"), columns.alias("cs"))
    own = F.transform("cs", lambda c: F.struct(c["name"].alias("name"), F.lit("text").alias("type"), F.lit(1).alias("occurrences"), F.coalesce(c["max_length"], F.lit(X.MAX_LENGTH)).alias("max_length")))
    none = F.lit(None)
    field = F.struct(F.col("r.name").alias("name"), F.lit("rows").alias("type"), F.lit(1).alias("occurrences"), none.cast("int").alias("max_length"), F.col("r.maxRows").alias("max_rows"), own.alias("columns"))
    names = F.transform("cs", lambda c: F.struct(c["name"].alias("name"), c["column"].alias("column")))
    return x.select("path", "profile_code", F.col("r.part").alias("part"), F.col("r.tableId").alias("table_id"), F.col("r.name").alias("region_name"), F.col("r.bodyRows.start").alias("first"), F.col("r.bodyRows.end").alias("last"), F.col("r.prototypeRow").alias("prototype"), F.col("r.headerRows").alias("headers"), names.alias("columns"), field.alias("rows_field"))


def fill_repeated(docs: DataFrame, profiles: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (path, code, reason, field, records, reused, cloned, removed) and filled documents (path, content) of requests (path, values as JSON) for documents
    (path, content) with a table whose rows repeat, by layout profiles (path, profile as JSON).

    In order: the document and the profile's envelope (as in inspect), the profile's region, the region in the document's own nodes, the values against the region's rows and
    the other fields; then the rows, then the other fields, and the result is opened and its rows are read again."""
    null = F.lit(None).cast("string")
    info = inspect(docs, None, profiles.select("path", "profile", F.lit(False).alias("registered")))
    x = requests.select("path", F.try_parse_json("values").alias("v"), "values").join(info.select("path", "code", "reason", "fields"), "path", "left").join(repeated_regions(profiles), "path", "left")
    # the document's own fields, but for the markers in the region's row
    inside = F.transform("columns", lambda c: c["name"])
    others = F.filter("fields", lambda f: ~F.array_contains(F.coalesce(inside, F.array().cast("array<string>")), f["name"]))
    fields = F.concat(F.transform(others, lambda f: F.struct(*[f[c.split(":")[0]].alias(c.split(":")[0]) for c in ("name", "type", "occurrences", "max_length", "max_rows", "columns")])), F.array("rows_field"))
    early = F.coalesce(F.when(F.col("fields").isNull(), "E_INPUT"), "code", F.when(F.col("region_name").isNull(), "E_INPUT"), "profile_code")
    x = cut(x.withColumn("early", early).withColumn("bound", F.when(F.col("early").isNull(), V.bind_verdict(F.coalesce("v", F.parse_json(F.lit("null"))), V.normalized(fields), True))))
    sound = docs.join(x.filter("early is null").select("path"), "path", "left_semi")
    every = cut(containers.parts(sound))
    tables = sections.table_rows(every.filter(F.col("part").rlike(f"^({containers.FIELD_PARTS['hwpx']})$")))
    regions = x.filter("early is null").select("path", "part", "table_id", "first", "last", "prototype", "headers", "columns")
    bound = x.filter("early is null and bound is null")
    rows = bound.select("path", F.posexplode(F.from_json(F.try_element_at(F.from_json("values", "map<string,string>"), F.col("region_name")), "array<map<string,string>>")).alias("record", "values"))
    headers = cut(markup.node_rows(every.filter("part = 'Contents/header.xml'")).filter("error is null").drop("error"))
    new, judged = repeat_fill.filled_tables(tables, every, regions, rows, headers)
    made = cut(repeat_fill.repacked(every, new))
    # texts of the other fields, once the rows stand
    texts = bound.select("path", V.strings(F.col("v")).alias("values")).filter(F.size("values") > 0)
    rest = packages.fill_packages(made.withColumn("format", F.lit("hwpx")).join(texts.select("path"), "path"), texts)
    both = cut(made.join(rest, "path", "left").select("path", F.when(F.col("filled").isNull() & F.col("error").isNull(), F.col("content")).otherwise(F.col("filled")).alias("content"), F.col("error").alias("fill_code")))
    again = sections.table_rows(containers.parts(both.filter("fill_code is null")).filter(F.col("part").rlike(f"^({containers.FIELD_PARTS['hwpx']})$")))
    got = repeat_fill.cells_of(repeat_fill.region_tables(regions, again), "path", "first", "columns")
    said = got.select("path", (F.col("row") - F.col("first")).alias("record"), F.get("columns", F.col("no"))["name"].alias("name"), "text")
    want = rows.select("path", "record", F.explode("values").alias("name", "value")).select("path", "record", "name", X.newlines(F.col("value")).alias("value"))
    lost = want.join(said, ["path", "record", "name"], "left").filter("text is null or text != value").select("path").distinct().withColumn("lost", F.lit(True))
    counts = T.repeat_counts(T.output_rows(rows.groupBy("path").agg(F.count("*").alias("n")).join(regions.select("path", F.col("first").alias("start"), F.col("last").alias("stop"), "prototype"), "path"), "path"), "path", regions.select("path", F.col("first").alias("start"), F.col("last").alias("stop")))
    n = rows.groupBy("path").agg(F.count("*").alias("records"))
    r = x.join(judged.withColumnRenamed("reason", "layout"), "path", "left").join(both.select("path", "fill_code"), "path", "left").join(lost, "path", "left").join(n, "path", "left").join(counts, "path", "left")
    code = F.coalesce("early", F.when(F.col("layout").isNotNull(), "E_LAYOUT"), "bound.code", "fill_code", F.when(F.col("lost"), "E_PRESERVATION"))
    report = cut(r.select("path", code.alias("code"), F.when(F.col("early").isNotNull(), F.col("reason")).otherwise(F.coalesce("layout", "bound.reason")).alias("reason"), F.when(F.col("early").isNotNull(), null).when(F.col("layout").isNotNull(), F.col("region_name")).otherwise(F.col("bound.field")).alias("field"), "records", "reused", "cloned", "removed"))
    return report, both.join(report.filter("code is null").select("path"), "path", "left_semi").select("path", "content")


def check_map(checks: dict[str, list[str]]) -> Column:
    return F.create_map(*[c for k, v in checks.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])


def validate(docs: DataFrame) -> DataFrame:
    """path, format, sha256, checks, code of documents: structure only."""
    info = inspect_structure(docs)
    checks = F.when(F.col("code").isNull(), F.try_element_at(check_map(CHECKS), F.col("format")))
    return info.select("path", F.lit("structure-validation").alias("operation"), "format", "sha256", checks.alias("checks"), C.completion(F.lit(None).cast("variant"), structure_only=True).alias("completion"), "code")


def inspect_structure(docs: DataFrame) -> DataFrame:
    """What inspection says of the documents themselves; their fields may be wrong."""
    info = inspect(docs)
    return info.withColumn("code", F.when(F.col("code") != "E_FIELDS", F.col("code")))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, code: a source whose bytes are other now than when it was read, or that is gone."""
    b, a = before.select("path", F.sha2("content", 256).alias("was")), after.select("path", F.sha2("content", 256).alias("now"))
    return b.join(a, "path", "left").select("path", F.when(~F.col("was").eqNullSafe(F.col("now")), "E_TEMPLATE_CHANGED").alias("code"))


def first_failures(checks: DataFrame, doc: str, order: str, code: str) -> DataFrame:
    """doc, code: the first failing check of each document."""
    w = Window.partitionBy(doc).orderBy(order)
    return checks.filter(F.col(code).isNotNull()).withColumn("n", F.row_number().over(w)).filter("n = 1").select(doc, code)


def marker_report(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, code, fields of texts that are templates themselves."""
    return texts.select(key, X.marker_verdict(F.col(text)).alias("code"), X.fields(F.col(text)).alias("fields"))
