"""Queries on records, field lists, manifests and coverage inventories. Their JSON comes from one expression that both engines read;
the verdicts are worked out on each side by its own functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.functions import values as V
from formloom.operators import coverage as C
from formloom.operators.lineage import spread
from formloom.plans.registry import query, t

COLUMNS = '[{"name": "part", "type": "text", "max_length": 10}, {"name": "note", "type": "text", "max_length": 30}]'
FIELDS = '[{"name": "name", "type": "text", "max_length": 20}, {"name": "ok", "type": "checkbox"}, {"name": "lines", "type": "rows", "max_rows": 3, "columns": ' + COLUMNS + "}]"

ROW = """'{"part": "p' || o_custkey || '", "note": "' || o_orderpriority || '"}'"""


def record(name="""'"' || o_orderpriority || '"'""", ok="'true'", lines=None, more="''"):
    lines = lines or f"'[' || {ROW} || ', ' || {ROW} || ']'"
    return f"""'{{"name": ' || {name} || ', "ok": ' || {ok} || ', "lines": ' || {lines} || {more} || '}}'"""


RECORDS = [
    "'[1]'", record(more="""', "zz": 1, "extra": 2'"""), """'{"ok": true, "lines": [], "na": 1}'""", """'{"ok": true, "lines": []}'""", record(name="'12'"), record(name="""'"  "'"""), record(name="""'"' || o_orderpriority || repeat('x', 15) || '"'"""),
    record(name="""'"a' || chr(92) || 'u0001"'"""), record(ok="""'"false"'"""), record(lines="""'"none"'"""), record(lines="'[]'"), record(lines=f"""'[' || {ROW} || ', ' || {ROW} || ', ' || {ROW} || ', ' || {ROW} || ']'"""),
    record(lines=f"'[' || {ROW} || ', null]'"), record(lines="""'[{"part": "1", "note": "2", "more": "3"}]'"""), record(lines="""'[{"part": "1"}]'"""), record(lines="""'[{"part": "12345678901", "note": "2"}]'"""), record(lines="""'[{"part": 5, "note": "2"}]'"""), record(), record(ok="'false'"),
]
JSON = "case o_orderkey % 19 " + " ".join(f"when {i} then {r}" for i, r in enumerate(RECORDS)) + " end"

BOUND = f"""with r as (select o_orderkey, {JSON} as j from orders),
x as (select *, json_type(j) as kind, case when json_type(j) = 'OBJECT' then list_sort(list_filter(json_keys(j), lambda k: k not in ('name', 'ok', 'lines'))) else [] end as unknown, json_extract_string(j, '$.name') as name, json_extract(j, '$.lines[*]') as rows from r),
y as (select *, list_transform(rows, lambda w: case when json_type(w) <> 'OBJECT' then 'row-not-object' when len(list_filter(json_keys(w), lambda k: k not in ('part', 'note'))) > 0 then 'row-unknown' when not json_exists(w, '$.part') or not json_exists(w, '$.note') then 'row-missing'
  when json_type(w, '$.part') <> 'VARCHAR' or json_type(w, '$.note') <> 'VARCHAR' then 'row-type' when length(json_extract_string(w, '$.part')) > 10 or length(json_extract_string(w, '$.note')) > 30 then 'row-length' end) as bad from x)
select o_orderkey, case when kind <> 'OBJECT' then 'not-object' when len(unknown) > 0 then 'unknown-field' when not json_exists(j, '$.name') then 'missing' when json_type(j, '$.name') <> 'VARCHAR' then 'type' when trim(name) = '' then 'blank' when length(name) > 20 then 'length' when regexp_matches(name, '[\\x00-\\x08]') then 'control'
  when not json_exists(j, '$.ok') then 'missing' when json_type(j, '$.ok') <> 'BOOLEAN' then 'not-boolean' when json_type(j, '$.lines') <> 'ARRAY' or len(rows) not between 1 and 3 then 'row-count' else list_filter(bad, lambda b: b is not null)[1] end as reason,
  case when len(unknown) > 0 then array_to_string(unknown, ',') when kind <> 'OBJECT' then null when json_type(j, '$.name') is distinct from 'VARCHAR' or trim(name) = '' or length(name) > 20 or regexp_matches(name, '[\\x00-\\x08]') then 'name' when json_type(j, '$.ok') is distinct from 'BOOLEAN' then 'ok'
  when json_type(j, '$.lines') <> 'ARRAY' or len(rows) not between 1 and 3 or len(list_filter(bad, lambda b: b is not null)) > 0 then 'lines' end as field from y"""


def bound(spark, d):
    fields = V.normalized(F.from_json(F.lit(FIELDS), f"array<{V.FIELD}>"))
    return t(spark, d, "orders").select("o_orderkey", F.try_parse_json(F.expr(JSON)).alias("v")).select("o_orderkey", "v", V.bind_verdict(F.col("v"), fields).alias("verdict"))


@query(BOUND)
def bind_verdict(spark, d):
    return bound(spark, d).select("o_orderkey", F.col("verdict.reason").alias("reason"), F.col("verdict.field").alias("field"))


@query("""select o_orderkey % 13 as k, case when o_orderkey % 13 = 5 then 'marker' when o_orderkey % 13 = 7 then 'row-marker' when o_orderkey % 13 = 9 then 'noncharacter' end as reason, count(*) as n from orders group by all""")
def strict_bind_verdict(spark, d):
    k = F.col("o_orderkey") % 13
    row = F.when(k == 7, F.lit("{{note}}")).otherwise(F.col("o_orderpriority"))
    name = F.when(k == 5, F.concat(F.lit("{{"), "o_orderpriority")).when(k == 9, F.concat("o_orderpriority", F.lit("￿"))).otherwise(F.col("o_orderpriority"))
    json = F.to_json(F.struct(name.alias("name"), F.lit(True).alias("ok"), F.array(F.struct(F.lit("p").alias("part"), row.alias("note"))).alias("lines")))
    fields = V.normalized(F.from_json(F.lit(FIELDS), f"array<{V.FIELD}>"))
    return t(spark, d, "orders").select(k.alias("k"), V.bind_verdict(F.try_parse_json(json), fields, strict=True)["reason"].alias("reason")).groupBy("k", "reason").agg(F.count("*").alias("n"))


LISTS = [
    "'[]'", """'[{"name": "a", "type": "text"}]'""", """'[{"name": "1a", "type": "text"}]'""", """'[{"name": "a", "type": "text"}, {"name": "a", "type": "checkbox"}]'""", """'[{"name": "a", "type": "date"}]'""", """'[{"name": "a", "type": "text", "max_length": 10001}]'""", """'[{"name": "a", "type": "text", "occurrences": 0}]'""",
    """'[{"name": "a", "type": "rows", "max_rows": 101, "columns": [{"name": "c", "type": "text", "max_length": 5}]}]'""", """'[{"name": "a", "type": "rows", "max_rows": ' || (p_size + 50) || ', "columns": [{"name": "c", "type": "text", "max_length": 5}]}]'""", """'[{"name": "a", "type": "rows", "max_rows": 5, "columns": [{"name": "c", "type": "rows", "max_length": 5}]}]'""",
    """'[{"name": "a", "type": "rows", "max_rows": 5, "columns": [{"name": "c", "type": "text", "max_length": 5}, {"name": "c", "type": "text", "max_length": 6}]}]'""", """'[{"name": "constructor", "type": "text"}]'""", """'[{"name": "a", "type": "rows", "max_rows": 5, "columns": [{"name": "c d", "type": "text", "max_length": 5}]}]'""",
]
LIST = "case p_partkey % 13 " + " ".join(f"when {i} then {r}" for i, r in enumerate(LISTS)) + " end"


@query(rf"""with r as (select p_partkey, json_extract(j, '$[*]') as f from (select p_partkey, {LIST} as j from part)),
x as (select p_partkey, unnest(f) as f, generate_subscripts(f, 1) as i, f as a from r),
y as (select p_partkey, i, f ->> 'name' as name, f ->> 'type' as type, coalesce((f ->> 'occurrences')::int, 1) as occ, coalesce((f ->> 'max_length')::int, 10000) as most, (f ->> 'max_rows')::int as max_rows, json_extract(f, '$.columns[*]') as c, list_transform(a[1 : i - 1], lambda e: e ->> 'name') as earlier from x),
z as (select p_partkey, i, name, case when not regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]{{0,63}}') or name in ('constructor', 'prototype', '__proto__') then 'name' when list_contains(earlier, name) then 'duplicate' when type not in ('text', 'checkbox', 'rows') then 'type'
  when type = 'rows' then case when occ <> 1 or max_rows not between 1 and 100 or len(c) not between 1 and 30 then 'row-limits' when len(list_filter(c, lambda e: e ->> 'type' <> 'text' or (e ->> 'max_length')::int not between 1 and 10000)) > 0 then 'columns' when len(list_filter(c, lambda e: not regexp_full_match(e ->> 'name', '[A-Za-z][A-Za-z0-9_]{{0,63}}'))) > 0 then 'column-name' when len(list_distinct(list_transform(c, lambda e: e ->> 'name'))) < len(c) then 'column-duplicate' end
  when occ < 1 or most not between 1 and 10000 then 'limits' end as reason from y)
select r.p_partkey, min_by(reason, i) filter (reason is not null) as reason, min_by(name, i) filter (reason is not null) as field, coalesce(max(len(r.f)), 0)::int as n from r left join z on z.p_partkey = r.p_partkey group by r.p_partkey""")
def field_list_verdict(spark, d):
    f = F.from_json(F.expr(LIST), f"array<{V.FIELD}>")
    x = t(spark, d, "part").select("p_partkey", V.fields_reason(f).alias("v"), F.size(V.normalized(f)).alias("n"))
    return x.select("p_partkey", F.col("v.reason").alias("reason"), F.col("v.field").alias("field"), "n")


@query("""select c_custkey, case c_custkey % 7 when 0 then false when 1 then false when 2 then false when 3 then false when 4 then false else true end as matches from customer""")
def manifest_shape(spark, d):
    base = FIELDS
    other = F.expr("case c_custkey % 7 when 0 then replace(f, 'checkbox', 'text') when 1 then replace(f, '\"max_rows\": 3', '\"max_rows\": 4') when 2 then replace(f, '\"note\"', '\"memo\"') when 3 then replace(f, '\"ok\"', '\"okay\"') when 4 then replace(f, '[{\"name\": \"name\"', '[{\"name\": \"new\", \"type\": \"text\"}, {\"name\": \"name\"') when 5 then replace(f, '\"max_length\": 20', '\"max_length\": 99') else f end")
    lists = t(spark, d, "customer").withColumn("f", F.lit(base)).select("c_custkey", F.from_json("f", f"array<{V.FIELD}>").alias("found"), F.from_json(other, f"array<{V.FIELD}>").alias("declared"))
    return lists.select("c_custkey", V.manifest_matches(F.col("found"), F.col("declared")).alias("matches"))


SHA = "sha256(c_name)"


def slot(id_="""'"s1"'""", location="""'"page 1"'""", rest="""'"status": "filled", "evidence": {"kind": "fields", "fields": ["a"]}'"""):
    return f"""'{{"id": ' || {id_} || ', "location": ' || {location} || ', ' || {rest} || '}}'"""


def inventory(slots, version="'1'", sha="""'"' || sha || '"'""", scope="''"):
    return f"""'{{"version": ' || {version} || ', "templateSha256": ' || {sha} || {scope} || ', "slots": ' || {slots} || '}}'"""


def listed(*slots):
    return "'[' || " + " || ', ' || ".join(slots) + " || ']'"


B = slot("""'"s2"'""", rest="""'"status": "filled", "evidence": {"kind": "fields", "fields": ["b"]}'""")
ok = listed(slot(), B)
status = lambda rest: listed(slot(), B, slot("""'"s3"'""", rest=f"'{rest}'"))
INVENTORIES = [
    "'[]'", inventory(ok, version="""'"1"'"""), inventory(ok, version="'2'"), inventory(ok, sha="""'"' || upper(sha) || '"'"""), inventory(ok, scope="""', "scope": "most"'"""), inventory(ok, scope="""', "scope": "partial"'"""), inventory(ok, scope="""', "scope": "partial", "scopeEvidence": {"kind": "user-instruction", "reference": " "}'"""),
    inventory(ok, scope="""', "scope": "partial", "scopeEvidence": {"kind": "user-instruction", "reference": "mail"}'"""), inventory("""'{}'"""), inventory(listed(slot("""'""'"""), B)), inventory(listed(slot(), slot())), inventory(listed(slot(location="'7'"), B)), inventory(status('"status": "done"')),
    inventory(status('"status": "blocked", "reason": "r"')), inventory(status('"status": "blocked", "reason": "r", "nextAction": "n"')), inventory(status('"status": "explicitly_excluded", "evidence": {"kind": "note", "reference": "r"}')), inventory(status('"status": "explicitly_excluded", "evidence": {"kind": "user-instruction", "reference": "r"}')),
    inventory(status('"status": "filled"')), inventory(status('"status": "not_applicable", "evidence": {"kind": "applicability", "condition": "c"}')), inventory(status('"status": "not_applicable", "evidence": {"kind": "applicability", "condition": "c", "reason": "r"}')), inventory(status('"status": "filled", "evidence": {"kind": "guess"}')),
    inventory(status('"status": "filled", "evidence": {"kind": "external-review"}')), inventory(status('"status": "filled", "evidence": {"kind": "external-review", "reference": "r"}')), inventory(status('"status": "filled", "evidence": {"kind": "fields", "fields": []}')), inventory(status('"status": "filled", "evidence": {"kind": "fields", "fields": ["c"]}')),
    inventory(status('"status": "filled", "evidence": {"kind": "fields", "fields": ["b"]}')), inventory(listed(slot())), inventory(ok, sha="""'"' || repeat('0', 64) || '"'"""), inventory(ok), "null",
]
N = len(INVENTORIES)
INVENTORY = f"case c_custkey % {N} " + " ".join(f"when {i} then {x}" for i, x in enumerate(INVENTORIES)) + " end"

TEXTED = lambda j, p: f"(json_type({j}, '{p}') = 'VARCHAR' and trim(json_extract_string({j}, '{p}')) <> '')"
INSTRUCTED = lambda j, p: f"(json_extract_string({j}, '{p}.kind') = 'user-instruction' and coalesce({TEXTED(j, p + '.reference')}, false))"
IS = lambda x: f"coalesce({x}, false)"
LADDER = f"""with i as (select c_custkey, sha, {INVENTORY} as j from (select c_custkey, {SHA} as sha from customer)),
e as (select c_custkey, unnest(range(0, len(s))) as n, unnest(s) as s, list_transform(s, lambda x: x ->> 'id') as ids from (select c_custkey, json_extract(j, '$.slots[*]') as s from i where json_type(j, '$.slots') = 'ARRAY')),
v as (select c_custkey, n, case when not {IS(TEXTED('s', '$.id'))} then 'invalid-slot-id' when list_contains(ids[1 : n], s ->> 'id') then 'duplicate-slot-id' when not {IS(TEXTED('s', '$.location'))} then 'missing-location' when coalesce(s ->> 'status', '') not in ('filled', 'explicitly_excluded', 'not_applicable', 'blocked') then 'invalid-status'
  when s ->> 'status' = 'blocked' then case when not ({IS(TEXTED('s', '$.reason'))} and {IS(TEXTED('s', '$.nextAction'))}) then 'missing-blocker-action' end
  when s ->> 'status' = 'explicitly_excluded' then case when not {IS(INSTRUCTED('s', '$.evidence'))} then 'missing-exclusion-instruction' end
  when coalesce(json_type(s, '$.evidence'), '') <> 'OBJECT' then 'missing-evidence'
  when s ->> 'status' = 'not_applicable' then case when not {IS("s ->> '$.evidence.kind' = 'applicability' and " + TEXTED('s', '$.evidence.condition') + " and " + TEXTED('s', '$.evidence.reason'))} then 'missing-applicability' end
  when coalesce(s ->> '$.evidence.kind', '') not in ('fields', 'external-review') then 'invalid-filled-evidence'
  when s ->> '$.evidence.kind' = 'external-review' then case when not {IS(TEXTED('s', '$.evidence.reference'))} then 'missing-review-reference' end
  when coalesce(json_array_length(s, '$.evidence.fields'), 0) = 0 then 'invalid-evidence-fields' end as reason from e),
f as (select c_custkey, min_by(reason, n) filter (reason is not null) as reason, min(n) filter (reason is not null) as slot from v group by c_custkey),
l as (select c_custkey, n, row_number() over (partition by c_custkey order by n) as k, name from (select c_custkey, n, unnest(json_extract_string(s, '$.evidence.fields[*]')) as name from e where s ->> 'status' = 'filled' and s ->> '$.evidence.kind' = 'fields')),
m as (select c_custkey, n, k, name, case when name not in ('a', 'b') then 'unknown-field' when count(*) over (partition by c_custkey, name order by k) > 1 then 'duplicate-field' end as reason from l),
g as (select c_custkey, min_by(reason, k) filter (reason is not null) as reason, min_by(n, k) filter (reason is not null) as slot, count(distinct name) as names from m group by c_custkey),
o as (select i.c_custkey, case when j is null then null when json_type(j) <> 'OBJECT' or coalesce(json_type(j, '$.version'), '') not in ('UBIGINT', 'BIGINT', 'DOUBLE') or j ->> 'version' <> '1' then 'invalid-version' when not regexp_full_match(j ->> 'templateSha256', '[a-f0-9]{{64}}') then 'invalid-template-hash' when coalesce(j ->> 'scope', 'full') not in ('full', 'partial') then 'invalid-scope'
  when j ->> 'scope' = 'partial' and not {IS(INSTRUCTED('j', '$.scopeEvidence'))} then 'missing-scope-instruction' when json_type(j, '$.slots') <> 'ARRAY' then 'invalid-slots' when f.reason is not null then f.reason when j ->> 'templateSha256' <> sha then 'template-hash' when g.reason is not null then g.reason when coalesce(names, 0) <> 2 then 'unmapped-fields' end as reason, f.slot as fs, f.reason as fr, g.slot as gs, g.reason as gr
  from i left join f on f.c_custkey = i.c_custkey left join g on g.c_custkey = i.c_custkey)
select c_custkey, reason, case when reason = 'template-hash' then 'E_TEMPLATE_CHANGED' when reason is not null then 'E_COVERAGE' end as code, case when reason = fr then fs when reason = gr then gs end::int as slot from o"""


def inventories(spark, d):
    # an inventory costs far more time than the bytes of its row
    base = spread(t(spark, d, "customer").select("c_custkey", "c_name")).withColumn("sha", F.sha2(F.col("c_name").cast("binary"), 256))
    return base.select("c_custkey", "sha", F.try_parse_json(F.expr(INVENTORY)).alias("v"))


@query(LADDER)
def inventory_verdict(spark, d):
    v = C.inventory_verdict(F.col("v"), F.col("sha"), F.array(F.lit("a"), F.lit("b")))
    x = inventories(spark, d).select("c_custkey", v.alias("x"))
    return x.select("c_custkey", F.col("x.reason").alias("reason"), F.col("x.code").alias("code"), F.col("x.slot").alias("slot"))


@query(f"""with i as (select c_custkey, {INVENTORY} as j from (select c_custkey, {SHA} as sha from customer)), s as (select *, case when json_type(j, '$.slots') = 'ARRAY' then json_extract(j, '$.slots[*]') else [] end as s from i),
c as (select c_custkey, j, coalesce(len(s), 0)::int as declared, coalesce(len(list_filter(s, lambda x: x ->> 'status' = 'filled' and x ->> '$.evidence.kind' = 'fields')), 0)::int as field_linked, coalesce(len(list_filter(s, lambda x: x ->> 'status' = 'filled' and x ->> '$.evidence.kind' = 'external-review')), 0)::int as external,
  coalesce(len(list_filter(s, lambda x: x ->> 'status' = 'explicitly_excluded')), 0)::int as excluded, coalesce(len(list_filter(s, lambda x: x ->> 'status' = 'not_applicable')), 0)::int as not_applicable, coalesce(len(list_filter(s, lambda x: x ->> 'status' = 'blocked')), 0)::int as blocked from s)
select c_custkey, case when json_type(j) = 'OBJECT' then coalesce(j ->> 'scope', 'full') else 'full' end as scope, case when j is not null and blocked = 0 then 'requires-review' else 'incomplete' end as status, false as full_document_complete, case when j is null then 'not-provided' else 'declared' end as inventory,
  case when j is null then 'explicit-fields' else 'explicit-fields-and-manifest-consistency' end as verification_scope, declared, field_linked, external, excluded, not_applicable, blocked, 'not-performed' as verification, 0 as verified_fields from c""")
def inventory_completion(spark, d):
    return inventories(spark, d).select("c_custkey", C.completion(F.col("v")).alias("x")).select("c_custkey", "x.*")


@query("""with s as (select conv_id, case turn % 4 when 0 then 'filled' when 1 then 'filled' when 2 then 'explicitly_excluded' else 'blocked' end as status, case turn % 4 when 0 then 'fields' when 1 then 'external-review' end as kind from conversations where conv_id % 5 <> 0),
n as (select conv_id, count(*) as declared, count(*) filter (kind = 'fields') as field_linked, count(*) filter (kind = 'external-review') as external, count(*) filter (status = 'explicitly_excluded') as excluded, count(*) filter (status = 'blocked') as blocked from s group by 1)
select c.conv_id, coalesce(declared, 0) as declared, coalesce(field_linked, 0) as field_linked, coalesce(external, 0) as external, coalesce(excluded, 0) as excluded, 0::bigint as not_applicable, coalesce(blocked, 0) as blocked, case when declared is null or blocked > 0 then 'incomplete' else 'requires-review' end as completion, false as full_document_complete
from (select distinct conv_id from conversations) as c left join n on n.conv_id = c.conv_id""")
def slot_counts(spark, d):
    c = t(spark, d, "conversations")
    k = F.col("turn") % 4
    s = c.filter("conv_id % 5 <> 0").select("conv_id", F.when(k < 2, "filled").when(k == 2, "explicitly_excluded").otherwise("blocked").alias("status"), F.when(k == 0, "fields").when(k == 1, "external-review").alias("kind"))
    return C.slot_counts(s, "conv_id", c.select("conv_id").distinct())


@query("select event_id, json_keys(props) = ['k'] as exact, json_keys(props) = ['k'] and event_id % 2 = 0 as exact_two from events")
def exact_key_set(spark, d):
    two = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.replace("props", F.lit("}"), F.lit(', "z": 1}')))
    return t(spark, d, "events").select("event_id", X.exact_keys(F.col("props"), ["k"]).alias("exact"), X.exact_keys(two, ["k"], ["y"]).alias("exact_two"))


@query("""select p_partkey, case p_partkey % 5 when 0 then true when 1 then true when 2 then false when 3 then false end as enabled, case when p_partkey % 4 = 0 then p_size::bigint when p_partkey % 4 = 1 then 9007199254740991 end as number from part""")
def tri_state(spark, d):
    k = F.col("p_partkey")
    v = F.when(k % 5 == 0, None).when(k % 5 == 1, "on").when(k % 5 == 2, "0").when(k % 5 == 3, "off").otherwise("yes")
    n = F.when(k % 4 == 0, F.col("p_size").cast("string")).when(k % 4 == 1, "9007199254740991").when(k % 4 == 2, "9007199254740992").otherwise("-1")
    return t(spark, d, "part").select("p_partkey", X.tri_state(v).alias("enabled"), X.whole_number(n).alias("number"))
