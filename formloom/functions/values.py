"""Fields and values as data: normalised field lists, the ordered checks of a value record, manifest matches. Nothing is raised: each
check gives a verdict, a struct (code, reason, field), null if all is well. Verdicts carry names only, never values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions import text as X

# Limits of fields and records.
MAX_ROWS, MAX_COLUMNS, MAX_ROW_CHARACTERS = 100, 30, 500_000

COLUMN = "struct<name:string,type:string,occurrences:int,max_length:int>"
FIELD = f"struct<name:string,type:string,occurrences:int,max_length:int,max_rows:int,columns:array<{COLUMN}>>"


def verdict(reason: Column | str, field: Column | None = None, code: str = "E_FIELDS") -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    field = F.lit(None).cast("string") if field is None else field
    return F.when(reason.isNotNull(), F.struct(F.lit(code).alias("code"), reason.alias("reason"), field.alias("field")))


def first_of(*verdicts: Column) -> Column:
    return F.coalesce(*verdicts)


def repeated(items: Column, name) -> Column:
    """Some item has a name that an earlier one has."""
    names = F.transform(items, name)
    return F.size(F.array_distinct(names)) < F.size(names)


def length_ok(n: Column) -> Column:
    return n.between(1, X.MAX_LENGTH)


def fields_reason(fields: Column) -> Column:
    """Why a field list (array of FIELD) is invalid: the first field that fails decides."""

    def reason(f: Column, i: Column) -> Column:
        occurrences = F.coalesce(f["occurrences"], F.lit(1))
        earlier = F.exists(F.slice(fields, 1, i), lambda e: e["name"] == f["name"])
        own = F.when(f.isNull() | ~F.coalesce(X.valid_name(f["name"]), F.lit(False)), "name").when(earlier, "duplicate").when(~F.coalesce(f["type"].isin("text", "checkbox", "rows"), F.lit(False)), "type")
        columns = f["columns"]
        size = (occurrences == 1) & F.coalesce(f["max_rows"].between(1, MAX_ROWS), F.lit(False)) & F.coalesce(F.size(columns).between(1, MAX_COLUMNS), F.lit(False))
        column = lambda c: F.coalesce((c["type"] == "text") & (F.coalesce(c["occurrences"], F.lit(1)) == 1) & length_ok(c["max_length"]), F.lit(False))
        rows = F.when(~size, "row-limits").when(~F.forall(columns, column), "columns").when(F.exists(columns, lambda c: ~F.coalesce(X.valid_name(c["name"]), F.lit(False))), "column-name").when(repeated(columns, lambda c: c["name"]), "column-duplicate")
        scalar = F.when((occurrences < 1) | ~length_ok(F.coalesce(f["max_length"], F.lit(X.MAX_LENGTH))), "limits")
        return F.coalesce(own, F.when(f["type"] == "rows", rows).otherwise(scalar))

    bad = F.filter(F.transform(fields, lambda f, i: F.struct(reason(f, i).alias("reason"), f["name"].alias("field"))), lambda v: v["reason"].isNotNull())
    return F.when(fields.isNull(), verdict("no-fields")).otherwise(X.let(F.get(bad, 0), lambda v: verdict(v["reason"], v["field"])))


def normalized(fields: Column) -> Column:
    """The fields with their defaults: one occurrence, MAX_LENGTH characters (also of a checkbox), always required."""
    one = lambda c: F.coalesce(c, F.lit(1))
    column = lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), one(c["occurrences"]).alias("occurrences"), c["max_length"].alias("max_length"))
    limit = lambda f: F.when(f["type"] != "rows", F.coalesce(f["max_length"], F.lit(X.MAX_LENGTH)))
    return F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"), F.lit(True).alias("required"), one(f["occurrences"]).alias("occurrences"), limit(f).alias("max_length"), f["max_rows"].alias("max_rows"), F.transform(f["columns"], column).alias("columns")))


def manifest_matches(found: Column, declared: Column) -> Column:
    """As many fields on both sides, and each declared one found with its name, type, occurrences and shape of rows."""

    def same(f: Column, d: Column) -> Column:
        shape = (f["max_rows"] == d["max_rows"]) & (F.transform(f["columns"], lambda c: F.struct(c["name"], c["type"], c["max_length"])) == F.transform(d["columns"], lambda c: F.struct(c["name"], c["type"], c["max_length"])))
        return (f["name"] == d["name"]) & (f["type"] == d["type"]) & (F.coalesce(f["occurrences"], F.lit(1)) == F.coalesce(d["occurrences"], F.lit(1))) & ((d["type"] != "rows") | F.coalesce(shape, F.lit(False)))

    return (F.size(found) == F.size(declared)) & F.forall(declared, lambda d: F.exists(found, lambda f: same(f, d)))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def members(v: Column) -> Column:
    """Of an object; null for anything else. Cheaper than to ask for the schema of all that is inside."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """Of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return members(v).isNotNull()


def is_array(v: Column) -> Column:
    return items(v).isNotNull()


def string_of(v: Column) -> Column:
    """The text of a variant that is a string, else null: numbers and booleans don't turn into text."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text_reason(v: Column, limit: Column) -> Column:
    return X.let(string_of(v), lambda s: F.when(s.isNull(), "type").when(X.blank(s), "blank").when(F.length(s) > limit, "length").when(s.rlike(X.CONTROL), "control"))


def strict_reason(v: Column) -> Column:
    """What the strict formats refuse besides: marker braces, noncharacters and lone surrogates."""
    return X.let(string_of(v), lambda s: F.when(s.rlike(r"[\x{FFFE}\x{FFFF}]"), "noncharacter").when(s.rlike(r"\{\{|\}\}"), "marker"))


def bind_verdict(values: Column, fields: Column, strict: bool | Column = False) -> Column:
    """The first failure of a record (variant) against its fields (normalised), in the order of the fields.

    Not an object; unknown keys (all are listed); then for each field: missing, its rows (count, then each row as a record of its
    own, then the characters of all rows so far), a checkbox that isn't a boolean, a text that isn't one, is blank, too long or holds controls."""
    return X.let(members(values), lambda record: _bind_verdict(record, fields, strict))


def _bind_verdict(record: Column, fields: Column, strict: bool | Column) -> Column:
    unknown = F.array_except(F.map_keys(record), F.transform(fields, lambda f: f["name"]))
    limit = lambda c: F.coalesce(c["max_length"], F.lit(X.MAX_LENGTH))
    none = F.lit(None).cast("string")
    extra = (lambda v: F.when(strict, strict_reason(v))) if isinstance(strict, Column) else strict_reason if strict else lambda v: none

    def row_reason(row: Column, columns: Column) -> Column:
        return X.let(members(row), lambda own: F.when(own.isNull(), "row-not-object").otherwise(member_reason(own, columns)))

    def member_reason(own: Column, columns: Column) -> Column:
        names = F.transform(columns, lambda c: c["name"])
        bad = F.filter(F.transform(columns, lambda c: F.when(~F.map_contains_key(own, c["name"]), "row-missing").otherwise(F.concat(F.lit("row-"), F.coalesce(text_reason(F.try_element_at(own, c["name"]), limit(c)), extra(F.try_element_at(own, c["name"])))))), lambda x: x.isNotNull())
        return F.when(F.size(F.array_except(F.map_keys(own), names)) > 0, "row-unknown").otherwise(F.get(bad, 0))

    def characters(row: Column) -> Column:
        return F.aggregate(F.map_values(members(row)), F.lit(0), lambda n, v: n + F.coalesce(F.length(string_of(v)), F.lit(0)))

    state = lambda n, reason, field: F.struct(n.cast("bigint").alias("n"), reason.cast("string").alias("reason"), field.cast("string").alias("field"))

    def field_state(a: Column, f: Column) -> Column:
        return X.let_all(lambda x: value_state(a, f, x["v"], x["rows"]), v=F.try_element_at(record, f["name"]), rows=F.when(f["type"] == "rows", items(F.try_element_at(record, f["name"]))))

    def value_state(a: Column, f: Column, v: Column, rows: Column) -> Column:
        counted = rows.isNotNull() & F.size(rows).between(1, f["max_rows"])
        grown = lambda r, row: X.let(r["n"] + characters(row), lambda n: state(n, F.coalesce(row_reason(row, f["columns"]), F.when(n > MAX_ROW_CHARACTERS, "total-length")), f["name"]))
        after = F.aggregate(rows, state(a["n"], F.lit(None), f["name"]), lambda r, row: F.when(r["reason"].isNotNull(), r).otherwise(grown(r, row)))
        scalar = F.when(f["type"] == "checkbox", F.when(F.coalesce(kind(v) != "BOOLEAN", F.lit(True)), "not-boolean")).otherwise(F.coalesce(text_reason(v, limit(f)), extra(v)))
        missing = ~F.map_contains_key(record, f["name"])
        return F.when(missing, state(a["n"], F.lit("missing"), f["name"])).when(f["type"] != "rows", state(a["n"], scalar, f["name"])).when(counted, after).otherwise(state(a["n"], F.lit("row-count"), f["name"]))

    walked = F.aggregate(fields, state(F.lit(0), F.lit(None), F.lit(None)), lambda a, f: F.when(a["reason"].isNotNull(), a).otherwise(field_state(a, f)))
    return F.when(record.isNull(), verdict("not-object")).when(F.size(unknown) > 0, verdict("unknown-field", F.array_join(F.array_sort(unknown), ","))).otherwise(X.let(walked, lambda w: verdict(w["reason"], w["field"])))


def strings(values: Column) -> Column:
    """map of name to text of the scalar text values of a record, with line ends as LF."""
    entries = F.filter(F.transform(F.map_entries(members(values)), lambda e: F.struct(e["key"].alias("k"), X.newlines(string_of(e["value"])).alias("v"))), lambda e: e["v"].isNotNull())
    return F.map_from_entries(entries)


def loss_verdict(report: Column) -> Column:
    """E_PRESERVATION unless a writer's report (variant) says that nothing was lost: a count of 0 and an empty list."""
    own = members(report)
    losses = F.try_element_at(own, F.lit("losses"))
    none = (F.try_variant_get(F.try_element_at(own, F.lit("count")), "$", "double") == 0) & (F.size(items(losses)) == 0)
    return F.when(~F.coalesce(is_object(report) & none, F.lit(False)), "E_PRESERVATION")


def unhandled(parts: Column, handled: Column) -> Column:
    """E_UNSUPPORTED if a part that holds fields isn't among those that are filled."""
    return F.when(F.size(F.array_except(parts, handled)) > 0, "E_UNSUPPORTED")
