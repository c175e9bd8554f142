"""Coverage inventories: what a document's author says about each place that is to be filled. The checks come in a fixed order and the first
failure decides; verdicts carry a reason and the slot's index, never ids, locations or any other text of the author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.functions.values import is_object, items, kind, members, string_of

STATES = ("filled", "explicitly_excluded", "not_applicable", "blocked")
HASH = r"\A[a-f0-9]{64}\z"


def get(v: Column, key: str) -> Column:
    return F.try_element_at(members(v), F.lit(key))


def has_text(v: Column) -> Column:
    return F.coalesce(~X.blank(string_of(v)), F.lit(False))


def user_instruction(evidence: Column) -> Column:
    return is_object(evidence) & F.coalesce(string_of(get(evidence, "kind")) == "user-instruction", F.lit(False)) & has_text(get(evidence, "reference"))


def slots_of(inventory: Column) -> Column:
    return items(get(inventory, "slots"))


def slot_reason(slot: Column, i: Column, ids: Column) -> Column:
    """The first thing that is wrong with a slot."""
    return X.let(members(slot), lambda own: X.let(members(F.try_element_at(own, F.lit("evidence"))), lambda evidence: member_reason(own, evidence, i, ids)))


def member_reason(own: Column, evidence: Column, i: Column, ids: Column) -> Column:
    """The same of the slot's members and those of its evidence."""
    of = lambda m, key: F.try_element_at(m, F.lit(key))
    status, what = string_of(of(own, "status")), string_of(of(evidence, "kind"))
    names = items(of(evidence, "fields"))
    fields = F.coalesce((F.size(names) > 0) & F.forall(names, has_text), F.lit(False))
    instructed = F.coalesce(what == "user-instruction", F.lit(False)) & has_text(of(evidence, "reference"))
    return (
        F.when(own.isNull() | ~has_text(of(own, "id")), "invalid-slot-id")
        .when(F.array_position(ids, string_of(of(own, "id"))) <= i, "duplicate-slot-id")
        .when(~has_text(of(own, "location")), "missing-location")
        .when(~F.coalesce(status.isin(*STATES), F.lit(False)), "invalid-status")
        .when(status == "blocked", F.when(~(has_text(of(own, "reason")) & has_text(of(own, "nextAction"))), "missing-blocker-action"))
        .when(status == "explicitly_excluded", F.when(~instructed, "missing-exclusion-instruction"))
        .when(evidence.isNull(), "missing-evidence")
        .when(status == "not_applicable", F.when(~(F.coalesce(what == "applicability", F.lit(False)) & has_text(of(evidence, "condition")) & has_text(of(evidence, "reason"))), "missing-applicability"))
        .when(~F.coalesce(what.isin("fields", "external-review"), F.lit(False)), "invalid-filled-evidence")
        .when(what == "external-review", F.when(~has_text(of(evidence, "reference")), "missing-review-reference"))
        .when(~fields, "invalid-evidence-fields")
    )


def inventory_verdict(inventory: Column, sha256: Column, fields: Column) -> Column:
    """Struct (code, reason, slot) of an inventory (variant) for a document of this hash and with these field names; null if all is well or
    there is no inventory."""
    bad = lambda reason, slot=None, code="E_COVERAGE": F.struct(F.lit(code).alias("code"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.lit(None) if slot is None else slot).cast("int").alias("slot"))
    return X.let(slots_of(inventory), lambda slots: X.let(links_of(slots), lambda links: _verdict(inventory, sha256, fields, slots, links, bad)))


def links_of(slots: Column) -> Column:
    """name and slot of the fields that filled slots give as evidence, in order."""
    linked = lambda s: F.when((string_of(get(s, "status")) == "filled") & (string_of(get(get(s, "evidence"), "kind")) == "fields"), F.transform(items(get(get(s, "evidence"), "fields")), string_of))
    return F.flatten(F.transform(slots, lambda s, i: F.transform(F.coalesce(linked(s), F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), i.alias("i")))))


def _verdict(inventory: Column, sha256: Column, fields: Column, slots: Column, links: Column, bad) -> Column:
    version, scope = get(inventory, "version"), get(inventory, "scope")
    whole = F.coalesce(kind(version).rlike("BIGINT|DOUBLE|DECIMAL") & (F.try_variant_get(version, "$", "double") == 1), F.lit(False))
    named = F.when(~F.map_contains_key(members(inventory), "scope"), "full").otherwise(string_of(scope))
    ids = F.transform(slots, lambda s: string_of(get(s, "id")))
    failed = X.let(ids, lambda known: F.filter(F.transform(slots, lambda s, i: F.struct(i.alias("i"), slot_reason(s, i, known).alias("reason"))), lambda x: x["reason"].isNotNull()))
    names = F.transform(links, lambda x: x["name"])
    judged = X.let(names, lambda all_: F.transform(links, lambda x, k: F.struct(x["i"].alias("i"), F.when(~F.array_contains(fields, x["name"]), "unknown-field").when(F.array_position(all_, x["name"]) <= k, "duplicate-field").alias("reason"))))
    first, link = F.get(failed, 0), F.get(F.filter(judged, lambda x: x["reason"].isNotNull()), 0)
    return (
        F.when(inventory.isNull(), None)
        .when(~is_object(inventory) | ~whole, bad("invalid-version"))
        .when(~F.coalesce(string_of(get(inventory, "templateSha256")).rlike(HASH), F.lit(False)), bad("invalid-template-hash"))
        .when(~F.coalesce(named.isin("full", "partial"), F.lit(False)), bad("invalid-scope"))
        .when((named == "partial") & ~user_instruction(get(inventory, "scopeEvidence")), bad("missing-scope-instruction"))
        .when(slots.isNull(), bad("invalid-slots"))
        .when(F.size(failed) > 0, X.let(first, lambda x: bad(x["reason"], x["i"])))
        .when(string_of(get(inventory, "templateSha256")) != sha256, bad("template-hash", code="E_TEMPLATE_CHANGED"))
        .when(F.exists(judged, lambda x: x["reason"].isNotNull()), X.let(link, lambda x: bad(x["reason"], x["i"])))
        .when(F.size(F.array_distinct(names)) != F.size(F.array_distinct(fields)), bad("unmapped-fields"))
    )


def completion(inventory: Column, structure_only: bool = False, verified: Column | None = None) -> Column:
    """What may be said of a document's completeness: counts by status and kind of evidence. It never says that a document is complete."""
    of = lambda m, key: F.try_element_at(m, F.lit(key))
    # a slot is read once, for all counts
    judged = lambda own: X.let(string_of(of(own, "status")), lambda status: F.struct(status.alias("status"), F.when(status == "filled", string_of(get(of(own, "evidence"), "kind"))).alias("kind")))
    slots = lambda top: F.coalesce(F.transform(items(of(top, "slots")), lambda s: X.let(members(s), judged)), F.array().cast("array<struct<status:string,kind:string>>"))
    return X.let(members(inventory), lambda top: X.let(slots(top), lambda x: _completion(inventory.isNotNull(), string_of(of(top, "scope")), x, structure_only, verified)))


def _completion(known: Column, scope: Column, slots: Column, structure_only: bool, verified: Column | None) -> Column:
    count = lambda f: F.size(F.filter(slots, lambda s: F.coalesce(f(s), F.lit(False))))
    evidence = lambda k: lambda s: s["kind"] == k
    blocked = count(lambda s: s["status"] == "blocked")
    checked = F.lit("structure-only") if structure_only else F.when(known, "explicit-fields-and-manifest-consistency").otherwise("explicit-fields")
    n = F.lit(0) if verified is None else F.coalesce(verified, F.lit(0))
    return F.struct(
        F.coalesce(scope, F.lit("full")).alias("scope"),
        F.when(known & (blocked == 0), "requires-review").otherwise("incomplete").alias("status"),
        F.lit(False).alias("full_document_complete"),
        F.when(known, "declared").otherwise("not-provided").alias("inventory"),
        checked.alias("verification_scope"),
        F.size(slots).alias("declared"),
        count(evidence("fields")).alias("field_linked"),
        count(evidence("external-review")).alias("external"),
        count(lambda s: s["status"] == "explicitly_excluded").alias("excluded"),
        count(lambda s: s["status"] == "not_applicable").alias("not_applicable"),
        blocked.alias("blocked"),
        F.when(n > 0, "candidate-reread").otherwise("not-performed").alias("verification"),
        n.alias("verified_fields"),
    )


def slot_counts(slots: DataFrame, doc: str, documents: DataFrame | None = None) -> DataFrame:
    """The same counts of inventories that come as rows (doc, status, kind). Documents without any slot are incomplete."""
    of = lambda f, name: F.count_if(F.expr(f)).alias(name)
    n = slots.groupBy(doc).agg(F.count("status").alias("declared"), of("status = 'filled' and kind = 'fields'", "field_linked"), of("status = 'filled' and kind = 'external-review'", "external"), of("status = 'explicitly_excluded'", "excluded"), of("status = 'not_applicable'", "not_applicable"), of("status = 'blocked'", "blocked"))
    if documents is not None:
        n = documents.select(doc).join(n, doc, "left")
    known = F.col("declared").isNotNull()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("declared", "field_linked", "external", "excluded", "not_applicable", "blocked")]
    return n.select(doc, *counts, F.when(known & (F.col("blocked") == 0), "requires-review").otherwise("incomplete").alias("completion"), F.lit(False).alias("full_document_complete"))
