"""Relational operators of template processing: discovery, checks, catalogs, coverage, repeated rows, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.functions import text as X
from formloom.operators.coverage import STATES
from formloom.operators.lineage import cut


def discover(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, occurrences, field_no: fields of each document in the order in which they first appear. All within the row."""
    each = docs.select(key, F.posexplode(X.fields(F.col(text))).alias("no", "f"))
    return each.select(key, F.col("f.name").alias("name"), F.col("f.occurrences").cast("long").alias("occurrences"), (F.col("no") + 1).alias("field_no"))


def schema_difference(found: DataFrame, declared: DataFrame, on: list[str]) -> DataFrame:
    """Rows of only one side, as often as they are there more than on the other, with the side: a manifest matches if this is empty. Each side is read once, and
    equal rows are counted against each other before they are shuffled."""
    signed = found.select(*on, F.lit(1).alias("_n")).unionByName(declared.select(*on, F.lit(-1).alias("_n")))
    more = signed.groupBy(*on).agg(F.sum("_n").alias("_n")).filter("_n != 0")
    return more.select(*on, F.when(F.col("_n") > 0, "found").otherwise("declared").alias("side"), F.explode(F.array_repeat(F.lit(1), F.abs("_n").cast("int"))).alias("_n")).drop("_n")


def catalog(bundled: DataFrame, user: DataFrame) -> DataFrame:
    """id, title, origin, dropped: the bundled entry wins over a user's of the same id, the smaller title over others."""
    both = bundled.select("id", "title", F.lit("bundled").alias("origin"), F.lit(0).alias("r")).unionByName(user.select("id", "title", F.lit("user").alias("origin"), F.lit(1).alias("r")))
    n = F.row_number().over(Window.partitionBy("id").orderBy("r", "title"))
    return both.withColumn("n", n).select("id", "title", "origin", (F.col("n") > 1).alias("dropped"))


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """What an insert-if-absent adds."""
    return new.join(existing.select("id"), "id", "left_anti")


def coverage_verdict(slots: DataFrame, doc: str) -> DataFrame:
    """doc, code, slot: the first failing slot of inventories that come as rows (slot, status, location, evidence), null codes if none fails. All but blocked
    slots need evidence. (`coverage.inventory_verdict` judges whole inventories.)"""
    code = F.when(F.col("location").isNull() | X.blank(F.col("location")), "missing-location").when(~F.coalesce(F.col("status").isin(*STATES), F.lit(False)), "invalid-status").when((F.col("status") != "blocked") & F.col("evidence").isNull(), "missing-evidence")
    judged = slots.withColumn("code", code)
    return judged.groupBy(doc).agg(F.min(F.when(F.col("code").isNotNull(), F.struct("slot", "code"))).alias("e"), F.count("*").alias("slots")).select(doc, F.col("e.code").alias("code"), F.col("e.slot").alias("slot"), "slots")


def completion(slots: DataFrame, doc: str) -> DataFrame:
    """Counts by status and the completion status; a full document is never claimed complete."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = slots.groupBy(doc).agg(F.count("*").alias("declared"), *[of(s) for s in STATES])
    return out.withColumn("completion", F.when(F.col("blocked") > 0, "incomplete").otherwise("requires-review"))


def field_bijection(slot_fields: DataFrame, fields: DataFrame, doc: str) -> DataFrame:
    """doc, name, reason: unknown, duplicate or unmapped fields of a coverage inventory."""
    n = slot_fields.groupBy(doc, "name").agg(F.count("*").alias("n"))
    both = n.join(fields.select(doc, "name", F.lit(True).alias("known")), [doc, "name"], "full_outer")
    reason = F.when(F.col("known").isNull(), "unknown-field").when(F.col("n").isNull(), "unmapped-fields").when(F.col("n") > 1, "duplicate-field")
    return both.select(doc, "name", reason.alias("reason")).filter("reason is not null")


def repeat_plan(counts: DataFrame, doc: str, body: int) -> DataFrame:
    """Rows reused, cloned and removed when n records go into a body of that many rows."""
    n = F.col("n")
    return counts.select(doc, "n", F.least(n, F.lit(body)).alias("reused"), F.greatest(n - body, F.lit(0)).alias("cloned"), F.greatest(body - n, F.lit(0)).alias("removed"))


def repeat_fill(records: DataFrame, doc: str, order: list[str], template: str, values: dict) -> DataFrame:
    """doc, row_addr, line: one filled row for each record, numbered in order."""
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    row = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    return records.select(doc, row.alias("row_addr"), X.fill(F.lit(template), m).alias("line"))


def run_offsets(runs: DataFrame, doc: str, no: str, text: str, *kept: str) -> DataFrame:
    """start and stop of each run in the joined text, and the columns that are kept."""
    stop = F.sum(F.length(text)).over(Window.partitionBy(doc).orderBy(no).rowsBetween(Window.unboundedPreceding, 0))
    return runs.select(doc, no, (stop - F.length(text)).alias("start"), stop.alias("stop"), *kept)


def covering_runs(spans: DataFrame, runs: DataFrame, doc: str, block: int = 256) -> DataFrame:
    """doc, span_no, run_no, start, stop, takes_value: runs that a span (start, stop) covers in part; the first takes the value, the others are emptied. Both sides
    go to the blocks of the text that they touch, so the join is on equal blocks."""
    touched = lambda df, a, b: df.withColumn("_block", F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / block))))
    s = touched(spans.select(doc, "span_no", F.col("start").alias("a"), F.col("stop").alias("b")), "a", "b")
    r = touched(runs.select(doc, "run_no", "start", "stop"), "start", "stop")
    hit = s.join(r, [doc, "_block"]).filter("stop > a and start < b").drop("_block").distinct()
    return hit.select(doc, "span_no", "run_no", "start", "stop", "a", "b", (F.row_number().over(Window.partitionBy(doc, "span_no").orderBy("start")) == 1).alias("takes_value"))


def replaced_runs(spans: DataFrame, runs: DataFrame, doc: str, *kept: str) -> DataFrame:
    """doc, run_no, text of runs (run_no, start, stop, text) when each span (start, stop, value) is replaced: its value goes into the first run that it covers, the others lose
    their part. Runs follow one another without gaps and spans don't overlap, so one sweep in the order of places meets in each run the spans that begin there, and
    of those before it only the last one can reach into it. kept: columns of runs that stay."""
    none = F.lit(None)
    span = F.struct(F.col("start").cast("long").alias("a"), F.col("stop").cast("long").alias("b"), "value")
    r = runs.select(doc, F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), "run_no", F.col("stop").cast("long").alias("stop"), "text", none.cast("struct<a:bigint,b:bigint,value:string>").alias("span"), *kept)
    s = spans.select(doc, F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), span.alias("span"))
    w = Window.partitionBy(doc).orderBy("at", "kind", "run_no").rowsBetween(Window.unboundedPreceding, 0)
    met = r.unionByName(s, allowMissingColumns=True).select(doc, "at", "kind", F.last("run_no", ignorenulls=True).over(w).alias("run_no"), "stop", "text", F.last("span", ignorenulls=True).over(w).alias("span"), *kept)
    # spans before the first run are in none
    own = lambda c: F.max(F.when(F.col("kind") == 0, F.col(c))).alias(c)
    reaches = (F.col("kind") == 1) | (F.col("span.b") > F.col("at"))
    per = met.filter("run_no is not null").groupBy(doc, "run_no").agg(own("at"), own("stop"), own("text"), *[own(c) for c in kept], F.collect_list(F.when(reaches, F.struct("kind", "span"))).alias("spans"))
    hit = F.filter("spans", lambda x: (F.col("stop") > x["span"]["a"]) & (F.col("at") < x["span"]["b"]))
    edit = lambda x: F.struct((F.greatest(x["span"]["a"], "at") - F.col("at")).cast("int").alias("start"), (F.least(x["span"]["b"], "stop") - F.col("at")).cast("int").alias("stop"), F.when(x["kind"] == 1, x["span"]["value"]).otherwise("").alias("replacement"))
    return per.withColumn("edits", F.transform(hit, edit)).select(doc, "run_no", F.when(F.size("edits") == 0, F.col("text")).otherwise(X.splice(F.col("text"), F.col("edits"))).alias("text"), *kept)


def nesting(tokens: DataFrame, doc: str, no: str, change: str) -> DataFrame:
    """doc, max_depth, min_depth, last_depth, balanced of open (+1) and close (-1) tokens."""
    depth = F.sum(change).over(Window.partitionBy(doc).orderBy(no).rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("depth", depth).groupBy(doc).agg(F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"), F.max_by("depth", no).alias("last_depth")).withColumn("balanced", (F.col("min_depth") >= 0) & (F.col("last_depth") == 0))


def nearest_ancestor(nodes: DataFrame, ancestors: DataFrame, doc: str, tasks: int | None = None) -> DataFrame:
    """Each node's innermost container (doc, id, start, stop that nest): one sweep over what opens and closes. Open containers are counted;
    a node under n of them lies in the one that opened last as the n-th. tasks: as many as the rows call for (`lineage.tasks_for`), else the session's number."""
    none = F.lit(None).cast("long")
    event = lambda df, at, kind, change, node, anc: df.select(doc, F.col(at).alias("at"), F.lit(kind).alias("kind"), F.lit(change).alias("change"), node.alias("id"), anc.alias("ancestor"))
    own = F.col("id").cast("long")
    # at one place what ends goes first, then nodes, then what begins there
    events = event(ancestors, "stop", 0, -1, none, none).unionByName(event(nodes, "start", 1, 0, own, none)).unionByName(event(ancestors, "start", 2, 1, none, own))
    events = events.repartition(tasks, doc) if tasks else events
    opened = F.sum("change").over(Window.partitionBy(doc).orderBy("at", "kind", F.coalesce("ancestor", "id")).rowsBetween(Window.unboundedPreceding, 0))
    level = events.withColumn("level", opened).filter("kind > 0")
    last = F.last("ancestor", ignorenulls=True).over(Window.partitionBy(doc, "level").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return level.withColumn("holder", last).filter("kind = 1 and level > 0").select(doc, "id", F.col("holder").alias("ancestor"))


def single_child(children: DataFrame, parent: str, kind: str, of: str) -> DataFrame:
    """parent, child, verdict: the one child of a kind that each parent must have; missing or ambiguous where it is not one."""
    n = children.groupBy(parent).agg(F.count_if(F.col(kind) == of).alias("n"), F.min(F.when(F.col(kind) == of, F.col("id"))).alias("child"))
    return n.select(parent, F.when(F.col("n") == 1, F.col("child")).alias("child"), F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").alias("verdict"))


def boxes_overlap(boxes: DataFrame, group: str) -> DataFrame:
    """Pairs of overlapping boxes (id, x, y, w, h) of a group (a page).

    Boxes are dealt to the cells of grids. A grid's cells are as large as a power of two at least as large as the box, so a box touches four cells of its own grid at most,
    however sizes differ; of two sizes, the box of the smaller one is dealt to the larger one's grid as well. A pair may meet in several cells: it counts in the one that holds
    the upper left corner of what the boxes share. Work grows with the boxes and the pairs in a cell, not with the square of a page."""
    positive = boxes.filter("w > 0 and h > 0")
    side = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("w", "h").cast("double")))).cast("int")
    b = positive.select(group, *[F.col(c).alias(c) for c in ("id", "x", "y", "w", "h")], side.alias("level"))
    levels = b.select(group, F.col("level").alias("grid")).distinct()
    size = lambda: F.pow(F.lit(2.0), F.col("grid"))
    span = lambda at, long: F.sequence(F.floor(F.col(at) / size()), F.floor((F.col(at) + F.col(long)) / size()))
    # few sizes: a page has a grid for each power of two that its boxes have
    dealt = b.join(levels, group).filter("grid >= level").withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    own = dealt.filter("grid = level")
    other = dealt.select(group, "grid", "cx", "cy", *[F.col(c).alias(f"{c}2") for c in ("id", "x", "y", "w", "h", "level")])
    met = own.join(other, [group, "grid", "cx", "cy"]).filter("x < x2 + w2 and x2 < x + w and y < y2 + h2 and y2 < y + h and (level > level2 or (level = level2 and id < id2))")
    met = met.filter((F.floor(F.greatest("x", "x2") / size()) == F.col("cx")) & (F.floor(F.greatest("y", "y2") / size()) == F.col("cy")))
    return met.select(group, F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def level_check(records: DataFrame, doc: str, no: str, level: str) -> DataFrame:
    """Records whose level rises by more than one, and the ordinal of their paragraph (level 0 starts one)."""
    w = Window.partitionBy(doc).orderBy(no)
    para = F.sum((F.col(level) == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return records.select(doc, no, para.alias("paragraph"), (F.col(level) <= F.coalesce(F.lag(level).over(w), F.lit(-1)) + 1).alias("ok"))


def style_chains(styles: DataFrame) -> DataFrame:
    """id, root, depth, cycle of styles (id, parent): parents are followed by doubling the distance at each round, so a chain of n takes
    log n joins and cycles one more. A chain that comes back to itself ends at its least member and is a cycle; depth counts parents up to the root."""
    step = styles.select("id", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("depth"))
    known = styles.select(F.col("id").alias("known")).distinct()
    # a parent that isn't defined ends the chain as well
    step = step.join(known, F.col("up") == F.col("known"), "left").select("id", F.when(F.col("known").isNotNull(), F.col("up")).alias("up"), "depth", F.when(F.col("known").isNull(), F.col("up")).alias("outside"))
    step = cut(step)
    state = step.select("id", F.coalesce("outside", F.when(F.col("up").isNull(), F.col("id"))).alias("root"), "up", "depth")
    left = state.filter("up is not null").count()
    for _ in range(state.count().bit_length() + 1):
        if not left:
            break
        far = state.select(F.col("id").alias("via"), F.col("root").alias("root2"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        state = cut(state.join(far, F.col("up") == F.col("via"), "left").select("id", F.coalesce("root", "root2").alias("root"), F.when(F.col("up").isNotNull(), F.col("up2")).alias("up"), (F.col("depth") + F.when(F.col("up").isNotNull(), F.coalesce("depth2", F.lit(0))).otherwise(0)).alias("depth")))
        before, left = left, state.filter("up is not null").count()
        # whoever is as far from an end as a round reaches has a style above it for each smaller distance: a round that ends none leaves cycles alone
        if left == before:
            break
    return state.select("id", "root", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("cycle"))


def style_properties(styles: DataFrame, doc: str) -> DataFrame:
    """doc, id, props, depth, reason of styles (doc, id, type, parent, props map, conditional): all properties that hold for a style, each set by the nearest
    style of its chain that sets it.

    Pointer jumping: a state is how far a style has looked and what it found there; two states join into one of twice the reach, the nearer one's properties before the farther one's (maps
    merge associatively), so a chain of n takes log n rounds whatever the number of properties. Reasons, the first that the chain meets: an id that several styles have, a
    parent that isn't there, a parent of another type, a style whose properties depend on a condition, a chain that comes back to itself."""
    n = styles.groupBy(doc, "id").agg(F.count("*").alias("n"), F.first("type").alias("type"), F.first("parent").alias("parent"), F.first("props").alias("props"), F.bool_or(F.coalesce("conditional", F.lit(False))).alias("conditional"))
    known = n.select(doc, F.col("id").alias("parent"), F.col("type").alias("above"), F.col("n").alias("many"))
    x = n.join(known, [doc, "parent"], "left")
    lost = F.col("parent").isNotNull() & F.col("above").isNull()
    reason = F.when(F.col("n") > 1, "ambiguous-style").when(F.col("conditional"), "conditional-style").when(lost, "missing-style").when(F.col("above") != F.col("type"), "ambiguous-style")
    state = cut(x.select(doc, "id", F.when(F.col("above").isNotNull() & reason.isNull(), F.col("parent")).alias("up"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), F.lit(0).cast("long").alias("depth"), reason.alias("reason")))
    longest = styles.groupBy(doc).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        if not state.filter("up is not null").limit(1).count():
            break
        far = state.select(doc, F.col("id").alias("up"), F.col("up").alias("up2"), F.col("props").alias("props2"), F.col("depth").alias("depth2"), F.col("reason").alias("reason2"))
        nearer = F.map_concat("props", F.map_filter(F.coalesce("props2", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.col("props"), k)))
        jumped = F.col("up").isNotNull()
        state = cut(state.join(far, [doc, "up"], "left").select(doc, "id", F.when(jumped, F.col("up2")).alias("up"), nearer.alias("props"), (F.col("depth") + F.when(jumped, F.col("depth2") + 1).otherwise(0)).alias("depth"), F.coalesce("reason", F.when(jumped, F.col("reason2"))).alias("reason")))
    # who still looks up after as many rounds as the longest chain could take goes round
    reason = F.when(F.col("up").isNotNull(), "cyclic-style").otherwise(F.col("reason"))
    return state.select(doc, "id", F.when(F.col("up").isNull(), F.col("props")).alias("props"), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), reason.alias("reason"))


def effective_property(chain: DataFrame, direct: DataFrame, doc: str) -> DataFrame:
    """doc, value, source: a property set directly, else by the nearest style of the chain (doc, depth, value, conditional) that sets it. A
    conditional style on the way makes it ambiguous."""
    found = chain.groupBy(doc).agg(F.min(F.when(F.col("value").isNotNull(), F.struct("depth", "value"))).alias("f"), F.min(F.when(F.col("conditional"), F.col("depth"))).alias("c"))
    both = direct.select(doc, F.col("value").alias("own")).join(found, doc, "full_outer")
    ambiguous = F.col("own").isNull() & (F.col("c") <= F.coalesce("f.depth", "c"))
    return both.select(doc, F.when(~F.coalesce(ambiguous, F.lit(False)), F.coalesce("own", "f.value")).alias("value"), F.when(F.col("own").isNotNull(), "direct").when(F.coalesce(ambiguous, F.lit(False)), "ambiguous").when(F.col("f").isNotNull(), "style").otherwise("none").alias("source"))


def dangling(references: DataFrame, definitions: DataFrame, on: list[str]) -> DataFrame:
    """References without a definition."""
    return references.join(definitions.select(*on).distinct(), on, "left_anti")
