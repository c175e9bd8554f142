"""Positional operators on parts, runs, rows and pages. All of them shuffle once, by document (or key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def before_this(*order):
    return lambda doc: Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def paired_fields(begins: DataFrame, ends: DataFrame, doc: str) -> DataFrame:
    """doc, id, start, stop, verdict of begins (doc, id, start) and ends (doc, id, stop): duplicate, unpaired, reversed, overlap or null."""
    both = begins.select(doc, "id", "start", F.lit(None).cast("long").alias("stop")).unionByName(ends.select(doc, "id", F.lit(None).cast("long").alias("start"), "stop"))
    one = both.repartition(doc).groupBy(doc, "id").agg(F.count("start").alias("b"), F.count("stop").alias("e"), F.min("start").alias("start"), F.min("stop").alias("stop"))
    own = F.when((F.col("b") > 1) | (F.col("e") > 1), "duplicate").when((F.col("b") == 0) | (F.col("e") == 0), "unpaired").when(F.col("stop") <= F.col("start"), "reversed")
    reached = F.max(F.when(F.col("own").isNull(), F.col("stop"))).over(before_this("start", "id")(doc))
    verdict = F.coalesce("own", F.when(reached > F.col("start"), "overlap"))
    return one.withColumn("own", own).select(doc, "id", "start", "stop", verdict.alias("verdict"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right, verdict: rows of both sides belong together one by one if no verdict is set. Counts are combined before the shuffle."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = both.groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    verdict = F.when((F.col("n_left") == 0) | (F.col("n_right") == 0), "orphan").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
    return n.withColumn("verdict", verdict)


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str, allowed: DataFrame | None = None) -> DataFrame:
    """keys, verdict (removed, added, changed) of what differs, but for the allowed keys. With a record number as key it compares by position."""
    b, a = before.select(*keys, F.col(value).alias("was"), F.lit(True).alias("b")), after.select(*keys, F.col(value).alias("now"), F.lit(True).alias("a"))
    verdict = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    out = b.join(a, keys, "full_outer").select(*keys, verdict.alias("verdict")).filter("verdict is not null")
    return out if allowed is None else out.join(allowed.select(*keys), keys, "left_anti")


def fan_out(paragraphs: DataFrame, doc: str, no: str, n: str) -> DataFrame:
    """doc, no, first, last: where the n paragraphs that each one became stand afterwards; also the shift of offsets when fields grow."""
    first = F.coalesce(F.sum(n).over(before_this(no)(doc)), F.lit(0))
    return paragraphs.select(doc, no, first.cast("long").alias("first"), (first + F.col(n) - 1).cast("long").alias("last"))


def following(nodes: DataFrame, marks: DataFrame, doc: str) -> DataFrame:
    """doc, id, start, mark: the first mark (doc, start, mark) that starts after each node. A window over both, not a range join."""
    both = nodes.select(doc, "start", "id", F.lit(None).cast("long").alias("mark"), F.lit(0).alias("side")).unionByName(marks.select(doc, "start", F.lit(None).cast("long").alias("id"), "mark", F.lit(1).alias("side")))
    # at equal starts marks come first: what starts at the same place doesn't follow
    w = Window.partitionBy(doc).orderBy("start", F.col("side").desc(), "mark").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("next", F.first("mark", ignorenulls=True).over(w)).filter("side = 0").select(doc, "id", "start", F.col("next").alias("mark"))


def consecutive(entries: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, page, ok: each page comes right after the one before it."""
    last = F.lag(page).over(Window.partitionBy(doc).orderBy(page))
    return entries.select(doc, page, F.coalesce(F.col(page) == last + 1, F.lit(True)).alias("ok"))


def style_clones(used: DataFrame, doc: str, style: str, own_id: str) -> DataFrame:
    """doc, style, new_id: one clone of each distinct style, numbered from the largest id of its document."""
    s = used.groupBy(doc, style).agg(F.max(own_id).alias("m"))
    w = Window.partitionBy(doc)
    return s.select(doc, style, (F.max("m").over(w) + F.row_number().over(w.orderBy(style))).cast("long").alias("new_id"))


def readdressed(rows: DataFrame, doc: str, order: list[str], height: str) -> DataFrame:
    """doc, order, row_addr, top, table_height: rows numbered anew, and the table as high as its rows."""
    w = Window.partitionBy(doc)
    top = F.coalesce(F.sum(height).over(before_this(*order)(doc)), F.lit(0))
    return rows.select(doc, *order, (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("row_addr"), top.cast("long").alias("top"), F.sum(height).over(w).cast("long").alias("table_height"))


def added_pages(chunks: DataFrame, doc: str, field: str, most: int = 256) -> DataFrame:
    """doc, added, over: pages that continued fields add, one for each chunk after a field's first."""
    n = chunks.groupBy(doc, field).agg(F.count("*").alias("n")).groupBy(doc).agg(F.sum(F.col("n") - 1).alias("added"))
    return n.withColumn("over", F.col("added") > most)


def insert_before(children: DataFrame, doc: str, no: str, rank: str, new: int) -> DataFrame:
    """doc, before: the first child that ranks after a new one; null: it goes last."""
    return children.groupBy(doc).agg(F.min(F.when(F.col(rank) > new, F.col(no))).cast("long").alias("before"))


def lookup(targets: DataFrame, files: DataFrame, entries: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, origin: a file of that name, else the catalog entry; null where neither is."""
    f, e = files.select(key, F.col(value).alias("f")), entries.select(key, F.col(value).alias("e"))
    out = targets.select(key).join(f, key, "left").join(e, key, "left")
    return out.select(key, F.coalesce("f", "e").alias(value), F.when(F.col("f").isNotNull(), "file").when(F.col("e").isNotNull(), "catalog").alias("origin"))


def fan_out_changes(before: DataFrame, after: DataFrame, doc: str) -> DataFrame:
    """doc, no, reason of paragraphs (no, text expected, n that it became) whose n paragraphs afterwards (no, text), joined by line ends, are other than expected, and of
    paragraphs left over. Places are running sums, so both sides meet on equal numbers."""
    # texts stay out of the rows that a paragraph became: each would carry the whole text
    each = fan_out(before, doc, "no", "n").select(doc, F.col("no").alias("of"), F.explode(F.sequence("first", "last")).alias("at"))
    now = after.select(doc, F.col("no").cast("long").alias("at"), F.col("text").alias("now"))
    both = each.join(now, [doc, "at"], "full_outer")
    got = both.filter("of is not null").groupBy(doc, "of").agg(F.array_sort(F.collect_list(F.struct("at", "now"))).alias("got"))
    said = before.groupBy(doc, F.col("no").alias("of")).agg(F.first("text").alias("text"))
    own = got.join(said, [doc, "of"])
    changed = own.filter(~F.col("text").eqNullSafe(F.array_join(F.transform("got", lambda x: x["now"]), "\n"))).select(doc, F.col("of").cast("long").alias("no"), F.lit("changed").alias("reason"))
    return changed.unionByName(both.filter("of is null").select(doc, F.col("at").alias("no"), F.lit("left-over").alias("reason")))
