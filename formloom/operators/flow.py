"""Records of compound files before and after a change, and whether every character of a changed paragraph stands on a page once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.functions import text as X
from formloom.operators.tables import first_reason

# Tags of a paragraph's records, bytes of a line's, and the bit that says that a text breaks.
HEADER, TEXT, SHAPE, LINE = 66, 67, 68, 69
LINE_BYTES, BREAK_BIT, TOP_BIT = 36, 1 << 10, 1 << 31


def little(data: Column, at: Column | int, n: int = 4) -> Column:
    """An unsigned little-endian number in binary data."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda k: F.conv(F.hex(F.substring(data, at + (k + 1), F.lit(1))), 16, 10).cast("long") * (1 << (8 * k))
    out = byte(0)
    for k in range(1, n):
        out = out + byte(k)
    return out


def as_text_record(text: Column) -> Column:
    return F.encode(F.concat(text, F.lit("\r")), "UTF-16LE")


def offsets(data: Column, size: int) -> Column:
    """Starts of the fixed-size entries of binary data."""
    return F.when(F.octet_length(data) >= size, F.sequence(F.lit(0), F.octet_length(data) - size, F.lit(size))).otherwise(F.array().cast("array<int>"))


def rising(numbers: Column) -> Column:
    """Each number is greater than the one before it."""
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(1))), lambda i: F.coalesce(F.get(numbers, i) > F.get(numbers, i - 1), F.lit(True)))


def target_verdict(targets: DataFrame, records: DataFrame) -> DataFrame:
    """doc, section, paragraph, reason of target paragraphs (text, first_field, single_line, keep_lines, keep_next, value) over records
    (doc, section, paragraph, record, tag, level, data): four plain records, the very text, nothing that keeps lines together, no tab in what goes in, sizes, and one
    character style from the first field on."""
    key = ["doc", "section", "paragraph"]
    own = records.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("record", "tag", "level", "data"))).alias("r"))
    x = targets.join(own, key, "left")
    data = lambda i: F.get("r", i)["data"]
    shaped = (F.transform("r", lambda r: r["tag"]) == F.array(*map(F.lit, (HEADER, TEXT, SHAPE, LINE)))) & (F.transform("r", lambda r: r["level"]) == F.array(*map(F.lit, (0, 1, 1, 1))))
    size = lambda i: F.octet_length(data(i))
    fits = (size(0) >= 22) & (size(2) >= 8) & (size(2) % 8 == 0) & (little(data(2), 0) == 0) & (size(3) > 0) & (size(3) % LINE_BYTES == 0)
    starts = X.let(data(2), lambda d: F.transform(offsets(d, 8), lambda at: little(d, at)))
    mixed = X.let(starts, lambda s: ~rising(s) | F.exists(s, lambda n: n > F.col("first_field")))
    reason = first_reason((~F.coalesce(shaped, F.lit(False)), "unsupported-anchor"), (data(1) != as_text_record(F.col("text")), "unsupported-anchor"), (F.col("single_line") | F.col("keep_lines") | F.col("keep_next"), "fixed-container"), (F.contains("value", F.lit("\t")), "unsupported-character"), (~fits, "unsupported-record"), (mixed, "mixed-character-styles"))
    return x.select(*key, reason.alias("reason"))


def record_changes(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """doc, section, record, reason of what may not have changed. before and after: doc, section, record, tag, level, paragraph, data; targets: doc, section,
    paragraph, text (the new one).

    Records pair by position. In a target's paragraph the header may change its counts and break bit, the text must be the new one, lines must
    be sound; lines of paragraphs after the first target of their section may move up and down; all else is the same."""
    key = ["doc", "section", "record"]
    side = lambda df, s: df.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("tag", "level", "paragraph", "data")])
    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    t = targets.select("doc", "section", F.col("paragraph").alias("paragraph_b"), "text")
    first = targets.groupBy("doc", "section").agg(F.min("paragraph").alias("first"))
    lines = after.filter(f"tag = {LINE} and level = 1").groupBy("doc", "section", F.col("paragraph").alias("paragraph_b")).agg((F.first(F.octet_length("data")) / LINE_BYTES).alias("lines"))
    x = both.join(t, ["doc", "section", "paragraph_b"], "left").join(first, ["doc", "section"], "left").join(lines, ["doc", "section", "paragraph_b"], "left")
    a, b, text = F.col("data_a"), F.col("data_b"), F.col("text")
    units = X.utf16_length(text)
    target = text.isNotNull() & (F.col("level_b") <= 1)
    part = lambda d, at, n: F.substring(d, F.lit(at + 1), F.lit(n))
    broken = F.contains(text, F.lit("\n"))
    header = (F.octet_length(a) == F.octet_length(b)) & (F.octet_length(b) >= 22) & (little(a, 0) == (little(b, 0).bitwiseAND(F.lit(TOP_BIT))) + units + 1) & (little(a, 4) == little(b, 4) - little(b, 4).bitwiseAND(F.lit(BREAK_BIT)) + F.when(broken, BREAK_BIT).otherwise(0)) & (part(a, 8, 8) == part(b, 8, 8)) & (little(a, 16, 2) == F.col("lines")) & (part(a, 18, 1 << 20) == part(b, 18, 1 << 20))
    signed = lambda d, at: F.when(little(d, at) >= TOP_BIT, little(d, at) - 2 * TOP_BIT).otherwise(little(d, at))
    starts = F.transform(offsets(a, LINE_BYTES), lambda at: little(a, at))
    sound = (F.octet_length(b) > 0) & (F.octet_length(b) % LINE_BYTES == 0) & (F.octet_length(a) > 0) & (F.octet_length(a) % LINE_BYTES == 0) & X.let(starts, lambda s: rising(s) & (F.get(s, 0) == 0) & F.forall(s, lambda n: n <= units)) & F.forall(offsets(a, LINE_BYTES), lambda at: (signed(a, at + 8) > 0) & (signed(a, at + 12) > 0) & (signed(a, at + 28) > 0))
    moved = (F.octet_length(a) == F.octet_length(b)) & (F.octet_length(b) % LINE_BYTES == 0) & F.forall(offsets(b, LINE_BYTES), lambda at: (F.substring(a, at + 1, F.lit(4)) == F.substring(b, at + 1, F.lit(4))) & (F.substring(a, at + 9, F.lit(LINE_BYTES - 8)) == F.substring(b, at + 9, F.lit(LINE_BYTES - 8))))
    later = (F.col("tag_b") == LINE) & (F.col("level_b") == 1) & (F.col("paragraph_b") > F.col("first"))
    reason = (
        F.when(a.isNull() | b.isNull(), "record-count")
        .when((F.col("tag_a") != F.col("tag_b")) | (F.col("level_a") != F.col("level_b")) | (F.col("paragraph_a") != F.col("paragraph_b")), "record-structure")
        .when(target & (F.col("tag_b") == HEADER), F.when(~F.coalesce(header, F.lit(False)), "target-header"))
        .when(target & (F.col("tag_b") == TEXT), F.when(a != as_text_record(text), "target-text"))
        .when(target & (F.col("tag_b") == LINE), F.when(~F.coalesce(sound, F.lit(False)), "target-lines"))
        .when(later, F.when(~F.coalesce(moved, F.lit(False)), "later-lines"))
        .when(a != b, "other-record")
    )
    return x.select(*key, reason.alias("reason")).filter("reason is not null")


def grafted(old: DataFrame, new: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Streams (keys, body): the new body for changed keys, the old one for all others."""
    n = new.join(changed.select(*keys), keys, "left_semi").select(*keys, F.col("body").alias("new"))
    return old.join(n, keys, "left").select(*keys, F.coalesce("new", "body").alias("body"), F.col("new").isNotNull().alias("changed"))


def character_coverage(targets: DataFrame, runs: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """doc, paragraph, pages, reason of target texts over laid-out runs (doc, paragraph, parent, page, char_start, text, x, y, w, h, page_w, page_h): runs outside their
    page; characters that aren't the text's, stand twice, or (but for line ends) nowhere. Runs in cells and headers don't count for the paragraph of the same number."""
    own = runs.filter("parent is null").join(targets.select("doc", "paragraph", F.col("text").alias("whole")), ["doc", "paragraph"])
    out = (F.trim("text") != "") & ((F.col("x") < -tolerance) | (F.col("y") < -tolerance) | (F.col("w") < 0) | (F.col("h") <= 0) | (F.col("x") + F.col("w") > F.col("page_w") + tolerance) | (F.col("y") + F.col("h") > F.col("page_h") + tolerance))
    # a run covers a range: ranges are compared, not single characters
    start, stop = F.col("char_start"), F.col("char_start") + F.length("text")
    w = Window.partitionBy("doc", "paragraph").orderBy("char_start", "page")
    last = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.substring("whole", F.coalesce(F.col("last"), F.lit(0)) + 1, F.col("char_start") - F.coalesce(F.col("last"), F.lit(0)))
    x = own.withColumn("last", last).withColumn("gap", gap)
    per = x.groupBy("doc", "paragraph").agg(F.bool_or(out).alias("out"), F.bool_or((F.substring("whole", start + 1, F.length("text")) != F.col("text")) | (start < 0) | (stop > F.length("whole"))).alias("other"), F.bool_or(start < F.col("last")).alias("twice"), F.bool_or(F.replace("gap", F.lit("\n"), F.lit("")) != "").alias("gap"), F.max(stop).alias("stop"), F.countDistinct("page").alias("pages"))
    t = targets.join(per, ["doc", "paragraph"], "left")
    rest = F.replace(F.substring("text", F.coalesce("stop", F.lit(0)) + 1, F.length("text")), F.lit("\n"), F.lit(""))
    reason = first_reason((F.col("out"), "page-overflow"), (F.col("other") | F.col("twice"), "ambiguous-field"), (F.col("gap") | (rest != ""), "no-progress"))
    return t.select("doc", "paragraph", F.coalesce("pages", F.lit(0)).alias("pages"), reason.alias("reason"))


def last_characters(fields: DataFrame, doc: str) -> DataFrame:
    """doc, name, at: where the last character of each value (no line end) stands in the new text, fields (name, start, stop, value) growing one after another."""
    w = Window.partitionBy(doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("value") - (F.col("stop") - F.col("start"))).over(w), F.lit(0))
    kept = F.length(F.regexp_replace("value", r"\n+$", ""))
    return fields.select(doc, "name", (F.col("start") + shift + kept - 1).cast("long").alias("at"))


def tail_style(paragraphs: DataFrame, key: list[str], flow: bool) -> DataFrame:
    """key, style, reason of paragraphs (styles, one a character; first_field): one style from the first field on (of the whole paragraph, if text may not flow)."""
    tail = F.col("first_field") if flow else F.lit(0)
    rest = F.slice("styles", tail + 1, F.greatest(F.size("styles"), F.lit(1)))
    x = paragraphs.withColumn("rest", rest)
    return x.select(*key, F.when(F.size(F.array_distinct("rest")) == 1, F.get("rest", 0)).alias("style"), F.when(F.size(F.array_distinct("rest")) != 1, "mixed-character-styles").alias("reason"))


def unique_blocks(paragraphs: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """doc, paragraph, block, reason: the one block of body text with a target paragraph's text."""
    n = blocks.filter("kind in ('paragraph', 'heading')").groupBy(doc, "text").agg(F.count("*").alias("n"), F.min("block").alias("block"))
    x = paragraphs.join(n, [doc, "text"], "left")
    return x.select(doc, "paragraph", F.when(F.col("n") == 1, F.col("block")).alias("block"), F.when(F.coalesce("n", F.lit(0)) != 1, "ambiguous-field").alias("reason"))


def with_fallback(strict: DataFrame, flow: DataFrame, key: str) -> DataFrame:
    """key, fields, required of models (fields, error): the strict one, or the flowing one where only the strict one fails to preserve."""
    a, b = strict.select(key, F.col("fields").alias("f1"), F.col("error").alias("e1")), flow.select(key, F.col("fields").alias("f2"), F.col("error").alias("e2"))
    falls = (F.col("e1") == "E_PRESERVATION") & F.col("e2").isNull()
    return a.join(b, key, "left").select(key, F.when(F.col("e1").isNull(), F.col("f1")).when(falls, F.col("f2")).alias("fields"), F.when(falls, "flow").alias("required"), F.when(F.col("e1").isNotNull() & ~F.coalesce(falls, F.lit(False)), F.col("e1")).alias("error"))
