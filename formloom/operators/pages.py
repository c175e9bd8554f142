"""Forms on pages: widgets and their geometry, text that continues on added pages, and what must be as before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.functions import text as X
from formloom.operators.tables import first_reason

# Limits of continuations and names that a form may not hold.
MAX_ADDED, MAX_PAGES, MAX_MAPPING, MAX_LABEL, MAX_FOOTER, MAX_VALUE = 256, 4096, 500_000, 80, 240, 20_000
ACTIVE_NAMES = ("JavaScript", "JS", "AA", "OpenAction", "RichMediaContent", "EmbeddedFiles", "EF", "XFA", "ByteRange", "Perms", "DocMDP")
ACTIVE_ACTIONS = ("JavaScript", "Launch", "SubmitForm", "ImportData", "Rendition", "Movie", "Sound", "GoToR", "GoToE")
ONE_LINE = r"[\x00-\x1F\x7F\x{FFFE}\x{FFFF}]"


def valid_box(b: Column) -> Column:
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite(b["x"]) & finite(b["y"]) & finite(b["w"]) & finite(b["h"]) & (b["w"] > 0) & (b["h"] > 0), F.lit(False))


def inside(a: Column, b: Column) -> Column:
    return (a["x"] >= b["x"]) & (a["y"] >= b["y"]) & (a["x"] + a["w"] <= b["x"] + b["w"]) & (a["y"] + a["h"] <= b["y"] + b["h"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["w"]) & (a["x"] + a["w"] > b["x"]) & (a["y"] < b["y"] + b["h"]) & (a["y"] + a["h"] > b["y"])


def supported_geometry(f: str = "") -> Column:
    """A field (kind, read_only, multiline, widgets, pages, page, media, crop, rotation, widget_rotation, rect, border) of one upright widget on its page."""
    c = lambda name: F.col(f + name)
    zero = lambda b: (b["x"] == 0) & (b["y"] == 0)
    return F.coalesce((c("kind") == "text") & ~c("read_only") & (c("widgets") == 1) & (c("pages") == F.array(c("page"))) & valid_box(c("media")) & valid_box(c("crop")) & zero(c("media")) & zero(c("crop")) & (c("rotation") == 0) & (c("widget_rotation") == 0) & valid_box(c("rect")) & inside(c("rect"), c("crop")) & inside(c("crop"), c("media")) & (c("border") >= 0), F.lit(False))


def field_verdict(fields: DataFrame, doc: str) -> DataFrame:
    """doc, code: what a form's fields (name, kind, read_only, rich, password, file, comb, widgets, visible) don't allow. Signatures are no fields; names
    are unique among all."""
    c = F.col
    names = F.count("*").over(Window.partitionBy(doc, "name"))
    code = F.when((F.coalesce(F.length("name"), F.lit(0)) == 0) | (F.length("name") > MAX_PAGES) | (c("same") > 1), "E_FIELDS").when(c("kind") == "signature", None).when(~c("kind").isin("text", "checkbox") | c("read_only") | c("rich") | c("password") | c("file") | c("comb") | (c("widgets") == 0) | ~c("visible"), "E_UNSUPPORTED")
    x = fields.withColumn("same", names).withColumn("code", code)
    return x.groupBy(doc).agg(F.min(F.when(F.col("code").isNotNull(), F.struct("no", "code")))["code"].alias("code"))


def active_content(entries: DataFrame, doc: str) -> DataFrame:
    """doc, code of dictionary entries (key, value, signature_empty): actions, scripts, attachments, signatures. One name is enough."""
    bad = F.col("key").isin(*ACTIVE_NAMES) | ((F.col("key") == "S") & F.col("value").isin(*ACTIVE_ACTIONS)) | ((F.col("value") == "Sig") & ((F.col("key") == "Type") | ((F.col("key") == "FT") & ~F.coalesce("signature_empty", F.lit(False)))))
    return entries.groupBy(doc).agg(F.when(F.bool_or(F.coalesce(bad, F.lit(False))), "E_UNSUPPORTED").alias("code"))


def aliases(fields: DataFrame, doc: str) -> DataFrame:
    """doc, name, alias: the name itself if legal, else field_ and as many digits of its hash (12, 16 ... 56) as tell it from all names that are legal and from the
    aliases of the same length in its document; null where none does."""
    legal = X.valid_name(F.col("name"))
    digits = F.sha2(F.col("name").cast("binary"), 256)
    lengths = F.array(*[F.lit(n) for n in range(12, 57, 4)])
    tried = fields.select(doc, "name", legal.alias("legal")).withColumn("n", F.explode(F.when(~F.col("legal"), lengths).otherwise(F.array(F.lit(0)))))
    tried = tried.withColumn("alias", F.when(F.col("legal"), F.col("name")).otherwise(F.concat(F.lit("field_"), F.substring(digits, F.lit(1), F.col("n")))))
    same = F.count("*").over(Window.partitionBy(doc, "alias"))
    free = tried.withColumn("same", same).groupBy(doc, "name").agg(F.min(F.when((F.col("same") == 1) | F.col("legal"), F.struct("n", "alias")))["alias"].alias("alias"))
    return free


def value_verdict(values: DataFrame, glyphs: DataFrame) -> DataFrame:
    """doc, field, code, reason of values (doc, field, kind, value, checked, max_units, multiline, columns, lines): a text that is one, of at most max_units UTF-16 units, with
    characters of the font only (but line ends and tabs), on one line where there is one, and within its box by a budget of characters."""
    bad = values.filter("kind = 'text'").select("doc", "field", F.explode(F.array_distinct(F.split("value", ""))).alias("ch")).filter("ch != '' and ch not in ('\\r', '\\n', '\\t')").join(glyphs.select("ch"), "ch", "left_anti").select("doc", "field").distinct().withColumn("strange", F.lit(True))
    x = values.join(bad, ["doc", "field"], "left")
    v = F.col("value")
    illegal = v.isNull() | v.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]")
    text = first_reason((illegal, "type"), (X.utf16_length(v) > F.col("max_units"), "length"), (F.col("strange"), "glyph"), (~F.col("multiline") & v.rlike(r"[\r\n]"), "line-end"), (~fits(v, F.col("columns"), F.col("lines")), "overflow"))
    reason = F.when(F.col("kind") == "checkbox", F.when(F.col("checked").isNull(), "type")).otherwise(text)
    return x.select("doc", "field", reason.alias("reason"), F.when(reason == "glyph", "E_UNSUPPORTED").when(reason.isNotNull(), "E_FIELDS").alias("code"))


def fits(text: Column, columns: Column, lines: Column) -> Column:
    """Whether lines of so many characters hold the text: a budget in the place of a font's widths."""
    rows = F.transform(F.split(X.newlines(text), "\n", -1), lambda r: F.greatest(F.lit(1), F.ceil(F.length(r) / columns)).cast("int"))
    return F.aggregate(rows, F.lit(0), lambda a, n: a + n) <= lines


def label_verdict(labels: DataFrame, glyphs: DataFrame, width: float = 5.0, height: float = 12.0) -> DataFrame:
    """id, reason of labels (id, text, box): every character in the font, and one line of it in its box."""
    bad = labels.select("id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch != ''").join(glyphs.select("ch"), "ch", "left_anti").select("id").distinct().withColumn("strange", F.lit(True))
    wide = (F.length("text") * width > F.col("box.w") + 0.01) | (F.lit(height) > F.col("box.h") + 0.01)
    return labels.join(bad, "id", "left").select("id", F.when(F.coalesce("strange", F.lit(False)) | wide, "label-overflow").alias("reason"))


def profile_verdict(settings: DataFrame, fields: DataFrame, widgets: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, field, reason of continuation settings (doc, no, field, page, repeat_fields, label, label_box, footer, footer_box, source_box).

    In order: shape of the setting, its texts; the field's geometry; boxes that are wrong, outside their page, on a widget or on one another; the source boxes of a page;
    fields that repeat."""
    c = F.col
    own = Window.partitionBy("doc", "field").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    text = lambda t, n: t.isNotNull() & ~X.blank(t) & (X.utf16_length(t) <= n) & ~t.rlike(ONE_LINE)
    s = settings.join(pages.select("doc", F.col("page").alias("own_page"), "crop").withColumnRenamed("own_page", "page"), ["doc", "page"], "left").withColumn("again", F.count("*").over(own) > 0)
    shape = c("field").isNull() | c("again") | c("crop").isNull() | (F.size(F.array_distinct("repeat_fields")) != F.size("repeat_fields")) | (c("footer").isNull() != c("footer_box").isNull()) | ~F.coalesce(text(c("label"), MAX_LABEL), F.lit(False)) | (c("footer").isNotNull() & ~F.coalesce(text(c("footer"), MAX_FOOTER), F.lit(False)))
    good = fields.select("doc", "field", (supported_geometry() & c("multiline")).alias("good"), c("page").alias("field_page"), supported_geometry().alias("plain"))
    s = s.join(good.select("doc", "field", "good", "field_page"), ["doc", "field"], "left")
    boxes = F.array_compact(F.array("label_box", "footer_box", "source_box"))
    placed = s.select("doc", "no", "page", "crop", F.explode(boxes).alias("box"))
    hit = placed.join(widgets.select("doc", "page", "rect"), ["doc", "page"], "left").groupBy("doc", "no").agg(F.bool_or(~valid_box(c("box")) | ~inside(c("box"), c("crop")) | F.coalesce(overlaps(c("box"), c("rect")), F.lit(False))).alias("hit"))
    a, b = s.select("doc", "page", "no", "source_box"), s.select("doc", "page", c("no").alias("other"), c("source_box").alias("other_box"))
    notes = a.join(b, ["doc", "page"]).filter("other < no").groupBy("doc", "no").agg(F.bool_or(overlaps(c("source_box"), c("other_box"))).alias("notes"))
    again = s.select("doc", "no", c("field").alias("origin"), "page", F.explode("repeat_fields").alias("field")).join(good, ["doc", "field"], "left").groupBy("doc", "no").agg(F.bool_or((c("field") == c("origin")) | ~F.coalesce(c("plain") & (c("field_page") == c("page")), F.lit(False))).alias("bad_repeat"))
    x = s.join(hit, ["doc", "no"], "left").join(notes, ["doc", "no"], "left").join(again, ["doc", "no"], "left")
    reason = first_reason((shape, "invalid-profile"), (~F.coalesce(c("good") & (c("field_page") == c("page")), F.lit(False)), "unsupported-geometry"), (c("hit") | overlaps(c("label_box"), c("footer_box")) | c("notes"), "invalid-label-box"), (c("bad_repeat"), "invalid-repeat-field"))
    return x.select("doc", "no", "field", reason.alias("reason"))


def continuation(values: DataFrame, budget: int) -> DataFrame:
    """doc, no, field, chunks, prefix_length, length, sha256, reason of values (doc, no, field, value, planned) that don't fit budget characters: at least two chunks, a setting
    that says where they go, and at most MAX_ADDED pages for a field."""
    x = values.withColumn("chunks", X.greedy_chunks(F.col("value"), budget)).withColumn("bad", X.chunk_verdict(F.col("value"), budget))
    reason = first_reason((~F.col("planned"), "continuation-template-required"), (F.col("bad").isNotNull(), "unbreakable-run"), (F.size("chunks") < 2, "unrepresentable-layout"), (F.size("chunks") > MAX_ADDED + 1, "unrepresentable-layout"))
    fine = reason.isNull()
    return x.select("doc", "no", "field", F.when(fine, F.col("chunks")).alias("chunks"), F.when(fine, X.utf16_length(F.get("chunks", 0))).alias("prefix_length"), X.utf16_length(F.col("value")).alias("length"), F.sha2("value", 256).alias("sha256"), reason.alias("reason"))


def added_chunks(plans: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, field, part, page, name, label, chunk of plans (doc, no, field, chunks, label, source_page): each chunk after a field's first has a page of its own after those of the
    document (doc, pages) and of the fields before it."""
    w = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.size("chunks") - 1).over(w), F.lit(0))
    x = plans.withColumn("base", base).join(documents, "doc").select("doc", "field", "label", "source_page", "base", "pages", F.size("chunks").alias("n"), F.posexplode("chunks").alias("part", "chunk")).filter("part > 0")
    name = F.concat(F.lit("continuation_"), F.substring(F.sha2("field", 256), 1, 24), F.lit("_"), F.col("part").cast("string"))
    label = F.concat("label", F.lit(" - part "), (F.col("part") + 1).cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" - original form page "), F.col("source_page").cast("string"))
    return x.select("doc", "field", "part", (F.col("pages") + F.col("base") + F.col("part")).cast("long").alias("page"), name.alias("name"), label.alias("label"), "chunk")


def page_notes(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, page, notes: what is written on each source page, one line a field that goes on elsewhere, in the order of the fields."""
    first = chunks.groupBy("doc", "field").agg(F.min("page").alias("first"))
    x = plans.join(first, ["doc", "field"])
    notes = F.transform(F.array_sort(F.collect_list(F.struct("no", F.concat("label", F.lit(": page "), F.col("first").cast("string")).alias("text")))), lambda n: n["text"])
    return x.groupBy("doc", F.col("source_page").alias("page")).agg(notes.alias("notes"))


def overflowing_repeats(settings: DataFrame, overflowing: DataFrame) -> DataFrame:
    """doc, field of settings whose repeated fields overflow themselves."""
    each = settings.select("doc", "field", F.explode("repeat_fields").alias("r"))
    return each.join(overflowing.select("doc", F.col("field").alias("r")), ["doc", "r"], "left_semi").select("doc", "field").distinct()


def mapping(entries: DataFrame, doc: str, most: int = MAX_MAPPING) -> DataFrame:
    """doc, mapping, code: the entries of a document as JSON, refused beyond so many characters."""
    m = entries.groupBy(doc).agg(F.to_json(F.array_sort(F.collect_list(F.struct("no", *[c for c in entries.columns if c not in (doc, "no")])))).alias("mapping"))
    return m.select(doc, F.when(F.length("mapping") <= most, F.col("mapping")).alias("mapping"), F.when(F.length("mapping") > most, "E_LAYOUT").alias("code"))


def continued_verdict(entries: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, reason of documents read again (doc, original_pages, pages): entries (doc, no, origin, source_page, prefix, prefix_length, length, sha256) and their chunks
    (doc, origin, part, name, page, text). Origins are distinct and no chunks; chunks have their names and the pages that follow one another; texts add up to what was continued; no
    page is left over."""
    value = F.concat("prefix", F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    listed = chunks.groupBy("doc", "origin").agg(F.array_sort(F.collect_list(F.struct("part", "page", "name", "text"))).alias("parts"))
    e = entries.join(listed, ["doc", "origin"], "left")
    w = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.size("parts")).over(w), F.lit(0))
    e = e.withColumn("base", base).withColumn("same", F.count("*").over(Window.partitionBy("doc", "origin"))).join(documents, "doc")
    named = lambda p: p["name"] == F.concat(F.lit("continuation_"), F.substring(F.sha2("origin", 256), 1, 24), F.lit("_"), p["part"].cast("string"))
    paged = F.forall(F.transform("parts", lambda p, i: p["page"] == F.col("original_pages") + F.col("base") + i + 1), lambda ok: ok)
    own = first_reason(
        (F.col("parts").isNull() | (F.col("same") > 1) | (F.col("source_page") < 1) | (F.col("source_page") > F.col("original_pages")) | (F.col("length") > MAX_VALUE) | (F.col("prefix_length") < 1) | (F.col("prefix_length") >= F.col("length")), "entry"),
        (X.utf16_length(F.col("prefix")) != F.col("prefix_length"), "prefix"), (~F.forall("parts", named), "name"), (~paged, "page"), (F.exists("parts", lambda p: p["text"] == ""), "empty-chunk"), ((X.utf16_length(value) != F.col("length")) | (F.sha2(value, 256) != F.col("sha256")), "value"),
    )
    per = e.withColumn("reason", own).groupBy("doc").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("no", "reason")))["reason"].alias("reason"), F.sum(F.size("parts")).alias("added"), F.collect_set("origin").alias("origins"), F.flatten(F.collect_list(F.transform("parts", lambda p: p["name"]))).alias("names"))
    x = documents.join(per, "doc", "left")
    left = F.coalesce("added", F.lit(0)) != F.col("pages") - F.col("original_pages")
    return x.select("doc", F.coalesce("reason", first_reason((F.arrays_overlap("origins", "names"), "origin-is-chunk"), (left, "page-count"))).alias("reason"))


def repeat_contexts(contexts: DataFrame, fields: DataFrame) -> DataFrame:
    """doc, name, reason of contexts (doc, name, origin, value_sha256, bindings, added) that repeat fields (doc, name, value): known, not the origin, with the value
    whose hash was noted, once on each added page."""
    x = contexts.withColumn("same", F.count("*").over(Window.partitionBy("doc", "origin", "name"))).join(fields.select("doc", "name", "value"), ["doc", "name"], "left")
    reason = first_reason((F.col("value").isNull(), "unknown"), ((F.col("name") == F.col("origin")) | (F.col("same") > 1), "origin-or-twice"), (F.sha2("value", 256) != F.col("value_sha256"), "changed"), (F.col("bindings") != F.col("added"), "bindings"))
    return x.select("doc", "origin", "name", reason.alias("reason"))


def appearance_coordinates(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """id, reason of appearances (id, bbox, matrix, rect): the identity, and a box of the widget's size at the origin."""
    off = lambda a, b: F.abs(a - b) > tolerance
    b = lambda i: F.get("bbox", F.lit(i))
    bad = (F.size("bbox") != 4) | (F.coalesce("matrix", F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])) != F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])) | off(b(0), F.lit(0.0)) | off(b(1), F.lit(0.0)) | off(b(2), F.col("rect.w")) | off(b(3), F.col("rect.h"))
    return rows.select("id", F.when(F.coalesce(bad, F.lit(True)), "unsupported-appearance").alias("reason"))


def widget_graph(widgets: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc, widget, reason: widgets (doc, widget, field) and the annotations of pages (doc, page, widget, field_ref) belong together one by one."""
    w = widgets.groupBy("doc", "widget").agg(F.count("*").alias("owners"), F.first("field").alias("field"))
    a = annotations.groupBy("doc", "widget").agg(F.count("*").alias("places"), F.first("field_ref").alias("field_ref"))
    x = w.join(a, ["doc", "widget"], "full_outer")
    reason = first_reason((F.col("owners") > 1, "two-fields"), (F.col("owners").isNull(), "no-field"), (F.col("places").isNull(), "no-page"), (F.col("places") > 1, "two-pages"), (F.col("field_ref").isNotNull() & (F.col("field_ref") != F.col("field")), "other-parent"))
    return x.select("doc", "widget", reason.alias("reason"))


def field_pages(widgets: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc, field, pages: the pages that show a field, in order."""
    return widgets.join(annotations.select("doc", "widget", "page"), ["doc", "widget"]).groupBy("doc", "field").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def appearances(widgets: DataFrame) -> DataFrame:
    """doc, field, reason of widgets (doc, field, kind, state, states, bytes, embedded): a text shows a stream that isn't empty and embeds its font, a checkbox its state."""
    text = first_reason((F.coalesce("bytes", F.lit(0)) == 0, "no-appearance"), (~F.col("embedded"), "no-font"))
    own = F.when(F.col("kind") == "text", text).when(~F.coalesce(F.array_contains("states", F.col("state")), F.lit(False)), "no-appearance")
    return widgets.withColumn("reason", own).groupBy("doc", "field").agg(F.min("reason").alias("reason"))


def page_changes(before: DataFrame, after: DataFrame, noted: DataFrame) -> DataFrame:
    """doc, page, reason of page streams (doc, page, no, sha256): the same, but for pages with notes (doc, page), which have one stream before and two after the old ones."""
    listed = lambda df, c: df.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "sha256"))), lambda s: s["sha256"]).alias(c))
    x = listed(before, "b").join(listed(after, "a"), ["doc", "page"], "full_outer").join(noted.select("doc", "page", F.lit(True).alias("noted")), ["doc", "page"], "left")
    kept = F.when(F.coalesce("noted", F.lit(False)), (F.size("a") == F.size("b") + 3) & (F.slice("a", 2, F.greatest(F.size("b"), F.lit(0))) == F.col("b"))).otherwise(F.col("a") == F.col("b"))
    reason = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~kept, "changed")
    return x.select("doc", "page", reason.alias("reason"))


def canonical(entries: Column) -> Column:
    """A map as text that doesn't depend on the order of its keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
