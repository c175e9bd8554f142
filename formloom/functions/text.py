"""Column functions on template texts: markers, substitution, edits, verdicts on values."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker syntax, the identifier rule, and the blanks that count as empty.
MARKER = r"\{\{([\s\S]*?)\}\}"
NAME = r"\A[A-Za-z][A-Za-z0-9_]{0,63}\z"
RESERVED = ("constructor", "prototype", "__proto__")
BLANK = r"\A[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*\z"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
BLANKS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MAX_LENGTH = 10_000

SPACES = BLANKS.replace(r"\n", "").replace(r"\r", "")
INNER = rf"(?:[^{BLANKS[1:-1]}]++|{SPACES}++(?=[\p{{M}}\x{{200D}}]))"
#: A piece of text up to a line end or a run of blanks, or the rest. A run of blanks that a mark or joiner follows is no end.
BREAK = rf"{INNER}*+(?:\r\n|\r|\n|{SPACES}++)|{INNER}++"


def let(value: Column, f) -> Column:
    """f of a value that is worked out once: an expression that a lambda names is worked out again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def let_all(f, **values: Column) -> Column:
    """f of a struct of several such values."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), f)


def marker_names(text: Column) -> Column:
    """Names in markers, in order; whatever stands in the braces."""
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))


def between_markers(text: Column) -> Column:
    return F.split(text, MARKER, -1)


def unclosed(text: Column) -> Column:
    """Braces are left when all markers are taken out."""
    return F.regexp_replace(text, MARKER, "").rlike(r"\{\{|\}\}")


def valid_name(name: Column) -> Column:
    return name.rlike(NAME) & ~name.isin(*RESERVED)


def fill(text: Column, values: Column) -> Column:
    """All markers at once; what goes in is never looked at again. values: map of name to string. Null if any of the names has no value."""

    def filled(x: Column) -> Column:
        whole = F.concat_ws("", F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(F.get(x["put"], i), F.lit("")))))
        return F.when(~F.exists(x["put"], lambda v: v.isNull()), whole)

    put = let(values, lambda m: F.transform(marker_names(text), lambda n: F.try_element_at(m, n)))
    return let_all(filled, parts=between_markers(text), put=put)


def spans(text: Column) -> Column:
    """Array of (name, start, stop) of the markers, in code points from 0. Lengths are added up once."""

    def placed(x: Column) -> Column:
        grown = F.zip_with(x["names"], F.slice(x["parts"], 1, F.size(x["names"])), lambda n, p: F.length(n) + F.length(p) + 4)
        stops = F.aggregate(grown, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.zip_with(x["names"], F.slice(stops, 2, F.greatest(F.size(x["names"]), F.lit(0))), lambda n, stop: F.struct(n.alias("name"), (stop - F.length(n) - 4).alias("start"), stop.alias("stop")))

    return let_all(placed, names=marker_names(text), parts=between_markers(text))


def fields(text: Column) -> Column:
    """Array of (name, occurrences) of the markers, in the order in which names first appear. Sorted names are counted by their places."""

    def counted(names: Column) -> Column:
        return let_all(lambda x: F.transform(x["distinct"], lambda n: F.struct(n.alias("name"), F.size(F.filter(x["names"], lambda y: y == n)).alias("occurrences"))), distinct=F.array_distinct(names), names=names)

    return let(marker_names(text), counted)


def marker_verdict(text: Column) -> Column:
    """Null if all markers of a text are legal, else illegal-name or unclosed-marker."""
    return F.when(F.exists(marker_names(text), lambda n: ~valid_name(n)), "illegal-name").when(unclosed(text), "unclosed-marker")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def blank(text: Column) -> Column:
    return text.rlike(BLANK)


def too_long(value: Column, max_length: int = MAX_LENGTH) -> Column:
    """Whether a value is over the length, whatever else may be wrong with it. Null of null."""
    return F.length(value) > max_length


def text_verdict(value: Column, max_length: int = MAX_LENGTH) -> Column:
    """Null if a text value is fine, else the first reason: missing, blank, length, control."""
    return F.when(value.isNull(), "missing").when(blank(value), "blank").when(too_long(value, max_length), "length").when(value.rlike(CONTROL), "control")


def splice(text: Column, edits: Column) -> Column:
    """Applies edits (start, stop, replacement; code points, not overlapping) at once, in order of start."""
    ordered = F.array_sort(edits)
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, e: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["replacement"]).alias("out"), e["stop"].alias("at"))
    return F.aggregate(ordered, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def edits_overlap(edits: Column) -> Column:
    """Any edit starts before the one before it stops."""
    return let(F.array_sort(edits), lambda s: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(F.get(s, i)["start"] < F.get(s, i - 1)["stop"], F.lit(False))))


def edits_verdict(text: Column, edits: Column) -> Column:
    """Null if edits (start, stop, replacement) can be applied at once, else reversed, range or overlap."""
    return F.when(F.exists(edits, lambda e: e["stop"] < e["start"]), "reversed").when(F.exists(edits, lambda e: (e["start"] < 0) | (e["stop"] > F.length(text))), "range").when(edits_overlap(edits), "overlap")


def break_tokens(text: Column) -> Column:
    """The text cut after line ends and blanks where a grapheme ends, too: no cut stands before a combining mark or a joiner."""
    return F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))


def chunk_verdict(text: Column, budget: int) -> Column:
    """Null if chunks of budget code points can hold the text, else unbreakable-run or no-progress (blanks that don't fit)."""
    bare = lambda t: F.length(F.regexp_replace(t, f"{BLANKS}+$", ""))
    return let(break_tokens(text), lambda tokens: F.when(F.exists(tokens, lambda t: bare(t) > budget), "unbreakable-run").when(F.exists(tokens, lambda t: F.length(t) > budget), "no-progress"))


def greedy_chunks(text: Column, budget: int) -> Column:
    """Cuts a text at the ends of break tokens into chunks of at most budget code points, each as long as may be. Losslessly; null if it
    can't be done. One pass: each match is the longest that ends at a break."""
    chunks = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{budget}}}(?:(?<=\n)|(?<=\r)(?!\n)|(?<={SPACES})(?![{SPACES[1:-1]}\p{{M}}\x{{200D}}])|\z)"), F.lit(0))
    return let(chunks, lambda c: F.when(F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x)) == F.length(text), c))


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def nfc(text: Column) -> Column:
    """Composed form; Spark has no function for it."""

    def composed(texts: pa.Array) -> pa.Array:
        return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(composed, "string")(text)


def tri_state(value: Column) -> Column:
    """An on/off attribute: no value means on; null where the value is none of the known."""
    return F.when(value.isNull() | value.isin("1", "true", "on"), True).when(value.isin("0", "false", "off"), False)


def whole_number(value: Column) -> Column:
    """A safe non-negative integer, or null."""
    return F.when(value.rlike(r"\A[0-9]{1,16}\z") & (F.try_to_number(value, F.lit("9" * 16)) <= 2**53 - 1), value.try_cast("bigint"))


def exact_keys(json: Column, required: list[str], optional: list[str] | None = None) -> Column:
    """A JSON object has all the required keys and no others but the optional ones."""
    keys, need = F.json_object_keys(json), F.array(*map(F.lit, required))
    both = F.array(*map(F.lit, [*required, *(optional or [])]))
    return F.coalesce((F.size(F.array_except(need, keys)) == 0) & (F.size(F.array_except(keys, both)) == 0), F.lit(False))


def alias_for(name: Column) -> Column:
    """The name itself if legal, else field_ and the first 12 hex digits of its sha-256."""
    return F.when(valid_name(name), name).otherwise(F.concat(F.lit("field_"), F.substring(F.sha2(name.cast("binary"), 256), 1, 12)))


def mask(text: Column, taken: Column) -> Column:
    """Spans (start, stop) become as many spaces, so that offsets stay."""
    inside = F.transform(taken, lambda e: F.struct(F.least(e["start"], F.length(text)).alias("start"), F.least(e["stop"], F.length(text)).alias("stop")))
    return splice(text, F.transform(inside, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), F.repeat(F.lit(" "), e["stop"] - e["start"]).alias("replacement"))))


def strict_verdict(value: Column) -> Column:
    """text_verdict, and no marker braces or noncharacters in a value."""
    return F.coalesce(text_verdict(value), F.when(value.rlike(r"\{\{|\}\}"), "marker").when(value.rlike(r"[\x{FFFE}\x{FFFF}]"), "noncharacter"))


def last_font_size(appearance: Column) -> Column:
    """Operand of the last Tf of an appearance string, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(appearance, F.lit(r"([0-9.]+)\s+Tf\b"), F.lit(1)), F.lit(-1)).cast("double")


def balanced_state(stream: Column) -> Column:
    """q and Q nest and end closed, and there is no inline image."""
    ops = F.regexp_extract_all(stream, F.lit(r"(?<!\S)(q|Q|BI)(?!\S)"), F.lit(1))
    step = lambda a, o: F.when((a < 0) | (o == "BI"), -1).when(o == "q", a + 1).otherwise(a - 1)
    return F.aggregate(ops, F.lit(0), step) == 0


def set_attribute(tag: Column, name: str, value: Column) -> Column:
    """An opening tag whose attribute is replaced in place, or appended where there is none. The value is escaped."""
    found = rf'(\s{name}=)"[^"]*"'
    safe = F.regexp_replace(xml_escape(value), r"([\\$])", r"\\$1")
    put = F.regexp_replace(tag, F.lit(found), F.concat(F.lit('$1"'), safe, F.lit('"')))
    add = F.regexp_replace(tag, F.lit(r"\s*(/?)>$"), F.concat(F.lit(f' {name}="'), safe, F.lit('"$1>')))
    return F.when(tag.rlike(found), put).otherwise(add)


def output_verdict(source: Column, output: Column, exists: Column) -> Column:
    """Null if a result may be written there, else extension, same-path or exists."""
    ext = lambda p: F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext(source) != ext(output), "extension").when(source == output, "same-path").when(exists, "exists")
