"""Edits of byte ranges as rows, merged with what they leave untouched in one sorted pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.sources.markup import TAG
from formloom.sources.packages import attribute

EDIT = ["path", "part", "segment", "start", "stop", "replacement", "attributes", "content_of"]


def splice(bodies: DataFrame, segments: DataFrame, edits: DataFrame) -> DataFrame:
    """path, part, body, error of parts (path, part, body) written anew: segments (path, part, segment, start, stop) are copied in the order of their numbers,
    any range as often as it is named, each with its own edits (EDIT) in it. An edit puts its replacement in the place of a range; with attributes (a map) the range is an opening
tag, which gets these; with content_of (an element's name) the range is that element, which keeps its opening tag and gets the replacement as its content.

    A part's bytes, its segments and its edits meet in one sorted stream; nothing but that one part is held. Edits that overlap or leave their segment give
    E_PRESERVATION."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    none = [null("map<string,string>", "attributes"), null("string", "content_of")]
    copied = segments.select("path", "part", "segment", F.lit(0).alias("turn"), "start", "stop", null("binary", "replacement"), *none)
    changed = edits.select("path", "part", "segment", F.lit(1).alias("turn"), "start", "stop", F.col("replacement").cast("binary").alias("replacement"), "attributes", "content_of")
    return run_script(bodies, copied.unionByName(changed))


#: What a script's row says of a part: a segment (turn 0) or an edit in it (turn 1).
STEP = "struct<segment:int,turn:int,start:int,stop:int,replacement:binary,attributes:map<string,string>,content_of:string>"


def step(segment: Column, turn: int, start: Column, stop: Column, replacement: Column | None = None, attributes: Column | None = None, content_of: Column | None = None) -> Column:
    """A script's row as a struct."""
    null = F.lit(None)
    return F.struct(segment, F.lit(turn), start, stop, *[null if c is None else c for c in (replacement, attributes, content_of)]).cast(STEP)


def run_script(bodies: DataFrame, script: DataFrame) -> DataFrame:
    """The same for a script (path, part, fields of STEP) of segments and edits."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    none = [null("map<string,string>", "attributes"), null("string", "content_of")]
    body = bodies.select("path", "part", F.lit(-1).alias("segment"), F.lit(0).alias("turn"), null("int", "start"), null("int", "stop"), F.col("body").alias("replacement"), *none)
    script = body.unionByName(script)
    parts = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = script.repartition(parts, "path", "part").sortWithinPartitions("path", "part", "segment", "turn", "start", "stop")
    return sorted_.mapInArrow(_run, "path string, part string, body binary, error string")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _Part()
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:2] != state.key:
                out += state.done()
                state = _Part(row[:2])
            state.take(*row[2:])
            if len(out) >= 64:
                yield _packed(out)
                out = []
        yield _packed(out)
    yield _packed(state.done())


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "part", "body", "error"])


class _Part:
    """The part that is being written: what is copied so far, and up to where."""

    def __init__(self, key: tuple | None = None):
        self.key, self.body, self.out, self.at, self.end, self.sound = key, None, [], 0, 0, True

    def take(self, segment: int, turn: int, start: int, stop: int, text: bytes | None, attributes: list | None, content_of: str | None) -> None:
        if segment < 0:
            self.body = text
        elif self.body is None or not self.sound:
            self.sound = False
        elif turn == 0:
            self.close()
            self.at, self.end = start, stop
            self.sound = 0 <= start <= stop <= len(self.body)
        else:
            self.sound = self.at <= start <= stop <= self.end
            self.out += [self.body[self.at : start], self.new(start, stop, text or b"", attributes, content_of)]
            self.at = stop

    def new(self, start: int, stop: int, text: bytes, attributes: list | None, content_of: str | None) -> bytes:
        if attributes:
            tag = self.body[start:stop]
            for name, value in attributes:
                tag = attribute(tag, name, value)
            return tag
        if content_of:
            opening = TAG.match(self.body, start)[0]
            return (opening[:-2].rstrip() + b">" if opening.endswith(b"/>") else opening) + text + f"</{content_of}>".encode()
        return text

    def close(self) -> None:
        self.out.append(self.body[self.at : self.end])
        self.at = self.end

    def done(self) -> list[tuple]:
        if self.key is None or self.body is None:
            return []
        if self.sound:
            self.close()
        return [(*self.key, b"".join(self.out) if self.sound else None, None if self.sound else "E_PRESERVATION")]
