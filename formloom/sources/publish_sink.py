"""Publication in two phases: `df.write.format("published_documents").mode("append").save(folder)` for rows (name, content).

Tasks write to a staging folder of their own attempt, with sorted lists of what they wrote, and report by commit messages where these lists are. The driver merges
the lists and holds no more than a line of each, whatever their length; it publishes once all tasks have ended: each document gets its name without replacing any other (a link locally, a rename that refuses an existing name on HDFS; stores
that have neither are refused), and a manifest of the whole job comes last. A job with two documents of one name, or a name that is
taken, publishes nothing: what it put down is taken back. A failed task ends the job, and its stage goes (what a task still writes after that is in a folder that nobody reads); of a task that ran twice, only
the attempt whose message was committed is published.

The option `id` publishes the documents as one registration: they go to folder/id/<job>, and the manifest folder/id/manifest.json, which names the job, makes
it one. Of several writers of an id, the one whose manifest comes first has it. A job that died leaves nothing that blocks the id."""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from formloom.operators.lineage import registered

MANIFEST = "manifest.json"
#: Documents of a sorted list, and lists that are merged at once.
RUN, WAYS = 50_000, 200


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    #: Files that list name, staged path, bytes, sha256 of each document, sorted.
    lists: list[str]


def put_list(store, at: str, files: Iterable[list]) -> str:
    with store.open_output_stream(at, buffer_size=1 << 16) as f:
        for x in files:
            f.write(json.dumps(x).encode() + b"\n")
    return at


def get_list(store, at: str) -> Iterator[list]:
    with store.open_input_stream(at) as raw, io.TextIOWrapper(raw, "utf-8") as f:
        for line in f:
            yield json.loads(line)


def merged(store, lists: list[str]) -> Iterator[list]:
    return heapq.merge(*(get_list(store, at) for at in lists))


class Taken(RuntimeError):
    """E_OUTPUT_EXISTS: the name."""


def put_once(store, staged: str, final: str) -> None:
    """The staged file under its final name, which nothing may have."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(staged, final)
        except FileExistsError:
            raise Taken(f"E_OUTPUT_EXISTS: {os.path.basename(final)}") from None
        return
    if store.type_name != "hdfs":
        raise ValueError("E_UNSUPPORTED: this store can't refuse to replace a file")
    if store.get_file_info(final).type != fs.FileType.NotFound:
        raise Taken(f"E_OUTPUT_EXISTS: {final.rsplit('/', 1)[-1]}")
    try:
        store.move(staged, final)
    except OSError as e:  # another was faster: HDFS renames onto no existing name
        raise Taken(f"E_OUTPUT_EXISTS: {final.rsplit('/', 1)[-1]}") from e


class Publisher(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.id, self.job = options["path"].rstrip("/"), options.get("id"), uuid.uuid4().hex

    @property
    def stage(self) -> str:
        return f"{self.folder}/_staged-{self.job}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, stage = store_of(self.stage)
        task = TaskContext.get()
        own = f"{stage}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}" if task else f"{stage}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        lists, files = [], []
        for n, row in enumerate(iterator):
            name, content = row["name"], bytes(row["content"])
            if not name or "/" in name or name in (".", "..", MANIFEST) or name.startswith("_"):
                raise ValueError(f"E_INPUT: {name}")
            at = f"{own}/{n}"
            with store.open_output_stream(at) as f:
                f.write(content)
            files.append([name, at, len(content), hashlib.sha256(content).hexdigest()])
            if len(files) >= RUN:
                lists.append(put_list(store, f"{own}/list-{len(lists)}", sorted(files)))
                files = []
        if files:
            lists.append(put_list(store, f"{own}/list-{len(lists)}", sorted(files)))
        return Staged(lists)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        lists = [at for m in messages if m is not None for at in m.lists]
        store, top = store_of(f"{self.folder}/{self.id}" if self.id else self.folder)
        folder, stage = f"{top}/{self.job}" if self.id else top, store_of(self.stage)[1]
        manifest = f"{top}/{MANIFEST}" if self.id else f"{folder}/_published-{self.job}.json"
        published = 0
        try:
            store.create_dir(stage, recursive=True)
            while len(lists) > WAYS:
                lists = [put_list(store, f"{stage}/{uuid.uuid4().hex}", merged(store, lists[i : i + WAYS])) for i in range(0, len(lists), WAYS)]
            staged = f"{stage}/manifest"
            with store.open_output_stream(staged, buffer_size=1 << 16) as f:
                f.write(f'{{"job": {json.dumps(self.job)}, "documents": ['.encode())
                last = None
                for name, _, size, digest in merged(store, lists):
                    if name == last:
                        raise Taken(f"E_OUTPUT_EXISTS: {name}")
                    f.write((", " if last is not None else "").encode() + json.dumps({"name": name, "bytes": size, "sha256": digest}, ensure_ascii=False).encode())
                    last = name
                f.write(b"]}")
            store.create_dir(folder, recursive=True)
            for name, at, _, _ in merged(store, lists):
                put_once(store, at, f"{folder}/{name}")
                published += 1
            put_once(store, staged, manifest)
        except BaseException:
            for name, *_ in islice(merged(store, lists), published):
                store.delete_file(f"{folder}/{name}")
            if self.id and published:
                store.delete_dir(folder)
            raise
        finally:
            self.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        store, stage = store_of(self.stage)
        if store.get_file_info(stage).type != fs.FileType.NotFound:
            store.delete_dir(stage)


class PublishedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published_documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("E_OUTPUT_EXISTS: documents are never replaced")
        return Publisher(self.options)


def publish(documents: DataFrame, folder: str, id: str | None = None) -> None:
    """Documents (name, content) under folder, or as the registration id there: all or none."""
    registered(documents.sparkSession, PublishedDocuments)
    writer = documents.select("name", "content").write.format("published_documents").mode("append")
    (writer.option("id", id) if id else writer).save(folder)
