"""Template catalogs: manifests read from folders, checked, united and looked up; registration and publication of new files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formloom.functions import text as X
from formloom.functions import values as V
from formloom.sources.publish_sink import Taken, put_once

# What a manifest must say.
ID, HASH, FORMATS, MAX_JSON, MAX_TITLE = r"\A[a-z0-9]+(-[a-z0-9]+)*\z", r"\A[a-f0-9]{64}\z", ("hwp", "hwpx", "docx", "pdf"), 2 << 20, 200
MANIFEST = f"struct<schemaVersion:int,id:string,version:string,title:string,category:string,format:string,file:string,sha256:string,license:string,source:string,fields:array<{V.FIELD}>>"


def strict_json(content: Column) -> Column:
    """The text of a JSON file of legal size in valid UTF-8 (a byte order mark is taken off), null for any other."""
    text = F.regexp_replace(content.cast("string"), r"\A\x{FEFF}", "")
    return F.when((F.octet_length(content) <= MAX_JSON) & F.is_valid_utf8(content.cast("string")) & F.try_parse_json(text).isNotNull(), text)


def manifest_of(json: Column) -> Column:
    """The manifest's struct; names of the JSON file are in camel case."""
    renamed = json
    for a, b in (("maxLength", "max_length"), ("maxRows", "max_rows")):
        renamed = F.regexp_replace(renamed, f'"{a}"(\\s*:)', f'"{b}"$1')
    return F.from_json(renamed, MANIFEST)


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID) & (F.length(c) <= 64), F.lit(False))


def manifest_verdict(m: Column) -> Column:
    """Why a manifest is invalid: what it must say, its file and hash, its fields, or that there are none."""
    said = (m["schemaVersion"] == 1) & valid_id(m["id"]) & ~X.blank(m["title"]) & m["format"].isin(*FORMATS)
    file = (m["file"] == F.concat(F.lit("template."), m["format"])) & m["sha256"].rlike(HASH)
    bad = F.coalesce(V.fields_reason(m["fields"]), F.when(F.size(m["fields"]) == 0, V.verdict("no-fields")))
    return F.when(~F.coalesce(said, F.lit(False)), V.verdict("manifest", code="E_INPUT")).when(~F.coalesce(file, F.lit(False)), V.verdict("file-or-hash", code="E_INPUT")).otherwise(bad)


def scanned(spark: SparkSession, folder: str, origin: str) -> DataFrame:
    """name, origin, json, file of the manifests one level under a folder; names that begin with a dot are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").load(folder)
    at = F.regexp_extract(F.col("path"), r"([^/]+)/manifest\.json$", 1)
    depth = F.size(F.split(F.regexp_replace("path", "^file:/+", "/"), "/")) - len(os.path.abspath(folder).split("/") if "://" not in folder else folder.rstrip("/").split("/"))
    return raw.filter(depth == 2).select(at.alias("name"), F.lit(origin).alias("origin"), strict_json(F.col("content")).alias("json"), F.regexp_replace("path", r"manifest\.json$", "").alias("folder")).filter("name not like '.%'")


def entries(manifests: DataFrame) -> DataFrame:
    """rank, name, origin, manifest, file, warning of manifests (name, origin bundled or user, json, folder): bundled ones first, each by name.

    The first entry of an id stands; what is invalid, in a folder of another name or met before is a warning and no entry."""
    m = manifests.withColumn("m", manifest_of(F.col("json"))).withColumn("rank", F.when(F.col("origin") == "bundled", 0).otherwise(1))
    own = F.when(F.col("m").isNull(), "E_INPUT").otherwise(F.coalesce(manifest_verdict(F.col("m"))["code"], F.when(F.col("m.id") != F.col("name"), "E_INPUT")))
    judged = m.withColumn("own", own)
    before = F.row_number().over(Window.partitionBy("name", F.col("own").isNull()).orderBy("rank", "folder"))
    warning = F.coalesce("own", F.when(before > 1, "E_INPUT"))
    return judged.withColumn("warning", warning).select("rank", "name", "origin", F.when(F.col("warning").isNull(), F.col("m")).alias("manifest"), F.concat("folder", "m.file").alias("file"), "warning")


def listing(catalog: DataFrame) -> DataFrame:
    """id, title, format, origin, file, fields (their number) of the entries, in the catalog's order."""
    fine = catalog.filter("warning is null").orderBy("rank", "name")
    return fine.select(F.col("manifest.id").alias("id"), F.col("manifest.title").alias("title"), F.col("manifest.format").alias("format"), "origin", "file", F.size("manifest.fields").alias("fields"))


def warnings(catalog: DataFrame) -> DataFrame:
    return catalog.filter("warning is not null").select(F.lit("W_INVALID_TEMPLATE").alias("code"), F.col("name").alias("id"), F.col("warning").alias("reason"))


def show(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, manifest, file, origin, error of the wanted ids: E_INPUT for one that is no id or isn't there."""
    own = catalog.filter("warning is null").select(F.col("manifest.id").alias("id"), "manifest", "file", "origin")
    return wanted.select("id").join(own, "id", "left").select("id", "manifest", "file", "origin", F.when(F.col("manifest").isNull(), "E_INPUT").alias("error"))


def changed(found: DataFrame) -> DataFrame:
    """found (id, manifest, content) with error E_TEMPLATE_CHANGED where the file isn't the registered one any more."""
    return found.withColumn("error", F.when(F.sha2("content", 256) != F.col("manifest.sha256"), "E_TEMPLATE_CHANGED"))


def doctor(catalog: DataFrame) -> DataFrame:
    """format, ready, code: a format is ready if a bundled report template of it is a valid entry with fields."""
    wanted = catalog.sparkSession.createDataFrame([(f, f"report-{f}") for f in FORMATS], "format string, name string")
    fine = F.coalesce(F.bool_or(F.col("warning").isNull() & (F.size("manifest.fields") > 0)), F.lit(False))
    own = catalog.filter("origin = 'bundled'").join(wanted, "name", "right").groupBy("format").agg(fine.alias("ready"), F.min(F.coalesce("warning", F.when(F.col("manifest").isNull(), "E_INPUT"))).alias("code"))
    return own.select("format", "ready", F.when(~F.col("ready"), F.coalesce("code", F.lit("E_ENGINE"))).alias("code"))


def new_manifest(id_: Column, title: Column, form: Column, sha256: Column, fields: Column) -> Column:
    """The manifest of a registered file."""
    said = [F.lit(1).alias("schemaVersion"), id_.alias("id"), F.lit("1.0.0").alias("version"), F.trim(title).alias("title"), F.lit("custom").alias("category"), form.alias("format"), F.concat(F.lit("template."), form).alias("file"), sha256.alias("sha256"), F.lit("user-supplied").alias("license"), F.lit("user").alias("source"), fields.alias("fields")]
    return F.struct(*said)


def registration(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """id, manifest, error of files to register (id, title, format, sha256, fields): a wrong id or title, an id that is taken (by an entry, or
    by an earlier row of the same id) or no fields. What has no error may be added."""
    taken = catalog.filter("warning is null").select(F.col("manifest.id").alias("id"), F.lit(True).alias("taken")).distinct()
    first = F.row_number().over(Window.partitionBy("id").orderBy("sha256", "title"))
    x = new.join(taken, "id", "left").withColumn("nth", first)
    wrong = ~valid_id(F.col("id")) | F.coalesce(X.blank(F.col("title")), F.lit(True)) | (X.utf16_length(F.col("title")) > MAX_TITLE)
    fields = F.coalesce(V.fields_reason(F.col("fields"))["code"], F.when(F.size("fields") == 0, "E_FIELDS"))
    error = F.when(wrong, "E_INPUT").when(F.col("taken") | (F.col("nth") > 1), "E_OUTPUT_EXISTS").otherwise(fields)
    made = new_manifest(F.col("id"), F.col("title"), F.col("format"), F.col("sha256"), F.col("fields"))
    return x.withColumn("error", error).select("id", F.when(F.col("error").isNull(), made).alias("manifest"), "error")


def publish(files: DataFrame) -> DataFrame:
    """path, error of files (path, content) written without replacing any: E_OUTPUT_EXISTS where one is, E_UNSUPPORTED in a store that can't refuse to replace, E_IO where it can't be
    written. Each goes to a temporary name first and appears whole. A task that is run again finds its own file and counts it as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [put(p.as_py(), c.as_py()) for p, c in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "error"])

    def put(path: str, content: bytes) -> str | None:
        from pyarrow import fs as pafs

        fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        temporary = f"{at}.{uuid.uuid4().hex}.tmp"
        try:
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                with fs.open_input_file(at) as f:
                    return None if f.size() == len(content) and f.read() == content else "E_OUTPUT_EXISTS"
            with fs.open_output_stream(temporary) as f:
                f.write(content)
            put_once(fs, temporary, at)
            return None
        except Taken:
            return "E_OUTPUT_EXISTS"
        except ValueError:
            return "E_UNSUPPORTED"
        except OSError:
            return "E_IO"
        finally:
            if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
                fs.delete_file(temporary)

    return files.select("path", "content").mapInArrow(run, "path string, error string")


def generated(definitions: DataFrame) -> DataFrame:
    """id, title, format, lines, fields, example of template definitions (id, title, format, fields array of name, label, max_length): a line with a marker for each field, the
    fields of its manifest, and a JSON object of example values that are within their limits."""
    lines = F.concat(F.array("title"), F.transform("fields", lambda f: F.concat(f["label"], F.lit(": {{"), f["name"], F.lit("}}"))))
    none = F.lit(None)
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), F.lit("text").alias("type"), F.lit(1).alias("occurrences"), f["max_length"].cast("int").alias("max_length"), none.cast("int").alias("max_rows"), none.cast(f"array<{V.COLUMN}>").alias("columns")))
    example = F.to_json(F.map_from_arrays(F.transform("fields", lambda f: f["name"]), F.transform("fields", lambda f: F.substring(F.concat(F.lit("Example "), f["label"]), F.lit(1), f["max_length"].cast("int")))))
    return definitions.select("id", "title", "format", lines.alias("lines"), fields.alias("fields"), example.alias("example"))
