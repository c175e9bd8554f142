"""The verbs of the command line: doctor, templates list | show | register, inspect, fill, validate. `python -m formloom.cli --help`.

Each builds the same plans as a table of documents would, for one document. A result is JSON on stdout, a failure JSON with its code on stderr."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators import catalog as K
from formloom.plans import engine


class Failed(Exception):
    """The arguments are the error code and details."""


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Failed("E_INPUT")


#: Where templates of the user are if --library doesn't say.
LIBRARY = os.path.expanduser("~/.local/share/formloom/templates")
#: Options and the verbs that take them.
OPTIONS = {"--library": ("doctor", "list", "show", "register", "fill"), "--id": ("register",), "--title": ("register",), "--data": ("fill",), "--output": ("fill",), "--overflow": ("fill",), "--dry-run": ("fill",), "--layout-profile": ("inspect", "fill"), "--coverage": ("inspect", "fill")}


def parser() -> Parser:
    p = Parser(prog="formloom")
    verbs = p.add_subparsers(dest="verb", required=True, parser_class=Parser)
    templates = verbs.add_parser("templates").add_subparsers(dest="action", required=True, parser_class=Parser)
    made = {"doctor": verbs.add_parser("doctor"), "inspect": verbs.add_parser("inspect"), "fill": verbs.add_parser("fill"), "validate": verbs.add_parser("validate")}
    made |= {k: templates.add_parser(k) for k in ("list", "show", "register")}
    for name, own in made.items():
        if name in ("inspect", "fill", "validate", "register", "show"):
            own.add_argument("target")
        own.add_argument("--bundled")
        for option, takers in OPTIONS.items():
            if name in takers:
                need = option in ("--id", "--title", "--data", "--output")
                own.add_argument(option, required=need, **({"action": "store_true"} if option == "--dry-run" else {"choices": ["preserve", "flow"]} if option == "--overflow" else {}))
    return p


def read(path: str | None) -> str | None:
    """A JSON file of legal size, strictly."""
    if path is None:
        return None
    try:
        with open(path, "rb") as f:
            data = f.read(K.MAX_JSON + 1)
        if len(data) > K.MAX_JSON:
            raise Failed("E_INPUT")
        text = data.decode("utf-8").removeprefix("﻿")
        json.loads(text)
        return text
    except OSError:
        raise Failed("E_IO") from None
    except ValueError:
        raise Failed("E_INPUT") from None


def document(spark: SparkSession, path: str) -> DataFrame:
    try:
        with open(path, "rb") as f:
            return spark.createDataFrame([(os.path.abspath(path), bytearray(f.read()))], "path string, content binary")
    except OSError:
        raise Failed("E_IO") from None


def catalog(spark: SparkSession, args) -> DataFrame:
    none = spark.createDataFrame([], "name string, origin string, json string, folder string")
    for folder, origin in ((args.bundled, "bundled"), (getattr(args, "library", None) or LIBRARY, "user")):
        if folder and os.path.isdir(folder):
            none = none.unionByName(K.scanned(spark, folder, origin))
    return K.entries(none)


def plain(row) -> dict:
    return json.loads(json.dumps(row.asDict(recursive=True), default=str))


def inspected(spark: SparkSession, docs: DataFrame, args) -> dict:
    path = docs.first()["path"]
    cover, profile = read(args.coverage), read(args.layout_profile)
    covers = None if cover is None else spark.createDataFrame([(path, cover)], "path string, inventory string")
    profiles = None if profile is None else spark.createDataFrame([(path, profile, False)], "path string, profile string, registered boolean")
    out = plain(engine.inspect(docs, covers, profiles).first())
    if out["code"]:
        raise Failed(out["code"], out["reason"])
    return {k: v for k, v in out.items() if k not in ("code", "reason")}


def run(args, spark: SparkSession) -> dict:
    verb = getattr(args, "action", None) or args.verb
    if verb == "doctor":
        formats = {r["format"]: {"ready": r["ready"]} | ({"code": r["code"]} if r["code"] else {}) for r in K.doctor(catalog(spark, args)).collect()}
        return {"ok": all(f["ready"] for f in formats.values()), "formats": formats}
    if verb == "list":
        own = catalog(spark, args).cache()
        return {"templates": [plain(r) for r in K.listing(own).collect()], "warnings": [plain(r) for r in K.warnings(own).collect()]}
    if verb == "show":
        got = K.show(catalog(spark, args), spark.createDataFrame([(args.target,)], "id string")).first()
        if got["error"]:
            raise Failed(got["error"])
        return plain(got["manifest"]) | {"file_path": got["file"], "origin": got["origin"]}
    if verb == "inspect":
        return inspected(spark, document(spark, args.target), args)
    if verb == "validate":
        out = plain(engine.validate(document(spark, args.target)).first())
        if out["code"]:
            raise Failed(out["code"])
        return {k: v for k, v in out.items() if k != "code"}
    return register(args, spark) if verb == "register" else fill(args, spark)


def register(args, spark: SparkSession) -> dict:
    args.library = args.library or LIBRARY
    docs = document(spark, args.target)
    info = engine.inspect(docs)
    bad = info.first()["code"]
    if bad:
        raise Failed(bad)
    columns = F.transform("fields", lambda f: f.dropFields("required"))
    new = info.select(F.lit(args.id).alias("id"), F.lit(args.title).alias("title"), "format", "sha256", columns.alias("fields"))
    got = K.registration(new, catalog(spark, args)).first()
    if got["error"]:
        raise Failed(got["error"])
    manifest = plain(got["manifest"])
    own = os.path.join(args.library, args.id)
    fields = [{a: f[b] for a, b in (("name", "name"), ("type", "type"), ("occurrences", "occurrences"), ("maxLength", "max_length")) if f[b] is not None} for f in manifest["fields"]]
    said = json.dumps(manifest | {"fields": fields}, ensure_ascii=False, indent=2).encode()
    # all of it appears at once under the id, or nothing; what a registration leaves that dies before has a name of its own and blocks nothing
    stage = os.path.join(args.library, f".{args.id}.{uuid.uuid4().hex}")
    os.makedirs(stage)
    try:
        for name, content in ((manifest["file"], bytes(docs.first()["content"])), ("manifest.json", said)):
            published(spark, os.path.join(stage, name), content)
        os.rename(stage, own)
    except OSError:
        raise Failed("E_OUTPUT_EXISTS") from None
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return {"id": args.id, "path": own, "manifest": manifest}


def published(spark: SparkSession, path: str, content: bytes) -> None:
    error = K.publish(spark.createDataFrame([(path, bytearray(content))], "path string, content binary")).first()["error"]
    if error:
        raise Failed(error)


def fill(args, spark: SparkSession) -> dict:
    if args.layout_profile and args.overflow != "flow":
        raise Failed("E_INPUT")
    values, manifests = read(args.data), None
    if os.path.isfile(args.target):
        docs = document(spark, args.target)
    else:
        got = K.show(catalog(spark, args), spark.createDataFrame([(args.target,)], "id string")).first()
        if got["error"]:
            raise Failed(got["error"])
        file = got["file"].removeprefix("file:")
        docs = document(spark, file)
        if K.changed(docs.withColumn("manifest", F.struct(F.lit(got["manifest"]["sha256"]).alias("sha256")))).first()["error"]:
            raise Failed("E_TEMPLATE_CHANGED")
        manifests = spark.createDataFrame([(os.path.abspath(file), got["manifest"]["fields"])], f"path string, fields array<{K.V.FIELD}>")
    path, output = docs.first()["path"], os.path.abspath(args.output)
    cover = read(args.coverage)
    covers = None if cover is None else spark.createDataFrame([(path, cover)], "path string, inventory string")
    request = spark.createDataFrame([(path, values, output, args.overflow, os.path.exists(output))], "path string, values string, output string, overflow string, output_exists boolean")
    report, filled = engine.fill(docs, request, covers, manifests)
    out = plain(report.first())
    if out["code"]:
        raise Failed(out["code"], *[out["field"]] if out["field"] else [])
    if not args.dry_run:
        if engine.unchanged(docs, document(spark, path)).first()["code"]:
            raise Failed("E_TEMPLATE_CHANGED")
        published(spark, output, bytes(filled.first()["content"]))
    return {k: v for k, v in out.items() if k not in ("code", "reason", "field")} | ({"dry_run": True} if args.dry_run else {})


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        out = {"ok": True} | run(args, spark or SparkSession.builder.master("local[2]").getOrCreate())
    except Failed as e:
        code = e.args[0] if e.args[0] in engine.CODES else "E_ENGINE"
        print(json.dumps({"ok": False, "error": {"code": code} | ({"details": e.args[1]} if e.args[1:] and e.args[1] else {})}), file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0 if out["ok"] else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
