"""Shared pieces: where intermediate tables go, row keys, and byte access to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting by which Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a local master may do without that setting (as in tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="formloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/formloom-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files: what they gave is stored already."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor loses nothing. by: a column whose values get folders of their own."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._formloom_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_formloom_path", None):
            fs, path = filesystem(t._formloom_path)
            fs.delete_dir(path)


def dropped_parts(table: DataFrame, by: str, *values: str) -> None:
    """Delete the folders of some values of a table that was stored by a column."""
    from pyarrow import fs as pafs

    fs, path = filesystem(table._formloom_path)
    for folder in (f"{path}/{by}={v}" for v in values):
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


def row_key(*cols: str) -> Column:
    """A 64-bit key of the row's id and text. It decides together with doc_id, so only texts of one doc_id could meet."""
    return F.xxhash64(*[F.col(c) for c in cols])


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def filesystem(uri: str):
    """pyarrow filesystem and path of a URI or plain path; files outside local disks need pyarrow's driver for that store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
