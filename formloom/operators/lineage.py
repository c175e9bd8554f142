"""Cutting the lineage of iterated tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local master may do without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="formloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own there."""
    return f"{shared_dir(spark)}/formloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return large(df.checkpoint())


def large(df: DataFrame) -> DataFrame:
    """df, joined by sorting: a size guessed before a plan runs knows neither how many rows a function gives nor how many an array holds, and by it tables far beyond the driver's memory
    would be broadcast. Joins keep this for one input; what they give is to be marked again where it is guessed small."""
    return df.hint("merge")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to as many tasks as the session shuffles to, for rows that cost far more time than their bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows that a task sorts or groups, about.
ROWS = 300_000


def tasks_for(table: DataFrame) -> int:
    """How many tasks the rows of a stored table call for: the session's number, and more for a large table, so that what a task holds doesn't grow with it. Counting reads no column."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // ROWS))


#: Setting, and bytes that a Python worker gets at once, about. Spark's own limit is on rows, whose texts and packages may be of any size.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of few bytes, unless the session says otherwise, so that a worker's memory depends neither on the rows' size nor on the table's."""
    name, size = BATCH
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(size))


def registered(spark: SparkSession, source: type) -> None:
    """Make a data source known. Sources are looked up in the calling thread's active session, which a thread of its own need not have yet: making a table sets it."""
    spark.createDataFrame([], "x int")
    spark.dataSource.register(source)
