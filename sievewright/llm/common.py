"""Helpers that all corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, on one machine only, a temporary one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def identified(docs: DataFrame, row_id: str, *columns: Column) -> DataFrame:
    """doc_id (null: the largest), copy (a hash of the text, which tells apart texts of one id), and columns, of which
    the first is the text, without nulls."""
    own = docs.select(F.coalesce(F.col(row_id).cast("long"), F.lit(LAST_ID)).alias("doc_id"), *columns)
    text = own.columns[1]
    return own.select("doc_id", F.xxhash64(text).alias("copy"), *own.columns[1:])


def with_node(docs: DataFrame) -> DataFrame:
    """Adds node to rows of identified(): a number that tells documents apart and rises with doc_id, then copy."""
    several = docs.groupBy("doc_id").agg((F.min("copy") < F.max("copy")).alias("several")).filter("several")
    if several.isEmpty():  # ids alone tell them apart
        return docs.withColumn("node", F.col("doc_id"))
    nodes = cut_lineage(numbered(docs.select("doc_id", "copy").distinct(), "doc_id", "copy"))
    return docs.join(nodes, ["doc_id", "copy"])


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds node, a number that rises with the order; its lineage is to be cut before the numbers are used twice."""
    many = partitions(df.sparkSession)
    return df.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())


def trim() -> None:
    """Gives memory that a worker no longer uses back."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    own = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if own:
        own(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which the worker, which lives on, trims its memory."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
