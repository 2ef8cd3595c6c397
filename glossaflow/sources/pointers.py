"""Which files and ids to load, what is missing, and where it comes from instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.session import checkpointed


def file_name(ids: DataFrame, pattern: str, id_col: str = "id") -> DataFrame:
    """``ids`` with file: ``pattern`` with {id} or, padded with zeros to 8, {id!p} filled in."""
    plain = F.col(id_col).cast("string")
    padded = F.when(F.length(plain) < 8, F.lpad(plain, 8, "0")).otherwise(plain)
    return ids.withColumn("file", F.replace(F.replace(F.lit(pattern), F.lit("{id!p}"), padded), F.lit("{id}"), plain))


def collection_of(path: Column) -> Column:
    """The folder that holds a file, 'unknown' for a bare name."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(folder == "", "unknown").otherwise(folder)


def chunked(ids: DataFrame, size: int, order: str = "id") -> DataFrame:
    """``ids`` with chunk: the number of their block of ``size`` in order.

    Ids are ranked within ranges of a range partitioning and shifted by the sizes of the ranges before, so that no task
    holds them all.
    """
    spread = checkpointed(ids.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return spread.withColumn("__rank", rank).join(F.broadcast(sizes.withColumn("__before", before).drop("__n")), "__part").withColumn("chunk", F.floor((F.col("__rank") + F.col("__before")) / size)).drop("__part", "__rank", "__before")


def missing(requested: DataFrame, delivered: DataFrame, id_col: str = "id") -> DataFrame:
    """The requested ids that were not delivered, each once."""
    return requested.select(id_col).distinct().join(delivered.select(id_col).distinct(), id_col, "left_anti")


def with_fallback(requested: DataFrame, first: DataFrame, second: DataFrame, id_col: str = "id") -> DataFrame:
    """The articles of ``first``, and those of ``second`` for requested ids that ``first`` lacks; no third source is tried."""
    return first.unionByName(second.join(missing(requested, first, id_col), id_col, "left_semi"))


def pmc_number(c: Column) -> Column:
    """A PMC id without its prefix, in capitals."""
    return F.regexp_replace(F.upper(c), "^[PMC]+", "")
