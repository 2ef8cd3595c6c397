"""Session helpers: table reading, parallelism, lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """The scan ``df`` in at least ``per_core`` partitions per core, for stages whose cost is CPU and not bytes.

    A scan that is already split finely enough (always so at scale) is returned untouched, so large inputs pay no
    shuffle; a table in one small file would otherwise run its Python stage on one core.
    """
    spark = df.sparkSession
    want = per_core * spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def spread_shuffled(df: DataFrame, scan: DataFrame | None = None, per_core: int = 3) -> DataFrame:
    """spread() of a frame behind a shuffle of ``scan``, whose partitions adaptive execution would merge by bytes.

    It is not asked for its partitions, as that would run the shuffle. Where ``scan`` itself has partitions enough, what is
    shuffled once has them too, and is left as it is.
    """
    spark = df.sparkSession
    if scan is not None and scan.rdd.getNumPartitions() >= per_core * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder that the cluster names."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="glossaflow-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
