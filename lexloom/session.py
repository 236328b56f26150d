"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "lexloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over at least as many partitions as there are cores, by ``keys`` where given.

    A table that comes in fewer partitions (a small file, one row group) would
    leave cores idle in work that is heavy per row; larger tables pass
    through as they are.  With the key of the work that follows, its grouping
    and windows need no further exchange.
    """
    spark = df.sparkSession
    try:
        cores, parts = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    except PySparkException:  # a remote session tells neither; there the work is spread by the shuffle's own number
        cores, parts = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
    return df if parts >= cores else df.repartition(cores, *keys)
