"""Tables written to the folder that all executors share, to cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_own: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once, under spark.checkpoint.dir, or a folder of our own where that is unset, as in tests."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own.append("file://" + tempfile.mkdtemp(prefix="textsig-"))
    path = f"{(shared or _own[0]).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int = 8 << 20) -> DataFrame:
    """df in as many partitions as there are cores, where it is a table of so little (`least` bytes a core) that its files may be one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < least * cores
    return df.repartition(cores) if small else df


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in a total order: __part, a number that ascends, and __place from 1 in it, by a range-partitioned sort that is written."""
    return written(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) + 1), "ranked")


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with rank from 1 in a total order: the place in a part, and the number of rows in the parts before."""
    out = placed(df, *order)
    sizes = out.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = out.join(F.broadcast(before), "__part")  # a row for each partition
    return joined.withColumn("rank", F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")
