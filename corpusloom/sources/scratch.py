"""Tables that cut a plan: written once to a folder that the driver and all executors see, and read back as they are."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Sends the module's functions to executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode alone, a folder below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corpusloom"
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table of its own and the table's path: what follows reads rows instead of computing them again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written, once its results are read."""
    discard(spark, own_dir(spark))


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with name, each row's place from 0 in the order.

    The places come from a range sort and the sizes of its ranges, so no task sees more than its own range. The sort is
    written before its ranges are counted: two runs of one range sort may draw their bounds from different samples. It reads
    a written table too, so df is made once and only its keys are read for the sample. Broadcast are the starts, a row for
    each range.
    """
    made, made_path = written(df, "rows")
    keys = [F.col(x) if isinstance(x, str) else x for x in order]
    ordered = made.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__mono", F.monotonically_increasing_id())
    placed, _ = written(ordered.select(*made.columns, F.shiftright("__mono", 33).alias("__part"), F.col("__mono").bitwiseAND((1 << 33) - 1).alias("__place")), "ordered")
    discard(df.sparkSession, made_path)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")
