"""Tables written between two steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset, a temporary one serves a local master only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it from there: ids drawn in it stay, lost executors cost no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like kept(), as a Parquet table, which takes a fraction of the disk: for wide or many rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(table: DataFrame, most: int = 50_000) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most so many."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def ranked(rows: DataFrame, by: list, out: str = "rank") -> DataFrame:
    """`rows` numbered from 1 in the order of `by`, over range partitions: no task sorts more than its range.

    `by` must tell all rows apart. Numbers don't depend on how the rows are partitioned.
    """
    placed = kept(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = placed.withColumn(out, F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    return inside.join(F.broadcast(parts), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")
