"""Cutting lineage, and running sums over a whole table without putting it into one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the folder in spark.checkpoint.dir, its lineage cut; where that is unset, a local one if the master is local, else an error."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        where, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not where and master != "local" and not master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[Column], value: Column, name: str, within: list[str] | None = None) -> DataFrame:
    """`df` with the sum of `value` over all rows up to this one, in an order without ties; with `within`, apart for each value of these columns.

    Rows are dealt by ranges, so a hot key is spread over tasks; each range sums its own, and what a key has in the
    ranges before is carried by at most one row for each range.
    """
    keys = within or []
    dealt = settled(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_own"))
    way = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.sum("_own").over(way)).where("_before is not null").select(*keys, "_part", "_before")
    own = F.sum(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    carried = dealt.withColumn("_run", own).join(F.broadcast(before), [*keys, "_part"], "left")
    return carried.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_run")).drop("_part", "_run", "_before")


def numbered(df: DataFrame, order: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """`df` with the position of each row, from 0, in an order without ties; with `within`, apart for each value of these columns."""
    return running(df, order, F.lit(1).cast("long"), name, within).withColumn(name, F.col(name) - 1)
