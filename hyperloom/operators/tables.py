"""Totals, statistics and running sums of treelet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions import treelets
from hyperloom.plans.storage import running


def totals(table: DataFrame) -> DataFrame:
    """Each structure and color set with its count over all vertices."""
    return table.groupBy("s", "c").agg(F.sum("n").alias("n"))


def statistics(table: DataFrame) -> DataFrame:
    """One row: total, greatest count of a vertex and of a row, rows, and whether 64 bits hold the total."""
    by_vertex = table.groupBy("v").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("of"), F.max("n").alias("most"), F.count("*").alias("rows"))
    one = by_vertex.agg(F.coalesce(F.sum("of"), F.lit(0)).cast("decimal(38,0)").alias("total"), F.max("of").cast("decimal(38,0)").alias("max_vertex"), F.max("most").alias("max_row"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))
    return one.withColumn("fits_64", F.col("total") < F.expr("cast(18446744073709551616 as decimal(38,0))"))


def root_weights(table: DataFrame) -> DataFrame:
    return table.groupBy("v").agg(F.sum("n").alias("weight"))


def distinct_treelets(table: DataFrame) -> DataFrame:
    return table.select("s", "c").distinct()


def prefix(table: DataFrame) -> DataFrame:
    """`cum`: the running sum of counts at each vertex, structures descending, then colors."""
    order = Window.partitionBy("v").orderBy(F.desc("s"), "c").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("cum", F.sum("n").over(order))


def distribution(table: DataFrame) -> DataFrame:
    """`lo` and `hi`: where each row stands in the sum of all, vertices ascending, structures descending, then colors.

    Vertices get running sums over ranges, and the rows of one vertex are summed by a window.
    """
    roots = running(root_weights(table), [F.col("v")], F.col("weight"), "until").select("v", (F.col("until") - F.col("weight")).alias("base"))
    return prefix(table).join(roots, "v").select("v", "s", "c", "n", (F.col("base") + F.col("cum") - F.col("n")).alias("lo"), (F.col("base") + F.col("cum")).alias("hi"))


def selected(table: DataFrame, chosen: set[int], include: bool) -> DataFrame:
    """The rows whose structure a selection allows."""
    inside = F.col("s").isin(*chosen) if chosen else F.lit(False)
    return table.where(inside if include else ~inside)


def of_sizes(table: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of trees with so many vertices."""
    return table.where((F.bit_count("s") + 1).between(first, last))


def fused(low: DataFrame, high: DataFrame) -> DataFrame:
    """Two tables added row by row."""
    return low.unionByName(high).groupBy("v", "s", "c").agg(F.sum("n").cast(low.schema["n"].dataType).alias("n"))


def merged_shards(*shards: DataFrame) -> DataFrame:
    """Tables of different vertices together; an error if a vertex is in two."""
    all_rows = shards[0].withColumn("_shard", F.lit(0))
    for k, shard in enumerate(shards[1:], 1):
        all_rows = all_rows.unionByName(shard.withColumn("_shard", F.lit(k)))
    twice = all_rows.groupBy("v").agg(F.count_distinct("_shard").alias("k")).where("k > 1")
    if not twice.isEmpty():
        raise ValueError("a vertex is in more than one shard")
    return all_rows.drop("_shard")


def representative_totals(table: DataFrame, k: int) -> DataFrame:
    """Counts of structures of k vertices by their tree seen from the centre."""
    dim = treelets.dimension(table.sparkSession, max(k, 2)).where(F.col("k") == k).select("s", "repr")
    return table.groupBy("s").agg(F.sum("n").alias("n")).join(F.broadcast(dim), "s").groupBy("repr").agg(F.sum("n").alias("n"))
