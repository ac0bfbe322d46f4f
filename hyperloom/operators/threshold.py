"""The size threshold between small and large hyperedges, by a cost model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.operators.incidence import edge_sizes
from hyperloom.plans.storage import numbered

SATURATED = "18446744073709551615"


def ranks(inc: DataFrame) -> DataFrame:
    """`v`, `e`, `size` and the place `p`, from 0, of the hyperedge among its vertex's, larger sizes and ids first."""
    sized = inc.join(edge_sizes(inc), "e").select("v", "e", "size")
    return numbered(sized, [F.desc("size"), F.desc("e")], "p", ["v"])


def _powers(until: Column) -> Column:
    """What the places before this one cost: nothing for the first two, then powers of two, a saturated number from 64 on."""
    bits = F.greatest(F.least(until, F.lit(64)), F.lit(2)).cast("int")
    one, first = F.lit(1).cast("long"), F.least(bits, F.lit(32))
    small = F.call_function("shiftleft", one, first).cast("decimal(12,0)") * F.call_function("shiftleft", one, bits - first).cast("decimal(12,0)") - F.lit(4).cast("decimal(2,0)")
    return small + F.greatest(until - 64, F.lit(0)).cast("decimal(17,0)") * F.expr(f"cast({SATURATED} as decimal(20,0))")


def costs(inc: DataFrame) -> DataFrame:
    """For each size t: `beta`, the most hyperedges of size t or more at a vertex; `ie`, what inclusion-exclusion
    costs on them; `naive`, a hundredth of what expanding sizes up to t costs; and their sum `total`.

    Sizes are few, so the running sums over them are small, at a vertex too; incidences are counted by vertex and
    size first. A place of 2^64 or more saturates.
    """
    counted = inc.join(edge_sizes(inc), "e").groupBy("v", F.col("size").alias("t")).agg(F.count("*").alias("m"))
    until = F.sum("m").over(Window.partitionBy("v").orderBy(F.desc("t")))
    by_size = counted.withColumn("until", until).groupBy("t").agg(F.max("until").alias("deepest"), F.sum(_powers(F.col("until")) - _powers(F.col("until") - F.col("m"))).alias("ie_of"))
    number = edge_sizes(inc).groupBy(F.col("size").alias("t")).agg(F.count("*").alias("m"))
    down = Window.orderBy(F.desc("t"))
    up = Window.orderBy("t")
    capped = F.least(F.sum("ie_of").over(down), F.expr(f"cast({SATURATED} as decimal(38,0))"))
    whole = F.sum(F.col("t") * F.col("t") * F.col("m")).over(up)
    out = by_size.join(number, "t").select("t", F.max("deepest").over(down).alias("beta"), capped.cast("decimal(38,0)").alias("ie"), F.floor(whole / 100).cast("long").alias("naive"))
    return out.withColumn("total", (F.col("ie") + F.col("naive")).cast("decimal(38,0)"))


def best(inc: DataFrame) -> DataFrame:
    """The size with the least cost, the smallest of equals; 0 without hyperedges."""
    return costs(inc).agg(F.coalesce(F.min(F.struct("total", "t"))["t"], F.lit(0)).alias("threshold"))
