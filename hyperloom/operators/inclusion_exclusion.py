"""Neighbour sums over large hyperedges without their pairs, by inclusion and exclusion over sets of hyperedges.

Level r has the sets of r hyperedges with two common vertices or more; to each common vertex x a set adds, by
turns, its total less x's own count, or takes it away. Sets grow by hyperedges with greater ids only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.operators.counting import neighbour_sums
from hyperloom.operators.incidence import gaifman
from hyperloom.plans.storage import settled

#: Members of all sets of one level; beyond that the plan goes by pairs instead, with the same result.
MOST_MEMBERS = 50_000_000
#: Rows of the join that makes a level, for each of these members.
JOINED = 20


def first_level(inc: DataFrame) -> DataFrame:
    """`es` and members `v` of the hyperedges with two vertices or more."""
    real = inc.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e")
    return inc.join(real, "e", "left_semi").select(F.array("e").alias("es"), "v")


def next_level(level: DataFrame, inc: DataFrame) -> DataFrame:
    """The sets with one more hyperedge, of a greater id, that still have two common vertices."""
    grown = level.join(inc, "v").where(F.col("e") > F.element_at("es", -1)).select(F.concat("es", F.array("e")).alias("es"), "v")
    real = grown.groupBy("es").agg(F.count("*").alias("n")).where("n > 1").select("es")
    return grown.join(real, "es", "left_semi")


def levels(inc: DataFrame, most: int = MOST_MEMBERS) -> list[DataFrame] | None:
    """All levels until one is empty; None if one has more members than `most`, or if the join that makes the next
    one has more rows than that, which is counted before from the hyperedges at each vertex."""
    out, level = [], settled(first_level(inc))
    degrees = inc.groupBy("v").agg(F.count("*").alias("degree"))
    while n := level.count():
        made = level.groupBy("v").agg(F.count("*").alias("sets")).join(degrees, "v")
        # a set that ends in a vertex's i-th hyperedge of d grows d - i times; of level 1 that is d(d - 1)/2 for each vertex
        grown = F.expr("degree * (degree - 1) div 2" if not out else "sets * degree")
        if n > most or made.agg(F.sum(grown.cast("decimal(38,0)"))).first()[0] > most * JOINED:
            return None
        out.append(level)
        level = settled(next_level(level, inc))
    return out


def contributions(level: DataFrame, table: DataFrame, sign: int) -> DataFrame:
    """What the sets of one level add to their members, for all trees of the table."""
    counted = level.join(table, "v")
    totals = counted.groupBy("es", "s", "c").agg(F.sum("n").alias("total"))
    own = table.withColumnRenamed("n", "own")
    return level.join(totals, "es").join(own, ["v", "s", "c"], "left").select("v", "s", "c", (F.lit(sign) * (F.col("total") - F.coalesce("own", F.lit(0)))).alias("n"))


def neighbour_sums_by_sets(inc: DataFrame, table: DataFrame, most: int = MOST_MEMBERS, prepared: list[DataFrame] | None = None) -> DataFrame:
    """The sum of a table over distinct co-members, without their pairs; zeros are left out."""
    found = prepared if prepared is not None else levels(inc, most)
    if found is None:
        return neighbour_sums(gaifman(inc), table)
    if not found:
        return table.limit(0)
    parts = [contributions(level, table, 1 if r % 2 == 0 else -1) for r, level in enumerate(found)]
    kind = table.schema["n"].dataType
    return reduce(DataFrame.unionByName, parts).groupBy("v", "s", "c").agg(F.sum("n").cast(kind).alias("n")).where("n <> 0")
