"""Color coding: counts of colorful rooted trees at every vertex, size by size.

A table of size k has rows (v, s, c, n): at v are n trees of structure s with the color set c. The sum over
a vertex's neighbours, N_j(u, s, c), is made once for each size; a step then is an equi-join at a vertex.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import treelets
from hyperloom.plans.storage import settled

MULTIPLIER, MODULUS, SEED_STEP = 2654435761, 4294967296, 40503
COUNT = "bigint"
WIDE = "decimal(38,0)"


def color_hash(v: Column, seed: int = 0) -> Column:
    """A number under 2^32 from a vertex, by its remainder of 2^31, and a seed, by whole-number arithmetic."""
    return F.pmod(F.pmod(v, F.lit(1 << 31)) * F.lit(MULTIPLIER) + F.lit(seed * SEED_STEP), F.lit(MODULUS))


def colored(vertices: DataFrame, colors: int, seed: int = 0, shares: list[float] | None = None) -> DataFrame:
    """`v` and `color`: equally likely ones, or by shares, cut at thresholds of the hash."""
    h = color_hash(F.col("v"), seed)
    if shares is None:
        return vertices.select("v", (F.shiftright(h, 16) % colors).cast("int").alias("color"))
    cuts = [round(sum(shares[: i + 1]) * MODULUS) for i in range(colors - 1)]
    chosen = reduce(lambda out, i: F.when(h < cuts[i], i).otherwise(out), reversed(range(colors - 1)), F.lit(colors - 1))
    return vertices.select("v", chosen.cast("int").alias("color"))


def singles(colors: DataFrame, kind: str = COUNT) -> DataFrame:
    """The table of size 1."""
    return colors.select("v", F.lit(0).cast("long").alias("s"), F.expr("shiftleft(1, color)").alias("c"), F.lit(1).cast(kind).alias("n"))


def neighbour_sums(adj: DataFrame, table: DataFrame) -> DataFrame:
    """`v`, `s`, `c` and the sum of the table over the vertex's neighbours."""
    near = adj.select(F.col("u").alias("at"), "v").join(table, "v")
    return near.groupBy(F.col("at").alias("v"), "s", "c").agg(F.sum("n").alias("n"))


def combined(tables: dict[int, DataFrame], sums: dict[int, DataFrame], k: int, chosen: tuple[set[int], bool] | None = None) -> DataFrame:
    """Trees of k vertices from their first child, among the neighbours, and the rest; not yet normalised.

    `chosen` is a selection (structures, whether they are included): others aren't made.
    """
    some = next(iter(tables.values()))
    rows = [r for r in treelets.rows(k) if r[0] == k and (chosen is None or (r[1] in chosen[0]) == chosen[1])]
    kind = some.schema["n"].dataType
    made = []
    for j in sorted({r[5] for r in rows}):
        dim = some.sparkSession.createDataFrame([r for r in rows if r[5] == j], treelets.DIM).select("s", "comp_s", "split_s")
        x = tables[k - j].select("v", F.col("s").alias("comp_s"), F.col("c").alias("c1"), F.col("n").alias("n1"))
        y = sums[j].select("v", F.col("s").alias("split_s"), F.col("c").alias("c2"), F.col("n").alias("n2"))
        both = x.join(F.broadcast(dim), "comp_s").join(y, ["v", "split_s"]).where("(c1 & c2) = 0")
        made.append(both.select("v", "s", F.expr("c1 | c2").alias("c"), (F.col("n1") * F.col("n2")).cast(kind).alias("n")))
    if not made:
        return some.limit(0)
    return reduce(DataFrame.unionByName, made).groupBy("v", "s", "c").agg(F.sum("n").cast(kind).alias("n"))


def normalised(table: DataFrame, k: int) -> DataFrame:
    """Counts divided by the number of equal first children of their structure."""
    norms = {r[1]: r[6] for r in treelets.rows(k) if r[6] > 1}
    if not norms:
        return table
    by = reduce(lambda out, item: F.when(F.col("s") == item[0], item[1]).otherwise(out), norms.items(), F.lit(1))
    return table.select("v", "s", "c", F.expr("n").alias("n"), by.cast("int").alias("norm")).select("v", "s", "c", F.expr("n div norm").cast(table.schema["n"].dataType).alias("n"))


def only_at_first_color(table: DataFrame, first: DataFrame) -> DataFrame:
    """The rows at vertices of color 0."""
    return table.join(first.where("c = 1").select("v"), "v", "left_semi")


def count_tables(adj: DataFrame, colors: DataFrame, k: int, at_first_color: bool = False, chosen: tuple[set[int], bool] | None = None, wide: bool = False, keep: bool = True) -> dict[int, DataFrame]:
    """The tables of sizes 1 to k. Counts are 64-bit and an overflow is an error; `wide` takes 38 digits.

    With `at_first_color` the last size is made at vertices of color 0 alone. `keep` cuts the lineage of each size.
    """
    hold = settled if keep else (lambda df: df)
    out, sums = {1: hold(singles(colors, WIDE if wide else COUNT))}, {}
    for size in range(2, k + 1):
        sums[size - 1] = hold(neighbour_sums(adj, out[size - 1])) if size < k else neighbour_sums(adj, out[size - 1])
        tables = {i: only_at_first_color(t, out[1]) for i, t in out.items()} if at_first_color and size == k else out
        made = normalised(combined(tables, sums, size, chosen), size)
        out[size] = hold(made) if size < k else made
    return out


def looked_up(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The counts at given (v, s, c), 0 where the table has none; one row for each key, also for repeated ones."""
    kind = table.schema["n"].dataType
    return keys.select("v", "s", "c").join(table, ["v", "s", "c"], "left").select("v", "s", "c", F.coalesce("n", F.lit(0).cast(kind)).alias("n"))


def sums_at(table: DataFrame, vertices: DataFrame) -> DataFrame:
    """The sum of all counts at each of the given vertices, 0 where the table has none."""
    kind = table.schema["n"].dataType
    sums = table.groupBy("v").agg(F.sum("n").cast(kind).alias("n"))
    return vertices.select("v").distinct().join(sums, "v", "left").select("v", F.coalesce("n", F.lit(0).cast(kind)).alias("n"))
