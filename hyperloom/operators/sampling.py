"""Drawing trees and occurrences in proportion to their counts, so that SQL can draw the same.

Draw i takes a number from a whole-number mix of i and the seed, modulo the total, and the choice of children one of
the sample, the place and the seed: cubes modulo primes, which permute the remainders, so all of any total can be
hit. `mixed` draws and choices use a 126-bit hash instead, which SQL has not.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import treelets
from hyperloom.plans.storage import running, settled

A, B = 2654435761, 12345
#: Primes that leave 2 by 3, so that cubing permutes the remainders; products of two remainders fit 64 bits.
PRIMES = (2147483579, 2147483549, 2147483543, 2147483489)
STEP_SAMPLE, STEP_SLOT, STEP_SEED = 40503, 9973, 7919
BUCKETS, CIRCLE = 1024, 4294967296


def _hashed(*parts: Column | str) -> Column:
    """A number under 2 ** 126 from a hash of these, wide enough for all totals of up to 38 digits."""
    high, low = (F.pmod(F.xxhash64(*parts, F.lit(i)).cast("decimal(38,0)"), F.lit(str(1 << bits)).cast("decimal(38,0)")).cast("decimal(20,0)") for i, bits in ((1, 62), (2, 64)))
    return (high * F.lit(str(1 << 64)).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _cubed(x: Column, prime: int) -> Column:
    """Twice a step and the cube, modulo a prime."""
    for step in (1, 7):
        r = F.pmod(x + step, F.lit(prime))
        x = F.pmod(F.pmod(r * r, F.lit(prime)) * r, F.lit(prime))
    return x


def _spread(x: Column, first: int = 0) -> Column:
    """A number under 2 ** 62 from a whole number, by two of the primes."""
    return _cubed(x, PRIMES[first]) * F.lit(1 << 31) + _cubed(x, PRIMES[first + 1])


def draws(spark: SparkSession, n: int, total: int, b: int = B, mixed: bool = False) -> DataFrame:
    """`sample` from 0 to n-1 and its number `r` under the total."""
    ids = spark.range(n).withColumnRenamed("id", "sample")
    x = F.col("sample") * STEP_SAMPLE + F.lit(b)
    plain = _spread(x).cast("decimal(20,0)") * F.lit(str(1 << 62)).cast("decimal(20,0)") + _spread(x, 2).cast("decimal(20,0)")
    number = _hashed("sample", F.lit(b)) if mixed else plain.cast("decimal(38,0)")
    return ids.withColumn("r", F.pmod(number, F.lit(str(total)).cast("decimal(38,0)")).cast("decimal(38,0)"))


def located(drawn: DataFrame, distribution: DataFrame, total: int, n: int = 0) -> DataFrame:
    """Each draw with the row whose [lo, hi) has its number: an equi-join on buckets of the number, then the interval.

    With as many buckets as draws, `n`, the rows made and the pairs compared are about the rows and the draws together.
    """
    if not total:
        return drawn.crossJoin(distribution.limit(0))
    width = max(1, total // max(BUCKETS, n))
    rows = distribution.withColumn("bucket", F.explode(F.expr(f"sequence(cast(lo div {width} as bigint), cast((hi - 1) div {width} as bigint))")))
    return drawn.withColumn("bucket", F.expr(f"cast(r div {width} as bigint)")).join(rows, "bucket").where("r >= lo and r < hi").drop("bucket")


def sampled_treelets(spark: SparkSession, distribution: DataFrame, n: int, total: int, b: int = B, mixed: bool = False) -> DataFrame:
    """`sample`, root `v`, structure `s`, colors `c` and its count `n`."""
    return located(draws(spark, n, total, b, mixed), distribution, total, n).select("sample", "v", "s", "c", "n")


def _target(weight: Column, seed: int, mixed: bool = False) -> Column:
    if mixed:
        return F.pmod(_hashed("sample", "q", F.lit(seed)), weight.cast("decimal(38,0)"))
    return F.pmod(_spread(F.col("sample") * STEP_SAMPLE + F.col("q") * STEP_SLOT + F.lit(seed * STEP_SEED)), weight)


def _picked(tasks: DataFrame, options: DataFrame, seed: int, mixed: bool) -> DataFrame:
    """Each task with the candidate, in the order of `w` and `c2`, that its number falls on.

    Candidates of a tree at a vertex get running weights over ranges and as many buckets as it has tasks. Buckets come
    from one rising function of the place, for tasks and candidates alike, so the join finds the right one.
    """
    key = ["v", "s", "c"]
    options = settled(options)
    facts = options.groupBy(*key).agg(F.sum("weight").alias("total")).join(tasks.groupBy(*key).agg(F.count("*").alias("tasks")), key)
    facts = settled(facts)

    def bucket(place: Column) -> Column:
        return F.floor(place.cast("double") / F.col("total").cast("double") * F.col("tasks")).cast("long")

    ranged = running(options, [F.col("w"), F.col("c2")], F.col("weight"), "hi", key).withColumn("lo", F.col("hi") - F.col("weight"))
    rows = ranged.join(facts, key).withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1)))).drop("total", "tasks")
    asked = tasks.join(facts, key).withColumn("at", _target(F.col("total"), seed, mixed))
    asked = asked.withColumn("bucket", bucket(F.col("at"))).drop("total", "tasks")
    return asked.join(rows, [*key, "bucket"]).where("at >= lo and at < hi")


def occurrences(sampled: DataFrame, adj: DataFrame | Callable[[DataFrame], DataFrame], tables: dict[int, DataFrame], k: int, seed: int = 0, mixed: bool = False) -> DataFrame:
    """`sample`, `pos`, `v`: for each sampled tree one of its places in the graph, in proportion to their number.

    A tree at u splits into its first child, at a neighbour, and the rest, at u. Candidates are found once for
    each distinct tree at a vertex, and each sample picks the one that its number falls on. A child stands
    behind its root and before the rest; at most k - 1 rounds. `adj` may be a function from vertices (`v`) to their
    rows of the adjacency, which then is never made as a whole.
    """
    spark = sampled.sparkSession
    dim = F.broadcast(treelets.dimension(spark, k).drop("k", "repr"))
    placed = sampled.select("sample", F.lit(0).alias("pos"), "v")
    tasks = settled(sampled.select("sample", "v", "s", "c", F.lit(1).alias("q")))
    for _ in range(k - 1):
        tasks = tasks.where("s <> 0")
        wanted = tasks.select("v", "s", "c").distinct().join(dim, "s")
        near = settled(adj(tasks.select("v").distinct())) if callable(adj) else adj
        options = None
        for j in range(1, k):
            part = wanted.where(F.col("split_k") == j)
            for rest in range(1, k - j + 1):
                x = tables[rest].select("v", F.col("s").alias("comp_s"), F.col("c").alias("c1"), F.col("n").alias("n1"))
                y = tables[j].select(F.col("v").alias("w"), F.col("s").alias("split_s"), F.col("c").alias("c2"), F.col("n").alias("n2"))
                left = part.where(F.col("comp_k") == rest).join(x, ["v", "comp_s"]).where("(c1 & c) = c1").withColumn("c2", F.expr("c ^ c1"))
                made = left.join(near.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").join(y, ["w", "split_s", "c2"])
                made = made.select("v", "s", "c", "w", "c1", "c2", "comp_s", "split_s", "split_k", (F.col("n1") * F.col("n2")).alias("weight"))
                options = made if options is None else options.unionByName(made)
        picked = _picked(tasks, options, seed, mixed)
        picked = settled(picked.select("sample", "v", "w", "q", "c1", "c2", "comp_s", "split_s", "split_k"))
        placed = placed.unionByName(picked.select("sample", F.col("q").alias("pos"), F.col("w").alias("v")))
        child = picked.select("sample", F.col("w").alias("v"), F.col("split_s").alias("s"), F.col("c2").alias("c"), (F.col("q") + 1).alias("q"))
        rest_of = picked.select("sample", "v", F.col("comp_s").alias("s"), F.col("c1").alias("c"), (F.col("q") + F.col("split_k")).alias("q"))
        tasks = child.unionByName(rest_of)
    return placed


def star_weights(adj: DataFrame, k: int) -> DataFrame:
    """`v`, its degree, and the stars of k vertices around it: degree over k - 1."""
    degree = adj.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("degree"))
    ways = " * ".join(f"cast(degree - {i} as decimal(38,0))" for i in range(k - 1)) or "cast(1 as decimal(38,0))"
    stars = F.expr(f"cast(({ways}) div {factorial(k - 1)} as decimal(38,0))")
    return degree.where(F.col("degree") >= k - 1).select("v", "degree", stars.alias("stars"))


def sampled_stars(spark: SparkSession, adj: DataFrame, roots: DataFrame, n: int, k: int, total: int, b: int = B) -> DataFrame:
    """`sample`, `pos`, `v`: centres in proportion to their stars (`roots` has `v`, `lo`, `hi`), and k - 1 neighbours.

    The neighbours are the first ones of an order that a hash gives for each sample: the circle of their hashes from a
    start of its own. So the neighbours of drawn centres are numbered once, and samples look up k - 1 numbers.
    """
    centres = settled(located(draws(spark, n, total, b), roots, total, n).select("sample", "v"))
    placed = centres.select("sample", F.lit(0).alias("pos"), "v")
    if k < 2:
        return placed
    near = centres.select("v").distinct().join(adj.select(F.col("u").alias("v"), F.col("v").alias("w")), "v")
    at = F.pmod(F.pmod(F.col("w"), F.lit(1 << 31)) * A, F.lit(CIRCLE))
    start = F.pmod(F.lit(CIRCLE) - F.pmod(F.col("sample") * STEP_SAMPLE, F.lit(CIRCLE)), F.lit(CIRCLE))
    none = F.lit(None).cast("long")
    stops = near.select("v", at.alias("at"), F.lit(1).cast("long").alias("leaf"), "w", none.alias("sample"))
    stops = stops.unionByName(centres.select("v", start.alias("at"), F.lit(0).cast("long").alias("leaf"), none.alias("w"), "sample"))
    stops = settled(running(stops, [F.col(c) for c in ("at", "leaf", "w", "sample")], F.col("leaf"), "until", ["v"]))
    numbers = stops.where("leaf = 1").select("v", (F.col("until") - 1).alias("number"), "w")
    degrees = numbers.groupBy("v").agg(F.count("*").alias("degree"))
    asked = stops.where("leaf = 0").join(degrees, "v").withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))).where("pos <= degree")
    asked = asked.select("v", "sample", "pos", F.pmod(F.col("until") + F.col("pos") - 1, F.col("degree")).alias("number"))
    return placed.unionByName(asked.join(numbers, ["v", "number"]).select("sample", "pos", F.col("w").alias("v")))


def star_share(samples: int, stars: float, trees_over_p: float, k: int) -> int:
    """How many of the samples go to the star sampler."""
    whole = trees_over_p + stars * k
    return round(samples * stars * k / whole) if whole else 0
