"""Sample tables: grouping, estimates of occurrences and frequencies, and putting tables together.

A sample table has `footprint`, `samples`, `spanning_trees`, `est_occurrences`, `est_frequency`, `sampling_algo`,
`vertices`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(samples: DataFrame, footprint: str = "footprint", vertices: str = "vertices") -> DataFrame:
    """One row for each footprint: how many samples have it (the sum of `samples` if there is one), and the least vertices."""
    times = F.sum("samples") if "samples" in samples.columns else F.count("*")
    return samples.groupBy(F.col(footprint).alias("footprint")).agg(times.alias("samples"), F.min(vertices).alias("vertices"))


def estimated(df: DataFrame, n_samples: int, total: float) -> DataFrame:
    """`est_occurrences`: the share of samples times the total (trees over the colorful probability), by spanning trees; 0 without any."""
    good = (F.lit(total) > 0) & (F.col("spanning_trees") > 0)
    return df.withColumn("est_occurrences", F.when(good, F.col("samples") / F.lit(float(n_samples)) * (F.lit(float(total)) / F.col("spanning_trees"))).otherwise(0.0))


def frequencies(df: DataFrame) -> DataFrame:
    """`est_frequency`: each estimate by their sum; 0 if that is not over 0. The sum is one row, joined to all."""
    whole = df.agg(F.sum("est_occurrences").alias("_whole"))
    return df.crossJoin(F.broadcast(whole)).withColumn("est_frequency", F.when(F.col("_whole") > 0, F.col("est_occurrences") / F.col("_whole")).otherwise(0.0)).drop("_whole")


def rescaled(df: DataFrame, factor: float) -> DataFrame:
    """Estimates times a factor."""
    return df if factor == 1 else df.withColumn("est_occurrences", F.col("est_occurrences") * factor)


def norm2(df: DataFrame, n_samples: int) -> DataFrame:
    """The root of the sum of squared counts, by the number of samples."""
    return df.agg((F.sqrt(F.coalesce(F.sum(F.col("samples").cast("double") * F.col("samples")), F.lit(0.0))) / n_samples).alias("norm2"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("footprint", *(F.col(c).alias(f"{c}_a") for c in ("samples", "spanning_trees", "est_occurrences", "vertices")))
    right = b.select("footprint", *(F.col(c).alias(f"{c}_b") for c in ("samples", "spanning_trees", "est_occurrences", "vertices")))
    return left.join(right, "footprint", "full_outer")


def _or(name: str, otherwise: Column | None = None) -> Column:
    return F.coalesce(f"{name}_a", f"{name}_b", *([otherwise] if otherwise is not None else []))


def merged(a: DataFrame, b: DataFrame, n_a: int, total_a: float, trees_b: Column, n_b: int, total_b: float) -> DataFrame:
    """Two tables as one sample: counts added, by the samples that each row's trees would get from either sampler.

    `trees_b` is the column of a row's trees for the second sampler; the first one's are its spanning trees.
    """
    both = _both(a, b).withColumn("samples", F.coalesce("samples_a", F.lit(0)) + F.coalesce("samples_b", F.lit(0))).withColumn("spanning_trees", _or("spanning_trees"))
    weight = F.lit(float(n_a)) * F.col("spanning_trees") / F.lit(float(total_a)) + F.lit(float(n_b)) * trees_b / F.lit(float(total_b))
    estimate = F.when(weight > 0, F.col("samples") / weight).otherwise(0.0)
    return both.select("footprint", "samples", "spanning_trees", estimate.alias("est_occurrences"), F.lit("M").alias("sampling_algo"), _or("vertices").alias("vertices"))


def weighted_average(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float) -> DataFrame:
    """Estimates of both tables weighed; a row of one table alone keeps its estimate."""
    both = _both(a, b)
    mean = F.col("est_occurrences_a") * weight_a + F.col("est_occurrences_b") * weight_b
    estimate = F.coalesce(mean, "est_occurrences_a", "est_occurrences_b")
    return both.select("footprint", (F.coalesce("samples_a", F.lit(0)) + F.coalesce("samples_b", F.lit(0))).alias("samples"), _or("spanning_trees").alias("spanning_trees"), estimate.alias("est_occurrences"), F.lit("W").alias("sampling_algo"), _or("vertices").alias("vertices"))


def output(df: DataFrame, motif: str = "hyper_motif") -> DataFrame:
    """The seven columns of a result file, greatest estimate first; estimates with four decimals in scientific form."""
    return df.orderBy(F.desc("est_occurrences"), "footprint").select(
        F.col("footprint").alias(motif),
        F.format_string("%.4e", "est_occurrences").alias("est_occurrences"),
        F.format_string("%.4e", "est_frequency").alias("est_frequency"),
        "samples",
        "sampling_algo",
        "spanning_trees",
        F.col("vertices").cast("string").alias("vertices"),
    )
