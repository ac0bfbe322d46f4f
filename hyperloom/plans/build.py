"""The build plans: tables of counts from one adjacency, or from small and large hyperedges apart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hyperloom.operators import counting, incidence, inclusion_exclusion
from hyperloom.operators.tables import fused
from hyperloom.plans.storage import settled


def vertices(inc: DataFrame) -> DataFrame:
    return inc.select("v").distinct()


def from_adjacency(inc: DataFrame, k: int, colors: int | None = None, **options) -> dict[int, DataFrame]:
    """Tables of sizes 1 to k over the whole adjacency."""
    return counting.count_tables(settled(incidence.gaifman(inc)), settled(counting.colored(vertices(inc), colors or k)), k, **options)


def from_split(inc: DataFrame, k: int, threshold: int, colors: int | None = None, wide: bool = False, most: int = inclusion_exclusion.MOST_MEMBERS) -> dict[int, DataFrame]:
    """The same tables: pairs for hyperedges up to the threshold, less the pairs that larger ones have too, and
    inclusion and exclusion for the larger ones. The sets of hyperedges are made once for all sizes."""
    low, high = (settled(x) for x in incidence.split(inc, threshold))
    near = settled(incidence.exclude_pairs(incidence.gaifman(low), incidence.overlap_pairs(low, high)))
    sets = inclusion_exclusion.levels(high, most)
    out = {1: settled(counting.singles(counting.colored(vertices(inc), colors or k), counting.WIDE if wide else counting.COUNT))}
    sums = {}
    for size in range(2, k + 1):
        table = out[size - 1]
        large = counting.neighbour_sums(incidence.gaifman(high), table) if sets is None else inclusion_exclusion.neighbour_sums_by_sets(high, table, prepared=sets)
        sums[size - 1] = settled(fused(counting.neighbour_sums(near, table), large))
        out[size] = settled(counting.normalised(counting.combined(out, sums, size), size))
    return out
