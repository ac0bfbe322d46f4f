"""Operators on the incidence relation (e, v) and on the adjacency (u, v) that it projects to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.plans.storage import numbered


def incidence(df: DataFrame, e: str, v: str) -> DataFrame:
    """Distinct (e, v) of any table; rows without either are left out."""
    return df.select(F.col(e).cast("long").alias("e"), F.col(v).cast("long").alias("v")).dropna().distinct()


def edge_sizes(inc: DataFrame) -> DataFrame:
    return inc.groupBy("e").agg(F.count("*").alias("size"))


def edges(inc: DataFrame) -> DataFrame:
    """Each hyperedge with its size and its vertices in order."""
    return inc.groupBy("e").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("v")).alias("verts"))


def vertex_degrees(inc: DataFrame) -> DataFrame:
    return inc.groupBy("v").agg(F.count("*").alias("degree"))


def vertex_count(inc: DataFrame) -> DataFrame:
    """The number of vertices when ids are dense: the greatest one plus 1, or 0."""
    return inc.agg(F.coalesce(F.max("v") + 1, F.lit(0)).alias("n"))


def member(inc: DataFrame, i: int) -> DataFrame:
    """The i-th vertex, from 0, of each hyperedge that has so many."""
    return edges(inc).where(F.col("size") > i).select("e", F.element_at("verts", i + 1).alias("v"))


def incident(inc: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted (e, v) that are incident."""
    return wanted.join(inc, ["e", "v"], "left_semi")


def adjacent(adj: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted (u, v) that are adjacent."""
    return wanted.join(adj, ["u", "v"], "left_semi")


def renumbered(inc: DataFrame) -> DataFrame:
    """Hyperedges numbered from 0 by size, greatest first, ties by their vertices: `e`, `number`."""
    return numbered(edges(inc), [F.desc("size"), F.col("verts"), F.col("e")], "number").select("e", "number")


def original_ids(df: DataFrame, vmap: DataFrame | None, column: str = "v") -> DataFrame:
    """Dense ids replaced by the original ones of (dense, orig); without a map, or for ids not in it, they stay."""
    if vmap is None:
        return df
    found = df.join(vmap.select(F.col("dense").alias(column), "orig"), column, "left")
    return found.withColumn(column, F.coalesce("orig", column)).drop("orig").select(*df.columns)


def _pairs(inc: DataFrame) -> DataFrame:
    return inc.join(inc.select("e", F.col("v").alias("w")), "e").where("v < w")


def shared_edges(inc: DataFrame) -> DataFrame:
    """Pairs u < v with the number of hyperedges that have both."""
    return _pairs(inc).groupBy(F.col("v").alias("u"), F.col("w").alias("v")).agg(F.count("*").alias("shared"))


def pair_set(inc: DataFrame, max_edge_size: int = 0) -> DataFrame:
    """Distinct pairs u < v of vertices that share a hyperedge, of those up to a size if one is given."""
    if max_edge_size:
        inc = inc.join(edge_sizes(inc).where(F.col("size") <= max_edge_size).select("e"), "e", "left_semi")
    return _pairs(inc).select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs as a symmetric adjacency."""
    return pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def gaifman(inc: DataFrame, max_edge_size: int = 0) -> DataFrame:
    """The symmetric adjacency of vertices that share a hyperedge. Pairs u < v are made distinct before they are mirrored."""
    return both_ways(pair_set(inc, max_edge_size))


def split(inc: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Incidences of hyperedges up to the threshold, and of larger ones."""
    sized = inc.join(edge_sizes(inc), "e")
    return tuple(sized.where(cond).select("e", "v") for cond in (F.col("size") <= threshold, F.col("size") > threshold))


def overlap_pairs(low: DataFrame, high: DataFrame) -> DataFrame:
    """Pairs u < v that share hyperedges of both sides."""
    return pair_set(low).intersect(pair_set(high))


def exclude_pairs(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """The adjacency without the given pairs, in both directions."""
    return adj.join(both_ways(pairs), ["u", "v"], "left_anti")


def neighbours_of(vertices: DataFrame, near: DataFrame, high: DataFrame) -> DataFrame:
    """The rows of the whole adjacency at the given vertices, from `near`, the adjacency of small hyperedges, and the
    large hyperedges' incidence: only the pairs of these vertices are made."""
    asked = vertices.select(F.col("v").alias("u")).distinct()
    small = near.join(asked, "u", "left_semi").select("u", "v")
    large = asked.join(high.select(F.col("v").alias("u"), "e"), "u").join(high, "e").where("u <> v").select("u", "v")
    return small.union(large).distinct()


def gaifman_bounds(inc: DataFrame, max_edge_size: int = 0) -> DataFrame:
    """An upper bound of the pairs, from sizes alone."""
    sizes = edge_sizes(inc).where("size >= 2")
    if max_edge_size:
        sizes = sizes.where(F.col("size") <= max_edge_size)
    return sizes.agg(F.coalesce(F.sum(F.expr("size * (size - 1) div 2")), F.lit(0)).alias("upper_bound"), F.count("*").alias("hyperedges"))


def dedup_classes(inc: DataFrame) -> DataFrame:
    """`v` and `class`: vertices in the same hyperedges are one class; classes are numbered by their least vertex."""
    same = inc.groupBy("v").agg(F.sort_array(F.collect_list("e")).alias("es"))
    first = same.groupBy("es").agg(F.min("v").alias("first"))
    order = numbered(first.select("first"), [F.col("first")], "class")
    return same.join(first, "es").join(order, "first").select("v", "class")


def dedup_edges(inc: DataFrame, classes: DataFrame) -> DataFrame:
    """The incidence with vertices replaced by their classes."""
    return inc.join(classes, "v").select("e", F.col("class").alias("v")).distinct()
