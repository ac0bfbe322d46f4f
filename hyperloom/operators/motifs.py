"""What sampled vertices induce: traces of hyperedges, their graph, and classes up to isomorphism."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.functions import graphlets, treelets
from hyperloom.operators import triangles
from hyperloom.plans.storage import settled


def traces(placed: DataFrame, inc: DataFrame, k: int) -> DataFrame:
    """`sample` and `traces`: the distinct masks of two or more sampled vertices that a hyperedge has, greatest first.

    Position 0 is the highest of k bits. Samples without a trace have an empty list.
    """
    bit = F.expr(f"shiftleft(1, {k - 1} - pos)")
    masks = placed.withColumn("bit", bit).join(inc, "v").groupBy("sample", "e").agg(F.expr("bit_or(bit)").alias("mask")).where("bit_count(mask) >= 2")
    found = masks.select("sample", "mask").distinct().groupBy("sample").agg(F.sort_array(F.collect_list("mask"), asc=False).alias("traces"))
    everyone = placed.select("sample").distinct()
    return everyone.join(found, "sample", "left").select("sample", F.coalesce("traces", F.array().cast("array<int>")).alias("traces"))


def _has(bits: int):
    """Whether a mask has all these bits."""
    return lambda m: m.bitwiseAND(F.lit(bits)) == bits


def gaifman_bits(masks: Column, k: int) -> Column:
    """The number of the graph in which vertices of one trace are neighbours."""
    total, out = graphlets.pair_count(k), F.lit(0).cast("long")
    for i in range(1, k):
        for j in range(i):
            both = 1 << (k - 1 - i) | 1 << (k - 1 - j)
            place = 1 << (total - 1 - (i * (i - 1) // 2 + j))
            out = out + F.when(F.exists(masks, _has(both)), place).otherwise(0)
    return out


def induced_bits(placed: DataFrame, adj: DataFrame, k: int) -> DataFrame:
    """`sample` and `bits`: the number of the graph that the sampled vertices induce."""
    total = graphlets.pair_count(k)
    a, b = placed.select("sample", F.col("pos").alias("i"), F.col("v").alias("u")), placed.select("sample", F.col("pos").alias("j"), "v")
    real = a.join(b, "sample").where("i > j").join(adj, ["u", "v"], "left_semi")
    bits = real.groupBy("sample").agg(F.expr(f"bit_or(shiftleft(1L, {total - 1} - (i * (i - 1) div 2 + j)))").alias("bits"))
    return placed.select("sample").distinct().join(bits, "sample", "left").select("sample", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))


def tree_bits(sampled: DataFrame, k: int) -> DataFrame:
    """`sample` and `bits`: the number of the graph that has the edges of the sampled tree alone, at its positions."""
    rows = [(s, graphlets.code_of(treelets.edges(s), k)) for s in treelets.trees(k)]
    codes = sampled.sparkSession.createDataFrame(rows, "s long, bits long")
    return sampled.join(F.broadcast(codes), "s").select("sample", "bits")


def class_of_three(masks: Column) -> Column:
    """The class of three connected vertices: whether one trace has all, and how many have two."""
    whole = F.array_contains(masks, F.lit(7))
    pairs = F.size(F.filter(masks, lambda m: m != 7))
    return F.concat(F.when(whole, "T").otherwise("-"), pairs.cast("string"))


def text_footprint(bits: Column, k: int) -> Column:
    """The number of a graph as letters from A, four bits each."""
    total = graphlets.pair_count(k)
    chars = -(-total // 4)
    shifted = F.shiftleft(bits.cast("long"), 4 * chars - total)
    return F.translate(F.lpad(F.hex(shifted), chars, "0"), "0123456789ABCDEF", "ABCDEFGHIJKLMNOP")


def canonical_graphs(df: DataFrame, bits: str, k: int, name: str = "footprint") -> DataFrame:
    """`df` with the canonical number of its graphs; each distinct one is worked out once in a process."""

    @F.pandas_udf(T.LongType())
    def canonical(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: graphlets.canonical_graph(int(c), k))

    return df.withColumn(name, canonical(bits))


def canonical_traces(df: DataFrame, masks: str, k: int, name: str = "footprint") -> DataFrame:
    """`df` with the canonical form of its traces, masks joined by commas."""

    @F.pandas_udf(T.StringType())
    def canonical(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: ",".join(map(str, graphlets.canonical_traces(tuple(sorted(map(int, x))), k))))

    return df.withColumn(name, canonical(masks))


def spanning_trees(df: DataFrame, bits: str, k: int, name: str = "spanning_trees", chosen: set[int] | None = None, include: bool = True) -> DataFrame:
    """`df` with the rooted spanning trees of its graphs, or of those that a selection of structures allows."""

    @F.pandas_udf(T.LongType())
    def count(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: graphlets.spanning_trees_selected(int(c), k, chosen, include))

    return df.withColumn(name, count(bits))


def spanning_trees_of_three(bits: Column) -> Column:
    """Rooted spanning trees of graphs of three vertices, in closed form."""
    n = F.bit_count(bits)
    return F.when(n == 3, 9).when(n == 2, 3).otherwise(0).cast("long")


def spanning_stars(bits: Column, k: int) -> Column:
    """k times the vertices that are next to all others."""
    total, out = graphlets.pair_count(k), F.lit(0)
    for v in range(k):
        mask = sum(1 << (total - 1 - (max(v, w) * (max(v, w) - 1) // 2 + min(v, w))) for w in range(k) if w != v)
        out = out + F.when(bits.bitwiseAND(F.lit(mask).cast("long")) == mask, k).otherwise(0)
    return out.cast("long")


def homomorphisms(df: DataFrame, structure: int, bits: str, k: int, name: str = "homomorphisms") -> DataFrame:
    """`df` with the numberings under which all edges of a tree are edges of its graphs."""

    @F.pandas_udf(T.LongType())
    def count(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: graphlets.homomorphisms(structure, int(c), k))

    return df.withColumn(name, count(bits))


def _repeated_threes(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Sets of three within a hyperedge of which two vertices share another one: by `pairs`, as in `census_of_three`, `n` and how often hyperedges have them, `times`."""
    many = near.select("u", F.inline("many"))
    ends = many.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    some = edges.select("e", F.explode("vs").alias("v")).join(ends.hint("merge"), "v", "left_semi")
    listed = some.groupBy("e").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    held = triangles.edge_pairs(listed).join(many.hint("merge"), ["u", "v"])
    thirds = held.join(edges.hint("merge"), "e").select("e", "u", "v", "shared", F.explode("vs").alias("w")).where("w <> u and w <> v")
    before, after = F.col("w") < F.col("u"), F.col("w") > F.col("v")
    keys = [F.least("u", "w").alias("x"), F.when(before, F.col("u")).when(after, F.col("v")).otherwise(F.col("w")).alias("y"), F.greatest("v", "w").alias("z")]
    sides = {"xy": after, "xz": ~before & ~after, "yz": before}
    once = thirds.groupBy(*keys, "e").agg(*(F.max(F.when(at, F.col("shared"))).alias(c) for c, at in sides.items()))
    threes = once.groupBy("x", "y", "z").agg(F.count("*").alias("xyz"), *(F.max(c).alias(c) for c in sides))
    pairs = sum((F.when(F.col(c) > F.col("xyz"), 1).otherwise(0) for c in sides), F.lit(0))
    return threes.groupBy(pairs.alias("pairs")).agg(F.count("*").alias("n"), F.sum("xyz").alias("times"))


def census_of_three(inc: DataFrame) -> DataFrame:
    """All connected sets of three vertices by class, exactly: `whole` (one trace has all), `pairs`, `n`.

    Open ones are counted from degrees, and triangles in cells (see `triangles`). A pair has a trace of its own if it
    shares more hyperedges than the three together do; so of sets within a hyperedge only those with a pair that shares
    two or more are listed, as all others are whole, without pairs and in one hyperedge only. Triangles that no
    hyperedge has whole have three pairs.
    """
    edges = settled(triangles.ranked_edges(inc))
    size = F.size("vs").cast("long").alias("size")
    sums = edges.select(size).agg(F.sum(F.expr("size * (size - 1) div 2")), F.sum(F.expr("size * (size - 1) * (size - 2) div 6")))
    bound, threes = (x or 0 for x in sums.first())
    near = settled(triangles.neighbours(edges))
    parts = {"open": triangles.wedges(near), "closed": triangles.triangles(near, bound), "whole": _repeated_threes(edges, near)}
    alike = [df.select(F.lit(part).alias("part"), *(F.col(c).cast("long") if c in df.columns else F.lit(0).cast("long").alias(c) for c in ("pairs", "n", "times"))) for part, df in parts.items()]
    found = {part: {} for part in parts}
    times = 0
    for part, pairs, n, often in reduce(DataFrame.unionByName, alike).collect():
        found[part][pairs] = n or 0
        times += often or 0
    closed, whole = found["closed"][0], found["whole"]
    whole[0] = whole.get(0, 0) + threes - times
    rows = [(True, pairs, n) for pairs, n in whole.items()] + [(False, 3, closed - sum(whole.values())), (False, 2, found["open"][0] - 3 * closed)]
    return inc.sparkSession.createDataFrame([r for r in rows if r[2]], "whole boolean, pairs int, n long")
