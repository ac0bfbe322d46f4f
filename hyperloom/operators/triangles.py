"""Neighbours by rank, and triangles counted in cells of vertex groups, so that no list of paths is shuffled."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.operators.incidence import edge_sizes
from hyperloom.plans.storage import numbered

#: Closing pairs that a task holds, about, and paths that one step of it makes.
HELD, STEP = 1 << 22, 1 << 18
#: Groups of vertices at least, for enough tasks.
LEAST_GROUPS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def ranked_edges(inc: DataFrame) -> DataFrame:
    """Hyperedges of two vertices or more as `e` and `vs`, their vertices' ranks in order.

    Vertices are ranked from 0 by the pairs that they are in, each hyperedge's counted, so that the greater neighbours
    of one are at most the root of all such pairs. Joins are by merging, as what grows must not be sent through the
    driver, which Spark does where a compressed file makes it look small.
    """
    sized = inc.join(edge_sizes(inc).where("size >= 2").hint("merge"), "e")
    ranks = numbered(sized.groupBy("v").agg(F.sum(F.col("size") - 1).alias("w")), [F.col("w"), F.col("v")], "r")
    small = F.when(F.col("r") < 1 << 31, F.col("r")).otherwise(F.raise_error(F.lit("more than 2^31 vertices")).cast("long")).cast("int")
    return inc.join(ranks.select("v", small.alias("r")).hint("merge"), "v").groupBy("e").agg(F.sort_array(F.collect_list("r")).alias("vs"))


def edge_pairs(edges: DataFrame) -> DataFrame:
    """`e` and the pairs u < v of each list in order."""
    first = edges.select("e", F.posexplode("vs").alias("i", "u"), "vs")
    return first.select("e", "u", F.explode(F.expr("slice(vs, i + 2, size(vs))")).alias("v"))


def neighbours(edges: DataFrame) -> DataFrame:
    """`u`, its greater neighbours `vs` in order, and `many`: those that share two hyperedges or more with it, and how many."""
    shared = edge_pairs(edges).groupBy("u", "v").agg(F.count("*").alias("shared"))
    many = F.when(F.col("shared") > 1, F.struct("v", "shared"))
    return shared.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.collect_list(many).alias("many"))


def wedges(near: DataFrame) -> DataFrame:
    """`n`: pairs of neighbours, over all vertices."""
    ends = near.select("u", F.size("vs").cast("long").alias("d")).union(near.select(F.explode("vs").alias("u"), F.lit(1).cast("long")))
    return ends.groupBy("u").agg(F.sum("d").alias("d")).agg(F.sum(F.expr("d * (d - 1) div 2")).alias("n"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each begins and the last ends."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), ends - ends[0]


class _Closing:
    """Pairs that close paths, looked up in a table of hashes first."""

    def __init__(self, codes: np.ndarray):
        codes.sort()
        bits = max(10, (8 * len(codes)).bit_length())
        self.codes, self.shift, self.table = codes, np.uint64(64 - bits), np.zeros(1 << bits, bool)
        for at in range(0, len(codes), STEP):
            self.table[self.places(codes[at : at + STEP])] = True

    def places(self, codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint64) * _ODD >> self.shift

    def count(self, codes: np.ndarray) -> int:
        likely = codes[self.table[self.places(codes)]]
        at = np.minimum(np.searchsorted(self.codes, likely), len(self.codes) - 1)
        return int((self.codes[at] == likely).sum())

    def paths(self, left: pa.ListArray, right: pa.ListArray, same: bool) -> int:
        """Closed ones of the pairs of a row's left and right vertices, or, with `same`, of its left ones."""
        first, begin = _lists(left)
        second, start = (first, begin) if same else _lists(right)
        row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        low = np.arange(1, len(first) + 1) if same else start[row]
        made = start[row + 1] - low
        total, found, at = np.concatenate([[0], np.cumsum(made)]), 0, 0
        while at < len(first):
            end = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
            many = made[at:end]
            place = np.repeat(low[at:end] - total[at:end], many) + np.arange(total[at], total[end])
            found += self.count(np.repeat(first[at:end] << 32, many) | second[place])
            at = end
        return found


def triangles(near: DataFrame, pairs: int) -> DataFrame:
    """`n`: sets of three vertices that are all neighbours; `pairs` is a bound of the pairs of neighbours.

    Vertices are dealt into groups by rank. The cell of two groups gets their closing pairs, and from each vertex the
    greater neighbours in both, as lists; so a pair goes to as many cells as there are groups, and one more. Paths from
    the least vertex to two greater ones are made and looked up in the cell. A task holds one cell's closing pairs.
    """
    groups = max(LEAST_GROUPS, isqrt(2 * pairs // HELD) + 1)
    every, none = f"sequence(0, {groups - 1})", "slice(vs, 1, 0)"
    parted = near.select("u", "vs", F.expr(f"transform({every}, g -> filter(vs, v -> v % {groups} = g))").alias("p"))
    closing = f"transform({every}, g -> named_struct('cell', least(u % {groups}, g) * {groups} + greatest(u % {groups}, g), 'path', 0, 'l', p[g], 'r', {none}))"
    paths = f"flatten(transform({every}, g -> transform(sequence(g, {groups - 1}), h -> named_struct('cell', g * {groups} + h, 'path', 1, 'l', p[g], 'r', if(g = h, {none}, p[h])))))"
    rows = parted.select("u", F.expr(f"inline(concat({closing}, {paths}))"))
    used = rows.where(f"size(l) > 0 and (path = 0 or size(r) > 0 or cell div {groups} = cell % {groups} and size(l) > 1)")
    number = F.expr(f"cast(cell div {groups} * (2 * {groups} - 1 - cell div {groups}) div 2 + cell % {groups} as int)")
    dealt = used.repartitionById(groups * (groups + 1) // 2, number).sortWithinPartitions("cell", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, codes, closing, found = -1, [], None, 0
        for batch in batches:
            cells, path = batch["cell"].to_numpy(), batch["path"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells * 2 + path)) + 1).tolist(), len(cells)] if len(cells) else [0]
            for start, end in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(start, end - start)
                if cells[start] != cell:
                    cell, codes, closing = int(cells[start]), [], None
                one, other = divmod(cell, groups)
                if not path[start]:
                    vs, ends = _lists(some["l"])
                    us = np.repeat(some["u"].to_numpy().astype(np.int64), np.diff(ends))
                    codes.append(np.where(us % groups == one, us << 32 | vs, vs << 32 | us))
                elif codes or closing:
                    if codes:
                        closing, codes = _Closing(np.concatenate(codes)), []
                    found += closing.paths(some["l"], some["r"], one == other)
        del codes, closing
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)  # the worker lives on
        yield pa.RecordBatch.from_pydict({"n": pa.array([found], pa.int64())})

    return dealt.mapInArrow(run, "n long").agg(F.sum("n").alias("n"))
