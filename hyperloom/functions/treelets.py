"""Rooted trees of up to 16 vertices as 32-bit numbers, and the tables that plans join with.

A tree is written as the walk around it: 1 into a child, 0 back; the number has this from its highest bit
on. A single vertex is 0. The children of a vertex stand in descending order of their own numbers.
"""

from __future__ import annotations

from functools import cache, reduce
from math import comb, factorial

from pyspark.sql import DataFrame, SparkSession

WIDTH = 32
TOP = 1 << (WIDTH - 1)
MOST_VERTICES = 16
COLORS_CLASH, WRONG_ORDER = "colors", "order"


def size(s: int) -> int:
    """The vertices of a tree."""
    return s.bit_count() + 1


def valid(s: int) -> bool:
    """Whether a number is a tree's: it walks back to the root, and children stand in order."""
    if s == 0:
        return True
    bits, depth, last = f"{s:032b}", 0, 0
    for i, b in enumerate(bits[: 2 * (size(s) - 1)]):
        depth += 1 if b == "1" else -1
        last = i + 1
        if depth < 0:
            return False
    return depth == 0 and "1" not in bits[last:] and _number(_children(s)) == s


def _children(s: int) -> list[int]:
    """The numbers of the root's subtrees, first to last."""
    out, walk = [], f"{s:032b}"[: 2 * (size(s) - 1)]
    depth, start = 0, 0
    for i, b in enumerate(walk):
        depth += 1 if b == "1" else -1
        if depth == 0:
            inner = walk[start + 1 : i]
            out.append(int(inner.ljust(WIDTH, "0"), 2) if inner else 0)
            start = i + 1
    return out


def _walk(s: int) -> str:
    return f"{s:032b}"[: 2 * (size(s) - 1)]


def _number(children: list[int]) -> int:
    """The tree whose root has these subtrees, put in order."""
    walk = "".join(f"1{_walk(c)}0" for c in sorted(children, key=lambda c: f"1{_walk(c)}0".ljust(WIDTH + 2, "0"), reverse=True))
    return int(walk.ljust(WIDTH, "0"), 2) if walk else 0


def merge(s1: int, s2: int) -> int | None:
    """The tree with `s2` as a new first child of `s1`'s root; None if it would stand in the wrong order."""
    if size(s1) + size(s2) > MOST_VERTICES:
        return None
    new = TOP + (s2 >> 1) + (s1 >> 2 * size(s2))
    shift = WIDTH - 2 * size(s2)
    return None if s1 >> shift != new >> shift and s1 > new else new


def merge_colored(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int] | str:
    """Trees with color sets merged, or why they can't be."""
    if a[1] & b[1]:
        return COLORS_CLASH
    new = merge(a[0], b[0])
    return WRONG_ORDER if new is None else (new, a[1] | b[1])


def split_child(s: int) -> int:
    """The first child of the root."""
    return _children(s)[0]


def complement(s: int) -> int:
    """The tree without the first child of its root."""
    return (s << 2 * size(split_child(s))) & (2 * TOP - 1)


def normalization(s: int) -> int:
    """How many of the first children are equal; 1 for a single vertex."""
    children = _children(s)
    return next((i for i, c in enumerate(children) if c != children[0]), len(children)) if children else 1


def leftmost_bit_tie(x: int) -> int | None:
    """The least number of leftmost bits, over 0, that hold as many zeros as ones."""
    depth = 0
    for i in range(WIDTH):
        depth += 1 if x >> (WIDTH - 1 - i) & 1 else -1
        if depth == 0:
            return i + 1
    return None


def edges(s: int) -> list[tuple[int, int]]:
    """(parent, child) pairs; vertices are numbered in the order of the walk."""
    out, way, fresh = [], [0], 1
    for b in _walk(s):
        if b == "1":
            out.append((way[-1], fresh))
            way.append(fresh)
            fresh += 1
        else:
            way.pop()
    return out


def rooted(pairs: list[tuple[int, int]], root: int) -> int:
    """The tree with these edges, seen from a root."""
    near: dict[int, list[int]] = {root: []}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    def down(v: int, above: int | None) -> int:
        return _number([down(w, v) for w in near[v] if w != above])

    return down(root, None)


def from_edges(pairs: list[tuple[int, int]], root: int = 0) -> int:
    """A tree given by its edges; an error if they are none, or too many vertices, or vertices aren't numbered from 0."""
    vertices = {v for p in pairs for v in p} | {root}
    if len(vertices) > MOST_VERTICES:
        raise ValueError("a tree has 16 vertices at most")
    if vertices != set(range(len(vertices))):
        raise ValueError("vertices must be numbered from 0 without a gap")
    if len({frozenset(p) for p in pairs}) != len(pairs) or len(pairs) != len(vertices) - 1:
        raise ValueError("the edges form no tree")
    seen, todo = {root}, [root]
    while todo:
        v = todo.pop()
        new = {b if a == v else a for a, b in pairs if v in (a, b)} - seen
        seen |= new
        todo += new
    if seen != vertices:
        raise ValueError("the edges form no tree")
    return rooted(pairs, root)


def canonical_rooting(s: int) -> int:
    """The same tree seen from its centre; of two centres the one with the greater number."""
    pairs, left = edges(s), set(range(size(s)))
    while len(left) > 2:
        degree = {v: sum(v in p for p in pairs if set(p) <= left) for v in left}
        left -= {v for v in left if degree[v] <= 1}
    return max(rooted(edges(s), c) for c in left)


def star(k: int, leaf: bool = False) -> int:
    """The star of k vertices, seen from its centre or from a leaf."""
    inner = _number([0] * (k - 1 - leaf)) if k > 1 else 0
    return _number([inner]) if leaf and k > 1 else inner


def path(k: int) -> int:
    """The path of k vertices, seen from an end."""
    return reduce(lambda s, _: _number([s]), range(k - 1), 0)


def decompose(s: int) -> set[int]:
    """All trees that merges build it from, itself among them."""
    return {s} | (decompose(split_child(s)) | decompose(complement(s)) if s else set())


def decompose_all(s: int, root: int | None = None, of_size: int | None = None) -> list[int]:
    """The parts of a tree seen from every root, or from one; of one size if given; greatest first."""
    pairs = edges(s)
    found = set().union(*(decompose(rooted(pairs, r)) for r in (range(size(s)) if root is None else [root])))
    return sorted((t for t in found if of_size is None or size(t) == of_size), reverse=True)


@cache
def trees(k: int) -> tuple[int, ...]:
    """All rooted trees of k vertices, greatest first."""
    if k == 1:
        return (0,)
    found = {merge(a, b) for j in range(1, k) for a in trees(k - j) for b in trees(j)} - {None}
    return tuple(sorted(found, reverse=True))


def rows(k: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """One row for each tree of 2 to k vertices: size, tree, rest and its size, first child and its size, equal children, tree from the centre."""
    out = []
    for n in range(2, k + 1):
        for s in trees(n):
            rest, child = complement(s), split_child(s)
            out.append((n, s, rest, size(rest), child, size(child), normalization(s), canonical_rooting(s)))
    return out


DIM = "k int, s long, comp_s long, comp_k int, split_s long, split_k int, norm int, repr long"


def dimension(spark: SparkSession, k: int) -> DataFrame:
    """The table of trees of 2 to k vertices; its rows are few (86 for k = 7), whatever the data."""
    return spark.createDataFrame(rows(k), DIM)


def closure(chosen: set[int], include: bool) -> set[int]:
    """A selection that can be built: with all parts if it includes, else only the greatest size is excluded."""
    if include:
        return {t for s in chosen for t in decompose(s)} - {0}
    most = max(map(size, chosen), default=0)
    return {s for s in chosen if size(s) == most}


def colorful_probability(k: int, colors: int) -> float:
    """That k vertices get k different ones of that many equally likely colors."""
    return reduce(lambda p, i: p * (1 - i / colors), range(k), 1.0) if k <= colors else 0.0


def colorful_probability_of(shares: list[float], k: int) -> float:
    """That k vertices get the first k colors, in any order."""
    return factorial(k) * reduce(lambda p, x: p * x, shares[:k], 1.0)


def biased_shares(colors: int, bias: float) -> list[float]:
    """All colors but the last get the smaller of the bias and an equal share; the last one gets the rest."""
    each = min(1 / colors, bias)
    return [each] * (colors - 1) + [1 - each * (colors - 1)]


def bimodal_shares(colors: int, first: int, p: float) -> list[float]:
    """The first few colors share p, the others the rest, made to sum to 1."""
    raw = [p / first if i < first else (1 - p) / (colors - first) for i in range(colors)]
    return [x / sum(raw) for x in raw]


def binomial(n: int, k: int) -> float:
    """n over k; 0 if k is more."""
    return float(comb(n, k)) if 0 <= k <= n else 0.0


def bits_needed(x: int) -> int:
    """Binary digits of a count."""
    return x.bit_length()
