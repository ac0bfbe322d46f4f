"""N-gram Jaccard join over a token-group matrix.

Documents are sets of hashed word shingles. Equal sets are one node. Nodes that agree in two minimum hashes
are checked exactly against the least of them; linked nodes have one label from then on. The matrix's tokens are
made so that any two linked sets have one in common, and sets that share only a passage have none: shingles are
dealt to numbered parts, one more than linked sets of that size can differ by, so that one part at least is the
same in both; a token is the hash of a part's shingles. Only tokens of several labels matter. The nodes that have
one are partitioned into groups of similar sets: the nodes of a large label, and otherwise those that share their
most frequent token; groups are stored in blocks of bounded size, each with the union of its sets' shingles.
A row of the matrix tells which blocks have a token and, by a bitmask, which of a block's nodes. Blocks that meet
in a token give one row with masks of the nodes on both sides, so the rows grow with the blocks, not the pairs of
nodes. Each such node is a query. Sketches of a few bits a shingle, whose difference is never more than that of the
sets, first leave out the queries and members that can't link, so that their texts stay where they are. A query's
overlap with the other block's stored union then bounds its overlap with every member, and only blocks whose bound
allows a link are opened, where sets are compared exactly, all at once. Links are handed on once for each two labels,
and links within a label never.

Hash values have 64 bits; sets with equal 128-bit digests count as equal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.bpe import PieceHash, mixed
from hyperloom.llm.columnar import by_batch, give_back, id_and_text, settled, steps, utf8_buffers
from hyperloom.llm.shared import HASHES, KeyFilter, Tables

SEEDS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC13FA9A902A6328F), np.uint64(0xD1B54A32D192ED03))
MINIMA = ("m1", "m2", "m3", "m4")
#: Sets of one block of a group, and queries that meet it at once, about; the shingles of all of them; nodes of a
#: label that has blocks of its own.
BLOCK, BLOCK_SHINGLES, LARGE = 128, 1 << 21, 64
#: Bits of a block's mask; a node's bit is a hash, so two nodes can have one, and then both are read.
MASK = 128
#: Shingles that one step of a comparison counts.
COUNTED = 1 << 15
#: Words of sketches that one step compares, and how many times more queries meet a block's sketches at once than its texts.
COMPARED, AT_ONCE = 1 << 20, 8
_word_hash = PieceHash(11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each of the joined texts, and where each text's start."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = _LOWER[data]
    full = ~_BLANK[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(full & (np.append(True, ~full[:-1]) | fresh[:-1]))
    ends = np.flatnonzero(full & (np.append(~full[1:], True) | fresh[1:])) + 1
    hashes = _word_hash(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # of each text's words
    counts = np.diff(first)
    shown = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    at = np.repeat(first[:-1] - (np.cumsum(shown) - shown), shown) + np.arange(int(shown.sum()))
    length = np.minimum(np.repeat(counts, shown), words)
    key = length.astype(np.uint64)
    for k in range(words):
        inside = length > k
        key = np.where(inside, mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at + k, len(hashes) - 1)]), key) if len(hashes) else key
    cuts = np.append(0, np.cumsum(shown))
    sets = [np.unique(key[a:b]) for a, b in zip(cuts.tolist(), cuts.tolist()[1:], strict=False)]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def overlaps(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of all sets on the left (rows) with all on the right, by products of 0-1 matrices."""
    both = np.intersect1d(left, right)
    out = np.zeros((len(left_at) - 1, len(right_at) - 1), np.int64)
    for first in range(0, len(both), COUNTED):
        step, grids = both[first : first + COUNTED], []
        for flat, at in ((left, left_at), (right, right_at)):
            column = np.minimum(np.searchsorted(step, flat), len(step) - 1)
            there = step[column] == flat
            grid = np.zeros((len(at) - 1, len(step)), np.float32)
            grid[np.repeat(np.arange(len(at) - 1), np.diff(at))[there], column[there]] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two sorted sets are similar enough, by whole numbers."""
    if min(len(a), len(b)) * share[1] < share[0] * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * share[1] >= share[0] * (len(a) + len(b) - both)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def described(docs: DataFrame, words: int) -> DataFrame:
    """Each document's set: size, digest, and four minimum hashes."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = shingles(*utf8_buffers(part.column(1)), words)
        sizes = np.diff(ends)
        full = np.flatnonzero(sizes)
        out = np.zeros((2 + len(SEEDS), len(sizes)), np.uint64)
        for k, seed in enumerate(SEEDS if len(full) else ()):
            seen = mixed(flat ^ seed)
            out[2 + k][full] = np.minimum.reduceat(seen, ends[full])
            if k < 2:
                out[k][full] = np.add.reduceat(mixed(seen), ends[full])
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *(pa.array(_signed(x)) for x in out)], ["k", "n", "d1", "d2", *MINIMA])

    return by_batch(docs, make, f"k long, n long, d1 long, d2 long, {', '.join(f'{m} long' for m in MINIMA)}")


class Parts:
    """How sets are dealt to parts, by size class, so that linked sets have a part in common.

    Linked sets are in one class or in neighbouring ones. Scheme c is for pairs whose smaller set is in class c;
    such sets differ by `differ[c]` shingles at most, and there are more parts than that. Empty parts make no
    tokens, as many sets would share them. If a linked pair has no token for that, all its untouched parts are
    empty, so both sets have `parts - differ` empty ones at least; such sets are dealt once more, by another hash,
    and after DEALS times their empty parts make tokens too.
    """

    DEALS = 3

    def __init__(self, share: tuple[int, int]):
        low, high = share
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * high // low)))
        most = [(b - 1, (b - 1) * high // low) for b in self.bounds[1:]]
        self.differ = np.array([(a + b) * (high - low) // (high + low) for a, b in most])
        # the parts that a set of the class's least size leaves empty, about
        empty = (self.differ + 1) * np.exp(-np.array(self.bounds[:-1]) / (self.differ + 1))
        self.parts = self.differ + 1 + np.ceil(2 * empty).astype(np.int64)

    def tokens(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix tokens of sets, and their sets; a set of a class without a differing partner has none."""
        sizes = np.diff(ends)
        of = np.repeat(np.arange(len(sizes)), sizes)
        own = np.searchsorted(self.bounds, sizes, "right") - 1
        value = mixed(flat ^ np.uint64(0xE7037ED1A0B428DB))
        halves = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
        out, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for scheme in (own - 1, own):
            used = (sizes > 0) & (scheme >= 0)
            used &= np.where(used, self.differ[np.maximum(scheme, 0)], 0) > 0
            for deal in range(self.DEALS):
                parts = np.where(used, self.parts[np.maximum(scheme, 0)], 0)
                base = np.cumsum(parts) - parts
                total = int(parts.sum())
                if not total:
                    break
                shown = used[of]
                place = mixed(flat[shown] + np.uint64(0x632BE59BD9B4E019 + deal)) >> np.uint64(16)
                slot = base[of[shown]] + (place % parts[of[shown]].astype(np.uint64)).astype(np.int64)
                sums = [np.bincount(slot, h[shown], total) for h in halves]  # whole numbers, exact under 2**53
                filled = np.bincount(slot, minlength=total) > 0
                slot_of = np.repeat(np.arange(len(sizes)), parts)
                sparse = used & (np.bincount(slot_of[~filled], minlength=len(sizes)) >= parts - self.differ[np.maximum(scheme, 0)])
                take = filled | sparse[slot_of] if deal == self.DEALS - 1 else filled
                number = (np.arange(total) - base[slot_of])[take].astype(np.uint64)
                name = mixed(scheme[slot_of[take]].astype(np.uint64) << np.uint64(40) | np.uint64(deal << 36) | number)
                out.append(mixed(mixed(sums[0][take].astype(np.uint64)) + sums[1][take].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + name))
                sets.append(slot_of[take])
                used = sparse
        return np.concatenate(out), np.concatenate(sets)


def matrix_rows(docs: DataFrame, words: int, share: tuple[int, int], only: KeyFilter | None = None) -> DataFrame:
    """`k` and `tokens` of every document; with `only`, just the tokens that may be among its keys."""
    parts = Parts(share)
    chosen = docs.sparkSession.sparkContext.broadcast(only)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, sets = parts.tokens(*shingles(*utf8_buffers(part.column(1)), words))
        if chosen.value is not None:
            may = chosen.value.has_tokens(tokens)
            tokens, sets = tokens[may], sets[may]
        order = np.argsort(sets, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(sets, minlength=part.num_rows)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(tokens[order])))
        return pa.RecordBatch.from_arrays([part.column(0), lists], ["k", "tokens"])

    return by_batch(docs, make, "k long, tokens array<long>")


def texts_of(docs: DataFrame, keys: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "k long, t string") -> DataFrame:
    """The documents that may be among `keys`, by a bounded filter before any shuffle, or what `make` makes of steps of them."""
    chosen = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(keys))

    def run(batches):
        for batch in batches:
            hashes = batch.column(2).flatten().to_numpy().reshape(-1, HASHES)
            found = batch.select([0, 1]).filter(pa.array(chosen.value.has(hashes)))
            yield from map(make, steps(found, 1)) if make else (found,)
        give_back()

    return docs.where("k is not null").withColumn("h", KeyFilter.places("k")).mapInArrow(run, schema)


def checked(pairs: DataFrame, docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) whose documents are similar enough; each pair comes from its texts."""
    texts = texts_of(docs, pairs.select("a").union(pairs.select("b")).distinct())
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            for part in steps(batch, 2):
                left, left_at = shingles(*utf8_buffers(part.column(2)), words)
                texts_b = part.column(3).dictionary_encode()
                right, right_at = shingles(*utf8_buffers(texts_b.dictionary), words)
                good = [linked(left[left_at[k] : left_at[k + 1]], right[right_at[j] : right_at[j + 1]], share) for k, j in enumerate(texts_b.indices.to_pylist())]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """`node` and `label`, the least node of its component, for all nodes of edges (a, b).

    Rounds of contraction: every node goes to the neighbour, or stays, that comes first in the round's order,
    and edges follow their ends. The first round orders by the nodes themselves, which takes stars around their
    least node at once; every other round's order is random, so that a constant share of the nodes goes.
    """
    edges = tables.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(hooks)
        near = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "to")
        order = (lambda c: F.xxhash64(F.col(c), F.lit(turn))) if turn % 2 else (lambda c: F.col(c))  # noqa: B023
        place = lambda c: F.struct(order(c).alias("first"), F.col(c).alias("id"))  # noqa: E731, B023
        hook = near.groupBy("node").agg(F.min(place("to")).alias("best")).select("node", F.least(F.col("best"), place("node"))["id"].alias("to"))
        hooks.append(tables.write(hook))
        moved = edges.join(hooks[-1].toDF("a", "ta"), "a").join(hooks[-1].toDF("b", "tb"), "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        old, edges = edges, tables.write(moved.where("a <> b").distinct())
        tables.drop(old)
    if not hooks:
        return edges.toDF("node", "label")
    goes = hooks[0]
    for n, hook in enumerate(hooks[1:], 1):
        goes = goes.toDF("node", "at").join(hook.toDF("at", "next"), "at", "left").select("node", F.coalesce("next", "at").alias("to"))
        goes = tables.write(goes) if n % 6 == 0 else goes
    if len(hooks) > 1:  # in the first round's order the least node may have gone elsewhere since
        goes = goes.join(goes.groupBy("to").agg(F.min("node").alias("label")), "to").select("node", "label")
    labelled = tables.write(goes.toDF("node", "label"))
    tables.drop(edges, *hooks)
    return labelled


def _shared_tokens(docs: DataFrame, labels: DataFrame, words: int, share: tuple[int, int], tables: Tables) -> DataFrame:
    """`token`, `node`, `label` and `n`, the token's nodes, for the tokens of several labels.

    A first pass finds them, from each token's least and greatest label; a second one takes the rows of these
    tokens alone. A token of any number of copies or of nodes of one label is a row a task in the first, and in none of the second.
    """
    docs, at = docs.where("k is not null"), labels.withColumnRenamed("node", "k")
    several = matrix_rows(docs, words, share).join(at, "k").select("label", F.explode("tokens").alias("token"))
    several = several.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    again = matrix_rows(docs, words, share, KeyFilter.of_tokens(several)).where(F.size("tokens") > 0)
    found = tables.write(again.join(at, "k").select(F.explode("tokens").alias("token"), F.col("k").alias("node"), "label").distinct())
    counts = found.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token", "n")
    made = tables.write(found.join(counts, "token"))
    tables.drop(found)
    return made


def blocks(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """`node`, `label`, `size` (of its set), `block`, and the node's bit in its block's mask, as `bit0` and `bit1`.

    A node of a small label goes by the most frequent token of all nodes that share one with it, so that similar nodes which
    lack their group's most frequent token come to it through others. A group has as many blocks as its sets and their shingles need.
    """
    own = shared.groupBy("node").agg(F.max(F.struct("n", "token")).alias("best"))
    near = shared.select("token", "node").join(own, "node").groupBy("token").agg(F.max("best").alias("best"))
    nodes = shared.join(near, "token").groupBy("node", "label").agg(F.max("best").alias("seat")).join(sets.select("node", F.col("n").alias("size")), "node")
    nodes = nodes.join(nodes.groupBy("label").agg(F.count("*").alias("alike")), "label")
    keyed = nodes.withColumn("own", F.col("alike") >= LARGE).withColumn("key", F.when(F.col("own"), F.xxhash64("label")).otherwise(F.xxhash64("seat.token", F.lit(1))))
    groups = keyed.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("buckets"))
    bucket = F.pmod(F.xxhash64("node", F.lit(77)), F.col("buckets"))
    number = F.xxhash64("key", bucket)
    bit = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(MASK))
    half = lambda k: F.expr(f"if(bit div 64 = {k}, shiftleft(1L, int(bit % 64)), 0L)").alias(f"bit{k}")
    return keyed.join(groups, "key").select("node", "label", "size", number.alias("block"), bit.alias("bit")).select("node", "label", "size", "block", half(0), half(1))


def meetings(shared: DataFrame, members: DataFrame) -> DataFrame:
    """`asks`, `block` and masks of the nodes on both sides, for blocks with different labels in a token; the side with fewer nodes asks."""
    at = shared.select("token", "node").join(members, "node")
    matrix = at.groupBy("token", "block").agg(*(F.bit_or(f"bit{k}").alias(f"bits{k}") for k in (0, 1)), F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = (matrix.select("token", *(F.col(c).alias(f"{c}_{side}") for c in matrix.columns[1:])) for side in "xy")
    met = x.join(y, "token").where("block_x >= block_y and (lo_x <> hi_x or lo_y <> hi_y or lo_x <> lo_y)")
    masks = [F.bit_or(f"bits{k}_{side}").alias(f"{name}{k}") for side, name in (("x", "by"), ("y", "of")) for k in (0, 1)]
    pairs = met.groupBy("block_x", "block_y").agg(*masks)
    fewer = F.expr("bit_count(by0) + bit_count(by1) <= bit_count(of0) + bit_count(of1)")
    sides = ("block_x", "block_y", "asks", "block"), ("by0", "of0", "by0", "of0"), ("by1", "of1", "by1", "of1")
    return pairs.select(*(c for x, y, a, b in sides for c in (F.when(fewer, F.col(x)).otherwise(F.col(y)).alias(a), F.when(fewer, F.col(y)).otherwise(F.col(x)).alias(b))))


def _dealt(queries: DataFrame, at_once: int = 1) -> DataFrame:
    """`block` and `parts`, over which its queries are dealt, `at_once` blocks of them to a part."""
    return queries.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / (BLOCK * at_once), F.sum("size") / (BLOCK_SHINGLES * at_once))).cast("long").alias("parts"))


def _asking(queries: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Queries with the part of the block that each goes to, and the rows of their nodes."""
    dealt = queries.drop("size").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    return dealt.join(rows, "node")


def _copies(stored: DataFrame, parts: DataFrame) -> DataFrame:
    """What blocks have stored, for each part of their queries; columns end in `_of`."""
    each = stored.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return each.select(*(F.col(c).alias(f"{c}_of") for c in ("part", *stored.columns)))


def parities(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of sets, joined, and where each one's bytes start.

    A sketch has a power of two of bits, two to four for each shingle; a bit is the parity of the number of shingles
    that hash to it. Two sets differ by as many shingles at least as their sketches differ in bits.
    """
    sizes = np.diff(ends)
    bits = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(sizes)), sizes)
    slot = np.sort(base[of] + (mixed(flat ^ np.uint64(0x8CB92BA72F3D8DD7)) & (bits[of] - 1).astype(np.uint64)).astype(np.int64))
    runs = np.flatnonzero(np.diff(slot, prepend=-1))
    odd = np.diff(np.append(runs, len(slot))) % 2 == 1
    flags = np.zeros(int(bits.sum()), bool)
    flags[slot[runs[odd]]] = True
    return np.packbits(flags, bitorder="little"), np.append(0, np.cumsum(bits // 8))


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Rows of sketches as 64-bit words, halved until they have so many bits."""
    while sketches.shape[1] * 8 > bits:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return np.ascontiguousarray(sketches).view(np.uint64)


def may_link(sizes: tuple[np.ndarray, np.ndarray], labels: tuple[np.ndarray, np.ndarray], sketches: tuple[pa.Array, pa.Array], share: tuple[int, int]) -> np.ndarray:
    """Which sets of the left (rows) and of the right have other labels and sizes and sketches that allow a link; no link is lost."""
    low, high = share
    raw, at = zip(*(_bytes_of(s) for s in sketches), strict=True)
    bits = [np.diff(x) * 8 for x in at]
    fit = labels[0][:, None] != labels[1]
    fit &= np.minimum(sizes[0][:, None], sizes[1]) * high >= np.maximum(sizes[0][:, None], sizes[1]) * low
    for a in np.unique(bits[0]).tolist():
        rows = np.flatnonzero(bits[0] == a)
        for b in np.unique(bits[1]).tolist():
            columns = np.flatnonzero(bits[1] == b)
            part = np.ix_(rows, columns)
            if not fit[part].any():
                continue
            x = folded(raw[0][at[0][rows][:, None] + np.arange(a // 8)], min(a, b))
            y = folded(raw[1][at[1][columns][:, None] + np.arange(b // 8)], min(a, b))
            differ, step = np.zeros((len(x), len(y)), np.int64), max(1, COMPARED // (len(x) * len(y)))
            for w in range(0, x.shape[1], step):
                differ += np.bitwise_count(x[:, None, w : w + step] ^ y[None, :, w : w + step]).sum(axis=2, dtype=np.int64)
            fit[part] &= differ * (low + high) <= (high - low) * (sizes[0][rows][:, None] + sizes[1][columns])
    return fit


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary column without nulls, and where each value starts."""
    return utf8_buffers(column.cast(pa.large_binary()).view(pa.large_string()))


def sketched(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """`node` and `sketch` of the documents that may be among `nodes`."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = parities(*shingles(*utf8_buffers(part.column(1)), words))
        made = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([part.column(0), made], ["node", "sketch"])

    return texts_of(docs, nodes, make, "node long, sketch binary")


def _near(queries: DataFrame, opened: DataFrame, drawn: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The queries (node, block, own) that some member of the block may link with, by their sketches, as `asks`, and these members."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        both = [t.combine_chunks() for t in (left, right)]
        if left.num_rows and right.num_rows:
            named = [[t[f"{c}{end}"].combine_chunks() for c in ("size", "label", "sketch")] for t, end in zip(both, ("_of", ""), strict=True)]
            sizes, labels, sketches = zip(*named, strict=True)
            fit = may_link(tuple(c.to_numpy() for c in sizes), tuple(c.to_numpy() for c in labels), sketches, share)
        else:
            fit = np.zeros((left.num_rows, right.num_rows), bool)
        members = both[0].select(["node_of", "block_of"]).rename_columns(["node", "block"]).filter(pa.array(fit.any(axis=1)))
        members = members.append_column("own", pa.array(np.ones(members.num_rows, bool))).append_column("asks", pa.array(np.zeros(members.num_rows, bool)))
        asking = both[1].select(["node", "block", "own"]).filter(pa.array(fit.any(axis=0)))
        return pa.concat_tables([members, asking.append_column("asks", pa.array(np.ones(asking.num_rows, bool)))])

    parts = _dealt(queries, AT_ONCE)
    left = _copies(opened.select("block", "node", "label", "size", "sketch"), parts)
    right = _asking(queries, parts, drawn.select("node", "label", "size", "sketch"))
    return left.groupBy("block_of", "part_of").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "node long, block long, own boolean, asks boolean")


def stored_unions(texts: DataFrame, words: int) -> DataFrame:
    """`block` and `shingles`, the sorted 32-bit ends of the shingle hashes of all its sets.

    Ends that two shingles share can only raise an overlap, so the bound still holds.
    """

    def union(table: pa.Table) -> pa.Table:
        held = np.zeros(0, np.uint32)
        for batch in table.to_batches():
            for part in steps(batch, table.column_names.index("t")):
                flat, _ = shingles(*utf8_buffers(part.column("t")), words)
                held = np.union1d(held, flat.astype(np.uint32))
        return pa.table({"block": table["block"].slice(0, 1), "shingles": pa.array([held.tobytes()], pa.binary())})

    return texts.select("block", "t").groupBy("block").applyInArrow(union, "block long, shingles binary")


def _allowed(queries: DataFrame, unions: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The queries (node, block) whose overlap with the block's stored union allows a link with a member."""

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        good = np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            union = np.frombuffer(left["shingles_of"][0].as_py(), np.uint32)
            flat, at = shingles(*utf8_buffers(right["t"].combine_chunks()), words)
            ends = flat.astype(np.uint32)
            there = union[np.minimum(np.searchsorted(union, ends), len(union) - 1)] == ends
            found = np.append(0, np.cumsum(there))[at]
            sizes = np.diff(at)
            good = (np.diff(found) * share[1] >= sizes * share[0]) & (sizes > 0)
        return right.select(["node", "block"]).filter(pa.array(good))

    parts = _dealt(queries)
    asking = _asking(queries, parts, texts)
    return _copies(unions, parts).groupBy("block_of", "part_of").cogroup(asking.groupBy("block", "part")).applyInArrow(bound, "node long, block long")


def _links(queries: DataFrame, opened: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Pairs of labels (a, b) of which a query and a node that its block opens are linked."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros((2, 0), np.int64)
        if left.num_rows and right.num_rows:
            sets = [shingles(*utf8_buffers(t.combine_chunks()), words) for t in (left["t_of"], right["t"])]
            sizes = [np.diff(at) for _, at in sets]
            both = overlaps(*sets[0], *sets[1])
            names = left["label_of"].to_numpy(), right["label"].to_numpy()
            good = (both > 0) & (both * share[1] >= share[0] * (sizes[0][:, None] + sizes[1] - both)) & (names[0][:, None] != names[1])
            x, y = np.nonzero(good)
            found = np.unique(np.sort(np.stack([names[0][x], names[1][y]]), axis=0), axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    parts = _dealt(queries)
    left, right = _copies(opened.select("block", "label", "t"), parts), _asking(queries, parts, texts)
    return left.groupBy("block_of", "part_of").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "a long, b long")


def _links_of_blocks(docs: DataFrame, members: DataFrame, met: DataFrame, words: int, share: tuple[int, int], tables: Tables) -> DataFrame:
    """Links between labels: by sketches, then by bounds against the stored unions, then by opening the blocks that qualify.

    Only nodes whose sketch comes near enough to one of the other side have their texts shuffled.
    """
    has = lambda name: (F.col(f"{name}0").bitwiseAND(F.col("bit0")) != 0) | (F.col(f"{name}1").bitwiseAND(F.col("bit1")) != 0)
    drawn = tables.write(sketched(docs, members.select("node"), words).join(members, "node"))
    asked = met.select(F.col("block").alias("to"), "by0", "by1", F.col("asks").alias("block")).join(members, "block").where(has("by"))
    asked = asked.select("node", F.col("to").alias("block"), (F.col("to") == F.col("block")).alias("own"), "size")
    masks = met.groupBy("block").agg(F.bit_or("of0").alias("of0"), F.bit_or("of1").alias("of1"))
    near = tables.write(_near(asked, drawn.join(masks, "block").where(has("of")), drawn, share).distinct())
    keys = near.groupBy("node").agg(F.bool_or(~F.col("asks")).alias("open"))
    texts = texts_of(docs, keys.select("node")).withColumnRenamed("k", "node").join(keys, "node").join(members.select("node", "label", "size", "block"), "node")
    texts = tables.write(texts)
    named = texts.select("node", "label", "t")
    queries = near.where("asks").join(members.select("node", "size"), "node").select("node", "block", "own", "size")
    own, other = queries.where("own").drop("own"), queries.where("not own").drop("own")
    opened = texts.where("open")
    unions = tables.write(stored_unions(opened.join(other.select("block").distinct(), "block", "left_semi"), words))
    good = _allowed(other, unions, named, words, share).join(members.select("node", "size"), "node").select("node", "block", "size")
    queries = tables.write(good.unionByName(own))
    links = tables.write(_links(queries, opened.join(queries.select("block").distinct(), "block", "left_semi"), named, words, share).distinct())
    tables.drop(drawn, near, texts, unions, queries)
    return links


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """`key`, `n_shingles` and `component_id`, the least key that links reach; one row per input row.

    Two documents link when share[1] * |A and B| >= share[0] * |A or B| over their sets of `words`-word
    shingles (words are runs without ASCII white space, A-Z in lower case; a shorter text is one shingle).
    Null, empty and blank texts have no set and link with nothing: their component is their own. Rows with
    one key are one document; a row with a null key links with nothing, and its component is null. Extra columns are not
    read; an empty table gives an empty result.
    """
    docs = id_and_text(df, key, text)
    tables = Tables(df.sparkSession)
    meta = tables.write(described(docs, words))
    full = meta.where("n > 0 and k is not null")
    sets = tables.write(full.groupBy("n", "d1", "d2").agg(F.min("k").alias("node"), *(F.min(m).alias(m) for m in MINIMA)))
    # labels around leaders
    seats = sets.select("node", F.explode(F.array(F.xxhash64(F.lit(1), *MINIMA[:2]), F.xxhash64(F.lit(2), *MINIMA[2:]))).alias("seat"))
    leaders = seats.groupBy("seat").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1").drop("size")
    stars = tables.write(seats.join(leaders, "seat").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    near = components(checked(stars, docs, words, share), tables)
    nodes = sets.select("node").distinct()
    labels = tables.write(nodes.join(near, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    # blocks of groups, and which of them meet
    shared = _shared_tokens(docs, labels, words, share, tables)
    members = tables.write(blocks(shared, sets))
    met = tables.write(meetings(shared, members))
    links = _links_of_blocks(docs, members, met, words, share, tables)
    merged = components(links, tables)
    final = labels.join(merged.toDF("label", "whole"), "label", "left").select("node", F.coalesce("whole", "label").alias("component_id"))
    of_set = tables.write(sets.select("n", "d1", "d2", "node").join(final, "node").select("n", "d1", "d2", "component_id"))
    tables.drop(near, labels, shared, members, met, links, merged, stars, sets)
    out = meta.join(of_set, ["n", "d1", "d2"], "left")
    chosen = F.when(F.col("k").isNotNull(), F.coalesce("component_id", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), chosen.alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `df`, all columns, that are the least of their component; rows with a null key all stay."""
    found = similar_components(df, key, text, words, share)
    gone = settled(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("k")).distinct())
    chosen = df.sparkSession.sparkContext.broadcast(KeyFilter.of(gone))

    @F.arrow_udf("boolean")
    def may_go(hashes: pa.Array) -> pa.Array:
        return pa.array(chosen.value.has(hashes.flatten().to_numpy().reshape(-1, HASHES)))

    own = F.col(f"`{key}`").cast("long")
    name = "_gone" + "_" * max(map(len, df.columns))
    asked = may_go(KeyFilter.places(own))
    checked_rows = df.where(asked).join(gone.withColumnRenamed("k", name), own == F.col(name), "left_anti")
    return df.where(~asked).unionByName(checked_rows)
