"""Best-fit decreasing packing of documents into sequences, by a segment tree over remaining capacities.

Pieces of one length are alike, so the plan is made from the number of pieces of each length: at most
`capacity` numbers reach the driver, however many documents there are. The tree finds the tightest open
group of bins for a length; a group's bins have equal room and neighbouring numbers, so the plan is a
bounded list of ranges. Every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.llm.bpe import _place, vocabulary
from hyperloom.llm.columnar import by_batch, id_and_text, settled, utf8_buffers

CAPACITY, END_ID, VOCABULARY = 1024, 2, "byte_bpe_50k.json"
PIECES = "k long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Which remaining capacities have an open bin; the least one that is enough, in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def mark(self, room: int, open_: bool) -> None:
        node = room + self.leaves
        self.any[node] = open_
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """The least open capacity of at least `need`."""
        node = need + self.leaves
        if self.any[node]:
            return need
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


@dataclass
class Plan:
    """Ranges of pieces, ordered by place; a piece's place is its rank behind all pieces of greater length."""

    before: np.ndarray  # by length, the pieces of greater length
    place: np.ndarray  # where a range starts
    sequence: np.ndarray  # its first sequence
    in_each: np.ndarray  # its pieces in each sequence
    offset: np.ndarray  # where in the sequence they start
    sequences: int

    def lookup(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        at = self.before[lengths] + ranks
        k = np.searchsorted(self.place, at, "right") - 1
        nth = at - self.place[k]
        return self.sequence[k] + nth // self.in_each[k], self.offset[k] + nth % self.in_each[k] * lengths


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for `counts[length]` pieces of each length from 1 to `capacity`."""
    tree, groups = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    before, ranges, place, sequences = np.zeros(capacity + 1, np.int64), [], 0, 0

    def put(room: int, first: int, bins: int) -> None:
        groups[room].append((first, bins))
        tree.mark(room, True)

    for length in range(capacity, 0, -1):
        before[length], left = place, counts.get(length, 0)
        while left:
            room = tree.tightest(length)
            if room is None:
                bins = -(-left // (capacity // length))
                put(capacity, sequences, bins)
                sequences += bins
                room = capacity
            first, bins = groups[room].pop()
            each = room // length
            for n, m in ((min(bins, left // each), each), (1, left % each if bins > left // each else 0)):
                if n and m:
                    ranges.append((place, first, m, capacity - room))
                    put(room - m * length, first, n)
                    place, left, first, bins = place + n * m, left - n * m, first + n, bins - n
            if bins:
                groups[room].append((first, bins))
            tree.mark(room, bool(groups[room]))
    columns = np.array(ranges, np.int64).reshape(-1, 4).T
    return Plan(before, *columns, sequences)


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_file: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Every document's tokens and its end id, cut into pieces of `capacity` if longer; the first piece has the rest."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = vocabulary(_place(vocabulary_file)).encode_bytes(*utf8_buffers(part.column(1)))
        raw, keys, rows = ids.astype("<u4").tobytes(), part.column(0).to_pylist(), []
        for k, a, b in zip(keys, ends.tolist(), ends.tolist()[1:], strict=False):
            own, n = raw[4 * a : 4 * b] + END_ID.to_bytes(4, "little"), b - a + 1
            start, end = 0, (n - 1) % capacity + 1
            piece = 0
            while start < n:
                rows.append((k, piece, start, end - start, zlib.crc32(own[4 * start : 4 * end])))
                start, end, piece = end, end + capacity, piece + 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["k", "piece", "start", "length", "ids_crc32"])

    return by_batch(id_and_text(df, key, text), make, PIECES)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`sequence_id` and `offset` for rows with `length`; other columns stay.

    `pieces` must give the same rows whenever it is read. Rows get their rank within a length from
    (length, bucket) windows, so that a length that most rows share is dealt over many tasks.
    """
    spark = pieces.sparkSession
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("k", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sizes = settled(sizes)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(counts, capacity)
    earlier = sizes.withColumn("earlier", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    earlier = earlier.select("length", "bucket", F.coalesce("earlier", F.lit(0)).alias("earlier"))
    order = Window.partitionBy("length", "bucket").orderBy("k", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(order) - 1).join(earlier, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("earlier") + F.col("nth")).alias("rank"))
    at = pieces.columns.index("length")

    def place(batches):
        for b in batches:
            n = b.num_columns - 1
            sequence, offset = plan.lookup(b.column(at).to_numpy(), b.column(n).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*b.schema.names[:n], "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_file: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """All documents packed into sequences of at most `capacity` tokens; one row per piece.

    A null or empty text is the end id alone. Repeated rows are packed each. Rows of equal length may
    change places among sequences, never their sizes. Other input columns are not read.
    """
    return place_pieces(settled(token_pieces(df, key, text, vocabulary_file, capacity)), capacity).withColumnRenamed("k", key)
