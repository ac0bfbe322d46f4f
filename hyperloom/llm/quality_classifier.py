"""Ordinal cumulative-link regression on graded ratings over hashed text features.

One weight vector, shared by all grades, scores a text; ordered thresholds cut the score: the probability of
a grade above j is the logistic of the score less threshold j. The expected grade is the sum of these, and
the probability of the highest grade selects. A document's grade is its quality plus 1 if it isn't toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.bpe import PieceHash, mixed
from hyperloom.llm.columnar import by_batch, id_and_text, sampled, utf8_buffers

#: Hashed features, and rated documents to learn from, about (chosen by their ids' hash).
BITS, SAMPLE_RATINGS = 18, 10_000
#: A feature must be in so many of the sampled documents to have a weight.
LEAST_DOCUMENTS = 5
GRADES = 3
PREFIXES = (5, 7)
#: Rounds and rate of the descent, and the weight of the sum of absolute weights in the loss.
ROUNDS, RATE, SPARSE = 300, 0.05, 2e-4
#: A document is selected if the highest grade has this probability at least.
SELECTED = 0.5
_hash = PieceHash(23)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of joined texts, each once.

    Features are lower-case letter runs, their first PREFIXES bytes, runs of other marks, whether a word equals the one before (by how
    often), the share of capitals and of words that are marks only, each in steps, and the length in steps.
    """
    n = len(offsets) - 1
    low = _LOWER[data]
    letter = _LETTER[data]
    blank = _BLANK[data]
    kind = np.where(blank, 0, np.where(letter, 1, 2)).astype(np.int8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    edge = np.append(True, (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])) if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data)).astype(np.int64)
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    keys = _hash(low, starts, ends)
    of, what = doc[starts], kind[starts]
    of_all = [of]
    same = np.append(False, (keys[1:] == keys[:-1]) & (of[1:] == of[:-1])) if len(keys) else np.zeros(0, bool)
    runs = np.bincount(of, minlength=n)
    share = lambda x: np.minimum(9, (20 * x / np.maximum(runs, 1)).astype(np.int64))
    for k in PREFIXES:
        long = (what == 1) & (ends - starts > k)
        keys = np.concatenate([keys, mixed(_hash(low, starts[long], starts[long] + k) + np.uint64(k))])
        of_all.append(of[long])
    capital = (data >= 65) & (data <= 90)
    shape = [
        share(np.bincount(of[same], minlength=n)),
        share(np.bincount(of[what == 2], minlength=n)),
        np.minimum(9, (20 * np.bincount(doc[capital], minlength=n) / np.maximum(1, np.bincount(doc[letter], minlength=n))).astype(np.int64)),
        np.minimum(20, np.log2(1 + runs).astype(np.int64)),
    ]
    shaped = np.concatenate([mixed((np.uint64(k + 1) << np.uint64(32)) + s.astype(np.uint64)) for k, s in enumerate(shape)])
    slot = (np.concatenate([keys, shaped]) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique(np.concatenate([*of_all, *[np.arange(n)] * len(shape)]) << BITS | slot)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """Rows of the probabilities of a grade above 0, 1, ..."""
        return _logistic(score[:, None] - self.thresholds)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, slot = features(data, offsets)
        return np.bincount(doc, self.weights[slot], len(offsets) - 1)

    @classmethod
    def fit(cls, doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> OrdinalModel:
        """By the likelihood of the grades, with Adam over all rows, weights drawn to 0 by their absolute sum.

        The thresholds are the first one and the logarithms of their distances, so that they stay in order.
        """
        n, size = len(grade), 1 << BITS
        used, local = np.unique(slot, return_inverse=True)
        w, free = np.zeros(len(used)), np.zeros(grades - 1)
        free[0] = -1.0
        m1, m2 = np.zeros(len(used) + grades - 1), np.zeros(len(used) + grades - 1)
        for step in range(1, (ROUNDS if n else 0) + 1):
            cuts = free[0] + np.append(0, np.cumsum(np.exp(free[1:])))
            score = np.bincount(doc, w[local], n)
            bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = _logistic(bounds[grade + 1] - score), _logistic(bounds[grade] - score)
            upper[grade == grades - 1], lower[grade == 0] = 1, 0
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            g_score = (du - dl) / n  # of the loss, by the score
            g_cuts = np.array([(-du[grade == j].sum() + dl[grade == j + 1].sum()) / n for j in range(grades - 1)])
            g_free = np.array([g_cuts.sum(), *(np.exp(free[k]) * g_cuts[k:].sum() for k in range(1, grades - 1))])
            g = np.concatenate([np.bincount(local, g_score[doc], len(used)), g_free])
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w -= move[: len(used)]
            drawn = RATE * SPARSE / (np.sqrt(m2[: len(used)] / (1 - 0.999**step)) + 1e-8)
            w = np.sign(w) * np.maximum(0, np.abs(w) - drawn)
            free -= move[len(used) :]
        weights = np.zeros(size)
        weights[used] = w
        return cls(weights, free[0] + np.append(0, np.cumsum(np.exp(free[1:]))))


def grade_of(quality: Column, toxic: Column) -> Column:
    """The grade from 0 to 2: the quality, and 1 if not toxic."""
    return (quality.cast("int") + 1 - toxic.cast("int")).cast("int")


def learn(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text") -> OrdinalModel:
    """The model from about SAMPLE_RATINGS rated documents; `ratings` has the key and `grade`, nulls left out.

    Features in too few of them are left out before they reach the driver.
    """
    rated = ratings.select(F.col(key).cast("long").alias("r"), F.col("grade").cast("int").alias("grade")).where("r is not null and grade is not null")
    n = rated.count()
    if n > SAMPLE_RATINGS:
        rated = rated.where(sampled("r", SAMPLE_RATINGS, n))
    found = id_and_text(docs, key, text).join(F.broadcast(rated), F.col("k") == F.col("r")).select("k", "t", "grade")  # bounded by the sample

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, slot = features(*utf8_buffers(part.column(1)))
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=part.num_rows)))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot, pa.int32()))], ["k", "grade", "slots"])

    rows = by_batch(found, make, "k long, grade int, slots array<int>")
    common = rows.select(F.explode("slots").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select("s").toArrow()["s"].to_numpy()
    keep = np.zeros(1 << BITS, bool)
    keep[common] = True

    def thinned(batches):
        for b in batches:
            sizes = np.diff(b.column(2).offsets.to_numpy())
            flat = b.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(len(sizes)), sizes)[keep[flat]]
            ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(sizes))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[keep[flat]], pa.int32()))], ["k", "grade", "slots"])

    table = rows.mapInArrow(thinned, "k long, grade int, slots array<int>").toArrow().combine_chunks().sort_by([("k", "ascending"), ("grade", "ascending")])
    if not table.num_rows:
        return OrdinalModel.fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lists = table["slots"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    grades = np.clip(table["grade"].to_numpy(), 0, GRADES - 1).astype(np.int64)
    return OrdinalModel.fit(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64), grades)


def grade_documents(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `expected_grade`, `tail_probability` of the highest grade, and `kept`, for every whole text.

    A null text is an empty one, graded by its length alone. One row per input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        above = shared.value.above(shared.value.score(*utf8_buffers(part.column(1))))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(above.sum(1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= SELECTED)], ["k", "expected_grade", "tail_probability", "kept"])

    return by_batch(id_and_text(docs, key, text), make, "k long, expected_grade double, tail_probability double, kept boolean").withColumnRenamed("k", key)
