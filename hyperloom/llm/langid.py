"""Language ID by a bit-sliced Bloom filter over letter n-grams.

Slot i of the filter is a bitmask with one bit for each language: a look-up of an n-gram takes the AND of
its slots and so gives all languages that have the n-gram at once; beyond 64 languages a slot has several words.
A document's hits of each language, less the share expected from false positives, decide; of languages that are
equal in that, the first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.bpe import mixed
from hyperloom.llm.columnar import by_batch, sampled, utf8_buffers
from hyperloom.llm.pretokens import LETTER, classes

ORDERS = (3, 4)
HASHES = 4
SLOTS_PER_GRAM = 8
#: Documents to learn from, about; an n-gram is a language's if it has this share of the language's n-grams at least.
SAMPLE_DOCUMENTS, LEAST_SHARE = 20_000, 1 / 20_000
#: Under this corrected share of known n-grams the filter stage rejects a document.
LEAST_SCORE = 0.2
#: Bits of a slot's word; text bytes of one step, and letters that are hashed at once, which bound the memory.
BITS, STEP, WINDOW = 64, 1 << 19, 1 << 18


def _lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case, where each text starts in them, and whether each is a letter."""
    text = data.tobytes().decode()
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    points = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    starts = offsets if len(text) == len(data) else np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    return points, starts, classes("tiktoken")[points] == LETTER


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and hashes of all n-grams of lower-case letters, other characters counting as one blank each run, some at a time."""
    if not len(data):
        return
    points, starts, letter = _lowered(data, offsets)
    keep = letter.copy()  # of a run of others the first stands for the run
    keep[0] = True
    keep[1:] |= letter[:-1]
    keep[starts[:-1][np.diff(starts) > 0]] = True
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(starts))[keep]
    points = np.where(letter, points, np.uint32(32))[keep]
    for first in range(0, len(points), WINDOW):
        for n in ORDERS:
            last = min(len(points), first + WINDOW + n - 1)
            size = last - first - n + 1
            if size <= 0:
                continue
            key = np.zeros(size, np.uint64)
            for k in range(n):
                point = points[first + k : first + k + size].astype(np.uint64)
                key = mixed(key * np.uint64(31) + point + np.uint64(n)) if k == n - 1 else key << np.uint64(21) | point
            inside = doc[first + n - 1 : last] == doc[first : first + size]
            yield doc[first : first + size][inside], key[inside]


@dataclass
class LanguageFilter:
    """The filter's slots as bitmasks (a row for each 64 languages), the languages of its bits, and each one's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray

    @classmethod
    def of(cls, found: dict[str, np.ndarray]) -> LanguageFilter:
        """From each language's n-gram hashes."""
        languages = sorted(found)
        most = max([1, *map(len, found.values())])
        slots = np.zeros((-(-len(languages) // BITS), 1 << (SLOTS_PER_GRAM * most - 1).bit_length()), np.uint64)
        out = cls(languages, slots, np.zeros(len(languages)))
        for n, name in enumerate(languages):
            word, bit = slots[n // BITS], np.uint64(1 << n % BITS)
            for at in out._places(found[name]):
                word[at] |= bit
            out.wrong[n] = (np.count_nonzero(word & bit) / len(word)) ** HASHES
        return out

    def _places(self, keys: np.ndarray):
        step = mixed(keys + np.uint64(0x1234567)) | np.uint64(1)
        for k in range(HASHES):
            yield ((keys + np.uint64(k) * step) & np.uint64(self.slots.shape[1] - 1)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bitmasks: a row for each 64 languages."""
        out = None
        for at in self._places(keys):
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of joined texts; `und` and 0 without a letter; 0 too where no n-gram is known."""
        n, many = len(offsets) - 1, len(self.languages)
        if not many:
            return ["und"] * n, np.zeros(n)
        hits, total = np.zeros((many, n)), np.zeros(n)
        for doc, keys in grams(data, offsets):
            masks = self.masks(keys)
            total += np.bincount(doc, minlength=n)
            for k in range(many):
                hits[k] += np.bincount(doc, masks[k // BITS] >> np.uint64(k % BITS) & np.uint64(1), n)
        share = np.clip((hits.T / np.maximum(total, 1)[:, None] - self.wrong) / np.maximum(1e-9, 1 - self.wrong), 0, 1)
        letters = np.zeros(n, bool)
        if len(data):
            _, starts, letter = _lowered(data, offsets)
            letters = np.diff(np.append(0, np.cumsum(letter))[starts]) > 0
        best = share.argmax(1)
        score = np.where(letters, share[np.arange(n), best], 0.0)
        return [self.languages[b] if has else "und" for b, has in zip(best.tolist(), letters.tolist(), strict=True)], score


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> LanguageFilter:
    """The filter from about `sample` documents with a language that aren't held out, chosen by their ids' hash.

    Each language's n-grams with a share of LEAST_SHARE at least: their number is bounded by its reciprocal.
    """
    usable = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where(~held_out("k") & F.col("l").isNotNull())
    rows = usable.select("k").count()
    if rows > sample:
        usable = usable.where(sampled("k", sample, rows))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        names, of = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
        tables = [pa.table({"l": pa.array([], pa.string()), "g": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})]
        for doc, keys in grams(*utf8_buffers(part.column(0))):
            for n, name in enumerate(names.tolist()):
                own, times = np.unique(keys[of[doc] == n], return_counts=True)
                tables.append(pa.table({"l": pa.array([name] * len(own), pa.string()), "g": pa.array(own.view(np.int64)), "n": pa.array(times)}))
        made = pa.concat_tables(tables).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in made.columns], made.schema.names)

    counted = by_batch(usable.select("t", "l"), count, "l string, g long, n long", 0, STEP).groupBy("l", "g").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("l").agg(F.sum("n").alias("total"))
    common = counted.join(F.broadcast(totals), "l").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * LEAST_SHARE)).select("l", "g")
    found: dict[str, list] = {}
    for r in common.toLocalIterator():
        found.setdefault(r["l"], []).append(r["g"])
    return LanguageFilter.of({k: np.sort(np.array(v, np.int64)).view(np.uint64) for k, v in found.items()})


def predict_language(df: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `held_out`, `lang_pred` and `score` of every whole text; one row per input row.

    Null and letterless texts are `und` with 0. A text with letters but no known n-gram, or one that languages share
    alike, is of the first such language in the alphabet. A document with a null key counts as held out. Without a learned language
    all texts are `und`. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        names, score = shared.value.predict(*utf8_buffers(part.column(1)))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(score)], ["k", "held_out", "lang_pred", "score"])

    made = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), held_out(key).alias("h"))
    return by_batch(made, make, "k long, held_out boolean, lang_pred string, score double", most=STEP).withColumnRenamed("k", key)


def keep_languages(df: DataFrame, model: LanguageFilter, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `df`, all columns, whose text is in a learned language by a score of `least` at least.

    Null and letterless texts go, and so do texts of which less than `least` of the n-grams are known in any language.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def kept(part: pa.RecordBatch) -> pa.RecordBatch:
        names, score = shared.value.predict(*utf8_buffers(part.column(at)))
        return part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return by_batch(df, kept, df.schema, at, STEP)
