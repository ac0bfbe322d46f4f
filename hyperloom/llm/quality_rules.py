"""Quality rules: a few counts, and the distance of a text's histograms from its language's.

Each language's reference is made from all its documents: shares of character classes, and of its common
words. A document is far off if the Jensen-Shannon distance of either histogram from its language's is over
a limit; documents too short for a histogram are not judged by it. A document without a language, or with
one that has no reference, is held against the nearest reference.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.columnar import by_batch, give_back, settled, steps, utf8_buffers

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
#: Code points and words under which a histogram is not held against a reference.
CLASS_GUARD, WORD_GUARD = 200, 100
#: Jensen-Shannon distances (base 2, 0 to 1) over which a document is rejected.
CLASS_LIMIT, WORD_LIMIT = 0.30, 0.40
#: A word is common in a language by this share of its words at least, so there are at most 500.
COMMON = 1 / 500
CLASS_NAMES = ("lower", "upper", "digit", "blank", "mark", "symbol", "other_ascii", "beyond_ascii")
#: Words that one task counts before it hands its counts on.
COUNTED = 100_000


def _class_table() -> np.ndarray:
    """The class of every byte; continuation bytes are of none, so each character counts once."""
    out = np.full(256, 7, np.uint8)
    out[:128] = 6
    for n, chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\n\v\f\r"), (4, b".,;:!?'\"()-"), (5, b"#*$%&|<>")):
        out[list(chars)] = n
    out[128:192] = 8
    return out


CLASS_OF = _class_table()


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of the character classes' counts of joined texts."""
    n, k = len(offsets) - 1, len(CLASS_NAMES)
    doc = np.repeat(np.arange(n) * (k + 1), np.diff(offsets))
    return np.bincount(doc + CLASS_OF[data], minlength=n * (k + 1)).reshape(n, k + 1)[:, :k]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance, base 2, of two histograms that are made to sum to 1."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(min(1.0, max(0.0, both / 2))))


@dataclass
class Reference:
    """One language's shares of character classes, its common words, and their shares with that of all others last."""

    classes: np.ndarray
    words: dict[bytes, int]
    shares: np.ndarray


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Reference]:
    """Each language's reference, counted over all documents that have a language."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where("l is not null and t is not null")

    def counted(totals: dict[str, Counter]):
        names, keys, times = [], [], []
        for name, words in totals.items():
            names += [name] * len(words)
            keys += words.keys()
            times += words.values()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.binary()), pa.array(times, pa.int64())], ["l", "w", "n"])

    def run(batches):
        words: dict[str, Counter] = {}
        classes: dict[str, Counter] = {}
        for batch in batches:
            for part in steps(batch, 0):
                data, offsets = utf8_buffers(part.column(0))
                raw, at = data.tobytes(), offsets.tolist()
                for a, b, name, row in zip(at, at[1:], part.column(1).to_pylist(), class_counts(data, offsets).tolist(), strict=False):
                    words.setdefault(name, Counter()).update(raw[a:b].split())
                    classes.setdefault(name, Counter()).update({b" %d" % k: n for k, n in enumerate(row)})
                if sum(map(len, words.values())) > COUNTED:
                    yield counted(words)
                    words = {}
        if words or classes:
            yield counted(words)
            yield counted(classes)
        give_back()

    # a class is counted under a blank and its number, which is no word
    counts = settled(rows.mapInArrow(run, "l string, w binary, n long").groupBy("l", "w").agg(F.sum("n").alias("n")))
    is_class = F.substring("w", 1, 1) == F.lit(b" ")
    totals = {r["l"]: r["n"] for r in counts.where(~is_class).groupBy("l").agg(F.sum("n").alias("n")).collect()}
    per_language = counts.where(~is_class).groupBy("l").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(per_language), "l").where(~is_class & (F.col("n") >= F.col("total") * COMMON)).select("l", "w", "n")
    out: dict[str, Reference] = {}
    for r in counts.where(is_class).select("l", "w", "n").unionByName(common).orderBy("l", F.desc("n"), "w").collect():
        ref = out.setdefault(r["l"], Reference(np.zeros(len(CLASS_NAMES)), {}, np.zeros(0)))
        if r["w"][:1] == b" ":
            ref.classes[int(r["w"])] = r["n"]
        else:
            ref.words[bytes(r["w"])] = len(ref.words)
            ref.shares = np.append(ref.shares, r["n"])
    for name, ref in out.items():
        ref.shares = np.append(ref.shares, totals.get(name, 0) - ref.shares.sum())
    return out


@dataclass
class Verdict:
    """One text's counts and distances; a distance is None where the text is too short for it."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    class_distance: float | None
    word_distance: float | None

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > 50 * self.n_words

    @property
    def kept(self) -> bool:
        return not self.base_failed and (self.class_distance or 0) <= CLASS_LIMIT and (self.word_distance or 0) <= WORD_LIMIT


def repeat_words(words: list[bytes]) -> int:
    """The words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    twice = np.array([times[w] > 1 for w in windows])
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(windows) + k] |= twice
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """The lines with a word that are equal to an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def judge(raw: bytes, classes: np.ndarray, lang: str | None, refs: dict[str, Reference]) -> Verdict:
    """The verdict on one text in UTF-8."""
    words = raw.split()
    letters = int(classes.sum())
    word_chars = letters - int(classes[3])
    near = [refs[lang]] if lang in refs else list(refs.values())
    by_class = by_word = None
    if near and letters >= CLASS_GUARD:
        by_class = min(distance(classes.astype(float), r.classes) for r in near)
    if near and len(words) >= WORD_GUARD:
        found = []
        for r in near:
            seen = np.bincount([r.words.get(w, len(r.words)) for w in words], minlength=len(r.words) + 1)
            found.append(distance(seen.astype(float), r.shares))
        by_word = min(found)
    return Verdict(len(words), word_chars, sum(map(raw.count, (bytes([s]) for s in SYMBOLS))), duplicate_lines(raw), repeat_words(words), by_class, by_word)


def _verdicts(part: pa.RecordBatch, text: int, lang: int, refs: dict[str, Reference]) -> list[Verdict]:
    data, offsets = utf8_buffers(part.column(text))
    raw, at = data.tobytes(), offsets.tolist()
    return [judge(raw[a:b], c, name, refs) for a, b, c, name in zip(at, at[1:], class_counts(data, offsets), part.column(lang).to_pylist(), strict=False)]


SCHEMA = "k long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality_rules(df: DataFrame, refs: dict[str, Reference], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances and the verdict on every whole text; one row per input row.

    A null text has no words and fails. A distance is null where the text is too short or there is no reference.
    """
    shared = df.sparkSession.sparkContext.broadcast(refs)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed, v.kept, v.class_distance, v.word_distance) for v in _verdicts(part, 1, 2, shared.value)]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    made = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    return by_batch(made, make, SCHEMA).withColumnRenamed("k", key)


def keep_quality(df: DataFrame, refs: dict[str, Reference], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `df`, all columns, that the rules keep; a null text has no words and goes."""
    shared = df.sparkSession.sparkContext.broadcast(refs)
    at, of = df.columns.index(text), df.columns.index(lang)

    def kept(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array([v.kept for v in _verdicts(part, at, of, shared.value)], pa.bool_()))

    return by_batch(df, kept, df.schema, at)
