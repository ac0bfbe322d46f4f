"""Tables in the shared folder, and bounded Bloom filters of unbounded key columns."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.columnar import settled, shared_dir

#: Bits of a filter at most (8 MB) and by key; beyond that it lets more keys through, and nothing else changes.
MOST_BITS, BITS_PER_KEY, HASHES = 1 << 26, 16, 3


class Tables:
    """Parquet tables that one run writes to the shared folder, until they are dropped."""

    def __init__(self, spark):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """`df` written and read again: its lineage is cut."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if self.n == 1:  # what later steps still read goes with the session
            root = self._path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        made = self.spark.read.schema(df.schema).parquet(path)
        made._own_path = path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table in tables:
            if own := getattr(table, "_own_path", None):
                path = self._path(own)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


class KeyFilter:
    """A Bloom filter of 64-bit keys, for filtering the other side of a join before its shuffle."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """From a one-column table; the words are put together on the executors, and at most MOST_BITS reach the driver."""
        name = keys.columns[0]
        bits = min(MOST_BITS, 1 << max(10, (BITS_PER_KEY * keys.count() - 1).bit_length()))
        places = F.array(*(F.pmod(F.xxhash64(F.col(name), F.lit(k)), F.lit(bits)) for k in range(HASHES)))
        return cls._made(keys.where(F.col(name).isNotNull()).select(F.explode(places).alias("at")), bits)

    @classmethod
    def of_tokens(cls, keys: DataFrame) -> KeyFilter:
        """From a one-column table of numbers that are hashes themselves: their own bits are the places."""
        name = keys.columns[0]
        keys = settled(keys)
        bits = min(MOST_BITS, 1 << max(10, (BITS_PER_KEY * keys.count() - 1).bit_length()))
        at = keys.select(F.explode(F.array(*(F.expr(f"shiftrightunsigned({name}, {19 * k}) & {bits - 1}") for k in range(HASHES)))).alias("at"))
        return cls._made(at, bits)

    def has_tokens(self, tokens: np.ndarray) -> np.ndarray:
        """Whether hashes may be in a set made by `of_tokens`."""
        out = np.ones(len(tokens), bool)
        for k in range(HASHES):
            at = ((tokens >> np.uint64(19 * k)) & np.uint64((len(self.words) << 6) - 1)).astype(np.int64)
            out &= (self.words[at >> 6] >> (at & 63) & 1).astype(bool)
        return out

    @classmethod
    def _made(cls, at: DataFrame, bits: int) -> KeyFilter:
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
        out = np.zeros(bits >> 6, np.int64)
        out[words["word"].to_numpy()] = words["bits"].to_numpy()
        return cls(out)

    @staticmethod
    def places(key: str | Column) -> Column:
        """The column that `has` needs: the hashes of a key column of type long, made by Spark."""
        return F.array(*(F.xxhash64(key, F.lit(k)) for k in range(HASHES)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether keys, given by rows of hashes, may be in the set."""
        at = hashes & ((len(self.words) << 6) - 1)
        return ((self.words[at >> 6] >> (at & 63)) & 1).all(axis=1)
