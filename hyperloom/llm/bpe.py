"""Byte-level BPE: pieces of like length are rows of one padded matrix, and all rows merge together.

In each round every row merges its leftmost pair of least rank, found by a hashed pair table; the merged
row closes up, and rows without a pair left leave the matrix. Pieces seen before come from a hashed store.
Pieces of more than LONGEST bytes go through a heap of pairs, which gives the same merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.columnar import by_batch, id_and_text, utf8_buffers
from hyperloom.llm.pretokens import byte_bounds

LONGEST = 256
NONE = np.int64(1 << 40)
#: Cells of one matrix, pieces and tokens of the store; beyond that the store starts again.
CELLS, STORED = 1 << 20, 1 << 19
#: Bytes of a span that its hash takes in rounds.
CHAINED = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each mixed by a reversible finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all pairs, joined."""
    total = int(sizes.sum())
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[at + np.arange(total)]


def _appended(flat: np.ndarray, ends: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A growing store of lists, `flat` used up to the last of `ends`, with lists of these sizes behind it."""
    used = int(ends[-1])
    total = used + len(more)
    if total > len(flat):
        flat = np.concatenate([flat[:used], np.zeros(total, flat.dtype)])
    flat[used:total] = more
    return flat, np.concatenate([ends, used + np.cumsum(sizes)])


class HashTable:
    """From 64-bit keys other than 0 to numbers, by open addressing over arrays."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not have yet."""
        while 2 * (self.size + len(keys)) > len(self.keys):
            self._grow()
        slot, mask = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.values[slot[won]] = values[won]
            self.size += int(won.sum())
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & mask

    def _grow(self) -> None:
        full = self.keys != 0
        keys, values = self.keys[full], self.values[full]
        self.__init__(self.bits + 1)
        self.put(keys, values)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot, mask = self._slots(keys), len(self.keys) - 1
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], default)
        left = np.flatnonzero((there != keys) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out


class PieceHash:
    """64-bit hashes of many byte spans at once: eight bytes a round go through a mixing chain that starts at the span's length.

    Spans of over 64 bytes take a cryptographic hash one by one.
    """

    def __init__(self, seed: int = 7):
        self.seed = mixed(np.array([seed], np.uint64))[0]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hashes of data[start : end] of all pairs."""
        left = ends - starts
        out = mixed(left.astype(np.uint64) * _ODD + self.seed)
        room = np.zeros(len(data) + 8, np.uint8)
        room[: len(data)] = data
        eight = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))  # the eight bytes from every place on
        for k in np.flatnonzero(left > CHAINED).tolist():
            out[k] ^= np.uint64(int.from_bytes(hashlib.blake2b(room[starts[k] : ends[k]], digest_size=8).digest(), "little"))
        going = np.flatnonzero((left > 0) & (left <= CHAINED))
        at, left = starts[going], left[going]
        while len(going):
            out[going] = mixed(out[going] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
            on = left > 8
            going, at, left = going[on], at[on] + 8, left[on] - 8
        return out


class ByteBpe:
    """One vocabulary: tokens as bytes by id, and for each pair of ids that merges its rank and the new id."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool):
        self.tokens, self.whole = tokens, whole
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        decimals = [b"%d," % i for i in range(len(tokens))]
        self.decimal_sizes = np.array([len(d) for d in decimals], np.int64)
        self.decimal_starts = np.cumsum(self.decimal_sizes) - self.decimal_sizes
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        single = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.of_byte = np.array([single[bytes([b])] for b in range(256)], np.int64)
        self.pairs = pairs
        self.ranks = HashTable(18)
        both = np.array(list(pairs), np.uint64).reshape(-1, 2)
        self.ranks.put(self._key(both[:, 0], both[:, 1]), np.array([r << 20 | new for r, new in pairs.values()], np.int64))
        self.hash = PieceHash()
        self.forget()

    @classmethod
    def from_ranks(cls, path: str) -> ByteBpe:
        """A file of base64 tokens and ranks: any two tokens merge that join to a token, by its rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        pairs = {(ranks[t[:k]], ranks[t[k:]]): (i, i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        return cls(tokens, pairs, whole=True)

    @classmethod
    def from_merges(cls, path: str) -> ByteBpe:
        """A tokenizer's JSON file with a byte-level vocabulary and an ordered list of merges."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        vocab = model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        return cls(tokens, pairs, whole=False)

    def forget(self) -> None:
        """An empty store of pieces."""
        self.seen = HashTable(16)
        self.store_ids, self.store_ends = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)
        self.store_bytes, self.store_byte_ends = np.zeros(1 << 18, np.uint8), np.zeros(1, np.int64)
        if self.whole:  # a piece that is a token stays whole, whatever its merges give
            ids = np.flatnonzero(self.sizes)
            self._keep(self.bytes, self.starts[ids], self.starts[ids] + self.sizes[ids], ids, np.ones(len(ids), np.int64))

    def _keep(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Pieces of distinct keys, their bytes and their ids, for the store."""
        self.seen.put(self._piece_keys(data, starts, ends), len(self.store_ends) - 1 + np.arange(len(starts)))
        self.store_ids, self.store_ends = _appended(self.store_ids, self.store_ends, ids, counts)
        self.store_bytes, self.store_byte_ends = _appended(self.store_bytes, self.store_byte_ends, ragged(data, starts, ends - starts), ends - starts)

    def _piece_keys(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.hash(data, starts, ends) | np.uint64(1)

    def _others(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The spans whose bytes aren't those of the stored piece that has their key."""
        sizes = ends - starts
        kept = self.store_byte_ends[at]
        other = self.store_byte_ends[at + 1] - kept != sizes
        like = np.flatnonzero(~other)
        differ = ragged(self.store_bytes, kept[like], sizes[like]) != ragged(data, starts[like], sizes[like])
        if differ.any():
            other[like[np.searchsorted(np.cumsum(sizes[like]), np.flatnonzero(differ), "right")]] = True
        return np.flatnonzero(other)

    def _encode_alone(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans without the store, and their numbers of ids."""
        ids, counts = self.encode_pieces(data, starts, ends)
        if not self.whole:
            return ids, counts
        number = {t: i for i, t in enumerate(self.tokens) if t}
        own = [number.get(data[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lists = [part if n is None else [n] for n, part in zip(own, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
        return np.concatenate(lists).astype(np.int32), np.array([len(x) for x in lists], np.int64)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and new id of pairs as one number, NONE for those that don't merge; ids under 0 are padding."""
        out = np.full(left.shape, NONE, np.int64)
        real = (left >= 0) & (right >= 0)
        out[real] = self.ranks.get(self._key(left[real], right[real]), NONE)
        return out

    def _merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row of a matrix of byte ids, padded with -1, merged; and the rows' numbers of tokens."""
        out = np.full(ids.shape, -1, np.int32)
        rows = np.arange(len(ids))
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            going = best != NONE
            if not going.all():
                out[rows[~going], : ids.shape[1]] = ids[~going]
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                if not len(rows):
                    break
                width = max(2, int((ids >= 0).sum(1).max()))
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
                line = np.arange(len(rows))
            # the new token replaces the pair's first, and what stands behind the pair closes up
            step = np.arange(ids.shape[1])
            take = np.minimum(step + (step > at[:, None]), ids.shape[1] - 1)
            ids[line, at] = best & 0xFFFFF
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], ranks.shape[1] - 1), 1)
            ranks[:, -1] = NONE
            behind = np.flatnonzero(at < ranks.shape[1])
            ranks[behind, at[behind]] = self._pair_ranks(ids[behind, at[behind]], ids[behind, at[behind] + 1])
            ahead = np.flatnonzero(at > 0)
            ranks[ahead, at[ahead] - 1] = self._pair_ranks(ids[ahead, at[ahead] - 1], ids[ahead, at[ahead]])
        return out, (out >= 0).sum(1)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = following[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.pairs[pair][1], -1
            following[i] = following[j]
            if following[j] < n:
                previous[following[j]] = i
            for a, b in ((previous[i], i), (i, following[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], a, p))
        return np.array([i for i in ids if i >= 0], np.int64)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of byte spans, joined in their order, and the spans' numbers of ids; spans of like length merge together."""
        sizes = ends - starts
        counts = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(sizes > LONGEST).tolist():
            ids = self._merge_long(data[starts[k] : ends[k]].tobytes())
            counts[k] = len(ids)
            done.append((np.array([k]), ids))
        width, least = 2, 0
        while least < LONGEST:
            bucket = np.flatnonzero((sizes > least) & (sizes <= width))
            for part in np.array_split(bucket, -(-len(bucket) * width // CELLS)) if len(bucket) else []:
                cells = starts[part][:, None] + np.arange(width)
                filled = cells < ends[part][:, None]
                rows, counts[part] = self._merge_rows(np.where(filled, self.of_byte[data[np.minimum(cells, len(data) - 1)]], -1))
                done.append((part, rows[rows >= 0]))
            least, width = width, min(LONGEST, width * 2 if width < 8 else width + 4 if width < 32 else width * 2)
        flat = np.zeros(int(counts.sum()), np.int32)
        place = np.cumsum(counts) - counts
        for part, ids in done:
            n = counts[part]
            flat[np.repeat(place[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, pattern: str = public_tokenizers.PATTERN) -> tuple[np.ndarray, np.ndarray]:
        """The ids of joined UTF-8 texts that start at `offsets`, and where each text's ids start."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        bounds = byte_bounds(data, offsets, "tiktoken" if self.whole else "tokenizers", pattern)
        starts, ends = bounds[:-1], bounds[1:]
        if self.seen.size > STORED or len(self.store_bytes) > 16 * STORED:
            self.forget()
        keys = self._piece_keys(data, starts, ends)
        at = self.seen.get(keys, -1)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            fresh = missing[first]
            self._keep(data, starts[fresh], ends[fresh], *self.encode_pieces(data, starts[fresh], ends[fresh]))
            at[missing] = self.seen.get(keys[missing], -1)
        begin = self.store_ends[at]
        counts = self.store_ends[at + 1] - begin
        store = self.store_ids
        if len(other := self._others(at, data, starts, ends)):
            more, counts[other] = self._encode_alone(data, starts[other], ends[other])
            begin[other] = len(store) + np.cumsum(counts[other]) - counts[other]
            store = np.concatenate([store, more])
        ids = ragged(store, begin, counts)
        before = np.append(0, np.cumsum(counts))
        return ids, before[np.searchsorted(bounds, offsets)]

    def encode(self, text: str, pattern: str = public_tokenizers.PATTERN) -> list[int]:
        """The ids of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_bytes(data, np.array([0, len(data)]), pattern)[0].tolist()

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, joined."""
        return ragged(self.bytes, self.starts[ids], self.sizes[ids])

    def decode(self, ids) -> bytes:
        """The bytes of one list of ids."""
        return self.decode_flat(np.asarray(ids, np.int64)).tobytes()


@cache
def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of a file, read once in a process."""
    return ByteBpe.from_merges(path) if path.endswith(".json") else ByteBpe.from_ranks(path)


def _place(path: str) -> str:
    return path if "/" in path else public_tokenizers.path(path)


def encode_texts(df: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `ids`, the token ids of every whole text; a null text is an empty one, with no ids."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_buffers(part.column(1))
        ids, ends = vocabulary(_place(vocabulary_file)).encode_bytes(data, offsets)
        return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["k", "ids"])

    return by_batch(id_and_text(df, key, text), make, "k long, ids array<int>").withColumnRenamed("k", key)


def decode_ids(df: DataFrame, vocabulary_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key` and `bytes`, the decoded bytes of every list of ids; a null list is an empty one."""

    def run(batches):
        for batch in batches:
            flat = batch.column(1).cast(pa.large_list(pa.int64()))
            flat = pa.array([x or [] for x in flat.to_pylist()], pa.large_list(pa.int64())) if flat.null_count else flat
            v = vocabulary(_place(vocabulary_file))
            values, ends = flat.flatten().to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            cuts = np.append(0, np.cumsum(v.sizes[values]))[ends - ends[0]].tolist()
            data = v.decode_flat(values).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["k", "bytes"])

    made = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{ids}`").cast("array<int>").alias("i"))
    return made.mapInArrow(run, "k long, bytes binary").withColumnRenamed("k", key)


def token_digests(df: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text encoded, and its ids decoded: number of tokens, digests of the ids and of the decoded bytes.

    One row per input row. A null text is an empty one: 0 tokens, digests of nothing. Very long pieces
    take the heap; repeated rows stay repeated; an empty table gives an empty result.
    """

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(_place(vocabulary_file))
        ids, ends = v.encode_bytes(*utf8_buffers(part.column(1)))
        shown = ragged(v.decimals, v.decimal_starts[ids], v.decimal_sizes[ids]).tobytes()
        decoded = v.decode_flat(ids).tobytes()
        shown_at = np.append(0, np.cumsum(v.decimal_sizes[ids]))[ends].tolist()
        bytes_at = np.append(0, np.cumsum(v.sizes[ids]))[ends].tolist()
        hexes = lambda raw, at, less: [hashlib.sha256(raw[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        cols = [part.column(0), pa.array(np.diff(ends)), pa.array(hexes(shown, shown_at, 1), pa.string()), pa.array(hexes(decoded, bytes_at, 0), pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(id_and_text(df, key, text), make, "k long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)
