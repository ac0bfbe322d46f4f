import base64
import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hyperloom.llm import bpe, packing
from hyperloom.llm.pretokens import pieces

SCRAPS = ["'", "'s", "'re", "s", "the", " ", "  ", "\n", "\t", "\xa0", "a", "é", "1", "²", "!", "%", "日", "\x1c", " ", "😀", "ing", "<|endoftext|>", "ZZ", "\U0010ffff"]
texts = st.lists(st.sampled_from(SCRAPS), max_size=20).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def multi():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def fifty():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(texts)
def test_both_vocabularies_equal_their_libraries(multi, fifty, text):
    text = text.encode("utf-8", "ignore").decode()
    v, w = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken")), bpe.vocabulary(P.path("byte_bpe_50k.json"))
    assert v.encode(text) == multi.encode_ordinary(text)
    assert w.encode(text) == fifty.encode(text, add_special_tokens=False).ids
    assert v.decode(v.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([s for s in SCRAPS if s != "\U0010ffff"]), max_size=12).map("".join))
def test_pieces_equal_the_pattern(text):
    assert pieces(text) == regex.findall(P.PATTERN, text)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 900, "!?" * 700, "日本" * 300, "x" * 257, "a" * 256])
def test_long_pieces(multi, text):
    assert bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken")).encode(text) == multi.encode_ordinary(text)


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_collide_in_polynomial_hashes(multi, fifty, n):
    text = f"{thue_morse(n, 'a', 'b')} {thue_morse(n, 'b', 'a')} {thue_morse(n, 'a', 'b')}"
    v, w = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken")), bpe.vocabulary(P.path("byte_bpe_50k.json"))
    assert v.encode(text) == multi.encode_ordinary(text)
    assert w.encode(text) == fifty.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"])
def test_pieces_of_one_key_keep_their_own_ids(multi, fifty, monkeypatch, file):
    import numpy as np

    v = bpe.ByteBpe.from_ranks(P.path(file)) if file.endswith("tiktoken") else bpe.ByteBpe.from_merges(P.path(file))
    monkeypatch.setattr(v, "hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(1))
    v.seen, v.store_ends, v.store_byte_ends = bpe.HashTable(16), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for text in ("the cat sat on the mat and ate hat", "was it not an old ant", "the " + "x" * 300 + " " + "y" * 300):
        assert v.encode(text) == (multi.encode_ordinary(text) if v.whole else fifty.encode(text, add_special_tokens=False).ids)


def test_heap_and_matrix_merge_alike():
    v, rng = bpe.vocabulary(P.path("byte_bpe_50k.json")), random.Random(1)
    for _ in range(50):
        piece = bytes(rng.choice(b"aehinrst ") for _ in range(rng.randint(1, 40)))
        import numpy as np

        ids, counts = v.encode_pieces(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))
        assert ids.tolist() == v._merge_long(piece).tolist() and counts.tolist() == [len(ids)]


DOCS = [(1, "Hello world's end"), (2, None), (3, ""), (4, "日本 " * 2000), (1, "Hello world's end"), (None, " \n x")]


def test_digests(spark, multi):
    df = spark.createDataFrame([(k, t, 0) for k, t in DOCS], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.token_digests(df, "byte_bpe_multi_50k.tiktoken").collect()), key=repr)
    want = []
    for k, t in DOCS:
        ids = multi.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.token_digests(df.limit(0), "byte_bpe_multi_50k.tiktoken").count() == 0
    ids = bpe.encode_texts(df, "byte_bpe_50k.json")
    assert sorted((r[0], bytes(r[1]).decode()) for r in bpe.decode_ids(ids.where("doc_id is not null"), "byte_bpe_50k.json").collect()) == sorted((k, t or "") for k, t in DOCS if k)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r, i) for i, r in enumerate(rooms) if r >= n)[1] if any(r >= n for r in rooms) else None
        if fit is None:
            rooms.append(capacity)
            fit = len(rooms) - 1
        rooms[fit] -= n
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    import numpy as np

    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_decreasing(counts, 20)
    used: dict = {}
    for n, c in counts.items():
        sequence, offset = plan.lookup(np.full(c, n), np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used.setdefault(s, []).append((o, n))
    for parts in used.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
    assert sorted(20 - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, 20)
    assert plan.sequences == len(used)


def test_tree_finds_the_tightest():
    tree, rng, open_ = packing.CapacityTree(50), random.Random(3), set()
    for _ in range(500):
        room = rng.randint(0, 50)
        on = rng.random() < 0.5
        tree.mark(room, on)
        (open_.add if on else open_.discard)(room)
        need = rng.randint(1, 50)
        assert tree.tightest(need) == min((r for r in open_ if r >= need), default=None)


def test_packing(spark, fifty):
    df = spark.createDataFrame([(k, t, 9) for k, t in DOCS], "doc_id long, text string, piece int")
    rows = packing.pack_documents(df).collect()
    assert len([r for r in rows if r["doc_id"] == 1]) == 2
    long = sorted((r for r in rows if r["doc_id"] == 4), key=lambda r: r["piece"])
    ids = [*fifty.encode(DOCS[3][1], add_special_tokens=False).ids, 2]
    assert [r["length"] for r in long] == [len(ids) % 1024 or 1024] + [1024] * (len(long) - 1)
    for r in long:
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    assert sum(r["length"] for r in long) == len(ids)
    assert all(r["length"] == 1 for r in rows if r["doc_id"] in (2, 3))
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 1024
    assert packing.pack_documents(df.limit(0)).count() == 0
