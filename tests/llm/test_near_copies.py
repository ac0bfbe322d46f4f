import random

import numpy as np
import pyarrow as pa
import pytest

from hyperloom.llm import jaccard
from hyperloom.llm.shared import Tables
from tests.llm.helpers import components, shingle_set

SF = "/root/testdata/sf0.01"


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def families(seed, count, size, copies, most):
    """Families of copies with changes, some through copies of copies, and passages that all share."""
    rng, docs = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for _ in range(count):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(*size))] + passage
        last = base
        for _ in range(copies):
            last = changed(rng, last if rng.random() < 0.5 else base, rng.randint(0, most))
            docs.append(" ".join(last))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("words", "share"), [(4, (85, 100)), (5, (80, 100)), (1, (1, 2))])
def test_components_equal_all_pairs(spark, words, share):
    docs = families(1, 12, (5, 120), 14, 4) + [(1000 + i, t) for i, t in enumerate(["a b c", "A b  c", "a b c", "", None, " \n", "a b", "one", "ONE", "x " * 30, "x " * 31])]
    got = jaccard.similar_components(spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, n long"), words=words, share=share)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(docs, words, share)


def test_large_label_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "LARGE", 4)
    docs = families(2, 3, (40, 60), 60, 3)
    got = jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), words=4, share=(85, 100))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(docs, 4, (85, 100))


def test_linked_sets_share_a_token():
    rng = random.Random(3)
    for share in ((85, 100), (80, 100), (1, 2)):
        parts = jaccard.Parts(share)
        for _ in range(400):
            n = rng.randint(1, 300)
            a = set(rng.sample(range(10**9), n))
            b = set(a)
            while True:  # as far from a as the link allows
                c = set(b)
                if c and rng.random() < 0.5:
                    c.discard(rng.choice(sorted(c)))
                else:
                    c.add(rng.randrange(10**9))
                if len(a & c) * share[1] < share[0] * len(a | c):
                    break
                b = c
            if a == b:
                continue
            flat = np.concatenate([np.sort(np.array(sorted(x), np.uint64)) for x in (a, b)])
            tokens, sets = parts.tokens(flat, np.array([0, len(a), len(a) + len(b)]))
            assert set(tokens[sets == 0].tolist()) & set(tokens[sets == 1].tolist())


def test_shingles_are_sets_of_word_runs():
    texts = ["A b c d e", "a B c d e", "x", "", "a b c d e f", "a b c d a b c d"]
    raw = [t.encode() for t in texts]
    flat, ends = jaccard.shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 4)
    assert np.diff(ends).tolist() == [len(shingle_set(t, 4)) for t in texts]
    assert (flat[ends[0] : ends[1]] == flat[ends[1] : ends[2]]).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 201), (300, 300), (201, 202)]
    got = {r["node"]: r["label"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()}
    assert got == {i: 0 for i in range(91)} | {200: 200, 201: 200, 202: 200}
    assert jaccard.components(spark.createDataFrame([], "a long, b long"), Tables(spark)).count() == 0


def test_edges(spark):
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (7, "q " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar_components(df).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, None), (None, None), (7, 7)], key=repr)
    assert sorted(r["doc_id"] or -1 for r in jaccard.one_of_each(df).collect()) == [-1, -1, 3, 3, 7]
    assert jaccard.similar_components(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs).collect()}
    assert got == components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 5, (80, 100))


@pytest.mark.parametrize("share", [(85, 100), (80, 100), (1, 2)])
def test_sketches_lose_no_link(share):
    rng, sets = random.Random(4), []
    for _ in range(150):
        n = rng.choice([1, 5, 50, 64, 65, 300, 2000])
        base = rng.sample(range(10**12), n)
        sets += [set(base), set(base[: max(1, int(n * rng.uniform(0.5, 1)))]) | set(rng.sample(range(10**12), int(n * rng.uniform(0, 0.2))))]
    ends = np.append(0, np.cumsum([len(x) for x in sets]))
    data, at = jaccard.parities(np.concatenate([np.sort(np.array(list(x), np.uint64)) for x in sets]), ends)
    column = pa.array([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    sizes, labels = np.diff(ends), np.arange(len(sets))
    got = jaccard.may_link((sizes, sizes), (labels, labels), (column, column), share)
    true = np.array([[a is not b and len(a & b) * share[1] >= share[0] * len(a | b) for b in sets] for a in sets])
    assert true.sum() > 20 and not (true & ~got).any()
    assert share == (1, 2) or got.sum() < true.sum() * 2  # sketches of sets that may differ by two thirds tell little
    assert not jaccard.may_link((sizes, sizes), (labels * 0, labels * 0), (column, column), share).any()


def test_one_of_each_keeps_all_columns(spark):
    df = spark.createDataFrame([(2, "a b c", [1], "x"), (1, "A b c", None, "y"), (None, "a b c", [], None), (3, None, [2], "z")], "doc_id int, text string, k array<int>, _gone string")
    got = jaccard.one_of_each(df)
    assert got.schema == df.schema
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, "A b c", None, "y"), (None, "a b c", [], None), (3, None, [2], "z")], key=repr)
