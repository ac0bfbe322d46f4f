import random
from itertools import combinations, permutations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from hyperloom.functions import graphlets, treelets


def test_numbers_of_rooted_trees():
    assert [len(treelets.trees(k)) for k in range(1, 9)] == [1, 1, 2, 4, 9, 20, 48, 115]


def test_each_tree_splits_in_one_way_and_merges_back():
    for k in range(2, 8):
        for s in treelets.trees(k):
            assert treelets.merge(treelets.complement(s), treelets.split_child(s)) == s
            assert treelets.valid(s) and treelets.size(s) == k


def test_known_trees():
    assert treelets.star(3) == 2684354560 and treelets.path(3) == 3221225472
    assert treelets.star(4) == 2818572288 and treelets.path(4) == 3758096384
    two_legs = treelets.merge(treelets.path(3), treelets.path(2))
    three_legs = treelets.merge(two_legs, treelets.path(2))
    assert (two_legs, three_legs) == (3422552064, 3435134976)
    assert [treelets.normalization(s) for s in (0, treelets.path(2), treelets.star(3), two_legs, three_legs)] == [1, 1, 2, 2, 3]
    assert treelets.complement(three_legs) == two_legs and treelets.split_child(three_legs) == treelets.path(2)


def test_merges_that_fail():
    edge = (treelets.path(2), 3)
    assert treelets.merge_colored((0, 1), (0, 1)) == "colors"
    assert treelets.merge_colored((3422552064, 31), (0, 32)) == "order"
    assert treelets.merge_colored((0, 1), (0, 2)) == edge


def test_same_tree_from_every_root():
    for s in treelets.trees(7):
        pairs = treelets.edges(s)
        assert len({treelets.canonical_rooting(treelets.rooted(pairs, r)) for r in range(7)}) == 1


@given(st.integers(0, 2**32 - 1))
def test_leftmost_tie(x):
    bits = f"{x:032b}"
    assert treelets.leftmost_bit_tie(x) == next((i for i in range(1, 33) if 2 * bits[:i].count("1") == i), None)


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 0)], [(0, 2)], [(0, 1), (2, 3)], [(0, 1), (1, 2), (2, 0)]])
def test_what_is_no_tree(pairs):
    with pytest.raises(ValueError):
        treelets.from_edges(pairs)


def test_selections():
    assert treelets.closure({treelets.path(3)}, True) == {treelets.path(3), treelets.path(2)}
    assert treelets.closure({treelets.path(3), treelets.path(2)}, False) == {treelets.path(3)}


def test_probabilities():
    assert treelets.colorful_probability(3, 3) == pytest.approx(2 / 9)
    assert treelets.colorful_probability_of([1 / 3] * 3, 3) == pytest.approx(2 / 9)
    assert treelets.colorful_probability(4, 3) == 0
    assert sum(treelets.biased_shares(5, 0.1)) == pytest.approx(1) and sum(treelets.bimodal_shares(5, 2, 0.7)) == pytest.approx(1)


def test_spanning_trees_of_known_graphs():
    for n in range(2, 8):
        assert graphlets.rooted_spanning_trees(graphlets.clique(n), n) == n * n ** (n - 2)
        assert graphlets.rooted_spanning_trees(graphlets.star_graph(n), n) == n
    diamond, paw = graphlets.code_of([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)], 4), graphlets.code_of([(0, 1), (1, 2), (2, 0), (0, 3)], 4)
    assert (graphlets.rooted_spanning_trees(diamond, 4), graphlets.rooted_spanning_trees(paw, 4)) == (32, 12)


def test_two_counts_of_spanning_trees_agree():
    rng = random.Random(1)
    for k in (3, 4, 5):
        for _ in range(20):
            code = rng.getrandbits(graphlets.pair_count(k))
            whole = graphlets.rooted_spanning_trees(code, k)
            assert sum(graphlets.treelets_by_structure(code, k).values()) == whole
            stars = {treelets.star(k), treelets.star(k, leaf=True)}
            assert graphlets.spanning_trees_selected(code, k, stars, include=False) == whole - graphlets.rooted_spanning_stars(code, k) or k == 3


def test_canonical_forms_do_not_depend_on_numbers():
    rng = random.Random(2)
    for _ in range(30):
        order = rng.sample(range(4), 4)
        code = rng.getrandbits(6)
        moved = graphlets.code_of([(order[a], order[b]) for a, b in graphlets.edges_of(code, 4)], 4)
        assert graphlets.canonical_graph(code, 4) == graphlets.canonical_graph(moved, 4)


def test_canonical_forms_are_the_greatest_of_all_numberings():
    rng = random.Random(3)
    for k in (1, 2, 3, 4, 5):
        orders = list(permutations(range(k)))
        for _ in range(40):
            code = rng.getrandbits(graphlets.pair_count(k))
            pairs = graphlets.edges_of(code, k)
            assert graphlets.canonical_graph(code, k) == max(graphlets.code_of([(o[a], o[b]) for a, b in pairs], k) for o in orders)
            traces = tuple(sorted({rng.randrange(1, 1 << k) for _ in range(rng.randrange(2 * k))}))
            moved = (tuple(sorted((sum(1 << (k - 1 - o[v]) for v in range(k) if t >> (k - 1 - v) & 1) for t in traces), reverse=True)) for o in orders)
            assert graphlets.canonical_traces(traces, k) == max(moved)


@pytest.mark.parametrize("k", [10, 12, 16])
def test_canonical_forms_of_many_vertices(k):
    rng = random.Random(k)
    circle = [(i, (i + 1) % k) for i in range(k)]
    for pairs in (circle, list(combinations(range(k), 2)), [(0, i) for i in range(1, k)], [p for p in combinations(range(k), 2) if rng.random() < 0.4]):
        order = rng.sample(range(k), k)
        moved = [(order[a], order[b]) for a, b in pairs]
        assert graphlets.canonical_graph(graphlets.code_of(pairs, k), k) == graphlets.canonical_graph(graphlets.code_of(moved, k), k)


def test_canonical_traces_of_eight_vertices():
    rng = random.Random(8)
    for n in (3, 6, 12, 28):
        traces = rng.sample(range(3, 256), n)
        order = rng.sample(range(8), 8)
        moved = [sum(1 << (7 - order[v]) for v in range(8) if t >> (7 - v) & 1) for t in traces]
        assert graphlets.canonical_traces(tuple(sorted(traces)), 8) == graphlets.canonical_traces(tuple(sorted(moved)), 8)


def test_homomorphisms_equal_all_numberings():
    rng = random.Random(4)
    for k in (2, 3, 4, 5):
        for s in treelets.trees(k):
            code = rng.getrandbits(graphlets.pair_count(k))
            near = {p for a, b in graphlets.edges_of(code, k) for p in ((a, b), (b, a))}
            assert graphlets.homomorphisms(s, code, k) == sum(all((o[a], o[b]) in near for a, b in treelets.edges(s)) for o in permutations(range(k)))


def test_texts_round_trip():
    for code in (0, 1, 37, 63):
        assert graphlets.code_of_footprint(graphlets.text_footprint(code, 4), 4) == code
    assert graphlets.unpacked_incidence(graphlets.packed_incidence([6, 5], 3)) == (3, [6, 5])
    assert len(graphlets.signature(graphlets.matrix_of(7, 3))) == 30


def test_homomorphisms():
    assert graphlets.homomorphisms(treelets.path(4), graphlets.clique(4), 4) == 24
    assert graphlets.homomorphisms(treelets.star(4), graphlets.star_graph(4), 4) == 6
    with pytest.raises(ValueError):
        graphlets.homomorphisms(treelets.path(3), graphlets.clique(4), 4)
