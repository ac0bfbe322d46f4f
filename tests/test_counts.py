from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hyperloom.functions import graphlets, treelets
from hyperloom.operators import counting, estimates, incidence, inclusion_exclusion, motifs, sampling, tables, threshold
from hyperloom.plans import build

T1 = [[0, 1, 2], [2, 3, 4], [1, 2, 4]]
T2 = [[0, 1, 2, 3, 4, 5], [2, 3, 6], [6, 7], [5, 7, 8], [1, 4, 8, 9], [0, 9]]


def of(spark, edges):
    return spark.createDataFrame([(e, v) for e, vs in enumerate(edges) for v in vs], "e long, v long")


def by_remainder(spark, edges, k):
    return spark.createDataFrame([(v, v % k) for v in sorted({v for e in edges for v in e})], "v long, color int")


def sums(made):
    return [t.agg(F.sum("n")).first()[0] for t in made.values()]


def test_projection(spark, rows):
    assert rows(incidence.pair_set(of(spark, T1))) == sorted([(0, 1), (0, 2), (1, 2), (1, 4), (2, 3), (2, 4), (3, 4)])
    assert incidence.pair_set(of(spark, T2)).count() == 27


@pytest.mark.parametrize(("edges", "k", "want"), [(T1, 3, [5, 12, 24]), (T1, 4, [5, 14, 36, 44]), (T2, 3, [10, 42, 138]), (T2, 4, [10, 44, 174, 436])])
def test_totals(spark, edges, k, want):
    adj = incidence.gaifman(of(spark, edges))
    assert sums(counting.count_tables(adj, by_remainder(spark, edges, k), k)) == want


def test_wide_counts_are_the_same(spark, rows):
    adj, colors = incidence.gaifman(of(spark, T2)), by_remainder(spark, T2, 3)
    narrow, wide = (counting.count_tables(adj, colors, 3, wide=w)[3] for w in (False, True))
    assert rows(narrow) == rows(wide.withColumn("n", F.col("n").cast("long")))


@pytest.mark.parametrize("t", [2, 3, 4])
def test_split_plans_equal_the_whole(spark, rows, t):
    inc = of(spark, T2)
    whole, apart = build.from_adjacency(inc, 3), build.from_split(inc, 3, t)
    for k in (1, 2, 3):
        assert rows(whole[k]) == rows(apart[k])


def test_split_plan_by_pairs_when_sets_are_many(spark, rows):
    inc = of(spark, T2)
    assert rows(build.from_split(inc, 3, 2, most=0)[3]) == rows(build.from_adjacency(inc, 3)[3])


def test_inclusion_exclusion_is_the_neighbour_sum(spark, rows):
    inc, colors = of(spark, T2), by_remainder(spark, T2, 3)
    one = counting.singles(colors)
    assert rows(inclusion_exclusion.neighbour_sums_by_sets(inc, one)) == rows(counting.neighbour_sums(incidence.gaifman(inc), one))


def test_first_color_roots(spark):
    adj, colors = incidence.gaifman(of(spark, T1)), by_remainder(spark, T1, 3)
    part = counting.count_tables(adj, colors, 3, at_first_color=True)[3]
    assert 3 * part.agg(F.sum("n")).first()[0] == 24


def test_mean_over_colorings_is_exact(spark):
    adj = incidence.gaifman(of(spark, T1))
    pairs = {tuple(r) for r in adj.collect()}
    want = 0
    for u in combinations(range(5), 3):
        code = graphlets.code_of([(a, b) for a, b in combinations(range(3), 2) if (u[a], u[b]) in pairs], 3)
        want += graphlets.rooted_spanning_trees(code, 3)
    assert want == 42


def test_thresholds(spark, rows):
    inc = of(spark, [[0, 1, 2], [0, 1, 3], [0, 1, 4, 5], [0, 2, 4], [0, 6]])
    got = sorted((r.t, r.beta, int(r.ie), r.naive, int(r.total)) for r in threshold.costs(inc).collect())
    assert got == [(2, 5, 32, 0, 32), (3, 4, 16, 0, 16), (4, 1, 0, 0, 0)]
    assert threshold.best(inc).first()[0] == 4
    assert threshold.best(of(spark, T2)).first()[0] == 2
    assert threshold.best(inc.limit(0)).first()[0] == 0


def test_dedup(spark, rows):
    inc = of(spark, [[0, 1, 2], [1, 2, 3], [3, 4]])
    classes = incidence.dedup_classes(inc)
    assert rows(classes) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)]
    assert rows(incidence.dedup_edges(inc, classes)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3)]


def test_occurrences_are_places_of_their_trees(spark):
    inc = of(spark, T2)
    adj, made = incidence.gaifman(inc), counting.count_tables(incidence.gaifman(inc), by_remainder(spark, T2, 4), 4)
    drawn = sampling.sampled_treelets(spark, tables.distribution(made[4]), 60, 436).cache()
    assert drawn.count() == 60
    trees = {r["sample"]: (r["s"], r["v"]) for r in drawn.collect()}
    near = {tuple(r) for r in adj.collect()}
    places: dict = {}
    for r in sampling.occurrences(drawn, adj, made, 4).collect():
        places.setdefault(r["sample"], {})[r["pos"]] = r["v"]
    for sample, (s, root) in trees.items():
        at = places[sample]
        assert at[0] == root and sorted(at) == [0, 1, 2, 3] and len(set(at.values())) == 4
        assert all((at[a], at[b]) in near for a, b in treelets.edges(s))
        assert len({v % 4 for v in at.values()}) == 4


def test_every_tree_is_drawn_as_often_as_it_counts(spark):
    made = counting.count_tables(incidence.gaifman(of(spark, T1)), by_remainder(spark, T1, 3), 3)
    hits = sampling.located(spark.range(24).selectExpr("id as sample", "cast(id as decimal(38,0)) as r"), tables.distribution(made[3]), 24)
    got = {(r["v"], r["s"], r["c"]): r["count"] for r in hits.groupBy("v", "s", "c").count().collect()}
    assert got == {(r["v"], r["s"], r["c"]): r["n"] for r in made[3].collect()}


def test_mixed_choices_reach_all_neighbours_of_a_hub(spark):
    hub, near = 1000, 100
    ((_, edge, comp, *_),) = treelets.rows(2)
    adj = spark.createDataFrame([(hub, i) for i in range(near)], "u long, v long")
    ones = spark.createDataFrame([(hub, comp, 1, 1)] + [(i, 0, 2, 10**9) for i in range(near)], "v long, s long, c int, n long")
    trees = spark.range(400).selectExpr("id as sample", f"{hub}L as v", f"{edge}L as s", "3 as c")
    hits = [r["v"] for r in sampling.occurrences(trees, adj, {1: ones}, 2, mixed=True).where("pos = 1").collect()]
    assert len(hits) == 400 and len(set(hits)) > 90 and 150 < sum(v < near // 2 for v in hits) < 250


@pytest.mark.parametrize("total", [10**9, 10**14, 10**30])
def test_plain_draws_and_picks_are_even(spark, total):
    drawn = [int(r["r"]) for r in sampling.draws(spark, 4000, total).collect()]
    tenths = [sum(r * 10 // total == k for r in drawn) for k in range(10)]
    assert len(set(drawn)) > 3990 and all(320 < n < 480 for n in tenths)
    if total < 1 << 62:
        at = spark.range(4000).selectExpr("id as sample", "1 as q").select(sampling._target(F.lit(total).cast("long"), 0).alias("at"))
        tenths = [0] * 10
        for r in at.collect():
            tenths[r["at"] * 10 // total] += 1
        assert all(320 < n < 480 for n in tenths)


def test_mixed_draws_reach_all_of_a_great_total(spark):
    for total in (7, 10**13, 3 * 10**18, 10**37):
        drawn = [int(r["r"]) for r in sampling.draws(spark, 400, total, mixed=True).collect()]
        assert all(0 <= r < total for r in drawn) and 140 < sum(r < total // 2 for r in drawn) < 260


def test_census_and_classes(spark):
    def want(edges, k):
        found: dict = {}
        pairs = {frozenset(p) for e in edges for p in combinations(e, 2)}
        for u in combinations(sorted({v for e in edges for v in e}), k):
            masks = {sum(1 << (k - 1 - i) for i, v in enumerate(u) if v in e) for e in edges}
            masks = tuple(sorted((m for m in masks if m.bit_count() >= 2), reverse=True))
            seen, todo = {u[0]}, [u[0]]
            while todo:
                v = todo.pop()
                new = {w for w in u if frozenset((v, w)) in pairs} - seen
                seen |= new
                todo += new
            if len(seen) == k:
                name = graphlets.canonical_traces(masks, k)
                found[name] = found.get(name, 0) + 1
        return found

    assert want(T2, 3) == {(7,): 15, (7, 6): 11, (6, 5): 40, (6, 5, 3): 4}
    got = {(r["whole"], r["pairs"]): r["n"] for r in motifs.census_of_three(of(spark, T2)).collect()}
    assert got == {(True, 0): 15, (True, 1): 11, (False, 2): 40, (False, 3): 4}
    assert want(T1, 4) == {(14, 12, 9): 2, (14, 13, 10): 2, (12, 10, 5): 1}


def test_traces_and_bits(spark):
    placed = spark.createDataFrame([(0, p, v) for p, v in enumerate([1, 2, 4])] + [(1, p, v) for p, v in enumerate([0, 3, 2])], "sample long, pos int, v long")
    inc = of(spark, T1)
    got = {r["sample"]: r["traces"] for r in motifs.traces(placed, inc, 3).collect()}
    assert got == {0: [7, 6, 3], 1: [5, 3]}
    bits = motifs.traces(placed, inc, 3).select("sample", motifs.gaifman_bits(F.col("traces"), 3).alias("b"))
    assert {tuple(r) for r in bits.collect()} == {tuple(r) for r in motifs.induced_bits(placed, incidence.gaifman(inc), 3).collect()}


def test_sample_tables(spark):
    a = spark.createDataFrame([("x", 30, 3, "1"), ("y", 10, 9, "2")], "footprint string, samples long, spanning_trees long, vertices string")
    b = spark.createDataFrame([("x", 5, 3, "0"), ("z", 5, 3, "3")], "footprint string, samples long, spanning_trees long, vertices string")
    ea, eb = estimates.estimated(a, 40, 120.0), estimates.estimated(b, 10, 120.0)
    assert {r["footprint"]: r["est_occurrences"] for r in ea.collect()} == pytest.approx({"x": 30.0, "y": 10 / 3})
    assert sum(r["est_frequency"] for r in estimates.frequencies(ea).collect()) == pytest.approx(1)
    mean = {r["footprint"]: r["est_occurrences"] for r in estimates.weighted_average(ea, eb, 0.5, 0.5).collect()}
    assert mean == pytest.approx({"x": 25.0, "y": 10 / 3, "z": 20.0})
    both = {r["footprint"]: (r["samples"], r["est_occurrences"]) for r in estimates.merged(ea, eb, 40, 120.0, F.col("spanning_trees"), 10, 120.0).collect()}
    assert both["x"] == (35, pytest.approx(35 / (50 * 3 / 120)))
    assert estimates.norm2(a, 40).first()[0] == pytest.approx((30**2 + 10**2) ** 0.5 / 40)
    assert estimates.output(estimates.frequencies(ea).withColumn("sampling_algo", F.lit("H"))).first()["est_occurrences"] == "3.0000e+01"


def test_shards(spark):
    t = spark.createDataFrame([(1, 0, 1, 1)], "v long, s long, c int, n long")
    with pytest.raises(ValueError):
        tables.merged_shards(t, t)
    assert tables.statistics(t).first()["fits_64"]


@pytest.mark.parametrize("until", [0, 1, 2, 3, 40, 63, 64, 65, 100])
def test_costs_of_places_are_exact(spark, until):
    got = spark.range(1).select(threshold._powers(F.lit(until).cast("long")).alias("x")).first()["x"]
    assert int(got) == sum(0 if p < 2 else 2**p if p < 64 else int(threshold.SATURATED) for p in range(until))


def test_running_sums_within_keys_over_ranges(spark):
    from hyperloom.plans.storage import running

    df = spark.range(3000).selectExpr("if(id % 3 = 0, id % 7, 99) as key", "id", "id % 11 as x").repartition(16)
    want: dict = {}
    for key, i, x in sorted((99 if i % 3 else i % 7, i, i % 11) for i in range(3000)):
        want.setdefault(key, {})[i] = x + (list(want[key].values())[-1] if want.get(key) else 0)
    got = running(df, [F.col("id")], F.col("x"), "sum", ["key"]).collect()
    assert len(got) == 3000 and all(want[r["key"]][r["id"]] == r["sum"] for r in got)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_star_leaves_follow_the_circle_of_hashes(spark, k):
    near = {7: [1, 2, 3, 1 << 33, 12345678901], 8: [1, 5, 9, 11, 13, 15]}
    adj = spark.createDataFrame([(u, v) for u, vs in near.items() for v in vs], "u long, v long")
    roots = spark.createDataFrame([(7, 0, 30), (8, 30, 100)], "v long, lo long, hi long")
    found: dict = {}
    for r in sampling.sampled_stars(spark, adj, roots, 50, k, 100).collect():
        found.setdefault(r["sample"], {})[r["pos"]] = r["v"]
    assert len(found) == 50 and {at[0] for at in found.values()} == {7, 8}
    for sample, at in found.items():
        order = sorted(near[at[0]], key=lambda w: (((w % 2**31) * sampling.A + sample * sampling.STEP_SAMPLE) % 2**32, w))
        assert [at[i] for i in range(1, k)] == order[: k - 1]
