import random
import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from hyperloom.operators import motifs, triangles


def _census(edges):
    """The census by looking at every three vertices."""
    shared: dict = {}
    for p in (p for e in edges for p in combinations(sorted(e), 2)):
        shared[p] = shared.get(p, 0) + 1
    found: dict = {}
    for three in combinations(sorted({v for e in edges for v in e}), 3):
        all3, by = sum(set(three) <= e for e in edges), [shared.get(p, 0) for p in combinations(three, 2)]
        if sum(x > 0 for x in by) >= 2:
            kind = (all3 > 0, sum(x > all3 for x in by))
            found[kind] = found.get(kind, 0) + 1
    return found


@pytest.mark.parametrize("held", [1 << 22, 16])
def test_census_of_copies_hubs_and_nothing(spark, monkeypatch, held):
    monkeypatch.setattr(triangles, "HELD", held)
    r = random.Random(held)
    some = [set(r.sample(range(0, 210, 7), r.randint(1, 9))) for _ in range(25)]
    hub = [{-5, 7 * i, 7 * i + 7} for i in range(40)]
    for edges in (some, some + some[:9] + [{1 << 40, 0, 7}], hub, [{1}, {2}], []):
        inc = spark.createDataFrame([(i, v) for i, e in enumerate(edges) for v in e], "e long, v long")
        assert {(x["whole"], x["pairs"]): x["n"] for x in motifs.census_of_three(inc).collect()} == _census(edges)


def test_census_shuffles_pairs_and_no_threes(spark):
    def written():
        return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    inc, before = spark.range(300).selectExpr("0L as e", "id as v"), written()
    assert [tuple(r) for r in motifs.census_of_three(inc).collect()] == [(True, 0, comb(300, 3))]
    assert written() - before < 200 * comb(300, 2)


def test_census_sends_nothing_that_grows_through_the_driver(spark):
    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        listed = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed)}

    before = set(plans())
    assert motifs.census_of_three(spark.range(60).selectExpr("id div 3 as e", "id % 25 as v")).collect()
    sent = [keys for i, plan in plans().items() if i not in before for keys in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\]]*)\]", plan)]
    assert sent and all(re.fullmatch(r"_part#\d+", keys) for keys in sent)  # running sums: a row for each range


def test_closed_paths_in_steps(monkeypatch):
    monkeypatch.setattr(triangles, "STEP", 4)
    left, right = [[1, 5, 9], [], [5, 9]], [[2, 6], [6], []]
    kind = pa.list_(pa.int32())
    shut = {(1, 2), (5, 6), (9, 2), (1, 9), (5, 9)}
    closing = triangles._Closing(np.array([a << 32 | b for a, b in shut]))
    got = closing.paths(pa.array([[7], *left], kind).slice(1), pa.array([[7], *right], kind).slice(1), False)
    assert got == sum((a, b) in shut for x, y in zip(left, right, strict=True) for a in x for b in y) == 3
    assert closing.paths(pa.array(left, kind), pa.array(right, kind), True) == sum(p in shut for x in left for p in combinations(x, 2)) == 3
