"""Adaptive sampling: rounds that move to the tree which finds the least covered graphlets.

Only counts by class of graphlet and by tree reach the driver: both are few for a given size.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import graphlets, treelets
from hyperloom.operators import motifs, sampling, tables
from hyperloom.plans.storage import settled

#: Samples after which a class counts as covered, and samples of a round.
COVERED, ROUND = 1000, 1000


@dataclass
class State:
    """What the rounds have found."""

    counts: Counter = field(default_factory=Counter)
    weights: dict[int, float] = field(default_factory=dict)
    drawn: Counter = field(default_factory=Counter)


def trees_of(code: int, k: int) -> Counter:
    """Rooted spanning trees of a graphlet by their tree seen from the centre."""
    out: Counter = Counter()
    for s, n in graphlets.treelets_by_structure(code, k).items():
        out[treelets.canonical_rooting(s)] += n
    return out


def _next_tree(state: State, totals: dict[int, int], k: int) -> int:
    """The tree whose draws hit classes that are not covered with the greatest share of all it can hit."""
    share: dict[int, float] = {}
    for tree, total in totals.items():
        hits = {g: state.counts[g] / w * trees_of(g, k)[tree] / total for g, w in state.weights.items() if w}
        done = sum(x for g, x in hits.items() if state.counts[g] >= COVERED)
        share[tree] = (sum(hits.values()) - done + 1e-12) / (sum(hits.values()) + 1e-12)
    return max(share, key=lambda t: (share[t], t))


def adaptive_sample(adj: DataFrame, table: dict[int, DataFrame], k: int, rounds: int = 3, round_size: int = ROUND, scale: float = 1.0) -> DataFrame:
    """`footprint` (canonical graph), `samples` and `est_occurrences`, estimated from all rounds together.

    `scale` is what one colorful occurrence stands for: 1 over the colorful probability, times k if the table
    has the first color's roots only.
    """
    spark = adj.sparkSession
    top = table[k]
    dim = treelets.dimension(spark, k).where(F.col("k") == k).select("s", "repr")
    totals = {r["repr"]: int(r["n"]) for r in tables.representative_totals(top, k).collect()}
    state, seen = State(), 0
    tree = max(totals, key=lambda t: (totals[t], t), default=None)
    for turn in range(rounds if tree is not None else 0):
        part = top.join(F.broadcast(dim.where(F.col("repr") == tree).select("s")), "s", "left_semi")
        drawn = sampling.sampled_treelets(spark, tables.distribution(part), round_size, totals[tree], sampling.B + seen, mixed=True)
        placed = settled(sampling.occurrences(settled(drawn), adj, table, k, seed=turn, mixed=True))
        classes = motifs.canonical_graphs(motifs.induced_bits(placed, adj, k), "bits", k)
        found = Counter({r["footprint"]: r["count"] for r in classes.groupBy("footprint").count().collect()})
        covered = {g for g in state.counts if state.counts[g] >= COVERED}
        state.counts += found
        state.drawn[tree] += round_size
        seen += round_size
        state.weights = {g: sum(n * trees_of(g, k)[t] / totals[t] for t, n in state.drawn.items()) for g in state.counts}
        if {g for g in state.counts if state.counts[g] >= COVERED} - covered:
            tree = _next_tree(state, totals, k)
    rows = [(g, n, scale * n / state.weights[g] if state.weights[g] else 0.0) for g, n in sorted(state.counts.items())]
    return spark.createDataFrame(rows, "footprint long, samples long, est_occurrences double")
