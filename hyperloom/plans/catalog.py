"""The catalogue of queries over the driver's tables, each operator applied to a whole hypergraph.

Hyperedges are orders and vertices are parts, unless a query says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import treelets
from hyperloom.operators import adaptive, counting, estimates, incidence, inclusion_exclusion, motifs, sampling, tables, threshold
from hyperloom.plans import build
from hyperloom.plans.oracle import SAMPLES, SECOND, SQL, T_SPLIT
from hyperloom.plans.storage import settled
from hyperloom.sources import labelled, text_formats
from hyperloom.streaming.windows import window_incidence

__all__ = ["QUERIES", "SQL", "entry"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__.strip("_")] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.incidence(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return incidence.split(basket(spark, sf_dir), T_SPLIT)


def _colors(spark: SparkSession, sf_dir: str, k: int = 3, **options) -> DataFrame:
    return counting.colored(build.vertices(basket(spark, sf_dir)), k, **options)


def _counts(spark: SparkSession, sf_dir: str, k: int = 3, **options) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The adjacency and the tables of sizes 1 to k."""
    adj = settled(incidence.gaifman(basket(spark, sf_dir)))
    return adj, counting.count_tables(adj, settled(_colors(spark, sf_dir, k)), k, **options)


def _total(table: DataFrame) -> int:
    return int(table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size-3 counts by structure."""
    return _counts(spark, sf_dir)[1][3].groupBy("s").agg(F.sum("n").alias("n"))


# hypergraphs and their projections


@query
def _incidence(spark, sf_dir):
    return basket(spark, sf_dir)


@query
def edge_sizes(spark, sf_dir):
    return incidence.edge_sizes(basket(spark, sf_dir))


@query
def vertex_degrees(spark, sf_dir):
    return incidence.vertex_degrees(basket(spark, sf_dir))


@query
def second_member(spark, sf_dir):
    return incidence.member(basket(spark, sf_dir), 1)


@query
def renumbered_edges(spark, sf_dir):
    return incidence.renumbered(basket(spark, sf_dir))


@query
def shared_edges(spark, sf_dir):
    return incidence.shared_edges(basket(spark, sf_dir))


@query
def gaifman(spark, sf_dir):
    return incidence.gaifman(basket(spark, sf_dir))


@query
def gaifman_max_edge_size(spark, sf_dir):
    return incidence.gaifman(basket(spark, sf_dir), max_edge_size=5)


@query
def gaifman_upper_bound(spark, sf_dir):
    return incidence.gaifman_bounds(basket(spark, sf_dir))


@query
def gaifman_exact_size(spark, sf_dir):
    return incidence.pair_set(basket(spark, sf_dir)).agg(F.count("*").alias("pairs"))


@query
def graph_degrees(spark, sf_dir):
    return incidence.gaifman(basket(spark, sf_dir)).groupBy(F.col("u").alias("v")).agg(F.count("*").alias("degree"))


@query
def has_incident(spark, sf_dir):
    inc = basket(spark, sf_dir)
    return incidence.incident(inc, inc.select("e", (F.col("v") + 1).alias("v")))


@query
def has_edge(spark, sf_dir):
    adj = incidence.gaifman(basket(spark, sf_dir))
    return incidence.adjacent(adj, build.vertices(basket(spark, sf_dir)).select(F.col("v").alias("u"), (F.col("v") + 1).alias("v")))


@query
def split_low(spark, sf_dir):
    return _sides(spark, sf_dir)[0]


@query
def split_high(spark, sf_dir):
    return _sides(spark, sf_dir)[1]


@query
def overlap_pairs(spark, sf_dir):
    return incidence.overlap_pairs(*_sides(spark, sf_dir))


@query
def exclude_pairs(spark, sf_dir):
    low, high = _sides(spark, sf_dir)
    return incidence.exclude_pairs(incidence.gaifman(low), incidence.overlap_pairs(low, high))


@query
def dedup_classes(spark, sf_dir):
    return incidence.dedup_classes(basket(spark, sf_dir))


@query
def dedup_edges(spark, sf_dir):
    inc = basket(spark, sf_dir)
    return incidence.dedup_edges(inc, incidence.dedup_classes(inc))


@query
def original_ids(spark, sf_dir):
    inc = basket(spark, sf_dir)
    vmap = build.vertices(inc).where("v % 2 = 0").select(F.col("v").alias("dense"), (F.col("v") + 1_000_000).alias("orig"))
    return incidence.original_ids(inc, vmap)


@query
def min_size_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return labelled.from_labels(rows, "o_custkey", "l_suppkey", 10)


@query
def label_numbers(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return labelled.numbered_labels(labelled.from_labels(rows, "o_custkey", "l_suppkey", 10), by_size=True)


@query
def hourly_hypergraph(spark, sf_dir):
    return window_incidence(_table(spark, sf_dir, "events"))


@query
def parse_text_hypergraph(spark, sf_dir):
    return text_formats.hyperedges_from_lines(_table(spark, sf_dir, "documents").where("text is not null"), "text", "doc_id")


@query
def dump_text_hypergraph(spark, sf_dir):
    return text_formats.hypergraph_lines(basket(spark, sf_dir))


@query
def graph_formats(spark, sf_dir):
    """The adjacency written in the form with degrees, and read back."""
    adj = settled(incidence.gaifman(basket(spark, sf_dir)))
    facts = adj.agg(F.max("u").alias("n"), F.count("*").alias("m")).first()
    lines = text_formats.graph_lines(adj).select(F.col("u").alias("line"), "value")
    return text_formats.graph_from_lines(lines, "degree", facts["n"] + 1, facts["m"] // 2)


# threshold


@query
def alpha_rank(spark, sf_dir):
    return threshold.ranks(basket(spark, sf_dir))


@query
def alpha_cost(spark, sf_dir):
    costs = threshold.costs(basket(spark, sf_dir))
    return costs.select("t", "beta", *(F.col(c).cast("string").alias(c) for c in ("ie", "naive", "total")))


@query
def best_alpha(spark, sf_dir):
    return threshold.best(basket(spark, sf_dir))


# colors and counts


@query
def coloring(spark, sf_dir):
    return _colors(spark, sf_dir, 4, seed=7)


@query
def coloring_biased(spark, sf_dir):
    return _colors(spark, sf_dir, 4, shares=treelets.biased_shares(4, 0.125))


@query
def c2(spark, sf_dir):
    return _counts(spark, sf_dir)[1][2]


@query
def c3(spark, sf_dir):
    return _counts(spark, sf_dir)[1][3]


@query
def c4(spark, sf_dir):
    return _counts(spark, sf_dir, 4)[1][4]


@query
def n1(spark, sf_dir):
    adj, made = _counts(spark, sf_dir, 1)
    return counting.neighbour_sums(adj, made[1])


@query
def n2(spark, sf_dir):
    adj, made = _counts(spark, sf_dir)
    return counting.neighbour_sums(adj, made[2])


@query
def store0_c3(spark, sf_dir):
    return _counts(spark, sf_dir, at_first_color=True)[1][3]


@query
def selector_include(spark, sf_dir):
    return _counts(spark, sf_dir, chosen=(treelets.closure({treelets.path(3)}, True), True))[1][3]


@query
def selector_exclude(spark, sf_dir):
    return _counts(spark, sf_dir, chosen=(treelets.closure({treelets.star(3)}, False), False))[1][3]


@query
def ie_level1(spark, sf_dir):
    high = settled(_sides(spark, sf_dir)[1])
    rows = inclusion_exclusion.contributions(inclusion_exclusion.first_level(high), counting.singles(_colors(spark, sf_dir)), 1)
    return rows.groupBy("v", "s", "c").agg(F.sum("n").alias("n")).where("n <> 0")


@query
def ie_total(spark, sf_dir):
    return inclusion_exclusion.neighbour_sums_by_sets(settled(_sides(spark, sf_dir)[1]), counting.singles(_colors(spark, sf_dir)))


@query
def fuse_low_high(spark, sf_dir):
    return build.from_split(basket(spark, sf_dir), 3, T_SPLIT)[3]


@query
def merged_shards(spark, sf_dir):
    made = settled(_counts(spark, sf_dir)[1][2])
    return tables.merged_shards(made.where("v % 2 = 0"), made.where("v % 2 = 1"))


# tables


@query
def treelet_totals(spark, sf_dir):
    return tables.totals(_counts(spark, sf_dir)[1][3])


@query
def table_stats(spark, sf_dir):
    stats = tables.statistics(_counts(spark, sf_dir)[1][3])
    return stats.select(*(F.col(c).cast("long").alias(c) for c in ("total", "max_vertex", "max_row", "n_rows")), "fits_64")


@query
def root_weights(spark, sf_dir):
    return tables.root_weights(_counts(spark, sf_dir)[1][3])


@query
def prefix_cdf(spark, sf_dir):
    return tables.distribution(_counts(spark, sf_dir)[1][3]).select("v", "s", "c", "lo", "hi")


@query
def prefix_by_vertex(spark, sf_dir):
    return tables.prefix(_counts(spark, sf_dir)[1][3]).select("v", "s", "c", "cum")


@query
def distinct_treelets(spark, sf_dir):
    return tables.distinct_treelets(_counts(spark, sf_dir)[1][3])


@query
def sizes_in_range(spark, sf_dir):
    made = _counts(spark, sf_dir)[1]
    return tables.of_sizes(made[1].unionByName(made[2]).unionByName(made[3]), 2, 2)


@query
def count_lookup(spark, sf_dir):
    made = _counts(spark, sf_dir)[1]
    keys = made[1].select("v", F.lit(treelets.path(3)).cast("long").alias("s"), F.lit(7).cast(made[3].schema["c"].dataType).alias("c"))
    return counting.looked_up(made[3], keys)


@query
def sums_at_vertices(spark, sf_dir):
    made = _counts(spark, sf_dir)[1]
    return counting.sums_at(made[3], made[1])


@query
def rescaled_estimates(spark, sf_dir):
    return estimates.rescaled(estimate_occurrences(spark, sf_dir), 0.5)


@query
def representative_totals(spark, sf_dir):
    return tables.representative_totals(_counts(spark, sf_dir, 4)[1][4], 4)


# sampling


def _drawn(spark: SparkSession, sf_dir: str, n: int = SAMPLES, b: int = sampling.B) -> tuple[DataFrame, dict[int, DataFrame], DataFrame, int]:
    """The adjacency, the tables, draws from the last one, and its total."""
    adj, made = _counts(spark, sf_dir)
    made[3] = settled(made[3])
    total = _total(made[3])
    return adj, made, settled(sampling.sampled_treelets(spark, tables.distribution(made[3]), n, total, b)), total


def _placed(spark: SparkSession, sf_dir: str, n: int = SAMPLES, b: int = sampling.B) -> tuple[DataFrame, DataFrame, int]:
    adj, made, drawn, total = _drawn(spark, sf_dir, n, b)
    return adj, settled(sampling.occurrences(drawn, adj, made, 3)), total


def _classes(spark: SparkSession, sf_dir: str, n: int = SAMPLES, b: int = sampling.B) -> tuple[DataFrame, int]:
    """The grouped table of sampled graphs of three vertices with spanning trees, and the total of trees over the colorful probability."""
    adj, placed, total = _placed(spark, sf_dir, n, b)
    bits = motifs.induced_bits(placed, adj, 3)
    names = placed.groupBy("sample").agg(F.array_join(F.sort_array(F.collect_list("v")).cast("array<string>"), " ").alias("vertices"))
    table = estimates.grouped(bits.join(names, "sample").withColumn("footprint", F.bit_count("bits")))
    table = table.withColumn("spanning_trees", F.when(F.col("footprint") == 3, 9).otherwise(3).cast("long"))
    return table, total / treelets.colorful_probability(3, 3)


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Estimates are halves of a total by hundreds of samples: with too few digits they lie on the edge between two roundings."""
    return df.withColumns({c: F.round(c, digits) for c in names})


@query
def root_sample(spark, sf_dir):
    drawn = _drawn(spark, sf_dir)[2]
    return drawn.select("sample", "v")


@query
def treelet_sample(spark, sf_dir):
    return _drawn(spark, sf_dir)[2]


@query
def rooted_occurrence(spark, sf_dir):
    return _placed(spark, sf_dir)[1]


@query
def rooted_occurrence_split(spark, sf_dir):
    """The same samples from small and large hyperedges apart: pairs of large ones are made at sampled vertices only."""
    inc = basket(spark, sf_dir)
    low, high = (settled(x) for x in _sides(spark, sf_dir))
    near = settled(incidence.gaifman(low))
    made = build.from_split(inc, 3, T_SPLIT)
    drawn = settled(sampling.sampled_treelets(spark, tables.distribution(made[3]), SAMPLES, _total(made[3])))
    return sampling.occurrences(drawn, lambda vertices: incidence.neighbours_of(vertices, near, high), made, 3)


@query
def side_masses(spark, sf_dir):
    """What neighbours over small hyperedges alone, and those over large ones, have of each color."""
    low, high = (settled(x) for x in _sides(spark, sf_dir))
    near, singles = incidence.exclude_pairs(incidence.gaifman(low), incidence.overlap_pairs(low, high)), settled(counting.singles(_colors(spark, sf_dir)))
    small = counting.neighbour_sums(near, singles).withColumnRenamed("n", "low")
    large = inclusion_exclusion.neighbour_sums_by_sets(high, singles).withColumnRenamed("n", "high")
    return small.join(large, ["v", "s", "c"], "full_outer").select("v", "s", "c", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("low", "high")))


@query
def tree_mode_bits(spark, sf_dir):
    return motifs.tree_bits(_drawn(spark, sf_dir)[2], 3)


@query
def selective_sample(spark, sf_dir):
    """Draws from the stars alone."""
    stars = settled(tables.selected(_counts(spark, sf_dir)[1][3], {treelets.star(3)}, True))
    return sampling.sampled_treelets(spark, tables.distribution(stars), SAMPLES, _total(stars))


@query
def traces(spark, sf_dir):
    placed = _placed(spark, sf_dir)[1]
    return motifs.traces(placed, basket(spark, sf_dir), 3).select("sample", F.array_join(F.col("traces").cast("array<string>"), ",").alias("traces"))


@query
def gaifman_bits(spark, sf_dir):
    found = motifs.traces(_placed(spark, sf_dir)[1], basket(spark, sf_dir), 3)
    return found.select("sample", motifs.gaifman_bits(F.col("traces"), 3).alias("bits"))


@query
def induced_bits(spark, sf_dir):
    adj, placed, _ = _placed(spark, sf_dir)
    return motifs.induced_bits(placed, adj, 3)


@query
def motif_class_k3(spark, sf_dir):
    found = motifs.traces(_placed(spark, sf_dir)[1], basket(spark, sf_dir), 3)
    return found.select(motifs.class_of_three(F.col("traces")).alias("class")).groupBy("class").agg(F.count("*").alias("samples"))


@query
def group_footprints(spark, sf_dir):
    return _classes(spark, sf_dir)[0].select("footprint", "samples", "vertices")


@query
def text_footprints(spark, sf_dir):
    adj, placed, _ = _placed(spark, sf_dir)
    return motifs.induced_bits(placed, adj, 3).select("sample", motifs.text_footprint(F.col("bits"), 3).alias("footprint"))


@query
def spanning_stars(spark, sf_dir):
    adj, placed, _ = _placed(spark, sf_dir)
    return motifs.induced_bits(placed, adj, 3).select("sample", motifs.spanning_stars(F.col("bits"), 3).alias("stars"))


@query
def spanning_trees_k3(spark, sf_dir):
    adj, placed, _ = _placed(spark, sf_dir)
    return motifs.induced_bits(placed, adj, 3).select("sample", motifs.spanning_trees_of_three(F.col("bits")).alias("spanning_trees"))


@query
def spanning_trees_kirchhoff(spark, sf_dir):
    adj, placed, _ = _placed(spark, sf_dir)
    return motifs.spanning_trees(motifs.induced_bits(placed, adj, 3), "bits", 3)


@query
def homomorphisms(spark, sf_dir):
    adj, placed, _ = _placed(spark, sf_dir)
    return motifs.homomorphisms(motifs.induced_bits(placed, adj, 3), treelets.path(3), "bits", 3)


@query
def estimate_occurrences(spark, sf_dir):
    table, total = _classes(spark, sf_dir)
    return _rounded(estimates.estimated(table, SAMPLES, total), "est_occurrences", digits=7).select("footprint", "samples", "est_occurrences")


@query
def estimate_frequencies(spark, sf_dir):
    table, total = _classes(spark, sf_dir)
    return _rounded(estimates.frequencies(estimates.estimated(table, SAMPLES, total)), "est_frequency").select("footprint", "est_frequency")


@query
def norm2(spark, sf_dir):
    return _rounded(estimates.norm2(_classes(spark, sf_dir)[0], SAMPLES), "norm2")


@query
def merge_tables(spark, sf_dir):
    (a, total), (b, _) = _classes(spark, sf_dir), _classes(spark, sf_dir, *SECOND)
    both = estimates.merged(estimates.estimated(a, SAMPLES, total), estimates.estimated(b, SECOND[0], total), SAMPLES, total, F.col("spanning_trees"), SECOND[0], total)
    return _rounded(both, "est_occurrences").select("footprint", "samples", "est_occurrences", "sampling_algo")


@query
def weighted_average(spark, sf_dir):
    (a, total), (b, _) = _classes(spark, sf_dir), _classes(spark, sf_dir, *SECOND)
    both = estimates.weighted_average(estimates.estimated(a, SAMPLES, total), estimates.estimated(b, SECOND[0], total), 0.75, 0.25)
    return _rounded(both, "est_occurrences", digits=7).select("footprint", "samples", "est_occurrences", "sampling_algo")


@query
def sample_output(spark, sf_dir):
    table, total = _classes(spark, sf_dir)
    made = estimates.frequencies(estimates.estimated(table, SAMPLES, total)).withColumn("sampling_algo", F.lit("H"))
    return estimates.output(made).select("hyper_motif", "samples", "sampling_algo", "spanning_trees", "vertices")


@query
def star_counts(spark, sf_dir):
    return sampling.star_weights(incidence.gaifman(basket(spark, sf_dir)), 3).withColumn("stars", F.col("stars").cast("long"))


@query
def star_sample(spark, sf_dir):
    adj = settled(incidence.gaifman(basket(spark, sf_dir)))
    weights = settled(sampling.star_weights(adj, 3).select("v", F.lit(0).cast("long").alias("s"), F.lit(0).alias("c"), F.col("stars").cast("long").alias("n")))
    return sampling.sampled_stars(spark, adj, tables.distribution(weights).select("v", "lo", "hi"), SAMPLES, 3, _total(weights))


@query
def exact_census_k3(spark, sf_dir):
    return motifs.census_of_three(basket(spark, sf_dir))


@query
def canonical_k4(spark, sf_dir):
    adj, made = _counts(spark, sf_dir, 4)
    made[4] = settled(made[4])
    drawn = settled(sampling.sampled_treelets(spark, tables.distribution(made[4]), SAMPLES, _total(made[4]), mixed=True))
    placed = settled(sampling.occurrences(drawn, adj, made, 4, mixed=True))
    found = motifs.canonical_traces(motifs.traces(placed, basket(spark, sf_dir), 4), "traces", 4)
    return found.groupBy("footprint").agg(F.count("*").alias("samples"))


@query
def adaptive_sample(spark, sf_dir):
    adj, made = _counts(spark, sf_dir)
    made[3] = settled(made[3])
    return adaptive.adaptive_sample(adj, made, 3, rounds=3, scale=1 / treelets.colorful_probability(3, 3))


# tree algebra


@query
def decompose_star(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in treelets.decompose_all(treelets.star(6), root=0)], "s long")


@query
def decompose_path(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in treelets.decompose_all(treelets.path(6), root=0)], "s long")


@query
def treelet_dimension(spark, sf_dir):
    return treelets.dimension(spark, 5).groupBy("k").agg(F.count("*").alias("trees"))
