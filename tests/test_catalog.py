import decimal

import duckdb
import pytest

from hyperloom.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ["incidence", "gaifman", "exclude_pairs", "dedup_edges", "alpha_cost", "best_alpha", "coloring_biased", "c3", "store0_c3", "selector_exclude", "ie_level1", "prefix_cdf", "rooted_occurrence", "gaifman_bits", "estimate_occurrences", "star_sample", "exact_census_k3", "decompose_path", "count_lookup", "sums_at_vertices", "rescaled_estimates", "rooted_occurrence_split", "side_masses", "tree_mode_bits", "selective_sample"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(int(x) if isinstance(x, decimal.Decimal) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF), db.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    got = {r["s"]: r["n"] for r in catalog.entry(spark, SF).collect()}
    assert got == {3221225472: 351532, 2684354560: 175766}


def test_all_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_adaptive_estimates_are_near_the_census(spark):
    got = {r["footprint"]: r["est_occurrences"] for r in catalog.QUERIES["adaptive_sample"](spark, SF).collect()}
    assert got[6] == pytest.approx(423752, rel=0.15) and got[7] == pytest.approx(125968, rel=0.15)
