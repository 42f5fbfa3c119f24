"""Every registered query of the sequencing operators runs; those with SQL equal DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest
import test_operators

from cytolith.plans.oracles import ORACLES
from cytolith.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


#: Queries beyond SQL, and the tests in test_operators that hold their operators against plain Python.
DIRECT = {
    "annotate_clusters": ("test_auc_of_sets_of_clusters", "test_clusters_get_their_types"),
    "cluster_cells": ("test_components_of_all_genes_are_those_of_the_covariance", "test_neighbours_and_communities", "test_communities_raise_modularity"),
    "copy_number_residuals": ("test_copy_number_is_taken_off",),
    "differential_edges": ("test_moderated_tests_equal_those_of_the_matrix", "test_differential_edges_find_the_shifted_neighbour"),
    "dirichlet_draws": ("test_dirichlet_draws_repeat",),
    "driver_posterior": ("test_inference_equals_enumeration", "test_learning_climbs"),
    "expression_distribution": ("test_densities_are_those_of_the_fitted_parts",),
    "expression_weights": ("test_expression_weights_by_direct_fit",),
    "gauss_mixture": ("test_mixtures_climb_and_find_parts",),
    "student_mixture": ("test_mixtures_climb_and_find_parts",),
    "heatmap_order": ("test_leaf_order_puts_like_rows_together",),
    "low_count_filter": ("test_low_counts_are_cut", "test_a_weighted_fit_is_that_of_repeated_values"),
}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert columns and rows and all(callable(getattr(test_operators, t)) for t in DIRECT[name])
        return
    wanted = con.sql(ORACLES[name])
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    assert sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=repr) == sorted((tuple(norm(r[k]) for k in order) for r in wanted.fetchall()), key=repr)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["cell", "gene", "count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
