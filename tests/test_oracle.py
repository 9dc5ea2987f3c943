"""Registered queries against their oracle statements on the smallest given tables."""

import os
import sys

import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

QUICK = ["side_share_report", "keywords_top_2500", "text_cleaning", "unique_terms", "standard_columns",
         "collocations", "embedding_category_scores", "seed_expansion", "seed_incremental_merge",
         "older_term_scores", "eps_join_pairs", "knn_join_edges", "dbscan_per_group", "standard_scale",
         "exact_duplicates", "near_duplicate_pairs", "clustering_comparison", "graph_modularity",
         "micro_cluster_graph", "final_cluster_numbers"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, name):
    compare = pytest.importorskip("compare")
    got = entry.queries()[name](spark, SF).toPandas()
    want = compare.connect(SF).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canonical(got) == compare.canonical(want) and len(got) > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
