"""Queries against their SQL on the smallest tables; those that take longest are left to the driver's check."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from netprobe.plans import registry

NAMES = ["canonical_edges", "node_neighbors", "complete_attrs", "node_sample", "walk_path", "weighted_pick", "probe_batch", "replay_rewards", "clustering", "egonet_counts", "knn_features", "log_bins", "epsilon_greedy", "htr_gram", "regularize", "error_curves", "modularity", "power_law", "stream_rewards", "refresh_knn", "refresh_refex", "stream_probes", "stream_counts", "clustering_all_lines", "transitivity_all_lines", "network_file", "edge_list_file", "attribute_file", "embedding_file", "step_log_file", "curve_file", "probe_lines", "grow_high", "components_all_lines", "cubic_features", "ols_errors", "curve_text_file", "appended_samples", "stored_stats", "linear_topk", "gain_extremes", "curve_maxima", "linreg_score"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = registry.queries()[name](spark, sf_dir)
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    expected = want.df()[columns]
    exact = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.astype(object).itertuples(index=False, name=None))
    assert exact(got.select(*columns).toPandas()) == exact(expected)


def test_each_query_but_iterative_ones_has_sql():
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"walk_sample", "knn_score", "logit_score", "svm_score", "pu_score", "htr_fit", "grow_small", "grow_learned", "grow_logit", "communities", "node2vec_features", "refex_node2vec"}
