"""Every registered query that has an oracle matches DuckDB on sf0.001."""
import pytest

from tests.conftest import SF_SMALL, canon

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
SLOW = {"model_reload_check", "linreg_check", "stream_model_check", "glm_check", "tree_check",
        "forest_check", "embedding_clusters_check", "scaler_check", "kmeans_check",
        "firewall_kmeans_check", "logistic_check", "stream_batch_scores_check", "model_summaries_check",
        "grid_predictions_check", "pipeline_refit_check"}


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = df.collect()
    rel = duck.sql(ORACLES[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    order = [df.columns.index(c) for c in sorted(df.columns)]
    worder = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert canon([[r[i] for i in order] for r in got]) == canon([[r[i] for i in worder] for r in want])


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n in SLOW))
def test_invariant_queries(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).collect()
    want = duck.sql(ORACLES[name]).fetchall()
    assert canon(got) == canon(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "fpm" in df.columns and "rides" in df.columns


def test_every_query_has_check():
    from hubcast.plans.catalog import all_queries
    rows_only = set(all_queries()) - set(ORACLES)
    assert rows_only <= {"file_manifest", "grid_predictions"}
