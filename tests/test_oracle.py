"""A representative subset of the registered queries against the DuckDB oracle (sf0.001).
The full set runs with tools/oracle_check.py."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SUBSET = ["feature_matrix", "scaler_fit", "standardize", "nearest_centroid", "silhouette_sq",
          "davies_bouldin", "profile_numeric", "profile_mode", "cluster_label", "score_rows",
          "label_distribution", "action_plan", "observed_factors", "customer_features",
          "embedding_nearest_centroid", "case_number", "unrecognised_values", "scan_bad_lines"]


@pytest.fixture(scope="module")
def con(small):
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, small, name):
    sdf = E.queries()[name](spark, small)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
