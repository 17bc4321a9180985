import os

import duckdb
import pytest

from treefuse.queries import ORACLE, QUERIES

NAMES = ["matrix_quantiles", "mst_rows", "subtree_balance", "outlier_floor", "tree_solve", "contract_tree", "merge_table", "leaf_order", "labels_small_k", "column_shrink", "sparse_loss", "bi_loss", "star_pointers", "mst_rows_1d_rounds", "rooted_tree_tour", "single_lambda_labels", "bi_columns_fused", "sparse_kept_features", "tree_path_counts", "tree_path_clusters", "several_lambda_labels"]


def plain(rows):
    return sorted(tuple("" if v is None or v != v else f"{float(v):.6f}" if hasattr(v, "__float__") and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "lineitem", "embeddings", "events", "part"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(ORACLE[name]).df()
    assert sorted(want.columns) == columns
    assert plain(got.select(columns).collect()) == plain(want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False))


def test_the_entry_point_names_what_it_runs():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and os.path.exists(entry.__file__)
