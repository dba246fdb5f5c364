"""The registered queries run and agree with their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
NAMES = ["flagship", "select_features", "norm_zscore", "factorize_cg_posterior", "loglik_cg", "perplexity_c", "cluster_probability_g", "ambient_native", "distance_spearman", "module_table", "enrichment", "recode", "added_log_lik", "text_counts", "norm_scaled_columns", "log_normalized", "facet_order", "color_breaks", "top_rank", "top_rank_increasing", "module_heatmap_cells", "reduced_modules"]


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    import duckdb

    import countloom.queries as q

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(con.sql(q.oracle_sql()[name]).columns)
    got = q.queries()[name](spark, SF).select(*[f"`{c}`" for c in cols]).collect()
    quoted = ", ".join(f'"{c}"' for c in cols)
    near = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert near(got) == near(con.sql(f"SELECT {quoted} FROM ({q.oracle_sql()[name]})").fetchall())
