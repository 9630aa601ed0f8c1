"""Every query with SQL agrees with it on the smallest tables; plans keep the expected shape."""

import duckdb
import pytest

import __spark_entry__ as contract
from catalog.registry import Tables
from catalog import tables, texts
from cohortspark.operators import neighbors
from cohortspark.plans import embedding, narrative
from tools.check import TABLES, rows


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


#: Minutes of small jobs; tools/check.py runs them, and the operators below them have tests of their own.
LONG = {"structured_comparator", "kmeans_range", "phenotype_clusters", "subgroup_clusters", "layout_2d", "layout_3d", "density_clusters",
        "spanning_forest", "importance_table", "backmapping_metrics"}


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - LONG))
def test_query_equals_sql(spark, folder, db, name):
    got = contract.queries()[name](spark, folder).toArrow()
    want = db.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry_without_the_text_operators():
    """A missing third-party module takes the queries that need it, not the others."""
    import subprocess
    import sys

    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert 'survival_cif' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)")
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_jobs_stay_in_the_jvm(spark, folder):
    t = Tables(spark, folder)
    built = plan(narrative.build(texts.admissions(t), texts.episodes(t), episode_order=texts.EPISODE_ORDER))
    embedded = plan(embedding.HashedTextEmbedder(8)(t.documents, "text", "v"))
    for p in (built, embedded):
        assert "Python" not in p and "Pandas" not in p and "Cartesian" not in p and "NestedLoop" not in p


def test_scans_read_needed_columns_only(spark, folder):
    t = Tables(spark, folder)
    p = plan(tables.labelled_features(t))
    assert "l_extendedprice" not in p and "p_brand" not in p


def test_no_pair_join_in_neighbour_search(spark, folder):
    t = Tables(spark, folder)
    df = t.embeddings.selectExpr("vec_id AS id", "embedding AS vec")
    p = plan(neighbors.nearest(df, df, 3))
    assert "Cartesian" not in p and "NestedLoop" not in p


def test_neighbour_search_moves_no_vectors_as_keys(spark, folder):
    t = Tables(spark, folder)
    df = t.embeddings.selectExpr("vec_id AS id", "embedding AS vec")
    p = plan(neighbors.nearest(df, df, 3))
    assert not any("hashpartitioning(vec" in line for line in p.splitlines())
