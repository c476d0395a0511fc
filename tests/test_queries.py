"""Every registered query of the core against its SQL, or against its invariants."""

import duckdb
import pytest

from ledgerloom.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"kmeans_select", "nested_search", "forest_cv", "extra_trees_cv", "mlp_cv"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    out = con.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(got) == plain([[r[i] for i in at] for r in out.fetchall()])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_kfold_is_balanced(spark):
    rows = core.QUERIES["group_kfold"](spark, SF).collect()
    n = [r.n_rows for r in rows]
    assert len(rows) == 5 and max(n) - min(n) <= 2 and sum(n) == spark.read.parquet(f"{SF}/orders.parquet").count()
