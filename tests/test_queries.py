"""Every registered query against its SQL in DuckDB on the smallest tables; of those without SQL what must hold of their rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from riskweave.sources.storage import clear_saved

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def scores(df):
    """A score for each row of the last fifth."""
    assert len(df) == 200 and df["event_id"].is_unique and df["p"].between(0, 1).all() and df["p"].nunique() > 1


def runs(df):
    assert sorted(df["run"]) == ["boosted", *(f"draw_{i}" for i in range(4)), "forest"] and df["pr_auc"].between(0, 1).all() and (df["pr_auc"] > 0).sum() >= 3


def best_run(df):
    r = df.iloc[0]
    assert len(df) == 1 and r["champion_pr_auc"] >= max(r["forest"], r["draw_0"])
    assert r["promote_trained"] == (r["draw_0"] >= r["forest"]) and r["promote_live"] == (r["draw_0"] - r["forest"] > 0.005)


def importances(df):
    assert 3 <= len(df) <= 20 and (df["importance"] >= 0).all() and df["importance"].is_monotonic_decreasing and "amount_usd" in set(df["feature"])


def components(df):
    """One vector a node, of components with falling variance that don't go together."""
    x = np.array(df["embedding"].tolist())
    cov = np.cov(x.T)
    assert x.shape[1] == 32 and df["id"].is_unique
    assert (np.diff(np.diag(cov)) <= 1e-9).all() and np.abs(cov - np.diag(np.diag(cov))).max() < 1e-9 * max(1, cov.max())


#: What must hold where SQL can't give the rows.
WITHOUT_SQL = {"m3_m4_m9_logistic_scores": scores, "m5_boosted_scores": scores, "m6_m7_tournament": runs, "k15_m8_runs": best_run, "m16_importance": importances, "g13_propagated_embeddings": components}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        WITHOUT_SQL[name](got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(autouse=True)
def cleared(spark):
    yield
    clear_saved(spark)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
