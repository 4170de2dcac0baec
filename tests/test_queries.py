"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from helixframe import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_two_sets_hold_all_vectors(spark):
    from helixframe.plans import model_queries

    a, b = model_queries._two(spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert a.count() + b.count() == n and a.join(b, "feature_id").isEmpty()
    rows = catalog.QUERIES["hungarian_match"](spark, SF).collect()
    assert len({r.a_id for r in rows} | {r.b_id for r in rows}) == 2 * len(rows) == n


def test_matched_jaccard_without_a_matrix_in_the_driver(spark, monkeypatch):
    import numpy as np

    from helixframe.operators import models, vectors
    from helixframe.plans import model_queries

    (ka, wa), (kb, wb) = (vectors.matrix(d) for d in model_queries._two(spark, SF))
    monkeypatch.setattr(vectors, "matrix", None)
    monkeypatch.setattr(models, "hungarian", None, raising=False)
    got = catalog.QUERIES["matched_jaccard"](spark, SF).first()
    monkeypatch.undo()
    unit = lambda w: w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-9)
    a, b = wa[:, 0] > 0, wb[models.hungarian(-(unit(wa) @ unit(wb).T)), 0] > 0
    assert got.pair_jaccard == pytest.approx((a & b).sum() / (a | b).sum())
    assert got.hybrid_jaccard == pytest.approx((a & b).sum() / (a.sum() + (wb[:, 0] > 0).sum()))


def test_replicates_of_the_survey(spark, monkeypatch):
    from helixframe.plans import resample_queries

    assert catalog.QUERIES["noise_ceiling"](spark, SF).first().splits == 200
    seen, real = [], resample_queries.R.pair_bootstrap
    monkeypatch.setattr(resample_queries.R, "pair_bootstrap", lambda pairs, reps: seen.append(reps) or real(pairs, reps))
    catalog.QUERIES["jaccard_bootstrap"](spark, SF)
    assert seen == [2000]
