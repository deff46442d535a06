"""Every registered query that has SQL against it."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def names():
    from braidflow.plans.oracles import ORACLES

    return sorted(ORACLES)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", names())
def test_query(spark, db, name):
    from braidflow.plans.oracles import ORACLES
    from braidflow.plans.queries import QUERIES

    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == wanted


@pytest.mark.parametrize("name", ["pyspark", "cuda", "mpi", "openmp", "thread"])
def test_profiles_take_every_branch(spark, name):
    """The intransitive scores reach what the discriminant's never do."""
    from braidflow.operators import hybrid
    from braidflow.plans import queries

    p = queries.mixed_profile(name)
    rows = queries.mixed_final(spark, SF, name).collect()
    unsure = [r for r in rows if r["route"] == "uncertain"]
    assert unsure and any(r["route"] == "confident" for r in rows) and any(r["route"] == "holdout" for r in rows)
    assert any(r["cluster_id"] is None for r in unsure)  # beyond the cap
    assert any(r["cluster_id"] == -1 for r in unsure) and any((r["cluster_id"] or 0) >= 0 and r["cluster_id"] is not None for r in unsure)
    assert (any(r["route"] == "normal" for r in rows)) == (p.normal_bypass and name != "mpi")
    routed = hybrid.route(hybrid.judge(queries.mixed_scores(spark, SF), p), p)
    pooled = hybrid.pool(routed, p)
    labels = hybrid.label_clusters(hybrid.cluster_pool(pooled, p), hybrid.normal_centroid(routed, pooled, p), p).collect()
    assert any(r["anchors"] == 0 for r in labels)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
