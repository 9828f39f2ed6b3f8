"""Every query with SQL is held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from meshtide import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    made.sql("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        made.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return made


def plain(value):
    return round(float(value), 9) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    assert rows(got.select(*columns).collect()) == rows([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["s6_box_filter_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal)" in plan


def brute_flips(at, faces, n=300):
    """The vote of each face by n rays either way against every other face of its mesh."""
    rng = np.random.default_rng(11)
    a, b, c = (np.array([at[f[k]] for f in faces.values()]) for k in range(3))
    e1, e2 = b - a, c - a
    out = {}
    for i, name in enumerate(faces):
        r, s, up, turn = rng.random((4, n, 1))
        root, up, turn = np.sqrt(r), 0.1 + 0.9 * up, 2 * np.pi * turn
        o = (1 - root) * a[i] + root * (1 - s) * b[i] + root * s * c[i]
        m, t = np.cross(e1[i], e2[i]), e1[i] / np.linalg.norm(e1[i])
        m /= np.linalg.norm(m)
        d = up * m + np.sqrt(1 - up * up) * (np.cos(turn) * t + np.sin(turn) * np.cross(m, t))
        votes = []
        for way in (d, -d):
            near = np.full(n, np.inf)
            for j in set(range(len(faces))) - {i}:
                p, q = np.cross(way, e2[j]), np.cross(o - a[j], e1[j])
                with np.errstate(divide="ignore", invalid="ignore"):
                    u, v, x = np.array([((o - a[j]) * p).sum(1), (way * q).sum(1), q @ e2[j]]) / (p @ e1[j])
                near = np.where((u >= 0) & (v >= 0) & (u + v <= 1) & (x > 0), np.minimum(near, x), near)
            votes += [np.isinf(near).sum(), near[np.isfinite(near)].sum()]
        out[name] = bool(votes[0] < votes[2] or (votes[0] == votes[2] and votes[1] < votes[3]))
    return out


def test_arrow_way_on_boxes_without_floor(spark, tmp_path):
    """Every part's box is answered, a third of them open, and each face as brute force votes."""
    parts = [(k, 1 + 5 * k % 50, 899.0 + 3 * k) for k in range(1, 13)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    v, f = queries.boxes(spark, str(tmp_path))
    at, want = {(r.mesh_id, r.vertex_id): (r.x, r.y, r.z) for r in v.collect()}, {}
    for r in f.collect():
        want.setdefault(r.mesh_id, {})[r.face_id] = (r.a, r.b, r.c)
    want = {m: brute_flips({k: x for (of, k), x in at.items() if of == m}, own) for m, own in want.items()}
    assert sorted(map(len, want.values())) == [10] * 4 + [12] * 8
    want = {(m, k): x for m, own in want.items() for k, x in own.items()}
    for name in ("x2_arrow_flips_all", "x3_default_flips"):
        got = {(r.mesh_id, r.face_id): r.flip for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == want and len(set(got.values())) == 2, name
