"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from atlasfold.plans import oracles
from atlasfold.plans import queries as plans

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


def norm(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, str(SF))
    rows = [tuple(map(norm, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name not in oracles.SQL:
        assert rows or name in ("bootstrap_cov", "segment_fit")
        return
    got = duck.execute(oracles.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(n) for n in sorted(names)]
    want = [tuple(norm(r[i]) for i in order) for r in got.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_every_oracle_has_a_query():
    assert set(oracles.SQL) <= set(plans.queries())


def test_replay_runs_over_the_tables(spark):
    from atlasfold.sources import fixtures as fx

    before = {(r.graph_id, r.pose_id): (r.x, r.y) for r in fx.poses(spark, str(SF)).collect()}
    after = {(r.graph_id, r.pose_id): (r.x, r.y) for r in plans.replay(spark, str(SF)).collect()}
    assert set(after) == set(before)
    seen = {r.graph_id for r in fx.world(spark, str(SF)).select("graph_id").distinct().collect()}
    moved = {k[0] for k in before if max(abs(a - b) for a, b in zip(after[k], before[k], strict=True)) > 1e-3}
    assert moved == seen


def test_ransac_finds_the_walls(spark):
    """Every segment lies along a wall, and every wall is covered but for where tiles and walls cross it."""
    import numpy as np

    from atlasfold.sources import fixtures as fx

    walls = {}
    for r in fx.walls(spark, str(SF)).groupBy("graph_id", "wall").agg({"wx": "count"}).collect():
        number = r.wall
        x0, y0, a = number * 2.3, (r.graph_id * 2 + number * 3) % 5 * 1.7, number * 0.9 + r.graph_id
        walls[r.graph_id, number] = np.array([x0, y0]), np.array([np.cos(a), np.sin(a)])
    seen = {k: np.zeros(100, bool) for k in walls}
    found = plans.ransac(spark, str(SF)).collect()
    for r in found:
        p, q = np.array([r.x0, r.y0]), np.array([r.x1, r.y1])
        best = min((k for k in walls if k[0] == r.graph_id), key=lambda k: max(abs(np.cross(walls[k][1], e - walls[k][0])) for e in (p, q)))
        start, u = walls[best]
        assert max(abs(np.cross(u, e - start)) for e in (p, q)) < 0.2 and r.n >= 40
        low, high = sorted(((p - start) @ u / fx.WALL_LENGTH, (q - start) @ u / fx.WALL_LENGTH))
        seen[best][max(0, int(low * 100)) : max(0, int(high * 100))] = True
    assert len(walls) == 28 and np.mean([x.mean() for x in seen.values()]) > 0.8
