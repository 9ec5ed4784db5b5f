"""Cells of rays are told apart inside the rays' rows: none is shuffled for it, and equal rays count once."""

from atlasfold.operators import grid


def test_no_cell_is_shuffled(spark):
    rays = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.3)] * 3 + [(0, 0.0, 0.0, -1.0, -2.0), (1, 0.5, 0.5, 0.5, 0.5)], "graph_id long, sx double, sy double, wx double, wy double")
    cells = grid.ray_cells(rays, 0.25)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")
    rows = [tuple(r) for r in cells.select("graph_id", "wx", "ix", "iy").collect()]
    assert len(rows) == len(set(rows)) and min(r[2] for r in rows) < 0 and min(r[3] for r in rows) < 0
    assert {r[:2] for r in rows} == {(0, 1.0), (0, -1.0)}


def test_a_ray_makes_no_more_candidates_than_lie_beside_it(spark):
    """Every cell of a brute-force search, and of steep, flat, backward and short rays few candidates a cell."""
    import numpy as np

    g = np.random.default_rng(3)
    rays = [tuple(map(float, r)) for r in g.uniform(-2, 2, (40, 4))] + [(0.0, 0.0, 0.0, 1.0), (1.0, 1.0, -1.0, 1.0), (0.1, 0.1, 0.101, 0.1)]
    df = spark.createDataFrame(rays, "sx double, sy double, wx double, wy double")
    want = set()
    for k, (sx, sy, wx, wy) in enumerate(rays):
        long = np.hypot(wx - sx, wy - sy)
        u, v = (wx - sx) / long, (wy - sy) / long
        for ix in range(-30, 31):
            for iy in range(-30, 31):
                px, py = ix * 0.1 - wx, iy * 0.1 - wy
                if abs(u * py - v * px) < 0.1 * 2**0.5 / 2 and -0.2 <= -(u * px + v * py) <= long + 1e-9:
                    want.add((k, ix, iy))
    cells = grid.ray_cells(df, 0.1)
    number = {r: k for k, r in enumerate(rays)}
    got = [(number[r.sx, r.sy, r.wx, r.wy], r.ix, r.iy) for r in cells.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "transform(" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_no_lambda_runs_over_a_points_nodes(spark):
    points = spark.createDataFrame([(0, 0.1, 0.1), (0, None, 0.1)], "graph_id long, wx double, wy double")
    nodes = spark.createDataFrame([(0, i, j, 0.0, 1.0) for i in range(-3, 5) for j in range(-3, 5)], "graph_id long, ix int, iy int, value double, weight double")
    kept = grid.filter_points(points, nodes, 0.25, ["graph_id"])
    assert kept.count() == 1 and "lambda" not in kept._jdf.queryExecution().optimizedPlan().toString()
