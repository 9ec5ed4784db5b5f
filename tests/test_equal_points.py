"""Equal points go to RANSAC as one row; lines and resamplings are those of the points one by one."""

import numpy as np
from pyspark.sql import functions as F

from atlasfold.operators import linemap, lines, solve


def cross(g, n):
    x, y = g.uniform(0, 3, (2, n)).round(2)
    near = g.normal(0, 0.02, (2, n)).round(3)
    xy = np.concatenate([np.stack([x, 1 + near[0]], 1), np.stack([2 + near[1], y], 1), g.uniform(0, 3, (n // 4, 2)).round(1)])
    normals = np.concatenate([np.tile([0.0, 1.0], (n, 1)), np.tile([1.0, 0.0], (n, 1)), np.tile([0.6, 0.8], (n // 4, 1))])
    return xy, normals


def test_weights_stand_for_equal_points_and_bounds_for_counts(monkeypatch):
    xy, normals = cross(np.random.default_rng(3), 6000)
    rows, w = np.unique(np.concatenate([xy, normals, xy + normals], 1), axis=0, return_counts=True)
    assert w.max() > 3 and len(rows) > lines.CROWD
    every = np.repeat(rows, w, 0)
    split = lambda r: (r[:, :2], 0.02, 100, 300, 5, r[:, 2:4], r[:, 4:], 0.2)
    one, two = lines.line_segments(*split(rows), w), lines.line_segments(*split(every))
    monkeypatch.setattr(lines, "CROWD", 1 << 30)
    plain = lines.line_segments(*split(every))
    assert len(plain) >= 2 and [int(x[2].sum()) for x in one] == [int(x[2].sum()) for x in two] == [len(x[1]) for x in plain]
    assert all(np.allclose(a[0], b[0]) and np.allclose(a[0], c[0]) for a, b, c in zip(one, two, plain, strict=True))


def test_resamplings_by_moments_are_those_of_the_points():
    g = np.random.default_rng(4)
    for ends, wide in (((0.0, 0.0, 3.0, 0.1), 0.05), ((0.0, 0.0, 3.0, 0.1), 1e-6), ((1.0, 0.3, 2.0, -0.1), 0.05), ((1.0, 0.0, 1.0, 0.0), 0.05)):
        own = np.stack([g.uniform(0, 3, 400), g.normal(0, 0.04, 400)], 1)
        w = g.integers(1, 4, 400)
        every, a = np.repeat(own, w, 0), np.random.default_rng(8)
        want = [solve.fit_segment(ends, every[a.integers(0, len(every), len(every))])[:4] for _ in range(30)]
        assert np.allclose(linemap.turns(ends, own, w, 30, np.random.default_rng(8), wide), want, atol=1e-7)
        # many equal points: the same moments by other draws
        few = linemap.turns(ends, own, w * 9, 400, g, wide)
        assert np.allclose(few.mean(0), np.mean(want, 0), atol=0.02)


def test_repeats_make_no_rows_of_a_tile(spark):
    xy, normals = cross(np.random.default_rng(6), 800)
    rows = [(1, *map(float, (*p, *n, *(p + n)))) for p, n in zip(xy, normals, strict=True)]
    once = spark.createDataFrame(rows, "graph_id long, wx double, wy double, nx double, ny double, sx double, sy double")
    often = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("k")
    held = lines.tiles(lines.gathered(often), 4.0, 0.5)
    assert held.count() == lines.tiles(once.distinct(), 4.0, 0.5).count() and lines.gathered(often).agg(F.sum("copies")).first()[0] == 20 * len(rows)
    plan = lines.ransac(often, 4.0, inliers=2000, iterations=200, share=0.2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.rindex("HashAggregate") > text.index("FlatMapGroupsInArrow")
    found = plan.collect()
    assert len(found) >= 2 and all(r.n % 20 == 0 for r in found)
