"""Composed motion, relative residuals, closest observations and cell-wise selection against sequential loops and brute force."""

import math

import numpy as np
import pytest

from atlasfold.operators import correct, motion, relative, select


def rows(df):
    return [r.asDict() for r in df.collect()]


def sequential(steps):
    """One motion after the other, with whole Jacobians."""
    pose, cov, out = np.zeros(3), np.zeros((3, 3)), []
    for x, y, th, c00, c01, c02, c11, c12, c22 in steps:
        s, c = math.sin(pose[2]), math.cos(pose[2])
        by_pose = np.array([[1, 0, -s * x - c * y], [0, 1, c * x - s * y], [0, 0, 1]])
        by_step = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
        cov = by_pose @ cov @ by_pose.T + by_step @ np.array([[c00, c01, c02], [c01, c11, c12], [c02, c12, c22]]) @ by_step.T
        pose = pose + [c * x - s * y, s * x + c * y, th]
        out.append((pose, cov))
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_a_scan_is_the_sequential_product(spark, block):
    g = np.random.default_rng(1)
    data, want, steps = [], {}, {}
    for graph, ids in ((1, range(40)), (2, sorted(g.choice(500, 25, replace=False).tolist())), (3, [7])):
        own = []
        for k in ids:
            root = g.normal(0, 0.1, (3, 3))
            c = root @ root.T
            own.append((*g.normal(0, 1, 3).tolist(), *(float(c[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))))
            data.append((graph, int(k), *own[-1], "extra"))
        steps[graph] = dict(zip(ids, own, strict=True))
        want |= {(graph, k): v for k, v in zip(ids, sequential(own), strict=True)}
    table = spark.createDataFrame(data, f"graph_id long, pose_id int, {', '.join(f'{k} double' for k in motion.MOTION)}, block string")
    found = motion.composed(table, block)
    got = {(r["graph_id"], r["pose_id"]): r for r in rows(found)}
    assert set(got) == set(want)
    for key, (pose, cov) in want.items():
        flat = [*pose, cov[0, 0], cov[0, 1], cov[0, 2], cov[1, 1], cov[1, 2], cov[2, 2]]
        assert np.allclose([got[key][k] for k in motion.MOTION], flat, rtol=1e-9, atol=1e-9)
    pairs = spark.createDataFrame([(1, i, j) for i, j in ((0, 9), (3, 4), (5, 39))] + [(9, 0, 1)], "graph_id long, i int, j int")
    for r in rows(motion.between(found, pairs)):
        pose, cov = sequential([steps[1][k] for k in range(r["i"] + 1, r["j"] + 1)])[-1]
        assert np.allclose([r["x"], r["y"], math.cos(r["th"] - pose[2])], [pose[0], pose[1], 1], atol=1e-8)
        assert np.allclose([r[k] for k in motion.COVARIANCE], [cov[0, 0], cov[0, 1], cov[0, 2], cov[1, 1], cov[1, 2], cov[2, 2]], rtol=1e-6, atol=1e-7)
    for r in rows(motion.loop_constraints(found, pairs, trans=(0.0, 99.0), ang=(0.0, 99.0))):
        c = np.array([[r["c00"], r["c01"]], [r["c01"], r["c11"]]])
        u = np.array([math.cos(r["direction"]), math.sin(r["direction"])])
        assert abs(r["sd_radial"] - math.sqrt(5.991 * u @ c @ u)) < 1e-9 and abs(r["sd_angular"] - math.sqrt(r["c22"])) < 1e-9
    assert rows(motion.composed(table.limit(0))) == []


@pytest.mark.parametrize("turned", [False, True])
def test_gradients_by_relative_poses_are_differences(spark, turned):
    g = np.random.default_rng(2)
    n = 6
    steps = g.normal(0, 0.5, (n, 3))
    points = [(1, k, i, *g.normal(0, 1, 2).tolist(), 0.8, 0.6, -0.2) for k in range(n) if k != 2 for i in range(3)] + [(1, 77, 0, 0.0, 0.0, 1.0, 0.0, 0.0)]

    def cost(steps):
        total, pose = 0.0, np.zeros(3)
        for k in range(n):
            a = pose[2] if turned else 0.0
            pose = pose + [math.cos(a) * steps[k, 0] - math.sin(a) * steps[k, 1], math.sin(a) * steps[k, 0] + math.cos(a) * steps[k, 1], steps[k, 2]]
            for _, at, _, px, py, nx, ny, off in points:
                if at == k:
                    x, y = pose[0] + math.cos(pose[2]) * px - math.sin(pose[2]) * py, pose[1] + math.sin(pose[2]) * px + math.cos(pose[2]) * py
                    total += ((x * nx + y * ny + off) * 0.5 / 0.2) ** 2 / 2
        return total

    table = spark.createDataFrame([(1, k, *steps[k].tolist()) for k in range(n)], "graph_id long, pose_id int, dx double, dy double, dth double")
    seen = spark.createDataFrame(points, "graph_id long, pose_id int, obs_id int, px double, py double, nx double, ny double, offset double")
    poses = relative.composed(table) if turned else relative.summed(table)
    found = sorted(rows(relative.gradients(table, relative.per_pose(relative.point_residuals(poses, seen, 0.2, 0.5)), turned)), key=lambda r: r["pose_id"])
    for k in range(n):
        for m, name in enumerate(("gx", "gy", "gth")):
            step = np.zeros((n, 3))
            step[k, m] = 1e-5
            assert abs(found[k][name] - (cost(steps + step) - cost(steps - step)) / 2e-5) < 1e-4 * max(1, abs(found[k][name]))


def test_many_segments_are_met_cell_by_cell(spark, monkeypatch):
    g = np.random.default_rng(3)
    points = spark.createDataFrame([(1, i // 30, i, *g.uniform(-6, 6, 2).tolist()) for i in range(900)], "graph_id long, pose_id int, obs_id int, wx double, wy double")
    ends = [(k, *g.uniform(-6, 6, 4).tolist()) for k in range(60)] + [(60, 1.0, 1.0, 1.0, 1.0), (61, -6.0, 0.5, 6.0, 0.5)]
    segments = spark.createDataFrame(ends, "sel_id int, x0 double, y0 double, x1 double, y1 double")
    for compat in (False, True):
        want = sorted((r["sel_id"], r["obs_id"]) for r in rows(select.observed(points, segments, 0.1, compat)))
        with monkeypatch.context() as m:
            m.setattr(select, "MAX_SEGMENTS", 10)
            found = select.observed(points, segments, 0.1, compat)
            assert sorted((r["sel_id"], r["obs_id"]) for r in rows(found)) == want and len(want) > 50
            assert set(found.columns) == {*points.columns, *segments.columns}


def test_closest_observations_are_brute_force(spark, monkeypatch):
    g = np.random.default_rng(4)
    data = [(i % 3, i // 30, i, *g.uniform(-6, 6, 2).tolist()) for i in range(300)] + [(0, 50, 1000, 2.0, 2.0), (0, 49, 1001, 2.0, 2.0), (0, 1, 1002, None, 1.0)]
    picks = [(k, i, *g.uniform(-9, 9, 2).tolist()) for k in range(9) for i in range(2)] + [(20, 0, 2.0, 2.0), (20, 1, 1e6, -1e6)]
    points = spark.createDataFrame(data, "graph_id long, pose_id int, obs_id int, wx double, wy double")
    asked = spark.createDataFrame(picks, "sel_id int, pick_id int, qx double, qy double")
    want = {}
    for graph in range(3):
        for k, i, x, y in picks:
            own = min((math.hypot(wx - x, wy - y), p, o, wx, wy) for gr, p, o, wx, wy in data if gr == graph and wx is not None)
            want[graph, k, i] = own
    for most in (10_000, 5):
        monkeypatch.setattr(select, "MAX_SEGMENTS", most)
        found = select.closest_observations(points, asked)
        assert {(r["graph_id"], r["sel_id"], r["pick_id"]): (r["pose_id"], r["obs_id"]) for r in rows(found)} == {k: v[1:3] for k, v in want.items()}
    for r in rows(correct.closest_pair_motion(found)):
        a, b = (want[r["graph_id"], r["sel_id"], i] for i in (0, 1))
        late, early = (a, b) if a[1] >= b[1] else (b, a)
        assert (r["constrained_id"], r["anchor_id"]) == (late[1], early[1]) and math.isclose(r["dx"], early[3] - late[3], abs_tol=1e-12) and math.isclose(r["dy"], early[4] - late[4], abs_tol=1e-12)
    assert rows(select.closest_observations(points.limit(0), asked)) == [] and rows(select.closest_observations(points, asked.limit(0))) == []
