"""Kernels against NumPy: segment fits, the chain solver, RANSAC, and the correction arithmetic."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest

from atlasfold.operators import correct, lines, solve
from atlasfold.plans.session import Pending, add_points
from atlasfold.schema import Correction
from atlasfold.streaming import events


def chain(n=25, seed=0):
    g = np.random.default_rng(seed)
    p = np.zeros((n, 3))
    for i in range(1, n):
        p[i, 2] = p[i - 1, 2] + g.normal(0, 0.2)
        p[i, :2] = p[i - 1, :2] + g.uniform(0.2, 1) * np.array([math.cos(p[i, 2]), math.sin(p[i, 2])])
    return p


TARGETS = [(7, 2, 1.0, 2.0, 0.3, 0.0), (12, 4, 3.0, -1.0, 0.1, 0.7), (19, 5, 0, 0, -0.4, 0.0), (24, 6, 0, 0, 1.0, 0.0)]


def dense(c, p):
    """Residual vector and numeric Jacobian."""
    f = lambda q: np.concatenate([c.residuals(q)[0].ravel(), *c.residuals(q)[1]])
    j = np.stack([(f(p + d) - f(p - d)) / 2e-6 for d in (np.eye(p.size)[k].reshape(p.shape) * 1e-6 for k in range(p.size))], 1)
    return f(p), j


def test_normal_blocks_are_the_jacobians():
    p = chain()
    c = solve.Chain(p, TARGETS)
    q = p + np.random.default_rng(1).normal(0, 0.05, p.shape)
    r, j = dense(c, q)
    diag, up, grad = c.normal(q)
    full = j.T @ j
    for i in range(len(p)):
        assert np.allclose(full[3 * i : 3 * i + 3, 3 * i : 3 * i + 3], diag[i], rtol=1e-4, atol=1e-3)
        if i:
            assert np.allclose(full[3 * i - 3 : 3 * i, 3 * i : 3 * i + 3], up[i - 1], rtol=1e-4, atol=1e-3)
    assert np.allclose(j.T @ r, grad.ravel(), rtol=1e-4, atol=1e-3)


def test_sweep_solves_the_band():
    p = chain()
    c = solve.Chain(p, TARGETS)
    diag, up, grad = c.normal(p)
    n = len(p)
    full = np.zeros((3 * n, 3 * n))
    for i in range(n):
        full[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] = diag[i]
        if i:
            full[3 * i - 3 : 3 * i, 3 * i : 3 * i + 3] = up[i - 1]
            full[3 * i : 3 * i + 3, 3 * i - 3 : 3 * i] = up[i - 1].T
    x = np.linalg.solve(full[3:, 3:], -grad.ravel()[3:])
    assert np.allclose(c._sweep(diag, up, -grad)[1:].ravel(), x) and not c._sweep(diag, up, -grad)[0].any()


def test_solve_reaches_a_minimum_and_starts_at_zero_without_targets():
    p = chain()
    q, before, after, _ = solve.Chain(p, TARGETS).solve(p)
    r, j = dense(solve.Chain(p, TARGETS), q)
    assert after < before and np.abs((j.T @ r)[3:]).max() < 1e-3 and np.allclose(q[0], p[0])
    same, before, after, _ = solve.Chain(p, []).solve(p)
    assert before < 1e-20 and np.allclose(same[:, :2], p[:, :2])


@pytest.mark.parametrize("angle", [0.0, 0.7, -1.2, 2.9])
def test_segment_fit_finds_the_angle(angle):
    g = np.random.default_rng(2)
    u = np.array([math.cos(angle), math.sin(angle)])
    xy = np.array([1.0, 2.0]) + g.uniform(-1, 1, (300, 1)) * u + g.normal(0, 0.005, (300, 2))
    off = angle + 0.1
    ends = (1 + math.cos(off), 2 + math.sin(off), 1 - math.cos(off), 2 - math.sin(off))
    x0, y0, x1, y1, cost = solve.fit_segment(ends, xy)
    assert abs(math.sin(math.atan2(y0 - y1, x0 - x1) - angle)) < 0.01
    best = min(solve.segment_cost(t, 1, 2, 1, xy) for t in np.linspace(angle - 0.05, angle + 0.05, 2001))
    assert cost <= best + 1e-9
    new, n, _ = solve.adjust_segment((1 + math.cos(angle + 0.02), 2 + math.sin(angle + 0.02), 1 - math.cos(angle + 0.02), 2 - math.sin(angle + 0.02)), xy)
    assert n > 250 and abs(math.sin(math.atan2(new[1] - new[3], new[0] - new[2]) - angle)) < 0.01


def test_ransac_finds_planted_lines():
    g = np.random.default_rng(3)
    xy = np.concatenate([np.stack([g.uniform(0, 4, 200), g.normal(0, 0.01, 200)], 1), np.stack([g.normal(4, 0.01, 200), g.uniform(0, 3, 200)], 1), g.uniform(-1, 5, (60, 2))])
    found = lines.find_lines(xy, 0.04, 150, 300, 1)
    assert len(found) == 2 and {round(abs(math.atan2(y1 - y0, x1 - x0)) % math.pi, 1) for x0, y0, x1, y1, _ in found} <= {0.0, 1.6, 3.1}


def test_ransac_finds_a_short_line_among_many_points():
    g = np.random.default_rng(5)
    line = np.stack([np.linspace(1, 1.3, 12), np.full(12, 2.0)], 1)
    found = 0
    for seed in range(5):
        # a sparse cloud far and wide, in which two points drawn at random are seldom both of the line
        xy = np.concatenate([line, g.uniform(-200, 200, (988, 2))])
        i = lines.partners(xy, 500, np.random.default_rng(seed))
        assert (np.hypot(*(xy[i[:, 0]] - xy[i[:, 1]]).T) <= lines.RADIUS).all() and (i[:, 0] != i[:, 1]).all()
        found += any(abs(y0 - 2) < 0.1 and abs(y1 - 2) < 0.1 for _, y0, _, y1, _ in lines.find_lines(xy, 0.01, 12, 200, seed))
    assert found == 5
    assert lines.partners(np.array([[0.0, 0.0], [9.0, 9.0]]), 5, g).shape == (0, 2)


def moved(kind, points, p):
    t, a, b = correct.motion(kind, points)
    c, s = math.cos(t), math.sin(t)
    return b[0] + c * (p[0] - a[0]) - s * (p[1] - a[1]), b[1] + s * (p[0] - a[0]) + c * (p[1] - a[1])


PTS = [(0.0, 0.0), (2.0, 0.3), (1.0, 4.0), (2.5, 5.5)]


def test_motions_do_what_they_say():
    (a, b), (c, d) = [moved(2, PTS, p) for p in PTS[:2]], PTS[2:]
    assert math.isclose((a[0] + b[0]) / 2, (c[0] + d[0]) / 2) and math.isclose(math.atan2(b[1] - a[1], b[0] - a[0]), math.atan2(d[1] - c[1], d[0] - c[0]))
    a, b = (moved(4, PTS, p) for p in PTS[:2])
    for p in (a, b):
        assert abs((d[0] - c[0]) * (p[1] - c[1]) - (d[1] - c[1]) * (p[0] - c[0])) < 1e-9
    a, b = (moved(5, PTS, p) for p in PTS[:2])
    assert abs((b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1])) < 1e-9
    a, b = (moved(6, PTS, p) for p in PTS[:2])
    assert abs((b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])) < 1e-9
    with pytest.raises(ValueError):
        correct.motion(2, [(0, 0), (0, 0), (1, 1), (2, 2)])


def test_corner_motion_is_the_best_rigid_one():
    src = [(0, 0), (1, 0), (1, 2), (0, 3)]
    t = 0.4
    dst = [(3 + math.cos(t) * x - math.sin(t) * y, -1 + math.sin(t) * x + math.cos(t) * y) for x, y in src]
    got, a, b = correct.corner_motion(src, dst)
    assert math.isclose(got, t) and all(math.isclose(b[0] + math.cos(got) * (x - a[0]) - math.sin(got) * (y - a[1]), d[0]) for (x, y), d in zip(src, dst, strict=True))


def test_points_pend_and_complete():
    s = add_points(Pending(), 2, (0, 0), (1, 1))
    assert s == Pending(2, ((0, 0), (1, 1)), 0)
    assert add_points(s, 4, (5, 5), (6, 6)) == Pending(4, ((5, 5), (6, 6)), 0)
    assert add_points(s, 2, (2, 2), (3, 3)) == Pending(0, ((0, 0), (1, 1), (2, 2), (3, 3)), 2)
    assert add_points(s, 0, (9, 9), (9, 9)) == s and add_points(s, int(Correction.CORNER), (9, 9), (9, 9)).points == s.points
    assert add_points(Pending(), 1, (0, 0), (1, 1)).points == ((0, 0),)


def test_keys_and_clicks():
    key = lambda c: {"event_type": "key", "keycode": c}
    click = lambda *p, m=2: {"event_type": "click", "modifiers": m, "x0": p[0], "y0": p[1], "x1": p[2], "y1": p[3]}
    state, out = (False, 0, 0, ""), []
    for e in [click(0, 0, 1, 1), key(0x50), click(0, 0, 1, 1), {"event_type": "move"}, key(0x55), click(2, 2, 3, 3), key(0x50), key(0x55), key(0x56), key(0x4C), key(0x41)]:
        state, c = events.step(state, e)
        out += c
    assert [c[:2] for c in out] == [("run", 2), ("undo", 0), ("save", 0), ("replay", 0)]
    assert events._points(out[0][2]) == ((0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0))


def test_odometry_turns_by_the_new_angle():
    s = events.accumulate((0.0,) * 6, 1.0, 0.0, math.pi / 2)
    assert np.allclose(s[:5], [0, 1, math.pi / 2, 1, math.pi / 2])
    assert events.due(s, 0.0, 2.0, 1.0, 9.0) and not events.due(s, 1.0, 2.0, 2.0, 9.0) and events.due(s, 10.0, 2.0, 2.0, 9.0)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 17, 64, 101])
def test_cyclic_reduction_is_a_dense_solve(n):
    g = np.random.default_rng(n)
    j = g.normal(size=(n - 1, 3, 6))
    dense = np.eye(3 * n) * 0.5
    for i in range(n - 1):
        dense[3 * i : 3 * i + 6, 3 * i : 3 * i + 6] += j[i].T @ j[i]
    diag = np.stack([dense[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] for i in range(n)])
    up = np.stack([dense[3 * i : 3 * i + 3, 3 * i + 3 : 3 * i + 6] for i in range(n - 1)])
    rhs = g.normal(size=(n, 3))
    got = solve.Chain._sweep(diag, up, rhs)
    want = np.linalg.solve(dense[3:, 3:], rhs[1:].ravel())
    assert np.allclose(got[1:].ravel(), want, atol=1e-9) and not got[0].any()


def test_lines_are_judged_by_normals_and_by_what_lies_beside_them():
    g = np.random.default_rng(7)
    wall = np.stack([g.uniform(0, 3, 200), g.normal(0, 0.01, 200)], 1)
    beside = np.stack([g.uniform(0, 3, 150), g.uniform(0.15, 0.45, 150)], 1)
    across, along = np.tile([0.0, 1.0], (200, 1)), np.tile([1.0, 0.0], (200, 1))
    assert len(lines.find_lines(wall, 0.04, 150, 200, 1, normals=across, share=0.8)) == 1
    assert not lines.find_lines(wall, 0.04, 150, 200, 1, normals=along)
    both = np.concatenate([wall, beside])
    assert len(lines.find_lines(both, 0.04, 190, 200, 1)) == 1
    assert not lines.find_lines(both, 0.04, 190, 200, 1, share=0.8)
    # seen along a ray that runs beside the wall, the same points are far off
    sources = both + np.array([[-9.0, 0.3]])
    assert len(lines.find_lines(both, 0.04, 190, 200, 1, sources=sources, share=0.8)) == 1


def test_a_line_across_a_tile_border_is_found_once(spark):
    g = np.random.default_rng(8)
    xy = np.stack([g.uniform(3.7, 4.3, 60), g.normal(1, 0.005, 60)], 1)
    points = spark.createDataFrame([(1, float(x), float(y)) for x, y in xy], "graph_id long, wx double, wy double")
    found = lines.ransac(points, 4.0, inliers=50, iterations=100).collect()
    assert [r.n for r in found] == [60]


def test_curation_joins_what_tiles_split(spark):
    from atlasfold.operators import linemap

    g = np.random.default_rng(9)
    xy = np.stack([g.uniform(0, 10, 1500), g.normal(1, 0.004, 1500)], 1)
    points = spark.createDataFrame([(1, float(x), -1.0, float(x), float(y), 0.0, -1.0) for x, y in xy], "graph_id long, sx double, sy double, wx double, wy double, nx double, ny double")
    split = linemap.extract(points, 4.0, inliers=40, iterations=100, samples=50)
    parts = split.collect()
    assert len(parts) >= 3 and len({r.seg_id for r in parts}) == len(parts)
    # wide enough for the ends of parts to agree
    wide = split.withColumns({k: split[k] + 1e-3 for k in ("c0xx", "c0yy", "c1xx", "c1yy")})
    whole = linemap.self_merge(wide, ["graph_id"], 2.0)
    (one,) = whole.collect()
    assert one.mass == sum(r.mass for r in parts) and abs(abs(one.x1 - one.x0) - 10) < 0.3 and abs(one.y0 - 1) < 0.02 and abs(one.y1 - 1) < 0.02
    assert not linemap.match(whole, whole, ["graph_id"], 2.0, later=True).count()
    assert not linemap.self_merge(wide.limit(0), ["graph_id"], 2.0).count()
    # a second run over the same wall takes the master up
    again, cells = linemap.curate(points, res=0.25, tile=20.0, inliers=40, iterations=100, samples=50, share=0.0)
    master = again.withColumns({k: again[k] + 1e-3 for k in ("c0xx", "c0yy", "c1xx", "c1yy")})
    grown, merged = linemap.curate(points, master, cells, res=0.25, tile=20.0, inliers=40, iterations=100, samples=50, share=0.0)
    assert merged.count() == cells.count() and grown.agg({"mass": "sum"}).first()[0] >= 1.5 * master.agg({"mass": "sum"}).first()[0]


def test_settings_are_read_without_running_code(tmp_path):
    from atlasfold.sources.config import ConfigError, Settings, config

    base, more = tmp_path / "base.cfg", tmp_path / "more.cfg"
    base.write_text("""-- shared
function twice(x)
  if (x) then return 2 * x; else return 0; end
end
--[[ a longer
note ]]
half = pi / 2;
Engine = { name = "a \\"b\\""; debug = on, limits = {-1.5, 2e1}; at = vec2(1, -2 + 0.5); turn = deg2rad(90.0);
  n = 7, hex = 0x10; q = {w = 1, x = 0, y = 0, z = 0}; nested = { depth = 2 ^ 3; }; power = -2 ^ 2 };
""")
    more.write_text("Engine.n = 8\nEngine.nested.depth = sq(3) - 1\nverify = 0.125; min_inliers = 9")
    s = Settings(str(base), str(more))
    e = s.sub("Engine")
    assert e.text("name") == 'a "b"' and e.flag("debug") and e.integer("n") == 8 and e.integer("hex") == 16 and e.real("power") == -4
    assert e.bounds("limits") == (-1.5, 20.0) and e.vector("at") == (1.0, -1.5) and e.vector("q", "wxyz") == (1.0, 0.0, 0.0, 0.0)
    assert math.isclose(e.real("turn"), s.real("half")) and e.sub("nested").positive("depth") == 8 and e.text("none", "x") == "x"
    c = config(s)
    assert c.verify == 0.125 and c.min_inliers == 9 and c.inlier == 0.03
    for bad in (lambda: e.text("n"), lambda: e.integer("turn"), lambda: e.integer("n", most=7), lambda: e.positive("power"), lambda: e.flag("missing"), lambda: e.real("debug")):
        with pytest.raises(ConfigError):
            bad()
    assert not s.modified()
    os.utime(more, ns=(0, 0))
    assert s.modified()
    s.reload()
    assert not s.modified()
    for text in ("x = twice(2)", "x = ", "x = {1, 2", "function f() x = 1", "a.b = 1", "x = $"):
        more.write_text(text)
        with pytest.raises(ConfigError):
            Settings(str(base), str(more))


def test_chains_solved_together_are_those_solved_alone():
    g = np.random.default_rng(11)
    sizes = [1, 2, 7, 30, 1, 64, 3]
    starts = np.cumsum([0, *sizes])[:-1]
    parts = [np.cumsum(g.normal(0, 0.3, (n, 3)), 0) for n in sizes]
    parts[2][3] = np.nan  # spoils its own chain only
    targets = [[(int(i), int(g.integers(1, 6)), *map(float, g.normal(0, 1, 3)), 0.4) for i in g.integers(0, n, 3)] for n in sizes]
    joined = solve.Chain(np.concatenate(parts), [(t[0] + s, *t[1:]) for s, own in zip(starts, targets, strict=True) for t in own], starts=starts)
    q, before, after, steps = joined.solve(np.concatenate(parts))
    for k, (p, own, s) in enumerate(zip(parts, targets, starts, strict=True)):
        alone, *figures = solve.Chain(p, own).solve(p)
        assert np.allclose(q[s : s + len(p)], alone, atol=1e-5, equal_nan=True) and np.allclose([before[k], after[k]], [figures[0][0], figures[1][0]], rtol=1e-6, equal_nan=True)
    assert steps[5] > 1


def test_joint_solve_works_many_graphs_in_a_call(spark):
    """As each graph alone, with targets of unknown poses and graphs, a null graph, and groups that go over the bounds of batches."""
    g = np.random.default_rng(12)
    p = {k: np.cumsum(g.normal(0, 0.3, (n, 3)), 0) for k, n in enumerate([40, 1, 25, 60, 33])}
    name = lambda k: None if k == 4 else 10**17 + k
    poses = spark.createDataFrame([(name(k), i, *map(float, r)) for k, own in p.items() for i, r in enumerate(own)], "graph_id long, pose_id int, x double, y double, th double")
    own = {k: [(i, kind, 1.0, 0.5, 0.2, 0.3) for i, kind in ((5, 2), (17, 4), (17, 5), (500, 2))] for k in (0, 2, 3, 4)}
    rows = [(name(k), t[1], t[0], *t[2:]) for k in own for t in own[k]] + [(7, 2, 1, 0.0, 0.0, 0.0, 0.0)]
    constraints = spark.createDataFrame(rows, "graph_id long, type int, constrained_id int, tx double, ty double, tth double, penalty double")
    found = solve.joint_solve(poses.repartition(3), constraints)
    assert "Cogroup" not in found._jdf.queryExecution().toString() and "InPandas" not in found._jdf.queryExecution().toString()
    found = {(r.graph_id, r.pose_id): r for r in found.collect()}
    assert len(found) == sum(map(len, p.values()))
    for k in p:
        q, before, after, _ = solve.Chain(p[k], [t for t in own.get(k, []) if t[0] < len(p[k])]).solve(p[k])
        got = [found[name(k), i] for i in range(len(p[k]))]
        assert np.allclose([[r.x, r.y, r.th] for r in got], q, atol=1e-5) and np.allclose([[r.cost_before, r.cost_after] for r in got], [before[0], after[0]], rtol=1e-6)


def test_groups_come_whole_and_some_together():
    g = np.random.default_rng(13)
    key = np.sort(g.integers(0, 40, 1000))
    batches = pa.table({"k": key, "v": np.arange(1000)}).to_batches(max_chunksize=37)
    tables = list(solve.together(iter(batches), ["k"], 100))
    assert pa.concat_tables(tables).column("v").to_pylist() == list(range(1000)) and 3 < len(tables) < 11
    assert sum(len(set(t.column("k").to_pylist())) for t in tables) == len(set(key.tolist()))
