"""Loopy solves against dense ones, and every registered residual's derivatives against differences."""

import numpy as np
import pytest

from atlasfold.functions import duals, registry
from atlasfold.operators import refine


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.REGISTRY))
def test_derivatives_are_differences(name):
    residual, g = registry.REGISTRY[name], np.random.default_rng(1)
    n, h = 200, 1e-6
    data = {k: g.uniform(0.2, 1.5, n) * (1 if k.startswith("sd") else g.choice([-1, 1], n)) for k in residual.columns}
    poses = [g.uniform(-1, 1, (n, 3)) for _ in range(residual.poses)]
    call = lambda p: registry.values(residual, p[0], p[1] if len(p) == 2 else None, data)
    found, slopes = registry.evaluate(residual, poses[0], poses[1] if len(poses) == 2 else None, data)
    assert np.allclose(found, call(poses))
    for k in range(3 * len(poses)):
        step = [p.copy() for p in poses]
        step[k // 3][:, k % 3] += h
        up = call(step)
        step[k // 3][:, k % 3] -= 2 * h
        change = (up - call(step)) / (2 * h)
        smooth = np.abs(change) < 1e3  # a switch may lie within the step
        assert np.allclose(slopes[:, k][smooth], change[smooth], atol=1e-5) and smooth.mean() > 0.95


def test_dual_arithmetic():
    x, y = duals.unknowns(np.array([[2.0, 3.0], [0.5, -1.0]]), 0, 2)
    z = (1 - x) * y / (x + 2) + 3 / y - duals.sqrt(x * x) + duals.where(np.array([True, False]), y, x)
    f = lambda a, b, first: (1 - a) * b / (a + 2) + 3 / b - abs(a) + (b if first else a)
    assert np.allclose(z.v, [f(2, 3, True), f(0.5, -1, False)])
    h = 1e-6
    for i, (a, b, first) in enumerate([(2, 3, True), (0.5, -1, False)]):
        assert np.allclose(z.d[:, i], [(f(a + h, b, first) - f(a - h, b, first)) / (2 * h), (f(a, b + h, first) - f(a, b - h, first)) / (2 * h)], atol=1e-6)


def world(seed, graphs=2, n=16):
    """Rings driven with noise; closures between poses seen again, and a graph of one pose, and one without residuals."""
    g = np.random.default_rng(seed)
    poses, edges = [], []
    for graph in range(graphs):
        true = np.array([[5 * np.cos(t), 5 * np.sin(t), t + np.pi / 2] for t in np.linspace(0, 4 * np.pi, n)])
        start = true + np.cumsum(g.normal(0, [0.03, 0.03, 0.01], (n, 3)), 0)
        poses += [(graph, k, *map(float, start[k]), "extra") for k in range(n)]
        links = [(k, k + 1) for k in range(n - 1)] + [(k, k + n // 2) for k in range(0, n // 2, 2)]
        for i, j in links:
            c, s = np.cos(true[i, 2]), np.sin(true[i, 2])
            dx, dy = true[j, :2] - true[i, :2]
            lx, ly = c * dx + s * dy + g.normal(0, 0.01), c * dy - s * dx + g.normal(0, 0.01)
            edges.append((graph, i, j, float(np.hypot(lx, ly)), float(np.arctan2(ly, lx)), float(true[j, 2] - true[i, 2]), 0.03, 0.03, 0.01))
    poses += [(50, 4, 1.0, 2.0, 3.0, "lone"), (51, 0, 0.0, 0.0, 0.0, None), (51, 1, 1.0, 0.0, 0.0, None)]
    edges += [(0, 3, 99, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0), (77, 0, 1, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    return poses, edges


def frames(spark, poses, edges):
    p = spark.createDataFrame(poses, "graph_id long, pose_id int, x double, y double, th double, s0 string")
    e = spark.createDataFrame(edges, "graph_id long, i int, j int, radial double, direction double, rotation double, sd_radial double, sd_tangential double, sd_angular double")
    targets = spark.createDataFrame([(0, 7, 5.0, 0.0, 2.0, 2.0), (1, 3, 1.0, 4.0, 0.5, None)], "graph_id long, i int, tx double, ty double, tth double, weight double")
    return p, {"pose_edge": e, "colocation": targets}


def dense(poses, edges, targets, graph):
    """Gauss-Newton with the whole Jacobian, first pose fixed."""
    own = [p for p in poses if p[0] == graph]
    at = {p[1]: k for k, p in enumerate(own)}
    x = np.array([p[2:5] for p in own])
    links = [e for e in edges if e[0] == graph and e[1] in at and e[2] in at]
    i, j = (np.array([at[e[k]] for e in links]) for k in (1, 2))
    data = {k: np.array([e[3 + m] for e in links]) for m, k in enumerate(registry.REGISTRY["pose_edge"].columns)}
    marks = [t for t in targets if t[0] == graph]
    k = np.array([at[t[1]] for t in marks], int)
    goal = {c: np.array([t[2 + m] for t in marks]) for m, c in enumerate(("tx", "ty", "tth"))}
    w = np.sqrt(np.array([1.0 if t[5] is None else t[5] for t in marks]))

    def system(x):
        r, d = registry.evaluate(registry.REGISTRY["pose_edge"], x[i], x[j], data)
        rows, jac = [r.T.ravel()], np.zeros((r.size + 3 * len(k), x.size))
        for m in range(len(i)):
            jac[3 * m : 3 * m + 3, 3 * i[m] : 3 * i[m] + 3] = d[:, :3, m]
            jac[3 * m : 3 * m + 3, 3 * j[m] : 3 * j[m] + 3] = d[:, 3:, m]
        if len(k):
            r2, d2 = registry.evaluate(registry.REGISTRY["colocation"], x[k], None, goal)
            rows.append((r2 * w).T.ravel())
            for m in range(len(k)):
                jac[r.size + 3 * m : r.size + 3 * m + 3, 3 * k[m] : 3 * k[m] + 3] = d2[:, :, m] * w[m]
        return np.concatenate(rows), jac

    for _ in range(50):
        r, jac = system(x)
        jac = jac[:, 3:]
        x[1:] += np.linalg.solve(jac.T @ jac, -jac.T @ r).reshape(-1, 3)
    r, _ = system(x)
    return x, r @ r / 2


def test_conjugate_gradients_equal_a_dense_solve(spark):
    poses, edges = world(2)
    p, terms = frames(spark, poses, edges)
    system = refine.normal_equations(p, terms).where("i > 0 and j > 0")
    blocks = rows(system)
    for stretch in (128, 6):
        found = {(r["graph_id"], r["pose_id"]): [r["s0"], r["s1"], r["s2"]] for r in rows(refine.conjugate_gradients(system, stretch, 1e-12))}
        for graph in (0, 1):
            a, b = np.zeros((48, 48)), np.zeros(48)
            for r in blocks:
                if r["graph_id"] == graph:
                    i, j = 3 * r["i"], 3 * r["j"]
                    a[i : i + 3, j : j + 3] = np.array([r[k] for k in refine.BLOCK]).reshape(3, 3)
                    if i == j:
                        b[i : i + 3] = [r[k] for k in refine.SLOPE]
            want = np.linalg.solve(a[3:, 3:], -b[3:]).reshape(-1, 3)
            assert np.allclose([found[graph, k] for k in range(1, 16)], want, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("direct", [256, 0])
def test_refined_loops_equal_a_dense_solve(spark, direct):
    poses, edges = world(3)
    p, terms = frames(spark, poses, edges)
    found = rows(refine.refine(p, terms, rounds=8 if direct else 6, settled=1e-9, stretch=6, direct=direct))
    assert {(r["graph_id"], r["pose_id"]) for r in found} == {x[:2] for x in poses}
    targets = [tuple(r) for r in terms["colocation"].collect()]
    for graph in range(2):
        own = sorted((r for r in found if r["graph_id"] == graph), key=lambda r: r["pose_id"])
        want, cost = dense(poses, edges, targets, graph)
        got = np.array([[r["x"], r["y"], r["th"]] for r in own])
        assert np.allclose(got[:, :2], want[:, :2], atol=1e-4) and np.allclose(np.cos(got[:, 2] - want[:, 2]), 1, atol=1e-7)
        assert abs(own[0]["cost_after"] - cost) < 1e-4 * cost and own[0]["cost_after"] < own[0]["cost_before"]
        assert np.allclose(got[0, :2], [p[2:4] for p in poses if p[:2] == (graph, 0)][0])
    still = {(r["graph_id"], r["pose_id"]): (r["x"], r["y"], r["cost_after"]) for r in found if r["graph_id"] >= 50}
    assert still == {(50, 4): (1.0, 2.0, 0.0), (51, 0): (0.0, 0.0, 0.0), (51, 1): (1.0, 0.0, 0.0)}


def test_a_residual_of_the_users_own(spark):
    own = dict(registry.REGISTRY)

    def ring(a, d):
        return (duals.sqrt(a[0] * a[0] + a[1] * a[1]) - d["radius"],)

    own["ring"] = registry.Residual("ring", 1, ("radius",), ring)
    p = spark.createDataFrame([(1, k, float(k + 1), 1.0, 0.0) for k in range(4)], "graph_id long, pose_id int, x double, y double, th double")
    t = spark.createDataFrame([(1, k, 2.5) for k in range(1, 4)], "graph_id long, i int, radius double")
    found = rows(refine.refine(p, {"ring": t}, registry=own))
    assert all(abs(np.hypot(r["x"], r["y"]) - 2.5) < 1e-4 for r in found if r["pose_id"]) and all(r["cost_after"] < 1e-8 for r in found)
    assert rows(refine.refine(p.limit(0), {"ring": t}, registry=own)) == []


def test_gradients_inside_tasks_are_those_of_rounds(spark, monkeypatch):
    """Many graphs at once: no round of Spark is taken for them, and a graph over the bound goes by rounds with the same steps."""
    poses, edges = world(5, graphs=3)
    poses += [(9, k, float(k), 0.0, 0.0, None) for k in range(40)]
    edges += [(9, k, k + 1, 1.1, 0.0, 0.01, 0.03, 0.03, 0.01) for k in range(39)] + [(9, 0, 35, 30.0, 0.1, 0.2, 0.03, 0.03, 0.01)]
    p, terms = frames(spark, poses, edges)
    system = refine.cut(refine.normal_equations(p, terms).where("i > 0 and j > 0"), "system")
    steps = lambda bound: {(r["graph_id"], r["pose_id"]): [r["s0"], r["s1"], r["s2"]] for r in rows(refine.conjugate_gradients(system, 6, 1e-11, whole=bound))}
    some = steps(100)
    cuts = []
    real = refine.cut
    monkeypatch.setattr(refine, "cut", lambda df, name="cut": cuts.append(name) or real(df, name))
    found = steps(refine.WHOLE)
    assert "gradients" not in cuts and set(found) == set(some) and len(found) == 3 * 15 + 39
    for k in found:
        assert np.allclose(found[k], some[k], rtol=1e-6, atol=1e-8)
    assert system.groupBy("graph_id").count().where("count > 100").count() == 1
