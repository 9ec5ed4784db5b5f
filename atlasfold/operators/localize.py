"""Sliding-window scan matching: correspondences from Spark, a least-squares kernel over windows of poses for each graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rotate, to_world
from ..snapshot import snapshot
from . import match
from .solve import Chain, wrap


def world_with_normals(poses: DataFrame, scans: DataFrame) -> DataFrame:
    j = scans.join(poses.select("graph_id", "pose_id", "x", "y", "th"), ["graph_id", "pose_id"])
    wx, wy = to_world("px", "py", "x", "y", "th")
    nx, ny = rotate("nx", "ny", "th")
    return j.withColumns({"wx": wx, "wy": wy, "wnx": nx, "wny": ny})


def _points(p: np.ndarray, at: np.ndarray, xy: np.ndarray) -> np.ndarray:
    c, s = np.cos(p[at, 2]), np.sin(p[at, 2])
    return np.stack([p[at, 0] + c * xy[:, 0] - s * xy[:, 1], p[at, 1] + s * xy[:, 0] + c * xy[:, 1]], 1)


def solve_window(p: np.ndarray, lo: int, hi: int, chain: Chain, m: dict[str, np.ndarray], sd: float, factor: float, iterations: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Poses lo to hi - 1 under odometry and matches, the others fixed; and their 3x3 covariances. Damped Gauss-Newton.

    ``m``: i, j (pose rows), a, b (robot-frame points), n (robot-frame normals of b's scan at b).
    """
    own = np.flatnonzero((m["i"] < hi) & (m["j"] < hi) & ((m["i"] >= lo) | (m["j"] >= lo)))
    i, j, a, b, n = (m[k][own] for k in ("i", "j", "a", "b", "n"))
    size, w = hi - lo, factor / sd

    def residuals(q):
        turned = _points(np.concatenate([np.zeros((len(q), 2)), q[:, 2:]], 1), j, n)
        d = _points(q, i, a) - _points(q, j, b)
        r, _ = chain.residuals(q)
        edges = slice(max(lo - 1, 0), hi - 1)
        return np.concatenate([(d * turned).sum(1) * w, r[edges].ravel()]), d, turned, edges

    def cost(q):
        return float((residuals(q)[0] ** 2).sum())

    p, now, damp = p.copy(), cost(p), 1e-4
    normal = np.eye(3 * size)
    for _ in range(iterations):
        r, d, turned, edges = residuals(p)
        jac = np.zeros((len(r), 3 * size))
        row = np.arange(len(own))
        pi, pj = _points(p, i, a) - p[i, :2], _points(p, j, b) - p[j, :2]
        for at, rel, sign in ((i, pi, 1.0), (j, pj, -1.0)):
            free = (at >= lo) & (at < hi)
            k = 3 * (at[free] - lo)
            t = turned[free]
            for axis in (0, 1):
                np.add.at(jac, (row[free], k + axis), sign * w * t[:, axis])
            by_angle = sign * (t[:, 1] * rel[free, 0] - t[:, 0] * rel[free, 1])
            if sign < 0:  # the normal turns with the second pose too
                by_angle = by_angle + d[free, 1] * t[:, 0] - d[free, 0] * t[:, 1]
            np.add.at(jac, (row[free], k + 2), w * by_angle)
        base = len(own)
        for e in range(edges.start, edges.stop):
            for v in range(2):
                if lo <= e + v < hi:
                    for axis in range(3):
                        q = p.copy()
                        q[e + v, axis] += 1e-6
                        jac[base + 3 * (e - edges.start) : base + 3 * (e - edges.start) + 3, 3 * (e + v - lo) + axis] = (chain.residuals(q)[0][e] - chain.residuals(p)[0][e]) / 1e-6
        normal = jac.T @ jac
        step = np.linalg.solve(normal + damp * np.diag(np.diag(normal)) + 1e-9 * np.eye(3 * size), -jac.T @ r).reshape(-1, 3)
        q = p.copy()
        q[lo:hi] += step
        new = cost(q)
        if new < now:
            done = now - new < 1e-9 * max(now, 1e-9)
            p, now, damp = q, new, max(damp / 5, 1e-10)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
    cov = np.linalg.pinv(normal)
    return p, np.stack([cov[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] for k in range(size)])


def localize(poses: DataFrame, scans: DataFrame, threshold: float = 0.3, window: int = 10, step: int = 5, rounds: int = 2, sd: float = 0.05, factor: float = 0.2, more_than: int = 10, cap: int = 5) -> DataFrame:
    """(graph_id, pose_id, x, y, th, cov): poses after ``rounds`` of matching all scans at most ``window`` apart and solving windows in order.

    Matches are made by grid joins over all graphs at once; a graph's own matches are a group of its solve.
    """
    first = poses.select("graph_id", "pose_id", "x", "y", "th")
    now = first
    for _ in range(rounds):
        m = match.all_pairs(world_with_normals(now, scans), threshold, window=window, cap=cap, more_than=more_than)
        a = scans.select("graph_id", "pose_id", "obs_id", F.col("px").alias("ax"), F.col("py").alias("ay"))
        b = scans.select("graph_id", F.col("pose_id").alias("to_pose"), F.col("obs_id").alias("to_obs"), F.col("px").alias("bx"), F.col("py").alias("by"), F.col("nx").alias("bnx"), F.col("ny").alias("bny"))
        pairs = m.select("graph_id", "pose_id", "obs_id", "to_pose", "to_obs").join(a, ["graph_id", "pose_id", "obs_id"]).join(b, ["graph_id", "to_pose", "to_obs"])
        pairs = pairs.select(F.col("graph_id").alias("_h"), "pose_id", "to_pose", "ax", "ay", "bx", "by", "bnx", "bny")
        odo = first.select("graph_id", "pose_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("th").alias("ot"))
        left = now.select("graph_id", "pose_id", "x", "y", "th").join(odo, ["graph_id", "pose_id"]).withColumn("_g", F.col("graph_id"))

        def run(key, p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("pose_id").reset_index(drop=True)
            if not len(p):
                return pd.DataFrame(columns=["graph_id", "pose_id", "x", "y", "th", "cov"])
            at = {int(k): i for i, k in enumerate(p.pose_id)}
            m = m.sort_values(["pose_id", "to_pose", "ax", "ay"])
            got = {"i": np.array([at[int(k)] for k in m.pose_id], int), "j": np.array([at[int(k)] for k in m.to_pose], int), "a": m[["ax", "ay"]].to_numpy(float), "b": m[["bx", "by"]].to_numpy(float), "n": m[["bnx", "bny"]].to_numpy(float)}
            x = p[["x", "y", "th"]].to_numpy(float)
            chain = Chain(p[["ox", "oy", "ot"]].to_numpy(float), [])
            cov = np.zeros((len(x), 3, 3))
            for stop in range(min(step + 1, len(x)), len(x) + step, step):
                hi = min(stop, len(x))
                lo = max(1, hi - window)
                if lo < hi:
                    x, cov[lo:hi] = solve_window(x, lo, hi, chain, got, sd, factor)
            return pd.DataFrame({"graph_id": p.graph_id, "pose_id": p.pose_id, "x": x[:, 0], "y": x[:, 1], "th": wrap(x[:, 2]), "cov": [c.ravel().tolist() for c in cov]})

        solved = left.groupBy("_g").cogroup(pairs.groupBy("_h")).applyInPandas(run, "graph_id long, pose_id int, x double, y double, th double, cov array<double>")
        now = snapshot(solved)
    return now
