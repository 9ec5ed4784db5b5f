"""Least squares kernels: segment fits, and the pose chain by a block-tridiagonal sweep."""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of whole groups that a task works at once.
TOGETHER = 1 << 13


def _ends(cx: float, cy: float, half: float, theta: float) -> tuple[float, float, float, float]:
    return cx + half * math.cos(theta), cy + half * math.sin(theta), cx - half * math.cos(theta), cy - half * math.sin(theta)


def segment_cost(theta: float, cx: float, cy: float, half: float, xy: np.ndarray) -> float:
    """Sum of squared distances to the segment of given centre and half length."""
    u = np.array([math.cos(theta), math.sin(theta)])
    d = xy - (cx, cy)
    t = np.clip(d @ u, -half, half)
    return float(((d - t[:, None] * u) ** 2).sum())


def fit_segment(ends: tuple[float, float, float, float], xy: np.ndarray, iterations: int = 25) -> tuple[float, float, float, float, float]:
    """Turns a segment about its centre to fit the points: new ends (first along +direction) and the cost. Damped Gauss-Newton in the angle."""
    x0, y0, x1, y1 = ends
    cx, cy, half = (x0 + x1) / 2, (y0 + y1) / 2, math.hypot(x1 - x0, y1 - y0) / 2
    theta = math.atan2(y0 - y1, x0 - x1)
    if not len(xy) or half == 0:
        return (*_ends(cx, cy, half, theta), 0.0)
    d = xy - (cx, cy)
    cost, damp = segment_cost(theta, cx, cy, half, xy), 1e-4
    for _ in range(iterations):
        u, v = np.array([math.cos(theta), math.sin(theta)]), np.array([-math.sin(theta), math.cos(theta)])
        t = d @ u
        inside = np.abs(t) <= half
        # inside: the residual is the offset, which turns by -t; beyond an end: the vector to the end turns with it
        end = np.clip(t, -half, half)
        r = d - end[:, None] * u
        g = -(r @ v * end).sum()
        h = np.where(inside, t * t, half * half).sum()
        step = -g / (h * (1 + damp) + 1e-12)
        new = segment_cost(theta + step, cx, cy, half, xy)
        if new < cost:
            theta, cost, damp = theta + step, new, damp / 3
            if abs(step) < 1e-10:
                break
        else:
            damp = damp * 10 + 1e-6
            if damp > 1e8:
                break
    return (*_ends(cx, cy, half, theta), cost)


def adjust_segment(ends: tuple[float, float, float, float], xy: np.ndarray, inlier: float = 0.03, settled: float = 0.05, rounds: int = 50) -> tuple[tuple[float, float, float, float], int, int]:
    """Inliers, refit, new ends, until both ends move at most ``settled``: ends, inliers of the last fit, rounds."""
    n = 0
    for k in range(1, rounds + 1):
        x0, y0, x1, y1 = ends
        d = np.array([x1 - x0, y1 - y0])
        t = np.clip((xy - (x0, y0)) @ d / max(d @ d, 1e-300), 0, 1)
        off = np.hypot(*(xy - (x0, y0) - t[:, None] * d).T)
        own = xy[off < inlier]
        n = len(own)
        fitted = fit_segment(ends, own)[:4]
        # the fit keeps the direction from the second end to the first
        moved = max(math.hypot(fitted[0] - x0, fitted[1] - y0), math.hypot(fitted[2] - x1, fitted[3] - y1))
        ends = fitted
        if moved <= settled:
            return ends, n, k
    return ends, n, rounds


def wrap(a):
    return np.arctan2(np.sin(a), np.cos(a))


class Chain:
    """Poses in a row: odometry edges between neighbours, targets on single poses, the first pose fixed. ``starts``: many such rows one after another, solved together.

    Targets are frozen numbers, so the normal matrix is block tridiagonal and a damped step is one sweep, O(n).
    """

    def __init__(self, poses: np.ndarray, targets: list[tuple], sd=(0.03, 0.03, 0.01), starts=(0,)):
        """``targets``: (index, kind, x, y, th, penalty direction); kinds as in Correction."""
        self.sd = np.asarray(sd)
        starts = np.asarray(starts)
        self.chain = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(poses))))
        self.place = np.arange(len(poses)) - starts[self.chain]
        self.edge = i = np.flatnonzero(self.place[1:])
        d = poses[i + 1, :2] - poses[i, :2]
        c, s = np.cos(poses[i, 2]), np.sin(poses[i, 2])
        rel = np.stack([c * d[:, 0] + s * d[:, 1], c * d[:, 1] - s * d[:, 0]], 1)
        self.turn = wrap(poses[i + 1, 2] - poses[i, 2])
        self.radial = n = np.hypot(*rel.T)
        self.dir = np.where(n[:, None] > 0, rel / np.where(n > 0, n, 1)[:, None], [1.0, 0.0])
        t = np.asarray(targets, float).reshape(-1, 6)
        t = t[self.place[t[:, 0].astype(int)] > 0]
        self.at, self.goal = t[:, 0].astype(int), t[:, 2:5]
        whole, along = np.isin(t[:, 1], (1, 2)), t[:, 1] == 4
        self.look = np.zeros((len(t), 3, 3))  # what of the difference counts; a row of nothing is no residual
        self.look[whole] = np.eye(3)
        self.look[along, 0, 0], self.look[along, 0, 1] = np.cos(t[along, 5]), np.sin(t[along, 5])
        self.look[:, 2, 2] = 1

    def _of(self, chosen: np.ndarray) -> Chain:
        """Only the chosen chains."""
        out = copy.copy(self)
        rows, edges, targets = (chosen[self.chain[k]] for k in (slice(None), self.edge, self.at))
        number, at = np.cumsum(chosen) - 1, np.cumsum(rows) - 1
        out.chain, out.place = number[self.chain[rows]], self.place[rows]
        out.edge, out.turn, out.radial, out.dir = at[self.edge[edges]], self.turn[edges], self.radial[edges], self.dir[edges]
        out.at, out.goal, out.look = at[self.at[targets]], self.goal[targets], self.look[targets]
        return out

    def residuals(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of edges and of targets, three each."""
        i = self.edge
        d = p[i + 1, :2] - p[i, :2]
        c, s = np.cos(p[i, 2]), np.sin(p[i, 2])
        lx, ly = c * d[:, 0] + s * d[:, 1], c * d[:, 1] - s * d[:, 0]
        r = np.stack([self.dir[:, 0] * lx + self.dir[:, 1] * ly - self.radial, self.dir[:, 0] * ly - self.dir[:, 1] * lx, wrap(p[i + 1, 2] - p[i, 2] - self.turn)], 1) / self.sd
        own = self.goal - p[self.at]
        own[:, 2] = wrap(own[:, 2])
        return r, (self.look @ own[..., None])[..., 0]

    def cost(self, p: np.ndarray) -> np.ndarray:
        """Of each chain."""
        r, own = self.residuals(p)
        n = self.chain[-1] + 1
        return (np.bincount(self.chain[self.edge], (r * r).sum(1), n) + np.bincount(self.chain[self.at], (own * own).sum(1), n)) / 2

    def normal(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Diagonal blocks, blocks right of them, and gradient."""
        n, i = len(p), self.edge
        diag, up, grad = np.zeros((n, 3, 3)), np.zeros((n, 3, 3)), np.zeros((n, 3))
        r, own = self.residuals(p)
        d = p[i + 1, :2] - p[i, :2]
        c, s = np.cos(p[i, 2]), np.sin(p[i, 2])
        lx, ly = c * d[:, 0] + s * d[:, 1], c * d[:, 1] - s * d[:, 0]
        u, v = self.dir.T
        j1 = np.zeros((len(i), 3, 3))  # by the later pose
        j1[:, 0, 0], j1[:, 0, 1] = u * c - v * s, u * s + v * c
        j1[:, 1, 0], j1[:, 1, 1] = -u * s - v * c, u * c - v * s
        j1[:, 2, 2] = 1
        j0 = -j1.copy()
        j0[:, 0, 2], j0[:, 1, 2] = u * ly - v * lx, -u * lx - v * ly
        j1, j0 = j1 / self.sd[None, :, None], j0 / self.sd[None, :, None]
        t0, t1 = j0.transpose(0, 2, 1), j1.transpose(0, 2, 1)
        diag[i] += t0 @ j0
        diag[i + 1] += t1 @ j1
        up[i] = t0 @ j1
        grad[i] += (t0 @ r[..., None])[..., 0]
        grad[i + 1] += (t1 @ r[..., None])[..., 0]
        turned = self.look.transpose(0, 2, 1)
        np.add.at(diag, self.at, turned @ self.look)
        np.add.at(grad, self.at, -(turned @ own[..., None])[..., 0])
        return diag, up, grad

    def solve(self, p: np.ndarray, iterations: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Levenberg-Marquardt, each chain damped and ended on its own: poses; first and last cost and steps taken of each chain."""
        p, first = p.copy(), self.cost(p)
        cost, damp, steps = first.copy(), np.full(len(first), 1e-4), np.zeros(len(first), int)
        going = np.isfinite(cost)
        for k in range(1, iterations + 1):
            if not going.any():
                break
            steps[going] = k
            now, ids, rows = self._of(going), np.flatnonzero(going), np.flatnonzero(going[self.chain])
            diag, up, grad = now.normal(p[rows])
            steep = np.maximum.reduceat(np.where(now.place > 0, np.abs(grad).max(1), 0), np.flatnonzero(now.place == 0))
            gain = np.full(len(ids), -1.0)
            left = ~(steep < 1e-10)
            while (left := left & (damp[ids] < 1e12)).any():
                some, own, at = now._of(left), ids[left], left[now.chain]
                a = diag[at]
                a = a + damp[own][some.chain, None, None] * np.einsum("nii->ni", a)[:, :, None] * np.eye(3) + 1e-12 * np.eye(3)
                q = p[rows[at]] + self._sweep(a, up[at], -grad[at], some.place)
                new = some.cost(q)
                better = new < cost[own]
                gain[np.flatnonzero(left)[better]] = (cost[own] - new)[better]
                taken = better[some.chain]
                p[rows[at][taken]] = q[taken]
                cost[own[better]] = new[better]
                damp[own] = np.where(better, np.maximum(damp[own] / 5, 1e-12), damp[own] * 10)
                left[np.flatnonzero(left)[better]] = False
            going[ids] = gain >= 1e-12 * np.maximum(cost[ids], 1e-12)
        p[:, 2] = wrap(p[:, 2])
        return p, first, cost, steps

    @staticmethod
    def _sweep(diag: np.ndarray, up: np.ndarray, rhs: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Cyclic reduction over all but the first pose of each chain, all blocks of a level at once; first poses don't move."""
        free = np.flatnonzero(np.arange(len(diag)) if place is None else place)
        x = np.zeros((len(diag), 3))
        if len(free):
            x[free] = _reduced(diag[free], up[free[:-1]], rhs[free, :, None], None if place is None else place[free] - 1)[..., 0]
        return x


def _reduced(diag: np.ndarray, up: np.ndarray, rhs: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Solves a symmetric block-tridiagonal system: the blocks at even places are eliminated, the odd ones are such a system again.

    ``place``: of each block in its own system, where many stand one after another; blocks of ``up`` between two systems don't count.
    """
    n = len(diag)
    place = np.arange(n) if place is None else place
    goes_on = np.append(place[1:] > 0, False)
    e, o = np.flatnonzero(place % 2 == 0), np.flatnonzero(place % 2)
    at = np.empty(n, int)
    at[e], at[o] = np.arange(len(e)), np.arange(len(o))
    # of each even place: its block's inverse times what couples it to the place before and after, and its right side
    has_before, has_after = np.flatnonzero(place[e]), np.flatnonzero(goes_on[e])
    before, after = np.zeros((len(e), 3, 3)), np.zeros((len(e), 3, 3))
    before[has_before] = up[e[has_before] - 1].transpose(0, 2, 1)
    after[has_after] = up[e[has_after]]
    both = np.linalg.solve(diag[e], np.concatenate([before, after, rhs[e]], 2))
    to_before, to_after, own = both[..., :3], both[..., 3:6], both[..., 6:]
    out = np.empty_like(rhs)
    out[e] = own
    if len(o):
        # the even place left of an odd one, then the one right of it, if there is one
        k = at[o - 1]
        left = after[k].transpose(0, 2, 1)
        new_diag, new_rhs, new_up = diag[o] - left @ to_after[k], rhs[o] - left @ own[k], np.zeros((len(o), 3, 3))
        r = np.flatnonzero(goes_on[o])
        k = at[o[r] + 1]
        right = before[k].transpose(0, 2, 1)
        new_diag[r] -= right @ to_before[k]
        new_rhs[r] -= right @ own[k]
        new_up[r] = -(right @ to_after[k])
        out[o] = found = _reduced(new_diag, new_up, new_rhs, place[o] // 2)
        out[e[has_after]] -= to_after[has_after] @ found[at[e[has_after] + 1]]
        out[e[has_before]] -= to_before[has_before] @ found[at[e[has_before] - 1]]
    return out


def together(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = TOGETHER) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups: some ``rows`` each, or one longer group. Keys are whole numbers, never null."""
    held: list[pa.Table] = []
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if sum(map(len, held)) >= rows:
            other = np.logical_or.reduce([part.column(k).to_numpy() != held[-1].column(k)[-1].as_py() for k in keys])
            if other.any():
                at = int(other.argmax())
                yield pa.concat_tables([*held, part.slice(0, at)])
                held, part = [], part.slice(at)
        if len(part):
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def joint_solve(poses: DataFrame, constraints: DataFrame) -> DataFrame:
    """(graph_id, pose_id, x, y, th, cost_before, cost_after): every graph's chain with its targets.

    ``constraints``: graph_id, type, constrained_id, tx, ty, tth, penalty. A graph's poses and targets are read in order,
    O(n) work; a task solves graphs of some TOGETHER rows at once, so its numpy calls are few, and holds no more, or one graph.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, ["_none", "_g"]):
            target = table.column("_target").to_numpy()
            pose, others = np.flatnonzero(~target), np.flatnonzero(target)
            if not len(pose):
                continue
            before = np.cumsum(~target)[others] - 1  # the pose that a target follows is its own, or it has none
            ids = [table.column(k).to_numpy() for k in ("_none", "_g", "pose_id")]
            known = np.logical_and.reduce([before >= 0, *(k[others] == k[pose[before]] for k in ids)])
            others, before = others[known], before[known]
            xyt = np.column_stack([table.column(k).to_numpy() for k in ("x", "y", "th")])
            kind, penalty = (table.column(k).to_numpy()[others] for k in ("type", "penalty"))
            starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[pose[1:]] != k[pose[:-1]] for k in ids[:2]])))
            chain = Chain(xyt[pose], np.column_stack([before, kind, xyt[others], penalty]), starts=starts)
            solved, first, last, _ = chain.solve(xyt[pose])
            own = table.select(["graph_id", "pose_id"]).take(pa.array(pose))
            for k, v in zip(("x", "y", "th", "cost_before", "cost_after"), (*solved.T, first[chain.chain], last[chain.chain]), strict=True):
                own = own.append_column(k, pa.array(v))
            yield from own.to_batches(10_000)

    a = poses.select("graph_id", F.col("pose_id").cast("int").alias("pose_id"), F.lit(False).alias("_target"), F.lit(0.0).alias("type"), "x", "y", "th", F.lit(0.0).alias("penalty"))
    b = constraints.select("graph_id", F.col("constrained_id").cast("int"), F.lit(True), F.col("type").cast("double"), "tx", "ty", "tth", "penalty")
    rows = a.union(b).withColumns({"_none": F.col("graph_id").isNull().cast("int"), "_g": F.coalesce(F.col("graph_id").cast("long"), F.lit(0))})
    parts = int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "_none", "_g").sortWithinPartitions("_none", "_g", "pose_id", "_target")
    return rows.mapInArrow(run, "graph_id long, pose_id int, x double, y double, th double, cost_before double, cost_after double")


def fit_segments(points: DataFrame, inlier: float = 0.03) -> DataFrame:
    """(graph_id, sel_id, x0, y0, x1, y1, n_inliers, rounds): each selected segment settled on its graph's points.

    ``points`` has sel_id, the segment's ends and the points in a generous reach of it; one segment's points are a group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["wx", "wy"])
        ends = tuple(float(frame[k].iloc[0]) for k in ("x0", "y0", "x1", "y1"))
        new, n, rounds = adjust_segment(ends, frame[["wx", "wy"]].to_numpy(), inlier)
        return pd.DataFrame([(int(frame.graph_id.iloc[0]), int(frame.sel_id.iloc[0]), *new, n, rounds)], columns=["graph_id", "sel_id", "x0", "y0", "x1", "y1", "n_inliers", "rounds"])

    return points.groupBy("graph_id", "sel_id").applyInPandas(run, "graph_id long, sel_id int, x0 double, y0 double, x1 double, y1 double, n_inliers int, rounds int")
