"""A correction session over one pose graph: collect points, verify, select, move, distribute, solve; undo and replay."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import length, to_world, wrap
from ..operators import correct, select, solve
from ..schema import VALID, Config, Correction
from ..snapshot import snapshot


@dataclass(frozen=True)
class Pending:
    """What the clicks so far have given: the kind that is being entered, its points, and the kind that is complete (0: none)."""

    kind: int = 0
    points: tuple = ()
    done: int = 0


def add_points(state: Pending, kind: int, down: tuple[float, float], up: tuple[float, float]) -> Pending:
    """The first entry of a kind starts it, the second of the same kind completes it; another kind starts anew."""
    if kind == Correction.UNKNOWN:
        return state
    own = (down,) if kind == Correction.POINT else (down, up)
    if kind not in VALID:
        return replace(state, done=kind)
    if kind != state.kind:
        return Pending(kind, own)
    return Pending(0, state.points + own, kind)


@dataclass
class Session:
    """Poses (graph_id, pose_id, x, y, th, var_t, var_r) and scans (graph_id, pose_id, obs_id, px, py) of one graph."""

    poses: DataFrame
    scans: DataFrame
    config: Config = field(default_factory=Config)
    history: list = field(default_factory=list)
    constraints: list = field(default_factory=list)
    _before: tuple | None = None

    def world(self) -> DataFrame:
        """Points in the world frame: a view, never stored."""
        wx, wy = to_world("px", "py", "x", "y", "th")
        return self.scans.join(self.poses.select("graph_id", "pose_id", "x", "y", "th"), ["graph_id", "pose_id"]).withColumns({"wx": wx, "wy": wy})

    def verify(self, points) -> bool:
        """Whether every picked point has a world point near, and both segments have length."""
        if len(points) != 4 or any(math.dist(points[k], points[k + 1]) == 0 for k in (0, 2)):
            return False
        spark = self.poses.sparkSession
        picks = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "sel_id int, pick_id int, qx double, qy double")
        return select.verified(self.world(), picks, self.config.verify).where(~F.col("ok")).limit(1).count() == 0

    def settle(self, points) -> list[tuple[float, float]]:
        """Both segments refitted to their inliers: one job picks the points of a generous envelope, a kernel iterates."""
        out = []
        for k in (0, 2):
            (x0, y0), (x1, y1) = points[k], points[k + 1]
            reach = math.dist(points[k], points[k + 1]) / 2 + 10 * self.config.inlier
            near = length(F.col("wx") - (x0 + x1) / 2, F.col("wy") - (y0 + y1) / 2) < reach
            rows = self.world().where(near).select("graph_id", F.lit(k).alias("sel_id"), *[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)], "wx", "wy")
            got = solve.fit_segments(rows, self.config.inlier).first()
            out += [(got.x0, got.y0), (got.x1, got.y1)] if got else [points[k], points[k + 1]]
        return out

    def correct(self, kind: int, points, record: bool = True) -> str:
        """Runs one correction; says ok, or why the poses stay: invalid, unverified, empty, full_overlap, interleaved."""
        if kind not in VALID or kind == Correction.POINT:
            return "invalid"
        if not self.verify(points):
            return "unverified"
        cfg, spark = self.config, self.poses.sparkSession
        points = self.settle(points)
        segments = spark.createDataFrame([(k // 2 + 1, *map(float, (*points[k], *points[k + 1]))) for k in (0, 2)], "sel_id int, x0 double, y0 double, x1 double, y1 double")
        chosen = select.selected_poses(self.world(), segments, cfg.inlier, cfg.min_inliers)
        filtered = select.overlap(chosen)
        bounds = select.ordered_bounds(filtered).first()
        if bounds is None or bounds.state != "ok":
            return "empty" if bounds is None else bounds.state
        moving, still = (1, 2) if bounds.corrected_sel == 1 else (2, 1)
        a, b = (points[:2], points[2:]) if moving == 1 else (points[2:], points[:2])
        islands = select.contiguous(filtered.where(F.col("sel_id") == moving)).where("group_id = 0").first()
        anchors, corrected = (filtered.where(F.col("sel_id") == k).select(F.col("pose_id").alias(name)) for k, name in ((still, "anchor_id"), (moving, "constrained_id")))
        ends = [df.agg(F.min(df.columns[0]), F.max(df.columns[0])).first() for df in (anchors, corrected)]
        pair = [*a, *b]
        moved = correct.apply(self.poses, kind, pair, islands.first_pose, islands.last_pose)
        first = correct.deltas(self.poses.where(F.col("pose_id") == islands.first_pose), kind, pair).first()
        direction = math.atan2(b[1][1] - b[0][1], b[1][0] - b[0][0])
        new = correct.targets(moved, tuple(ends[0]), tuple(ends[1]), direction)
        new = new.join(anchors, "anchor_id", "left_semi").join(corrected, "constrained_id", "left_semi").withColumn("type", F.lit(int(kind)))
        before = (self.poses, list(self.constraints))
        now = snapshot(moved)
        constraints = [*self.constraints, snapshot(new)]
        if bounds.lo < bounds.hi:
            spread = correct.backpropagate(now, bounds.lo, bounds.hi, (first.dx, first.dy, first.dth), cfg.rot_prior, cfg.trans_prior)
            rest = now.join(spread.select("graph_id", "pose_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("th").alias("_t")), ["graph_id", "pose_id"], "left")
            now = rest.select("graph_id", "pose_id", *[F.coalesce(n, o).alias(o) for n, o in (("_x", "x"), ("_y", "y"), ("_t", "th"))], "var_t", "var_r")
        now = snapshot(now.withColumn("th", wrap("th")))
        self.poses = self._solved(now, constraints)
        self.constraints, self._before = constraints, before
        if record:
            self.history.append([kind, False, list(points)])
        return "ok"

    def _solved(self, poses: DataFrame, constraints: list) -> DataFrame:
        """The chain solved under every constraint so far, its targets taken from the anchors' poses now."""
        every = constraints[0]
        for c in constraints[1:]:
            every = every.unionByName(c)
        anchor = poses.select("graph_id", F.col("pose_id").alias("anchor_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("th").alias("ath"))
        j = every.join(anchor, ["graph_id", "anchor_id"])
        tx, ty = to_world("delta_parallel", "delta_perpendicular", "ax", "ay", "ath")
        t = j.select("graph_id", "type", "constrained_id", tx.alias("tx"), ty.alias("ty"), wrap(F.col("ath") + F.col("delta_angle")).alias("tth"), (F.col("ath") + F.col("penalty_dir")).alias("penalty"))
        solved = solve.joint_solve(poses, t)
        keep = poses.select("graph_id", "pose_id", "var_t", "var_r")
        return snapshot(solved.select("graph_id", "pose_id", "x", "y", "th").join(keep, ["graph_id", "pose_id"]))

    def undo(self) -> bool:
        """One step back, once."""
        if self._before is None:
            return False
        self.poses, self.constraints = self._before
        self._before = None
        if self.history:
            self.history[-1][1] = True
        return True

    def replay(self, entries, skip_undone: bool = False) -> list[str]:
        """The log's corrections in order, without recording them."""
        return [self.correct(kind, points, record=False) for _, kind, undone, points in entries if not (undone and skip_undone)]

    def log(self) -> list:
        return [(i, k, u, p) for i, (k, u, p) in enumerate(self.history)]
