"""Corrections: deltas of the selected poses, motion of the rest, targets, and back-propagation as prefix sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rotate, wrap
from ..schema import Correction

Points = Sequence[tuple[float, float]]


def motion(kind: int, points: Points) -> tuple[float, tuple[float, float], tuple[float, float]]:
    """Angle, pivot and where the pivot goes, of a correction that moves segment A (points 0, 1) to B (points 2, 3)."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = points
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    if not (math.hypot(ux, uy) and math.hypot(vx, vy)):
        raise ValueError("a segment has no length")
    theta = math.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    mid_a, mid_b = ((ax + bx) / 2, (ay + by) / 2), ((cx + dx) / 2, (cy + dy) / 2)
    if kind == Correction.SEGMENT:
        return theta, mid_a, mid_b
    if kind == Correction.COLLINEAR:
        n = math.hypot(vx, vy)
        t = ((mid_a[0] - mid_b[0]) * vx + (mid_a[1] - mid_b[1]) * vy) / (n * n)
        return theta, mid_a, (mid_b[0] + t * vx, mid_b[1] + t * vy)
    if kind == Correction.PERPENDICULAR:
        turn = 0.0 if abs(theta) == math.pi / 2 else theta - math.pi / 2 if theta > 0 else theta + math.pi / 2
        return turn, mid_a, mid_a
    if kind == Correction.PARALLEL:
        return theta, mid_a, mid_a
    raise ValueError(f"no motion for kind {kind}")


def motions(kind, a: tuple, b: tuple) -> tuple:
    """``motion`` as columns, for corrections of many graphs at once: the kind, and the segments' ends (x0, y0, x1, y1) as columns."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    theta = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    mid_a, mid_b = ((ax + bx) / 2, (ay + by) / 2), ((cx + dx) / 2, (cy + dy) / 2)
    t = ((mid_a[0] - mid_b[0]) * vx + (mid_a[1] - mid_b[1]) * vy) / (vx * vx + vy * vy)
    turn = F.when(F.abs(theta) == math.pi / 2, 0.0).when(theta > 0, theta - math.pi / 2).otherwise(theta + math.pi / 2)
    is_ = lambda k: kind == int(k)
    to = [F.when(is_(Correction.SEGMENT), m).when(is_(Correction.COLLINEAR), m + t * v).otherwise(own) for m, v, own in zip(mid_b, (vx, vy), mid_a, strict=True)]
    return F.when(is_(Correction.PERPENDICULAR), turn).otherwise(theta), mid_a, tuple(to)


def point_motion(source: tuple[float, float], target: tuple[float, float]) -> tuple[float, tuple[float, float], tuple[float, float]]:
    return 0.0, source, target


def closest_pair_motion(found: DataFrame) -> DataFrame:
    """(graph_id, sel_id, constrained_id, anchor_id, dx, dy) from the closest observations of two picks, 0 and 1, of a selection.

    The observation of the later pose is moved onto the other one; of one pose's two, that of pick 0.
    """
    ends = [found.where(F.col("pick_id") == k).select("graph_id", "sel_id", *[F.col(c).alias(f"{c}{k}") for c in ("pose_id", "wx", "wy")]) for k in (0, 1)]
    both = ends[0].join(ends[1], ["graph_id", "sel_id"])
    later = F.col("pose_id0") >= F.col("pose_id1")
    sign = F.when(later, 1.0).otherwise(-1.0)
    ids = [F.when(later, F.col(f"pose_id{a}")).otherwise(F.col(f"pose_id{b}")) for a, b in ((0, 1), (1, 0))]
    return both.select("graph_id", "sel_id", ids[0].alias("constrained_id"), ids[1].alias("anchor_id"), (sign * (F.col("wx1") - F.col("wx0"))).alias("dx"), (sign * (F.col("wy1") - F.col("wy0"))).alias("dy"))


def corner_motion(source: Points, target: Points) -> tuple[float, tuple[float, float], tuple[float, float]]:
    """The rigid motion that takes matched points onto each other best, in closed form."""
    n = len(source)
    ms, mt = (tuple(sum(p[k] for p in ps) / n for k in (0, 1)) for ps in (source, target))
    s = sum((a[0] - ms[0]) * (b[1] - mt[1]) - (a[1] - ms[1]) * (b[0] - mt[0]) for a, b in zip(source, target, strict=True))
    c = sum((a[0] - ms[0]) * (b[0] - mt[0]) + (a[1] - ms[1]) * (b[1] - mt[1]) for a, b in zip(source, target, strict=True))
    return math.atan2(s, c), ms, mt


def deltas(poses: DataFrame, kind: int, points: Points) -> DataFrame:
    """(graph_id, pose_id, dx, dy, dth): how far each pose goes."""
    theta, (px, py), (qx, qy) = motion(kind, points)
    rx, ry = rotate(F.col("x") - px, F.col("y") - py, F.lit(theta))
    return poses.select("graph_id", "pose_id", (F.lit(qx) + rx - F.col("x")).alias("dx"), (F.lit(qy) + ry - F.col("y")).alias("dy"), F.lit(theta).alias("dth"))


def apply(poses: DataFrame, kind: int, points: Points, first: int, last: int) -> DataFrame:
    """Poses first to last move; all later ones turn about the moved last one and shift by its delta again."""
    return carry(poses, motion(kind, points), first, last)


def carry(poses: DataFrame, by: tuple, first, last) -> DataFrame:
    """``apply`` for any motion (angle, pivot, where the pivot goes); numbers, or columns of the poses that are the same over a graph."""
    theta, (px, py), (qx, qy) = by

    def moved(x, y):
        rx, ry = rotate(x - px, y - py, F.lit(theta))
        return F.lit(qx) + rx, F.lit(qy) + ry

    pivot = poses.where(F.col("pose_id") == F.lit(last)).select("graph_id", F.col("x").alias("lx"), F.col("y").alias("ly"))
    with_pivot = poses.join(pivot, "graph_id", "left")
    nx, ny = moved(F.col("x"), F.col("y"))
    mx, my = moved(F.col("lx"), F.col("ly"))
    sx, sy = rotate(F.col("x") - mx, F.col("y") - my, F.lit(theta))
    here, after = F.col("pose_id").between(first, last), (F.col("pose_id") > last) & F.col("lx").isNotNull()
    keep = [c for c in poses.columns if c not in ("x", "y", "th")]
    return with_pivot.select(
        *keep,
        F.when(here, nx).when(after, mx + sx + (mx - F.col("lx"))).otherwise(F.col("x")).alias("x"),
        F.when(here, ny).when(after, my + sy + (my - F.col("ly"))).otherwise(F.col("y")).alias("y"),
        (F.col("th") + F.when(here | after, F.lit(theta)).otherwise(0.0)).alias("th"),
    )


def targets(poses: DataFrame, anchors: tuple[int, int], corrected: tuple[int, int], direction: float) -> DataFrame:
    """Every anchor with every corrected pose of its graph: the corrected pose in the anchor's frame, and the penalty direction."""
    a = poses.where(F.col("pose_id").between(*anchors)).select("graph_id", F.col("pose_id").alias("anchor_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("th").alias("ath"))
    b = poses.where(F.col("pose_id").between(*corrected)).select("graph_id", F.col("pose_id").alias("constrained_id"), "x", "y", "th")
    return framed(a.join(b, "graph_id"), direction)


def framed(pairs: DataFrame, direction) -> DataFrame:
    """``targets`` of given pairs: anchors (anchor_id, ax, ay, ath) beside corrected poses (constrained_id, x, y, th)."""
    rx, ry = rotate(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), -F.col("ath"))
    return pairs.select(
        "graph_id", "anchor_id", "constrained_id", rx.alias("delta_parallel"), ry.alias("delta_perpendicular"),
        wrap(F.col("th") - F.col("ath")).alias("delta_angle"), (wrap(F.lit(direction) - F.col("ath")) + math.pi / 2).alias("penalty_dir"),
    )


def backpropagate(poses: DataFrame, lo, hi, correction: tuple, rot_prior: float = 1e-4, trans_prior: float = 1e-3) -> DataFrame:
    """Poses lo to hi take up the correction by the share of their variance; in two prefix sums, not a pass per pose.

    (graph_id, pose_id, x, y, th) of that range; columns var_t and var_r are the variances. The range and the correction are
    numbers, or columns of the poses that are the same over a graph.
    """
    w = Window.partitionBy("graph_id").orderBy("pose_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("graph_id")
    r = poses.where(F.col("pose_id").between(lo, hi)).select(
        "graph_id", "pose_id", "x", "y", "th",
        (F.col("var_r") / (F.sum("var_r").over(every) + rot_prior)).alias("wr"),
        (F.col("var_t") / (F.sum("var_t").over(every) + trans_prior)).alias("wt"),
        (F.lead("x").over(w) - F.col("x")).alias("ex"), (F.lead("y").over(w) - F.col("y")).alias("ey"),
        *[F.lit(v).alias(k) for k, v in zip(("_cx", "_cy", "_ct", "_hi"), (*correction, hi), strict=True)],
    )
    d = r.withColumn("dk", F.col("_ct") * F.sum("wr").over(w))
    rx, ry = rotate("ex", "ey", "dk")
    e = d.withColumns({"rx": rx, "ry": ry})
    none = F.lit(0.0)
    f = e.select(
        "graph_id", "pose_id",
        (F.first("x").over(w) + F.coalesce(F.sum("rx").over(before), none)).alias("x1"),
        (F.first("y").over(w) + F.coalesce(F.sum("ry").over(before), none)).alias("y1"),
        (F.col("th") + F.when(F.col("pose_id") < F.col("_hi"), F.col("dk")).otherwise(F.coalesce(F.lag("dk").over(w), none))).alias("th"),
        F.coalesce(F.sum("wt").over(before), none).alias("cw"), "x", "y", "_cx", "_cy", "_hi",
    )
    end = F.col("pose_id") == F.col("_hi")
    tx = F.max(F.when(end, F.col("x") + F.col("_cx") - F.col("x1"))).over(every)
    ty = F.max(F.when(end, F.col("y") + F.col("_cy") - F.col("y1"))).over(every)
    return f.select("graph_id", "pose_id", (F.col("x1") + F.col("cw") * F.coalesce(tx, none)).alias("x"), (F.col("y1") + F.col("cw") * F.coalesce(ty, none)).alias("y"), "th")


#: Places in a row-major 3x3 covariance that the rotation's factor scales; the others take the translation's.
ROTATIONAL = (2, 5, 6, 7, 8)


def scale_covariances(poses: DataFrame, lo: int, hi: int, rot_prior: float = 1e-4, trans_prior: float = 1e-3, compat: bool = False) -> DataFrame:
    """Column cov of poses lo to hi - 1 scaled by beta = 1 / (1 + variance of pose hi - 1 / prior).

    ``compat``: the asymmetric variant, which scales (0, 2) twice and (1, 2) never.
    """
    last = poses.where(F.col("pose_id") == hi - 1).select("graph_id", (1 / (1 + F.col("var_r") / rot_prior)).alias("_br"), (1 / (1 + F.col("var_t") / trans_prior)).alias("_bt"))

    def factor(i):
        rot = F.when(i == 2, F.col("_br") * F.col("_br")).when(i == 5, F.lit(1.0)) if compat else F
        return rot.when(i.isin(*ROTATIONAL), F.col("_br")).otherwise(F.col("_bt"))

    scaled = F.transform("cov", lambda v, i: v * factor(i))
    inside = F.col("pose_id").between(lo, hi - 1) & F.col("_br").isNotNull()
    return poses.join(last, "graph_id", "left").withColumn("cov", F.when(inside, scaled).otherwise(F.col("cov"))).drop("_br", "_bt")
