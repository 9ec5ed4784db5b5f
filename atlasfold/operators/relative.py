"""Residuals of points under relative poses, and the gradient of their cost by each relative pose.

A trajectory is given as what each pose adds to the one before: plain sums of
components, or motions composed with their turns. Forward, poses are prefix
sums; back, a pose's adjoint counts for every relative pose before it, so
gradients are suffix sums of adjoints. Both are windows over (graph_id,
pose_id); residuals themselves are per point and need none.

Defined results: points of unknown poses are left out; poses without points
have no residual and still pass on the adjoints of later ones; null components
of a relative pose are nought; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import residuals as r
from ..functions.geometry import rotate, to_world

POSE = ("x", "y", "th")


def _forward() -> Window:
    return Window.partitionBy("graph_id").orderBy("pose_id").rowsBetween(Window.unboundedPreceding, 0)


def summed(relative: DataFrame) -> DataFrame:
    """(graph_id, pose_id, x, y, th) where each component is a plain sum of dx, dy, dth."""
    return relative.select("graph_id", "pose_id", *[F.sum(F.coalesce(f"d{k}", F.lit(0.0))).over(_forward()).alias(k) for k in POSE])


def composed(relative: DataFrame) -> DataFrame:
    """The same where each dx, dy is in the frame of the pose before; th isn't wrapped."""
    dx, dy, dth = (F.coalesce(f"d{k}", F.lit(0.0)) for k in POSE)
    turned = relative.withColumn("th", F.sum(dth).over(_forward()))
    mx, my = rotate(dx, dy, F.col("th") - dth)
    return turned.select("graph_id", "pose_id", F.sum(mx).over(_forward()).alias("x"), F.sum(my).over(_forward()).alias("y"), "th")


def point_residuals(poses: DataFrame, points: DataFrame, sd: float = 1.0, factor: float = 1.0, seen_through: bool = False) -> DataFrame:
    """Of every point (graph_id, pose_id, obs_id, px, py, and its line nx, ny, offset, with ends x0..y1 if ``seen_through``): r, and its derivatives rx, ry, rth by the pose.

    ``seen_through`` counts only points behind the segment, as the robot sees them; the rest, and their derivatives, are nought.
    """
    own = points.join(poses.select("graph_id", "pose_id", *POSE), ["graph_id", "pose_id"])
    wx, wy = to_world("px", "py", "x", "y", "th")
    value = r.point_to_line(wx, wy, "nx", "ny", "offset", sd, factor)
    counts = F.lit(True)
    if seen_through:
        value = r.visibility(wx, wy, "x", "y", "x0", "y0", "x1", "y1", "nx", "ny", "offset", sd, factor)
        counts = value != 0
    k = factor / sd
    turn = F.col("ny") * (wx - F.col("x")) - F.col("nx") * (wy - F.col("y"))
    slopes = {"rx": F.col("nx") * k, "ry": F.col("ny") * k, "rth": turn * k}
    return own.select("graph_id", "pose_id", "obs_id", value.alias("r"), *[F.when(counts, v).otherwise(0.0).alias(name) for name, v in slopes.items()])


def per_pose(points: DataFrame) -> DataFrame:
    """(graph_id, pose_id, root, ax, ay, ath): the root of the sum of squares, and the adjoints of half that sum."""
    return points.groupBy("graph_id", "pose_id").agg(r.root_sum("r").alias("root"), *[F.sum(F.col("r") * F.col(f"r{k}")).alias(f"a{k}") for k in POSE])


def _back(x: Column) -> Column:
    w = Window.partitionBy("graph_id").orderBy("pose_id").rowsBetween(0, Window.unboundedFollowing)
    return F.sum(x).over(w)


def gradients(relative: DataFrame, adjoints: DataFrame, turned: bool) -> DataFrame:
    """(graph_id, pose_id, gx, gy, gth): of the summed half squares by every relative pose; ``turned`` if they are composed with their turns."""
    poses = composed(relative) if turned else summed(relative)
    own = relative.select("graph_id", "pose_id", F.coalesce("dth", F.lit(0.0)).alias("dth")).join(poses, ["graph_id", "pose_id"]).join(adjoints.select("graph_id", "pose_id", "ax", "ay", "ath"), ["graph_id", "pose_id"], "left").fillna(0.0, ["ax", "ay", "ath"])
    sums = own.withColumns({"_x": _back(F.col("ax")), "_y": _back(F.col("ay"))})
    if not turned:
        return sums.select("graph_id", "pose_id", F.col("_x").alias("gx"), F.col("_y").alias("gy"), _back(F.col("ath")).alias("gth"))
    # a turn moves all later poses about its own
    sums = sums.withColumn("_t", _back(F.col("ath") + F.col("ay") * F.col("x") - F.col("ax") * F.col("y")))
    gx, gy = rotate("_x", "_y", -(F.col("th") - F.col("dth")))
    return sums.select("graph_id", "pose_id", gx.alias("gx"), gy.alias("gy"), (F.col("_t") + F.col("y") * F.col("_x") - F.col("x") * F.col("_y")).alias("gth"))
