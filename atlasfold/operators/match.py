"""Nearest points and correspondences: equi-joins on grid cells as wide as the threshold, in place of an index.

Two points closer than a cell is wide lie in the same or neighbouring cells,
so queries are sent to nine cells and targets stay in one. The work follows
the number of pairs in reach, and a crowded cell is a skewed join key that
adaptive execution can split.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot, length


def pairs(queries: DataFrame, targets: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Rows of ``queries`` (qx, qy) and ``targets`` (tx, ty) with equal ``keys`` closer than ``threshold``; adds d."""
    reach = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cell = lambda x: F.floor(F.col(x) / threshold)
    q = queries.withColumn("_r", F.explode(reach)).withColumns({"_cx": cell("qx") + F.col("_r.i"), "_cy": cell("qy") + F.col("_r.j")}).drop("_r")
    t = targets.withColumns({"_cx": cell("tx"), "_cy": cell("ty")})
    d = length(F.col("qx") - F.col("tx"), F.col("qy") - F.col("ty"))
    return q.join(t, [*keys, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("d", d).where(F.col("d") < threshold)


def nearest(found: DataFrame, per: list[str], order: list, take: list[str]) -> DataFrame:
    """Of each query's pairs the first by ``order``: one pass of a mergeable minimum, no sort."""
    return found.groupBy(*per).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_n")).select(*per, *[F.col(f"_n.{c}").alias(c) for c in take])


def scan_pairs(points: DataFrame, threshold: float, step: int = 1) -> DataFrame:
    """Each point of a scan with the points of the scan ``step`` poses on, in reach, all in the world frame."""
    q = points.select("graph_id", "pose_id", "obs_id", F.col("wx").alias("qx"), F.col("wy").alias("qy"), F.col("wnx").alias("qnx"), F.col("wny").alias("qny"), (F.col("pose_id") + step).alias("to_pose"))
    t = points.select("graph_id", F.col("pose_id").alias("to_pose"), F.col("obs_id").alias("to_obs"), F.col("wx").alias("tx"), F.col("wy").alias("ty"), F.col("wnx").alias("tnx"), F.col("wny").alias("tny"))
    return pairs(q, t, threshold, ["graph_id", "to_pose"])


def nearest_points(points: DataFrame, threshold: float) -> DataFrame:
    return nearest(scan_pairs(points, threshold), ["graph_id", "pose_id", "obs_id"], [F.col("d"), F.col("to_obs")], ["to_obs", "d"])


def nearest_by_normal(points: DataFrame, threshold: float) -> DataFrame:
    """Of the points in reach, the one least far along the query's normal; exact."""
    found = scan_pairs(points, threshold).withColumn("dn", F.abs(dot("qnx", "qny", F.col("tx") - F.col("qx"), F.col("ty") - F.col("qy"))))
    return nearest(found, ["graph_id", "pose_id", "obs_id"], [F.col("dn"), F.col("to_obs")], ["to_obs", "dn"])


def in_radius(points: DataFrame, threshold: float) -> DataFrame:
    """How many points of the next scan each point has in reach."""
    return scan_pairs(points, threshold).groupBy("graph_id", "pose_id", "obs_id").agg(F.count("*").alias("n"))


def visual_odometry(points: DataFrame, threshold: float, angle_deg: float = 25.0) -> DataFrame:
    """Nearest points of successive scans whose normals agree."""
    found = scan_pairs(points, threshold).where(dot("qnx", "qny", "tnx", "tny") > math.cos(math.radians(angle_deg)))
    return nearest(found, ["graph_id", "pose_id", "obs_id"], [F.col("d"), F.col("to_obs")], ["to_obs", "d"])


def all_pairs(points: DataFrame, threshold: float, window: int = 10, angle_deg: float = 25.0, cap: int = 5, more_than: int = 10, stride: int = 1) -> DataFrame:
    """Matches between all ordered pairs of scans at most ``window`` poses apart.

    Each point of a scan has its best match by normal in every other scan; a point counts for its first
    ``cap`` scans; pairs of scans are kept with over ``more_than`` matches.
    """
    q = points.where(F.col("obs_id") % stride == 0).select("graph_id", "pose_id", "obs_id", F.col("wx").alias("qx"), F.col("wy").alias("qy"), F.col("wnx").alias("qnx"), F.col("wny").alias("qny"))
    t = points.select("graph_id", F.col("pose_id").alias("to_pose"), F.col("obs_id").alias("to_obs"), F.col("wx").alias("tx"), F.col("wy").alias("ty"), F.col("wnx").alias("tnx"), F.col("wny").alias("tny"))
    # poses in reach of each other lie in the same or neighbouring stretches of the trajectory
    stretch = lambda x: F.floor(F.col(x) / max(1, window))
    q = q.withColumn("_w", F.explode(F.array(*[stretch("pose_id") + k for k in (-1, 0, 1)])))
    near = pairs(q, t.withColumn("_w", stretch("to_pose")), threshold, ["graph_id", "_w"]).drop("_w").where((F.col("pose_id") != F.col("to_pose")) & (F.abs(F.col("pose_id") - F.col("to_pose")) <= window))
    near = near.where(dot("qnx", "qny", "tnx", "tny") > math.cos(math.radians(angle_deg)))
    near = near.withColumn("dn", F.abs(dot("qnx", "qny", F.col("tx") - F.col("qx"), F.col("ty") - F.col("qy"))))
    best = nearest(near, ["graph_id", "pose_id", "obs_id", "to_pose"], [F.col("dn"), F.col("to_obs")], ["to_obs", "qx", "qy", "tx", "ty", "tnx", "tny"])
    w = Window.partitionBy("graph_id", "pose_id", "obs_id").orderBy("to_pose")
    capped = best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")
    n = F.count("*").over(Window.partitionBy("graph_id", "pose_id", "to_pose"))
    return capped.withColumn("n_matches", n).where(F.col("n_matches") > more_than)


def rms(matches: DataFrame, sd: float, factor: float = 1.0) -> DataFrame:
    """Root mean square along the target's normal of each pair of scans."""
    e = dot("tnx", "tny", F.col("qx") - F.col("tx"), F.col("qy") - F.col("ty")) * factor / sd
    return matches.groupBy("graph_id", "pose_id", "to_pose").agg(F.count("*").alias("n_matches"), F.sqrt(F.avg(e * e)).alias("rms"))
