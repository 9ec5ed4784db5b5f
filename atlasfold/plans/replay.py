"""Corrections of many graphs at once: what a session does for one graph, as joins and groups over all of them.

A round takes one entry of every graph's log, so the number of jobs follows the longest log, not the number of graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import length, rotate, segment_distance, to_world, wrap
from ..operators import correct, select, solve
from ..schema import VALID, Config, Correction
from ..snapshot import snapshot

ENDS = ["x0", "y0", "x1", "y1"]


def _segments(entries: DataFrame) -> DataFrame:
    """(graph_id, sel_id, x0 .. y1): the two segments of each entry's four points."""
    both = [F.struct(F.lit(k + 1).alias("sel_id"), *[F.get("points", F.lit(4 * k + i)).alias(n) for i, n in enumerate(ENDS)]) for k in (0, 1)]
    return entries.select("graph_id", F.explode(F.array(*both)).alias("s")).select("graph_id", "s.*")


def verified(entries: DataFrame, world: DataFrame, threshold: float) -> DataFrame:
    """The entries that can be worked: a kind with two segments that have length, and a world point of their graph near each of the four points."""
    at = [F.get("points", F.lit(i)) for i in range(8)]
    kinds = [k for k in VALID if k != Correction.POINT]
    whole = (F.size("points") == 8) & F.col("type").isin(kinds) & (length(at[2] - at[0], at[3] - at[1]) > 0) & (length(at[6] - at[4], at[7] - at[5]) > 0)
    fit = entries.where(whole)
    near = [F.min(length(F.col("wx") - at[2 * i], F.col("wy") - at[2 * i + 1])).alias(f"d{i}") for i in range(4)]
    met = world.select("graph_id", "wx", "wy").join(fit.select("graph_id", "points"), "graph_id").groupBy("graph_id").agg(*near)
    return fit.join(met.where(F.greatest("d0", "d1", "d2", "d3") < threshold).select("graph_id"), "graph_id", "left_semi")


def settled(segments: DataFrame, world: DataFrame, inlier: float) -> DataFrame:
    """Each segment refitted to its graph's points; one without any in a generous reach stays."""
    mid, half = ((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2), length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    near = length(F.col("wx") - mid[0], F.col("wy") - mid[1]) < half + 10 * inlier
    rows = world.select("graph_id", "wx", "wy").join(segments, "graph_id").where(near)
    fits = solve.fit_segments(rows.select("graph_id", "sel_id", *ENDS, "wx", "wy"), inlier).select("graph_id", "sel_id", *[F.col(k).alias(f"_{k}") for k in ENDS])
    return segments.join(fits, ["graph_id", "sel_id"], "left").select("graph_id", "sel_id", *[F.coalesce(f"_{k}", k).alias(k) for k in ENDS])


def correct_all(poses: DataFrame, scans: DataFrame, entries: DataFrame, constraints: DataFrame | None, config: Config) -> tuple[DataFrame, DataFrame]:
    """One correction of every graph that has an entry (graph_id, type, points as eight numbers): its poses, and all constraints so far.

    Graphs whose entry is invalid, unverified, or selects poses that are empty, equal or interleaved stay as they are.
    """
    wx, wy = to_world("px", "py", "x", "y", "th")
    seen = scans.join(entries.select("graph_id"), "graph_id", "left_semi")
    world = snapshot(seen.join(poses.select("graph_id", "pose_id", "x", "y", "th"), ["graph_id", "pose_id"]).select("graph_id", "pose_id", wx.alias("wx"), wy.alias("wy")))
    fit = snapshot(verified(entries, world, config.verify))
    segments = snapshot(settled(_segments(fit), world, config.inlier))
    found = world.join(segments, "graph_id").where(segment_distance("wx", "wy", *ENDS) < config.inlier).groupBy("sel_id", "graph_id", "pose_id").agg(F.count("*").alias("n_inliers"))
    filtered = snapshot(select.overlap(found.where(F.col("n_inliers") > config.min_inliers)))
    bounds = select.ordered_bounds(filtered).where("state = 'ok'").select("graph_id", "corrected_sel", "lo", "hi")
    own = filtered.select("graph_id", "pose_id", "sel_id").join(bounds, "graph_id").withColumn("moves", F.col("sel_id") == F.col("corrected_sel"))
    first = select.contiguous(own.where("moves")).where("group_id = 0").select("graph_id", "first_pose", "last_pose")
    ends = segments.join(bounds, "graph_id").groupBy("graph_id", "corrected_sel", "lo", "hi").agg(*[
        F.max(F.when((F.col("sel_id") == F.col("corrected_sel")) == moves, F.col(k))).alias(f"{name}{k}") for name, moves in (("a", True), ("b", False)) for k in ENDS
    ])
    a, b = (tuple(F.col(f"{name}{k}") for k in ENDS) for name in "ab")
    theta, pivot, to = correct.motions(F.col("type"), a, b)
    moves = ends.join(fit.select("graph_id", "type"), "graph_id").join(first, "graph_id").select(
        "graph_id", F.col("type").cast("int").alias("type"), "lo", "hi", "first_pose", "last_pose", theta.alias("theta"), pivot[0].alias("px"), pivot[1].alias("py"), to[0].alias("qx"), to[1].alias("qy"),
        F.atan2(b[3] - b[1], b[2] - b[0]).alias("direction"),
    )
    moves = snapshot(moves)
    own = snapshot(own.select("graph_id", "pose_id", "moves"))
    keep = ["graph_id", "pose_id", "x", "y", "th", "var_t", "var_r"]
    before = snapshot(poses.select(*keep).join(moves, "graph_id"))
    by = (F.col("theta"), (F.col("px"), F.col("py")), (F.col("qx"), F.col("qy")))
    moved = snapshot(correct.carry(before, by, F.col("first_pose"), F.col("last_pose")))
    anchors, corrected = (moved.join(own.where(F.col("moves") == side), ["graph_id", "pose_id"], "left_semi") for side in (False, True))
    pairs = anchors.select("graph_id", F.col("pose_id").alias("anchor_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("th").alias("ath"), "direction", "type").join(corrected.select("graph_id", F.col("pose_id").alias("constrained_id"), "x", "y", "th"), "graph_id")
    new = correct.framed(pairs, F.col("direction")).join(moves.select("graph_id", "type"), "graph_id")
    constraints = snapshot(new if constraints is None else constraints.unionByName(new))
    rx, ry = rotate(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("theta"))
    start = before.where("pose_id = first_pose").select("graph_id", (F.col("qx") + rx - F.col("x")).alias("_dx"), (F.col("qy") + ry - F.col("y")).alias("_dy"))
    spread = correct.backpropagate(moved.where("lo < hi").join(start, "graph_id"), F.col("lo"), F.col("hi"), (F.col("_dx"), F.col("_dy"), F.col("theta")), config.rot_prior, config.trans_prior)
    rest = moved.select(*keep).join(spread.select("graph_id", "pose_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("th").alias("_t")), ["graph_id", "pose_id"], "left")
    now = snapshot(rest.select("graph_id", "pose_id", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"), wrap(F.coalesce("_t", "th")).alias("th"), "var_t", "var_r"))
    done = now.select("graph_id").distinct()
    still = poses.select(*keep).join(done, "graph_id", "left_anti")
    return snapshot(solved(now, constraints.join(done, "graph_id", "left_semi")).unionByName(still)), constraints


def solved(poses: DataFrame, constraints: DataFrame) -> DataFrame:
    """Every graph's chain solved under its constraints, whose targets are taken from the anchors' poses now."""
    anchor = poses.select("graph_id", F.col("pose_id").alias("anchor_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("th").alias("ath"))
    tx, ty = to_world("delta_parallel", "delta_perpendicular", "ax", "ay", "ath")
    t = constraints.join(anchor, ["graph_id", "anchor_id"]).select("graph_id", "type", "constrained_id", tx.alias("tx"), ty.alias("ty"), wrap(F.col("ath") + F.col("delta_angle")).alias("tth"), (F.col("ath") + F.col("penalty_dir")).alias("penalty"))
    keep = poses.select("graph_id", "pose_id", "var_t", "var_r")
    return solve.joint_solve(poses, t).select("graph_id", "pose_id", "x", "y", "th").join(keep, ["graph_id", "pose_id"])


def replay(poses: DataFrame, scans: DataFrame, log: DataFrame, config: Config | None = None, skip_undone: bool = False) -> DataFrame:
    """Poses (graph_id, pose_id, x, y, th, var_t, var_r) after every graph's log (graph_id, entry_id, type, undone, points), entry by entry.

    A round works the next entry of all graphs that still have one; graphs without a log stay.
    """
    entries = log.where(~F.col("undone")) if skip_undone else log
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("entry_id"))
    entries = snapshot(entries.select("graph_id", "type", "points", rank.alias("_round")))
    constraints = None
    for k in range(1, (entries.agg(F.max("_round")).first()[0] or 0) + 1):
        poses, constraints = correct_all(poses, scans, entries.where(F.col("_round") == k).drop("_round"), constraints, config or Config())
    return poses
