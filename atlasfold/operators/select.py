"""Selecting observations and poses: what user-drawn segments see, and in which order selections lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import length, segment_distance, segment_distance_compat
from .match import pairs

#: Segments that a selection may have to be sent to all tasks; more are met cell by cell, of so many metres a side.
MAX_SEGMENTS, CELL = 10_000, 1.0


def observed(points: DataFrame, segments: DataFrame, threshold: float = 0.03, compat: bool = False) -> DataFrame:
    """World points within ``threshold`` of a segment, a row for each segment they lie at.

    ``segments`` is a stated query set (sel_id, x0, y0, x1, y1), sent to all tasks behind a check
    of its size; each point is first held against the segments' bounding boxes. A larger set is
    joined on the cells that its segments pass through.
    """
    reach = threshold + (1.0 if compat else 0.0)
    distance = (segment_distance_compat if compat else segment_distance)("wx", "wy", "x0", "y0", "x1", "y1") < threshold
    if segments.limit(MAX_SEGMENTS + 1).count() > MAX_SEGMENTS:
        cell = {"_cx": F.floor(F.col("wx") / CELL), "_cy": F.floor(F.col("wy") / CELL)}
        return points.withColumns(cell).join(passed_cells(segments, reach), ["_cx", "_cy"]).drop("_cx", "_cy").where(distance)
    near = F.col("wx").between(F.least("x0", "x1") - reach, F.greatest("x0", "x1") + reach) & F.col("wy").between(F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach)
    return points.join(F.broadcast(segments), near).where(distance)


def passed_cells(segments: DataFrame, reach: float) -> DataFrame:
    """The segments, each once for every cell (_cx, _cy) that lies within ``reach`` of a piece of it of a cell's length."""
    pieces = F.greatest(F.lit(1), F.ceil(length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / CELL).cast("int"))
    cut = segments.withColumn("_n", pieces).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    for axis in ("x", "y"):
        at = [F.col(f"{axis}0") + (F.col("_k") + end) / F.col("_n") * (F.col(f"{axis}1") - F.col(f"{axis}0")) for end in (0, 1)]
        cells = F.sequence(F.floor((F.least(*at) - reach) / CELL), F.floor((F.greatest(*at) + reach) / CELL))
        cut = cut.withColumn(f"_c{axis}", F.explode(cells))
    return cut.drop("_n", "_k").distinct()


def closest_observations(points: DataFrame, picks: DataFrame) -> DataFrame:
    """(graph_id, sel_id, pick_id, pose_id, obs_id, wx, wy, d): the observation of every graph that is nearest to each pick (sel_id, pick_id, qx, qy), however far.

    Picks are a stated query set, sent to all tasks behind a check of its size, or in blocks beyond it; each task keeps
    the least of each, so what is shuffled is the picks times the tasks. Ties go to the first pose, then observation.
    """
    own = points.select("graph_id", "pose_id", "obs_id", "wx", "wy").where("wx is not null and wy is not null")
    d = length(F.col("wx") - F.col("qx"), F.col("wy") - F.col("qy"))
    blocks, found = max(1, -(-picks.count() // MAX_SEGMENTS)), None
    for k in range(blocks):
        block = picks.select("sel_id", "pick_id", "qx", "qy").where(F.pmod(F.xxhash64("sel_id", "pick_id"), F.lit(blocks)) == k)
        best = own.join(F.broadcast(block)).withColumn("d", d).groupBy("graph_id", "sel_id", "pick_id").agg(F.min(F.struct("d", "pose_id", "obs_id", "wx", "wy")).alias("n"))
        best = best.select("graph_id", "sel_id", "pick_id", "n.pose_id", "n.obs_id", "n.wx", "n.wy", "n.d")
        found = best if found is None else found.union(best)
    return found


def selected_poses(points: DataFrame, segments: DataFrame, threshold: float = 0.03, more_than: int = 5) -> DataFrame:
    """(sel_id, graph_id, pose_id, n_inliers) of the poses with more than ``more_than`` inliers."""
    found = observed(points, segments, threshold).groupBy("sel_id", "graph_id", "pose_id").agg(F.count("*").alias("n_inliers"))
    return found.where(F.col("n_inliers") > more_than)


def verified(points: DataFrame, picks: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(sel_id, pick_id, ok) whether a world point lies within the threshold of each picked point (sel_id, pick_id, qx, qy)."""
    hit = pairs(picks, points.select(F.col("wx").alias("tx"), F.col("wy").alias("ty")), threshold, []).select("sel_id", "pick_id").distinct()
    return picks.join(hit.withColumn("_hit", F.lit(True)), ["sel_id", "pick_id"], "left").select("sel_id", "pick_id", F.coalesce("_hit", F.lit(False)).alias("ok"))


def overlap(selected: DataFrame) -> DataFrame:
    """Two selections (sel_id 1 and 2) without their common poses, by the rules for full and partial overlap.

    (graph_id, pose_id, sel_id, state); state: ok, or full_overlap where both sets are the same.
    """
    both = selected.groupBy("graph_id", "pose_id").agg(F.max(F.when(F.col("sel_id") == 1, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("sel_id") == 2, 1).otherwise(0)).alias("b"))
    sizes = both.groupBy("graph_id").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("common"))
    joined = both.join(sizes, "graph_id")
    full = (F.col("common") == F.col("na")) & (F.col("common") == F.col("nb"))
    shared = (F.col("a") + F.col("b") == 2) & ~full
    keep_a = (F.col("a") == 1) & (~shared | (F.col("common") == F.col("na")))
    keep_b = (F.col("b") == 1) & (~shared | ((F.col("common") == F.col("nb")) & (F.col("common") != F.col("na"))))
    sets = F.array_compact(F.array(F.when(keep_a, 1), F.when(keep_b, 2)))
    return joined.select("graph_id", "pose_id", F.explode(sets).alias("sel_id"), F.when(full, "full_overlap").otherwise("ok").alias("state"))


def ordered_bounds(filtered: DataFrame) -> DataFrame:
    """Which selection is corrected and which anchors, and the poses between: (graph_id, state, corrected_sel, lo, hi).

    state: ok, full_overlap, interleaved or empty; lo and hi are -1 unless it is ok.
    """
    sel = lambda f, k: f(F.when(F.col("sel_id") == k, F.col("pose_id")))
    g = filtered.groupBy("graph_id").agg(
        sel(F.min, 1).alias("a0"), sel(F.max, 1).alias("a1"), sel(F.min, 2).alias("b0"), sel(F.max, 2).alias("b1"), F.max(F.col("state") == "full_overlap").alias("full")
    )
    state = (
        F.when(F.col("full"), "full_overlap")
        .when(F.col("a0").isNull() | F.col("b0").isNull(), "empty")
        .when((F.col("a0") > F.col("b1")) | (F.col("a1") < F.col("b0")), "ok")
        .otherwise("interleaved")
    )
    after = F.col("a0") > F.col("b1")
    ok = F.col("state") == "ok"
    return g.withColumn("state", state).select(
        "graph_id", "state",
        F.when(ok, F.when(after, 1).otherwise(2)).alias("corrected_sel"),
        F.when(ok, F.when(after, F.col("b1") + 1).otherwise(F.col("a1") + 1)).otherwise(-1).alias("lo"),
        F.when(ok, F.when(after, F.col("a0") - 1).otherwise(F.col("b0") - 1)).otherwise(-1).alias("hi"),
    )


def kept_messages(messages: DataFrame, skip: float, most: int | None, by: list[str], time: str = "ts", order: str = "event_id") -> DataFrame:
    """Messages from ``skip`` seconds after the first of their group on, the first ``most`` of those (all for None)."""
    at = F.col(time).cast("timestamp")
    w = Window.partitionBy(*by)
    later = messages.withColumn("_t0", F.min(at).over(w)).where(F.unix_micros(at) >= F.unix_micros("_t0") + int(skip * 1_000_000)).drop("_t0")
    if most is None:
        return later
    return later.withColumn("_k", F.row_number().over(w.orderBy(time, order))).where(F.col("_k") <= most).drop("_k")


def keyframes(poses: DataFrame, frames: DataFrame, on: list[str]) -> DataFrame:
    """The poses whose ``on`` columns equal a keyframe's, to the bit."""
    return poses.join(frames.select(*on).distinct(), on, "left_semi")


def dragged(x0, y0, x1, y1, least: float = 1.0):
    """Whether a press and its release lie over ``least`` apart."""
    return F.sqrt((F.col(x1) - F.col(x0)) * (F.col(x1) - F.col(x0)) + (F.col(y1) - F.col(y0)) * (F.col(y1) - F.col(y0))) > least


def contiguous(poses: DataFrame) -> DataFrame:
    """(graph_id, group_id, first_pose, last_pose, n): islands of successive pose ids, numbered from 0."""
    w = Window.partitionBy("graph_id").orderBy("pose_id")
    islands = poses.select("graph_id", "pose_id").distinct().withColumn("_i", F.col("pose_id") - F.row_number().over(w))
    out = islands.groupBy("graph_id", "_i").agg(F.min("pose_id").alias("first_pose"), F.max("pose_id").alias("last_pose"), F.count("*").alias("n"))
    return out.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("_i")) - 1).alias("group_id"), "first_pose", "last_pose", "n")


def runs(lines: DataFrame, keys: list[str], order: str = "line_no", *, by: list[str]) -> DataFrame:
    """Adds run_id: the number, from 0, of the run of equal successive ``keys`` among the rows of equal ``by``."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.lit(False)
    for k in keys:
        new = new | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    return lines.withColumn("_new", F.when(new & ~first, 1).otherwise(0)).withColumn("run_id", F.sum("_new").over(w)).drop("_new")
