"""Registered queries: every operator over the fixtures, whole tables, outputs rounded for comparison."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import geometry as g
from ..functions import residuals as r
from ..operators import correct, display, grid, linemap, lines, match, motion, refine, relative, select, sensors, solve, uncertain
from ..schema import VALID, Config, Correction
from ..snapshot import cut, snapshot
from ..sources import fixtures as fx
from ..sources.fixtures import table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed inputs of the queries: two drawn segments, thresholds that suit the fixture, and a correction.
SEG_A, SEG_B = (-1.0, 0.0, 1.0, 0.5), (2.0, -1.0, 3.5, 1.0)
PICK, REACH, RES = 0.1, 0.25, 0.25
POINTS = [(0.0, 0.0), (2.0, 0.2), (0.1, 0.5), (2.0, 1.1)]
LO, HI, CORRECTION = 5, 30, (0.7, -0.4, 0.3)


def rnd(x, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    x = g.c(x) if not isinstance(x, Column) else x
    return F.when(F.abs(x) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(x, digits))


def out(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[rnd(v, digits).alias(v) for v in values])


def segments(spark: SparkSession, *segs) -> DataFrame:
    return spark.createDataFrame([(i + 1, *s) for i, s in enumerate(segs)], "sel_id int, x0 double, y0 double, x1 double, y1 double")


def world_normals(spark, sf) -> DataFrame:
    w = fx.world(spark, sf)
    nx, ny = g.rotate("nx", "ny", "th")
    return w.withColumns({"wnx": nx, "wny": ny})


def odometry_prefix(spark, sf):
    return out(fx.poses(spark, sf), ["graph_id", "pose_id"], ["x", "y", "th"], 5)


def pose_edges(spark, sf):
    return out(sensors.edges(fx.poses(spark, sf)), ["graph_id", "pose_id"], ["radial", "direction", "rotation"], 5)


def world_points(spark, sf):
    return out(fx.world(spark, sf), ["graph_id", "pose_id", "obs_id"], ["wx", "wy"], 5)


def robot_frame(spark, sf):
    px, py = g.to_robot(1.0, 2.0, "x", "y", "th")
    return out(fx.poses(spark, sf).withColumns({"px": px, "py": py}), ["graph_id", "pose_id"], ["px", "py"], 5)


def relative_pose(spark, sf):
    p = fx.poses(spark, sf)
    first = p.where("pose_id = 0").select("graph_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("th").alias("th0"))
    dx, dy, dth = g.relative_pose("x0", "y0", "th0", "x", "y", "th")
    return out(p.join(first, "graph_id").withColumns({"dx": dx, "dy": dy, "sin_dth": F.sin(dth), "cos_dth": F.cos(dth)}), ["graph_id", "pose_id"], ["dx", "dy", "sin_dth", "cos_dth"], 5)


def wrap_angles(spark, sf):
    p = fx.odometry(spark, sf)
    a = F.col("dth") * 7 + 0.001
    return out(p.withColumns({"modded": g.angle_mod(a), "wrapped": g.wrap(a), "positive": g.angle_pos(a), "apart": g.angle_dist(a, F.lit(1.0))}), ["graph_id", "pose_id"], ["modded", "wrapped", "positive", "apart"])


def segment_distance(spark, sf):
    return out(fx.world(spark, sf).withColumn("d", g.segment_distance("wx", "wy", *SEG_A)), ["graph_id", "pose_id", "obs_id"], ["d"], 5)


def segment_distance_compat(spark, sf):
    return out(fx.world(spark, sf).withColumn("d", g.segment_distance_compat("wx", "wy", *SEG_A)), ["graph_id", "pose_id", "obs_id"], ["d"], 5)


def line_ops(spark, sf):
    s = fx.scans(spark, sf)
    x, y, inside = g.intersection(0.0, 0.0, "px", "py", *SEG_A)
    s = s.withColumns({"off": g.line_offset("px", "py", *SEG_A), "t": g.along("px", "py", *SEG_A), "len": g.length("px", "py"), "meets": inside, "ix": F.when(inside, x), "iy": F.when(inside, y)})
    return out(s, ["graph_id", "pose_id", "obs_id"], ["off", "t", "len", "ix", "iy"])


def geom_ops(spark, sf):
    s = fx.scans(spark, sf)
    cx, cy, rad = g.circle(0.0, 0.0, 3.0, 0.5, "px", F.col("py") + 9.0)
    t = g.tangent_points(F.col("px") + 20.0, "py", 0.0, 0.0, 1.5)
    s = s.withColumns({
        "angle": g.vertex_angle("px", "py", 9.0, 9.0, -9.0, 7.0), "cx": cx, "cy": cy, "radius": rad, "t0": t[0], "t1": t[1],
        "hit": g.ray_sphere(-9.0, F.col("px") / 9, F.col("py") / 9, 1.0, 0.0, 0.0, 2.0), "plane": g.ray_plane(0.0, 0.0, "px", 1.0, 0.0, 0.0, 2.0, 1.0, 1.0, 5.0),
        "ramp": g.ramp("px", -1.0, 1.0), "bound": g.abs_bound("py", 0.75), "mid": g.cubic("px", "py", F.col("px") + 1, F.col("py") - 1, 0.3),
    })
    return out(s, ["graph_id", "pose_id", "obs_id"], ["angle", "cx", "cy", "radius", "t0", "t1", "hit", "plane", "ramp", "bound", "mid"], 5)


def scalar_ops(spark, sf):
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 97 + 1).cast("long").alias("p"))
    return e.select(
        F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), g.gcd("q", "p").cast("long").alias("gcd"),
        F.bit_count("q").cast("long").alias("bits"), g.sign_nz(F.col("q") - F.col("p")).cast("long").alias("sign"), F.greatest("q", "p").alias("larger"), F.pmod(-F.col("q"), "p").cast("long").alias("mod"),
    )


def pill_select(spark, sf):
    """The flagship: which poses see the drawn segment."""
    found = select.selected_poses(fx.world(spark, sf), segments(spark, SEG_A), PICK)
    return found.select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), "n_inliers")


def verify_points(spark, sf):
    picks = [(k, i, x + 0.25 * i, y - 0.4 * k) for k, (x, y) in enumerate([(-1.0, 0.0), (2.0, -1.0), (12.0, 40.0)]) for i in range(4)]
    p = spark.createDataFrame(picks, "sel_id int, pick_id int, qx double, qy double")
    return select.verified(fx.world(spark, sf), p, 0.05).select(F.col("sel_id").cast("long").alias("sel_id"), F.col("pick_id").cast("long").alias("pick_id"), "ok")


def _selections(spark, sf) -> DataFrame:
    return select.selected_poses(fx.world(spark, sf), segments(spark, SEG_A, SEG_B), 0.25, 2)


def selection_overlap(spark, sf):
    return select.overlap(_selections(spark, sf)).select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), F.col("sel_id").cast("long").alias("sel_id"), "state")


def order_bounds(spark, sf):
    b = select.ordered_bounds(select.overlap(_selections(spark, sf)))
    return b.select("graph_id", "state", F.col("corrected_sel").cast("long").alias("corrected_sel"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def contiguous_groups(spark, sf):
    p = fx.odometry(spark, sf).where("dx > 0.5")
    return select.contiguous(p).select("graph_id", F.col("group_id").cast("long").alias("group_id"), F.col("first_pose").cast("long").alias("first_pose"), F.col("last_pose").cast("long").alias("last_pose"), "n")


def pose_runs(spark, sf):
    p = fx.odometry(spark, sf).select("graph_id", "pose_id", (F.col("dx") > 0.5).alias("far"), (F.col("dth") > 0).alias("left"))
    return select.runs(p, ["far", "left"], "pose_id", by=["graph_id"]).select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), F.col("run_id").cast("long").alias("run_id"))


def _moved(kind):
    def query(spark, sf):
        return out(correct.deltas(fx.poses(spark, sf), kind, POINTS), ["graph_id", "pose_id"], ["dx", "dy", "dth"], 5)

    return query


colocate, collinear, perpendicular, parallel = (_moved(k) for k in (2, 4, 5, 6))


def suffix_motion(spark, sf):
    return out(correct.apply(fx.poses(spark, sf), 2, POINTS, LO, 9), ["graph_id", "pose_id"], ["x", "y", "th"], 5)


def constraint_targets(spark, sf):
    t = correct.targets(fx.poses(spark, sf), (0, 2), (20, 22), math.atan2(0.6, 1.9))
    t = t.withColumns({"sin_da": F.sin("delta_angle"), "cos_da": F.cos("delta_angle"), "sin_pen": F.sin("penalty_dir"), "cos_pen": F.cos("penalty_dir")})
    return out(t, ["graph_id", "anchor_id", "constrained_id"], ["delta_parallel", "delta_perpendicular", "sin_da", "cos_da", "sin_pen", "cos_pen"], 5)


def backprop(spark, sf):
    return out(correct.backpropagate(fx.poses(spark, sf), LO, HI, CORRECTION), ["graph_id", "pose_id"], ["x", "y", "th"], 5)


def cov_scale(spark, sf):
    p = fx.poses(spark, sf)
    p = p.withColumn("cov", F.array(F.col("var_t"), F.lit(0.0), F.lit(1e-4), F.lit(0.0), F.col("var_t"), F.lit(2e-4), F.lit(1e-4), F.lit(2e-4), F.col("var_r")))
    s = correct.scale_covariances(p, LO, HI).select("graph_id", "pose_id", *[(F.get("cov", F.lit(i)) * 1e4).alias(n) for i, n in ((0, "c00"), (2, "c02"), (4, "c11"), (5, "c12"), (8, "c22"))])
    return out(s, ["graph_id", "pose_id"], ["c00", "c02", "c11", "c12", "c22"])


def scan_normals_window(spark, sf):
    return out(sensors.window_normals(fx.scans(spark, sf), REACH), ["graph_id", "pose_id", "obs_id"], ["nx", "ny"])


def nn_l2(spark, sf):
    n = match.nearest_points(world_normals(spark, sf), REACH)
    return out(n, ["graph_id", "pose_id", "obs_id", "to_obs"], ["d"], 5)


def nn_normal(spark, sf):
    n = match.nearest_by_normal(world_normals(spark, sf), REACH)
    return out(n, ["graph_id", "pose_id", "obs_id", "to_obs"], ["dn"], 5)


def radius_search(spark, sf):
    return match.in_radius(world_normals(spark, sf), REACH).select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), F.col("obs_id").cast("long").alias("obs_id"), "n")


def visual_odometry(spark, sf):
    n = match.visual_odometry(world_normals(spark, sf), REACH)
    return out(n, ["graph_id", "pose_id", "obs_id", "to_obs"], ["d"], 5)


def stf_pairs(spark, sf):
    m = match.all_pairs(world_normals(spark, sf), 0.4, window=60, angle_deg=60.0, cap=5, more_than=2)
    return m.select("graph_id", *[F.col(k).cast("long").alias(k) for k in ("pose_id", "obs_id", "to_pose", "to_obs", "n_matches")])


def residual_rms(spark, sf):
    m = match.all_pairs(world_normals(spark, sf), 0.4, window=60, angle_deg=60.0, cap=5, more_than=2)
    return out(match.rms(m, 0.05, 0.5), ["graph_id", "pose_id", "to_pose", "n_matches"], ["rms"], 5)


def residual_pose(spark, sf):
    e = sensors.edges(fx.poses(spark, sf))
    a, b, d = r.pose_edge("x0", "y0", "th0", "x", "y", "th", F.col("radial") * 0.9, 0.1, F.col("rotation") + 0.05, 0.03, 0.03, 0.01)
    return out(e.withColumns({"r0": a, "r1": b, "r2": d}), ["graph_id", "pose_id"], ["r0", "r1", "r2"], 4)


def residual_human(spark, sf):
    p = fx.odometry(spark, sf).select("graph_id", "pose_id", F.col("dx").alias("x"), F.col("var_t").alias("y"), F.col("dth").alias("th"))
    a, b, d = r.colocation("x", "y", "th", 0.5, 0.1, 0.2)
    e, f = r.collinear("x", "y", "th", 0.5, 0.1, 0.2, 0.7)
    return out(p.withColumns({"c0": a, "c1": b, "c2": d, "l0": e, "l1": f, "o0": r.orientation("th", 0.3)}), ["graph_id", "pose_id"], ["c0", "c1", "c2", "l0", "l1", "o0"])


#: The wall of the residual query: unit normal, offset, and ends.
WALL = (0.6, 0.8, -0.5)
WALL_ENDS = (2.3, -1.1, -1.3, 1.6)


def residual_wall(spark, sf):
    s = fx.scans(spark, sf)
    return out(s.withColumns({
        "plain": r.point_to_line("px", "py", *WALL, 0.05, 0.5), "front": r.obstacle("px", "py", 0.0, 0.0, *WALL, 0.05, 0.5),
        "seen": r.visibility("px", "py", 0.0, 0.0, *WALL_ENDS, *WALL, 0.05, 0.5), "pair": r.point_to_point("px", "py", 0.1, 0.2, "nx", "ny", 0.05, 0.5),
    }), ["graph_id", "pose_id", "obs_id"], ["plain", "front", "seen", "pair"])


def residual_glob(spark, sf):
    """Sums over a scan: squared point-to-line, root of squared visibility, RMS to a point."""
    s = fx.scans(spark, sf)
    a, b, c = r.point_to_line("px", "py", *WALL, 0.05), r.visibility("px", "py", 0.0, 0.0, *WALL_ENDS, *WALL, 0.05), r.point_to_point("px", "py", 0.1, 0.2, "nx", "ny", 0.05)
    t = s.groupBy("graph_id", "pose_id").agg(F.sum(a * a).alias("line"), F.sqrt(F.sum(b * b)).alias("wall"), F.sqrt(F.avg(c * c)).alias("rms"))
    return out(t, ["graph_id", "pose_id"], ["line", "wall", "rms"], 4)


def _rays(spark, sf) -> DataFrame:
    return fx.scans(spark, sf).select("graph_id", "pose_id", "obs_id", F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.col("px").alias("wx"), F.col("py").alias("wy"))


def sdf_grid(spark, sf):
    return out(grid.sdf(_rays(spark, sf), RES, ["graph_id"]), ["graph_id", "ix", "iy"], ["value", "weight"], 5)


def sdf_merge(spark, sf):
    m = grid.merge(grid.sdf(_rays(spark, sf), RES, ["graph_id"]).withColumn("map_id", F.col("graph_id") % 2), ["map_id"])
    return out(m, ["map_id", "ix", "iy"], ["value", "weight"], 4)


def consistency(spark, sf):
    n = grid.inconsistency(fx.world(spark, sf), fx.poses(spark, sf), RES, 10.0)
    return n.select("graph_id", F.col("pose_a").cast("long").alias("pose_a"), F.col("pose_b").cast("long").alias("pose_b"), F.col("n").cast("long").alias("n"))


def consistency_hist(spark, sf):
    n = grid.histogram(grid.inconsistency(fx.world(spark, sf), fx.poses(spark, sf), RES, 10.0))
    return n.select("graph_id", F.col("bin").cast("long").alias("bin"), "n_pairs")


def _local(spark, sf) -> DataFrame:
    return fx.scans(spark, sf).select("graph_id", "pose_id", "obs_id", F.col("px").alias("wx"), F.col("py").alias("wy"))


def endpoint_cov(spark, sf):
    return out(lines.endpoint_covariance(_local(spark, sf), ["graph_id", "pose_id"], 0.3, -0.2), ["graph_id", "pose_id", "n"], ["cxx", "cxy", "cyy"])


def scatter(spark, sf):
    return out(lines.scatter(_local(spark, sf), ["graph_id", "pose_id"]), ["graph_id", "pose_id", "mass"], ["mx", "my", "sxx", "sxy", "syy"])


def cov_ellipse(spark, sf):
    e = lines.with_ellipse(lines.endpoint_covariance(_local(spark, sf), ["graph_id", "pose_id"], 0.3, -0.2))
    return out(e, ["graph_id", "pose_id"], ["major", "minor", "angle"], 5)


def _map_segments(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Even scans' first and last points as the master's segments, odd ones' as new ones."""
    s = fx.scans(spark, sf)
    ends = s.groupBy("graph_id", "pose_id").agg(
        F.max(F.when(F.col("obs_id") == 0, F.col("px"))).alias("x0"), F.max(F.when(F.col("obs_id") == 0, F.col("py"))).alias("y0"),
        F.max(F.when(F.col("obs_id") == 31, F.col("px"))).alias("x1"), F.max(F.when(F.col("obs_id") == 31, F.col("py"))).alias("y1"),
    )
    segs = ends.select("graph_id", F.col("pose_id").alias("seg_id"), "x0", "y0", "x1", "y1", (F.lit(10.0) + F.col("pose_id") % 7).alias("mass"), F.lit(0.002).alias("c0"), F.lit(0.003).alias("c1"))
    return segs.where("seg_id % 2 = 1"), segs.where("seg_id % 2 = 0")


def segment_match(spark, sf):
    m = lines.match(*_map_segments(spark, sf), ["graph_id"], 1.2)
    return out(m, ["graph_id", "new_id", "master_id"], ["t1", "t2"], 5)


def merge_segments(spark, sf):
    new, master = _map_segments(spark, sf)
    # the merge reads the matches three times
    m = lines.merge(new, master, snapshot(lines.match(new, master, ["graph_id"], 1.2)), ["graph_id"])
    return out(m, ["graph_id", "seg_id"], ["x0", "y0", "x1", "y1", "mass", "c0", "c1"], 5)


def _line_map(spark, sf) -> DataFrame:
    """The scans' segments with covariances that lean either way, and the moments of points spread evenly along them."""
    new, master = _map_segments(spark, sf)
    dx, dy, mx, my = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    own = F.col("seg_id") % 3 * 0.001
    return new.unionByName(master).select(
        "graph_id", "seg_id", *linemap.ENDS, "mass", (own + 0.002).alias("c0xx"), F.lit(0.0005).alias("c0xy"), F.lit(0.003).alias("c0yy"), F.lit(0.003).alias("c1xx"), F.lit(-0.0005).alias("c1xy"), (own + 0.002).alias("c1yy"),
        mx.alias("mx"), my.alias("my"), (mx * mx + dx * dx / 12 + 1e-4).alias("sxx"), (mx * my + dx * dy / 12).alias("sxy"), (my * my + dy * dy / 12 + 1e-4).alias("syy"),
    )


_LINE = [*linemap.ENDS, "mass", "c0xx", "c0yy", "c1xx", "c1yy", "mx", "my", "sxx", "sxy", "syy"]


def match_lines(spark, sf):
    m = _line_map(spark, sf)
    return out(linemap.match(m.where("seg_id % 2 = 1"), m.where("seg_id % 2 = 0"), ["graph_id"], 1.5), ["graph_id", "new_id", "master_id"], ["t1", "t2"], 5)


def merge_lines(spark, sf):
    m = _line_map(spark, sf)
    new, master = m.where("seg_id % 2 = 1"), m.where("seg_id % 2 = 0")
    merged = linemap.merge(new, master, snapshot(linemap.match(new, master, ["graph_id"], 1.5)), ["graph_id"])
    return out(merged, ["graph_id", "seg_id"], _LINE, 4)


def self_merge_round(spark, sf):
    """The first of the rounds in which a map is merged with itself."""
    return out(linemap.merge_round(snapshot(_line_map(spark, sf)), ["graph_id"], 1.5)[0], ["graph_id", "seg_id"], _LINE, 4)


def screen_points(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("long").alias("event_id"), "value", (F.col("event_id") % 480).alias("row"))
    x, y = g.screen_to_world("value", "row", 640.0, 480.0, 0.025, 1.5, -2.0, (0.25, 0.5))
    return e.select("event_id", rnd(x).alias("x"), rnd(y).alias("y"))


def drawn_rectangles(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("p"))
    o = o.withColumns({"a": F.col("p") * -20, "b": F.col("p") - 1e5, "c": F.col("p") * 10, "d": F.col("p") / 3})
    return o.select("o_orderkey", *[rnd(v, 3).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), display.drawn_rectangle("a", "b", "c", "d"), strict=True)])


def _stamped(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def display_compiled(spark, sf):
    """What is shown a day after the first event, of users heard from in the last two hours; purchases stay."""
    e = _stamped(spark, sf).withColumn("stays", F.col("event_type") == "purchase")
    now = F.lit(e.agg(F.min("ts")).first()[0]) + F.expr("interval 1 day")
    return display.compiled(e, now, "user_id", ["ts", "event_id"], "ts", ["event_id", "value"], 7200.0, "stays").select("user_id", "event_id", rnd("value").alias("value"))


def display_throttled(spark, sf):
    e = _stamped(spark, sf).select("event_type", "ts", "event_id")
    return display.throttled(e, "ts", ["event_type"], 0.0009765625).select("event_type", "event_id")


def motion_sd(spark, sf):
    e = sensors.motion_noise(sensors.edges(fx.poses(spark, sf)))
    return out(e, ["graph_id", "pose_id"], ["sd_radial", "sd_tangential", "sd_angular"], 5)


def polar_scan(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 4).alias("ranges"))
    p = sensors.polar_points(e, 0.2, 6.0, -1.5, 3.0 / 63, skip=2, offset=(0.15, 0.0))
    return out(p, ["vec_id", "beam"], ["range", "px", "py"])


def range_correction(spark, sf):
    t = spark.createDataFrame([(b, 0.01 * (b % 5) - 0.02) for b in range(-30, 30) if b % 3], "bin int, delta double")
    p = fx.scans(spark, sf).withColumns({"range": g.length("px", "py"), "bearing": F.atan2("py", "px")})
    return out(sensors.correct_ranges(p, t, "bearing", 0.1), ["graph_id", "pose_id", "obs_id"], ["range"], 5)


def latest_per_publisher(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return display.latest(e, "user_id", ["ts", "event_id"], ["event_id", "value"]).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), rnd("value").alias("value"))


def display_lines(spark, sf):
    d = display.trajectory_lines(fx.poses(spark, sf))
    return d.select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), "kind", *[rnd(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")])


def adjacency(spark, sf):
    o = fx.odometry(spark, sf).select("graph_id", "pose_id")
    c = o.where("pose_id % 10 = 9").select("graph_id", F.lit(0).alias("anchor_id"), F.col("pose_id").alias("constrained_id"))
    return display.adjacency(o, c).select("graph_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def raster(spark, sf):
    return grid.raster(_local(spark, sf), 0.1, ["graph_id"]).select("graph_id", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "n")


def modifier_decode(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").cast("long").alias("event_id"), g.modifier_type((F.col("event_id") % 16).cast("int")).cast("long").alias("type"))


def argb_unpack(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.pmod(F.col("o_orderkey").cast("long") * 2654435761, F.lit(4294967296)).alias("v"))
    a, red, green, blue = g.argb("v")
    return o.select("o_orderkey", a.cast("long").alias("alpha"), red.cast("long").alias("red"), green.cast("long").alias("green"), blue.cast("long").alias("blue"))


def event_windows(spark, sf):
    """An extension: hourly counts and sums by user."""
    from ..streaming.events import windowed

    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    w = windowed(e, "ts", "10 minutes", "1 hour", ["user_id"])
    return w.select(F.unix_seconds("start").alias("start"), F.col("user_id").cast("long").alias("user_id"), "n", rnd("total", 4).alias("total"))


def vector_ops(spark, sf):
    s = fx.scans(spark, sf)
    u, v = g.project_in("px", "py", 0.6, 0.8)
    bx, by = g.bounded_length("px", "py", 0.5)
    qx, qy = g.point_on_segment("px", "py", *SEG_A)
    c3, r3 = g.cross3(("px", "py", 1.0), (0.5, -1.0, 2.0)), g.rotate3(("px", "py", 1.0), 0, 0.4)
    s = s.withColumns({
        "u": u, "v": v, "bx": bx, "byy": by, "qx": qx, "qy": qy, "apart": g.segments_distance("px", "py", F.col("px") + 1, F.col("py") + 0.5, *SEG_A), "t": g.closest_time("px", "py", 1.0, 0.5, 0.2, 0.1, -0.5, 0.2),
        "c0": c3[0], "c2": c3[2], "d3": g.dot3(("px", "py", 1.0), (0.5, -1.0, 2.0)), "r1": r3[1], "r2": r3[2],
    })
    return out(s, ["graph_id", "pose_id", "obs_id"], ["u", "v", "bx", "byy", "qx", "qy", "apart", "t", "c0", "c2", "d3", "r1", "r2"], 5)


def cov_rotate(spark, sf):
    p = fx.poses(spark, sf).withColumn("cov", F.array(F.col("var_t") * 1e3, F.lit(0.2), F.lit(0.1), F.lit(0.2), F.col("var_r") * 1e4, F.lit(0.3), F.lit(0.1), F.lit(0.3), F.lit(2.0)))
    p = p.withColumn("r", g.rotate_covariance("cov", "th"))
    xx, xy, yy = g.motion_covariance("x", "y", 0.3, 0.1)
    p = p.withColumns({**{f"r{i}": F.get("r", F.lit(i)) for i in (0, 1, 2, 4, 5, 8)}, "xx": xx, "xy": xy, "yy": yy})
    return out(p, ["graph_id", "pose_id"], ["r0", "r1", "r2", "r4", "r5", "r8", "xx", "xy", "yy"], 5)


def scalar_more(spark, sf):
    e = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 97 + 1).cast("long").alias("p")
    )
    e = e.withColumns({"s": F.col("q") - F.col("p"), "r": F.col("q") - 25})
    own, (least, taken), (most, raised) = F.array("q", "p", "s"), g.take_min("q", "p"), g.take_max("q", "p")
    ranged = g.set_range(own, 1, 2, F.lit(7).cast("long"))
    flags = {"sign_eq": g.sign_eq("s", "r"), "taken": taken, "raised": raised, "toggled": g.toggled(F.col("q") > 20), "one_bit": g.one_bit_set("q"), "all_bits": g.all_bits_set("q", 5), "any_bits": g.any_bits_set("p", 6)}
    longs = {
        "abs_max": g.abs_max("s", "r"), "abs_min": g.abs_min("s", "r"), "max_idx": g.max_idx(own), "min_idx": g.min_idx(own), "least": least, "most": most, "middle": g.median3("q", "p", "s"), "cube": g.cube("s"),
        "floor_mod": g.floor_mod("s", "p"), "lcm": g.lcm("q", "p"), "found": g.find_item(own, F.lit(30).cast("long")), "r0": F.get(ranged, F.lit(0)), "r2": F.get(ranged, F.lit(2)),
        "held": g.saturating_count(F.array(F.col("q") > 10, F.col("p") > 10, F.col("s") > 0, F.col("r") > 0), 0, 2),
    }
    return e.select("l_orderkey", "l_linenumber", *[v.cast("long").alias(k) for k, v in longs.items()], *[v.alias(k) for k, v in flags.items()])


def pose_differences(spark, sf):
    """Plain differences of poses, and the sums that lead back."""
    p = fx.poses(spark, sf).select("graph_id", "pose_id", "x", "y", "th")
    d = sensors.differences(p, ["x", "y", "th"]).select("graph_id", "pose_id", *[F.col(k).alias(f"d{k}") for k in ("x", "y", "th")], "x", "y", "th")
    return out(sensors.totals(d, ["x", "y", "th"]), ["graph_id", "pose_id"], ["dx", "dy", "dth", "x", "y", "th"], 4)


def scan_bounds(spark, sf):
    return out(grid.bounds(_local(spark, sf), ["graph_id", "pose_id"]), ["graph_id", "pose_id"], ["x_min", "x_max", "y_min", "y_max", "x_mean", "y_mean", "x_spread", "y_spread"], 5)


def sdf_normalised(spark, sf):
    n = grid.normalised(grid.sdf(_rays(spark, sf), RES, ["graph_id"]), ["graph_id"])
    # shades are rounded down, so only values are held against SQL
    return out(n, ["graph_id", "ix", "iy"], ["value", "weight"], 4)


def message_window(spark, sf):
    """From an hour after each user's first event on, 40 events at most."""
    m = select.kept_messages(table(spark, sf, "events").select("user_id", "event_id", "ts"), 3600.0, 40, ["user_id"])
    return m.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"))


def keyframe_poses(spark, sf):
    """The odometry rows that carry a keyframe's very time, those of the long moves."""
    o = fx.odometry(spark, sf)
    return select.keyframes(o, o.where("dx > 1").select("graph_id", "ts"), ["graph_id", "ts"]).select("graph_id", F.col("pose_id").cast("long").alias("pose_id"))


def drags(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("long").alias("event_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("value") / 50).alias("x1"), F.lit(0.5).alias("y1"))
    return e.select("event_id", select.dragged("x0", "y0", "x1", "y1").alias("dragged"))


def residual_cumulative(spark, sf):
    a, b, d = r.cumulative_pose("x", "y", "th", 1.0, -0.5, 0.25, 0.05, 0.04, 0.02)
    return out(fx.poses(spark, sf).withColumns({"r0": a, "r1": b, "r2": d}), ["graph_id", "pose_id"], ["r0", "r1", "r2"], 3)


def seeded_draws(spark, sf):
    """A draw of each kind for every line item, keyed by the item."""
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("q"))
    key = ("l_orderkey", "l_linenumber")
    i = i.withColumns({"even": draws.uniform(1, *key), "ranged": draws.between(-2.0, "q", 2, *key), "bell": draws.normal("q", 0.5, 3, *key)})
    return out(i, [*key], ["even", "ranged", "bell"])


def pose_draws(spark, sf):
    """A place drawn for every pose from a covariance that leans with its heading."""
    p = fx.poses(spark, sf)
    xx, xy, yy = g.motion_covariance(F.cos("th"), F.sin("th"), 0.4, 0.1)
    x, y = draws.multivariate_normal(("x", "y"), (xx, xy, yy), 5, "graph_id", "pose_id")
    return out(p.withColumns({"dx": x - F.col("x"), "dy": y - F.col("y")}), ["graph_id", "pose_id"], ["dx", "dy"], 5)


def crowd_select(spark, sf):
    """Observations at the motions of all trajectories: more segments than are sent to every task."""
    p = fx.poses(spark, sf)
    ends = sensors.edges(p).select((F.col("graph_id") * 100_000 + F.col("pose_id")).alias("sel_id"), "x0", "y0", F.col("x").alias("x1"), F.col("y").alias("y1"))
    found = select.observed(fx.world(spark, sf).select("graph_id", "pose_id", "obs_id", "wx", "wy"), ends, 0.02)
    return found.groupBy("graph_id", "pose_id").agg(F.count("*").alias("n"), F.min("sel_id").alias("first"), F.max("sel_id").alias("last")).select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), "n", "first", "last")


def _picks(spark):
    return spark.createDataFrame([(k, i, 0.37 + 1.1 * k - 0.8 * i, -0.21 + 0.45 * k * (1 - 2 * i)) for k in range(6) for i in range(2)] + [(9, 0, 4000.0, -900.0), (9, 1, -5000.0, 70.0)], "sel_id int, pick_id int, qx double, qy double")


def closest_observations(spark, sf):
    found = select.closest_observations(fx.world(spark, sf), _picks(spark))
    return out(found, ["graph_id", "sel_id", "pick_id", "pose_id", "obs_id"], ["d"], 4)


def closest_pair_motion(spark, sf):
    found = correct.closest_pair_motion(select.closest_observations(fx.world(spark, sf), _picks(spark)))
    return out(found, ["graph_id", "sel_id", "constrained_id", "anchor_id"], ["dx", "dy"], 4)


def _lined(spark, sf) -> DataFrame:
    """Scans whose points each have a wall: a slanted one, behind a segment of it."""
    ends = {"x0": 0.0, "y0": 2.0, "x1": 3.0, "y1": -2.0, "nx": 0.8, "ny": 0.6, "offset": -1.2}
    return fx.scans(spark, sf).select("graph_id", "pose_id", "obs_id", "px", "py").withColumns({k: F.lit(v) for k, v in ends.items()})


def _steps(spark, sf) -> DataFrame:
    return fx.odometry(spark, sf).select("graph_id", "pose_id", "dx", (F.col("dth") / 4).alias("dy"), "dth")


def residual_relative(spark, sf):
    """Of every pose with a scan: its points against a wall under summed motions, seen through it, and under composed motions."""
    steps, points = _steps(spark, sf), _lined(spark, sf)
    plain, turned = relative.summed(steps), relative.composed(steps)
    roots = [relative.per_pose(x).select("graph_id", "pose_id", F.col("root").alias(name)) for name, x in (
        ("summed", relative.point_residuals(plain, points, 0.05, 0.5)), ("through", relative.point_residuals(plain, points, 0.05, 0.5, True)), ("composed", relative.point_residuals(turned, points, 1.0, 0.5)))]
    return out(roots[0].join(roots[1], ["graph_id", "pose_id"]).join(roots[2], ["graph_id", "pose_id"]), ["graph_id", "pose_id"], ["summed", "through", "composed"], 4)


def relative_gradients(spark, sf):
    """Of the summed half squares of the same points by every relative pose: under summed and under composed motions."""
    steps, points = _steps(spark, sf), _lined(spark, sf)
    plain = relative.gradients(steps, relative.per_pose(relative.point_residuals(relative.summed(steps), points, 1.0, 0.5)), False)
    turned = relative.gradients(steps, relative.per_pose(relative.point_residuals(relative.composed(steps), points, 1.0, 0.5)), True)
    both = plain.join(turned.toDF("graph_id", "pose_id", "tx", "ty", "tth"), ["graph_id", "pose_id"])
    return out(both.join(points.select("graph_id").distinct(), "graph_id", "left_semi"), ["graph_id", "pose_id"], ["gx", "gy", "gth", "tx", "ty", "tth"], 3)


def residual_object(spark, sf):
    """World points against a line in the frame of an object that stands at each graph's tenth pose."""
    p = fx.poses(spark, sf).where("pose_id = 10").select("graph_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("th").alias("oth"))
    w = fx.world(spark, sf).join(p, "graph_id")
    return out(w.withColumn("r", r.point_to_object("wx", "wy", "ox", "oy", "oth", 0.6, -0.8, 0.3, 0.05, 0.5)), ["graph_id", "pose_id", "obs_id"], ["r"], 4)


#: What a message of the log below is made of.
EVENT = "Header header\nfloat64 value  # as it was\nint64 event_id\nint32[] keys\n====\nMSG: std_msgs/Header\nuint32 seq\ntime stamp\nstring frame_id"


def message_log(spark, sf):
    """The events as a recorded log, a topic for each type, read back: purchases and views of a span of time, decoded."""
    import struct

    from ..sources import bag

    e = table(spark, sf, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"))

    def pack(frames):
        for f in frames:
            own = zip(f["event_id"].tolist(), f["time_ns"].tolist(), f["value"].tolist(), f["k"].tolist(), strict=True)
            f["data"] = [struct.pack("<IIII4sdqIii", i, *divmod(t, 1_000_000_000), 4, b"user", v, i, 2, k, 2 * k) for i, t, v, k in own]
            yield f[["topic", "type", "time_ns", "data"]]

    e = e.withColumns({"topic": F.concat(F.lit("user/"), "event_type"), "type": F.lit("log/Event")})
    messages = e.mapInPandas(pack, "topic string, type string, time_ns long, data binary")
    first = e.agg(F.min("time_ns")).first()[0] or 0
    log = bag.read_log(spark, *bag.write_log(messages.sortWithinPartitions("time_ns"), {"log/Event": EVENT}, "bz2", 64 << 10))
    hour = 3600 * 10**9
    kept = log.where(F.col("topic").isin("user/purchase", "user/view") & (F.col("time_ns") >= first + 6 * hour) & (F.col("time_ns") < first + 240 * hour))
    found = bag.decoded(kept, EVENT).select("topic", "message.*")
    return found.select("topic", "event_id", rnd("value").alias("value"), F.col("header.frame_id").alias("frame_id"), F.element_at("keys", 2).cast("long").alias("twice_k"), (F.col("header.seq") - F.col("event_id")).alias("seq_off"))


def step_motions(spark, sf) -> DataFrame:
    """The odometry as motions, noisier across than along."""
    nought = F.lit(0.0)
    return fx.odometry(spark, sf).select("graph_id", "pose_id", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dth").alias("th"), F.col("var_t").alias("c00"), nought.alias("c01"), nought.alias("c02"), (2 * F.col("var_t")).alias("c11"), nought.alias("c12"), F.col("var_r").alias("c22"))


def motion_scan(spark, sf):
    """Every pose with the covariance that its odometry has gathered."""
    found = motion.composed(step_motions(spark, sf), block=16)
    # c22 is a sum of multiples of 2e-9
    return found.select("graph_id", "pose_id", *[rnd(k, 9 if k == "c22" else 5).alias(k) for k in motion.MOTION])


def loop_constraints(spark, sf):
    """The constraint between each pose and the one 20 steps on."""
    p = cut(motion.composed(step_motions(spark, sf), block=16), "prefixes")
    pairs = p.select("graph_id", F.col("pose_id").alias("i"), (F.col("pose_id") + 20).alias("j"))
    found = motion.loop_constraints(p, pairs, trans=(0.05, 2.0), ang=(0.01, 0.5))
    return found.select("graph_id", "i", "j", *[rnd(k, 9 if k == "c22" else 5).alias(k) for k in ("radial", "sd_radial", "sd_tangential", "sd_angular", *motion.COVARIANCE)])


# without SQL: kernels and sequential operators


def seen_points(spark, sf) -> DataFrame:
    """World points with their normals and where they were seen from."""
    return world_normals(spark, sf).select("graph_id", "wx", "wy", F.col("wnx").alias("nx"), F.col("wny").alias("ny"), F.col("x").alias("sx"), F.col("y").alias("sy"))


def batch_localize(spark, sf):
    from ..operators.localize import localize

    p, s = fx.poses(spark, sf).select("graph_id", "pose_id", "x", "y", "th"), fx.scans(spark, sf)
    seen = p.join(s.select("graph_id", "pose_id").distinct(), ["graph_id", "pose_id"], "left_semi")
    return localize(seen, s, more_than=2)


def _wall_points(spark, sf) -> DataFrame:
    """Wall points, their walls as segments."""
    return fx.walls(spark, sf).withColumnsRenamed({"wall": "seg_id"})


def _wall_guesses(spark, sf) -> DataFrame:
    """Each wall with the mass of its points, its ends guessed askew."""
    w = fx.walls(spark, sf).groupBy("graph_id", F.col("wall").alias("seg_id")).agg(F.count("*").alias("mass"))
    x, y, a = fx.wall(F.col("graph_id"), F.col("seg_id"))
    u, v, n = F.cos(a), F.sin(a), fx.WALL_LENGTH
    return w.select("graph_id", "seg_id", "mass", (x + 0.3 * u - 0.2 * v).alias("x0"), (y + 0.3 * v + 0.2 * u).alias("y0"), (x + 0.8 * n * u + 0.1 * v).alias("x1"), (y + 0.8 * n * v - 0.1 * u).alias("y1"))


def segment_ends(spark, sf):
    """Every wall with both ends fitted to its points."""
    return out(uncertain.fit_ends(_wall_points(spark, sf), _wall_guesses(spark, sf), ["graph_id", "seg_id"]), ["graph_id", "seg_id", "n"], [*uncertain.ENDS, "cost"], 4)


def sensor_noise(spark, sf):
    """What the sensor makes uncertain of each wall point."""
    w = uncertain.sensor_covariance(fx.walls(spark, sf).withColumns({k: F.col(k) * 4 for k in ("sx", "sy")}))
    w = w.groupBy("graph_id", F.col("wall").alias("seg_id")).agg(F.count("*").alias("n"), *[(F.sum(k) * 1e3).alias(k) for k in ("qxx", "qxy", "qyy")])
    return out(w, ["graph_id", "seg_id", "n"], ["qxx", "qxy", "qyy"], 4)


def sensor_ends(spark, sf):
    """How sure the ends of each wall are under the sensor's noise."""
    points = _wall_points(spark, sf)
    fitted = snapshot(uncertain.fit_ends(points, _wall_guesses(spark, sf), ["graph_id", "seg_id"]))
    found = uncertain.sensor_uncertainty(points, fitted, ["graph_id", "seg_id"], ["wx", "wy"], 20)
    return out(found, ["graph_id", "seg_id"], ["c0xx", "c0xy", "c0yy", "c1xx", "c1xy", "c1yy"])


def resampled_ends(spark, sf):
    """The same of walls that keep only their ends and mass."""
    found = uncertain.resampled(_wall_guesses(spark, sf), ["graph_id", "seg_id"], fx.WALL_NOISE, 100)
    return out(found, ["graph_id", "seg_id"], ["c0xx", "c0xy", "c0yy", "c1xx", "c1xy", "c1yy", "mx", "my"])


def segment_fit(spark, sf):
    w = fx.world(spark, sf)
    rows = w.select("graph_id", F.lit(1).alias("sel_id"), *[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), SEG_A, strict=True)], "wx", "wy")
    return solve.fit_segments(rows.where(g.segment_distance("wx", "wy", *SEG_A) < 1.0), PICK)


def joint_solve(spark, sf):
    p = fx.poses(spark, sf)
    t = p.where("pose_id % 20 = 19").select("graph_id", F.lit(2).alias("type"), F.col("pose_id").alias("constrained_id"), (F.col("x") + 0.2).alias("tx"), (F.col("y") - 0.1).alias("ty"), F.col("th").alias("tth"), F.lit(0.0).alias("penalty"))
    return solve.joint_solve(p, t)


def odometry_terms(poses: DataFrame, sd=(0.03, 0.03, 0.01)) -> DataFrame:
    """Rows of the residual ``pose_edge``: the motion between successive poses as it is now."""
    names = ("sd_radial", "sd_tangential", "sd_angular")
    return sensors.edges(poses).select("graph_id", (F.col("pose_id") - 1).alias("i"), F.col("pose_id").alias("j"), "radial", F.coalesce("direction", F.lit(0.0)).alias("direction"), "rotation", *[F.lit(v).alias(n) for n, v in zip(names, sd, strict=True)])


def match_terms(points: DataFrame, matches: DataFrame, sd: float, factor: float = 1.0) -> DataFrame:
    """Rows of the residual ``point_to_point``: every match's points and normals in their own frames, each pair of scans weighing one."""
    a = points.select("graph_id", "pose_id", "obs_id", "px", "py", "nx", "ny")
    b = points.select("graph_id", F.col("pose_id").alias("to_pose"), F.col("obs_id").alias("to_obs"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("nx").alias("mx"), F.col("ny").alias("my"))
    both = matches.select("graph_id", "pose_id", "obs_id", "to_pose", "to_obs", "n_matches").join(a, ["graph_id", "pose_id", "obs_id"]).join(b, ["graph_id", "to_pose", "to_obs"])
    return both.select("graph_id", F.col("pose_id").alias("i"), F.col("to_pose").alias("j"), "px", "py", "nx", "ny", "qx", "qy", "mx", "my", F.lit(sd).alias("sd"), F.lit(factor).alias("factor"), (1 / F.col("n_matches")).alias("weight"))


def _loops(spark, sf):
    """Trajectories with scans, and what holds them: their odometry, and the matches between all their scans."""
    points = snapshot(world_normals(spark, sf))
    matches = match.all_pairs(points, 0.4, window=60, angle_deg=60.0, cap=5, more_than=2)
    p = snapshot(fx.poses(spark, sf).join(points.select("graph_id").distinct(), "graph_id", "left_semi"))
    return p, {"pose_edge": snapshot(odometry_terms(p)), "point_to_point": snapshot(match_terms(points, matches, 0.5))}


def loop_step(spark, sf):
    """The first step of their refinement, by conjugate gradients over stretches of 32 poses."""
    p, terms = _loops(spark, sf)
    system = cut(refine.normal_equations(p, terms).where("i > 0 and j > 0"), "system")
    return out(refine.conjugate_gradients(system, 32, 1e-9), ["graph_id", "pose_id"], ["s0", "s1", "s2"], 5)


def loop_refine(spark, sf):
    """They are refined, loops included."""
    found = refine.refine(*_loops(spark, sf))
    return found.select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), *[rnd(k, 5).alias(k) for k in ("x", "y", "th", "cost_before", "cost_after")])


def ransac(spark, sf):
    """The walls of the wall points, tile by tile."""
    return lines.ransac(fx.walls(spark, sf), 4.0, inliers=40, share=0.6)


def curate(spark, sf):
    """The line map of each graph's wall points, from points to lines merged with themselves."""
    found, _ = linemap.curate(fx.walls(spark, sf), res=RES, tile=4.0, inliers=6, share=0.3)
    return found.select("graph_id", "seg_id", *[rnd(k).alias(k) for k in (*linemap.ENDS, "mass", *linemap.COVS)])


def scan_normals(spark, sf):
    return sensors.scan_normals(fx.scans(spark, sf).select("graph_id", "pose_id", "obs_id", "px", "py"), REACH)


def gate_keyframes(spark, sf):
    return sensors.gate(fx.poses(spark, sf), 1.0, 0.5)


def bootstrap_cov(spark, sf):
    rows = fx.world(spark, sf).where(g.segment_distance("wx", "wy", *SEG_A) < 0.3)
    return lines.bootstrap(rows.select("graph_id", *[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), SEG_A, strict=True)], "wx", "wy"))


def correction_log(world: DataFrame) -> DataFrame:
    """(graph_id, type, points): an entry for each graph, from its own points.

    It draws the chord that sees most of a scan on the best pose of either half of the trajectory, the later one to be
    corrected onto the earlier one; kinds go around by graph.
    """
    import numpy as np
    import pandas as pd

    near, kinds = Config().inlier, [k for k in VALID if k != Correction.POINT]

    def chord(xy):
        i, j = np.triu_indices(len(xy), 1)
        d = xy[j] - xy[i]
        n = np.hypot(*d.T)
        i, j, d, n = (v[n > 0] for v in (i, j, d, n))
        if not len(n):
            return 0, None
        r = xy[None] - xy[i][:, None]
        t = np.clip((r * d[:, None]).sum(2) / n[:, None] ** 2, 0, 1)
        seen = (np.hypot(*np.moveaxis(r - t[..., None] * d[:, None], 2, 0)) < near).sum(1)
        k = int(seen.argmax())
        return int(seen[k]), [*xy[i[k]].tolist(), *xy[j[k]].tolist()]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        graph = int(frame.graph_id.iloc[0])
        found = [(p, *chord(own.sort_values("obs_id")[["wx", "wy"]].to_numpy())) for p, own in frame.groupby("pose_id")]
        found = [x for x in found if x[2]]
        half = (found[0][0] + found[-1][0] + 1) // 2 if found else 0
        early, late = (max((x for x in found if (x[0] >= half) == side), key=lambda x: (x[1], -x[0]), default=None) for side in (False, True))
        rows = [(graph, kinds[graph % len(kinds)], [*late[2], *early[2]])] if early and late else []
        return pd.DataFrame(rows, columns=["graph_id", "type", "points"])

    return world.select("graph_id", "pose_id", "obs_id", "wx", "wy").groupBy("graph_id").applyInPandas(run, "graph_id long, type int, points array<double>")


def replay(spark, sf):
    """Every trajectory after the session of its graph: an entry drawn from its own scans is replayed; poses without scans stay."""
    from .replay import replay as all_graphs

    p = snapshot(fx.poses(spark, sf).select("graph_id", "pose_id", "x", "y", "th", "var_t", "var_r"))
    s = snapshot(fx.scans(spark, sf).select("graph_id", "pose_id", "obs_id", "px", "py").join(p.select("graph_id", "pose_id"), ["graph_id", "pose_id"], "left_semi"))
    wx, wy = g.to_world("px", "py", "x", "y", "th")
    log = correction_log(s.join(p, ["graph_id", "pose_id"]).withColumns({"wx": wx, "wy": wy})).select("graph_id", F.lit(0).alias("entry_id"), "type", F.lit(False).alias("undone"), "points")
    return all_graphs(p, s, log).select("graph_id", "pose_id", *[rnd(c).alias(c) for c in ("x", "y", "th")])


def stream_corrections(spark, sf):
    """The commands that the events give when they are read as clicks and keys: the session reducer over each user's events."""
    import pandas as pd

    from ..streaming.events import COMMANDS, step

    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.select(
        "session_id", "event_id", "ts", F.when(F.col("k") % 5 == 0, "key").otherwise("click").alias("event_type"), (F.col("k") % 8).alias("modifiers"), F.when(F.col("k") % 2 == 0, 0x50).otherwise(0x55).alias("keycode"),
        F.col("value").alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.col("value").alias("y1"),
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state, rows = (False, 0, 0, ""), []
        for i, ev in enumerate(frame.sort_values(["ts", "event_id"]).to_dict("records")):
            state, commands = step(state, ev)
            rows += [(ev["session_id"], i, *c) for c in commands]
        return pd.DataFrame(rows, columns=["session_id", "seq", "command", "type", "points"])

    return e.groupBy("session_id").applyInPandas(run, COMMANDS)


_NAMES = """odometry_prefix pose_edges world_points robot_frame relative_pose wrap_angles segment_distance segment_distance_compat line_ops geom_ops scalar_ops
pill_select verify_points selection_overlap order_bounds contiguous_groups pose_runs colocate collinear perpendicular parallel suffix_motion constraint_targets
backprop cov_scale scan_normals_window nn_l2 nn_normal radius_search visual_odometry stf_pairs residual_rms residual_pose residual_human residual_wall residual_glob
sdf_grid sdf_merge consistency consistency_hist endpoint_cov scatter cov_ellipse segment_match merge_segments motion_sd polar_scan range_correction
latest_per_publisher display_lines adjacency raster modifier_decode argb_unpack event_windows vector_ops cov_rotate
scalar_more pose_differences scan_bounds sdf_normalised message_window keyframe_poses drags residual_cumulative motion_scan loop_constraints
crowd_select closest_observations closest_pair_motion residual_relative relative_gradients residual_object message_log
seeded_draws pose_draws sensor_noise segment_ends sensor_ends resampled_ends
match_lines merge_lines self_merge_round screen_points drawn_rectangles display_compiled display_throttled
segment_fit joint_solve loop_step loop_refine ransac scan_normals gate_keyframes bootstrap_cov replay stream_corrections batch_localize curate"""


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in _NAMES.split()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pill_select(spark, sf_dir)
