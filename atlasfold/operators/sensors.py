"""From raw readings to poses and points: range scans, bin corrections, motion noise, gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle_mod, clamp, length, rotate


def differences(poses: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less the pose before's, the first as it is; no rotation."""
    w = Window.partitionBy("graph_id").orderBy("pose_id")
    return poses.withColumns({k: F.col(k) - F.coalesce(F.lag(k).over(w), F.lit(0.0)) for k in columns})


def totals(poses: DataFrame, columns: list[str]) -> DataFrame:
    """The way back from differences: sums along the trajectory."""
    w = Window.partitionBy("graph_id").orderBy("pose_id")
    return poses.withColumns({k: F.sum(k).over(w) for k in columns})


def polar_points(scans: DataFrame, low: float, high: float, start: float, step: float, skip: int = 0, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Points of arrays ``ranges``: beams at start + i * step, within [low, high], without ``skip`` beams at either end."""
    keep = [c for c in scans.columns if c != "ranges"]
    beams = scans.withColumn("_n", F.size("ranges")).select(*keep, "_n", F.posexplode("ranges").alias("beam", "range"))
    good = beams.where((F.col("beam") >= skip) & (F.col("beam") < F.col("_n") - skip) & F.col("range").between(low, high) & ~F.isnan("range"))
    a = F.lit(start) + F.col("beam") * step
    return good.select(*keep, "beam", "range", (offset[0] + F.col("range") * F.cos(a)).alias("px"), (offset[1] + F.col("range") * F.sin(a)).alias("py"))


def correct_ranges(points: DataFrame, table: DataFrame, angle: str, bin_width: float) -> DataFrame:
    """Ranges times 1 + delta of their angle's bin; without one unchanged. ``table``: (bin, delta)."""
    b = F.floor(F.col(angle) / bin_width).cast("int")
    return points.withColumn("bin", b).join(table, "bin", "left").withColumn("range", F.col("range") * (1 + F.coalesce("delta", F.lit(0.0)))).drop("delta")


def edges(poses: DataFrame) -> DataFrame:
    """Motion between successive poses: radial (length), direction in the earlier pose's frame, rotation."""
    w = Window.partitionBy("graph_id").orderBy("pose_id")
    lag = lambda k: F.lag(k).over(w)
    p = poses.select("graph_id", "pose_id", "x", "y", "th", lag("x").alias("x0"), lag("y").alias("y0"), lag("th").alias("th0")).where("x0 is not null")
    dx, dy = rotate(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), -F.col("th0"))
    return p.select("graph_id", "pose_id", length(dx, dy).alias("radial"), F.when(length(dx, dy) > 0, F.atan2(dy, dx)).alias("direction"), angle_mod(F.col("th") - F.col("th0")).alias("rotation"), "x0", "y0", "th0", "x", "y", "th")


def motion_noise(edge: DataFrame, radial=(0.2, 0.2), angular=0.2, trans=(0.01, 0.5), ang=(0.005, 0.5)) -> DataFrame:
    """Standard deviations by rate of motion, held between bounds: sd_radial, sd_tangential, sd_angular."""
    return edge.withColumns({
        "sd_radial": clamp(F.col("radial") * radial[0], *trans),
        "sd_tangential": clamp(F.col("radial") * radial[1], *trans),
        "sd_angular": clamp(F.abs("rotation") * angular, *ang),
    })


def gate(odometry: DataFrame, min_translation: float, min_rotation: float) -> DataFrame:
    """Poses that keep a scan: the first, and each that has moved or turned enough since the last kept. Sequential for each graph.

    One graph is one group; groups are bounded by a trajectory, which a task reads once in order.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pose_id")
        kept, last = [], None
        for row in frame.itertuples(index=False):
            turn = abs((row.th - last.th + 3.141592653589793) % 6.283185307179586 - 3.141592653589793) if last is not None else 0.0
            if last is None or ((row.x - last.x) ** 2 + (row.y - last.y) ** 2) ** 0.5 > min_translation or turn > min_rotation:
                kept.append(True)
                last = row
            else:
                kept.append(False)
        return frame[kept][["graph_id", "pose_id", "x", "y", "th"]]

    return odometry.select("graph_id", "pose_id", "x", "y", "th").groupBy("graph_id").applyInPandas(run, "graph_id long, pose_id int, x double, y double, th double")


def scan_normals(points: DataFrame, reach: float) -> DataFrame:
    """Normals from neighbours along each scan; points without a near one are dropped and what follows is held against the survivors. Sequential."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for g, p, ids, xs, ys in zip(frame["graph_id"], frame["pose_id"], frame["ids"], frame["xs"], frame["ys"], strict=True):
                live = list(zip(ids, xs, ys, strict=True))
                i = 0
                while i < len(live):
                    nx = ny = 0.0
                    for a, b in ((i - 1, i), (i, i + 1)):
                        if a >= 0 and b < len(live):
                            dx, dy = live[b][1] - live[a][1], live[b][2] - live[a][2]
                            d = (dx * dx + dy * dy) ** 0.5
                            if 0 < d < reach:
                                nx, ny = nx - dy / d, ny + dx / d
                    n = (nx * nx + ny * ny) ** 0.5
                    if n > 0:
                        live[i] = (*live[i][:3], nx / n, ny / n)
                        i += 1
                    else:
                        del live[i]
                out += [(g, p, x[0], x[1], x[2], x[3], x[4]) for x in live]
            yield pd.DataFrame(out, columns=["graph_id", "pose_id", "obs_id", "px", "py", "nx", "ny"])

    rows = points.groupBy("graph_id", "pose_id").agg(F.array_sort(F.collect_list(F.struct("obs_id", "px", "py"))).alias("s"))
    arrays = rows.select("graph_id", "pose_id", F.col("s.obs_id").alias("ids"), F.col("s.px").alias("xs"), F.col("s.py").alias("ys"))
    return arrays.mapInPandas(run, "graph_id long, pose_id int, obs_id int, px double, py double, nx double, ny double")


def window_normals(points: DataFrame, reach: float) -> DataFrame:
    """The set-based approximation: neighbours before any is dropped."""
    w = Window.partitionBy("graph_id", "pose_id").orderBy("obs_id")

    def part(dx, dy):
        d = length(dx, dy)
        ok = (d < reach) & (d > 0)
        return F.coalesce(F.when(ok, -dy / d), F.lit(0.0)), F.coalesce(F.when(ok, dx / d), F.lit(0.0))

    back = part(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w))
    ahead = part(F.lead("px").over(w) - F.col("px"), F.lead("py").over(w) - F.col("py"))
    raw = points.select("graph_id", "pose_id", "obs_id", "px", "py", (back[0] + ahead[0]).alias("_x"), (back[1] + ahead[1]).alias("_y"))
    n = length("_x", "_y")
    return raw.where(n > 1e-12).select("graph_id", "pose_id", "obs_id", "px", "py", (F.col("_x") / n).alias("nx"), (F.col("_y") / n).alias("ny"))
