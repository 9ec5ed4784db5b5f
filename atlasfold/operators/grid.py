"""Grids as sparse rows: signed distances, their merging, rasters, occupancy and consistency."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import c, dot, length, unit
from ..snapshot import snapshot

#: Truncation, least value, full-weight band, decay and least weight of the signed distance.
TRUNCATE, BEHIND, BAND, DECAY, LEAST = 0.2, 0.2, 0.02, 30.0, 0.01


def ray_cells(rays: DataFrame, res: float, beyond: float = BEHIND) -> DataFrame:
    """Cells (ix, iy) whose centre lies within half a cell's diagonal of a ray (sx, sy) to (wx, wy), up to ``beyond`` behind its end.

    Candidates are, for each column of cells (or row, along the longer axis), the few beside the ray: a ray's cells are made
    once each inside its row, and the work follows its length. Equal rays count once.
    """
    ux, uy = unit(F.col("wx") - F.col("sx"), F.col("wy") - F.col("sy"))
    half = res * math.sqrt(2) / 2
    r = rays.distinct().withColumns({"_ux": ux, "_uy": uy, "_len": length(F.col("wx") - F.col("sx"), F.col("wy") - F.col("sy"))}).where("_len > 0")
    flat = F.abs("_ux") >= F.abs("_uy")
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    r = r.withColumns({"_flat": flat, "_s": pick("sx", "sy"), "_e": pick("wx", "wy"), "_f": pick("wy", "wx"), "_u": pick("_ux", "_uy"), "_v": pick("_uy", "_ux")})
    far = F.col("_e") + beyond * F.col("_u")
    index = lambda of, x: of(x / res).cast("int")
    s = r.withColumn("_i", F.explode(F.sequence(index(F.floor, F.least("_s", far) - half), index(F.ceil, F.greatest("_s", far) + half))))
    s = s.withColumns({"_at": F.col("_f") + F.col("_v") / F.col("_u") * (F.col("_i") * res - F.col("_e")), "_by": half / F.abs("_u")})
    s = s.withColumn("_j", F.explode(F.sequence(index(F.floor, F.col("_at") - F.col("_by")), index(F.ceil, F.col("_at") + F.col("_by")))))
    s = s.withColumns({"ix": F.when(F.col("_flat"), F.col("_i")).otherwise(F.col("_j")), "iy": F.when(F.col("_flat"), F.col("_j")).otherwise(F.col("_i"))})
    px, py = F.col("ix") * res - F.col("wx"), F.col("iy") * res - F.col("wy")
    off = F.abs(F.col("_ux") * py - F.col("_uy") * px)
    sdf = -dot("_ux", "_uy", px, py)
    hit = s.withColumns({"off": off, "sdf": sdf}).where((F.col("off") < half) & (F.col("sdf") >= -beyond) & (F.col("sdf") <= F.col("_len") + 1e-9))
    return hit.select(*rays.columns, "ix", "iy", "sdf")


def sdf(rays: DataFrame, res: float, keys: list[str]) -> DataFrame:
    """(keys, ix, iy, value, weight): the weighted mean of truncated signed distances; order free."""
    hit = ray_cells(rays, res)
    v = F.least("sdf", F.lit(TRUNCATE))
    w = F.when(F.abs(v) <= BAND, F.lit(1.0)).when(F.col("sdf") > TRUNCATE, F.lit(LEAST)).otherwise(F.exp(-DECAY * (v - BAND) * (v - BAND)))
    return hit.groupBy(*keys, "ix", "iy").agg((F.sum(w * v) / F.sum(w)).alias("value"), F.sum(w).alias("weight"))


def binarised(grid: DataFrame, keys: list[str], share: float = 0.2) -> DataFrame:
    """Weights as 0 or 255, by a share of the grid's largest."""
    top = grid.groupBy(*keys).agg(F.max("weight").alias("_top"))
    return grid.join(top, keys).withColumn("weight", F.when(F.col("weight") > share * F.col("_top"), 255.0).otherwise(0.0)).drop("_top")


def merge(grids: DataFrame, keys: list[str]) -> DataFrame:
    """Several runs' grids of one frame as one: means weighted by weight, and weights added."""
    return grids.groupBy(*keys, "ix", "iy").agg((F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("value"), F.sum("weight").alias("weight"))


def filter_points(points: DataFrame, grid: DataFrame, res: float, keys: list[str], share: float = 0.95, near: float = 0.05) -> DataFrame:
    """Points in cells of high weight that lie at a surface: bicubic value near 0, over the 16 nodes around each point.

    The nodes of each cell are brought together beforehand, so a point meets the grid in one row.
    """
    top = grid.groupBy(*keys).agg(F.max("weight").alias("_top"))
    places = [(i, j) for i in range(-1, 3) for j in range(-1, 3)]
    around = grid.select(*keys, "ix", "iy", "value", "weight", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in places])).alias("_n"))
    around = around.withColumns({"_gx": F.col("ix").cast("long") - F.col("_n.i"), "_gy": F.col("iy").cast("long") - F.col("_n.j")})
    node = lambda of, i, j: F.coalesce(F.sum(F.when((F.col("_n.i") == i) & (F.col("_n.j") == j), F.col(of))), F.lit(0.0))
    around = around.groupBy(*keys, "_gx", "_gy").agg(*[node(of, i, j).alias(f"_{of}{k}") for of in ("value", "weight") for k, (i, j) in enumerate(places)]).join(top, keys)

    def key(t, k):
        d = F.abs(c(t) - k)
        # never null, or tests for that are worked out for every point before the join
        return F.coalesce(F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2), F.lit(0.0))

    p = points.withColumns({"_gx": F.floor(F.col("wx") / res), "_gy": F.floor(F.col("wy") / res)})
    p = p.withColumns({"_tx": F.col("wx") / res - F.col("_gx"), "_ty": F.col("wy") / res - F.col("_gy")})
    p = p.select(*points.columns, "_gx", "_gy", *[key(f"_t{a}", i).alias(f"_k{a}{i + 1}") for a in "xy" for i in range(-1, 3)])

    def total(of):
        s = F.lit(0.0)
        for k, (i, j) in enumerate(places):
            s = s + F.col(f"_kx{i + 1}") * F.col(f"_ky{j + 1}") * F.col(f"_{of}{k}")
        return s

    kept = p.join(around, [*keys, "_gx", "_gy"]).where((total("weight") > share * F.col("_top")) & (F.abs(total("value")) < near))
    return kept.select(*points.columns)


def raster(points: DataFrame, res: float, keys: list[str]) -> DataFrame:
    """Points per cell."""
    return points.groupBy(*keys, F.floor(F.col("wx") / res).cast("int").alias("ix"), F.floor(F.col("wy") / res).cast("int").alias("iy")).agg(F.count("*").alias("n"))


def occupied(points: DataFrame, res: float) -> DataFrame:
    """The distinct cells that each scan hits."""
    return points.select("graph_id", "pose_id", F.floor(F.col("wx") / res).cast("int").alias("ix"), F.floor(F.col("wy") / res).cast("int").alias("iy")).distinct()


def inconsistency(points: DataFrame, poses: DataFrame, res: float = 0.05, reach: float = 10.0) -> DataFrame:
    """(graph_id, pose_a, pose_b, n) of pairs of scans taken within ``reach``: cells that one has and the other lacks.

    |A| + |B| - 2 |A and B|; pairs of poses are found by cells of ``reach``, where ids and places alone meet, and each pair
    intersects the scans' sets of cells, which join it once for each side. A wall that many scans see makes no rows of its own.
    """
    cell = F.struct(F.floor(F.col("wx") / res).cast("int").alias("ix"), F.floor(F.col("wy") / res).cast("int").alias("iy"))
    sizes = points.groupBy("graph_id", "pose_id").agg(F.collect_set(cell).alias("n"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = poses.join(points.select("graph_id", "pose_id").distinct(), ["graph_id", "pose_id"], "left_semi").select("graph_id", "pose_id", "x", "y", F.floor(F.col("x") / reach).alias("_cx"), F.floor(F.col("y") / reach).alias("_cy"))
    a = at.select("graph_id", F.col("pose_id").alias("pose_a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "_cx", "_cy").withColumn("_o", F.explode(around))
    a = a.withColumns({"_cx": F.col("_cx") + F.col("_o.i"), "_cy": F.col("_cy") + F.col("_o.j")}).drop("_o")
    b = at.select("graph_id", F.col("pose_id").alias("pose_b"), F.col("x").alias("bx"), F.col("y").alias("by"), "_cx", "_cy")
    close = a.join(b, ["graph_id", "_cx", "_cy"]).where((F.col("pose_a") < F.col("pose_b")) & (length(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) < reach)).select("graph_id", "pose_a", "pose_b")
    for k in ("a", "b"):
        close = close.join(sizes.select("graph_id", F.col("pose_id").alias(f"pose_{k}"), F.col("n").alias(f"n{k}")), ["graph_id", f"pose_{k}"])
    return close.select("graph_id", "pose_a", "pose_b", (F.size("na") + F.size("nb") - 2 * F.size(F.array_intersect("na", "nb"))).alias("n"))


def normalised(grid: DataFrame, keys: list[str], limit: float = TRUNCATE) -> DataFrame:
    """Values and weights of each grid scaled to 255 by the largest (values by 0 or less stay as they are), and the colours of its picture.

    red: how far a value is below 0, green: at or above 0, both as shares of ``limit`` in 255 steps.
    """
    top = grid.groupBy(*keys).agg(F.max("value").alias("_v"), F.max("weight").alias("_w"))
    scaled = lambda x, m: F.when(F.col(m) > 0, F.col(x) * 255 / F.col(m)).otherwise(F.col(x))
    shade = F.least(F.floor(F.abs("value") / limit * 255), F.lit(255)).cast("int")
    above = F.col("value") >= 0
    return grid.join(top, keys).select(*keys, "ix", "iy", scaled("value", "_v").alias("value"), scaled("weight", "_w").alias("weight"), F.when(above, 0).otherwise(shade).alias("red"), F.when(above, shade).otherwise(0).alias("green"))


def bounds(points: DataFrame, keys: list[str], x: str = "wx", y: str = "wy") -> DataFrame:
    """The bounding box of each group, and each dimension's mean and spread (the sum of squares off the mean)."""
    n = F.count("*")
    return points.groupBy(*keys).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), (F.var_pop(x) * n).alias("x_spread"), (F.var_pop(y) * n).alias("y_spread"),
    )


def histogram(scored: DataFrame, value: str = "n", bins: int = 10) -> DataFrame:
    """(graph_id, bin, n_pairs) of the values as shares of the graph's largest; the largest is in the last bin. No rows where all are 0."""
    top = scored.groupBy("graph_id").agg(F.max(value).alias("_top"))
    b = F.least(F.floor(F.col(value) * bins / F.nullif("_top", F.lit(0))), F.lit(bins - 1)).cast("int")
    return scored.join(top, "graph_id").withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy("graph_id", "bin").agg(F.count("*").alias("n_pairs"))
