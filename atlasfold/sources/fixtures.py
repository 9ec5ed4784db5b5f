"""Pose graphs and scans derived from the driver's tables, with explicit order columns.

A user's events are one trajectory: value and props.k make the odometry. An
embedding is one ordered scan of points. Scans of label g are seen from the
poses of user g.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import to_world


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, pose_id, ts, dx, dy, dth, var_t, var_r)"""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("graph_id"),
        (F.row_number().over(order) - 1).alias("pose_id"),
        "ts",
        (F.col("value") / 100).alias("dx"),
        F.lit(0.0).alias("dy"),
        ((F.col("k") - 50) * 0.02).alias("dth"),
        (1e-3 * (1 + F.col("k") / 100)).alias("var_t"),
        (1e-4 * (1 + F.col("value") / 500)).alias("var_r"),
    )


def by_pose() -> Window:
    return Window.partitionBy("graph_id").orderBy("pose_id")


def integrate(odo: DataFrame) -> DataFrame:
    """Poses from robot-frame motion: two prefix sums over one sort."""
    w = by_pose()
    turned = odo.withColumn("th", F.sum("dth").over(w))
    before = F.coalesce(F.lag("th").over(w), F.lit(0.0))
    moved = turned.withColumn("_a", before)
    return (
        moved.withColumn("x", F.sum(F.col("dx") * F.cos("_a") - F.col("dy") * F.sin("_a")).over(w))
        .withColumn("y", F.sum(F.col("dx") * F.sin("_a") + F.col("dy") * F.cos("_a")).over(w))
        .drop("_a")
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, pose_id, ts, x, y, th, var_t, var_r)"""
    return integrate(odometry(spark, sf_dir)).select("graph_id", "pose_id", "ts", "x", "y", "th", "var_t", "var_r")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, pose_id, obs_id, px, py, nx, ny): points in the robot frame, normals away from the robot."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    order = Window.partitionBy("label").orderBy("vec_id")
    v = e.select(F.col("label").cast("long").alias("graph_id"), (F.row_number().over(order) - 1).alias("pose_id"), "embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("px"), F.get("embedding", 2 * i + 1).cast("double").alias("py")))
    s = v.select("graph_id", "pose_id", F.posexplode(pairs).alias("obs_id", "p")).select("graph_id", "pose_id", "obs_id", "p.px", "p.py")
    a = F.atan2("py", "px")
    return s.withColumns({"nx": F.cos(a), "ny": F.sin(a)})


#: Walls of a graph, their length, and how far points may lie off them.
WALLS, WALL_LENGTH, WALL_NOISE = 7, 3.0, 0.05


def wall(graph: Column, number: Column) -> tuple[Column, Column, Column]:
    """Where a wall starts, and its direction."""
    return number * 2.3, F.pmod(graph * 2 + number * 3, F.lit(5)) * 1.7, number * 0.9 + graph


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points seen on walls: (graph_id, wall, wx, wy, nx, ny, sx, sy), sources a metre off."""
    i = table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(4)).cast("long").alias("graph_id"),
        F.pmod("l_linenumber", F.lit(WALLS)).cast("long").alias("wall"),
        (F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31, F.lit(9973)) / 9973.0).alias("t"),
        ((F.pmod(F.col("l_partkey") * 17 + F.col("l_orderkey"), F.lit(61)) - 30) / 30.0 * WALL_NOISE).alias("off"),
    )
    x0, y0, a = wall(F.col("graph_id"), F.col("wall"))
    u, v = F.cos(a), F.sin(a)
    i = i.withColumns({"nx": -v, "ny": u, "wx": x0 + F.col("t") * WALL_LENGTH * u - F.col("off") * v, "wy": y0 + F.col("t") * WALL_LENGTH * v + F.col("off") * u})
    return i.select("graph_id", "wall", "wx", "wy", "nx", "ny", (F.col("wx") + F.col("nx")).alias("sx"), (F.col("wy") + F.col("ny")).alias("sy"))


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans seen from their poses: (graph_id, pose_id, obs_id, px, py, nx, ny, x, y, th, wx, wy)"""
    p = poses(spark, sf_dir).select("graph_id", "pose_id", "x", "y", "th")
    joined = scans(spark, sf_dir).join(p, ["graph_id", "pose_id"])
    wx, wy = to_world("px", "py", "x", "y", "th")
    return joined.withColumns({"wx": wx, "wy": wy})
