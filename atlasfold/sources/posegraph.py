"""Pose-graph text files: two header lines, then an observation a line, in the world frame.

Order has meaning (runs of equal poses, neighbours in a scan), so lines carry
their number from the file. Files are read whole, one row a file, and split on
the executors; a folder of files is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import rotate, to_robot, to_world
from ..operators.select import runs

FIELDS = ["pose_x", "pose_y", "pose_th", "obs_x", "obs_y", "normal_x", "normal_y"]
COVARIANCE = [f"covar_{a}{b}" for a in ("x", "y", "th") for b in ("x", "y", "th")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, line numbers from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("line_no", "line"))


def read_observations(spark: SparkSession, path: str, n_fields: int = 16, mode: str = "FAILFAST") -> DataFrame:
    """(file, map_name, stamp, line_no, fields…) in the order of the file.

    mode FAILFAST: a malformed line is an error that names it. PERMISSIVE: the file ends before it.
    """
    if n_fields not in (7, 16):
        raise ValueError("7 or 16 fields")
    names = (FIELDS + COVARIANCE)[:n_fields]
    lines = read_lines(spark, path)
    head = lines.where("line_no < 2").groupBy("file").agg(
        F.max(F.when(F.col("line_no") == 0, F.trim("line"))).alias("map_name"), F.max(F.when(F.col("line_no") == 1, F.expr("try_cast(trim(line) as double)"))).alias("stamp")
    )
    body = lines.where("line_no >= 2").where(F.trim("line") != "")
    values = F.transform(F.split(F.regexp_replace(F.trim("line"), r",\s*$", ""), r"\s*,\s*"), lambda x: x.try_cast("double"))
    parsed = body.withColumn("v", values).withColumn("bad", (F.size("v") != n_fields) | F.exists("v", lambda x: x.isNull()))
    if mode == "FAILFAST":
        parsed = parsed.where(F.when(F.col("bad"), F.raise_error(F.format_string("%s, line %d is malformed", "file", F.col("line_no") + 1)).isNull()).otherwise(F.lit(True)))
    elif mode == "PERMISSIVE":
        first = parsed.where("bad").groupBy("file").agg(F.min("line_no").alias("_bad"))
        parsed = parsed.join(first, "file", "left").where(F.col("_bad").isNull() | (F.col("line_no") < F.col("_bad")))
    else:
        raise ValueError(mode)
    return parsed.join(F.broadcast(head), "file").select("file", "map_name", "stamp", "line_no", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_posegraph(spark: SparkSession, path: str, n_fields: int = 16, compat: bool = False, placeholder: bool = False, self_hit: float = 0.0, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame]:
    """(poses, scans): a pose for each run of equal (x, y, th), points and normals in its frame, covariance from its first line.

    ``compat``: normals are shifted with the points, as older tools did. ``placeholder``: an observation at the
    pose itself stands for an empty scan and is left out. ``self_hit``: observations at most this far are left out.
    """
    rows = runs(read_observations(spark, path, n_fields, mode), ["pose_x", "pose_y", "pose_th"], by=["file"])
    rows = rows.withColumn("graph_id", F.xxhash64("file")).withColumnRenamed("run_id", "pose_id")
    cov = F.array(*[F.col(c) for c in COVARIANCE]) if n_fields == 16 else F.lit(None).cast("array<double>")
    poses = rows.groupBy("graph_id", F.col("pose_id").cast("int").alias("pose_id")).agg(
        F.min_by(F.struct(F.col("pose_x").alias("x"), F.col("pose_y").alias("y"), F.col("pose_th").alias("th"), cov.alias("cov")), "line_no").alias("p")
    )
    poses = poses.select("graph_id", "pose_id", "p.x", "p.y", "p.th", "p.cov")
    px, py = to_robot("obs_x", "obs_y", "pose_x", "pose_y", "pose_th")
    nx, ny = to_robot("normal_x", "normal_y", "pose_x", "pose_y", "pose_th") if compat else rotate("normal_x", "normal_y", -F.col("pose_th"))
    scans = rows.select("graph_id", F.col("pose_id").cast("int").alias("pose_id"), "line_no", px.alias("px"), py.alias("py"), nx.alias("nx"), ny.alias("ny"))
    if placeholder:
        scans = scans.where((F.abs("px") > 1e-9) | (F.abs("py") > 1e-9))
    if self_hit:
        scans = scans.where(F.hypot("px", "py") > self_hit)
    order = Window.partitionBy("graph_id", "pose_id").orderBy("line_no")
    return poses, scans.select("graph_id", "pose_id", (F.row_number().over(order) - 1).alias("obs_id"), "px", "py", "nx", "ny")


def write_posegraph(poses: DataFrame, scans: DataFrame, path: str, map_name: str, stamp: float, n_fields: int = 16) -> None:
    """The inverse, one folder with one part; an empty scan gives one observation at the pose."""
    wx, wy = to_world("px", "py", "x", "y", "th")
    vx, vy = rotate("nx", "ny", "th")
    j = poses.join(scans, ["graph_id", "pose_id"], "left")
    o = j.select(
        "graph_id", "pose_id", F.coalesce("obs_id", F.lit(0)).alias("obs_id"), "x", "y", "th",
        F.coalesce(wx, F.col("x")).alias("wx"), F.coalesce(wy, F.col("y")).alias("wy"), F.coalesce(vx, F.lit(0.0)).alias("vx"), F.coalesce(vy, F.lit(0.0)).alias("vy"), "cov",
    )
    cols = [F.col(c) for c in ("x", "y", "th", "wx", "wy", "vx", "vy")]
    form = "%.4f,%.4f,%.4f, %.4f,%.4f, %.4f,%.4f"
    if n_fields == 16:
        cols += [F.coalesce(F.get("cov", F.lit(i)), F.lit(0.0)) for i in range(9)]
        form += ", %f" * 9
    body = o.select(F.lit(1).alias("_h"), "graph_id", "pose_id", "obs_id", F.format_string(form, *cols).alias("value"))
    head = poses.sparkSession.createDataFrame([(0, 0, 0, 0, map_name), (0, 0, 0, 1, f"{stamp:f}")], "_h int, graph_id long, pose_id int, obs_id int, value string")
    head.unionByName(body).orderBy("_h", "graph_id", "pose_id", "obs_id").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_poses(poses: DataFrame, path: str, with_time: bool = False, separator: str = " ") -> None:
    """``x y th`` (or ``t x y th``) a line, in order."""
    cols = (["t"] if with_time else []) + ["x", "y", "th"]
    line = F.format_string(separator.join(["%f"] * len(cols)), *[F.col(c).cast("double") for c in cols])
    poses.orderBy("graph_id", "pose_id").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """Sorted time stamps, one a line."""
    return spark.read.text(path).select(F.trim("value").try_cast("double").alias("t")).where("t is not null").orderBy("t")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``x y px py nx ny`` a line."""
    return spark.read.csv(path, sep=" ", schema="x double, y double, px double, py double, nx double, ny double")


def write_points(points: DataFrame, path: str) -> None:
    points.select("x", "y", "px", "py", "nx", "ny").write.mode("append").csv(path, sep=" ")


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """``id name`` a line."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)\s+(\S+)", 1).try_cast("int").alias("map_id"), F.regexp_extract("value", r"^\s*(\d+)\s+(\S+)", 2).alias("name")).where("map_id is not null")


def read_laser_corrections(spark: SparkSession, path: str) -> DataFrame:
    """``n,0`` then ``angle,delta`` lines: (bin, angle, delta) in the order of the file."""
    rows = read_lines(spark, path).where("line_no >= 1 and trim(line) != ''")
    v = F.split("line", ",")
    return rows.select((F.col("line_no") - 1).alias("bin"), F.trim(F.get(v, F.lit(0))).cast("double").alias("angle"), F.trim(F.get(v, F.lit(1))).cast("double").alias("delta"))


def read_grid(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A text grid: ``w h``, ``ox oy``, then values x by x: (file, ix, iy, ox, oy, value)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("v"))
    num = lambda i: F.get("v", F.lit(i)).cast("double")
    at = whole.select("file", num(1).cast("int").alias("h"), num(2).alias("ox"), num(3).alias("oy"), F.posexplode(F.slice("v", 5, F.size("v"))).alias("k", "s"))
    return at.select("file", F.floor(F.col("k") / F.col("h")).cast("int").alias("ix"), F.pmod("k", "h").cast("int").alias("iy"), "ox", "oy", F.col("s").cast("double").alias(value))


def write_grid(grid: DataFrame, path: str, value: str, width: int, height: int, origin: tuple[float, float]) -> None:
    """Sparse cells as a full text grid, missing ones 0."""
    spark = grid.sparkSession
    cells = spark.range(width * height).select(F.floor(F.col("id") / height).cast("int").alias("ix"), F.pmod("id", F.lit(height)).cast("int").alias("iy"))
    body = cells.join(grid.select("ix", "iy", value), ["ix", "iy"], "left").select(F.lit(1).alias("_h"), "ix", "iy", F.format_string("%f", F.coalesce(value, F.lit(0.0))).alias("value"))
    head = spark.createDataFrame([(0, 0, 0, f"{width} {height}"), (0, 0, 1, f"{origin[0]:f} {origin[1]:f}")], "_h int, ix int, iy int, value string")
    head.unionByName(body).orderBy("_h", "ix", "iy").select("value").coalesce(1).write.mode("overwrite").text(path)
