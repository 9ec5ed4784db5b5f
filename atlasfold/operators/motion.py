"""Composed motion with covariance: an associative scan over trajectories, and the constraints between any two poses that come of it.

A motion is (x, y, th) in the frame of the pose before, with the covariance of
the three. Composing two is associative, errors included (to first order), so
a trajectory is scanned block by block: each block of BLOCK poses where the
shuffle has put it, then the blocks' totals in the same way, then totals back onto the
blocks. No trajectory is one group or one window.

Defined results: pose ids need not follow each other, but must be distinct in a
graph and not negative; the first motion of a graph starts from the origin;
null components count as nought; an empty table gives no rows; extra columns
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp, length, wrap
from ..snapshot import cut, remove

BLOCK = 1024
COVARIANCE = ("c00", "c01", "c02", "c11", "c12", "c22")
MOTION = ("x", "y", "th", *COVARIANCE)
#: Fixed value: chi-square of two degrees of freedom that 95 % stay under.
CHI2 = 5.991


def compose(a: dict, b: dict, sin=np.sin, cos=np.cos) -> dict:
    """First ``a``, then ``b``; arrays, or columns with their sine and cosine."""
    s, c = sin(a["th"]), cos(a["th"])
    dx, dy = c * b["x"] - s * b["y"], s * b["x"] + c * b["y"]
    # the turn's error of a moves what b adds
    u, v = -dy, dx
    out = {"x": a["x"] + dx, "y": a["y"] + dy, "th": a["th"] + b["th"]}
    out["c00"] = a["c00"] + 2 * u * a["c02"] + u * u * a["c22"] + c * c * b["c00"] - 2 * c * s * b["c01"] + s * s * b["c11"]
    out["c01"] = a["c01"] + v * a["c02"] + u * a["c12"] + u * v * a["c22"] + c * s * (b["c00"] - b["c11"]) + (c * c - s * s) * b["c01"]
    out["c11"] = a["c11"] + 2 * v * a["c12"] + v * v * a["c22"] + s * s * b["c00"] + 2 * c * s * b["c01"] + c * c * b["c11"]
    out["c02"] = a["c02"] + u * a["c22"] + c * b["c02"] - s * b["c12"]
    out["c12"] = a["c12"] + v * a["c22"] + s * b["c02"] + c * b["c12"]
    out["c22"] = a["c22"] + b["c22"]
    return out


def _scanned(own: dict[str, np.ndarray], place: np.ndarray) -> dict[str, np.ndarray]:
    """Inclusive prefixes of runs of rows, ``place`` counting from 0 in each, by doubling: a step composes what lies 1, 2, 4, ... places before."""
    step = 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        joined = compose({k: v[at - step] for k, v in own.items()}, {k: v[at] for k, v in own.items()})
        own = {k: v.copy() for k, v in own.items()}
        for k, v in joined.items():
            own[k][at] = v
        step *= 2
    return own


def composed(motions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(graph_id, pose_id, x, y, th, c00..c22): every motion composed with all before it, in order of pose_id; th isn't wrapped.

    ``motions`` has graph_id, pose_id and MOTION.
    """
    before = [f"_{k}" for k in MOTION]
    schema = f"graph_id long, block long, pose_id long, {', '.join(f'{k} double' for k in (*MOTION, *before))}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None  # the block that the last rows were of, and its prefix
        for frame in frames:
            if not len(frame):
                continue
            ids = frame[["graph_id", "block"]].to_numpy()
            fresh = np.concatenate([[tuple(ids[0]) != key], (ids[1:] != ids[:-1]).any(1)])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
            found = _scanned({k: frame[k].to_numpy(float) for k in MOTION}, np.arange(len(ids)) - start)
            before = {k: np.where(fresh, 0.0, np.concatenate([[0.0], v[:-1]])) for k, v in found.items()}
            if not fresh[0]:
                going = slice(0, int(fresh.argmax()) or len(ids))
                carried = {k: np.full(going.stop, v) for k, v in held.items()}
                for own in (found, before):
                    for k, v in compose(carried, {k: v[going] for k, v in own.items()}).items():
                        own[k][going] = v
            key, held = tuple(ids[-1]), {k: v[-1] for k, v in found.items()}
            yield frame[["graph_id", "block", "pose_id"]].assign(**found, **{f"_{k}": v for k, v in before.items()})

    def level(own: DataFrame) -> DataFrame:
        """Prefixes including a row and without it."""
        keyed = own.withColumn("block", F.floor(F.col("pose_id") / block))
        inner = cut(keyed.select("graph_id", "block", "pose_id", *MOTION).repartition("graph_id", "block").sortWithinPartitions("graph_id", "block", "pose_id").mapInPandas(run, schema), "motion")
        if not inner.where("block > 0").limit(1).count():
            return inner
        last = F.max_by(F.struct(*MOTION), "pose_id")
        totals = inner.groupBy("graph_id", F.col("block").alias("pose_id")).agg(last.alias("m")).select("graph_id", "pose_id", "m.*")
        outer = level(totals)
        held = outer.select("graph_id", F.col("pose_id").alias("block"), *[F.col(f"_{k}").alias(f"o_{k}") for k in MOTION])
        both = inner.join(held, ["graph_id", "block"])
        start = {k: F.col(f"o_{k}") for k in MOTION}
        to, at = (compose(start, {k: F.col(f"{mark}{k}") for k in MOTION}, F.sin, F.cos) for mark in ("", "_"))
        out = cut(both.select("graph_id", "block", "pose_id", *[to[k].alias(k) for k in MOTION], *[at[k].alias(f"_{k}") for k in MOTION]), "motion")
        remove(inner, outer)
        return out

    plain = motions.select("graph_id", F.col("pose_id").cast("long").alias("pose_id"), *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in MOTION])
    return level(plain.withColumn("block", F.lit(0).cast("long"))).select("graph_id", "pose_id", *MOTION)


def between(prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, i, j) with MOTION: pose j seen from pose i < j, with the covariance of the motions in between alone, in i's frame."""
    ends = [prefixes.select("graph_id", F.col("pose_id").alias(end), *[F.col(k).alias(f"{end}_{k}") for k in MOTION]) for end in ("i", "j")]
    both = pairs.select("graph_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).join(ends[0], ["graph_id", "i"]).join(ends[1], ["graph_id", "j"])
    a, b = ({k: F.col(f"{end}_{k}") for k in MOTION} for end in ("i", "j"))
    dx, dy, s, c = b["x"] - a["x"], b["y"] - a["y"], F.sin(a["th"]), F.cos(a["th"])
    # what i's own error makes of the covariance at j
    w00 = b["c00"] - (a["c00"] - 2 * dy * a["c02"] + dy * dy * a["c22"])
    w01 = b["c01"] - (a["c01"] + dx * a["c02"] - dy * a["c12"] - dx * dy * a["c22"])
    w11 = b["c11"] - (a["c11"] + 2 * dx * a["c12"] + dx * dx * a["c22"])
    w02, w12, w22 = b["c02"] - (a["c02"] - dy * a["c22"]), b["c12"] - (a["c12"] + dx * a["c22"]), b["c22"] - a["c22"]
    both = both.withColumns({"_00": w00, "_01": w01, "_11": w11, "_02": w02, "_12": w12, "_22": w22})
    w = {k: F.col(f"_{k[1:]}") for k in COVARIANCE}
    out = {
        "x": c * dx + s * dy, "y": c * dy - s * dx, "th": wrap(b["th"] - a["th"]),
        "c00": c * c * w["c00"] + 2 * c * s * w["c01"] + s * s * w["c11"], "c01": c * s * (w["c11"] - w["c00"]) + (c * c - s * s) * w["c01"], "c11": s * s * w["c00"] - 2 * c * s * w["c01"] + c * c * w["c11"],
        "c02": c * w["c02"] + s * w["c12"], "c12": c * w["c12"] - s * w["c02"], "c22": w["c22"],
    }
    return both.select("graph_id", "i", "j", *[out[k].alias(k) for k in MOTION])


def deviation(cx: Column, cy: Column) -> Column:
    """Of a unit direction within the 95 % ellipse of the covariance's places."""
    return F.sqrt(F.greatest(F.lit(0.0), CHI2 * (cx * cx * F.col("c00") + 2 * cx * cy * F.col("c01") + cy * cy * F.col("c11"))))


def loop_constraints(prefixes: DataFrame, pairs: DataFrame, trans=(0.01, 0.5), ang=(0.005, 0.5), scale: float = 1.0) -> DataFrame:
    """Rows of the residual ``pose_edge`` between the poses of ``pairs``: how far, which way and how much turned, each with its deviation.

    Deviations are the ellipse's along and across the motion, held between bounds; where nothing moved, along the heading.
    """
    m = between(prefixes, pairs)
    m = m.withColumn("radial", length("x", "y")).withColumn("direction", F.when(F.col("radial") > 1e-6, F.atan2("y", "x")).otherwise(F.col("th")))
    along, across = F.cos("direction"), F.sin("direction")
    return m.select(
        "graph_id", "i", "j", F.when(F.col("radial") > 1e-6, F.col("radial")).otherwise(0.0).alias("radial"), "direction", F.col("th").alias("rotation"),
        (scale * clamp(deviation(along, across), *trans)).alias("sd_radial"), (scale * clamp(deviation(-across, along), *trans)).alias("sd_tangential"),
        (scale * clamp(F.sqrt(F.greatest(F.lit(0.0), F.col("c22"))), *ang)).alias("sd_angular"), *COVARIANCE,
    )
