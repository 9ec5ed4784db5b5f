"""Line maps with whole covariances: matching, merging, merging a map with itself, and curation from points.

Segments (keys, seg_id) have ends x0, y0, x1, y1, a covariance for either end (c0xx, c0xy, c0yy, c1xx, c1xy, c1yy), and
of their points the mass, the mean (mx, my) and the second moments about the origin (sxx, sxy, syy).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot, length, unit
from ..snapshot import snapshot
from . import grid
from .lines import MATCH, TILE, batch_of, find_segments, first_matches, gathered, prune, tiles
from .solve import fit_segment

ENDS = ["x0", "y0", "x1", "y1"]
COVS = ["c0xx", "c0xy", "c0yy", "c1xx", "c1xy", "c1yy"]
MOMENTS = ["mx", "my", "sxx", "sxy", "syy"]


def match(new: DataFrame, master: DataFrame, keys: list[str], reach: float, later: bool = False) -> DataFrame:
    """Each new segment's first master segment (least id) that it may merge with: (keys, new_id, master_id, t1, t2).

    A pair matches if their spans overlap, both ends agree by chi-squared under the summed covariances and directions by
    |cos| > 0.5. ``reach`` is twice the distance that a match's ends may have at most, as pairs come from cells.
    ``later``: only masters of a greater id, for a map and itself.
    """

    def test(j: DataFrame) -> DataFrame:
        j = j.withColumns({"dx": F.col("x1") - F.col("x0"), "dy": F.col("y1") - F.col("y0")}).withColumn("dd", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
        t = lambda x, y: (F.col("dx") * (F.col(x) - F.col("x0")) + F.col("dy") * (F.col(y) - F.col("y0"))) / F.nullif("dd", F.lit(0.0))
        j = j.withColumns({"t1": t("nx0", "ny0"), "t2": t("nx1", "ny1")})

        for end, at in ((0, "t1"), (1, "t2")):
            share = F.col(at)
            own = {k: F.when(share < 0, F.col(f"c0{k}")).when(share > 1, F.col(f"c1{k}")).otherwise((1 - share) * F.col(f"c0{k}") + share * F.col(f"c1{k}")) for k in ("xx", "xy", "yy")}
            off = {k: F.col(f"{k}0") + share * F.col(f"d{k}") - F.col(f"n{k}{end}") for k in ("x", "y")}
            j = j.withColumns({**{f"_{k}": v + F.col(f"nc{end}{k}") for k, v in own.items()}, **{f"_f{k}": v for k, v in off.items()}})
            j = j.withColumn(f"chi{end}", F.expr("(_yy * _fx * _fx - 2 * _xy * _fx * _fy + _xx * _fy * _fy) / nullif(_xx * _yy - _xy * _xy, 0.0D)"))
        a, b = unit("dx", "dy"), unit(F.col("nx1") - F.col("nx0"), F.col("ny1") - F.col("ny0"))
        apart = ((F.col("t1") < 0) & (F.col("t2") < 0)) | ((F.col("t1") > 1) & (F.col("t2") > 1))
        return j.withColumn("ok", ~apart & (F.col("chi0") < MATCH) & (F.col("chi1") < MATCH) & (F.abs(dot(*a, *b)) > 0.5))

    return first_matches(new, master, keys, reach, COVS, test, later)


def merge(new: DataFrame, master: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Masters with what they take up; unmatched masters and new segments stay as they are.

    Moments and covariances are weighted by mass. The line goes through the merged mean along the larger axis of the merged
    scatter, turned as the master was, as far as the extremes of the matched spans.
    """
    values = COVS + MOMENTS
    n = new.select(*keys, F.col("seg_id").alias("new_id"), F.col("mass").alias("_nm"), *[F.col(k).alias(f"n{k}") for k in values])
    taken = matched.join(n, [*keys, "new_id"]).groupBy(*keys, F.col("master_id").alias("seg_id")).agg(
        F.least(F.lit(0.0), F.min("t1"), F.min("t2")).alias("_lo"), F.greatest(F.lit(1.0), F.max("t1"), F.max("t2")).alias("_hi"),
        F.sum("_nm").alias("_nm"), *[F.sum(F.col("_nm") * F.col(f"n{k}")).alias(f"_s{k}") for k in values],
    )
    j = master.join(taken, [*keys, "seg_id"]).withColumn("_m", F.col("mass") + F.col("_nm"))
    j = j.withColumns({k: (F.col("mass") * F.col(k) + F.col(f"_s{k}")) / F.col("_m") for k in values})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turn = 0.5 * F.atan2(2 * (F.col("sxy") - F.col("mx") * F.col("my")), F.col("sxx") - F.col("mx") * F.col("mx") - F.col("syy") + F.col("my") * F.col("my"))
    j = j.withColumns({"_len": length(dx, dy), "_u": F.cos(turn), "_v": F.sin(turn), "_t": (dx * (F.col("mx") - F.col("x0")) + dy * (F.col("my") - F.col("y0"))) / F.nullif(dx * dx + dy * dy, F.lit(0.0))})
    side = F.when(dot("_u", "_v", dx, dy) < 0, -F.col("_len")).otherwise(F.col("_len"))
    at = lambda mean, t, u: F.col(mean) + (F.col(t) - F.col("_t")) * side * F.col(u)
    cols = [*ENDS, "mass", *values]
    grown = j.select(*keys, "seg_id", at("mx", "_lo", "_u").alias("x0"), at("my", "_lo", "_v").alias("y0"), at("mx", "_hi", "_u").alias("x1"), at("my", "_hi", "_v").alias("y1"), F.col("_m").alias("mass"), *values)
    old = master.join(taken, [*keys, "seg_id"], "left_anti").select(*keys, "seg_id", *cols)
    fresh = new.join(matched.withColumnRenamed("new_id", "seg_id"), [*keys, "seg_id"], "left_anti").select(*keys, "seg_id", *cols)
    return grown.unionByName(old).unionByName(fresh)


def merge_round(segments: DataFrame, keys: list[str], reach: float) -> tuple[DataFrame, int]:
    """The map after one round with itself, and how many segments went into others.

    A segment goes into its first match of a greater id, if that one has no match of its own this round: so no mass counts
    twice. While any pair matches, the greatest segment that has a match goes, so rounds come to an end.
    """
    own = snapshot(match(segments, segments, keys, reach, later=True))
    sinks = own.join(own.select(*keys, F.col("new_id").alias("master_id")), [*keys, "master_id"], "left_anti").select(*own.columns)
    went = sinks.select(*keys, F.col("new_id").alias("seg_id"))
    stay = segments.join(went, [*keys, "seg_id"], "left_anti")
    return merge(segments.join(went, [*keys, "seg_id"], "left_semi"), stay, sinks, keys), went.count()


def self_merge(segments: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """The map merged with itself until no two segments match; every round is a cut."""
    now, went = snapshot(segments), 1
    while went:
        after, went = merge_round(now, keys, reach)
        now = snapshot(after) if went else now
    return now


def turns(ends: tuple, own: np.ndarray, weights: np.ndarray, samples: int, g: np.random.Generator, wide: float = 0.05) -> np.ndarray:
    """(samples, 4): the ends that ``fit_segment`` gives for each resampling of the points, a point of weight w standing for w equal ones.

    A point that stays beside the segment however it turns within ``wide`` radians is in a fit by its second moments alone, which
    are summed once for a sample; only those near the ends are looked at in every round. A segment that turns farther
    is fitted to all points.
    """
    x0, y0, x1, y1 = ends
    cx, cy, half = (x0 + x1) / 2, (y0 + y1) / 2, math.hypot(x1 - x0, y1 - y0) / 2
    theta0, many = math.atan2(y0 - y1, x0 - x1), int(weights.sum())
    d = own - (cx, cy)
    u = np.array([math.cos(theta0), math.sin(theta0)])
    beside = np.abs(d @ u) + np.abs(d @ (-u[1], u[0])) * math.sin(wide) < half - 1e-9
    order = np.argsort(~beside, kind="stable")
    sure = int(beside.sum())
    second = np.stack([d[order[:sure], 0] ** 2, d[order[:sure], 0] * d[order[:sure], 1], d[order[:sure], 1] ** 2], 1)
    edge = d[order[sure:]]
    of = None if many == len(own) else np.repeat(np.arange(len(own), dtype=np.int32), weights) if many <= 4 * len(own) else False
    p = weights / many

    def resample() -> np.ndarray:
        """How often each point is taken."""
        if of is False:
            return g.multinomial(many, p)
        counts = np.zeros(len(own), np.int64)
        for i in range(0, many, 1 << 20):
            k = g.integers(0, many, min(1 << 20, many - i), dtype=np.uint32 if many < 1 << 32 else np.uint64).astype(np.int64)
            counts += np.bincount(k if of is None else of[k], minlength=len(own))
        return counts

    def cost(theta, s, w):
        u, v = (math.cos(theta), math.sin(theta)), (-math.sin(theta), math.cos(theta))
        t = np.clip(edge @ u, -half, half)
        off = edge - t[:, None] * u
        return v[0] * v[0] * s[0] + 2 * v[0] * v[1] * s[1] + v[1] * v[1] * s[2] + float(w @ (off * off).sum(1))

    def fit(s, w) -> float | None:
        theta, damp = theta0, 1e-4
        least = cost(theta, s, w)
        for _ in range(25):
            u, v = (math.cos(theta), math.sin(theta)), (-math.sin(theta), math.cos(theta))
            t = edge @ u
            end = np.clip(t, -half, half)
            grad = -(u[0] * v[0] * s[0] + (u[0] * v[1] + u[1] * v[0]) * s[1] + u[1] * v[1] * s[2]) - float(w @ (edge @ v * end))
            h = u[0] * u[0] * s[0] + 2 * u[0] * u[1] * s[1] + u[1] * u[1] * s[2] + float(w @ np.where(np.abs(t) <= half, t * t, half * half))
            step = -grad / (h * (1 + damp) + 1e-12)
            if abs(theta + step - theta0) > wide:
                return None
            new = cost(theta + step, s, w)
            if new < least:
                theta, least, damp = theta + step, new, damp / 3
                if abs(step) < 1e-10:
                    break
            else:
                damp = damp * 10 + 1e-6
                if damp > 1e8:
                    break
        return theta

    out = np.empty((samples, 4))
    for i in range(samples):
        counts = resample()
        some = counts[order] if half else None
        theta = fit(some[:sure] @ second, some[sure:]) if half else theta0
        u = (math.cos(theta), math.sin(theta)) if theta is not None else None
        out[i] = fit_segment(ends, np.repeat(own, counts, 0))[:4] if u is None else (cx + half * u[0], cy + half * u[1], cx - half * u[0], cy - half * u[1])
    return out


def extract(points: DataFrame, tile: float, inliers: int = 150, iterations: int = 2000, samples: int = 1000, sigma: float = 0.04, share: float = 0.8, halo: float = 0.5) -> DataFrame:
    """Segments of each graph's points, by RANSAC on tiles with a halo, with moments of their points and covariances by resampling.

    ``points`` as for lines.ransac. seg_id: from the tile and the line's number in it, so it stays when tiles are done anew.
    """
    fields = TILE | {k: pa.float64() for k in [*ENDS, "mass", *COVS, *MOMENTS]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, tx, ty, found = find_segments(batches, tile, sigma, inliers, iterations, share)
        rows = []
        for k, (ends, own, w) in enumerate(found):
            g = np.random.default_rng([graph & 0xFFFFFFFF, tx & 0xFFFFFFFF, ty & 0xFFFFFFFF, k])
            fits = turns(ends, own, w, samples, g)
            cov = [np.cov(fits[:, i : i + 2].T, bias=True) for i in (0, 2)]
            second = (own * w[:, None]).T @ own / w.sum()
            rows.append((graph, tx, ty, k, *ends, float(w.sum()), *[c[i] for c in cov for i in ((0, 0), (0, 1), (1, 1))], *(w @ own / w.sum()), second[0, 0], second[0, 1], second[1, 1]))
        yield batch_of(rows, fields)

    doubles = ", ".join(f"{k} double" for k in [*ENDS, "mass", *COVS, *MOMENTS])
    found = tiles(gathered(points), tile, halo).groupBy("graph_id", "tx", "ty").applyInArrow(run, f"graph_id long, tx int, ty int, line_id int, {doubles}")
    # 20 bits for either tile number, 20 for the line's
    number = lambda k: F.col(k).cast("long").bitwiseAND(F.lit((1 << 20) - 1))
    seg = F.shiftleft(number("tx"), 40) + F.shiftleft(number("ty"), 20) + F.col("line_id")
    return found.select("graph_id", seg.alias("seg_id"), *ENDS, "mass", *COVS, *MOMENTS)


def curate(points: DataFrame, master: DataFrame | None = None, old_grid: DataFrame | None = None, res: float = 0.05, tile: float = 16.0, reach: float = 1.0, **thresholds) -> tuple[DataFrame, DataFrame]:
    """The line map and the grid after a run: signed distances, pruning, filter, line finding, merging, merging with itself.

    ``points``: graph_id, sx, sy (where they were seen from), wx, wy, and normals nx, ny. ``master`` and ``old_grid`` are
    what an earlier run returned, of the same graphs; new segments get ids above the master's. Equal points go as one row.
    """
    keys = ["graph_id"]
    points = snapshot(gathered(points))
    fresh = grid.sdf(points.select("graph_id", "sx", "sy", "wx", "wy"), res, keys)
    cells = snapshot(fresh if old_grid is None else grid.merge(old_grid.select(*fresh.columns).unionByName(fresh), keys))
    found = snapshot(extract(grid.filter_points(points, cells, res, keys), tile, **thresholds))
    if master is not None:
        # parts of a pruned segment share its covariances and moments
        parts = prune(master, cells, res, keys).join(master.select("graph_id", "seg_id", "mass", *COVS, *MOMENTS), ["graph_id", "seg_id"])
        kept = snapshot(parts.withColumn("seg_id", F.row_number().over(Window.partitionBy(*keys).orderBy("seg_id", "x0", "y0")).cast("long")))
        top = kept.groupBy(*keys).agg(F.max("seg_id").alias("_top"))
        after = found.join(top, keys, "left").withColumn("seg_id", F.coalesce("_top", F.lit(0)) + 1 + F.row_number().over(Window.partitionBy(*keys).orderBy("seg_id"))).drop("_top")
        after = snapshot(after)
        found = merge(after, kept, snapshot(match(after, kept, keys, reach)), keys)
    return self_merge(found, keys, reach), cells
