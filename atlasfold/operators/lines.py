"""Line maps: moments of segments, matching, merging, ellipses, RANSAC tiles and bootstrap covariances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot, ellipse, length, unit
from ..snapshot import cut, remove
from .solve import fit_segment

#: Fixed value: chi-squared bound for either end of a match.
MATCH = 50.0
#: Fixed value: how far, in metres, the two points that propose a line may lie apart.
RADIUS = 0.4
#: How far off a line points still count against it, and the largest cosine of a line and a normal across it.
LOCAL, ALONG = 0.5, 0.5


def endpoint_covariance(points: DataFrame, keys: list[str], x0, y0) -> DataFrame:
    """Second moments of points around a *given* point, not their mean: (keys, n, cxx, cxy, cyy)."""
    dx, dy = F.col("wx") - x0, F.col("wy") - y0
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(dx * dx).alias("cxx"), F.avg(dx * dy).alias("cxy"), F.avg(dy * dy).alias("cyy"))


def scatter(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mass, mean and E[p p'] of each group."""
    x, y = F.col("wx"), F.col("wy")
    return points.groupBy(*keys).agg(F.count("*").alias("mass"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("sxx"), F.avg(x * y).alias("sxy"), F.avg(y * y).alias("syy"))


def with_ellipse(moments: DataFrame, chi2: float = 5.991) -> DataFrame:
    """Axes and direction of the confidence ellipse of columns cxx, cxy, cyy."""
    major, minor, angle = ellipse("cxx", "cxy", "cyy", chi2)
    return moments.withColumns({"major": major, "minor": minor, "angle": angle})


def ellipse_polygon(moments: DataFrame, step_deg: int = 15) -> DataFrame:
    """The ellipse's outline around (mx, my): (…, k, ex, ey)."""
    p = with_ellipse(moments).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(360 // step_deg))))
    t = F.radians(F.col("k") * step_deg)
    u, v = F.col("major") * F.cos(t), F.col("minor") * F.sin(t)
    return p.withColumns({"ex": F.col("mx") + u * F.cos("angle") - v * F.sin("angle"), "ey": F.col("my") + u * F.sin("angle") + v * F.cos("angle")})


def cells_along(reach: float, pad: tuple[int, ...]) -> Column:
    """The distinct cells, ``reach`` wide, along a segment (x0, y0, x1, y1), and those ``pad`` off them in either direction."""
    n = F.greatest(F.ceil(length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / (reach / 2)).cast("int"), F.lit(1))
    at = lambda a, b, k: F.floor((F.col(a) + k / n * (F.col(b) - F.col(a))) / reach).cast("int")
    along_it = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(at("x0", "x1", k).alias("x"), at("y0", "y1", k).alias("y")))
    beside = lambda i, j: lambda p: F.struct((p["x"] + i).alias("x"), (p["y"] + j).alias("y"))
    return F.array_distinct(F.flatten(F.array(*[F.transform(along_it, beside(i, j)) for i in pad for j in pad])))


#: Masters, by the order of their ids, that a first match is looked for in at once, and how many times as many are next.
FIRST, GROWTH = 32, 4


def first_matches(new: DataFrame, master: DataFrame, keys: list[str], reach: float, values: list[str], test: Callable[[DataFrame], DataFrame], later: bool = False) -> DataFrame:
    """(keys, new_id, master_id, t1, t2): each new segment's master of the least id, of those within half of ``reach``, that passes ``test``.

    ``test`` gets pairs (the new one's ends and ``values`` with an n before them, the master's as they are) and adds t1, t2 and ok.
    ``later``: only masters of a greater id, for a map and itself. Cells are ``reach`` wide along either segment, the new
    one's with their neighbours. Masters are tried in rounds, in the order of their ids, and a segment goes on only while it
    has no match: so the pairs of a crowd follow what it takes to find the first match, not the square of its size.
    """
    ends = ["x0", "y0", "x1", "y1"]
    n = new.select(*keys, F.col("seg_id").alias("new_id"), *ends, *values).where(F.col("new_id").isNotNull())
    m = master.select(*keys, F.col("seg_id").alias("master_id"), *ends, *values).where(F.col("master_id").isNotNull())
    number = lambda k: F.dense_rank().over(Window.partitionBy(*keys).orderBy(k)).cast("long")
    m = m.withColumn("_r", number("master_id") - 1)
    n = n.withColumn("_q", number("new_id") if later else F.lit(0).cast("long"))
    m = cut(m.withColumn("_c", F.explode(cells_along(reach, (0,)))), "masters")
    left = cut(n, "unmatched")
    last = m.agg(F.max("_r")).first()[0]
    # few bytes make many pairs, so parts are by number, not by size
    parts = max(new.sparkSession.sparkContext.defaultParallelism, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out, low, high = None, 0, FIRST
    while out is None or (low <= last and left.limit(1).count()):
        # of a segment's masters this round's have numbers from _q + low up to _q + high: in one block, or two, of that width
        width = high - low
        tried = left.repartition(parts, *keys, "new_id").withColumn("_c", F.explode(cells_along(reach, (-1, 0, 1)))).withColumnsRenamed({k: f"n{k}" for k in ends + values})
        block = lambda k: F.floor(F.col(k) / width)
        if later:
            tried = tried.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_q") + low) / width), F.floor((F.col("_q") + high - 1) / width))))
            pairs = tried.join(m.withColumn("_b", block("_r")), [*keys, "_c", "_b"]).where((F.col("_r") >= F.col("_q") + low) & (F.col("_r") < F.col("_q") + high))
        else:
            pairs = tried.join(m.where((F.col("_r") >= low) & (F.col("_r") < high)), [*keys, "_c"])
        # not a filter: pushed into the join, it would spell every column out again wherever it is used
        best = test(pairs).groupBy(*keys, "new_id").agg(F.min(F.when(F.col("ok"), F.struct("master_id", "t1", "t2"))).alias("_m"))
        found = cut(best.where("_m is not null").select(*keys, "new_id", "_m.master_id", "_m.t1", "_m.t2"), "matched")
        out = found if out is None else out.unionByName(found)
        rest = cut(left.join(found.select(*keys, "new_id"), [*keys, "new_id"], "left_anti").select(*left.columns), "unmatched")
        remove(left)
        left, low, high = rest, high, high + width * GROWTH
        if last is None:
            break
    remove(left, m)
    return out


def match(new: DataFrame, master: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Each new segment's first master segment (least id) that it may merge with: (keys, new_id, master_id, t1, t2).

    Segments have ends x0, y0, x1, y1 and, for either end, a covariance c0, c1 (variance, isotropic).
    A pair matches if their spans overlap, both ends agree by chi-squared and directions by |cos| > 0.5.
    A pair that matches has points less than the ends' bound apart, so ``reach`` is to be twice that bound.
    """

    def test(j: DataFrame) -> DataFrame:
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        j = j.withColumns({"dx": dx, "dy": dy, "dd": length(dx, dy) * length(dx, dy)})
        t = lambda x, y: (F.col("dx") * (F.col(x) - F.col("x0")) + F.col("dy") * (F.col(y) - F.col("y0"))) / F.nullif("dd", F.lit(0.0))
        j = j.withColumns({"t1": t("nx0", "ny0"), "t2": t("nx1", "ny1")})

        def chi(t, px, py, cov):
            fx, fy = F.col("x0") + F.col(t) * F.col("dx") - F.col(px), F.col("y0") + F.col(t) * F.col("dy") - F.col(py)
            c = F.when(F.col(t) < 0, F.col("c0")).when(F.col(t) > 1, F.col("c1")).otherwise((1 - F.col(t)) * F.col("c0") + F.col(t) * F.col("c1"))
            return (fx * fx + fy * fy) / (c + F.col(cov))

        a, b = unit("dx", "dy"), unit(F.col("nx1") - F.col("nx0"), F.col("ny1") - F.col("ny0"))
        apart = ((F.col("t1") < 0) & (F.col("t2") < 0)) | ((F.col("t1") > 1) & (F.col("t2") > 1))
        j = j.withColumns({"chi0": chi("t1", "nx0", "ny0", "nc0"), "chi1": chi("t2", "nx1", "ny1", "nc1")})
        return j.withColumn("ok", ~apart & (F.col("chi0") < MATCH) & (F.col("chi1") < MATCH) & (F.abs(dot(*a, *b)) > 0.5))

    return first_matches(new, master, keys, reach, ["c0", "c1"], test)


def merge(new: DataFrame, master: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Masters with what they take up: ends at the extremes of the matched spans, covariances and means weighted by mass.

    Unmatched masters and new segments stay as they are. Columns: keys, seg_id, x0, y0, x1, y1, mass, c0, c1.
    """
    cols = ["x0", "y0", "x1", "y1", "mass", "c0", "c1"]
    n = new.select(*keys, F.col("seg_id").alias("new_id"), F.col("mass").alias("nm"), F.col("c0").alias("nc0"), F.col("c1").alias("nc1"))
    taken = matched.join(n, [*keys, "new_id"]).groupBy(*keys, F.col("master_id").alias("seg_id")).agg(
        F.least(F.lit(0.0), F.min("t1"), F.min("t2")).alias("lo"), F.greatest(F.lit(1.0), F.max("t1"), F.max("t2")).alias("hi"),
        F.sum("nm").alias("nm"), F.sum(F.col("nm") * F.col("nc0")).alias("s0"), F.sum(F.col("nm") * F.col("nc1")).alias("s1"),
    )
    whole = F.col("mass") + F.col("nm")
    grown = master.join(taken, [*keys, "seg_id"]).select(
        *keys, "seg_id",
        (F.col("x0") + F.col("lo") * (F.col("x1") - F.col("x0"))).alias("x0"), (F.col("y0") + F.col("lo") * (F.col("y1") - F.col("y0"))).alias("y0"),
        (F.col("x0") + F.col("hi") * (F.col("x1") - F.col("x0"))).alias("x1"), (F.col("y0") + F.col("hi") * (F.col("y1") - F.col("y0"))).alias("y1"),
        whole.alias("mass"), ((F.col("mass") * F.col("c0") + F.col("s0")) / whole).alias("c0"), ((F.col("mass") * F.col("c1") + F.col("s1")) / whole).alias("c1"),
    )
    old = master.join(taken, [*keys, "seg_id"], "left_anti").select(*keys, "seg_id", *cols)
    fresh = new.join(matched.withColumnRenamed("new_id", "seg_id"), [*keys, "seg_id"], "left_anti").select(*keys, "seg_id", *cols)
    return grown.unionByName(old).unionByName(fresh)


def prune(segments: DataFrame, grid: DataFrame, res: float, keys: list[str], share: float = 0.2, least: float = 0.05) -> DataFrame:
    """Parts of segments that run over cells of high weight, as segments of their own, longer than ``least``."""
    top = grid.groupBy(*keys).agg(F.max("weight").alias("_top"))
    heavy = grid.join(top, keys).where(F.col("weight") > share * F.col("_top")).select(*keys, "ix", "iy")
    n = F.greatest(F.ceil(length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / res).cast("int"), F.lit(1))
    s = segments.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: F.col(a) + F.col("k") / F.col("_n") * (F.col(b) - F.col(a))
    s = s.withColumns({"px": at("x0", "x1"), "py": at("y0", "y1")})
    s = s.withColumns({"ix": F.round(F.col("px") / res).cast("int"), "iy": F.round(F.col("py") / res).cast("int")}).join(heavy, [*keys, "ix", "iy"], "left_semi")
    w = Window.partitionBy(*keys, "seg_id").orderBy("k")
    runs = s.withColumn("_i", F.col("k") - F.row_number().over(w)).groupBy(*keys, "seg_id", "_i").agg(F.min_by(F.struct("px", "py"), "k").alias("a"), F.max_by(F.struct("px", "py"), "k").alias("b"))
    out = runs.select(*keys, "seg_id", F.col("a.px").alias("x0"), F.col("a.py").alias("y0"), F.col("b.px").alias("x1"), F.col("b.py").alias("y1"))
    return out.where(length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > least)


#: Pairs of points in neighbouring cells up to which it is settled beforehand which points have any near.
EXACT = 1 << 24


def partners(xy: np.ndarray, draws: int, g: np.random.Generator, radius: float = RADIUS, weights: np.ndarray | None = None) -> np.ndarray:
    """(draws, 2): a point that has others within the radius, and one of those, uniformly; no rows if no point has.

    Points are sorted by cells as wide as the radius, so a point's neighbours lie in three runs of them; partners are drawn
    from the runs until they are near. Tables hold a row a draw, never points by points. Where cells are crowded a point
    without anyone near may have cost some draws, which are then fewer. A point of weight w is drawn as w equal points
    are, by the same draws.
    """
    cell = np.floor((xy - xy.min(0)) / radius).astype(np.int64) + 1
    high = int(cell[:, 1].max()) + 2
    key = cell[:, 0] * high + cell[:, 1]
    del cell
    order = np.argsort(key, kind="stable")
    cells, starts, mine = np.unique(key[order], return_index=True, return_inverse=True)
    place = np.empty(len(xy), np.int32)
    place[order] = mine
    del key, mine
    # how much lies before each point in this order, and of each cell how much its three runs hold
    before = np.arange(len(xy) + 1) if weights is None else np.concatenate([[0], np.cumsum(weights[order])])
    edges = before[np.append(starts, len(xy))]
    lows, sizes = [], []
    for side in (-1, 0, 1):
        low = edges[np.searchsorted(cells, cells + side * high - 1)]
        lows.append(low)
        sizes.append(edges[np.searchsorted(cells, cells + side * high + 1, "right")] - low)
    lows, sizes = np.array(lows), np.array(sizes)
    total = sizes.sum(0)

    def near(i, j):
        d = np.hypot(*(xy[i] - xy[j]).T)
        return (d > 1e-9) & (d <= radius)

    def taken(i, k):
        """The k-th point of those in the runs of each i."""
        own = place[i]
        one, two = sizes[0, own], sizes[0, own] + sizes[1, own]
        at = np.where(k < one, lows[0, own] + k, np.where(k < two, lows[1, own] + k - one, lows[2, own] + k - two))
        return order[at if weights is None else np.searchsorted(before, at, "right") - 1]

    local = np.arange(len(xy))
    if (np.diff(edges) * total).sum() <= EXACT:
        much = total[place]
        i = np.repeat(local, much)
        k = np.arange(len(i)) - np.repeat(np.cumsum(much) - much, much)
        local = np.unique(i[near(i, taken(i, k))])
        if not len(local):
            return np.zeros((0, 2), np.int64)
    if weights is None:
        first = g.choice(local, draws)
    else:
        ranks = np.cumsum(weights[local])
        first = local[np.searchsorted(ranks, g.integers(0, ranks[-1], draws), "right")]
    second = np.full(draws, -1)
    still = np.arange(draws)
    for _ in range(200):
        i = first[still]
        j = taken(i, (g.random(len(i)) * total[place[i]]).astype(np.int64))
        good = near(i, j)
        second[still[good]] = j[good]
        still = still[~good]
        if not len(still):
            break
    return np.stack([first, second], 1)[second >= 0]


#: Points that a pass works at once, and points from which groups of them are counted as one.
PASS, CROWD = 1 << 17, 4096
#: The side of a group's cell as a share of sigma, its range of normals (radians), and the doubt in a bound by rounding.
SIDE, SECTOR, DOUBT = 0.25, 0.1, 1e-9


class _Crowds:
    """Points in groups of like place and normal, with the bounds that tell of most groups whether all of them are a line's inliers, or none."""

    def __init__(self, xy: np.ndarray, normals: np.ndarray | None, weights: np.ndarray, sigma: float):
        key = np.floor((xy - xy.min(0)) / (SIDE * sigma)).astype(np.int64)
        key = key[:, 0] * (int(key[:, 1].max()) + 1) + key[:, 1]
        if normals is not None:
            key = key * 64 + np.floor(np.nan_to_num(np.arctan2(normals[:, 1], normals[:, 0])) / SECTOR).astype(np.int64) + 32
        self.order = np.argsort(key, kind="stable")
        _, self.start, of = np.unique(key[self.order], return_index=True, return_inverse=True)
        del key
        self.size = np.diff(np.append(self.start, len(xy)))
        self.weight = np.add.reduceat(weights[self.order], self.start)
        self.middle, self.reach = self._ball(xy, of)
        self.normal, self.turn = (None, None) if normals is None else self._ball(normals, of)

    def _ball(self, v: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = v[self.order]
        middle = np.add.reduceat(v, self.start) / self.size[:, None]
        return middle, np.maximum.reduceat(np.hypot(*(v - middle[of]).T), self.start) + DOUBT

    def split(self, sigma: float, a: np.ndarray, u: np.ndarray) -> tuple[int, np.ndarray]:
        """The weight of groups that are inliers as a whole, and the groups of which it isn't known."""
        off = np.abs(u[0] * (self.middle[:, 1] - a[1]) - u[1] * (self.middle[:, 0] - a[0]))
        yes, no = off + self.reach < 3 * sigma, off - self.reach >= 3 * sigma
        if self.normal is not None:
            lean = np.abs(self.normal @ u)
            yes, no = yes & (lean + self.turn <= ALONG), no | (lean - self.turn > ALONG)
        return int(self.weight[yes].sum()), np.flatnonzero(~(yes | no))

    def points(self, groups: np.ndarray) -> np.ndarray:
        size = self.size[groups]
        return self.order[np.repeat(self.start[groups] - np.cumsum(size) + size, size) + np.arange(size.sum())]


def line_segments(xy: np.ndarray, sigma: float, inliers: int, iterations: int, seed: int, normals: np.ndarray | None = None, sources: np.ndarray | None = None, share: float = 0.0, weights: np.ndarray | None = None) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
    """(ends, own points, their weights) of segments by sequential RANSAC with refitting; a seeded generator.

    Of the lines drawn, the one with most inliers wins that has enough of them and, of inliers and outliers, a ``share`` that
    are inliers. Inliers are near and, where normals are given, have one that is across the line. Outliers are farther off
    but within LOCAL, measured along the ray where the points' sources are given. A point of weight w counts as w equal ones.
    Inliers of every line are counted exactly: by groups where bounds settle a group, by points where they don't and the
    line may still win. Passes over all points go in parts, so little is held beside the points.
    """
    g = np.random.default_rng(seed)
    out = []
    weights = np.ones(len(xy), np.int64) if weights is None else weights

    def near(xy, normals, a, u):
        off = np.abs(u[0] * (xy[:, 1] - a[1]) - u[1] * (xy[:, 0] - a[0]))
        hit = off < 3 * sigma
        return (hit if normals is None else hit & (np.abs(normals @ u) <= ALONG)), off

    def some(at):
        return xy[at], None if normals is None else normals[at]

    def parts():
        return (slice(i, i + PASS) for i in range(0, len(xy), PASS))

    def all_near(a, u):
        return np.concatenate([near(*some(at), a, u)[0] for at in parts()])

    def outliers(a, u):
        n = 0
        for at in parts():
            _, off = near(xy[at], None, a, u)
            far = off
            if sources is not None:
                rays = xy[at] - sources[at]
                rays = rays / np.maximum(np.hypot(*rays.T), 1e-12)[:, None]
                far = off / np.maximum(np.abs(rays[:, 1] * u[0] - rays[:, 0] * u[1]), 0.01)
            n += int(weights[at][(off >= 3 * sigma) & (far < LOCAL)].sum())
        return n

    while weights.sum() >= max(inliers, 2):
        i = partners(xy, iterations, g, weights=weights if (weights > 1).any() else None)
        if not len(i):
            break
        crowds = _Crowds(xy, normals, weights, sigma) if len(xy) > CROWD else None
        best, held = 0, None
        for a, b in zip(xy[i[:, 0]], xy[i[:, 1]], strict=True):
            u = (b - a) / np.hypot(*(b - a))
            if crowds is None:
                n = int(weights[near(xy, normals, a, u)[0]].sum())
            else:
                n, open_ = crowds.split(sigma, a, u)
                if n + int(crowds.weight[open_].sum()) <= max(best, inliers - 1):
                    continue
                at = crowds.points(open_)
                n += int(weights[at][near(*some(at), a, u)[0]].sum())
            if n <= best or n < inliers:
                continue
            if n >= share * (n + outliers(a, u)):
                best, held = n, (a, u)
        if held is None:
            break
        held = all_near(*held)
        del crowds
        for _ in range(20):  # refit until the inliers stay
            own, w = xy[held], weights[held]
            mean = w @ own / w.sum()
            d = own - mean
            _, v = np.linalg.eigh((d * w[:, None]).T @ d / max(w.sum() - 1, 1))
            u = v[:, 1]
            new = all_near(mean, u)
            if (new == held).all() or weights[new].sum() < inliers:
                break
            held = new
        own, w = xy[held], weights[held]
        t = (own - mean) @ u
        p, q = mean + t.min() * u, mean + t.max() * u
        out.append(((float(p[0]), float(p[1]), float(q[0]), float(q[1])), own, w))
        xy = xy[~held]
        normals, sources, weights = (x if x is None else x[~held] for x in (normals, sources, weights))
    return out


def find_lines(xy: np.ndarray, sigma: float, inliers: int, iterations: int, seed: int, **tests) -> list[tuple]:
    """Segments (x0, y0, x1, y1, n); ``tests`` as for line_segments."""
    return [(*ends, int(w.sum())) for ends, _, w in line_segments(xy, sigma, inliers, iterations, seed, **tests)]


#: What a point may have beside its place, and how many equal points a row stands for.
EXTRA, COPIES = ("nx", "ny", "sx", "sy"), "copies"


def gathered(points: DataFrame) -> DataFrame:
    """Equal points (graph_id, wx, wy and the normals and sources that there are) as one row with their number."""
    if COPIES in points.columns:
        return points
    return points.groupBy("graph_id", "wx", "wy", *[k for k in EXTRA if k in points.columns]).agg(F.count("*").alias(COPIES))


def tiles(points: DataFrame, tile: float, halo: float) -> DataFrame:
    """Points by tile (tx, ty), those within ``halo`` of a border in the tiles across it too."""
    near = lambda k: F.explode(F.sequence(F.floor((F.col(k) - halo) / tile).cast("int"), F.floor((F.col(k) + halo) / tile).cast("int")))
    extra = [k for k in (*EXTRA, COPIES) if k in points.columns]
    return points.select("graph_id", "wx", "wy", *extra).withColumn("tx", near("wx")).withColumn("ty", near("wy"))


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[tuple[int, int, int], dict[str, np.ndarray]]:
    """A tile's (graph_id, tx, ty), and its points column by column, in order of place; the batches are not held with them."""
    parts, tile = {}, None
    for batch in batches:
        if batch.num_rows:
            tile = tile or tuple(batch.column(k)[0].as_py() for k in ("graph_id", "tx", "ty"))
            for k in batch.schema.names:
                if k not in ("graph_id", "tx", "ty"):
                    parts.setdefault(k, []).append(np.array(batch.column(k).to_numpy(zero_copy_only=False), np.int64 if k == COPIES else float))
    columns = {k: np.concatenate(parts.pop(k)) for k in list(parts)}
    order = np.lexsort([columns[k] for k in reversed(["wx", "wy", *[k for k in EXTRA if k in columns]])])
    for k in columns:
        columns[k] = columns[k][order]
    return tile, columns


def find_segments(batches: Iterator[pa.RecordBatch], tile: float, sigma: float, inliers: int, iterations: int, share: float) -> tuple[int, int, int, list]:
    """(graph_id, tx, ty, segments) of a tile with its halo: those whose middle is in the tile itself, so a short line across a border counts once."""
    (g, tx, ty), columns = _columns(batches)
    two = lambda a, b: np.stack([columns.pop(a), columns.pop(b)], 1) if a in columns else None
    xy, normals, sources = two("wx", "wy"), two("nx", "ny"), two("sx", "sy")
    found = line_segments(xy, sigma, inliers, iterations, abs(hash((g, tx, ty))) % (1 << 32), normals, sources, share, columns.pop(COPIES))
    own = [x for x in found if (np.floor((x[0][0] + x[0][2]) / 2 / tile), np.floor((x[0][1] + x[0][3]) / 2 / tile)) == (tx, ty)]
    return g, tx, ty, own


def batch_of(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(columns, fields.values(), strict=True)], names=list(fields))


#: The fields that name a line of a tile.
TILE = {"graph_id": pa.int64(), "tx": pa.int32(), "ty": pa.int32(), "line_id": pa.int32()}


def ransac(points: DataFrame, tile: float, sigma: float = 0.04, inliers: int = 150, iterations: int = 2000, share: float = 0.8, halo: float = 0.5) -> DataFrame:
    """Lines of each graph's tiles (graph_id, tx, ty, line_id, x0, y0, x1, y1, n). A tile bounds a task's group; its id seeds its draws.

    ``points``: graph_id, wx, wy, and where there are any, normals nx, ny and sources sx, sy. A line longer than the halo
    that crosses a border comes in parts that overlap there; linemap.self_merge joins them. Equal points go to a tile as one row.
    """
    fields = TILE | {k: pa.float64() for k in ("x0", "y0", "x1", "y1")} | {"n": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, tx, ty, found = find_segments(batches, tile, sigma, inliers, iterations, share)
        yield batch_of([(g, tx, ty, k, *ends, int(w.sum())) for k, (ends, _, w) in enumerate(found)], fields)

    return tiles(gathered(points), tile, halo).groupBy("graph_id", "tx", "ty").applyInArrow(run, "graph_id long, tx int, ty int, line_id int, x0 double, y0 double, x1 double, y1 double, n int")


def bootstrap(points: DataFrame, samples: int = 1000) -> DataFrame:
    """Covariances of the ends of each group's fitted segment under resampling: (graph_id, c0xx, c0xy, c0yy, c1xx, c1xy, c1yy). Columns graph_id, x0..y1, wx, wy."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["wx", "wy"])
        xy = frame[["wx", "wy"]].to_numpy()
        ends = tuple(float(frame[k].iloc[0]) for k in ("x0", "y0", "x1", "y1"))
        g = np.random.default_rng(int(frame.graph_id.iloc[0]) & 0xFFFFFFFF)
        fits = np.array([fit_segment(ends, xy[g.integers(0, len(xy), len(xy))]) for _ in range(samples)])
        d0, d1 = fits[:, :2] - fits[:, :2].mean(0), fits[:, 2:4] - fits[:, 2:4].mean(0)
        c0, c1 = d0.T @ d0 / samples, d1.T @ d1 / samples
        return pd.DataFrame([(int(frame.graph_id.iloc[0]), c0[0, 0], c0[0, 1], c0[1, 1], c1[0, 0], c1[0, 1], c1[1, 1])], columns=["graph_id", "c0xx", "c0xy", "c0yy", "c1xx", "c1xy", "c1yy"])

    return points.select("graph_id", "x0", "y0", "x1", "y1", "wx", "wy").groupBy("graph_id").applyInPandas(run, "graph_id long, c0xx double, c0xy double, c0yy double, c1xx double, c1xy double, c1yy double")


def rasterise(segments: DataFrame, res: float, keys: list[str]) -> DataFrame:
    """Cells under each segment."""
    n = F.greatest(F.ceil(length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / res).cast("int"), F.lit(1))
    s = segments.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: F.floor((F.col(a) + F.col("k") / F.col("_n") * (F.col(b) - F.col(a))) / res).cast("int")
    return s.select(*keys, at("x0", "x1").alias("ix"), at("y0", "y1").alias("iy")).distinct()
