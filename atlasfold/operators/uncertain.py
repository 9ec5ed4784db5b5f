"""Segments with both ends free, and how sure their ends are under the sensor's noise and under resampling."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import named, normals
from ..functions.geometry import ellipse, length
from ..snapshot import cut, remove

#: Fixed value: the pull of either end to the centroid, shared by all points.
PULL = 10.0
#: Deviations of the sensor across (radians) and along (metres) a ray, and the chi-squared bound of its ellipse.
SD_ANGLE, SD_RANGE, CHI2 = 0.002, 0.03, 5.991
#: Draws of a resampling task, and points up to which a segment is fitted in one piece.
DRAWS, WHOLE = 5_000_000, 1 << 15
#: Draws of a resampling that are made at once, and up to which a sample's are held; of larger samples they are made anew in every round.
BLOCK, HELD = 100_000, 1 << 23
#: Samples whose draws are shuffled at once, so that disk doesn't grow with their number.
TOGETHER = 20
#: Points that are summed at once, so that what is worked out of them stays in a processor's cache.
STRIP = 1 << 15
#: Metres from a kink within which curvature grows no more.
NEAR = 1e-4
ENDS = ["x0", "y0", "x1", "y1"]
SUMS = ["m", "rr", "r", "p", "q", "rp", "rq", "pp", "pq", "qq"]
_G = [f"g{i}" for i in range(4)]
_H = [f"h{i}{j}" for i in range(4) for j in range(i, 4)]


def end_terms(ends: np.ndarray, xy: np.ndarray, centre: np.ndarray, n, pull: float = PULL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of points (m, 2): the distance to a segment (x0, y0, x1, y1) plus the ends' pull to the centroid of n points, its derivatives by the ends, and the curvature of half its square.

    A distance has a kink on the segment, where the pull's share of the curvature would be without bound; there it is that of
    a parabola above it which touches it at the point (no nearer than NEAR), so steps still lead down.

    ``ends``, ``centre`` and ``n`` are a row for each point, or one for all. A derivative is 0 where there is none: a point on
    the segment, an end at the centroid. A segment without length is its first end.
    """
    ends, centre, share = np.atleast_2d(ends), np.atleast_2d(centre), pull / np.reshape(n, (-1, 1))
    p, q = ends[:, :2], ends[:, 2:]
    over = lambda v, size: v / np.where(size > 0, size, 1)[:, None]
    long = np.hypot(*(q - p).T)
    u = over(q - p, long)
    normal = np.stack([-u[:, 1], u[:, 0]], 1)
    e0, e1 = p - xy, q - xy
    t = np.where(long > 0, -(e0 * u).sum(1) / np.where(long > 0, long, 1), -1.0)
    off = -(e0 * normal).sum(1)
    d0, d1 = np.hypot(*e0.T), np.hypot(*e1.T)
    first, second = (t < 0)[:, None], (t > 1)[:, None]
    side, t = np.sign(off)[:, None] * normal, t[:, None]
    c0, c1 = p - centre, q - centre
    n0, n1 = np.hypot(*c0.T), np.hypot(*c1.T)
    slopes = np.concatenate([
        np.where(first, over(e0, d0), np.where(second, 0.0, (t - 1) * side)) + share * over(c0, n0),
        np.where(first, 0.0, np.where(second, over(e1, d1), -t * side)) + share * over(c1, n1),
    ], 1)
    held = share[:, 0] * (n0 + n1)
    r = np.where(first[:, 0], d0, np.where(second[:, 0], d1, np.abs(off))) + held
    bend = slopes[:, :, None] * slopes[:, None, :]
    turn = np.where(first | second, 0.0, np.concatenate([(t - 1) * normal, -t * normal], 1))
    bend += (held / np.maximum(np.abs(off), NEAR))[:, None, None] * turn[:, :, None] * turn[:, None, :]
    for at, end, far, mine, size, to in ((slice(0, 2), e0, d0, first, n0, c0), (slice(2, 4), e1, d1, second, n1, c1)):
        for v, long, k in ((end, far, np.where(mine[:, 0], r, 0.0)), (to, size, r * share[:, 0])):
            u = over(v, long)
            bend[:, at, at] += (k / np.maximum(long, NEAR))[:, None, None] * (np.eye(2) - u[:, :, None] * u[:, None, :])
    return r, slopes, bend


def damped(frame: pd.DataFrame) -> pd.DataFrame:
    """The next trial of every segment from its cost and normal equations at the last one: better trials are taken, worse ones damped."""
    frame = frame.copy()
    open_ = ~frame.done.to_numpy(bool) & frame.cost.notna().to_numpy()
    cost, best = frame.cost.to_numpy(float), frame.best.to_numpy(float)
    better = open_ & ~(cost >= best)
    gained = np.where(np.isfinite(best), best - cost, np.inf)
    for new, held in zip(["cost", *ENDS, *_G, *_H], ["best", *(f"b{k}" for k in ENDS), *(f"b{k}" for k in _G + _H)], strict=True):
        frame[held] = np.where(better, frame[new], frame[held])
    damp = np.where(better, np.maximum(frame.damp / 3, 1e-9), frame.damp * 4)
    frame["damp"] = np.where(open_, damp, frame.damp)
    frame["done"] = ~open_ | (better & (gained <= 1e-6 * cost)) | (frame.damp > 1e8)
    go = ~frame.done.to_numpy(bool)
    if go.any():
        g = frame.loc[go, [f"b{k}" for k in _G]].to_numpy(float)
        h = np.zeros((go.sum(), 4, 4))
        for k in _H:
            i, j = int(k[1]), int(k[2])
            h[:, i, j] = h[:, j, i] = frame.loc[go, f"b{k}"]
        own = np.arange(4)
        h[:, own, own] += frame.damp.to_numpy()[go][:, None] * h[:, own, own] + 1e-12
        step = np.linalg.solve(h, -g[..., None])[..., 0]
        frame.loc[go, ENDS] = frame.loc[go, [f"b{k}" for k in ENDS]].to_numpy(float) + step
    return frame


def fit_ends(points: DataFrame, segments: DataFrame, keys: list[str], copies: list[str] | None = None, moved: Callable[[], tuple[Column, Column]] | None = None, iterations: int = 25, whole: int = WHOLE) -> DataFrame:
    """Each segment with both ends where the squares of their points' residuals are least: (keys, copies, x0, y0, x1, y1, n, mx, my, cost).

    ``points``: keys, wx, wy. ``segments``: keys, ``copies``, x0 .. y1; every copy of a segment has the points of its keys,
    ``moved`` as the expression says, which may read the copy's columns. Segments of up to ``whole`` points are fitted where their
    points are brought together. The others are fitted in rounds, all at once: a round is one join and one aggregation of
    sums that Spark adds up before the shuffle, so no large segment's points are one group and none goes to Python; a damped
    step is taken on the sums. Rounds end with the last segment. Segments without points stay as they are (n 0, cost null); null
    coordinates don't count.
    """
    copies = copies or []
    ids = [*keys, *copies]
    own = points.where("wx is not null and wy is not null")
    px, py = moved() if moved else (F.col("wx"), F.col("wy"))
    clash = [k for k in own.columns if k not in keys and k in (*copies, *ENDS, "mx", "my", "n", "done", "damp", "best")]
    own = own.drop(*clash)
    centre = own.join(segments.select(*ids), keys).groupBy(*ids).agg(F.count("*").alias("n"), F.avg(px).alias("mx"), F.avg(py).alias("my"))
    columns = [*ids, *ENDS, "n", "mx", "my"]
    start = segments.select(*ids, *[F.col(k).cast("double").alias(k) for k in ENDS]).join(centre, ids, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    start = cut(start.select(*columns), "guesses")
    placed = start.select(*columns, F.lit(0.0).alias("cost")).schema

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[:1][columns].reset_index(drop=True)
        first[ENDS], first["cost"] = np.nan, np.nan
        xy = frame[["_px", "_py"]].to_numpy()
        ends, cost = fit_points(frame[ENDS].iloc[0].to_numpy(float), xy[np.lexsort(xy.T)], iterations)
        first.loc[0, [*ENDS, "cost"]] = [*ends, cost]
        return first

    together = own.join(start.where(F.col("n").between(1, whole)), keys).select(*columns, px.alias("_px"), py.alias("_py")).groupBy(*ids).applyInPandas(fitted, placed)
    rest = start.where(~F.col("n").between(1, whole)).withColumn("cost", F.lit(None).cast("double"))
    if rest.where("n > 0").limit(1).count():
        rest = _in_rounds(own, rest.select(*columns), keys, ids, (px, py), iterations)
    return together.unionByName(rest)


def _summed(own: DataFrame, open_: DataFrame, keys: list[str], ids: list[str], at: tuple[Column, Column]) -> DataFrame:
    """Of each segment, what ``equations`` needs of its points: sums over those before its first end (0), beside it (1) and beyond its last (2).

    (p, q) is the slope of a point's own distance: by the end that is near, or of both ends across the segment.
    """
    c = F.col
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    size = length(dx, dy)
    apart = lambda e: length(c(f"x{e}") - c("mx"), c(f"y{e}") - c("my")) * PULL / c("n")
    near = open_.withColumns({"_long": size, "_ux": F.coalesce(dx / F.nullif(size, F.lit(0.0)), F.lit(0.0)), "_uy": F.coalesce(dy / F.nullif(size, F.lit(0.0)), F.lit(0.0)), "_held": apart(0) + apart(1)})
    seen = own.join(near, keys).select(*ids, *ENDS, "_long", "_ux", "_uy", "_held", at[0].alias("_px"), at[1].alias("_py"))
    seen = seen.withColumns({"_t": F.when(c("_long") > 0, ((c("_px") - c("x0")) * c("_ux") + (c("_py") - c("y0")) * c("_uy")) / c("_long")).otherwise(-1.0), "_off": (c("_py") - c("y0")) * c("_ux") - (c("_px") - c("x0")) * c("_uy")})
    seen = seen.withColumn("_region", F.when(c("_t") < 0, 0).when(c("_t") > 1, 2).otherwise(1))
    beside, last = c("_region") == 1, c("_region") == 2
    seen = seen.withColumns({"_ex": F.when(last, c("x1")).otherwise(c("x0")) - c("_px"), "_ey": F.when(last, c("y1")).otherwise(c("y0")) - c("_py")})
    seen = seen.withColumn("_d", F.when(beside, F.abs("_off")).otherwise(length(c("_ex"), c("_ey"))))
    over = F.nullif(c("_d"), F.lit(0.0))
    seen = seen.withColumns({
        "_p": F.when(beside, (c("_t") - 1) * F.signum("_off")).otherwise(F.coalesce(c("_ex") / over, F.lit(0.0))),
        "_q": F.when(beside, -c("_t") * F.signum("_off")).otherwise(F.coalesce(c("_ey") / over, F.lit(0.0))),
        "_r": c("_d") + c("_held"),
    })
    seen = seen.withColumn("_k", F.when(beside, c("_held")).otherwise(c("_r")) / F.greatest(c("_d"), F.lit(NEAR)))
    p, q, r, k, t = c("_p"), c("_q"), c("_r"), c("_k"), c("_t")
    each = {
        "m": F.lit(1.0), "rr": r * r, "r": r, "p": p, "q": q, "rp": r * p, "rq": r * q,
        "pp": p * p + k * F.when(beside, (t - 1) * (t - 1)).otherwise(1 - p * p),
        "pq": p * q - k * F.when(beside, (t - 1) * t).otherwise(p * q),
        "qq": q * q + k * F.when(beside, t * t).otherwise(1 - q * q),
    }
    parts = seen.groupBy(*ids, "_region").agg(*[F.sum(each[n]).alias(n) for n in SUMS])
    return parts.groupBy(*ids).agg(*[F.coalesce(F.sum(F.when(c("_region") == g, c(n))), F.lit(0.0)).alias(f"{n}{g}_") for g in range(3) for n in SUMS])


def normal_terms(sums: np.ndarray, ends: np.ndarray, centre: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, gradient and curvature of segments from their sums (size, 3, len(SUMS)); the pull's share, alike for all points, is added here."""
    size, share = len(sums), PULL / np.maximum(n, 1)
    sums = {k: sums[:, :, i] for i, k in enumerate(SUMS)}
    d = ends[:, 2:] - ends[:, :2]
    long = np.hypot(*d.T)
    u = d / np.where(long > 0, long, 1)[:, None]
    across = np.stack([-u[:, 1], u[:, 0]], 1)
    own, grad, bend = np.zeros((size, 4)), np.zeros((size, 4)), np.zeros((size, 4, 4))
    for into, x, y in ((own, "p", "q"), (grad, "rp", "rq")):
        for e, g, s in ((0, 0, x), (1, 2, y)):
            at = slice(2 * e, 2 * e + 2)
            into[:, at] = np.stack([sums[x][:, g], sums[y][:, g]], 1) + sums[s][:, 1, None] * across
    for e, g in ((0, 0), (1, 2)):
        at = slice(2 * e, 2 * e + 2)
        bend[:, at, at] += np.stack([sums["pp"][:, g], sums["pq"][:, g], sums["pq"][:, g], sums["qq"][:, g]], 1).reshape(-1, 2, 2)
    flat = across[:, :, None] * across[:, None, :]
    for i, j, n in ((0, 0, "pp"), (0, 1, "pq"), (1, 0, "pq"), (1, 1, "qq")):
        bend[:, 2 * i : 2 * i + 2, 2 * j : 2 * j + 2] += sums[n][:, 1, None, None] * flat
    pull, all_r, m = np.zeros((size, 4)), sums["r"].sum(1), sums["m"].sum(1)
    for e in (0, 1):
        at = slice(2 * e, 2 * e + 2)
        away = ends[:, at] - centre
        far = np.hypot(*away.T)
        v = away / np.where(far > 0, far, 1)[:, None]
        pull[:, at] = share[:, None] * v
        bend[:, at, at] += (all_r * share / np.maximum(far, NEAR))[:, None, None] * (np.eye(2) - v[:, :, None] * v[:, None, :])
    bend += own[:, :, None] * pull[:, None, :] + pull[:, :, None] * own[:, None, :] + m[:, None, None] * pull[:, :, None] * pull[:, None, :]
    grad += all_r[:, None] * pull
    return sums["rr"].sum(1) / 2, grad, bend


def equations(frame: pd.DataFrame) -> pd.DataFrame:
    """A copy with cost, gradient and curvature of each segment from ``_summed``. Null without sums."""
    frame = frame.copy()
    sums = frame[[f"{n}{g}_" for g in range(3) for n in SUMS]].to_numpy(float).reshape(-1, 3, len(SUMS))
    frame["cost"], frame[_G], bend = normal_terms(sums, frame[ENDS].to_numpy(float), frame[["mx", "my"]].to_numpy(float), frame["n"].to_numpy(float))
    for k in _H:
        frame[k] = bend[:, int(k[1]), int(k[2])]
    return frame


def _in_rounds(own: DataFrame, start: DataFrame, keys: list[str], ids: list[str], at: tuple[Column, Column], iterations: int) -> DataFrame:
    """``fit_ends`` of segments whose points stay where they are."""
    held = [F.lit(None).cast("double").alias(f"b{k}") for k in (*ENDS, *_G, *_H)]
    state = cut(start.select(*ids, *ENDS, "n", "mx", "my", F.lit(float("inf")).alias("best"), *held, F.lit(3e-4).alias("damp"), (F.col("n") == 0).alias("done")), "ends")
    schema = state.schema

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield damped(equations(frame))[schema.names]

    for _ in range(iterations + 1):
        found = _summed(own, state.where("not done").select(*ids, *ENDS, "n", "mx", "my"), keys, ids, at)
        new = cut(state.join(found, ids, "left").mapInPandas(steps, schema), "ends")
        remove(state)
        state = new
        if not state.where("not done").limit(1).count():
            break
    best = [F.coalesce(f"b{k}", k).alias(k) for k in ENDS]
    return state.select(*ids, *best, "n", "mx", "my", F.when(F.col("best") < float("inf"), F.col("best")).alias("cost"))


def sensor_covariance(points: DataFrame, sd_angle: float = SD_ANGLE, sd_range: float = SD_RANGE) -> DataFrame:
    """Adds qxx, qxy, qyy: what noise of the angle and of the range does to a point (wx, wy) seen from (sx, sy)."""
    rx, ry = F.col("wx") - F.col("sx"), F.col("wy") - F.col("sy")
    d = length(rx, ry)
    ux, uy = F.coalesce(rx / F.nullif(d, F.lit(0.0)), F.lit(1.0)), F.coalesce(ry / F.nullif(d, F.lit(0.0)), F.lit(0.0))
    across, along = d * d * sd_angle * sd_angle, F.lit(sd_range * sd_range)
    return points.withColumns({"qxx": across * uy * uy + along * ux * ux, "qxy": (along - across) * ux * uy, "qyy": across * ux * ux + along * uy * uy})


def _spread(fits: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Second moments of the fitted ends around the segments' own, added up by sample, so that they don't depend on the order in which fits arrive."""
    given = segments.select(*keys, *[F.col(k).cast("double").alias(f"_{k}") for k in ENDS])
    off = {k: F.col(k) - F.col(f"_{k}") for k in ENDS}
    each = {f"c{e}{a}{b}": off[f"{a}{e}"] * off[f"{b}{e}"] for e in (0, 1) for a, b in ("xx", "xy", "yy")}
    # a row per sample, so as many in a list as samples were asked for
    fits = fits.join(given, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_sample", *[v.alias(k) for k, v in each.items()]))).alias("_fits"))

    def mean(name: str):
        some = F.filter(F.col(f"_fits.{name}"), F.isnotnull)
        return F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(some), F.lit(0))

    return fits.select(*keys, *[mean(k).alias(k) for k in each])


def normal_digests(names: list[str], samples: range) -> tuple[np.ndarray, np.ndarray]:
    """(names, samples) each: ``draws.normals`` of names and samples, outside of Spark."""
    ends, digests = [f",{k}".encode() for k in samples], []
    for name in names:
        base = md5(name.encode())
        for end in ends:
            one = base.copy()
            one.update(end)
            digests.append(one.digest())
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(len(names), len(ends), 16).astype(np.float64)
    u, v = (raw[:, :, i : i + 5] @ (256.0 ** np.arange(4, -1, -1)) / (1 << 40) for i in (0, 5))
    radius = np.sqrt(-2 * np.log(1 - u))
    return radius * np.cos(2 * math.pi * v), radius * np.sin(2 * math.pi * v)


def _fit_drawn(noisy: DataFrame, segments: DataFrame, keys: list[str], samples: range) -> DataFrame:
    """(keys, _sample, ends) of the samples: every point is drawn once for each, and a segment's sample is fitted in one piece.

    Draws are shuffled as places and numbers of equal points, and a task holds one sample's. The guess comes as two rows more.
    """
    schema = noisy.select(*keys, F.lit(0).alias("_sample"), *[F.lit(0.0).alias(k) for k in ("_px", "_py")], F.lit(0).cast("long").alias("_w")).schema

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                x, y, u, v, cos, sin = (batch.column(k).to_numpy(zero_copy_only=False).astype(float)[:, None] for k in ("wx", "wy", "_u", "_v", "_cos", "_sin"))
                a, b = normal_digests(batch.column("_name").to_pylist(), samples)
                a, b = a * u, b * v
                of = pa.array(np.repeat(np.arange(batch.num_rows), len(samples)))
                moved = [pa.array(k.ravel()) for k in (x + a * cos - b * sin, y + a * sin + b * cos)]
                sample = pa.array(np.tile(np.array(samples, np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in keys], sample, *moved, batch.column("_w").take(of)], names=schema.names)

    guesses = segments.select(*keys, F.explode(F.sequence(F.lit(samples[0]), F.lit(samples[-1]))).alias("_sample"), *ENDS)
    ends = [guesses.select(*keys, "_sample", F.col(f"x{e}").cast("double").alias("_px"), F.col(f"y{e}").cast("double").alias("_py"), F.lit(e - 2).cast("long").alias("_w")) for e in (0, 1)]
    rows = noisy.mapInArrow(draw, schema).unionByName(ends[0]).unionByName(ends[1])
    fitted = rows.select(*keys, "_sample", *[F.lit(0.0).alias(k) for k in ENDS]).schema

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, key = [], None
        for batch in batches:
            if batch.num_rows:
                key = key or [batch.column(k).slice(0, 1) for k in (*keys, "_sample")]
                parts.append([np.array(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("_px", "_py", "_w")])
        x, y, w = (np.concatenate(k) for k in zip(*parts, strict=True))
        parts.clear()
        guess = [float(k[w == e][0]) for e in (-2, -1) for k in (x, y) if (w == e).any()]
        order = np.lexsort((w, y, x))
        order = order[(w[order] > 0) & np.isfinite(x[order]) & np.isfinite(y[order])]
        x, y, w = x[order], y[order], w[order].astype(float)
        if len(guess) == 4 and len(x):
            n = w.sum()
            found, _ = fit_blocks(guess, lambda: iter([(x, y, w)]), n, np.array([w @ x / n, w @ y / n]))
            yield pa.RecordBatch.from_arrays([*key, *[pa.array([float(k)]) for k in found]], names=fitted.names)

    return rows.groupBy(*keys, "_sample").applyInArrow(fit, fitted)


def sensor_uncertainty(points: DataFrame, segments: DataFrame, keys: list[str], point_id: list[str], samples: int = 1000, seed: int = 7, held: int = HELD) -> DataFrame:
    """Covariances of the ends (keys, c0xx, c0xy, c0yy, c1xx, c1xy, c1yy) under noise of the sensor: refits of all points, each moved along the axes of its ellipse.

    ``points``: keys, ``point_id``, wx, wy and the sources sx, sy. Draws are keyed by the point and the sample, so points that
    are equal in all of these are drawn as one that counts as often. Every point is drawn once a sample, TOGETHER samples at
    a time, so what is shuffled is bounded by the points. Segments of more than ``held`` different points are fitted in
    rounds of sums, which draw where the points are. Moments are around the given ends, as those of the mapping.
    """
    major, minor, angle = ellipse("qxx", "qxy", "qyy", CHI2)
    once = {"_u": major, "_v": minor, "_cos": F.cos(angle), "_sin": F.sin(angle), "_name": named(seed, *keys, *point_id)}
    columns = list(dict.fromkeys([*keys, *point_id, "wx", "wy", "sx", "sy"]))
    equal = points.where("wx is not null and wy is not null").join(segments.select(*keys), keys, "left_semi").groupBy(*columns).agg(F.count("*").alias("_w"))
    noisy = cut(sensor_covariance(equal).withColumns(once).select(*keys, "wx", "wy", *once, "_w"), "noisy")
    large = cut(noisy.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > held).select(*keys), "large")
    small, fits = segments.join(large, keys, "left_anti").select(*keys, *ENDS), []
    some = noisy.join(large, keys, "left_anti")
    for first in range(1, samples + 1, TOGETHER):
        fits.append(cut(_fit_drawn(some, small, keys, range(first, min(first + TOGETHER, samples + 1))), "fits"))

    def moved():
        a, b = normals(F.col("_name"), "_sample")
        u, v = a * F.col("_u"), b * F.col("_v")
        return F.col("wx") + u * F.col("_cos") - v * F.col("_sin"), F.col("wy") + u * F.col("_sin") + v * F.col("_cos")

    if large.limit(1).count():
        # a row for each of the equal points, as sums have no weights there
        each = noisy.join(large, keys, "left_semi").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_w").cast("int")))).select(*keys, "wx", "wy", *once)
        every = segments.join(large, keys, "left_semi").select(*keys, *ENDS).withColumn("_sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        fits.append(fit_ends(each, every, keys, ["_sample"], moved).where("n > 0").select(*fits[0].columns))
    return _spread(functools.reduce(DataFrame.unionByName, fits), segments, keys)


def _least(ends, terms: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], iterations: int) -> tuple[np.ndarray, float]:
    """Ends and cost by damped rounds; ``terms`` gives the cost, curvature and gradient of a trial."""
    best, held, damp = np.inf, None, 3e-4
    trial = at = np.asarray(ends, float)
    for _ in range(iterations + 1):
        cost, h, g = terms(trial)
        if not cost >= best:
            gained, best, at, held, damp = best - cost, cost, trial, (h, g), max(damp / 3, 1e-9)
            if gained <= 1e-6 * cost:
                break
        else:
            damp *= 4
            if damp > 1e8:
                break
        h, g = held
        trial = at - np.linalg.solve(h + np.diag(damp * np.diag(h) + 1e-12), g)
    return at, best


def fit_points(ends, xy: np.ndarray, iterations: int = 25) -> tuple[np.ndarray, float]:
    """``fit_ends`` of one segment whose points are an array: its ends and cost, by the same rounds."""
    centre = xy.mean(0)

    def terms(trial):
        r, j, h = end_terms(trial, xy, centre, len(xy))
        return float(r @ r) / 2, h.sum(0), j.T @ r

    return _least(ends, terms, iterations)


def _strip_sums(ends: np.ndarray, held: float, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """(3, len(SUMS)): what ``_summed`` gives of one segment, of points that are arrays; one of weight w counts as w equal ones."""
    out = np.zeros((3, len(SUMS)))
    x0, y0, x1, y1 = ends
    long = np.hypot(x1 - x0, y1 - y0)
    over = np.arange(len(x))
    often = (lambda v: v) if weights is None else (lambda v: v * weights)
    if long > 0:
        u, v, rx, ry = (x1 - x0) / long, (y1 - y0) / long, x - x0, y - y0
        t, off = rx * (u / long) + ry * (v / long), ry * u - rx * v
        over = np.flatnonzero((t < 0) | (t > 1))
        first = t[over] < 0
        t[over] = off[over] = 0
        s, a = np.sign(off), np.abs(off)
        w = often(s * s + held / np.maximum(a, NEAR))
        w[over] = 0
        m = len(x) - len(over) if weights is None else weights.sum() - weights[over].sum()
        s, a, many = often(s), often(a), often(off)
        so, st, sot, wt = many.sum(), s @ t, many @ t, w * t
        ss, sa, w0, w1, w2 = s.sum(), a.sum(), w.sum(), wt.sum(), wt @ t
        out[1] = m, many @ off + 2 * held * sa + held * held * m, sa + held * m, st - ss, -st, sot - so + held * (st - ss), -sot - held * st, w2 - 2 * w1 + w0, w1 - w2, w2
    else:
        first = np.ones(len(x), bool)
    for g, some, ex, ey in ((0, over[first], x0, y0), (2, over[~first], x1, y1)):
        if len(some):
            ex, ey, c = ex - x[some], ey - y[some], np.ones(len(some)) if weights is None else weights[some]
            d = np.hypot(ex, ey)
            p, q = (np.where(d > 0, k / np.where(d > 0, d, 1), 0.0) for k in (ex, ey))
            r = d + held
            k = r / np.maximum(d, NEAR)
            out[g] = c.sum(), c @ (r * r), c @ r, c @ p, c @ q, c @ (r * p), c @ (r * q), c @ (p * p + k * (1 - p * p)), c @ (p * q * (1 - k)), c @ (q * q + k * (1 - q * q))
    return out


def fit_blocks(ends, blocks: Callable[[], Iterator[tuple[np.ndarray, ...]]], n: int, centre: np.ndarray, iterations: int = 25) -> tuple[np.ndarray, float]:
    """``fit_points`` of n points around ``centre`` that come as blocks (x, y, and weights if there are any), anew in every round: one block is worked at a time."""

    def terms(trial):
        held = PULL / n * (np.hypot(*(trial[:2] - centre)) + np.hypot(*(trial[2:] - centre)))
        sums = np.zeros((3, len(SUMS)))
        for block in blocks():
            for i in range(0, len(block[0]), STRIP):
                sums += _strip_sums(trial, held, *[k[i : i + STRIP] for k in block])
        cost, grad, bend = normal_terms(sums[None], trial[None], centre[None], np.array([n]))
        return float(cost[0]), bend[0], grad[0]

    return _least(ends, terms, iterations)


def drawn(ends: np.ndarray, mass: int, sigma: float, key: int, sample: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (x, y) of ``mass`` points evenly along a segment and normally across it, by a generator whose counter is the block's."""
    d = ends[2:] - ends[:2]
    across = np.array([-d[1], d[0]]) / np.hypot(*d)
    for number in range(-(-mass // BLOCK)):
        size = min(BLOCK, mass - number * BLOCK)
        g = np.random.Generator(np.random.Philox(key=np.array([key & (1 << 64) - 1, sample], np.uint64), counter=np.array([0, 0, 0, number], np.uint64)))
        t, off = g.random(size), sigma * g.standard_normal(size)
        yield ends[0] + t * d[0] + off * across[0], ends[1] + t * d[1] + off * across[1]


def resampled(segments: DataFrame, keys: list[str], sigma: float, samples: int = 1000, seed: int = 11) -> DataFrame:
    """How sure segments are of their ends that keep no points, only a ``mass``: (keys, c0xx .. c1yy, mx, my, sxx, sxy, syy).

    A sample draws as many points as the mass says, evenly along the segment and normally across it, and refits both ends. Points
    are drawn and summed in blocks; up to HELD of a sample are kept for its next rounds, of more they are drawn anew, so what
    a task holds is bounded. Moments of ends are around the given ones; mean and second moments are the last sample's.
    Segments' samples are rows of their own, so one segment's work is spread over tasks; a generator is keyed by segment and
    sample, so results don't depend on the partitioning. Segments without mass or length give no rows.
    """
    names = ["px", "py", "sxx", "sxy", "syy"]
    number = F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys])
    rows = segments.where("mass >= 1").where(length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > 0)
    rows = rows.select(*keys, *[F.col(k).cast("double").alias(k) for k in ENDS], F.col("mass").cast("long").alias("mass"), number.alias("_key"))
    total = (rows.agg(F.sum("mass")).first()[0] or 0) * samples
    tasks = max(segments.sparkSession.sparkContext.defaultParallelism, min(-(-total // DRAWS), rows.count() * samples))
    rows = rows.withColumn("_sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).repartition(tasks, *keys, "_sample")
    schema = rows.select(*keys, "_sample", *ENDS, *[F.lit(0.0).alias(k) for k in names]).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for ends, mass, key, sample in zip(frame[ENDS].to_numpy(float), frame["mass"], frame["_key"], frame["_sample"], strict=True):
                made = lambda: drawn(ends, int(mass), sigma, int(key), int(sample))  # noqa: B023, E731
                kept, moments = [], np.zeros(5)
                for x, y in made():
                    moments += x.sum(), y.sum(), x @ x, x @ y, y @ y
                    if mass <= HELD:
                        kept.append((x, y))
                moments /= mass
                again = (lambda: iter(kept)) if kept else made  # noqa: B023
                out.append((*fit_blocks(ends, again, int(mass), moments[:2])[0], *moments))
            yield pd.concat([frame[[*keys, "_sample"]].reset_index(drop=True), pd.DataFrame(out, columns=[*ENDS, *names])], axis=1)

    fits = cut(rows.mapInPandas(run, schema), "resampled")
    last = fits.where(F.col("_sample") == samples).select(*keys, F.col("px").alias("mx"), F.col("py").alias("my"), "sxx", "sxy", "syy")
    return _spread(fits, segments, keys).join(last, keys)
