"""Seeded draws, segments with both ends free, their uncertainties, and corrections of many graphs against one session each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasfold.functions import draws
from atlasfold.operators import uncertain

SEG = "k long, x0 double, y0 double, x1 double, y1 double, mass long"


def test_draws_follow_the_keys_alone(spark):
    df = spark.range(20_000).withColumn("other", F.lit(None).cast("string"))
    x, y = draws.multivariate_normal((F.lit(1.0), F.lit(-2.0)), (F.lit(0.5), F.lit(0.3), F.lit(0.4)), 3, "id", "other")
    take = lambda d: d.select("id", draws.uniform(1, "id").alias("u"), draws.between(2.0, 4.0, 2, "id").alias("b"), draws.normal(0.0, 1.0, 4, "id").alias("z"), x.alias("x"), y.alias("y")).orderBy("id").toPandas()
    a, b = take(df.repartition(7)), take(df.coalesce(1).orderBy(F.desc("id")))
    assert a.equals(b)
    assert abs(a.u.mean() - 0.5) < 0.01 and abs(a.u.var() - 1 / 12) < 0.003 and a.b.between(2, 4).all()
    assert abs(a.z.mean()) < 0.03 and abs(a.z.std() - 1) < 0.02
    assert np.allclose(np.cov(a.x, a.y), [[0.5, 0.3], [0.3, 0.4]], atol=0.02) and abs(a.x.mean() - 1) < 0.02 and abs(a.y.mean() + 2) < 0.02
    assert df.select(draws.uniform(1, "id").alias("a"), draws.uniform(2, "id").alias("b")).where("a = b").count() == 0


def test_slopes_equal_differences():
    g = np.random.default_rng(4)
    ends, xy = np.array([0.0, 0.1, 2.0, 0.7]), g.normal(0, 2, (200, 2))
    r, j, _ = uncertain.end_terms(ends, xy, xy.mean(0), len(xy))
    for i in range(4):
        step = np.eye(4)[i] * 1e-6
        d = (uncertain.end_terms(ends + step, xy, xy.mean(0), len(xy))[0] - uncertain.end_terms(ends - step, xy, xy.mean(0), len(xy))[0]) / 2e-6
        assert np.allclose(d, j[:, i], atol=1e-5)
    one = np.array([xy[0, 0], xy[0, 1], xy[0, 0], xy[0, 1]])
    r, j, _ = uncertain.end_terms(one, xy, xy.mean(0), len(xy))  # a segment without length
    assert np.isfinite(r).all() and np.isfinite(j).all()


def walls(g, n=150):
    rows = []
    for k in range(4):
        a = k * 0.8
        t, off = g.uniform(0, 3, n), g.normal(0, 0.03, n)
        rows += [(k, float(k + s * np.cos(a) - o * np.sin(a)), float(s * np.sin(a) + o * np.cos(a))) for s, o in zip(t, off, strict=True)]
    return rows


def guess(k):
    return (k, k + 0.4 * np.cos(k * 0.8) + 0.1, 0.4 * np.sin(k * 0.8), k + 2.5 * np.cos(k * 0.8), 2.5 * np.sin(k * 0.8) - 0.1, 150)


def test_ends_are_least_squares_by_either_way(spark):
    rows = walls(np.random.default_rng(1))
    points = spark.createDataFrame([*rows, (0, None, 1.0)], "k long, wx double, wy double").withColumn("n", F.lit("clash"))
    segments = spark.createDataFrame([tuple(map(float, guess(k)[1:5])) + (k,) for k in range(5)], "x0 double, y0 double, x1 double, y1 double, k long")
    names = ["k", *uncertain.ENDS, "n", "cost"]
    whole = {r.k: r for r in uncertain.fit_ends(points, segments, ["k"]).select(names).collect()}
    parts = {r.k: r for r in uncertain.fit_ends(points.repartition(5), segments, ["k"], whole=0).select(names).collect()}
    assert set(whole) == set(parts) == set(range(5)) and whole[4].n == 0 and whole[4].cost is None and whole[4].x0 == pytest.approx(guess(4)[1])
    for k in range(4):
        assert whole[k].n == 150 and np.allclose(whole[k][1:], parts[k][1:], atol=2e-3)
        xy = np.array([r[1:] for r in rows if r[0] == k])
        ends = np.array(whole[k][1:5])
        cost = lambda e: float((uncertain.end_terms(e, xy, xy.mean(0), len(xy))[0] ** 2).sum() / 2)
        assert cost(ends) == pytest.approx(whole[k].cost)
        around = [cost(ends + np.array(d)) for s in (0.05, 0.01, 0.003) for d in np.stack(np.meshgrid(*[[-s, 0, s]] * 4), -1).reshape(-1, 4)]
        assert min(around) >= whole[k].cost * (1 - 1e-4) and whole[k].cost < cost(np.array(guess(k)[1:5]))
    none = points.where("false")
    assert {r.n for r in uncertain.fit_ends(none, segments, ["k"]).collect()} == {0}
    assert uncertain.fit_ends(points, segments.where("false"), ["k"]).count() == 0


def test_uncertainties_equal_a_plain_resampling(spark):
    g = np.random.default_rng(2)
    rows = walls(g)
    points = spark.createDataFrame([(*r, i, r[1] * 0.5 + 1, r[2] - 2.0) for i, r in enumerate(rows)], "k long, wx double, wy double, i long, sx double, sy double")
    segments = spark.createDataFrame([(k, *map(float, uncertain.fit_points(guess(k)[1:5], np.array([r[1:] for r in rows if r[0] == k]))[0]), 150) for k in range(4)], SEG)
    covs = [f"c{e}{p}" for e in (0, 1) for p in ("xx", "xy", "yy")]
    got = {r.k: np.array(r[1:]) for r in uncertain.sensor_uncertainty(points, segments, ["k"], ["i"], 60).select("k", *covs).collect()}
    again = {r.k: np.array(r[1:]) for r in uncertain.sensor_uncertainty(points.repartition(3), segments, ["k"], ["i"], 60).select("k", *covs).collect()}
    given = {r.k: np.array(r[1:5]) for r in segments.collect()}
    for k in range(4):
        assert np.allclose(got[k], again[k], rtol=1e-6)
        xy, s = (np.array([(f(r)) for r in points.where(F.col("k") == k).collect()]) for f in (lambda r: (r.wx, r.wy), lambda r: (r.sx, r.sy)))
        ray = xy - s
        d = np.hypot(*ray.T)
        u = ray / d[:, None]
        fits = []
        for _ in range(150):  # noise along and across each ray, scaled as the ellipse is
            a, b = np.sqrt(5.991) * 0.03 * g.normal(size=len(xy)), np.sqrt(5.991) * 0.002 * d * g.normal(size=len(xy))
            fits.append(uncertain.fit_points(given[k], xy + a[:, None] * u + b[:, None] * np.stack([-u[:, 1], u[:, 0]], 1))[0])
        off = np.array(fits) - given[k]
        want = [(off[:, i] * off[:, j]).mean() for i, j in ((0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3))]
        assert np.allclose(got[k], want, rtol=0.5, atol=4e-4)
    made = lambda df: {r.k: np.array(r[1:]) for r in uncertain.resampled(df, ["k"], 0.03, 50).select("k", *covs, "mx", "my", "sxx", "sxy", "syy").collect()}
    one, two = made(segments), made(segments.repartition(3))
    assert set(one) == set(range(4)) and all((one[k] == two[k]).all() for k in one)
    for k in range(4):
        assert np.allclose(one[k][6:8], (given[k][:2] + given[k][2:]) / 2, atol=0.3)
        off = np.array([uncertain.fit_points(given[k], given[k][:2] + g.random((150, 1)) * (given[k][2:] - given[k][:2]) + 0.03 * g.normal(size=(150, 2)))[0] for _ in range(100)]) - given[k]
        assert one[k][0] + one[k][2] == pytest.approx((off[:, :2] ** 2).sum(1).mean(), rel=0.5, abs=1e-3)
    assert made(segments.withColumn("mass", F.lit(0))) == {}


def test_all_graphs_at_once_equal_a_session_each(spark):
    from pathlib import Path

    from atlasfold.plans import queries as plans
    from atlasfold.plans.replay import replay
    from atlasfold.plans.session import Session
    from atlasfold.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("needs the driver's tables")
    p = fx.poses(spark, sf).select("graph_id", "pose_id", "x", "y", "th", "var_t", "var_r").cache()
    s = fx.scans(spark, sf).select("graph_id", "pose_id", "obs_id", "px", "py").join(p.select("graph_id", "pose_id"), ["graph_id", "pose_id"], "left_semi").cache()
    drawn = plans.correction_log(fx.world(spark, sf)).collect()[:5]
    far = [900.0, 900.0, 901.0, 900.0, 902.0, 900.0, 903.0, 901.0]
    rows = [(r.graph_id, 1, r.type, False, r.points) for r in drawn] + [(drawn[0].graph_id, 0, 2, False, far), (drawn[1].graph_id, 2, 1, False, far[:4]), (drawn[2].graph_id, 3, 2, True, drawn[2].points)]
    log = spark.createDataFrame(rows, "graph_id long, entry_id int, type int, undone boolean, points array<double>")
    got = {(r.graph_id, r.pose_id): (r.x, r.y, r.th) for r in replay(p, s, log, skip_undone=True).collect()}
    assert set(got) == {(r.graph_id, r.pose_id) for r in p.collect()}
    moved = 0
    for r in drawn[:3]:
        one = F.col("graph_id") == r.graph_id
        session = Session(p.where(one), s.where(one))
        entries = [(e[1], e[2], e[3], list(zip(e[4][::2], e[4][1::2], strict=True))) for e in sorted(rows, key=lambda e: e[1]) if e[0] == r.graph_id]
        moved += session.replay(entries, skip_undone=True).count("ok")
        for q in session.poses.collect():
            assert np.allclose(got[q.graph_id, q.pose_id], (q.x, q.y, q.th), atol=1e-7)
    assert moved == 3
    unchanged = {(r.graph_id, r.pose_id): (r.x, r.y, r.th) for r in replay(p, s, log.where("false")).collect()}
    assert unchanged == {(r.graph_id, r.pose_id): (r.x, r.y, r.th) for r in p.collect()}


def test_sums_of_spark_are_those_of_the_points(spark):
    """Before the ends, beside the segment, beyond them, on it and on an end; a segment without length."""
    g = np.random.default_rng(9)
    xy = {k: np.concatenate([g.normal(0, 2, (200, 2)), [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]]) for k in range(3)}
    ends = {0: (0.0, 0.0, 2.0, 0.0), 1: (-1.0, 0.3, 1.5, 0.9), 2: (0.5, 0.5, 0.5, 0.5)}
    points = spark.createDataFrame([(k, *map(float, p)) for k in xy for p in xy[k]], "k long, wx double, wy double")
    rows = [(k, *ends[k], len(xy[k]), *map(float, xy[k].mean(0))) for k in xy]
    state = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double, n long, mx double, my double")
    found = uncertain._summed(points, state, ["k"], ["k"], (F.col("wx"), F.col("wy")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
    for row in uncertain.equations(state.join(found, "k").toPandas()).itertuples():
        own = xy[row.k]
        r, j, h = uncertain.end_terms(np.array(ends[row.k]), own, own.mean(0), len(own))
        assert row.cost == pytest.approx(r @ r / 2)
        assert np.allclose([row.g0, row.g1, row.g2, row.g3], j.T @ r)
        assert np.allclose([getattr(row, k) for k in uncertain._H], [h.sum(0)[int(k[1]), int(k[2])] for k in uncertain._H])


def test_a_name_spelt_once_draws_the_same(spark):
    df = spark.range(200).withColumns({"w": F.col("id") / 7.0, "none": F.lit(None).cast("string")})
    a, b = draws.normals(7, "id", "none", "w", "s"), draws.normals(F.col("name"), "s")
    rows = df.withColumn("name", draws.named(7, "id", "none", "w")).withColumn("s", F.explode(F.array(F.lit(1), F.lit(2))))
    assert rows.where((a[0] != b[0]) | (a[1] != b[1])).count() == 0 and rows.select(b[0].alias("b")).distinct().count() == 400


def test_moments_do_not_depend_on_the_order_of_fits(spark):
    fits = [(0, i, *(4 * [x])) for i, x in enumerate([1e8, *(400 * [1.0])])] + [(1, 0, None, 1.0, 2.0, 3.0), (1, 1, 2.0, 1.0, 2.0, 3.0)]
    segments = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 0.0) for k in range(3)], "k long, x0 double, y0 double, x1 double, y1 double")
    schema = "k long, _sample int, x0 double, y0 double, x1 double, y1 double"
    one, two = ({r.k: tuple(r[1:]) for r in uncertain._spread(spark.createDataFrame(rows, schema).coalesce(1), segments, ["k"]).collect()} for rows in (fits, fits[::-1]))
    assert one == two and set(one) == {0, 1}
    assert one[1] == (4.0, 2.0, 1.0, 4.0, 6.0, 9.0) and one[0] == pytest.approx(6 * [1e16 / 401])


def test_points_in_blocks_fit_as_an_array_does():
    g = np.random.default_rng(12)
    for k in range(4):
        xy = np.array([r[1:] for r in walls(g, 3000) if r[0] == k])
        blocks = lambda: ((xy[i : i + 700, 0], xy[i : i + 700, 1]) for i in range(0, len(xy), 700))  # noqa: B023, E731
        one, two = uncertain.fit_points(guess(k)[1:5], xy), uncertain.fit_blocks(guess(k)[1:5], blocks, len(xy), xy.mean(0))
        assert np.allclose(one[0], two[0], atol=1e-6) and one[1] == pytest.approx(two[1])
    sums = uncertain._strip_sums(np.array([1.0, 2.0, 1.0, 2.0]), 0.1, np.array([1.0, 3.0]), np.array([2.0, 2.0]))  # without length
    assert sums[:, 0].tolist() == [2.0, 0.0, 0.0] and np.isfinite(sums).all()


def test_a_resampling_draws_the_whole_mass(spark):
    mass = 230_000
    segments = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 1.0, mass), (2, 0.0, 0.0, 3.0, 1.0, mass + 100_000)], SEG)
    rows = {r.k: r for r in uncertain.resampled(segments, ["k"], 0.03, 1).collect()}
    for k, n in ((1, mass), (2, mass + 100_000)):
        key = segments.where(F.col("k") == k).select(F.xxhash64(F.lit(11), F.col("k").cast("string"))).first()[0]
        xy = np.concatenate([np.stack(b, 1) for b in uncertain.drawn(np.array([0.0, 0.0, 3.0, 1.0]), n, 0.03, key, 1)])
        assert len(np.unique(xy, axis=0)) == n
        assert (rows[k].mx, rows[k].my) == pytest.approx(tuple(xy.mean(0))) and rows[k].sxy == pytest.approx((xy[:, 0] * xy[:, 1]).mean())
        off = uncertain.fit_points([0.0, 0.0, 3.0, 1.0], xy)[0] - (0.0, 0.0, 3.0, 1.0)
        assert rows[k].c0xx == pytest.approx(off[0] ** 2, rel=1e-3) and rows[k].c1yy == pytest.approx(off[3] ** 2, rel=1e-3)


def test_equal_points_under_noise_are_drawn_once(spark, monkeypatch):
    rows = [(*r, i, r[1] * 0.5 + 1, r[2] - 2.0) for i, r in enumerate(walls(np.random.default_rng(5), 40))]
    points = spark.createDataFrame(rows, "k long, wx double, wy double, i long, sx double, sy double").withColumn("w", F.explode(F.array(*[F.lit(1)] * 3)))
    segments = spark.createDataFrame([(k, *map(float, guess(k)[1:5]), 150) for k in range(5)], SEG)
    some = points.select(draws.named(7, "k", "i").alias("n"), F.lit(4).alias("w")).withColumns(dict(zip("ab", draws.normals(F.col("n"), "w"), strict=True))).limit(5).collect()
    x, y = uncertain.normal_digests([r.n for r in some], range(3, 6))
    assert np.allclose(x[:, 1], [r.a for r in some]) and np.allclose(y[:, 1], [r.b for r in some])
    seen = []
    monkeypatch.setattr(uncertain, "_fit_drawn", lambda noisy, *a, f=uncertain._fit_drawn: seen.append(noisy.count()) or f(noisy, *a))
    monkeypatch.setattr(uncertain, "TOGETHER", 3)
    got = {r.k: np.array(r[1:]) for r in uncertain.sensor_uncertainty(points, segments, ["k"], ["i"], 4).collect()}
    assert seen == [len(rows)] * 2  # two batches of samples, of a row for each three equal points
    by_sums = {r.k: np.array(r[1:]) for r in uncertain.sensor_uncertainty(points, segments, ["k"], ["i"], 4, held=0).collect()}
    assert set(got) == set(by_sums) == set(range(4)) and all(np.allclose(got[k], by_sums[k], rtol=1e-3, atol=1e-5) for k in got)
