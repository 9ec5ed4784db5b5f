"""Text formats round trip; sessions verify, correct, undo and replay; streams give commands."""

import json
import math

import pytest
from pyspark.sql import functions as F

from atlasfold.operators import correct, display, grid, lines, sensors
from atlasfold.plans.session import Session
from atlasfold.sources import corrections, posegraph

HEAD = "Map\n1455656519.379815\n"


def obs(pose, point, cov=0.5):
    return ",".join(f"{v:.4f}" for v in pose) + ", " + ",".join(f"{v:.4f}" for v in point) + ", 0.0000,1.0000" + f", {cov:.5f}" * 9 + "\n"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture()
def graph_file(tmp_path):
    a, b = (0.0, 0.0, 0.0), (1.0, 2.0, math.pi / 2)
    f = tmp_path / "graph.txt"
    f.write_text(HEAD + obs(a, (1, 0), 0.1) + obs(a, (2, 0), 0.2) + obs(b, (1, 3)) + obs(a, (5, 5)) + obs(b, (1, 2)))
    return f


def test_runs_of_poses_and_frames(spark, graph_file):
    poses, scans = posegraph.read_posegraph(spark, str(graph_file))
    p = sorted(rows(poses), key=lambda r: r["pose_id"])
    assert [r["pose_id"] for r in p] == [0, 1, 2, 3] and p[0]["cov"] == [0.1] * 9 and math.isclose(p[1]["th"], 1.5708)
    s = {(r["pose_id"], r["obs_id"]): r for r in rows(scans)}
    assert len(s) == 5 and math.isclose(s[1, 0]["px"], 1.0, abs_tol=1e-4) and math.isclose(s[1, 0]["nx"], 1.0, abs_tol=1e-4)
    shifted = {(r["pose_id"], r["obs_id"]): r for r in rows(posegraph.read_posegraph(spark, str(graph_file), compat=True)[1])}
    assert math.isclose(shifted[1, 0]["nx"], -1.0, abs_tol=1e-3)
    assert posegraph.read_posegraph(spark, str(graph_file), placeholder=True)[1].count() == 4


def test_posegraph_round_trip(spark, graph_file, tmp_path):
    poses, scans = posegraph.read_posegraph(spark, str(graph_file))
    posegraph.write_posegraph(poses, scans, str(tmp_path / "out"), "Map", 1455656519.379815)
    (part,) = (tmp_path / "out").glob("part-*")
    again = posegraph.read_posegraph(spark, str(part))
    key = lambda df: sorted((r["pose_id"], r["obs_id"], round(r["px"], 3), round(r["py"], 3)) for r in rows(df))
    assert key(again[1]) == key(scans) and again[0].count() == 4


def test_malformed_lines(spark, graph_file):
    graph_file.write_text(graph_file.read_text() + "1,2,x\n" + obs((9, 9, 0), (9, 9)))
    assert posegraph.read_posegraph(spark, str(graph_file), mode="PERMISSIVE")[0].count() == 4
    with pytest.raises(Exception, match="line 8 is malformed"):
        posegraph.read_posegraph(spark, str(graph_file))[0].collect()


def test_logs(spark, tmp_path):
    text = "2\n2, 0\n1.0000, 2.0000\n3.0000, 2.0000\n1.0000, 2.3000\n3.0000, 2.3500\n7, 1\n0,0\n1,0\n0,1\n1,1\n"
    entries = corrections.parse_log(text)
    assert [e[1:3] for e in entries] == [(2, False), (6, True)] and entries[0][3][3] == (3.0, 2.35)
    assert corrections.parse_log(corrections.format_log(entries)) == entries
    assert corrections.parse_log("1.5\n3\n9\n" + "4, 0\n0,0\n1,0\n0,1\n1,1\n", version=1)[0][1] == 4
    (tmp_path / "l.log").write_text(text)
    assert corrections.read_log(spark, str(tmp_path / "l.log")).count() == 2
    for bad in ("1\n9, 0\n", "2\n2, 0\n1,1\n"):
        with pytest.raises(ValueError):
            corrections.parse_log(bad)


def test_grids_drawings_and_small_files(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2.5), (2, 0, -1.0)], "ix int, iy int, value double")
    posegraph.write_grid(cells, str(tmp_path / "grid"), "value", 3, 2, (1.0, -1.0))
    (part,) = (tmp_path / "grid").glob("part-*")
    back = {(r["ix"], r["iy"]): r["value"] for r in rows(posegraph.read_grid(spark, str(part), "value"))}
    assert back == {(0, 0): 0, (0, 1): 2.5, (1, 0): 0, (1, 1): 0, (2, 0): -1, (2, 1): 0}
    (tmp_path / "d.vec").write_bytes(corrections.drawing_bytes([("line", [1, 2, 3, 4], 7), ("circle", [1, 2, 0.5], 9), ("point", [8, 9], 1)]))
    d = {(r["kind"]): r for r in rows(corrections.read_drawing(spark, str(tmp_path / "d.vec")))}
    assert d["line"]["c3"] == 4 and d["circle"]["c2"] == 0.5 and d["point"]["c2"] is None and d["circle"]["colour"] == 9
    (tmp_path / "k.txt").write_text("2.5\n1.5\n\n")
    assert [r["t"] for r in rows(posegraph.read_keyframes(spark, str(tmp_path / "k.txt")))] == [1.5, 2.5]
    (tmp_path / "c.txt").write_text("2,0\n0.1, 0.02\n0.2,-0.01\n")
    assert [r["delta"] for r in rows(posegraph.read_laser_corrections(spark, str(tmp_path / "c.txt")))] == [0.02, -0.01]
    (tmp_path / "a.txt").write_text("1 Floor\n2 Attic\n")
    assert [(r["map_id"], r["name"]) for r in rows(posegraph.read_atlas(spark, str(tmp_path / "a.txt")))] == [(1, "Floor"), (2, "Attic")]
    (tmp_path / "m.json").write_text(json.dumps({"map_name": "a", "x": 1.0, "y": 2, "angle": 0.5}))
    assert rows(corrections.read_messages(spark, str(tmp_path / "m.json"), "map_location"))[0]["y"] == 2.0


def corridor(spark, n=40, drift=0.02):
    """Out along a wall and back beside it, the way back drifting."""
    k = F.col("pose_id") % (n // 2)
    back = F.col("pose_id") >= n // 2
    p = spark.range(n).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").cast("int").alias("pose_id"))
    p = p.withColumns({"x": k * 0.5, "y": F.when(back, drift * (k + 1)).otherwise(0.0), "th": F.lit(0.0), "var_t": F.lit(1e-3), "var_r": F.lit(1e-4)})
    s = p.select("graph_id", "pose_id", F.posexplode(F.sequence(F.lit(0), F.lit(39))).alias("obs_id", "o")).select("graph_id", "pose_id", "obs_id", (F.col("o") * 0.05 - 1.0).alias("px"), F.lit(1.0).alias("py"))
    return Session(p, s)


def test_session_corrects_undoes_and_replays(spark):
    s = corridor(spark)
    before = {r["pose_id"]: (r["x"], r["y"], r["th"]) for r in rows(s.poses)}
    w = {r["pose_id"]: r["wy"] for r in rows(s.world().groupBy("pose_id").agg(F.max("wy").alias("wy")))}
    late, early = w[38], w[5]
    entry = [(8.55, late), (9.4, late), (2.0, early), (3.0, early)]
    assert s.correct(2, [(50.0, 50.0), (51.0, 50.0), (2.0, 1.0), (3.0, 1.0)]) == "unverified"
    assert s.correct(1, entry) == "invalid" and not s.undo()
    state = s.correct(2, entry)
    assert state == "ok"
    after = {r["pose_id"]: (r["x"], r["y"], r["th"]) for r in rows(s.poses)}
    assert set(after) == set(before) and any(math.dist(after[i][:2], before[i][:2]) > 0.1 for i in after)
    assert s.log()[0][1] == 2
    t = corridor(spark)
    assert t.replay([(0, 2, False, entry), (1, 2, True, entry)], skip_undone=True) == ["ok"] and t.history == []
    replayed = {r["pose_id"]: (r["x"], r["y"]) for r in rows(t.poses)}
    assert all(math.dist(replayed[i], after[i][:2]) < 1e-9 for i in after)
    assert s.undo() and {r["pose_id"]: (r["x"], r["y"], r["th"]) for r in rows(s.poses)} == before and s.log()[0][2] and not s.undo()


def test_backprop_is_the_sequential_loop(spark):
    n, lo, hi, c = 12, 3, 9, (0.7, -0.4, 0.3)
    p = [(1, i, 0.4 * i, 0.1 * (i % 3), 0.05 * i, 1e-3 * (1 + i % 4), 1e-4 * (1 + i % 5)) for i in range(n)]
    df = spark.createDataFrame(p, "graph_id long, pose_id int, x double, y double, th double, var_t double, var_r double")
    found = {r["pose_id"]: r for r in rows(correct.backpropagate(df, lo, hi, c))}
    x = {i: [a, b, t] for _, i, a, b, t, _, _ in p}
    dest = (x[hi][0] + c[0], x[hi][1] + c[1])
    wr, wt = sum(p[i][6] for i in range(lo, hi + 1)) + 1e-4, sum(p[i][5] for i in range(lo, hi + 1)) + 1e-3
    for i in range(lo, hi):
        d = c[2] * p[i][6] / wr
        x[i][2] += d
        for k in range(i + 1, hi + 1):
            dx, dy = x[k][0] - x[i][0], x[k][1] - x[i][1]
            x[k] = [x[i][0] + math.cos(d) * dx - math.sin(d) * dy, x[i][1] + math.sin(d) * dx + math.cos(d) * dy, x[k][2] + d]
    t = (dest[0] - x[hi][0], dest[1] - x[hi][1])
    for i in range(lo, hi):
        for k in range(i + 1, hi + 1):
            x[k][0] += t[0] * p[i][5] / wt
            x[k][1] += t[1] * p[i][5] / wt
    for i in range(lo, hi + 1):
        assert all(math.isclose(found[i][k], x[i][j], abs_tol=1e-9) for j, k in enumerate(("x", "y", "th")))


def test_covariance_variants(spark):
    df = spark.createDataFrame([(1, i, 1e-3, 1e-4, [float(k) for k in range(1, 10)]) for i in range(4)], "graph_id long, pose_id int, var_t double, var_r double, cov array<double>")
    fixed = {r["pose_id"]: r["cov"] for r in rows(correct.scale_covariances(df, 1, 3))}
    compat = {r["pose_id"]: r["cov"] for r in rows(correct.scale_covariances(df, 1, 3, compat=True))}
    assert fixed[0] == fixed[3] == [float(k) for k in range(1, 10)] and fixed[1] == [0.5 * k for k in range(1, 10)]
    assert compat[1][2] == 0.75 and compat[1][5] == 6.0 and compat[1][6] == 3.5


def test_pieces_of_maps(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 0.0)], "graph_id long, seg_id int, x0 double, y0 double, x1 double, y1 double")
    heavy = spark.createDataFrame([(1, i, 0, 0.0, 1.0 if i not in (6, 7) else 0.0) for i in range(17)], "graph_id long, ix int, iy int, value double, weight double")
    cut = sorted((r["x0"], r["x1"]) for r in rows(lines.prune(seg, heavy, 0.25, ["graph_id"])))
    assert cut == [(0.0, 1.25), (2.0, 4.0)]
    assert lines.rasterise(seg, 1.0, ["graph_id"]).count() == 5
    assert {r["weight"] for r in rows(grid.binarised(heavy, ["graph_id"]))} == {0.0, 255.0}
    pts = spark.createDataFrame([(1, 1.0, 0.0), (1, 1.6, 0.0)], "graph_id long, wx double, wy double")
    wide = spark.createDataFrame([(1, i, j, 0.0, 1.0 if i < 6 else 0.0) for i in range(-2, 20) for j in range(-3, 4)], "graph_id long, ix int, iy int, value double, weight double")
    assert [r["wx"] for r in rows(grid.filter_points(pts, wide, 0.25, ["graph_id"], share=0.9))] == [1.0]
    m = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0, 1.0)], "mx double, my double, cxx double, cxy double, cyy double")
    poly = rows(lines.ellipse_polygon(m, 90))
    assert len(poly) == 5 and math.isclose(poly[0]["ex"], math.sqrt(5.991 * 4)) and math.isclose(poly[1]["ey"], math.sqrt(5.991))


def test_messages_and_gates(spark):
    msg = spark.createDataFrame([("a", [1.0, 2.0], [3.0]), ("b", [], [1.0])], "pub string, lx array<double>, ly array<double>")
    assert rows(display.primitives(msg, {"lx": "x", "ly": "y"})) == [{"pub": "a", "x": 1.0, "y": 3.0}]
    p = spark.createDataFrame([(1, i, 0.4 * i, 0.0, 0.0) for i in range(8)], "graph_id long, pose_id int, x double, y double, th double")
    assert sorted(r["pose_id"] for r in rows(sensors.gate(p, 1.0, 0.5))) == [0, 3, 6]
    pts = spark.createDataFrame([(1, 0, i, x, 0.0) for i, x in enumerate([0.0, 0.1, 0.2, 5.0, 9.0, 9.1])], "graph_id long, pose_id int, obs_id int, px double, py double")
    assert sorted(r["obs_id"] for r in rows(sensors.scan_normals(pts, 0.25))) == [0, 1, 2, 4, 5]


def test_streamed_corrections(spark, tmp_path):
    from atlasfold.streaming import events

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id string, seq int, event_type string, modifiers int, keycode int, x0 double, y0 double, x1 double, y1 double"
    data = [("s", 1, "key", 0, 0x50, 0.0, 0.0, 0.0, 0.0), ("s", 2, "click", 2, 0, 0.0, 0.0, 1.0, 0.0), ("s", 3, "click", 2, 0, 2.0, 0.0, 3.0, 0.0), ("s", 4, "key", 0, 0x50, 0.0, 0.0, 0.0, 0.0), ("t", 5, "key", 0, 0x56, 0.0, 0.0, 0.0, 0.0)]
    spark.createDataFrame(data, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = events.corrections(stream).writeStream.format("memory").queryName("commands").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted((r["session_id"], r["seq"], r["command"], r["type"]) for r in rows(spark.table("commands")))
    assert got == [("s", 4, "run", 2), ("t", 5, "save", 0)]
    odo = "robot_id string, seq int, t double, dx double, dy double, dth double"
    spark.createDataFrame([("r", i, float(i), 0.4, 0.0, 0.0) for i in range(6)], odo).coalesce(1).write.json(str(tmp_path / "odo"))
    q = events.scan_poses(spark.readStream.schema(odo).json(str(tmp_path / "odo")), 1.0, 0.5, 100.0).writeStream.format("memory").queryName("scanposes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert [(r["seq"], round(r["dx"], 6)) for r in rows(spark.table("scanposes").orderBy("seq"))] == [(2, 1.2), (5, 1.2)]


def test_localize_draws_scans_together(spark):
    import numpy as np

    from atlasfold.operators import localize

    g = np.random.default_rng(4)
    walls = np.array([(x, 3.0) for x in np.arange(-4, 10, 0.1)] + [(x, -2.0) for x in np.arange(-4, 10, 0.1)] + [(9.0, y) for y in np.arange(-2, 3, 0.1)])
    normals = np.array([(0.0, -1.0)] * 140 + [(0.0, 1.0)] * 140 + [(-1.0, 0.0)] * 50)
    truth = np.array([(0.4 * i, 0.05 * i, 0.03 * i) for i in range(9)])
    poses, scans = [], []
    for i, (x, y, th) in enumerate(truth):
        noise = g.normal(0, [0.06, 0.06, 0.02]) if i else np.zeros(3)
        poses.append((1, i, float(x + noise[0]), float(y + noise[1]), float(th + noise[2])))
        r = np.array([[np.cos(th), np.sin(th)], [-np.sin(th), np.cos(th)]])
        for o, (p, n) in enumerate(zip((walls - (x, y)) @ r.T, normals @ r.T, strict=True)):
            scans.append((1, i, o, *map(float, p), *map(float, n)))
    p = spark.createDataFrame(poses, "graph_id long, pose_id int, x double, y double, th double")
    s = spark.createDataFrame(scans, "graph_id long, pose_id int, obs_id int, px double, py double, nx double, ny double")
    out = {r["pose_id"]: r for r in rows(localize.localize(p, s, threshold=0.4, rounds=2, step=4, cap=9))}
    was = np.array([(q[2], q[3], q[4]) for q in poses]) - truth
    now = np.array([(out[i]["x"], out[i]["y"], out[i]["th"]) for i in range(9)]) - truth
    assert np.abs(now).mean() < 0.6 * np.abs(was).mean() and not now[0].any() and len(out[3]["cov"]) == 9
