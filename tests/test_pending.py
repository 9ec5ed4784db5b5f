"""Buffered poses and the latest pose over batches, restarts, idle keys and replaced solutions."""

import json
import math
import random
import time

import pytest

from atlasfold.streaming import pending


def composed(motions, pose=(0.0, 0.0, 0.0)):
    out = []
    for _, *m in motions:
        pose = pending.onward(pose, m)
        out.append(pose)
    return out


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def put(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"_{name}").write_text("\n".join(map(json.dumps, events)))
    (folder / f"_{name}").rename(folder / f"{name}.json")


def motions_of(g, n):
    return [(k, g.uniform(-1, 1), g.uniform(-1, 1), g.uniform(-1, 1)) for k in range(n)]


def test_poses_wait_for_enough_or_for_idleness(spark, rocks, tmp_path):
    g = random.Random(1)
    data = {"r1": motions_of(g, 11), "r2": motions_of(g, 3), "r3": motions_of(g, 4)}
    schema, got = "robot_id string, seq long, dx double, dy double, dth double", []

    def run(**trigger):
        poses = pending.buffered(spark.readStream.schema(schema).json(str(tmp_path / "in")), 4, 1.0)
        q = poses.writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(**trigger).start()
        return q

    def events(part):
        return [{"robot_id": r, "seq": s, "dx": x, "dy": y, "dth": t} for r, own in data.items() for s, x, y, t in own[part]]

    for k, part in enumerate((slice(0, 3), slice(3, 6), slice(2, 11))):  # the third repeats some; each run restarts
        put(tmp_path / "in", str(k), events(part))
        q, until = run(processingTime="300 milliseconds"), time.time() + 60
        ready = {r: min(len(own), part.stop) // 4 * 4 for r, own in data.items()}
        while any(sum(x[0] == r for x in got) < n for r, n in ready.items()) or not any(x["numInputRows"] for x in q.recentProgress):
            assert time.time() < until
            time.sleep(0.3)
        q.stop()
    q = run(processingTime="500 milliseconds")
    until = time.time() + 60
    while len(got) < 18 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    for r, own in data.items():
        mine = sorted(x for x in got if x[0] == r)
        assert [x[1:3] for x in mine] == [(k, k) for k in range(len(own))]
        assert all(math.isclose(a, b, abs_tol=1e-9) for x, p in zip(mine, composed(own), strict=True) for a, b in zip(x[3:], p, strict=True))


def test_the_latest_pose_is_the_solution_and_what_moved_since(spark, rocks, tmp_path):
    g = random.Random(2)
    data = {"r1": motions_of(g, 12), "r2": motions_of(g, 12)}
    moved = "robot_id string, seq long, dx double, dy double, dth double"
    solved = "robot_id string, seq long, x double, y double, th double"
    solutions = [("r1", 4, 1.0, 2.0, 0.5), ("r1", 2, 9.0, 9.0, 9.0), ("r1", 9, -1.0, 0.0, 3.0), ("r2", 11, 5.0, 5.0, -1.0)]
    (tmp_path / "solved").mkdir()
    base, last = {r: (-1, 0.0, 0.0, 0.0) for r in data}, {r: -1 for r in data}
    for k in range(4):
        put(tmp_path / "moved", str(k), [{"robot_id": r, "seq": s, "dx": x, "dy": y, "dth": t} for r, own in data.items() for s, x, y, t in own[3 * k : 3 * k + 3]])
        news = {0: [], 1: solutions[:1], 2: solutions[1:2], 3: solutions[2:]}[k]
        if news:
            put(tmp_path / "solved", str(k), [dict(zip(("robot_id", "seq", "x", "y", "th"), s, strict=True)) for s in news])
        got = []
        found = pending.latest(spark.readStream.schema(moved).json(str(tmp_path / "moved")), spark.readStream.schema(solved).json(str(tmp_path / "solved")))
        q = found.writeStream.foreachBatch(lambda df, _, got=got: got.extend(tuple(r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for r, s, *p in news:
            if s > base[r][0]:
                base[r] = (s, *p)
        for r, own in data.items():
            last[r] = 3 * k + 2
            rest = [m for m in own[: 3 * k + 3] if m[0] > base[r][0]]
            want = ([tuple(base[r][1:])] + composed(rest, tuple(base[r][1:])))[-1]
            mine = [x for x in got if x[0] == r][-1]
            assert mine[1] == max(last[r], base[r][0]) and mine[5] == len(rest) and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(mine[2:5], want, strict=True))
