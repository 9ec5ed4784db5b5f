"""Poses that wait: buffered until enough have come or none comes, and the latest pose over a solution that is replaced meanwhile.

``buffered`` holds each robot's relative poses in a list state and turns them
into poses ``increment`` at a time, or when nothing has come for ``idle``
seconds of processing time; give it a processing-time trigger, as its timers
keep a stream that is to end when its input does from ending. ``latest`` keeps what has moved since the last
batch solution and composes it onto that; a newer solution takes the place of
the old one and of the motions up to its seq.

Defined results: rows of a batch are taken in order of seq, so batches must not
overlap in seq for a robot; a seq seen before is ignored; null motions count as
nought; before any solution the origin is the base; a solution older than the
one held is ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOTION = "seq long, dx double, dy double, dth double"
BASE = "seq long, x double, y double, th double, n long"
POSES = "robot_id string, pose_id long, seq long, x double, y double, th double"
LATEST = "robot_id string, seq long, x double, y double, th double, pending long"


def onward(pose: tuple, motion: tuple) -> tuple:
    """A pose moved by (dx, dy, dth) in its own frame; the angle is wrapped."""
    x, y, th = pose
    dx, dy, dth = (0.0 if v is None or v != v else float(v) for v in motion)
    c, s, a = math.cos(th), math.sin(th), th + dth
    return x + c * dx - s * dy, y + s * dx + c * dy, math.atan2(math.sin(a), math.cos(a))


class BufferedPoses(StatefulProcessor):
    def __init__(self, increment: int, idle: float):
        self.increment, self.idle = increment, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", MOTION)
        self.last = handle.getValueState("last", BASE)

    def _flushed(self, key, n: int) -> pd.DataFrame:
        """The first n pending motions as poses; the rest stay."""
        held = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        seq, *pose, count = tuple(self.last.get()) if self.last.exists() else (-1, 0.0, 0.0, 0.0, 0)
        pose, out = tuple(pose), []
        for motion in held[:n]:
            seq, pose = motion[0], onward(pose, motion[1:])
            out.append((key[0], count, seq, *pose))
            count += 1
        self.last.update((seq, *pose, count))
        if held[n:]:
            self.pending.put(held[n:])
        else:
            self.pending.clear()
        return pd.DataFrame(out, columns=["robot_id", "pose_id", "seq", "x", "y", "th"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        seen = held[-1][0] if held else self.last.get()[0] if self.last.exists() else -1
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            if e.seq > seen:
                seen = int(e.seq)
                held.append((seen, e.dx, e.dy, e.dth))
        if held:
            self.pending.put(held)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        whole = len(held) // self.increment * self.increment
        if len(held) > whole:
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + int(1000 * self.idle))
        if whole:
            yield self._flushed(key, whole)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            yield self._flushed(key, len(list(self.pending.get())))

    def close(self) -> None:
        pass


def buffered(motions: DataFrame, increment: int, idle: float) -> DataFrame:
    """A stream (robot_id, seq, dx, dy, dth) into poses (robot_id, pose_id, seq, x, y, th), ``increment`` at a time or after ``idle`` seconds without any."""
    return motions.groupBy("robot_id").transformWithStateInPandas(BufferedPoses(increment, idle), POSES, "Append", "ProcessingTime")


class LatestPose(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("moved", MOTION)
        self.base = handle.getValueState("base", BASE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        base = tuple(self.base.get())[:4] if self.base.exists() else (-1, 0.0, 0.0, 0.0)
        held = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        seen = max(base[0], held[-1][0] if held else -1)
        come = pd.concat(list(rows)).sort_values("seq")
        for e in come[~come["solved"]].itertuples():
            if e.seq > seen:
                seen = int(e.seq)
                held.append((seen, e.dx, e.dy, e.dth))
        for e in come[come["solved"]].itertuples():
            if e.seq > base[0]:
                base = (int(e.seq), float(e.x), float(e.y), float(e.th))
        held = [m for m in held if m[0] > base[0]]
        self.base.update((*base, 0))
        if held:
            self.pending.put(held)
        else:
            self.pending.clear()
        pose = base[1:]
        for motion in held:
            pose = onward(pose, motion[1:])
        yield pd.DataFrame([(key[0], held[-1][0] if held else base[0], *pose, len(held))], columns=["robot_id", "seq", "x", "y", "th", "pending"])

    def close(self) -> None:
        pass


def latest(motions: DataFrame, solutions: DataFrame) -> DataFrame:
    """Streams (robot_id, seq, dx, dy, dth) and (robot_id, seq, x, y, th: the pose at seq by a batch solution) into the latest pose of each robot a batch has news of."""
    nought = F.lit(None).cast("double")
    moved = motions.select("robot_id", F.lit(False).alias("solved"), F.col("seq").cast("long").alias("seq"), "dx", "dy", "dth", *[nought.alias(k) for k in ("x", "y", "th")])
    known = solutions.select("robot_id", F.lit(True).alias("solved"), F.col("seq").cast("long").alias("seq"), *[nought.alias(k) for k in ("dx", "dy", "dth")], "x", "y", "th")
    return moved.unionByName(known).groupBy("robot_id").transformWithStateInPandas(LatestPose(), LATEST, "Update", "None")
