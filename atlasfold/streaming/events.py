"""Structured Streaming: clicks and keys into corrections and commands, odometry into scan poses, and windows over events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..plans.session import Pending, add_points

#: The key codes of mode and run, undo, save, replay.
KEYS = {0x50: "mode", 0x55: "undo", 0x56: "save", 0x4C: "replay"}
COMMANDS = StructType([StructField("session_id", StringType()), StructField("seq", IntegerType()), StructField("command", StringType()), StructField("type", IntegerType()), StructField("points", StringType())])
_STATE = StructType([StructField("on", BooleanType()), StructField("kind", IntegerType()), StructField("done", IntegerType()), StructField("points", StringType()), StructField("seq", IntegerType())])


def _points(text: str) -> tuple:
    v = [float(x) for x in text.split()] if text else []
    return tuple(zip(v[::2], v[1::2], strict=True))


def _text(points) -> str:
    return " ".join(repr(float(v)) for p in points for v in p)


def step(state: tuple, event: dict) -> tuple[tuple, list[tuple[str, int, str]]]:
    """One event on (on, kind, done, points): the new state and commands (name, type, points). Moves are ignored."""
    on, kind, done, points = state
    if event["event_type"] == "click" and on:
        p = add_points(Pending(kind, _points(points), done), int(event["modifiers"]) & 7, (event["x0"], event["y0"]), (event["x1"], event["y1"]))
        return (on, p.kind, p.done, _text(p.points)), []
    if event["event_type"] == "key":
        name = KEYS.get(int(event["keycode"]))
        if name == "mode":
            if on:  # leaving the mode runs what is complete
                return (False, 0, 0, ""), [("run", done, points)] if done else []
            return (True, 0, 0, ""), []
        if name and not on:
            return state, [(name, 0, "")]
    return state, []


class Corrections(StatefulProcessor):
    """Keyed by session_id; events of a batch are taken in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else (False, 0, 0, "", 0)
        state, out = tuple(now[:4]), []
        events = pd.concat(list(rows)).sort_values("seq")
        last = int(now[4])
        for e in events.to_dict("records"):
            state, commands = step(state, e)
            last = int(e["seq"])
            out += [(key[0], last, *c) for c in commands]
        self.state.update((*state, last))
        yield pd.DataFrame(out, columns=["session_id", "seq", "command", "type", "points"])

    def close(self) -> None:
        pass


def corrections(events: DataFrame) -> DataFrame:
    """Commands of a stream (session_id, seq, event_type, modifiers, keycode, x0, y0, x1, y1)."""
    return events.groupBy("session_id").transformWithStateInPandas(Corrections(), COMMANDS, "Append", "None")


SCAN_POSES = StructType([StructField("robot_id", StringType()), StructField("seq", IntegerType()), StructField("dx", DoubleType()), StructField("dy", DoubleType()), StructField("dth", DoubleType())])
_MOTION = StructType([StructField(k, DoubleType()) for k in ("dx", "dy", "dth", "moved", "turned", "t")])


def accumulate(state: tuple, dx: float, dy: float, dth: float) -> tuple:
    """Pending motion: the angle first, then the step turned by the new angle; lengths add up."""
    x, y, a, moved, turned, t = state
    a += dth
    return x + dx * math.cos(a) - dy * math.sin(a), y + dx * math.sin(a) + dy * math.cos(a), a, moved + math.hypot(dx, dy), turned + abs(dth), t


def due(state: tuple, t: float, min_translation: float, min_rotation: float, period: float) -> bool:
    """Whether a scan makes a pose: enough turn, enough way, or some of both and a long time since."""
    _, _, _, moved, turned, last = state
    return turned > min_rotation or moved > min_translation or (moved > 0 and turned > 0 and t - last > period)


class ScanPoses(StatefulProcessor):
    def __init__(self, min_translation: float, min_rotation: float, period: float):
        self.gate = (min_translation, min_rotation, period)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("motion", _MOTION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0.0,) * 6
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            state = accumulate(state, e.dx, e.dy, e.dth)
            if due(state, e.t, *self.gate):
                out.append((key[0], int(e.seq), *state[:3]))
                state = (0.0, 0.0, 0.0, 0.0, 0.0, float(e.t))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["robot_id", "seq", "dx", "dy", "dth"])

    def close(self) -> None:
        pass


def scan_poses(odometry: DataFrame, min_translation: float, min_rotation: float, period: float) -> DataFrame:
    """A stream (robot_id, seq, t, dx, dy, dth) into the motions between poses."""
    return odometry.groupBy("robot_id").transformWithStateInPandas(ScanPoses(min_translation, min_rotation, period), SCAN_POSES, "Append", "None")


def windowed(events: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """An extension: counts and sums per window and key, under a watermark; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
