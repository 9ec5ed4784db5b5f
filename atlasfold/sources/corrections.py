"""Correction logs: an entry count, then ``type, undone`` and its points, two numbers a line."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEGACY_PARALLEL, LOG, LOG_POINTS, Correction


def parse_log(text: str, version: int = 2) -> list[tuple[int, int, bool, list[tuple[float, float]]]]:
    """Entries (id, type, undone, points). ``version`` 1 has two more header lines; 7 is read as parallel in either."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines:
        return []
    n = int(float(lines[0].split(",")[0])) if version == 2 else None
    at = 1 if version == 2 else 3
    out = []
    while at < len(lines) and (n is None or len(out) < n):
        kind, undone = (int(float(x)) for x in lines[at].split(",")[:2])
        kind = int(Correction.PARALLEL) if kind == LEGACY_PARALLEL else kind
        if kind not in LOG_POINTS:
            raise ValueError(f"line {at + 1}: no correction has type {kind}")
        take = LOG_POINTS[kind]
        if at + take >= len(lines):
            raise ValueError(f"line {at + 1}: {take} points should follow")
        points = [tuple(float(v) for v in x.split(",")[:2]) for x in lines[at + 1 : at + 1 + take]]
        out.append((len(out), kind, bool(undone), points))
        at += 1 + take
    if n is not None and len(out) < n:
        raise ValueError(f"the log has {len(out)} of {n} entries")
    return out


def read_log(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """A session's log as rows; a log is as long as a person's session, so the driver parses it."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    return spark.createDataFrame([(i, k, u, [{"x": x, "y": y} for x, y in p]) for i, k, u, p in parse_log(row.value, version)], LOG)


def format_log(entries: Iterable[tuple[int, int, bool, list[tuple[float, float]]]]) -> str:
    entries = list(entries)
    lines = [str(len(entries))]
    for _, kind, undone, points in entries:
        lines.append(f"{kind}, {int(undone)}")
        lines += [f"{x:.4f}, {y:.4f}" for x, y in points]
    return "\n".join(lines) + "\n"


def write_log(spark: SparkSession, entries, path: str) -> None:
    spark.createDataFrame([(format_log(entries).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: A drawing file: for lines, points and circles in turn, a count, coordinates (4, 2, 3 floats each) and colours.
PRIMITIVES = (("line", 4), ("point", 2), ("circle", 3))


def read_drawing(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, k, c0..c3, colour) of binary drawings; coordinates are little-endian floats, colours 32 bits."""

    def run(frames):
        for frame in frames:
            out = []
            for path, data in zip(frame.path, frame.content, strict=True):
                at = 0
                for kind, width in PRIMITIVES:
                    (n,) = struct.unpack_from("<I", data, at)
                    at += 4
                    xs = struct.unpack_from(f"<{n * width}f", data, at)
                    at += 4 * n * width
                    colours = struct.unpack_from(f"<{n}I", data, at)
                    at += 4 * n
                    for k in range(n):
                        own = xs[k * width : (k + 1) * width]
                        out.append((path, kind, k, *own, *[None] * (4 - width), colours[k]))
            yield pd.DataFrame(out, columns=["path", "kind", "k", "c0", "c1", "c2", "c3", "colour"]).astype({"c2": "Float64", "c3": "Float64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, kind string, k int, c0 double, c1 double, c2 double, c3 double, colour long")


def drawing_bytes(rows: Iterable[tuple[str, list[float], int]]) -> bytes:
    """(kind, coordinates, colour) rows in the file's form."""
    rows = list(rows)
    out = b""
    for kind, width in PRIMITIVES:
        own = [r for r in rows if r[0] == kind]
        out += struct.pack("<I", len(own)) + b"".join(struct.pack(f"<{width}f", *r[1]) for r in own) + b"".join(struct.pack("<I", r[2]) for r in own)
    return out


def read_messages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Exported messages of one kind, JSON lines under its declared schema."""
    from ..schema import MESSAGES

    return spark.read.schema(MESSAGES[kind]).json(path)


def start_at(messages: DataFrame, start: DataFrame) -> DataFrame:
    """Messages (t, …) from the first set-location message (t, x, y, angle) on, in its frame's start pose."""
    first = start.agg(F.min_by(F.struct("t", "x", "y", "angle"), "t").alias("s"))
    return messages.join(F.broadcast(first), F.col("t") >= F.col("s.t")).select(messages["*"], F.col("s.x").alias("x0"), F.col("s.y").alias("y0"), F.col("s.angle").alias("th0"))
