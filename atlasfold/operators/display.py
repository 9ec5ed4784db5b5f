"""Shaping what a map view draws: primitives, the latest message of each publisher, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trajectory_lines(poses: DataFrame) -> DataFrame:
    """(graph_id, pose_id, kind, x0, y0, x1, y1): an edge to the next pose and the three strokes of an arrow; the last pose has none."""
    w = Window.partitionBy("graph_id").orderBy("pose_id")
    p = poses.select("graph_id", "pose_id", "x", "y", "th", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    tip = F.col("x") + 0.3 * F.cos("th"), F.col("y") + 0.3 * F.sin("th")

    def line(kind, a, b):
        return F.struct(F.lit(kind).alias("kind"), a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))

    barb = lambda turn: (tip[0] + 0.1 * F.cos(F.col("th") + turn), tip[1] + 0.1 * F.sin(F.col("th") + turn))
    here = F.col("x"), F.col("y")
    lines = F.array(line("edge", here, (F.col("x2"), F.col("y2"))), line("shaft", here, tip), line("barb", tip, barb(2.5)), line("barb", tip, barb(-2.5)))
    return p.select("graph_id", "pose_id", F.explode(lines).alias("l")).select("graph_id", "pose_id", "l.*")


def primitives(message: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """Rows of a struct-of-arrays message, cut to the shortest array; ``arrays``: output name by array column."""
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(next(iter(arrays)))
    keep = [c for c in message.columns if c not in arrays]
    zipped = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(*[F.element_at(a, i).alias(o) for a, o in arrays.items()]))
    return message.where(n > 0).select(*keep, F.inline(zipped))


def latest(messages: DataFrame, publisher: str, order: list[str], take: list[str]) -> DataFrame:
    """The last message of each publisher: a mergeable maximum."""
    return messages.groupBy(publisher).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_m")).select(publisher, *[F.col(f"_m.{c}").alias(c) for c in take])


def adjacency(odometry: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """(graph_id, i, j) both ways of every odometry edge, and of every constraint (graph_id, anchor_id, constrained_id)."""
    links = odometry.select("graph_id", (F.col("pose_id") - 1).alias("i"), F.col("pose_id").alias("j")).where("i >= 0")
    if constraints is not None:
        links = links.unionByName(constraints.select("graph_id", F.col("anchor_id").alias("i"), F.col("constrained_id").alias("j")))
    return links.unionByName(links.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


#: How far out a drawn rectangle may reach, how long a message is shown, and the most pictures a second.
FAR, TIMEOUT, MAX_FPS = 1e6, 1.0, 60.0


def drawn_rectangle(x0, y0, x1, y1) -> tuple[Column, Column, Column, Column]:
    """A rectangle's lower left and upper right, the one no lower and the other no higher than FAR."""
    low, high = (lambda v: F.greatest(F.col(v), F.lit(-FAR))), (lambda v: F.least(F.col(v), F.lit(FAR)))
    return low(x0), low(y0), high(x1), high(y1)


def compiled(messages: DataFrame, now, publisher: str, order: list[str], at: str, take: list[str], timeout: float = TIMEOUT, persistent: str | None = None) -> DataFrame:
    """What is shown at ``now``: the latest message of each publisher, unless it is ``timeout`` seconds old or older; ``persistent`` ones stay."""
    kept = [at, *take] + ([persistent] if persistent else [])
    shown = latest(messages.where(F.col(at) <= now), publisher, order, list(dict.fromkeys(kept)))
    fresh = F.unix_micros(now) - F.unix_micros(at) < timeout * 1e6
    return shown.where(fresh | F.col(persistent) if persistent else fresh).select(publisher, *take)


def throttled(messages: DataFrame, at: str, by: list[str], fps: float = MAX_FPS) -> DataFrame:
    """The first message of every picture's slot of time, by ``by``: at most ``fps`` a second."""
    slot = F.floor(F.unix_micros(at) * fps / 1e6)
    others = [k for k in messages.columns if k not in by]
    first = messages.groupBy(*by, slot.alias("_slot")).agg(F.min(F.struct(at, *[k for k in others if k != at])).alias("_m"))
    return first.select(*by, *[F.col(f"_m.{k}").alias(k) for k in others]).select(*messages.columns)
