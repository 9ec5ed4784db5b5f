"""Residuals by name, for one solver: each is a function of one or two poses and its rows' data, written once for values and derivatives.

A residual takes poses as (x, y, th) and a mapping of its data columns, and returns its components. Given duals
(``duals``) it returns derivatives too, so nothing is derived by hand. ``register`` adds one of the user's own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np

from . import duals
from .duals import rotate, value, where, wrap

#: Fixed value: what a point in front of a wall costs at most, in metres.
MAX_OBSTACLE = 0.5


@dataclass(frozen=True)
class Residual:
    """``poses`` unknown poses (1 or 2), the data columns that a row must have, and the function."""

    name: str
    poses: int
    columns: tuple[str, ...]
    function: Callable


REGISTRY: dict[str, Residual] = {}


def register(poses: int, columns: str) -> Callable:
    """Adds a residual under its function's name."""

    def add(function: Callable) -> Callable:
        REGISTRY[function.__name__] = Residual(function.__name__, poses, tuple(columns.split()), function)
        return function

    return add


def evaluate(residual: Residual, first: np.ndarray, second: np.ndarray | None, data: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Components (m, n) and their derivatives (m, 3 * poses, n) at poses (n, 3)."""
    k = 3 * residual.poses
    args = [duals.unknowns(first, 0, k)] + ([duals.unknowns(second, 3, k)] if residual.poses == 2 else [])
    found = residual.function(*args, data)
    n = len(first)
    values = np.stack([np.broadcast_to(value(x), (n,)) for x in found])
    slopes = np.stack([x.d if isinstance(x, duals.Dual) else np.zeros((k, n)) for x in found])
    return values, slopes


def values(residual: Residual, first: np.ndarray, second: np.ndarray | None, data: Mapping[str, np.ndarray]) -> np.ndarray:
    """The components alone."""
    args = [list(first.T)] + ([list(second.T)] if residual.poses == 2 else [])
    return np.stack([np.broadcast_to(x, (len(first),)) for x in residual.function(*args, data)])


def _seen(pose, d):
    """The row's point (px, py) in the world."""
    rx, ry = rotate(d["px"], d["py"], pose[2])
    return pose[0] + rx, pose[1] + ry


def _off(x, y, d):
    return x * d["nx"] + y * d["ny"] + d["offset"]


@register(2, "radial direction rotation sd_radial sd_tangential sd_angular")
def pose_edge(a, b, d):
    """Motion from the first pose to the second, in the first one's frame, against what was measured."""
    dx, dy = rotate(b[0] - a[0], b[1] - a[1], -a[2])
    c, s = np.cos(d["direction"]), np.sin(d["direction"])
    return (dx * c + dy * s - d["radial"]) / d["sd_radial"], (dy * c - dx * s) / d["sd_tangential"], wrap(b[2] - a[2] - d["rotation"]) / d["sd_angular"]


@register(1, "tx ty tth")
def colocation(a, d):
    return -a[0] + d["tx"], -a[1] + d["ty"], wrap(-a[2] + d["tth"])


@register(1, "tx ty tth penalty")
def collinear(a, d):
    return (-a[0] + d["tx"]) * np.cos(d["penalty"]) + (-a[1] + d["ty"]) * np.sin(d["penalty"]), wrap(-a[2] + d["tth"])


@register(1, "tth")
def orientation(a, d):
    """Perpendicular and parallel constraints: the target angle only."""
    return (wrap(-a[2] + d["tth"]),)


@register(1, "tx ty sd")
def anchor(a, d):
    return (a[0] - d["tx"]) / d["sd"], (a[1] - d["ty"]) / d["sd"]


@register(1, "px py nx ny offset sd factor")
def point_to_line(a, d):
    return (_off(*_seen(a, d), d) * d["factor"] / d["sd"],)


@register(1, "px py nx ny offset sd factor")
def obstacle(a, d):
    """Point to line; in front of the wall, beyond half a metre, a constant."""
    point, robot = _off(*_seen(a, d), d), _off(a[0], a[1], d)
    far = (value(point) * value(robot) > 0) & (np.abs(value(point)) >= MAX_OBSTACLE)
    return (where(far, np.full(far.shape, MAX_OBSTACLE), point) * d["factor"] / d["sd"],)


@register(1, "px py nx ny offset x0 y0 x1 y1 sd factor")
def visibility(a, d):
    """Only where the robot sees through the segment: zero beside it or in front of it."""
    x, y = _seen(a, d)
    u, v = value(x), value(y)
    beside = (d["x0"] - u) * (d["x1"] - u) + (d["y0"] - v) * (d["y1"] - v) > 0
    point, robot = _off(x, y, d), _off(a[0], a[1], d)
    return (where(beside | (value(point) * value(robot) > 0), np.zeros(beside.shape), point) * d["factor"] / d["sd"],)


@register(2, "px py nx ny offset sd factor")
def point_to_object(a, b, d):
    """A point seen from the first pose against a line in the frame of the second, an object's."""
    x, y = _seen(a, d)
    lx, ly = rotate(x - b[0], y - b[1], -b[2])
    return (_off(lx, ly, d) * d["factor"] / d["sd"],)


@register(2, "px py nx ny qx qy mx my sd factor")
def point_to_point(a, b, d):
    """A point and normal of either scan: the distance along the first's normal, then along the second's."""
    x, y = _seen(a, d)
    rx, ry = rotate(d["qx"], d["qy"], b[2])
    dx, dy = x - b[0] - rx, y - b[1] - ry
    n, m = rotate(d["nx"], d["ny"], a[2]), rotate(d["mx"], d["my"], b[2])
    return (dx * n[0] + dy * n[1]) * d["factor"] / d["sd"], (dx * m[0] + dy * m[1]) * d["factor"] / d["sd"]


@register(1, "tx ty tth sd_radial sd_tangential sd_angular")
def cumulative_pose(a, d):
    return (a[0] - d["tx"]) / d["sd_radial"], (a[1] - d["ty"]) / d["sd_tangential"], (a[2] - d["tth"]) / d["sd_angular"]
