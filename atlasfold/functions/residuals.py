"""Residuals of pose and point constraints as column expressions; sums and means over groups are the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import c, dot, relative_pose, rotate, wrap

#: Fixed value: what a point in front of a wall costs at most, in metres.
MAX_OBSTACLE = 0.5


def cumulative_pose(x, y, th, tx, ty, tth, sd_radial, sd_tangential, sd_angular) -> tuple[Column, Column, Column]:
    """A summed relative pose against its target, each component by its deviation; the angle isn't wrapped."""
    return (c(x) - c(tx)) / c(sd_radial), (c(y) - c(ty)) / c(sd_tangential), (c(th) - c(tth)) / c(sd_angular)


def point_to_line(wx, wy, nx, ny, offset, sd, factor=1.0) -> Column:
    return (dot(wx, wy, nx, ny) + c(offset)) / c(sd) * c(factor)


def obstacle(wx, wy, rx, ry, nx, ny, offset, sd, factor=1.0) -> Column:
    """Point to line; in front of the wall, beyond half a metre, a constant."""
    point, robot = dot(wx, wy, nx, ny) + c(offset), dot(rx, ry, nx, ny) + c(offset)
    far = (robot * point > 0) & (F.abs(point) >= MAX_OBSTACLE)
    return F.when(far, F.lit(MAX_OBSTACLE)).otherwise(point) / c(sd) * c(factor)


def visibility(wx, wy, rx, ry, x0, y0, x1, y1, nx, ny, offset, sd, factor=1.0) -> Column:
    """Only where the robot sees through the segment: zero beside it or in front of it."""
    wx, wy, x0, y0, x1, y1 = map(c, (wx, wy, x0, y0, x1, y1))
    beside = dot(x0 - wx, y0 - wy, x1 - wx, y1 - wy) > 0
    point, robot = dot(wx, wy, nx, ny) + c(offset), dot(rx, ry, nx, ny) + c(offset)
    return F.when(beside | (robot * point > 0), F.lit(0.0)).otherwise(point * c(factor) / c(sd))


def point_to_point(ax, ay, bx, by, nx, ny, sd, factor=1.0) -> Column:
    """Along the second point's normal."""
    return dot(nx, ny, c(ax) - c(bx), c(ay) - c(by)) * c(factor) / c(sd)


def pose_edge(x0, y0, th0, x1, y1, th1, radial, direction, rotation, sd_r, sd_t, sd_a) -> tuple[Column, Column, Column]:
    """An odometry edge: radial, tangential and angular error of pose 1 seen from pose 0."""
    dx, dy, dth = relative_pose(x0, y0, th0, x1, y1, th1)
    d = c(direction)
    along, across = F.cos(d) * dx + F.sin(d) * dy, F.cos(d) * dy - F.sin(d) * dx
    return (along - c(radial)) / c(sd_r), across / c(sd_t), wrap(dth - c(rotation)) / c(sd_a)


def anchor(x, y, x0, y0, sd) -> tuple[Column, Column]:
    return (c(x) - c(x0)) / c(sd), (c(y) - c(y0)) / c(sd)


def colocation(x, y, th, tx, ty, tth) -> tuple[Column, Column, Column]:
    return c(tx) - c(x), c(ty) - c(y), wrap(c(tth) - c(th))


def collinear(x, y, th, tx, ty, tth, penalty) -> tuple[Column, Column]:
    return F.cos(c(penalty)) * (c(tx) - c(x)) + F.sin(c(penalty)) * (c(ty) - c(y)), wrap(c(tth) - c(th))


def orientation(th, tth) -> Column:
    """Perpendicular and parallel constraints: the target angle only."""
    return wrap(c(tth) - c(th))


def relative_pose_residual(dx, dy, dth, radial, direction, rotation, sd_r, sd_t, sd_a) -> tuple[Column, Column, Column]:
    """An edge given as relative motion already; the rotation's error isn't wrapped."""
    d = c(direction)
    along, across = F.cos(d) * c(dx) + F.sin(d) * c(dy), F.cos(d) * c(dy) - F.sin(d) * c(dx)
    return (along - c(radial)) / c(sd_r), across / c(sd_t), (c(dth) - c(rotation)) / c(sd_a)


def sum_of_squares(x) -> Column:
    """An aggregate: the global point-to-line constraints."""
    return F.sum(c(x) * c(x))


def root_sum(x) -> Column:
    return F.sqrt(F.sum(c(x) * c(x)))


def root_mean(x) -> Column:
    return F.sqrt(F.avg(c(x) * c(x)))


def point_to_object(wx, wy, ox, oy, oth, nx, ny, offset, sd, factor=1.0) -> Column:
    """A world point against a line in the frame of an object's pose."""
    lx, ly = rotate(c(wx) - c(ox), c(wy) - c(oy), -c(oth))
    return point_to_line(lx, ly, nx, ny, offset, sd, factor)
