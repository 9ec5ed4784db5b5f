"""Seeded draws as column expressions: a counter-based generator, keyed by a row's own columns.

A draw is a function of the seed and the keys alone, so it is the same under any partitioning, order and
retry of a task, and any engine with MD5 gives it too. Keys are to name a row; rows of equal keys draw alike.
A null key counts as an empty text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import c, ellipse

#: Hexadecimal digits of one draw: three draws of 40 bits from a digest.
DIGITS = 10


def named(seed, *keys) -> Column:
    """The text that a draw is a digest of. It may be the seed of draws by further keys, so that it is spelt once for them all."""
    texts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.concat_ws(",", seed if isinstance(seed, Column) else F.lit(str(seed)), *texts)


def uniforms(seed, *keys) -> tuple[Column, Column, Column]:
    """Three independent draws from [0, 1), from one digest."""
    digest = F.md5(named(seed, *keys))
    return tuple(F.conv(F.substring(digest, 1 + i * DIGITS, DIGITS), 16, 10).cast("long") / float(1 << 4 * DIGITS) for i in range(3))


def uniform(seed: int, *keys) -> Column:
    return uniforms(seed, *keys)[0]


def between(low, high, seed: int, *keys) -> Column:
    """Evenly from [low, high)."""
    return c(low) + (c(high) - c(low)) * uniform(seed, *keys)


def normals(seed, *keys) -> tuple[Column, Column]:
    """Two independent standard normal draws, as the polar parts of one point."""
    u, v, _ = uniforms(seed, *keys)
    radius = F.sqrt(-2 * F.log(1 - u))
    return radius * F.cos(2 * math.pi * v), radius * F.sin(2 * math.pi * v)


def normal(mean, sd, seed: int, *keys) -> Column:
    return c(mean) + c(sd) * normals(seed, *keys)[0]


def multivariate_normal(mean, cov, seed: int, *keys) -> tuple[Column, Column]:
    """(x, y) with the given mean (x, y) and covariance (xx, xy, yy): normal draws along the axes of its ellipse."""
    major, minor, angle = ellipse(*cov, 1.0)
    a, b = normals(seed, *keys)
    u, v = a * major, b * minor
    return c(mean[0]) + u * F.cos(angle) - v * F.sin(angle), c(mean[1]) + u * F.sin(angle) + v * F.cos(angle)
