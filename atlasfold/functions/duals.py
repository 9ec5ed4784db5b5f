"""Forward-mode dual numbers over numpy arrays: a value and its derivatives for many rows at once."""

from __future__ import annotations

import numpy as np


class Dual:
    """``v`` (n) and ``d`` (k, n): the derivatives by k unknowns."""

    __array_ufunc__ = None  # numpy arrays leave mixed arithmetic to this class
    __slots__ = ("d", "v")

    def __init__(self, v, d):
        self.v, self.d = v, d

    def __add__(self, o):
        return Dual(self.v + o.v, self.d + o.d) if isinstance(o, Dual) else Dual(self.v + o, self.d)

    __radd__ = __add__

    def __neg__(self):
        return Dual(-self.v, -self.d)

    def __sub__(self, o):
        return self + (-o)

    def __rsub__(self, o):
        return -self + o

    def __mul__(self, o):
        return Dual(self.v * o.v, self.d * o.v + o.d * self.v) if isinstance(o, Dual) else Dual(self.v * o, self.d * o)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return Dual(self.v / o.v, (self.d - o.d * (self.v / o.v)) / o.v) if isinstance(o, Dual) else Dual(self.v / o, self.d / o)

    def __rtruediv__(self, o):
        return Dual(o / self.v, -self.d * (o / (self.v * self.v)))


def unknowns(values: np.ndarray, first: int, of: int) -> list[Dual]:
    """The columns of ``values`` (n, m) as unknowns ``first``.. of ``of``."""
    n, m = values.shape
    out = []
    for k in range(m):
        d = np.zeros((of, n))
        d[first + k] = 1
        out.append(Dual(values[:, k].astype(float), d))
    return out


def value(x):
    return x.v if isinstance(x, Dual) else x


def sin(x):
    return Dual(np.sin(x.v), x.d * np.cos(x.v)) if isinstance(x, Dual) else np.sin(x)


def cos(x):
    return Dual(np.cos(x.v), -x.d * np.sin(x.v)) if isinstance(x, Dual) else np.cos(x)


def sqrt(x):
    """At zero the derivative is taken as zero."""
    if not isinstance(x, Dual):
        return np.sqrt(x)
    r = np.sqrt(x.v)
    return Dual(r, np.divide(x.d, 2 * r, out=np.zeros_like(x.d), where=r > 0))


def wrap(x):
    """Into [-pi, pi]; the derivative passes."""
    bare = lambda a: np.arctan2(np.sin(a), np.cos(a))
    return Dual(bare(x.v), x.d) if isinstance(x, Dual) else bare(x)


def where(test, x, y):
    if not isinstance(x, Dual) and not isinstance(y, Dual):
        return np.where(test, x, y)
    k = (x if isinstance(x, Dual) else y).d
    side = lambda s: (s.v, s.d) if isinstance(s, Dual) else (s, np.zeros_like(k))
    (xv, xd), (yv, yd) = side(x), side(y)
    return Dual(np.where(test, xv, yv), np.where(test, xd, yd))


def rotate(x, y, a):
    c, s = cos(a), sin(a)
    return x * c - y * s, x * s + y * c
