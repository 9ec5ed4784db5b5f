"""Plane geometry as column expressions: everything stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


# angles


def wrap(a) -> Column:
    """Into [-pi, pi], by atan2."""
    return F.atan2(F.sin(c(a)), F.cos(c(a)))


def angle_mod(a) -> Column:
    return c(a) - F.lit(TAU) * F.rint(c(a) / F.lit(TAU))


def angle_pos(a) -> Column:
    return F.pmod(c(a), F.lit(TAU))


def angle_diff(a, b) -> Column:
    return angle_mod(c(a) - c(b))


def angle_dist(a, b) -> Column:
    return F.abs(angle_diff(a, b))


def average_angle(*angles) -> Column:
    return F.atan2(sum((F.sin(c(a)) for a in angles), F.lit(0.0)), sum((F.cos(c(a)) for a in angles), F.lit(0.0)))


# vectors


def rotate(x, y, a) -> tuple[Column, Column]:
    x, y, a = c(x), c(y), c(a)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def to_world(px, py, x, y, th) -> tuple[Column, Column]:
    rx, ry = rotate(px, py, th)
    return c(x) + rx, c(y) + ry


def to_robot(wx, wy, x, y, th) -> tuple[Column, Column]:
    return rotate(c(wx) - c(x), c(wy) - c(y), -c(th))


def relative_pose(x0, y0, th0, x1, y1, th1) -> tuple[Column, Column, Column]:
    """Pose 1 seen from pose 0."""
    dx, dy = to_robot(x1, y1, x0, y0, th0)
    return dx, dy, wrap(c(th1) - c(th0))


def dot(ax, ay, bx, by) -> Column:
    return c(ax) * c(bx) + c(ay) * c(by)


def cross(ax, ay, bx, by) -> Column:
    return c(ax) * c(by) - c(ay) * c(bx)


def length(x, y) -> Column:
    return F.sqrt(c(x) * c(x) + c(y) * c(y))


def unit(x, y) -> tuple[Column, Column]:
    n = F.nullif(length(x, y), F.lit(0.0))
    return c(x) / n, c(y) / n


def perpendicular(x, y) -> tuple[Column, Column]:
    return -c(y), c(x)


def signed_angle(ax, ay, bx, by) -> Column:
    """From direction A to direction B."""
    return F.atan2(cross(ax, ay, bx, by), dot(ax, ay, bx, by))


# lines and segments


def along(px, py, x0, y0, x1, y1) -> Column:
    """Where the foot of the point lies, in lengths of the segment; null for a degenerate one."""
    px, py, x0, y0, x1, y1 = map(c, (px, py, x0, y0, x1, y1))
    dx, dy = x1 - x0, y1 - y0
    return ((px - x0) * dx + (py - y0) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(c(x), c(low)), c(high))


def segment_distance(px, py, x0, y0, x1, y1) -> Column:
    """To the nearest point of the segment; of a degenerate segment, to its point."""
    t = clamp(F.coalesce(along(px, py, x0, y0, x1, y1), F.lit(0.0)), 0.0, 1.0)
    x0, y0, x1, y1 = map(c, (x0, y0, x1, y1))
    return length(c(px) - (x0 + t * (x1 - x0)), c(py) - (y0 + t * (y1 - y0)))


def segment_distance_compat(px, py, x0, y0, x1, y1) -> Column:
    """The variant that holds the foot in metres against 1: beyond it the distance is to the far end."""
    px, py, x0, y0, x1, y1 = map(c, (px, py, x0, y0, x1, y1))
    ux, uy = unit(x1 - x0, y1 - y0)
    t = dot(px - x0, py - y0, ux, uy)
    foot = F.abs(cross(ux, uy, px - x0, py - y0))
    return F.when(t < 0, length(px - x0, py - y0)).when(t > 1, length(px - x1, py - y1)).otherwise(foot)


def line_offset(px, py, x0, y0, x1, y1) -> Column:
    """Signed distance from the line through the ends, positive on its left."""
    ux, uy = unit(c(x1) - c(x0), c(y1) - c(y0))
    return cross(ux, uy, c(px) - c(x0), c(py) - c(y0))


def intersection(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> tuple[Column, Column, Column]:
    """Where two lines meet, and whether both segments hold that point; null if parallel."""
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(c, (ax0, ay0, ax1, ay1, bx0, by0, bx1, by1))
    d = F.nullif(cross(ax1 - ax0, ay1 - ay0, bx1 - bx0, by1 - by0), F.lit(0.0))
    t = cross(bx0 - ax0, by0 - ay0, bx1 - bx0, by1 - by0) / d
    u = cross(bx0 - ax0, by0 - ay0, ax1 - ax0, ay1 - ay0) / d
    return ax0 + t * (ax1 - ax0), ay0 + t * (ay1 - ay0), F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))


def vertex_angle(ax, ay, bx, by, cx, cy) -> Column:
    """The angle at b, in [0, pi]."""
    ux, uy, vx, vy = c(ax) - c(bx), c(ay) - c(by), c(cx) - c(bx), c(cy) - c(by)
    return F.abs(signed_angle(ux, uy, vx, vy))


def circle(ax, ay, bx, by, cx, cy) -> tuple[Column, Column, Column]:
    """Centre and radius through three points; null if they lie on a line."""
    ax, ay, bx, by, cx, cy = map(c, (ax, ay, bx, by, cx, cy))
    d = F.nullif(2 * cross(bx - ax, by - ay, cx - ax, cy - ay), F.lit(0.0))
    b2, c2 = dot(bx - ax, by - ay, bx - ax, by - ay), dot(cx - ax, cy - ay, cx - ax, cy - ay)
    ux, uy = ((cy - ay) * b2 - (by - ay) * c2) / d, ((bx - ax) * c2 - (cx - ax) * b2) / d
    return ax + ux, ay + uy, length(ux, uy)


def ray_sphere(ox, oy, oz, dx, dy, dz, radius) -> Column:
    """First distance along a unit ray to a sphere about the origin; null if it misses."""
    ox, oy, oz, dx, dy, dz, r = map(c, (ox, oy, oz, dx, dy, dz, radius))
    b = ox * dx + oy * dy + oz * dz
    q = b * b - (ox * ox + oy * oy + oz * oz - r * r)
    near, far = -b - F.sqrt(q), -b + F.sqrt(q)
    return F.when(q >= 0, F.when(near >= 0, near).when(far >= 0, far))


def ray_plane(ox, oy, oz, dx, dy, dz, nx, ny, nz, offset) -> Column:
    """Distance along a ray to the plane n.p = offset; null if parallel."""
    ox, oy, oz, dx, dy, dz, nx, ny, nz = map(c, (ox, oy, oz, dx, dy, dz, nx, ny, nz))
    return (c(offset) - (ox * nx + oy * ny + oz * nz)) / F.nullif(dx * nx + dy * ny + dz * nz, F.lit(0.0))


def tangent_points(px, py, cx, cy, r) -> tuple[Column, Column, Column, Column]:
    """The two points where tangents from p touch a circle; null inside it."""
    dx, dy = c(px) - c(cx), c(py) - c(cy)
    d2, r = dot(dx, dy, dx, dy), c(r)
    h = F.when(d2 >= r * r, r * F.sqrt(d2 - r * r) / d2)
    a = r * r / d2
    return c(cx) + a * dx - h * dy, c(cy) + a * dy + h * dx, c(cx) + a * dx + h * dy, c(cy) + a * dy - h * dx


# scalars


def sign_nz(x) -> Column:
    return F.when(c(x) >= 0, F.lit(1)).otherwise(F.lit(-1))


def ramp(x, low, high) -> Column:
    """0 at low, 1 at high, linear between."""
    return clamp((c(x) - c(low)) / (c(high) - c(low)), 0.0, 1.0)


def abs_bound(x, most) -> Column:
    return clamp(x, -c(most), c(most))


def gcd(a: str, b: str) -> Column:
    """By Euclid over a bounded sequence: 93 steps do for longs."""
    start = F.struct(F.abs(F.col(a).cast("long")).alias("a"), F.abs(F.col(b).cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["a"]


def lcm(a: str, b: str) -> Column:
    return F.abs(F.call_function("div", F.col(a).cast("long"), F.nullif(gcd(a, b), F.lit(0).cast("long"))) * F.col(b).cast("long"))


def abs_max(a, b) -> Column:
    """Of two values the one of the larger magnitude; the second of equals."""
    return F.when(F.abs(c(a)) > F.abs(c(b)), c(a)).otherwise(c(b))


def abs_min(a, b) -> Column:
    return F.when(F.abs(c(a)) < F.abs(c(b)), c(a)).otherwise(c(b))


def max_idx(values: Column) -> Column:
    """Where, from 0, an array's first largest value is."""
    return F.array_position(values, F.array_max(values)) - 1


def min_idx(values: Column) -> Column:
    return F.array_position(values, F.array_min(values)) - 1


def take_min(base, value) -> tuple[Column, Column]:
    """The lesser of both, and whether it is the value."""
    return F.least(c(base), c(value)), c(value) < c(base)


def take_max(base, value) -> tuple[Column, Column]:
    return F.greatest(c(base), c(value)), c(value) > c(base)


def median3(a, b, x) -> Column:
    """The middle of three in order."""
    return F.get(F.array_sort(F.array(c(a), c(b), c(x))), F.lit(1))


def cube(x) -> Column:
    return c(x) * c(x) * c(x)


def sign_eq(a, b) -> Column:
    """Whether two values don't differ in sign; zero goes with either."""
    return c(a) * c(b) >= 0


def toggled(flag) -> Column:
    return ~c(flag)


def floor_mod(x, m) -> Column:
    """What is left of x over the next lower multiple of m."""
    return c(x) - F.floor(c(x) / c(m)) * c(m)


def one_bit_set(x) -> Column:
    return F.bit_count(c(x)) == 1


def all_bits_set(x, mask: int) -> Column:
    return c(x).bitwiseAND(F.lit(mask)) == mask


def any_bits_set(x, mask: int) -> Column:
    return c(x).bitwiseAND(F.lit(mask)) != 0


def find_item(values: Column, item) -> Column:
    """Where, from 0, the item first is; the array's size without it."""
    at = F.array_position(values, c(item)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(values))


def set_range(values: Column, start: int, n: int, value) -> Column:
    """The array with ``n`` places from ``start`` set to a value."""
    return F.transform(values, lambda x, i: F.when((i >= start) & (i < start + n), c(value)).otherwise(x))


def saturating_count(flags: Column, least: int, most: int) -> Column:
    """A counter that true raises and false lowers, held in bounds, over an array of booleans."""
    return F.aggregate(flags, F.lit(least), lambda s, f: F.least(F.greatest(s + F.when(f, 1).otherwise(-1), F.lit(least)), F.lit(most)))


def cubic(p0, p1, p2, p3, t) -> Column:
    """Keys interpolation between p1 and p2 at t in [0, 1]."""
    p0, p1, p2, p3, t = map(c, (p0, p1, p2, p3, t))
    return p1 + 0.5 * t * (p2 - p0 + t * (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3 + t * (3.0 * (p1 - p2) + p3 - p0)))


def modifier_type(modifiers) -> Column:
    """Correction type of a key mask: fixed bits Alt 1, Ctrl 2, Shift 4; their sum is the type."""
    return (F.col(modifiers) if isinstance(modifiers, str) else modifiers).bitwiseAND(7).cast("int")


def argb(colour) -> tuple[Column, Column, Column, Column]:
    v = F.col(colour) if isinstance(colour, str) else colour
    return tuple(F.shiftright(v, s).bitwiseAND(255) for s in (24, 16, 8, 0))


def ellipse(a, b, d, chi2: float) -> tuple[Column, Column, Column]:
    """Half axes and direction of the confidence ellipse of covariance [[a, b], [b, d]]."""
    a, b, d = c(a), c(b), c(d)
    mid, off = (a + d) / 2, F.sqrt(((a - d) / 2) * ((a - d) / 2) + b * b)
    return F.sqrt(F.lit(chi2) * (mid + off)), F.sqrt(F.lit(chi2) * F.greatest(mid - off, F.lit(0.0))), 0.5 * F.atan2(2 * b, a - d)


def quaternion_yaw(w, z) -> Column:
    return 2 * F.atan2(c(z), c(w))


# more of segments and vectors


def project_in(x, y, ux, uy) -> tuple[Column, Column]:
    """Into the frame of a unit direction: along and across it."""
    return dot(x, y, ux, uy), cross(ux, uy, x, y)


def project_out(u, v, ux, uy) -> tuple[Column, Column]:
    return c(u) * c(ux) - c(v) * c(uy), c(u) * c(uy) + c(v) * c(ux)


def bounded_length(x, y, most) -> tuple[Column, Column]:
    """The vector, shortened to ``most``."""
    n = length(x, y)
    k = F.when(n > c(most), c(most) / n).otherwise(F.lit(1.0))
    return c(x) * k, c(y) * k


def point_on_segment(px, py, x0, y0, x1, y1) -> tuple[Column, Column]:
    """The segment's point nearest to p."""
    t = clamp(F.coalesce(along(px, py, x0, y0, x1, y1), F.lit(0.0)), 0.0, 1.0)
    return c(x0) + t * (c(x1) - c(x0)), c(y0) + t * (c(y1) - c(y0))


def segments_distance(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Between two segments: 0 where they meet, else the least distance of an end to the other."""
    _, _, meet = intersection(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1)
    ends = [segment_distance(ax0, ay0, bx0, by0, bx1, by1), segment_distance(ax1, ay1, bx0, by0, bx1, by1), segment_distance(bx0, by0, ax0, ay0, ax1, ay1), segment_distance(bx1, by1, ax0, ay0, ax1, ay1)]
    return F.when(meet, F.lit(0.0)).otherwise(F.least(*ends))


def closest_time(px, py, vx, vy, qx, qy, wx, wy) -> Column:
    """When two points in even motion are nearest, not before 0; 0 if their velocities are equal."""
    dx, dy, ux, uy = c(px) - c(qx), c(py) - c(qy), c(vx) - c(wx), c(vy) - c(wy)
    return F.greatest(F.coalesce(-dot(dx, dy, ux, uy) / F.nullif(dot(ux, uy, ux, uy), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def cross3(a, b) -> tuple[Column, Column, Column]:
    a, b = [c(x) for x in a], [c(x) for x in b]
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot3(a, b) -> Column:
    return sum((c(x) * c(y) for x, y in zip(a[1:], b[1:], strict=True)), c(a[0]) * c(b[0]))


def rotate3(v, axis: int, angle) -> tuple[Column, Column, Column]:
    """About x, y or z (axis 0, 1, 2)."""
    v = [c(x) for x in v]
    i, j = (axis + 1) % 3, (axis + 2) % 3
    out = list(v)
    out[i], out[j] = rotate(v[i], v[j], angle)
    return tuple(out)


# covariances


def rotate_covariance(cov, th) -> Column:
    """T C T' of a row-major 3x3 array for T the turn of the first two axes by th."""
    s, k = F.sin(c(th)), F.cos(c(th))
    zero, one = F.lit(0.0), F.lit(1.0)
    t = [[k, -s, zero], [s, k, zero], [zero, zero, one]]
    m = [[F.get(c(cov), F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    left = [[sum((t[i][q] * m[q][j] for q in (1, 2)), t[i][0] * m[0][j]) for j in range(3)] for i in range(3)]
    return F.array(*[sum((left[i][q] * t[j][q] for q in (1, 2)), left[i][0] * t[j][0]) for i in range(3) for j in range(3)])


def motion_covariance(dx, dy, sd_radial, sd_tangential) -> tuple[Column, Column, Column]:
    """xx, xy, yy of a motion's covariance from its radial and tangential deviations; isotropic radial for no motion."""
    n = F.nullif(length(dx, dy), F.lit(0.0))
    ux, uy = F.coalesce(c(dx) / n, F.lit(1.0)), F.coalesce(c(dy) / n, F.lit(0.0))
    r, t = c(sd_radial) * c(sd_radial), c(sd_tangential) * c(sd_tangential)
    return r * ux * ux + t * uy * uy, (r - t) * ux * uy, r * uy * uy + t * ux * ux


def encoder_noise(dx, dy, dth, rate, seed: int, radius: float = 0.2) -> tuple[Column, Column, Column]:
    """Robot-frame motion as four wheels at 45 degrees see it, each speed off by a normal share ``rate``."""
    root = math.sqrt(0.5)
    signs = [(-root, root), (-root, -root), (root, -root), (root, root)]
    wheels = [(a * c(dx) + b * c(dy) + radius * c(dth)) * (1 + F.lit(rate) * F.randn(seed + i)) for i, (a, b) in enumerate(signs)]
    w = wheels
    return (
        (w[2] + w[3] - w[0] - w[1]) / (4 * root),
        (w[0] + w[3] - w[1] - w[2]) / (4 * root),
        (w[0] + w[1] + w[2] + w[3]) / (4 * radius),
    )


def screen_to_world(px, py, width, height, scale, x_offset=0.0, y_offset=0.0, robot=(0.0, 0.0)) -> tuple[Column, Column]:
    """Where a pixel of a view lies in the world: pixels run down from the upper left, the view's middle is at its offsets (plus the robot it follows)."""
    return (c(px) - 0.5 * c(width)) * c(scale) + c(x_offset) + c(robot[0]), -(c(py) - 0.5 * c(height)) * c(scale) + c(y_offset) + c(robot[1])
