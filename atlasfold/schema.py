"""Types, the correction kinds and the configuration."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import types as T


class Correction(IntEnum):
    """The numbers that logs and modifier masks use."""

    UNKNOWN = 0
    POINT = 1
    SEGMENT = 2
    CORNER = 3
    COLLINEAR = 4
    PERPENDICULAR = 5
    PARALLEL = 6


#: Kinds that a correction may have, and the points each takes in a log.
VALID = (1, 2, 4, 5, 6)
LOG_POINTS = {1: 2, 2: 4, 3: 8, 4: 4, 5: 4, 6: 4}
#: An alias of PARALLEL in older logs.
LEGACY_PARALLEL = 7


@dataclass(frozen=True)
class Config:
    """Thresholds, in metres and radians; fixed values of the published configuration."""

    inlier: float = 0.03
    verify: float = 0.05
    min_inliers: int = 5
    min_matches: int = 10
    endpoint_move: float = 0.05
    endpoint_rounds: int = 50
    fit_iterations: int = 25
    solve_iterations: int = 100
    radial_sd: float = 0.03
    tangential_sd: float = 0.03
    angular_sd: float = 0.01
    rot_prior: float = 1e-4
    trans_prior: float = 1e-3
    normal_angle_deg: float = 25.0
    ransac_sigma: float = 0.04
    ransac_iterations: int = 2000
    ransac_inliers: int = 150
    bootstrap: int = 1000
    self_hit: float = 0.8
    chi2_95: float = 5.991


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


D, I, L, S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()
POSES = _struct(graph_id=L, pose_id=I, x=D, y=D, th=D, cov=T.ArrayType(D))
SCANS = _struct(graph_id=L, pose_id=I, obs_id=I, px=D, py=D, nx=D, ny=D)
SEGMENTS = _struct(sel_id=I, x0=D, y0=D, x1=D, y1=D)
LOG = _struct(entry_id=I, type=I, undone=T.BooleanType(), points=T.ArrayType(_XY))
CONSTRAINTS = _struct(graph_id=L, correction_id=I, type=I, anchor_id=I, constrained_id=I, delta_parallel=D, delta_perpendicular=D, delta_angle=D, penalty_dir=D)

#: Message schemas: header, scalars, and arrays where the message has them.
_HEADER = _struct(seq=L, stamp=T.TimestampType(), frame_id=S)
_A = T.ArrayType
MESSAGES = {
    "anomaly": _struct(header=_HEADER, anomaly=D, mean=_A(D), var=_A(D), nSamples=I),
    "anomaly_rectangle": _struct(header=_HEADER, lowerLeft=_A(D), upperRight=_A(D), anomaly=D, mean=_A(D), var=_A(D), nSamples=I),
    "camera": _struct(numCameras=I, ip=_A(S), width=_A(I), height=_A(I), frames=_A(T.BinaryType())),
    "events": _struct(timestamp=D, module=S, events=_A(S)),
    "localization3d": _struct(timeStamp=D, x=D, y=D, z=D, qw=D, qx=D, qy=D, qz=D, conf=D, map=S),
    "localization": _struct(timeStamp=D, x=D, y=D, angle=D, angleUncertainty=D, locUncertainty=D, map=S),
    "odometry": _struct(header=_HEADER, dr=D, dx=D, dy=D, v0=D, v1=D, v2=D, v3=D, vr=D, vx=D, vy=D, VBatt=D, status=T.ShortType()),
    "status": _struct(timeStamp=D, x=D, y=D, theta=D, targetX=D, targetY=D, particlesX=_A(D), particlesY=_A(D), particlesTheta=_A(D), particlesWeight=_A(D), pathPlanX=_A(D), pathPlanY=_A(D)),
    "keyboard": _struct(header=_HEADER, keycode=L, modifiers=L),
    "mouse_click": _struct(header=_HEADER, mouse_down=_XY, mouse_up=_XY, modifiers=L),
    "mouse_move": _struct(header=_HEADER, location=_XY, buttons=L, modifiers=L),
    "display": _struct(header=_HEADER, lines_p1x=_A(D), lines_p1y=_A(D), lines_p2x=_A(D), lines_p2y=_A(D), lines_col=_A(L), points_x=_A(D), points_y=_A(D), points_col=_A(L), text=_A(S), text_height=_A(D)),
    "map_location": _struct(map_name=S, x=D, y=D, angle=D),
    "set_localization": _struct(x=D, y=D, angle=D, map=S),
    "remote": _struct(vx=D, vy=D, vr=D, command=I, x=D, y=D, theta=D, err=T.ShortType()),
    "capture": _struct(filename=S, error=T.ShortType()),
}
