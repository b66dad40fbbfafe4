"""Pose arithmetic as column expressions: Euler angles in degrees about the fixed x, y, z axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("tx", "ty", "tz", "rx", "ry", "rz")


def rotation(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Matrix of Rz * Ry * Rx."""
    ax, ay, az = F.radians(rx), F.radians(ry), F.radians(rz)
    cx, sx, cy, sy, cz, sz = F.cos(ax), F.sin(ax), F.cos(ay), F.sin(ay), F.cos(az), F.sin(az)
    return [[cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz],
            [cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz],
            [-sy, sx * cy, cx * cy]]


def rotation_of(prefix: str) -> list[list[Column]]:
    return rotation(*[F.col(f"{prefix}r{a}") for a in "xyz"])


def position_of(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}t{a}") for a in "xyz"]


def distance(p: list[Column], q: list[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q)), F.lit(0.0)))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def dot(p: list[Column], q: list[Column]) -> Column:
    return sum((a * b for a, b in zip(p, q)), F.lit(0.0))


def geodesic_angle(a: list[list[Column]], b: list[list[Column]]) -> Column:
    """Angle of the rotation from one orientation to the other, in degrees."""
    trace = sum((a[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(clip((trace - 1) * 0.5, -1.0, 1.0)))


def pose_errors(a: str, b: str) -> tuple[Column, Column]:
    """Position and orientation error between the poses with column prefixes ``a`` and ``b``."""
    return distance(position_of(a), position_of(b)), geodesic_angle(rotation_of(a), rotation_of(b))
