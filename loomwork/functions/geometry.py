"""Camera and box geometry on double arrays; matrices are row-major arrays of 9 or 16."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.expr import bound


def _arr(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def _at(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@bound
def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def identity() -> Column:
    return _arr(*[1.0 if i % 5 == 0 else 0.0 for i in range(16)])


@bound
def rotation_angle(a: Column, b: Column) -> Column:
    """The angle between the rotations of two 4x4 poses."""
    trace = sum((_at(a, 4 * r + c) * _at(b, 4 * r + c) for r in range(3) for c in range(3)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))


@bound
def pose_inverse(m: Column) -> Column:
    """The inverse of a rigid 4x4 pose: transposed rotation, and minus that times the translation."""
    rows = []
    for r in range(3):
        turned = [_at(m, 4 * c + r) for c in range(3)]
        moved = sum((-turned[c] * _at(m, 4 * c + 3) for c in range(3)), F.lit(0.0))
        rows += [*turned, moved]
    return _arr(*rows, 0.0, 0.0, 0.0, 1.0)


@bound
def transformed(m: Column, p: Column) -> Column:
    """A point through a 4x4 matrix, divided by its fourth coordinate."""
    row = lambda r: sum((_at(m, 4 * r + c) * _at(p, c) for c in range(3)), _at(m, 4 * r + 3))
    return _arr(row(0) / row(3), row(1) / row(3), row(2) / row(3))


@bound
def matrix_of_axis_angle(v: Column) -> Column:
    """3x3 rotation of an axis-angle vector (Rodrigues); the identity for a zero vector."""
    angle = norm(v)
    x, y, z = (F.coalesce(F.try_divide(_at(v, i), angle), F.lit(0.0)) for i in range(3))
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return _arr(
        t * x * x + c, t * x * y - s * z, t * x * z + s * y,
        t * x * y + s * z, t * y * y + c, t * y * z - s * x,
        t * x * z - s * y, t * y * z + s * x, t * z * z + c,
    )


@bound
def pose_of(rotation: Column, translation: Column) -> Column:
    cells = []
    for r in range(3):
        cells += [_at(rotation, 3 * r + c) for c in range(3)] + [_at(translation, r)]
    return _arr(*cells, 0.0, 0.0, 0.0, 1.0)


@bound
def matrix_of_quaternion(q: Column) -> Column:
    """3x3 rotation of a quaternion (w, x, y, z) of any length."""
    n = norm(q)
    w, x, y, z = (_at(q, i) / n for i in range(4))
    return _arr(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


@bound
def matrix_of_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """3x3 rotation of turns about x, then y, then z."""
    ci, si, cj, sj, ck, sk = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return _arr(
        ck * cj, ck * sj * si - sk * ci, ck * sj * ci + sk * si,
        sk * cj, sk * sj * si + ck * ci, sk * sj * ci - ck * si,
        -sj, cj * si, cj * ci,
    )


def intrinsics(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """K as 4x4."""
    return _arr(fx, 0.0, cx, 0.0, 0.0, fy, cy, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


@bound
def unprojected(u: Column, v: Column, depth_mm: Column, k: Column, pose: Column) -> Column:
    """The world point of a pixel: depth in millimetres, K as 4x4, camera-to-world pose."""
    d = depth_mm / 1000.0
    camera = _arr((u - _at(k, 2)) * d / _at(k, 0), (v - _at(k, 6)) * d / _at(k, 5), d)
    return transformed(pose, camera)


@bound
def projected(point: Column, k: Column, world_to_camera: Column) -> Column:
    """(u, v, depth) of a world point."""
    p = transformed(world_to_camera, point)
    z = _at(p, 2)
    return _arr(_at(k, 0) * _at(p, 0) / z + _at(k, 2), _at(k, 5) * _at(p, 1) / z + _at(k, 6), z)


@bound
def is_visible(uvd: Column, width: Column, height: Column, depth_there: Column, slack: float = 0.05) -> Column:
    u, v, d = (_at(uvd, i) for i in range(3))
    return (u >= 0) & (v >= 0) & (u < width) & (v < height) & (d > 0) & (d <= depth_there + slack)


def voxel(point: Column, low: Column, high: Column, size: float) -> Column:
    """Clamped to the box, moved to its corner, divided and rounded half to even."""
    clamped = F.zip_with(F.zip_with(point, low, lambda x, a: F.greatest(x, a)), high, lambda x, b: F.least(x, b))
    return F.zip_with(clamped, low, lambda x, a: F.rint((x - a) / size).cast("bigint"))


@bound
def iou(a: Column, b: Column) -> Column:
    """Overlap of boxes [x1, y1, x2, y2] with inclusive ends; 0 for an empty union."""
    area = lambda x1, y1, x2, y2: F.greatest(x2 - x1 + 1, F.lit(0.0)) * F.greatest(y2 - y1 + 1, F.lit(0.0))
    inner = area(F.greatest(_at(a, 0), _at(b, 0)), F.greatest(_at(a, 1), _at(b, 1)), F.least(_at(a, 2), _at(b, 2)), F.least(_at(a, 3), _at(b, 3)))
    union = area(*(_at(a, i) for i in range(4))) + area(*(_at(b, i) for i in range(4))) - inner
    return F.coalesce(F.try_divide(inner, union), F.lit(0.0))


@bound
def relative_position(a: Column, b: Column, threshold: float = 0.1) -> Column:
    """Where box a stands from box b: left of, right of, above, below; empty when they overlap within the threshold."""
    parts, offsets = [], []
    for lo, hi in ((0, 2), (1, 3)):
        offset = (_at(a, lo) + _at(a, hi)) / 2 - (_at(b, lo) + _at(b, hi)) / 2
        size = F.abs(_at(a, hi) - _at(a, lo)) + F.abs(_at(b, hi) - _at(b, lo))
        offsets.append(offset)
        parts.append(F.greatest(F.abs(offset) - threshold * size, F.lit(0.0)) * F.signum(offset))
    far = F.sqrt(offsets[0] * offsets[0] + offsets[1] * offsets[1])
    dx, dy = (F.try_divide(p, far) for p in parts)
    none = (F.abs(parts[0]) < 1e-3) & (F.abs(parts[1]) < 1e-3)
    names = F.array(
        F.when(dx < -0.5, F.lit("left of")),
        F.when(dx > 0.5, F.lit("right of")),
        F.when(dy < -0.5, F.lit("above")),
        F.when(dy > 0.5, F.lit("below")),
    )
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(names))


def scaled_box(box: Column, sx: Column, sy: Column) -> Column:
    return F.transform(box, lambda x, i: F.when(i % 2 == 0, x * sx).otherwise(x * sy))
