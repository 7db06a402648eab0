"""Rotations, poses and cameras as scalar columns.

Matrices are lists of nine columns in row order, quaternions are (x, y, z, w). Scalars stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[Column]


def quat_to_matrix(x: Column, y: Column, z: Column, w: Column) -> Matrix:
    """Rotation of a quaternion of any norm but 0."""
    s = 2.0 / (x * x + y * y + z * z + w * w)
    return [
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    ]


def colmap_quat_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Matrix:
    """The same for the (w, x, y, z) order of sparse reconstructions; unit norm."""
    return quat_to_matrix(x, y, z, w)


def matrix_to_quat(m: Matrix) -> list[Column]:
    """(x, y, z, w) with w >= 0.

    With R = R(q): trace = 4ww - 1 and R[i][i] = 2(ww + qi qi) - 1, so the greatest of the trace and the diagonal tells which
    component is largest. That one is a root; sums and differences of opposite entries, which are four times products of two
    components, give the others by division. Of equal ones w, then x, y, z counts.
    """
    trace = m[0] + m[4] + m[8]
    turn = {"x": m[7] - m[5], "y": m[2] - m[6], "z": m[3] - m[1]}  # four times w times a component
    mixed = {frozenset("xy"): m[1] + m[3], frozenset("xz"): m[2] + m[6], frozenset("yz"): m[5] + m[7]}
    diagonal = {"w": trace, "x": m[0], "y": m[4], "z": m[8]}
    largest = F.greatest(*diagonal.values())

    def from_largest(name: str) -> dict[str, Column]:
        square = 1 + trace if name == "w" else 1 + 2 * diagonal[name] - trace  # four times its square
        twice = F.sqrt(F.greatest(square, F.lit(0.0)))
        if name == "w":
            return {"w": twice / 2} | {c: v / (2 * twice) for c, v in turn.items()}
        flip = F.when(turn[name] < 0, -1.0).otherwise(1.0)  # the sign that makes w positive
        rest = {c: flip * mixed[frozenset((name, c))] / (2 * twice) for c in "xyz" if c != name}
        return rest | {name: flip * twice / 2, "w": flip * turn[name] / (2 * twice)}

    forms = {name: from_largest(name) for name in "wxyz"}

    def pick(c: str) -> Column:
        return F.when(diagonal["w"] >= largest, forms["w"][c]).when(diagonal["x"] >= largest, forms["x"][c]).when(diagonal["y"] >= largest, forms["y"][c]).otherwise(forms["z"][c])

    return [pick(c) for c in "xyzw"]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transpose(a: Matrix) -> Matrix:
    return [a[0], a[3], a[6], a[1], a[4], a[7], a[2], a[5], a[8]]


def apply(a: Matrix, v: list[Column]) -> list[Column]:
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def se3_inverse(r: Matrix, t: list[Column]) -> tuple[Matrix, list[Column]]:
    """Inverse of x -> r x + t."""
    back = transpose(r)
    return back, [-x for x in apply(back, t)]


def rebase(r: Matrix, t: list[Column], r0: Matrix, t0: list[Column]) -> tuple[Matrix, list[Column]]:
    """The pose as seen when (r0, t0) becomes the identity: E times the inverse of E0."""
    inv_r, inv_t = se3_inverse(r0, t0)
    moved = apply(r, inv_t)
    return multiply(r, inv_r), [a + b for a, b in zip(moved, t, strict=True)]


def rotation_degrees(a: Matrix, b: Matrix) -> Column:
    """Angle between two rotations; the cosine is clamped first."""
    trace = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return F.degrees(F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0))))


def direction_degrees(a: list[Column], b: list[Column]) -> Column:
    """Angle between two directions; 90 where one is zero."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    norms = F.sqrt(a[0] ** 2 + a[1] ** 2 + a[2] ** 2) * F.sqrt(b[0] ** 2 + b[1] ** 2 + b[2] ** 2)
    cos = F.coalesce(F.try_divide(dot, norms), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))))


def encode_pose(r: Matrix, t: list[Column], fx: Column, fy: Column, height: Column, width: Column) -> list[Column]:
    """Translation, quaternion and the two fields of view: nine columns."""
    return [*t, *matrix_to_quat(r), 2 * F.atan((height / 2) / fy), 2 * F.atan((width / 2) / fx)]


def decode_pose(enc: list[Column], height: Column, width: Column) -> dict[str, Column]:
    """Rotation r0..r8, translation t0..t2 and intrinsics fx, fy, cx, cy of nine encoded columns."""
    r = quat_to_matrix(*enc[3:7])
    out = {f"r{k}": c for k, c in enumerate(r)} | {f"t{k}": c for k, c in enumerate(enc[:3])}
    return out | {"fx": (width / 2) / F.tan(enc[8] / 2), "fy": (height / 2) / F.tan(enc[7] / 2), "cx": width / 2, "cy": height / 2}


def project(r: Matrix, t: list[Column], fx: Column, fy: Column, cx: Column, cy: Column, p: list[Column]) -> tuple[Column, Column, Column]:
    """Pixel (u, v) and depth z of a world point; null where z is 0."""
    x, y, z = (a + b for a, b in zip(apply(r, p), t, strict=True))
    return F.try_divide(x * fx, z) + cx, F.try_divide(y * fy, z) + cy, z


def unproject(u: Column, v: Column, z: Column, r: Matrix, t: list[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """World point of a pixel at depth z."""
    cam = [(u - cx) / fx * z, (v - cy) / fy * z, z]
    return apply(transpose(r), [a - b for a, b in zip(cam, t, strict=True)])


def in_frustum(u: Column, v: Column, z: Column, width: Column, height: Column, min_depth: float) -> Column:
    return (z > min_depth) & (u >= 0) & (u < width) & (v >= 0) & (v < height)


def half_pixel_intrinsics(cx: Column, cy: Column) -> tuple[Column, Column]:
    """Principal point from pixel corners at integers to pixel centres at integers."""
    return cx - 0.5, cy - 0.5


def rescale_intrinsics(fx: Column, fy: Column, src_h: Column, src_w: Column, out_h: Column, out_w: Column) -> dict[str, Column]:
    """Centred pinhole of a resized image."""
    return {"fx": fx * out_w / src_w, "fy": fy * out_h / src_h, "cx": out_w / 2, "cy": out_h / 2}


#: Places of fx, fy, cx, cy and of k1, k2, p1, p2, k3 in a camera model's parameters; -1 is 0.
PINHOLE = {
    "SIMPLE_PINHOLE": ((0, 0, 1, 2), (-1, -1, -1, -1, -1)),
    "PINHOLE": ((0, 1, 2, 3), (-1, -1, -1, -1, -1)),
    "SIMPLE_RADIAL": ((0, 0, 1, 2), (3, -1, -1, -1, -1)),
    "RADIAL": ((0, 0, 1, 2), (3, 4, -1, -1, -1)),
    "OPENCV": ((0, 1, 2, 3), (4, 5, 6, 7, -1)),
    "FULL_OPENCV": ((0, 1, 2, 3), (4, 5, 6, 7, 8)),
}


def to_pinhole(model: Column, params: Column) -> Column:
    """struct<fx,fy,cx,cy,dist> of a camera; other models raise an error."""
    out = F.raise_error(F.concat(F.lit("no pinhole form of "), model)).cast("struct<fx:double,fy:double,cx:double,cy:double,dist:array<double>>")
    for name, (main, dist) in PINHOLE.items():
        at = lambda k: F.get(params, F.lit(k)) if k >= 0 else F.lit(0.0)
        got = F.struct(*[at(k).alias(n) for n, k in zip(("fx", "fy", "cx", "cy"), main, strict=True)], F.array(*[at(k) for k in dist]).alias("dist"))
        out = F.when(model == name, got).otherwise(out)
    return out
