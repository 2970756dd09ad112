"""Rotations as column expressions over arrays; quaternions have the scalar last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tendon.functions.columns import norm, safe_div

#: Orders of angles that profiles may declare.
EULER_ORDERS = ("xyz", "zyx", "xyx", "XYZ", "ZYX", "XYX")


def parts(q: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.element_at(q, i) for i in range(1, 5))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with x computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def conjugate(q: Column) -> Column:
    return F.transform(q, lambda v, i: F.when(i < 3, -v).otherwise(v))


def product(a: Column, b: Column) -> Column:
    def of(a: Column, b: Column) -> Column:
        ax, ay, az, aw = parts(a)
        bx, by, bz, bw = parts(b)
        return F.array(
            aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx,
            aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz,
        )

    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: of(x["a"], x["b"]))


def unit(q: Column) -> Column:
    return let(F.struct(q.alias("q"), norm(q).alias("n")), lambda x: F.transform(x["q"], lambda v: safe_div(v, x["n"], 0.0)))


def rotation_vector(q: Column) -> Column:
    """Axis times angle, the shorter way round."""

    def of(q: Column) -> Column:
        x, y, z, w = parts(q)
        s = F.sqrt(x * x + y * y + z * z)
        k = F.when(s > 1e-12, 2 * F.atan2(s, F.abs(w)) / F.when(s > 1e-12, s)).otherwise(2.0) * F.when(w < 0, -1.0).otherwise(1.0)
        return let(k, lambda k: F.array(x * k, y * k, z * k))

    return let(q, of)


def rotated_back(v: Column, q: Column) -> Column:
    """The vector in the frame of the rotation."""
    flat = F.concat(F.slice(v, 1, 3), F.array(F.lit(0.0)))
    return F.slice(product(product(conjugate(q), flat), q), 1, 3)


def from_rotation_vector(v: Column) -> Column:
    def of(v: Column) -> Column:
        x, y, z = (F.element_at(v, i) for i in (1, 2, 3))

        def scaled(angle: Column) -> Column:
            k = F.when(angle > 1e-12, F.sin(angle / 2) / F.when(angle > 1e-12, angle)).otherwise(0.5)
            return let(k, lambda k: F.array(x * k, y * k, z * k, F.cos(angle / 2)))

        return let(F.sqrt(x * x + y * y + z * z), scaled)

    return let(v, of)


def from_matrix(m: Column) -> Column:
    """From nine numbers, row by row; the largest of the four candidates keeps the division safe."""

    def of(m: Column) -> Column:
        m00, m01, m02, m10, m11, m12, m20, m21, m22 = (F.element_at(m, i) for i in range(1, 10))
        t = m00 + m11 + m22
        quads = [
            (t, F.array(m21 - m12, m02 - m20, m10 - m01, 1 + t)),
            (m00, F.array(1 + m00 - m11 - m22, m01 + m10, m02 + m20, m21 - m12)),
            (m11, F.array(m01 + m10, 1 - m00 + m11 - m22, m12 + m21, m02 - m20)),
            (m22, F.array(m02 + m20, m12 + m21, 1 - m00 - m11 + m22, m10 - m01)),
        ]
        top = F.greatest(t, m00, m11, m22)
        out = F.when(t == top, quads[0][1])
        for k, q in quads[1:]:
            out = out.when(k == top, q)
        return out

    return let(let(m, of), unit)


def from_rot6d(r: Column) -> Column:
    """From the first two columns of a matrix, made orthonormal one after the other."""

    def flat(x: Column, y: Column) -> Column:
        x1, x2, x3 = (F.element_at(x, i) for i in (1, 2, 3))
        y1, y2, y3 = (F.element_at(y, i) for i in (1, 2, 3))
        return from_matrix(F.array(x1, y1, x2 * y3 - x3 * y2, x2, y2, x3 * y1 - x1 * y3, x3, y3, x1 * y2 - x2 * y1))

    def second(v: Column) -> Column:
        along = F.aggregate(F.zip_with(v["x"], v["b"], lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        left = let(along, lambda k: F.zip_with(v["b"], v["x"], lambda q, p: q - k * p))
        return let(F.struct(v["x"].alias("x"), let(left, unit).alias("y")), lambda w: flat(w["x"], w["y"]))

    return let(F.struct(let(F.slice(r, 1, 3), unit).alias("x"), F.slice(r, 4, 3).alias("b")), second)


def from_euler(angles: Column, order: str) -> Column:
    """Three angles about the axes in ``order``: small letters turn about fixed axes, capitals about moving ones."""

    def about(axis: str, i: int) -> Column:
        half = F.element_at(angles, i) / 2
        return F.array(*(F.sin(half) if a == axis.lower() else F.lit(0.0) for a in "xyz"), F.cos(half))

    q = [about(axis, i + 1) for i, axis in enumerate(order)]
    return product(q[2], product(q[1], q[0])) if order.islower() else product(q[0], product(q[1], q[2]))


def to_quaternion(x: Column, representation: str) -> Column:
    """Any of quat, matrix, rot6d, rotvec and euler_<order> as a unit quaternion."""
    if representation.startswith("euler_"):
        return from_euler(x, representation.removeprefix("euler_"))
    made = {"quat": unit, "matrix": from_matrix, "rot6d": from_rot6d, "rotvec": from_rotation_vector}
    return made[representation](x)


def arms_to_quaternions(x: Column, representation: str, arms: int) -> Column:
    """The quaternions of several arms one after another, from equal parts of an array, one per arm."""
    width = (F.size(x) / arms).cast("int")
    return F.concat(*(to_quaternion(F.slice(x, width * i + 1, width), representation) for i in range(arms)))
