"""Vectors and matrices as tuples of Columns; everything unrolls into plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Mat = tuple[Column, ...]  # nine, row by row

#: Zero tests: of lattice-space vectors, of spatial vectors, of rotations.
LATTICE_EPSILON = 1e-3
ATOM_EPSILON = 1e-4
ROTATION_EPSILON = 1e-4


def vec(c: Column | str) -> Vec:
    """The entries of an array<double> of three."""
    c = F.col(c) if isinstance(c, str) else c
    return F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2))


def xyz(c: Column | str) -> Vec:
    """The fields of a struct<x,y,z>."""
    c = F.col(c) if isinstance(c, str) else c
    return c["x"], c["y"], c["z"]


def mat(c: Column | str) -> Mat:
    c = F.col(c) if isinstance(c, str) else c
    return tuple(F.get(c, F.lit(i)) for i in range(9))


def packed(v) -> Column:
    return F.array(*v)


def point(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def let(value: Column, body) -> Column:
    """body of value, which is worked out once for a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, s) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def det3(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def matvec(m: Mat, v: Vec) -> Vec:
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))


def matmul(a: Mat, b: Mat) -> Mat:
    return tuple(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3))


def all_true(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_true(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_zero(v, eps: float) -> Column:
    """Each component within eps of zero."""
    return all_true(F.abs(x) <= eps for x in v)


def is_identity(m: Mat, eps: float = ROTATION_EPSILON) -> Column:
    return all_true(F.abs(m[3 * i + j] - (1.0 if i == j else 0.0)) <= eps for i in range(3) for j in range(3))
