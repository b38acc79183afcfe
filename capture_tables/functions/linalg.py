"""3-D vectors, matrices and rotations as Column expressions.

A vector is a list of three Columns, a matrix a list of three rows of three. Everything stays
inside whole-stage code generation; nothing here is a UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list
Matrix = list


def columns(*names: str) -> Vector:
    return [F.col(n) for n in names]


def matrix(prefix: str = "r") -> Matrix:
    return [[F.col(f"{prefix}{i}{j}") for j in range(3)] for i in range(3)]


def named(m: Matrix, prefix: str = "r") -> list[Column]:
    return [m[i][j].alias(f"{prefix}{i}{j}") for i in range(3) for j in range(3)]


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Vector, b: Vector) -> Column:
    return total(x * y for x, y in zip(a, b, strict=True))


def minus(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def plus(a: Vector, b: Vector) -> Vector:
    return [x + y for x, y in zip(a, b, strict=True)]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def transpose(m: Matrix) -> Matrix:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def times(a: Matrix, b: Matrix) -> Matrix:
    return [[dot(a[i], [b[k][j] for k in range(3)]) for j in range(3)] for i in range(3)]


def apply(m: Matrix, v: Vector) -> Vector:
    return [dot(row, v) for row in m]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def angle_between(a: Matrix, b: Matrix) -> Column:
    """Geodesic angle, in radians, between two rotation matrices. The cosine is rounded to twelve
    digits: around 1 the arc cosine would make the last bits' noise ten million times as large."""
    trace = total(dot(a[i], b[i]) for i in range(3))
    return F.acos(clip(F.round((trace - 1.0) / 2.0, 12), -1.0, 1.0))


def from_axis_angle(axis: Vector, angle: Column) -> Matrix:
    """Rodrigues' formula for a unit axis."""
    x, y, z = axis
    c, s = F.cos(angle), F.sin(angle)
    k = 1.0 - c
    return [
        [c + x * x * k, x * y * k - z * s, x * z * k + y * s],
        [y * x * k + z * s, c + y * y * k, y * z * k - x * s],
        [z * x * k - y * s, z * y * k + x * s, c + z * z * k],
    ]


def from_rotation_vector(v: Vector) -> Matrix:
    """A rotation vector's matrix; the zero vector gives the identity."""
    size = norm(v)
    safe = F.when(size > 1e-12, size).otherwise(F.lit(1.0))
    return from_axis_angle([x / safe for x in v], size)


def quaternion(m: Matrix) -> list[Column]:
    """(w, x, y, z) of a rotation matrix, from whichever of the four is largest, w >= 0 where
    the trace decides."""
    (a, b, c), (d, e, f), (g, h, i) = m
    t = a + e + i

    def pick(first, second, third, fourth):
        return (
            F.when(t > 0, first).when((a >= e) & (a >= i), second).when(e >= i, third).otherwise(fourth)
        )

    s = pick(
        F.sqrt(F.greatest(t + 1.0, F.lit(0.0))) * 2.0,
        F.sqrt(F.greatest(1.0 + a - e - i, F.lit(0.0))) * 2.0,
        F.sqrt(F.greatest(1.0 + e - a - i, F.lit(0.0))) * 2.0,
        F.sqrt(F.greatest(1.0 + i - a - e, F.lit(0.0))) * 2.0,
    )
    return [
        pick(s / 4.0, (h - f) / s, (c - g) / s, (d - b) / s),
        pick((h - f) / s, s / 4.0, (b + d) / s, (c + g) / s),
        pick((c - g) / s, (b + d) / s, s / 4.0, (f + h) / s),
        pick((d - b) / s, (c + g) / s, (f + h) / s, s / 4.0),
    ]


def from_quaternion(q: list[Column]) -> Matrix:
    """The matrix of a quaternion (w, x, y, z) of any length but zero."""
    n = F.sqrt(dot(q, q))
    w, x, y, z = (c / n for c in q)
    return [
        [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y)],
        [2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x)],
        [2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)],
    ]


def with_rotation_vector(df, m: Matrix, names: list[str]):
    """`df` with the logarithm of the rotation m in three columns: the matrix, its quaternion and
    the vector are each a projection of their own, which keeps the generated code short."""
    flat = [f"_m{i}{j}" for i in range(3) for j in range(3)]
    q = [f"_q{k}" for k in range(4)]
    out = df.withColumns(dict(zip(flat, [c for row in m for c in row], strict=True)))
    out = out.withColumns(dict(zip(q, quaternion(matrix("_m")), strict=True)))
    return out.withColumns(dict(zip(names, rotation_vector(columns(*q)), strict=True))).drop(*flat, *q)


def rotation_vector(q: list[Column]) -> Vector:
    """The logarithm map of a unit quaternion (w, x, y, z); zero near the identity."""
    w, *v = q
    size = norm(v)
    angle = 2.0 * F.atan2(size, w)
    turned = F.when(angle > F.pi(), angle - 2.0 * F.pi()).otherwise(angle)
    scale = F.when(size > 1e-12, turned / F.when(size > 1e-12, size).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    return [c * scale for c in v]


def to_six(m: Matrix) -> list[Column]:
    """The first two columns of a matrix, row by row."""
    return [m[i][j] for i in range(3) for j in range(2)]


def from_six(s: list[Column]) -> Matrix:
    """Gram-Schmidt on the two columns that `to_six` gives."""
    a, b = [s[0], s[2], s[4]], [s[1], s[3], s[5]]
    x = [c / norm(a) for c in a]
    along = dot(x, b)
    y = [q - along * p for p, q in zip(x, b, strict=True)]
    y = [c / norm(y) for c in y]
    z = [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]
    return transpose([x, y, z])


def determinant(m: Matrix) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve(m: Matrix, v: Vector, least: float = 1e-9) -> Vector:
    """The solution of m x = v by Cramer's rule; NULL where the determinant is about zero."""
    det = determinant(m)
    good = F.abs(det) > least

    def with_column(k: int) -> Matrix:
        return [[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]

    return [F.when(good, determinant(with_column(k)) / F.when(good, det)) for k in range(3)]


def rounded(df, digits: int = 6):
    """`df` with every double column rounded, and negative zero made zero."""
    return df.select(
        *[(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )
