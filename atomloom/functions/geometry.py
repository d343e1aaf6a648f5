"""Column functions on coordinates, constraints and flow time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def xyz(prefix: str = "", suffix: str = "") -> Vector:
    """The three coordinate columns, e.g. xyz('l.') → l.x, l.y, l.z."""
    return tuple(F.col(f"{prefix}{axis}{suffix}") for axis in "xyz")


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def chiral_volume(ca: Vector, n: Vector, c: Vector, cb: Vector) -> Column:
    """Signed volume (N-CA) . ((C-CA) x (CB-CA))."""
    return dot(minus(n, ca), cross(minus(c, ca), minus(cb, ca)))


def normalized_chiral_volume(ca: Vector, n: Vector, c: Vector, cb: Vector, eps: float = 1e-6) -> Column:
    lengths = norm(minus(n, ca)) * norm(minus(c, ca)) * norm(minus(cb, ca))
    return chiral_volume(ca, n, c, cb) / (lengths + F.lit(eps))


def sinusoidal_embedding(t: Column, dimension: int) -> Column:
    """[sin(f t) ..., cos(f t) ...] with f_k = exp(-ln(10000) k / half)."""
    half = dimension // 2
    frequency = lambda k: F.exp(F.lit(-9.210340371976184) * k / F.lit(float(half)))
    steps = F.array(*[F.lit(float(k)) for k in range(half)])
    return F.concat(F.transform(steps, lambda k: F.sin(frequency(k) * t)), F.transform(steps, lambda k: F.cos(frequency(k) * t)))


def constraint_features(is_fixed: Column, is_hotspot: Column, rasa_target: Column, has_rasa: Column, drop_soft: bool = False) -> list[Column]:
    """The four conditioning columns; ``drop_soft`` blanks all but the first."""
    soft = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in (is_hotspot, rasa_target, has_rasa)]
    first = F.coalesce(is_fixed.cast("double"), F.lit(0.0)).alias("is_fixed")
    names = ("is_hotspot", "rasa", "has_rasa")
    return [first, *((F.lit(0.0) if drop_soft else c).alias(n) for c, n in zip(soft, names, strict=True))]


def rotate(rows: Sequence[Sequence[Column]], p: Vector, center: Vector) -> Vector:
    """R . (p - center), R given as three rows of three columns."""
    q = minus(p, center)
    return tuple(dot(tuple(r), q) for r in rows)


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion; four standard normal draws give the uniform law over rotations."""
    n = w * w + x * x + y * y + z * z
    return [
        [1 - 2 * (y * y + z * z) / n, 2 * (x * y - w * z) / n, 2 * (x * z + w * y) / n],
        [2 * (x * y + w * z) / n, 1 - 2 * (x * x + z * z) / n, 2 * (y * z - w * x) / n],
        [2 * (x * z - w * y) / n, 2 * (y * z + w * x) / n, 1 - 2 * (x * x + y * y) / n],
    ]


def interpolant(x0: Column, x1: Column, t: Column) -> tuple[Column, Column]:
    """(x_t, velocity) of the straight path from x0 to x1."""
    return (1 - t) * x0 + t * x1, x1 - x0


def guided_velocity(unconditional: Column, conditional: Column, guidance: float) -> Column:
    """Classifier-free blend v_u + g (v_c - v_u)."""
    return conditional if guidance == 1 else unconditional + F.lit(guidance) * (conditional - unconditional)


def euler_step(x: Column, velocity: Column, dt: float, is_fixed: Column, fixed: Column) -> Column:
    """x + dt v, with fixed atoms put back."""
    return F.when(is_fixed, fixed).otherwise(x + F.lit(dt) * velocity)
