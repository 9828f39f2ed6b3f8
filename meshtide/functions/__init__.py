"""Column functions: vectors and repeatable random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str, suffix: str = "") -> Vector:
    """The columns {prefix}x{suffix}, {prefix}y{suffix}, {prefix}z{suffix}."""
    return tuple(F.col(f"{prefix}{k}{suffix}") for k in "xyz")


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vector, k: Column | float) -> Vector:
    return tuple(p * k for p in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def uniform(*keys: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone: on no partitioning, order or engine."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


#: Numbers that a ray draws: four for its line, one for the face it starts on.
DRAWS = 5
#: How far each draw moves from ray to ray: powers of the root of x**6 = x + 1, so that few rays are spread evenly in all draws at once.
STRIDES = tuple(1.1347241384015194 ** -(k + 1) for k in range(DRAWS))


def ray_key(seed: int, mesh_id: Column, component: Column) -> Column:
    """Hexadecimal digits from which the draws of a component's rays begin."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), mesh_id, component.cast("string")).cast("binary"))


def draw(key: Column, ray_no: Column, k: int) -> Column:
    """The k-th number in [0, 1) of a ray: six digits of the key and a stride for each ray, without the whole part."""
    x = F.conv(F.substring(key, 6 * k + 1, 6), 16, 10).cast("bigint") / F.lit(16777216.0) + ray_no.cast("double") * F.lit(STRIDES[k])
    return x % F.lit(1.0)


def quantised(x: Column, places: int = 6) -> Column:
    """x as an integer count of 10**-places, so that sums do not depend on their order."""
    return F.floor(x * F.lit(10.0**places) + 0.5).cast("bigint")
