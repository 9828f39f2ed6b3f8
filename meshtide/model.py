"""Schemas, settings and validation.

A corpus is two DataFrames keyed by mesh: vertices(mesh_id, vertex_id, x, y, z) and
faces(mesh_id, face_id, a, b, c), where the order of a, b, c is the winding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTICES = "mesh_id string, vertex_id bigint, x double, y double, z double"
FACES = "mesh_id string, face_id bigint, a bigint, b bigint, c bigint"
RESULTS = "mass string, triangles int, method string, backfacingness double, seconds double, cpu_seconds double"
CORNERS = ("a", "b", "c")
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Settings:
    """rays_total: for a whole mesh, 100 a face when None; rays_minimum: at least so many a component;
    facet_wise: every face its own component; use_parity: vote by crossings; strategy: sql, arrow or auto."""

    rays_total: int | None = None
    rays_minimum: int = 10
    facet_wise: bool = True
    use_parity: bool = False
    seed: int = 0
    strategy: str = "auto"


def bad_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, corner): corners that no vertex of their mesh answers to."""
    corners = faces.select("mesh_id", "face_id", F.explode(F.array(*CORNERS)).alias("corner"))
    known = vertices.select("mesh_id", F.col("vertex_id").alias("corner"))
    return corners.join(known.hint("merge"), ["mesh_id", "corner"], "left_anti").select("mesh_id", "face_id", "corner")


def validate(vertices: DataFrame, faces: DataFrame) -> None:
    """Raise IndexError for a corner out of range and ValueError for a coordinate that is not finite."""
    finite = F.lit(True)
    for k in AXES:
        finite = finite & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) < float("inf"))
    if vertices.where(~finite).limit(1).count():
        raise ValueError("a vertex has a coordinate that is not finite")
    if bad_corners(vertices, faces).limit(1).count():
        raise IndexError("a face has a corner that is no vertex")
