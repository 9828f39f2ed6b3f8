"""Preparation of meshes: corners, normals, duplicates, welding, windings, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshtide.functions import cross, norm, sub, vector
from meshtide.model import AXES, CORNERS


def gather(vertices: DataFrame, faces: DataFrame, *kept: str) -> DataFrame:
    """Faces with their corners' coordinates (ax .. cz) and the columns kept: three equi-joins on mesh and vertex.

    Joins of whole corpora are merge joins by hint, here and elsewhere: Spark estimates a table that was made by an
    explode at the size before it, and would collect a corpus on the driver to broadcast it.
    """
    out = faces
    for k in CORNERS:
        own = vertices.select("mesh_id", F.col("vertex_id").alias(k), *(F.col(x).alias(f"{k}{x}") for x in AXES))
        out = out.join(own.hint("merge"), ["mesh_id", k])
    return out.select("mesh_id", "face_id", *CORNERS, *(f"{k}{x}" for k in CORNERS for x in AXES), *kept)


def with_normals(tri: DataFrame) -> DataFrame:
    """tri with nx, ny, nz, the cross product of the wound triangle, and its norm dbl_area."""
    a, b, c = (vector(k) for k in CORNERS)
    n = cross(sub(b, a), sub(c, a))
    return tri.withColumns(dict(zip(("nx", "ny", "nz"), n, strict=True))).withColumn("dbl_area", norm(vector("n")))


def apply_flips(faces: DataFrame, flips: DataFrame) -> DataFrame:
    """Faces with corners in reverse where flips (mesh_id, face_id, flip) says so."""
    joined = faces.join(flips.select("mesh_id", "face_id", "flip").hint("merge"), ["mesh_id", "face_id"], "left")
    flip = F.coalesce("flip", F.lit(False))
    return joined.select("mesh_id", "face_id", F.when(flip, F.col("c")).otherwise(F.col("a")).alias("a"), "b", F.when(flip, F.col("a")).otherwise(F.col("c")).alias("c"))


def turned(faces: DataFrame, wound: DataFrame) -> DataFrame:
    """(mesh_id, face_id, turned): whether a face's ordered corners differ between two windings."""
    other = wound.select("mesh_id", "face_id", *(F.col(k).alias(f"w{k}") for k in CORNERS))
    return faces.join(other.hint("merge"), ["mesh_id", "face_id"]).select("mesh_id", "face_id", ((F.col("a") != F.col("wa")) | (F.col("b") != F.col("wb")) | (F.col("c") != F.col("wc"))).alias("turned"))


def dedupe_faces(faces: DataFrame) -> DataFrame:
    """Of faces with the same set of corners the first stays; ids are closed up in the old order."""
    key = F.array_sort(F.array(*CORNERS))
    first = faces.groupBy("mesh_id", key.alias("key")).agg(F.min(F.struct("face_id", *CORNERS)).alias("f")).select("mesh_id", "f.*")
    order = Window.partitionBy("mesh_id").orderBy("face_id")
    return first.select("mesh_id", (F.row_number().over(order) - 1).cast("bigint").alias("face_id"), *CORNERS)


def weld(vertices: DataFrame, faces: DataFrame, places: int = 3) -> tuple[DataFrame, DataFrame]:
    """Round coordinates half to even, make vertices of a mesh unique in the order x, y, z, and point faces at them."""
    rounded = vertices.select("mesh_id", "vertex_id", *(F.bround(k, places).alias(k) for k in AXES))
    order = Window.partitionBy("mesh_id").orderBy(*AXES)
    numbered = rounded.withColumn("new_id", (F.dense_rank().over(order) - 1).cast("bigint"))
    out = faces
    for k in CORNERS:
        out = out.join(numbered.select("mesh_id", F.col("vertex_id").alias(k), F.col("new_id").alias(f"new_{k}")), ["mesh_id", k])
    welded = numbered.select("mesh_id", F.col("new_id").alias("vertex_id"), *AXES).distinct()
    return welded, out.select("mesh_id", "face_id", *(F.col(f"new_{k}").alias(k) for k in CORNERS))


def bounding_boxes(tri: DataFrame) -> DataFrame:
    """Per mesh, over referenced corners: low and high corner, centre and half extent r (5% larger than the longest side)."""
    lows = [F.min(F.least(*(F.col(f"{k}{x}") for k in CORNERS))).alias(f"low_{x}") for x in AXES]
    highs = [F.max(F.greatest(*(F.col(f"{k}{x}") for k in CORNERS))).alias(f"high_{x}") for x in AXES]
    box = tri.groupBy("mesh_id").agg(*lows, *highs)
    sides = [F.col(f"high_{x}") - F.col(f"low_{x}") for x in AXES]
    return box.withColumns({f"centre_{x}": (F.col(f"low_{x}") + F.col(f"high_{x}")) / 2.0 for x in AXES} | {"r": F.greatest(*sides) * 1.05 / 2.0})


def to_origin(vertices: DataFrame, places: int = 3) -> DataFrame:
    """Vertices moved so that each mesh's lowest corner is at the origin, rounded half to even."""
    low = vertices.groupBy("mesh_id").agg(*(F.min(x).alias(f"low_{x}") for x in AXES))
    return vertices.join(low, "mesh_id").select("mesh_id", "vertex_id", *(F.bround(F.col(x) - F.col(f"low_{x}"), places).alias(x) for x in AXES))


def polygon_normals(rings: DataFrame) -> DataFrame:
    """Newell's normal of polygons: rings(polygon_id, ring, i, x, y, z) without closing corners; summed over rings."""
    ring = Window.partitionBy("polygon_id", "ring").orderBy("i")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = rings.withColumns({f"n{x}": F.coalesce(F.lead(x).over(ring), F.first(x).over(whole)) for x in AXES})

    def part(p: str, q: str) -> Column:
        return (F.col(p) - F.col(f"n{p}")) * (F.col(q) + F.col(f"n{q}"))

    return after.groupBy("polygon_id").agg(F.sum(part("y", "z")).alias("nx"), F.sum(part("z", "x")).alias("ny"), F.sum(part("x", "y")).alias("nz"))


def edge_incidences(faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, u, v): directed edges whose ends differ."""
    edges = F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select("mesh_id", "face_id", F.explode(edges).alias("e")).select("mesh_id", "face_id", "e.*").where("u <> v")


def edge_pairs(faces: DataFrame) -> DataFrame:
    """(mesh_id, f1, f2): faces that share an edge which has exactly two incidences, from two faces. One grouping, no self-join."""
    ends = edge_incidences(faces).groupBy("mesh_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    return ends.agg(F.count(F.lit(1)).alias("n"), F.min("face_id").alias("f1"), F.max("face_id").alias("f2")).where("n = 2 and f1 <> f2").select("mesh_id", "f1", "f2").distinct()


def wound_against(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """(mesh_id, f1, f2, against): whether the two faces have a directed edge in common, so that their windings disagree."""
    edges = F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    own = faces.select("mesh_id", "face_id", edges.alias("edges"))
    one = own.select("mesh_id", F.col("face_id").alias("f1"), F.col("edges").alias("e1"))
    two = own.select("mesh_id", F.col("face_id").alias("f2"), F.col("edges").alias("e2"))
    return pairs.join(one, ["mesh_id", "f1"]).join(two, ["mesh_id", "f2"]).select("mesh_id", "f1", "f2", F.arrays_overlap("e1", "e2").alias("against"))
