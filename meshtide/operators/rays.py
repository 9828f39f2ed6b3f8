"""Rays: how many each component gets, where they start and where they go."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.functions import add, cross, draw, norm, quantised, ray_key, scale, sub, vector
from meshtide.model import AXES, Settings

#: A direction's cosine to the normal is at least this.
GRAZING = 0.1


def component_areas(tri: DataFrame) -> DataFrame:
    """(mesh_id, component, area, faces): doubled areas of components, quantised so that sums do not depend on order."""
    return tri.groupBy("mesh_id", "component").agg(F.sum(quantised(F.col("dbl_area"))).alias("area"), F.count(F.lit(1)).alias("faces"))


def allot(tri: DataFrame, settings: Settings) -> DataFrame:
    """(mesh_id, component, area, rays): a share of the mesh's rays by area, a least number for all that have any area."""
    areas = component_areas(tri)
    whole = Window.partitionBy("mesh_id")
    areas = areas.withColumns({"mesh_area": F.sum("area").over(whole), "mesh_faces": F.sum("faces").over(whole)})
    total = F.lit(settings.rays_total) if settings.rays_total is not None else F.col("mesh_faces") * 100
    share = F.floor(total * F.col("area") / F.nullif("mesh_area", F.lit(0)).cast("double") + 1e-9).cast("bigint")
    rays = F.when(F.col("area") == 0, F.lit(0)).otherwise(F.greatest(share, F.lit(settings.rays_minimum))).cast("bigint")
    return areas.select("mesh_id", "component", "area", rays.alias("rays"))


def running_areas(tri: DataFrame) -> DataFrame:
    """(mesh_id, component, face_id, reach): quantised area of a component's faces up to and with each."""
    order = Window.partitionBy("mesh_id", "component").orderBy("face_id").rowsBetween(Window.unboundedPreceding, 0)
    return tri.select("mesh_id", "component", "face_id", F.sum(quantised(F.col("dbl_area"))).over(order).alias("reach"))


def starts(tri: DataFrame, allotted: DataFrame, settings: Settings) -> DataFrame:
    """(mesh_id, component, ray_no, face_id, u0 .. u3): the face each ray starts on, as likely as its area within its component, and its draws.

    With every face its own component this is the face itself. Otherwise faces' running areas and
    rays' targets are sorted together and each ray takes the next face: one sort, no range join.
    """
    some = allotted.where("rays > 0").withColumn("key", ray_key(settings.seed, F.col("mesh_id"), F.col("component")))
    rays = some.select("mesh_id", "component", "area", "key", F.explode(F.sequence(F.lit(0), F.col("rays").cast("int") - 1)).alias("ray_no"))
    draws = [draw(F.col("key"), F.col("ray_no"), k).alias(f"u{k}") for k in range(4)]
    if settings.facet_wise:
        return rays.select("mesh_id", "component", "ray_no", F.col("component").alias("face_id"), *draws)
    target = draw(F.col("key"), F.col("ray_no"), 4) * F.col("area")
    asked = rays.select("mesh_id", "component", target.alias("at"), F.lit(1).alias("kind"), "ray_no", F.lit(None).cast("bigint").alias("face_id"), *draws)
    # faces without area reach no further than the face before and are never picked
    known = running_areas(tri.where(quantised(F.col("dbl_area")) > 0)).select("mesh_id", "component", F.col("reach").cast("double").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("ray_no"), "face_id", *(F.lit(None).cast("double").alias(f"u{k}") for k in range(4)))
    order = Window.partitionBy("mesh_id", "component").orderBy("at", "kind", "ray_no").rowsBetween(0, Window.unboundedFollowing)
    picked = asked.unionByName(known).withColumn("face_id", F.first("face_id", ignorenulls=True).over(order))
    return picked.where("kind = 1").select("mesh_id", "component", "ray_no", "face_id", *(f"u{k}" for k in range(4)))


def cast_lines(tri: DataFrame, begun: DataFrame) -> DataFrame:
    """(mesh_id, component, ray_no, face_id, ox, oy, oz, dx, dy, dz): a random point of the face and a direction off its front, evenly spread but not grazing."""
    return _lines(begun.join(tri.drop("component").hint("shuffle_hash"), ["mesh_id", "face_id"]))


def facet_lines(tri: DataFrame, allotted: DataFrame, settings: Settings) -> DataFrame:
    """What cast_lines makes of starts where every face is its own component, without shuffling a ray.

    With tri dealt by mesh, and allotted made of it, each face meets its rays' number in the task it is in and the rays are
    made after that. The face's number is compared in a way that is no key of the join, which would deal the faces anew.
    """
    some = allotted.where("rays > 0").select(F.col("mesh_id").alias("own_mesh"), "component", "rays", ray_key(settings.seed, F.col("mesh_id"), F.col("component")).alias("key"))
    same = (F.col("own_mesh") == F.col("mesh_id")) & (F.col("component").bitwiseXOR(F.col("face_id")) == 0)
    begun = some.join(tri.drop("component").hint("shuffle_hash"), same).drop("mesh_id").withColumnRenamed("own_mesh", "mesh_id")
    begun = begun.withColumn("ray_no", F.explode(F.sequence(F.lit(0), F.col("rays").cast("int") - 1)))
    return _lines(begun.withColumns({f"u{k}": draw(F.col("key"), F.col("ray_no"), k) for k in range(4)}))


def _lines(at: DataFrame) -> DataFrame:
    """The lines of rays that stand beside their faces."""
    a, b, c = (vector(k) for k in "abc")
    root = F.sqrt("u0")
    origin = add(add(scale(a, 1.0 - root), scale(b, (1.0 - F.col("u1")) * root)), scale(c, F.col("u1") * root))
    at = at.withColumns(dict(zip(("ox", "oy", "oz"), origin, strict=True)))
    side = sub(b, a)
    at = at.withColumns({f"t{x}": v / norm(side) for x, v in zip(AXES, side, strict=True)} | {f"m{x}": F.col(f"n{x}") / F.col("dbl_area") for x in AXES})
    up = F.lit(GRAZING) + (1.0 - GRAZING) * F.col("u2")
    out = F.sqrt(1.0 - up * up)
    turn = F.lit(2.0 * math.pi) * F.col("u3")
    other = cross(vector("m"), vector("t"))
    direction = add(scale(vector("m"), up), add(scale(vector("t"), out * F.cos(turn)), scale(other, out * F.sin(turn))))
    at = at.withColumns(dict(zip(("dx", "dy", "dz"), direction, strict=True)))
    return at.select("mesh_id", "component", "ray_no", "face_id", "ox", "oy", "oz", "dx", "dy", "dz")
