"""Which side of a component is outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.functions import cross, dot, quantised, vector


def escape_votes(tallied: DataFrame) -> DataFrame:
    """(mesh_id, component, vote): turn where fewer rays escape from the front or, at a tie, travel less far; a full tie stays."""
    f, b = F.col("front_escapes"), F.col("back_escapes")
    return tallied.select("mesh_id", "component", ((f < b) | ((f == b) & (F.col("front_distance") < F.col("back_distance")))).alias("vote"))


def parity_votes(tallied: DataFrame) -> DataFrame:
    """(mesh_id, component, vote): turn where more front rays than back rays cross an odd number of faces."""
    return tallied.select("mesh_id", "component", (F.col("front_odd") > F.col("back_odd")).alias("vote"))


def flips(faces: DataFrame, votes: DataFrame) -> DataFrame:
    """(mesh_id, face_id, flip, component) of faces(mesh_id, face_id, component, turned): the component's vote, the other way round where the face was turned."""
    joined = faces.join(votes.hint("merge"), ["mesh_id", "component"], "left")
    return joined.select("mesh_id", "face_id", (F.coalesce("vote", F.lit(False)) != F.col("turned")).alias("flip"), "component")


def volume_votes(tri: DataFrame) -> DataFrame:
    """(mesh_id, component, vote): turn a component whose signed volume, of the solids between its faces and the origin, is below zero."""
    six = F.sum(quantised(dot(vector("a"), cross(vector("b"), vector("c")))))
    return tri.groupBy("mesh_id", "component").agg((six < 0).alias("vote"))


def centre_votes(tri: DataFrame) -> DataFrame:
    """(mesh_id, component, vote): turn a component whose faces, by area, look toward its centre more than away from it."""
    thrice = {f"m{x}": F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}") for x in "xyz"}
    each = tri.withColumns(thrice)
    # sum of n . (m - centre) is sum of n . m less sum of n . centre, so one grouping serves
    out = F.sum(quantised(dot(vector("n"), vector("m"))))
    normals = [F.sum(quantised(F.col(f"n{x}"))) for x in "xyz"]
    centres = [F.sum(quantised(F.col(f"m{x}") * F.col("dbl_area"))) for x in "xyz"]
    area = F.sum(quantised(F.col("dbl_area")))
    toward = out.cast("double") - sum(n.cast("double") * (c.cast("double") / F.nullif(area.cast("double"), F.lit(0.0))) for n, c in zip(normals, centres, strict=True))
    return each.groupBy("mesh_id", "component").agg(F.coalesce(toward < -1.0, F.lit(False)).alias("vote"))
