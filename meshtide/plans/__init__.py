"""The public API: whole plans over vertices and faces of any number of meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.model import Settings, validate
from meshtide.operators import casting, components, prep, raster, rays, voting
from meshtide.operators.staging import saved

#: Rays are cast in SQL in meshes of up to so many faces, by the Arrow way in larger ones and in those of one leaf.
SQL_FACES = 500


def wind(faces: DataFrame, settings: Settings) -> DataFrame:
    """faces with component and turned; facet-wise each face is its own component and none is turned."""
    if settings.facet_wise:
        return faces.select("mesh_id", "face_id", "a", "b", "c", F.col("face_id").alias("component"), F.lit(False).alias("turned"))
    wound = components.orient_components(faces)
    return wound.join(prep.turned(faces, wound).hint("merge"), ["mesh_id", "face_id"])


def _votes(tri: DataFrame, settings: Settings, strategy: str) -> DataFrame:
    """(mesh_id, component, vote) of wound triangles with component and dbl_area."""
    if strategy == "sql":
        tri = tri.repartition("mesh_id")
        allotted = rays.allot(tri, settings)
        lines = rays.facet_lines(tri, allotted, settings) if settings.facet_wise else rays.cast_lines(tri, rays.starts(tri, allotted, settings))
        if settings.use_parity:
            return voting.parity_votes(casting.tally_odd(casting.crossings(lines, tri)))
        return voting.escape_votes(casting.tally(casting.nearest_hits(lines, tri)))
    tallied = casting.cast_in_arrow(tri, rays.allot(tri, settings), settings)
    if settings.use_parity:
        return voting.parity_votes(tallied.withColumnsRenamed({"front_escapes": "front_odd", "back_escapes": "back_odd"}))
    return voting.escape_votes(tallied)


def reorient_facets_raycast(vertices: DataFrame, faces: DataFrame, check: bool = True, **options) -> DataFrame:
    """(mesh_id, face_id, flip, component): which faces to flip so that all face outward. Options as in Settings.

    A mesh's answer depends on itself and the settings alone: rays are the same either way of casting them, and the
    way is chosen for each mesh by its own number of faces. Wound faces and triangles are made once and saved.
    """
    settings = Settings(**options)
    if check:
        validate(vertices, faces)
    wound = wind(faces, settings)
    if not settings.facet_wise:
        wound = saved(wound, "wound")
    tri = saved(prep.with_normals(prep.gather(vertices, wound, "component")), "triangles")
    if settings.strategy != "auto":
        votes = _votes(tri, settings, settings.strategy)
    else:
        by_sql = F.col("count").between(casting.LEAF + 1, SQL_FACES)
        sizes = saved(tri.groupBy("mesh_id").count(), "sizes")
        others = sizes.where(~by_sql).select("mesh_id").hint("merge")
        all_sql, no_sql = sizes.agg(F.coalesce(F.every(by_sql), F.lit(True)), F.coalesce(~F.some(by_sql), F.lit(True))).first()
        if all_sql:
            votes = _votes(tri, settings, "sql")
        elif no_sql:
            votes = _votes(tri, settings, "arrow")
        else:
            votes = _votes(tri.join(others, "mesh_id", "left_anti"), settings, "sql").unionByName(_votes(tri.join(others, "mesh_id", "left_semi"), settings, "arrow"))
    return voting.flips(wound.select("mesh_id", "face_id", "component", "turned"), votes)


def reorient(vertices: DataFrame, faces: DataFrame, **options) -> DataFrame:
    """faces with those reversed that reorient_facets_raycast flips."""
    return prep.apply_flips(faces, reorient_facets_raycast(vertices, faces, **options))


def orient_components(faces: DataFrame) -> DataFrame:
    """faces wound to agree with their neighbours, and their component."""
    return components.orient_components(faces)


def draw_backfacing_views(vertices: DataFrame, faces: DataFrame, resolution: int = 1024) -> DataFrame:
    """(mesh_id, view, py, px, shows): drawn pixels of the six views, 1 front or 2 back; rows count from the bottom."""
    tri = prep.gather(vertices, faces)
    return raster.depth_test(raster.fragments(raster.screen_triangles(tri, resolution), resolution))


def measure_backfacingness(vertices: DataFrame, faces: DataFrame, resolution: int = 1024) -> DataFrame:
    """(mesh_id, backfacingness): the share of what six views see that is the backs of faces."""
    meshes = vertices.select("mesh_id").union(faces.select("mesh_id"))
    return raster.shares(raster.shown(raster.screen_triangles(prep.gather(vertices, faces), resolution), resolution), meshes)


# fixed values: the settings of each method of the evaluation
METHODS = {"facet-wise": {}, "components": {"facet_wise": False}, "parity": {"use_parity": True}}


def evaluate_corpus(vertices: DataFrame, faces: DataFrame, resolution: int = 1024, methods: dict[str, dict] | None = None) -> DataFrame:
    """(mass, triangles, method, backfacingness) of deduplicated meshes, as published and after each method.

    Faces and each method's scores are saved, so that the driver plans and watches one method at a time.
    """
    faces = saved(prep.dedupe_faces(faces), "faces")
    sizes = faces.groupBy(F.col("mesh_id").alias("mass")).agg(F.count(F.lit(1)).cast("int").alias("triangles"))
    rows = []
    for name, options in [("as published", None), *(METHODS if methods is None else methods).items()]:
        turned = faces if options is None else reorient(vertices, faces, **options)
        scores = saved(measure_backfacingness(vertices, turned, resolution), "scores")
        rows.append(scores.select(F.col("mesh_id").alias("mass"), F.lit(name).alias("method"), "backfacingness"))
    made = rows[0]
    for row in rows[1:]:
        made = made.unionByName(row)
    return made.join(sizes.hint("merge"), "mass").select("mass", "triangles", "method", "backfacingness")
