"""No table that grows with the corpus is collected on the driver, however small Spark believes it to be."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshtide import plans as plans_of
from meshtide import queries
from meshtide.operators import casting, prep, raster

SF = "/root/testdata/sf0.001"
NAMES = [
    "p1_gather",
    "s3_bad_corners",
    "p5_apply_flips",
    "p6_turned",
    "p9_screen",
    "a7_flips",
    "j3_nearest_hit",
    "a4_escape_tally",
    "a5_escape_vote",
    "j4_crossings",
    "a6_parity_vote",
    "a1_component_area",
    "a2_mesh_area",
    "a3_ray_allotment",
    "p3_normals",
    "r14_signed_volume",
    "j9_evaluate_corpus",
    "x3_default_flips",
    "x1_arrow_flips",
    "x4_arrow_parity",
    "x2_arrow_flips_all",
]


def plans_run(spark, run):
    """The plans of all that run executes."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    found = store.executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_nothing_that_grows_is_broadcast(spark, name):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    plans = plans_run(spark, lambda: queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert plans and not [x for x in plans if "BroadcastHashJoin" in x]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("resolution", [7, 200])
def test_shown_counts_as_the_depth_test(spark, monkeypatch, resolution):
    """Pixels counted in depth buffers, also by bands of rows, are those of the depth test, and none of them is a row."""
    monkeypatch.setattr(raster, "BAND_PIXELS", 60 * 200)
    vertices, faces = queries.fields(spark, SF)
    screen = raster.screen_triangles(prep.gather(vertices, queries.doubled(faces)), resolution).cache()
    want = raster.depth_test(raster.fragments(screen, resolution)).groupBy("mesh_id").agg(F.count_if(F.col("shows") == 2), F.count(F.lit(1)))
    assert sorted(map(tuple, raster.shown(screen, resolution).collect())) == sorted(map(tuple, want.collect()))
    plans = plans_run(spark, lambda: plans_of.measure_backfacingness(vertices, faces, resolution).collect())
    assert not [x for x in plans if "px#" in x.replace("_px#", "")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_misses_are_left_out_before_the_grouping(spark):
    """Of the pairs of a line and a face only those that meet are rows, and one row a line more."""
    tri, lines = queries.box_lines(spark, SF)
    hits = casting.line_hits(lines, tri)
    asked, rows, met = lines.count(), hits.count(), hits.where("t is not null").count()
    assert rows == asked + met and met > 0
    assert hits.select("mesh_id", "component", "ray_no").distinct().count() == asked


@pytest.mark.parametrize("every", [False, True])
def test_few_meets_as_the_hierarchy(every):
    """Small meshes of one call are met as each is by its own hierarchy, faces without area too."""
    rng = np.random.default_rng(3)
    sizes = np.array([1, 12, 16, 3, 10])
    a, b, c = rng.normal(size=(3, sizes.sum(), 3))
    b[5] = a[5]
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(sizes.sum()), 150)
    o, d = a[own] + 0.1 * rng.normal(size=(len(own), 3)), rng.normal(size=(len(own), 3))
    got = casting.Few(a, b, c, sizes).cast(o, d, own, every)
    for first, last in zip(ends - sizes, ends, strict=True):
        mine = (own >= first) & (own < last)
        want = casting.Hierarchy(a[first:last], b[first:last], c[first:last]).cast(o[mine], d[mine], own[mine] - first, every)
        if every:
            here = mine[got[0]]
            place = np.cumsum(mine) - 1
            assert sorted(zip(place[got[0][here]], got[1][here], strict=True)) == sorted(zip(*want, strict=True))
        else:
            assert all((x[mine] == y).all() for x, y in zip(got, want, strict=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_evaluation_plans_one_method_at_a_time(spark):
    """No plan of the whole evaluation holds the drawing of two methods."""
    plans = plans_run(spark, lambda: queries.QUERIES["j9_evaluate_corpus"](spark, SF).collect())
    drawn = [x.split("== Initial Plan ==")[0].count("mapInArrow") + x.split("== Initial Plan ==")[0].count("MapInArrow") for x in plans]
    assert len([x for x in drawn if x]) >= 3
    assert "MapInArrow" not in plans[-1] and "mapInArrow" not in plans[-1]
