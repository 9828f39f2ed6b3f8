import numpy as np
import pytest
import shapes
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meshtide import plans, sources
from meshtide.model import FACES, VERTICES
from meshtide.operators import casting, components, prep, raster


def arrays(spark, quads, name="m"):
    return sources.from_arrays(spark, name, *shapes.mesh(quads))


def answer(spark, quads, **options):
    vertices, faces = shapes.mesh(quads)
    v, f = sources.from_arrays(spark, "m", vertices, faces)
    rows = sorted(plans.reorient_facets_raycast(v, f, **options).collect(), key=lambda r: r.face_id)
    flip = np.array([r.flip for r in rows])
    faces = np.where(flip[:, None], faces[:, ::-1], faces)
    assert (flip[::2] == flip[1::2]).all()
    return flip, [r.component for r in rows], shapes.normals(vertices, faces)


@pytest.mark.parametrize("strategy", ["sql", "arrow"])
def test_box_turns_outward(spark, strategy):
    flip, _, n = answer(spark, shapes.turned(shapes.BOX, 0, 2), strategy=strategy)
    assert flip.tolist() == [True, True, False, False, True, True] + [False] * 6
    assert (n[0] == [0, 0, -1]).all() and (n[4] == [0, -1, 0]).all()


def test_box_as_one_component(spark):
    flip, component, _ = answer(spark, shapes.turned(shapes.BOX, 0, 2), facet_wise=False, strategy="sql")
    assert set(component) == {0} and flip.sum() == 4
    flip, component, _ = answer(spark, shapes.turned(shapes.BOX, 0, 2), facet_wise=False, strategy="arrow")
    assert set(component) == {0} and flip.sum() == 4


def test_open_box_is_left_alone(spark):
    _, _, n = answer(spark, shapes.open_box())
    assert np.allclose(n[::2], [[0, -1, 0], [0, 1, 0], [0, 0, 1]])


@pytest.mark.parametrize("parity", [False, True])
def test_courtyard_walls_face_the_air(spark, parity):
    _, _, n = answer(spark, shapes.courtyard(), use_parity=parity, seed=7, strategy="sql")
    assert np.allclose(n[0], [0, -1, 0])
    assert np.allclose(n[2], [0, 1, 0])


def test_enclosed_wall_turns_to_the_farther_side(spark):
    inner = [(0.8, 0.2, 0.2), (0.8, 0.8, 0.2), (0.8, 0.8, 0.8), (0.8, 0.2, 0.8)]
    for strategy in ("sql", "arrow"):
        _, _, n = answer(spark, [*shapes.BOX, inner], strategy=strategy)
        assert np.allclose(n[12], [-1, 0, 0])


def test_seed_repeats_and_partitioning_does_not_matter(spark):
    v, f = arrays(spark, shapes.courtyard())
    one = plans.reorient_facets_raycast(v, f, seed=7, strategy="sql").orderBy("face_id").collect()
    two = plans.reorient_facets_raycast(v.repartition(5), f.repartition(3), seed=7, strategy="sql").orderBy("face_id").collect()
    assert one == two


def test_bad_corner_and_bad_coordinate(spark):
    vertices, faces = shapes.mesh(shapes.BOX)
    with pytest.raises(IndexError):
        sources.from_arrays(spark, "m", vertices, faces + len(vertices))
    v, _ = sources.from_arrays(spark, "m", vertices, faces)
    f = spark.createDataFrame([("m", 0, 0, 1, 99)], FACES)
    with pytest.raises(IndexError):
        plans.reorient_facets_raycast(v, f)
    with pytest.raises(ValueError):
        plans.reorient_facets_raycast(spark.createDataFrame([("m", 0, float("nan"), 0.0, 0.0)], VERTICES), spark.createDataFrame([], FACES))


def test_empty_and_flat_meshes(spark):
    v, f = spark.createDataFrame([], VERTICES), spark.createDataFrame([], FACES)
    assert plans.reorient_facets_raycast(v, f).count() == 0
    assert plans.measure_backfacingness(v, f).count() == 0
    v, f = sources.from_arrays(spark, "m", [[0, 0, 0], [1, 0, 0], [2, 0, 0]], [[0, 1, 2]])
    assert [r.flip for r in plans.reorient_facets_raycast(v, f, strategy="sql").collect()] == [False]
    assert plans.measure_backfacingness(v, f, 16).first().backfacingness == 0.0


def test_reorient_leaves_its_input(spark):
    v, f = arrays(spark, shapes.turned(shapes.BOX, 0, 2))
    before = sorted(f.collect())
    out = plans.reorient(v, f)
    assert sorted(f.collect()) == before and plans.measure_backfacingness(v, out, 32).first().backfacingness == 0.0


def test_backfacingness_of_boxes(spark):
    for which, wanted in (((), 0.0), (range(6), 1.0), ((0,), 1 / 6)):
        v, f = arrays(spark, shapes.turned(shapes.BOX, *which))
        assert abs(plans.measure_backfacingness(v, f, 64).first().backfacingness - wanted) < 1e-9
    v, f = arrays(spark, shapes.BOX)
    counts = {r["view"]: r["count"] for r in plans.draw_backfacing_views(v, f, 32).groupBy("view").count().collect()}
    assert len(counts) == 6 and counts[0] == counts[3] > 0


def test_degenerate_face_severs_its_edge(spark):
    faces = [("m", 0, 0, 1, 2), ("m", 1, 1, 0, 3), ("m", 2, 0, 0, 1)]
    assert prep.edge_pairs(spark.createDataFrame(faces[:2], FACES)).count() == 1
    assert prep.edge_pairs(spark.createDataFrame(faces, FACES)).count() == 0
    three = [*faces[:2], ("m", 2, 0, 1, 4)]
    assert prep.edge_pairs(spark.createDataFrame(three, FACES)).count() == 0


def test_rounds_agree_with_the_search(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6):
        for j in range(9):
            p = 10 * i + j
            for t, c in enumerate(((p, p + 1, p + 11), (p, p + 11, p + 10))):
                if rng.random() < 0.8:
                    rows.append(("g", len(rows), *(c[::-1] if rng.random() < 0.5 else c)))
                del t
    f = spark.createDataFrame(rows, FACES)
    assert sorted(components.orient_components(f).collect()) == sorted(components.propagate_components(f).collect())


def test_moebius_strip_is_one_component():
    n = 5
    strip = [(2 * i, 2 * i + 1, 2 * i + 3) if i < n - 1 else (2 * i, 2 * i + 1, 0) for i in range(n)] + [(2 * i, 2 * i + 3, 2 * i + 2) if i < n - 1 else (2 * i, 0, 1) for i in range(n)]
    wound, component = components.search(np.array(strip))
    assert component.max() == 0 and len(wound) == 2 * n


def test_dedupe_and_weld(spark):
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 2, 1, 0), ("m", 2, 1, 2, 3)], FACES)
    assert [tuple(r) for r in prep.dedupe_faces(f).orderBy("face_id").collect()] == [("m", 0, 0, 1, 2), ("m", 1, 1, 2, 3)]
    v = spark.createDataFrame([("m", 0, 0.0004, 0.0, 0.0), ("m", 1, 0.0, 0.0, 0.0), ("m", 2, 1.0, 0.0, 0.0), ("m", 3, 0.0, 1.0, 0.0)], VERTICES)
    welded, faces = prep.weld(v, f)
    assert welded.count() == 3 and faces.orderBy("face_id").first()[2:] == (0, 0, 2)


def test_off_files_and_stream(spark, tmp_path):
    v, f = arrays(spark, shapes.turned(shapes.BOX, 0))
    text = sources.format_off(v, f).first().text
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.off").write_text(text)
    rv, rf = sources.read_off(spark, str(tmp_path / "in"))
    assert rv.count() == 16 and sorted(r[1:] for r in rf.where("mesh_id = 'one'").collect()) == sorted(r[1:] for r in f.collect())
    from meshtide import streaming

    q = streaming.score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 32)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.mesh_id for r in got} == {"one", "two"} and all(abs(r.backfacingness - 1 / 6) < 1e-9 for r in got)


def test_results_csv_round_trip(spark, tmp_path):
    from meshtide.model import RESULTS

    rows = [("a", 10, "as published", 0.5, None, None), ("a", 10, "facet-wise", 0.0125, 1.5, 2.25)]
    sources.write_results(spark.createDataFrame(rows, RESULTS), str(tmp_path / "r"))
    assert sorted(map(tuple, sources.read_results(spark, str(tmp_path / "r")).collect()), key=lambda r: r[2]) == rows


def test_binary_polygons():
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    for order, mark in (("<", 1), (">", 0)):
        polygon = bytes([mark]) + struct.pack(order + "III", 3, 1, 4) + b"".join(struct.pack(order + "dd", *p) for p in ring)
        point = bytes([mark]) + struct.pack(order + "Idd", 1, 5, 5)
        both = bytes([mark]) + struct.pack(order + "II", 7, 2) + point + polygon
        assert sources.read_rings(both) == [[[(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]]]
        high = bytes([mark]) + struct.pack(order + "III", 1003, 1, 2) + struct.pack(order + "6d", 0, 0, 1, 2, 2, 2)
        assert sources.read_rings(high) == [[[(0.0, 0.0, 1.0), (2.0, 2.0, 2.0)]]]


def test_hierarchy_agrees_with_brute_force():
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 80, 3))
    o, d = rng.normal(size=(2, 300, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    own = rng.integers(0, 80, 300)
    front, back = np.full(300, np.inf), np.full(300, np.inf)
    hits = np.zeros(300, int)
    for k in range(80):
        e1, e2 = b[k] - a[k], c[k] - a[k]
        p = np.cross(d, e2)
        s = o - a[k]
        det = p @ e1
        u, q = (s * p).sum(1) / det, np.cross(s, e1)
        v, t = (d * q).sum(1) / det, q @ e2 / det
        ok = (u >= 0) & (v >= 0) & (u + v <= 1) & (own != k)
        front = np.where(ok & (t > 0), np.minimum(front, t), front)
        back = np.where(ok & (t < 0), np.minimum(back, -t), back)
        hits += ok
    tree = casting.Hierarchy(a, b, c)
    f, g = tree.cast(o, d, own, False)
    assert np.allclose(f, front) and np.allclose(g, back)
    line, _ = tree.cast(o, d, own, True)
    assert (np.bincount(line, minlength=300) == hits).all()
    assert casting.count_apart(np.array([0, 0, 0]), np.array([1.0, 1.000001, 2.0]), 1).tolist() == [2]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, 7)] * 3), min_size=1, max_size=20))
def test_search_winds_neighbours_to_agree(corners):
    wound, component = components.search(np.array(corners))
    assert all(set(w) == set(c) for w, c in zip(wound.tolist(), corners, strict=True))
    assert component[0] == 0 and set(component) == set(range(component.max() + 1))


def test_camera_sees_the_near_face(spark):
    v, f = arrays(spark, shapes.BOX)
    view = ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, -1.0, 0.0))  # from the south
    rows = raster.find_visible(prep.gather(v, f), view, 16).collect()
    assert rows and {r.face_id for r in rows} <= {4, 5}
    cut = raster.find_visible(prep.gather(v, f), view, 16, raster.cutting_planes(v, view))
    assert {r.face_id for r in cut.collect()} <= {6, 7}
