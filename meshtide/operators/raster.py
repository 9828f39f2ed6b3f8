"""Six orthographic views of a mesh and the share of backs they show."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.functions import dot, sub, vector
from meshtide.model import AXES, CORNERS
from meshtide.operators.prep import bounding_boxes

# fixed values: the six viewing axes and which way is up in each
VIEWS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1))
UPS = ((0, 1, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0), (1, 0, 0), (0, 1, 0))

#: A task's depth buffer has about so many pixels; a larger image is cut into bands of rows.
BAND_PIXELS = 1 << 20
#: Triangles whose boxes have up to so many pixels are drawn many at once.
SMALL = 256


def views(spark: SparkSession) -> DataFrame:
    """(view, ax, f*, s*, u*): axis, forward, side and up of the six views, six rows."""

    def cross(p, q):
        return (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])

    rows = []
    for i, (axis, up) in enumerate(zip(VIEWS, UPS, strict=True)):
        forward = tuple(-x for x in axis)
        side = cross(forward, up)
        rows.append((i, *map(float, axis), *map(float, forward), *map(float, side), *map(float, cross(side, forward))))
    return spark.createDataFrame(rows, "view int, " + ", ".join(f"{k}{x} double" for k in ("axis_", "f_", "s_", "u_") for x in AXES))


def screen_triangles(tri: DataFrame, resolution: int) -> DataFrame:
    """Triangles in each view: corners' window coordinates and depths, signed area, colour (1 front, 2 back), half extent r.

    Triangles seen edge-on and meshes without extent are left out.
    """
    box = bounding_boxes(tri).where("r > 0").select("mesh_id", *(f"centre_{x}" for x in AXES), "r")
    seen = tri.join(box.hint("merge"), "mesh_id").crossJoin(F.broadcast(views(tri.sparkSession)))  # six rows
    eye = tuple(F.col(f"centre_{x}") + F.col(f"axis_{x}") * (2.0 * F.col("r")) for x in AXES)
    added = {}
    for k in CORNERS:
        d = sub(vector(k), eye)
        added[f"{k}_px"] = (dot(vector("s_"), d) / F.col("r") + 1.0) / 2.0 * resolution
        added[f"{k}_py"] = (dot(vector("u_"), d) / F.col("r") + 1.0) / 2.0 * resolution
        added[f"{k}_pz"] = dot(vector("f_"), d)
    flat = seen.select("mesh_id", "face_id", "view", "r", *(v.alias(n) for n, v in added.items()))
    area = (F.col("b_px") - F.col("a_px")) * (F.col("c_py") - F.col("a_py")) - (F.col("b_py") - F.col("a_py")) * (F.col("c_px") - F.col("a_px"))
    return flat.withColumn("area", area).where("area <> 0").withColumn("shows", F.when(F.col("area") > 0, 1).otherwise(2))


def _boxed(screen: DataFrame, resolution: int) -> DataFrame:
    """screen with the pixels x0 to x1 and y0 to y1, ends excluded, around each triangle; those off the image are left out."""

    def bounds(k: str):
        cols = [F.col(f"{c}_p{k}") for c in CORNERS]
        return F.greatest(F.floor(F.least(*cols)), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest(*cols)), F.lit(resolution)).cast("int")

    x0, x1 = bounds("x")
    y0, y1 = bounds("y")
    return screen.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 < x1 and y0 < y1")


def fragments(screen: DataFrame, resolution: int) -> DataFrame:
    """(mesh_id, view, py, px, z, face_id, shows): pixels whose centre a triangle covers, edges included, within the depth range."""
    px, py = F.col("px") + 0.5, F.col("py") + 0.5
    boxed = _boxed(screen, resolution)
    # pixels are made a row at a time, so that a large triangle needs no long array; rows of a triangle, not
    # fragments, are shuffled, to where all fragments of an image row meet
    rows = boxed.withColumn("py", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    rows = rows.repartition(int(screen.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mesh_id", "view", "py")
    each = rows.withColumn("px", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    wa = ((F.col("b_px") - px) * (F.col("c_py") - py) - (F.col("b_py") - py) * (F.col("c_px") - px)) / F.col("area")
    wb = ((F.col("c_px") - px) * (F.col("a_py") - py) - (F.col("c_py") - py) * (F.col("a_px") - px)) / F.col("area")
    weighed = each.withColumns({"wa": wa, "wb": wb}).withColumn("wc", 1.0 - F.col("wa") - F.col("wb")).where("wa >= 0 and wb >= 0 and wc >= 0")
    z = F.col("wa") * F.col("a_pz") + F.col("wb") * F.col("b_pz") + F.col("wc") * F.col("c_pz")
    return weighed.withColumn("z", z).where((F.col("z") >= F.col("r")) & (F.col("z") <= 3.0 * F.col("r"))).select("mesh_id", "view", "py", "px", "z", "face_id", "shows")


def depth_test(made: DataFrame) -> DataFrame:
    """(mesh_id, view, py, px, shows): the nearest fragment of each pixel, of equally near ones the lowest face's."""
    return made.groupBy("mesh_id", "view", "py", "px").agg(F.min(F.struct("z", "face_id", "shows")).alias("n")).select("mesh_id", "view", "py", "px", F.col("n.shows").alias("shows"))


class Canvas:
    """Depths and colours of a band of rows. Triangles come in order of face_id, so of equally near ones the first stays."""

    def __init__(self, high: int, wide: int):
        self.z, self.shows = np.full((high, wide), np.inf), np.zeros((high, wide), np.uint8)
        self.box = [high, 0, wide, 0]

    def weigh(self, t: dict, i, x, y):
        """Depths at pixels, infinite where triangle i does not cover them or out of the depth range: the steps of fragments."""
        area = t["area"][i]
        dx, dy = {k: t[f"{k}_px"][i] - x for k in CORNERS}, {k: t[f"{k}_py"][i] - y for k in CORNERS}
        wa = (dx["b"] * dy["c"] - dy["b"] * dx["c"]) / area
        wb = (dx["c"] * dy["a"] - dy["c"] * dx["a"]) / area
        wc = 1.0 - wa
        wc -= wb
        inside = (wa >= 0) & (wb >= 0) & (wc >= 0)
        wa *= t["a_pz"][i]
        wb *= t["b_pz"][i]
        wc *= t["c_pz"][i]
        wa += wb
        wa += wc
        inside &= (wa >= t["r"][i]) & (wa <= 3.0 * t["r"][i])
        return wa, inside

    def large(self, t: dict, i: int, x0: int, x1: int, y0: int, y1: int, top: int) -> None:
        z, inside = self.weigh(t, i, np.arange(x0, x1) + 0.5, np.arange(y0, y1)[:, None] + 0.5)
        at = self.z[y0 - top : y1 - top, x0:x1]
        inside &= z < at
        np.copyto(at, z, where=inside)
        np.copyto(self.shows[y0 - top : y1 - top, x0:x1], np.uint8(t["shows"][i]), where=inside)

    def small(self, t: dict, first: int, last: int, y0: np.ndarray, y1: np.ndarray, top: int) -> None:
        """Triangles first to last at once."""
        x0, wide = t["x0"][first:last], t["x1"][first:last] - t["x0"][first:last]
        size = wide * (y1 - y0)
        k = np.repeat(np.arange(last - first), size)
        n = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        x, y = x0[k] + n % wide[k], y0[k] + n // wide[k]
        z, inside = self.weigh(t, k + first, x + 0.5, y + 0.5)
        at = (y - top) * self.z.shape[1] + x
        inside &= z < self.z.ravel()[at]
        at, z, k = at[inside], z[inside], k[inside]
        order = np.lexsort((k, z, at))
        at, z, k = at[order], z[order], k[order]
        new = np.r_[True, at[1:] != at[:-1]][: len(at)]
        self.z.ravel()[at[new]] = z[new]
        self.shows.ravel()[at[new]] = t["shows"][k[new] + first]

    def draw(self, t: dict, first: int, last: int, top: int) -> None:
        """Triangles first to last of the columns t; top is the number of the band's first row."""
        y0, y1 = np.maximum(t["y0"][first:last], top), np.minimum(t["y1"][first:last], top + len(self.z))
        x0, x1 = t["x0"][first:last], t["x1"][first:last]
        low, high, left, right = self.box
        self.box = [min(low, int(y0.min()) - top), max(high, int(y1.max()) - top), min(left, int(x0.min())), max(right, int(x1.max()))]
        little = (x1 - x0) * (y1 - y0) <= SMALL
        runs = [0, *(np.flatnonzero(little[1:] != little[:-1]) + 1).tolist(), last - first]
        for a, b in zip(runs, runs[1:], strict=False):
            if little[a]:
                for c in range(a, b, 1000):  # a quarter of a million pixels at once
                    d = min(b, c + 1000)
                    self.small(t, first + c, first + d, y0[c:d], y1[c:d], top)
            else:
                for i, *own in zip(range(a, b), x0[a:b].tolist(), x1[a:b].tolist(), y0[a:b].tolist(), y1[a:b].tolist(), strict=True):
                    self.large(t, first + i, *own, top)

    def taken(self) -> tuple[int, int]:
        """Pixels that show backs, pixels drawn; the canvas is blank after it."""
        low, high, left, right = self.box
        z, shows = self.z[low:high, left:right], self.shows[low:high, left:right]
        out = int(np.count_nonzero(shows == 2)), int(np.count_nonzero(shows))
        z[...], shows[...] = np.inf, 0
        self.box = [self.z.shape[0], 0, self.z.shape[1], 0]
        return out


def shown(screen: DataFrame, resolution: int) -> DataFrame:
    """(mesh_id, backs, drawn): how many pixels of all views show a back, and anything, as depth_test of fragments gives them.

    No pixel is a row: a task draws the triangles of one band of one view into a depth buffer of bounded size.
    """
    high = max(1, BAND_PIXELS // resolution)
    numbers = ("area", "r", *(f"{k}_p{x}" for k in CORNERS for x in AXES))
    whole = ("shows", "x0", "x1", "y0", "y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canvas, place, done = Canvas(high, resolution), None, []
        for batch in batches:
            if not len(batch):
                continue
            t = {k: batch.column(k).to_numpy() for k in (*numbers, *whole)}
            mesh, view, band = batch.column("mesh_id"), batch.column("view").to_numpy(), batch.column("band").to_numpy()
            code = mesh.dictionary_encode().indices.to_numpy()
            cuts = (np.flatnonzero((code[1:] != code[:-1]) | (view[1:] != view[:-1]) | (band[1:] != band[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(code)], strict=True):
                here = (mesh[a].as_py(), view[a], band[a])
                if place is not None and here != place:
                    done.append((place[0], *canvas.taken()))
                place = here
                canvas.draw(t, a, b, int(band[a]) * high)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["mesh_id", "backs", "drawn"])
                done = []
        if place is not None:
            backs, drawn = canvas.taken()
            yield pa.RecordBatch.from_arrays([pa.array([place[0]], pa.string()), pa.array([backs], pa.int64()), pa.array([drawn], pa.int64())], ["mesh_id", "backs", "drawn"])

    bands = F.explode(F.sequence(F.floor(F.col("y0") / high).cast("int"), F.floor((F.col("y1") - 1) / high).cast("int")))
    dealt = _boxed(screen, resolution).withColumn("band", bands).select("mesh_id", "view", "band", "face_id", *numbers, *whole)
    dealt = dealt.repartition(int(screen.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mesh_id", "view", "band").sortWithinPartitions("mesh_id", "view", "band", "face_id", "shows")
    return dealt.mapInArrow(run, "mesh_id string, backs bigint, drawn bigint").groupBy("mesh_id").agg(F.sum("backs").alias("backs"), F.sum("drawn").alias("drawn"))


def shares(counted: DataFrame, meshes: DataFrame) -> DataFrame:
    """(mesh_id, backfacingness) of what shown counted, 0 for a mesh of which nothing is drawn."""
    share = counted.select("mesh_id", F.try_divide("backs", "drawn").alias("share"))
    return meshes.select("mesh_id").distinct().join(share.hint("merge"), "mesh_id", "left").select("mesh_id", F.coalesce("share", F.lit(0.0)).alias("backfacingness"))


def backfacingness(pixels: DataFrame, meshes: DataFrame) -> DataFrame:
    """(mesh_id, backfacingness): the share of drawn pixels that show a back, 0 for a mesh of which nothing is drawn."""
    share = pixels.groupBy("mesh_id").agg((F.count_if(F.col("shows") == 2) / F.count(F.lit(1))).alias("share"))
    return meshes.select("mesh_id").distinct().join(share.hint("merge"), "mesh_id", "left").select("mesh_id", F.coalesce("share", F.lit(0.0)).alias("backfacingness"))


def camera(elevation: float = 30, azimuth: float = -55) -> tuple[tuple[float, float, float], ...]:
    """Right, up and toward the viewer of a camera that looks down at an angle, in degrees."""
    e, a = math.radians(elevation), math.radians(azimuth)
    toward = (math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e))
    right = (-math.sin(a), math.cos(a), 0.0)
    up = tuple(toward[(i + 1) % 3] * right[(i + 2) % 3] - toward[(i + 2) % 3] * right[(i + 1) % 3] for i in range(3))
    return right, up, toward


def cutting_planes(vertices: DataFrame, view: tuple[tuple[float, float, float], ...]) -> DataFrame:
    """(mesh_id, point_x .. point_z, away_x .. away_z): per mesh, a vertical plane through the middle, square to the viewer; what lies toward them is cut away."""
    x, y, _ = view[2]
    away = (x / math.hypot(x, y), y / math.hypot(x, y), 0.0)
    return vertices.groupBy("mesh_id").agg(*(((F.min(k) + F.max(k)) / 2.0).alias(f"point_{k}") for k in AXES)).select("*", *(F.lit(v).alias(f"away_{k}") for k, v in zip(AXES, away, strict=True)))


def find_visible(tri: DataFrame, view: tuple[tuple[float, float, float], ...], size: int, planes: DataFrame | None = None) -> DataFrame:
    """(mesh_id, py, px, face_id): the face each pixel shows, rows from the top, in an orthographic view that the mesh fills.

    With planes, as cutting_planes makes them, what lies on the side their normals point to is cut away pixel by pixel, and the
    frame is of the corners that are left. Faces are taken in order; one replaces another where it is nearer by more
    than a millionth of the mesh's depth, so faces drawn twice on one plane show the first.
    """
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    seen = tri.withColumns({f"{k}_{n}": dot(vector(k), lit(row)) for k in CORNERS for n, row in zip("uvw", view, strict=True)})
    if planes is None:
        seen = seen.withColumns({f"{k}_side": F.lit(0.0) for k in CORNERS})
    else:
        seen = seen.join(planes, "mesh_id").withColumns({f"{k}_side": dot(sub(vector(k), vector("point_")), vector("away_")) for k in CORNERS})
    least = lambda n, kept: F.min(F.least(*(F.when(F.col(f"{k}_side") <= 0, F.col(f"{k}_{n}")) if kept else F.col(f"{k}_{n}") for k in CORNERS)))
    most = lambda n, kept: F.max(F.greatest(*(F.when(F.col(f"{k}_side") <= 0, F.col(f"{k}_{n}")) if kept else F.col(f"{k}_{n}") for k in CORNERS)))
    # a mesh of which nothing is left is framed whole
    low, high = {n: F.coalesce(least(n, True), least(n, False)) for n in "uv"}, {n: F.coalesce(most(n, True), most(n, False)) for n in "uv"}
    frame = seen.groupBy("mesh_id").agg(
        *(((low[n] + high[n]) / 2.0).alias(f"middle_{n}") for n in "uv"),
        (F.lit(0.92 * size) / F.greatest(high["u"] - low["u"], high["v"] - low["v"])).alias("zoom"),
        (1e-6 * (most("w", False) - least("w", False) + 1.0)).alias("tie"),
    )
    placed = seen.join(frame, "mesh_id")
    placed = placed.withColumns({f"{k}_px": (F.col(f"{k}_u") - F.col("middle_u")) * F.col("zoom") + size / 2 for k in CORNERS} | {f"{k}_py": size / 2 - (F.col(f"{k}_v") - F.col("middle_v")) * F.col("zoom") for k in CORNERS})
    area = (F.col("b_px") - F.col("a_px")) * (F.col("c_py") - F.col("a_py")) - (F.col("b_py") - F.col("a_py")) * (F.col("c_px") - F.col("a_px"))

    def bounds(n: str):
        cols = [F.col(f"{k}_p{n}") for k in CORNERS]
        return F.greatest(F.floor(F.least(*cols)), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest(*cols)), F.lit(size)).cast("int")

    (x0, x1), (y0, y1) = bounds("x"), bounds("y")
    boxed = placed.withColumn("area", area).where("area <> 0").withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 < x1 and y0 < y1")
    rows = boxed.withColumn("py", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    each = rows.withColumn("px", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    px, py = F.col("px") + 0.5, F.col("py") + 0.5
    wa = ((F.col("b_px") - px) * (F.col("c_py") - py) - (F.col("b_py") - py) * (F.col("c_px") - px)) / F.col("area")
    wb = ((F.col("c_px") - px) * (F.col("a_py") - py) - (F.col("c_py") - py) * (F.col("a_px") - px)) / F.col("area")
    weighed = each.withColumns({"wa": wa, "wb": wb}).withColumn("wc", 1.0 - F.col("wa") - F.col("wb")).where("wa >= 0 and wb >= 0 and wc >= 0")
    mixed = lambda n: F.col("wa") * F.col(f"a_{n}") + F.col("wb") * F.col(f"b_{n}") + F.col("wc") * F.col(f"c_{n}")
    kept = weighed.withColumns({"z": mixed("w"), "side": mixed("side")}).where("side <= 0")
    layers = kept.groupBy("mesh_id", "py", "px").agg(F.array_sort(F.collect_list(F.struct("face_id", "z"))).alias("layers"), F.first("tie").alias("tie"))
    shown = F.aggregate("layers", F.struct(F.lit(-1).cast("bigint").alias("face_id"), F.lit(float("-inf")).alias("z")), lambda acc, x: F.when(x["z"] > acc["z"] + F.col("tie"), x).otherwise(acc))
    return layers.select("mesh_id", "py", "px", shown["face_id"].alias("face_id"))


def dense_views(pixels: DataFrame, resolution: int) -> DataFrame:
    """(mesh_id, view, image): each view's pixels as resolution * resolution bytes, row by row from the bottom; 0 where nothing is drawn."""

    def fill(key, table):
        image = np.zeros((resolution, resolution), np.uint8)
        image[table["py"].to_numpy(), table["px"].to_numpy()] = table["shows"].to_numpy()
        return pa.table({"mesh_id": pa.array([key[0].as_py()]), "view": pa.array([key[1].as_py()], pa.int32()), "image": pa.array([image.tobytes()], pa.binary())})

    return pixels.select("mesh_id", "view", "py", "px", "shows").groupBy("mesh_id", "view").applyInArrow(fill, "mesh_id string, view int, image binary")


def views_array(pixels: DataFrame, mesh_id: str, resolution: int) -> np.ndarray:
    """One mesh's six views as an array of 6 x resolution x resolution bytes, on the driver."""
    out = np.zeros((6, resolution, resolution), np.uint8)
    for r in dense_views(pixels.where(F.col("mesh_id") == mesh_id), resolution).collect():  # six rows
        out[r["view"]] = np.frombuffer(r["image"], np.uint8).reshape(resolution, resolution)
    return out


def png(image: np.ndarray) -> bytes:
    """A picture file of an image of bytes, rows from the top: grey (two axes) or red, green and blue (three)."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    rows = np.column_stack([np.zeros(height, np.uint8), image.reshape(height, -1)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
