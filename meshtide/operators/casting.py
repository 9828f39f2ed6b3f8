"""Rays against triangles.

A front ray and the back ray of the same start lie on one line, so one intersection of the line
serves both: positive distances are the front's, negative ones the back's.

Two ways. In SQL the rays of a mesh meet its triangles in an equi-join on the mesh with the
Moeller-Trumbore test as expressions of generated code, for meshes of some hundred faces. For
larger ones an Arrow function per mesh and share of its rays walks a bounding volume hierarchy;
a mesh with many rays is dealt to many tasks, each with all its triangles and its own rays. Meshes
that would be a single leaf go through one call by the hundred, without a hierarchy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.functions import DRAWS, STRIDES, cross, dot, quantised, sub, vector
from meshtide.model import AXES, CORNERS, Settings
from meshtide.operators.rays import GRAZING

LINE_HITS = "mesh_id string, component bigint, front_escapes bigint, back_escapes bigint, front_distance bigint, back_distance bigint"
#: Rays a task of the Arrow way casts, about.
TASK_RAYS = 500_000
#: Rays that small meshes of one call cast, about.
FEW_RAYS = 200_000
LEAF = 16


def line_hits(lines: DataFrame, tri: DataFrame) -> DataFrame:
    """Each line with t, the signed distance to each other face of its mesh that it meets, and once with null.

    Steps of the test are columns of their own, so that each is computed once. Misses are left out before the groupings
    by line, which would else take a row for each pair; the line's own face, which is among tri, stays as the row with null.
    Lines and triangles are dealt by mesh; the groupings by line after it need no other shuffle.
    """
    other = tri.select("mesh_id", F.col("face_id").alias("hit_face"), *(f"{k}{x}" for k in CORNERS for x in AXES))
    own = lines.withColumnRenamed("mesh_id", "line_mesh")
    met = own.join(other.hint("shuffle_hash"), F.col("line_mesh") == F.col("mesh_id"), "left")
    named = lambda name, v: {f"{name}{x}": c for x, c in zip(AXES, v, strict=True)}
    a, b, c = (vector(k) for k in CORNERS)
    met = met.withColumns(named("e1", sub(b, a)) | named("e2", sub(c, a)) | named("s", sub(vector("o"), a)))
    met = met.withColumns(named("p", cross(vector("d"), vector("e2"))) | named("q", cross(vector("s"), vector("e1"))))
    met = met.withColumn("inverse", F.lit(1.0) / F.nullif(dot(vector("e1"), vector("p")), F.lit(0.0)))
    met = met.withColumns({"u": dot(vector("s"), vector("p")) * F.col("inverse"), "v": dot(vector("d"), vector("q")) * F.col("inverse"), "t": dot(vector("e2"), vector("q")) * F.col("inverse")})
    hit = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") + F.col("v") <= 1) & (F.col("t") != 0)
    itself = F.coalesce(F.col("face_id") == F.col("hit_face"), F.lit(True))
    # the task's number keeps Spark from pushing the filter into the join as one long expression
    met = met.select(F.col("line_mesh").alias("mesh_id"), "component", "ray_no", F.when(hit & ~itself, F.col("t")).alias("t"), itself.alias("itself"), F.spark_partition_id().alias("task"))
    return met.where("(t is not null or itself) and task >= 0").select("mesh_id", "component", "ray_no", "t")


def nearest_hits(lines: DataFrame, tri: DataFrame) -> DataFrame:
    """(mesh_id, component, ray_no, front, back): distance to the first hit either way, null where the ray escapes."""
    hits = line_hits(lines, tri)
    front, back = F.min(F.when(F.col("t") > 0, F.col("t"))), F.min(F.when(F.col("t") < 0, -F.col("t")))
    return hits.groupBy("mesh_id", "component", "ray_no").agg(front.alias("front"), back.alias("back"))


def crossings(lines: DataFrame, tri: DataFrame) -> DataFrame:
    """(mesh_id, component, ray_no, front, back): hits either way; a hit just past the last one counted, by 1e-5 of 1 and the distance, is the same."""
    hits = line_hits(lines, tri)

    def count(ts):
        zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("start"))

        def step(acc, t):
            return F.when(t >= acc["start"], F.struct((acc["n"] + 1).alias("n"), (t + 1e-5 * (1.0 + t)).alias("start"))).otherwise(acc)

        return F.aggregate(F.array_sort(ts), zero, step)["n"]

    gathered = hits.groupBy("mesh_id", "component", "ray_no").agg(F.collect_list(F.when(F.col("t") > 0, F.col("t"))).alias("f"), F.collect_list(F.when(F.col("t") < 0, -F.col("t"))).alias("b"))
    return gathered.select("mesh_id", "component", "ray_no", count(F.col("f")).alias("front"), count(F.col("b")).alias("back"))


def tally(nearest: DataFrame) -> DataFrame:
    """Per component and side: rays that escape, and how far the others go, quantised."""
    sides = []
    for side in ("front", "back"):
        sides += [F.count_if(F.col(side).isNull()).alias(f"{side}_escapes"), F.coalesce(F.sum(quantised(F.col(side))), F.lit(0)).alias(f"{side}_distance")]
    return nearest.groupBy("mesh_id", "component").agg(*sides).select("mesh_id", "component", "front_escapes", "back_escapes", "front_distance", "back_distance")


def tally_odd(crossed: DataFrame) -> DataFrame:
    """Per component and side: rays with an odd number of crossings."""
    return crossed.groupBy("mesh_id", "component").agg(F.sum(F.col("front") % 2).alias("front_odd"), F.sum(F.col("back") % 2).alias("back_odd"))


class Hierarchy:
    """Triangles in a tree of boxes, split at the median of the longest side, walked for many lines at once."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray):
        order = np.arange(len(a))
        middle = (a + b + c) / 3
        nodes: list[list[int]] = []  # first, last, left child (right is the next one), 0 for a leaf
        todo = [(0, len(a), -1)]
        while todo:
            first, last, slot = todo.pop()
            if slot < 0:
                slot = len(nodes)
                nodes.append([first, last, 0])
            if last - first <= LEAF:
                continue
            own = middle[order[first:last]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            cut = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own[:, axis], cut)]
            nodes[slot][2] = len(nodes)
            nodes += [[first, first + cut, 0], [first + cut, last, 0]]
            todo += [(first, first + cut, nodes[slot][2]), (first + cut, last, nodes[slot][2] + 1)]
        self.nodes = np.array(nodes)
        self.order = order
        self.a, self.e1, self.e2 = a[order], b[order] - a[order], c[order] - a[order]
        low, high = np.minimum(np.minimum(a, b), c)[order], np.maximum(np.maximum(a, b), c)[order]
        slack = 1e-9 * (1 + np.abs(high).max())
        self.low = np.array([low[f:g].min(axis=0) for f, g, _ in nodes]) - slack
        self.high = np.array([high[f:g].max(axis=0) for f, g, _ in nodes]) + slack

    def _met(self, o: np.ndarray, d: np.ndarray, own: np.ndarray, line: np.ndarray, face: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines and signed distances of the pairs that meet."""
        e1, e2, dd = self.e1[face], self.e2[face], d[line]
        p = np.cross(dd, e2)
        det = (e1 * p).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = o[line] - self.a[face]
            u = (s * p).sum(axis=1) / det
            q = np.cross(s, e1)
            v = (dd * q).sum(axis=1) / det
            t = (e2 * q).sum(axis=1) / det
            hit = (det != 0) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t != 0) & (self.order[face] != own[line])
        return line[hit], t[hit]

    def cast(self, o: np.ndarray, d: np.ndarray, own: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """Nearest distance ahead and behind of each line (infinite: none) or, with every, all hits as (line, t)."""
        front, back = np.full(len(o), np.inf), np.full(len(o), np.inf)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(divide="ignore"):
            inverse = 1.0 / d
        waves = [(np.arange(len(o)), np.zeros(len(o), np.int64))]
        while waves:
            line, node = waves.pop()
            with np.errstate(invalid="ignore"):
                x, y = (self.low[node] - o[line]) * inverse[line], (self.high[node] - o[line]) * inverse[line]
            near, far = np.fmin(x, y).max(axis=1), np.fmax(x, y).min(axis=1)
            keep = near <= far
            if not every:  # boxes behind the nearest hits either way are passed over
                keep &= (near <= front[line]) & (-far <= back[line])
            line, node = line[keep], node[keep]
            child = self.nodes[node, 2]
            leaf = child == 0
            l_line, l_node = line[leaf], node[leaf]
            if len(l_line):
                first, size = self.nodes[l_node, 0], self.nodes[l_node, 1] - self.nodes[l_node, 0]
                many = np.repeat(l_line, size)
                face = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                got, t = self._met(o, d, own, many, face)
                if every:
                    found.append((got, t))
                else:
                    np.minimum.at(front, got[t > 0], t[t > 0])
                    np.minimum.at(back, got[t < 0], -t[t < 0])
            line, child = line[~leaf], child[~leaf]
            if len(line):
                waves.append((np.concatenate([line, line]), np.concatenate([child, child + 1])))
        if every:
            return (np.concatenate([x for x, _ in found]), np.concatenate([t for _, t in found])) if found else (np.zeros(0, int), np.zeros(0))
        return front, back


class Few:
    """Meshes of at most LEAF faces, which stand one after the other in runs of the sizes given: each line meets every face of its mesh."""

    #: Lines that are met at once, so that steps stay in a processor's cache.
    LINES = 2048

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, sizes: np.ndarray):
        self.mesh = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(a)) - (np.cumsum(sizes) - sizes)[self.mesh]
        # a row a mesh, filled up with faces that nothing meets
        self.rows = np.zeros((9, len(sizes), sizes.max()))
        for k, x in enumerate((*a.T, *(b - a).T, *(c - a).T)):
            self.rows[k, self.mesh, self.place] = x

    def cast(self, o: np.ndarray, d: np.ndarray, own: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """As Hierarchy.cast, by the same steps."""
        front, back = np.full(len(o), np.inf), np.full(len(o), np.inf)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(o), self.LINES):
            f = own[i : i + self.LINES]
            ax, ay, az, e1x, e1y, e1z, e2x, e2y, e2z = (x[self.mesh[f]] for x in self.rows)
            ox, oy, oz, dx, dy, dz = (x[:, None] for x in (*o[i : i + self.LINES].T, *d[i : i + self.LINES].T))
            px, py, pz = dy * e2z - dz * e2y, dz * e2x - dx * e2z, dx * e2y - dy * e2x
            det = e1x * px + e1y * py + e1z * pz
            sx, sy, sz = ox - ax, oy - ay, oz - az
            with np.errstate(divide="ignore", invalid="ignore"):
                u = (sx * px + sy * py + sz * pz) / det
                qx, qy, qz = sy * e1z - sz * e1y, sz * e1x - sx * e1z, sx * e1y - sy * e1x
                v = (dx * qx + dy * qy + dz * qz) / det
                t = (e2x * qx + e2y * qy + e2z * qz) / det
                hit = (det != 0) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t != 0)
            hit[np.arange(len(f)), self.place[f]] = False
            if every:
                line, face = np.nonzero(hit)
                found.append((line + i, t[line, face]))
            else:
                front[i : i + len(f)] = np.where(hit & (t > 0), t, np.inf).min(axis=1)
                back[i : i + len(f)] = np.where(hit & (t < 0), -t, np.inf).min(axis=1)
        if every:
            return (np.concatenate([x for x, _ in found]), np.concatenate([t for _, t in found])) if found else (np.zeros(0, int), np.zeros(0))
        return front, back


def count_apart(line: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Hits of each of n lines along sorted distances, those just past the last one counted left out."""
    out = np.zeros(n, np.int64)
    # a line's only hit counts if it is not behind the start
    only = np.bincount(line, minlength=n)[line] == 1
    np.add.at(out, line[only & (t >= 0)], 1)
    line, t = line[~only], t[~only]
    order = np.lexsort((t, line))
    last, start = -1, 0.0
    for i, x in zip(line[order].tolist(), t[order].tolist(), strict=True):
        if i != last:
            last, start = i, 0.0
        if x >= start:
            out[i] += 1
            start = x + 1e-5 * (1 + x)
    return out


def draws(seed: int, names: list[tuple[str, int]], group: np.ndarray, ray_no: np.ndarray) -> np.ndarray:
    """The same numbers as functions.draw gives, a row for each ray; names: mesh and component of each group."""
    used, back = np.unique(group, return_inverse=True)
    keys = [hashlib.md5("{}|{}|{}".format(seed, *names[k]).encode()).digest() for k in used.tolist()]
    digits = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)[:, : 3 * DRAWS].reshape(-1, DRAWS, 3).astype(float)
    begin = (digits[:, :, 0] * 65536.0 + digits[:, :, 1] * 256.0 + digits[:, :, 2]) / 16777216.0
    return (begin[back] + ray_no[:, None].astype(float) * np.array(STRIDES)) % 1.0


def cast_in_arrow(tri: DataFrame, allotted: DataFrame, settings: Settings) -> DataFrame:
    """LINE_HITS by the Arrow way: the rays that rays.starts and rays.cast_lines describe, each share making its own only.

    With use_parity, front_escapes and back_escapes count odd crossings and distances are zero.
    """
    seed, parity = settings.seed, settings.use_parity
    shares = F.greatest(F.lit(1), F.ceil(F.sum("rays").over(Window.partitionBy("mesh_id")) / TASK_RAYS)).cast("int")
    rays = allotted.select("mesh_id", "component", "rays", shares.alias("shares"))
    dealt = tri.join(rays.hint("merge"), ["mesh_id", "component"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def run(batches: list[pa.RecordBatch], sizes: list[int]) -> pa.Table:
        """Tallies of one mesh and share, or of several whole small meshes, whose triangles stand in order of face_id; sizes: faces of each."""
        table = pa.Table.from_batches(batches)
        share, shares = (table[k][0].as_py() for k in ("share", "shares"))
        a, b, c = (np.stack([table[f"{k}{x}"].to_numpy() for x in AXES], 1) for k in CORNERS)
        component, area = table["component"].to_numpy(), np.floor(table["dbl_area"].to_numpy() * 1e6 + 0.5).astype(np.int64)
        # components of all meshes are numbered together
        mesh = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((component, mesh))
        new = np.concatenate([[True], (np.diff(component[order]) != 0) | (np.diff(mesh[order]) != 0)])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first_of = order[new]
        own_mesh, names = table["mesh_id"].take(first_of), component[first_of]
        before = np.concatenate([[0], np.cumsum(table["rays"].to_numpy()[first_of])])
        # faces with area in order of component and number, and how far their areas reach within the component
        order = np.lexsort((np.arange(len(number)), number))
        order = order[area[order] > 0]
        bounds = np.searchsorted(number[order], np.arange(len(names) + 1))
        reach = np.concatenate([[0], np.cumsum(area[order])])
        # this share's rays
        index = np.arange(share, before[-1], shares)
        group = np.searchsorted(before, index, "right") - 1
        u = draws(seed, list(zip(own_mesh.to_pylist(), names.tolist(), strict=True)), group, index - before[group])
        whole = reach[bounds]
        # the first face that reaches beyond the draw's part of the component's area
        target = u[:, 4] * (whole[group + 1] - whole[group])
        low, high = bounds[group].copy(), bounds[group + 1] - 1
        while (low < high).any():
            middle = (low + high) // 2
            beyond = reach[middle + 1] - whole[group] > target
            low, high = np.where(beyond, low, np.minimum(middle + 1, high)), np.where(beyond, middle, high)
        face = order[low]
        tree = Few(a, b, c, np.array(sizes)) if max(sizes) <= LEAF else Hierarchy(a, b, c)
        out = np.zeros((len(names), 4), np.int64)
        for i in range(0, len(face), 20_000):
            f, v, g = face[i : i + 20_000], u[i : i + 20_000], group[i : i + 20_000]
            root = np.sqrt(v[:, 0:1])
            o = (1 - root) * a[f] + (1 - v[:, 1:2]) * root * b[f] + v[:, 1:2] * root * c[f]
            n = np.cross(b[f] - a[f], c[f] - a[f])
            n /= np.linalg.norm(n, axis=1, keepdims=True)
            s = b[f] - a[f]
            s /= np.linalg.norm(s, axis=1, keepdims=True)
            up = GRAZING + (1 - GRAZING) * v[:, 2:3]
            flat, turn = np.sqrt(1 - up * up), 2 * np.pi * v[:, 3:4]
            d = up * n + flat * (np.cos(turn) * s + np.sin(turn) * np.cross(n, s))
            if parity:
                line, t = tree.cast(o, d, f, True)
                for k, own in ((0, t > 0), (1, t < 0)):
                    out[:, k] += np.bincount(g, count_apart(line[own], np.abs(t[own]), len(f)) % 2, len(names)).astype(np.int64)
            else:
                for k, x in enumerate(tree.cast(o, d, f, False)):
                    gone = np.isinf(x)
                    out[:, k] += np.bincount(g, gone, len(names)).astype(np.int64)
                    out[:, 2 + k] += np.bincount(g, np.floor(np.where(gone, 0, x) * 1e6 + 0.5), len(names)).astype(np.int64)
        return pa.table({"mesh_id": own_mesh, "component": pa.array(names), **{k: pa.array(out[:, i]) for i, k in enumerate(("front_escapes", "back_escapes", "front_distance", "back_distance"))}})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task holds the triangles of one mesh, or of small ones for one call
        held: list[pa.RecordBatch] = []
        few: list[pa.RecordBatch] = []
        sizes: list[int] = []
        asked = 0
        place = None

        def closed(last: bool) -> Iterator[pa.Table]:
            """What is ready once the mesh held is whole."""
            nonlocal held, few, sizes, asked
            size = sum(x.num_rows for x in held)
            if held and size <= LEAF and held[0].column("shares")[0].as_py() == 1:
                few += held
                sizes.append(size)
                asked += sum(int(x.column("rays").to_numpy().sum()) for x in held)
            elif held:
                yield run(held, [size])
            held = []
            if few and (last or asked >= FEW_RAYS or len(sizes) >= FEW_RAYS // 100):
                yield run(few, sizes)
                few, sizes, asked = [], [], 0

        for batch in batches:
            mesh, share = batch.column("mesh_id"), batch.column("share").to_numpy()
            code = mesh.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (share[1:] != share[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
                if a == b:
                    continue
                here = (mesh[a].as_py(), share[a])
                if held and here != place:
                    for done in closed(False):
                        yield from done.combine_chunks().to_batches()
                place = here
                held.append(batch.slice(a, b - a))
        for done in closed(True):
            yield from done.combine_chunks().to_batches()

    columns = ["mesh_id", "share", "shares", "face_id", "component", "dbl_area", "rays", *(f"{k}{x}" for k in CORNERS for x in AXES)]
    sorted_ = dealt.select(*columns).repartition("mesh_id", "share").sortWithinPartitions("mesh_id", "share", "face_id")
    partial = sorted_.mapInArrow(stream, LINE_HITS)
    return partial.groupBy("mesh_id", "component").agg(*(F.sum(k).alias(k) for k in ("front_escapes", "back_escapes", "front_distance", "back_distance")))
