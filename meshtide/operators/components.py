"""Components of faces that share edges, wound to agree.

Two ways: a breadth-first search per mesh in a grouped Arrow function, exact for any mesh, and
rounds of label propagation over all meshes at once for meshes too large for one task. In
an orientable component whether a face is turned is the parity of disagreeing edges on any
path from its lowest face, so the rounds agree with the search; in a component that cannot be
oriented the answer depends on the order of the search, so the rounds hand such meshes to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.model import FACES
from meshtide.operators.prep import edge_pairs, wound_against
from meshtide.operators.staging import saved


def face_links(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each face over edges with two incidences from two faces: CSR offsets and faces, ascending, each once."""
    n = len(corners)
    edges = np.concatenate([corners[:, [0, 1]], corners[:, [1, 2]], corners[:, [2, 0]]])
    owner = np.tile(np.arange(n), 3)
    real = edges[:, 0] != edges[:, 1]
    edges, owner = np.sort(edges[real], axis=1), owner[real]
    order = np.lexsort((owner, edges[:, 1], edges[:, 0]))
    edges, owner = edges[order], owner[order]
    starts = np.flatnonzero(np.r_[True, (edges[1:] != edges[:-1]).any(axis=1)]) if len(edges) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(edges)])
    two = starts[sizes == 2]
    pairs = np.stack([owner[two], owner[two + 1]], 1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    links = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    return np.searchsorted(links[:, 0], np.arange(n + 1)), links[:, 1]


def disagree(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether two faces, row by row, have a directed edge in common as they are wound."""
    out = np.zeros(len(p), bool)
    for i in range(3):
        for j in range(3):
            out |= (p[:, i] == q[:, j]) & (p[:, (i + 1) % 3] == q[:, (j + 1) % 3])
    return out


def search(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners wound to agree and component numbers, for the faces of one mesh in order.

    Breadth first, a whole frontier at a time. A face is wound against the first face of the frontier that
    reaches it, and the next frontier stands in the order its faces were reached, so the visits are
    those of a queue, which decides the outcome where a component cannot be oriented.
    """
    n = len(corners)
    at, neighbours = face_links(corners)
    wound, component = corners.copy(), np.full(n, -1, np.int64)
    made, lowest = 0, 0
    while lowest < n:
        if component[lowest] >= 0:
            rest = np.flatnonzero(component[lowest:] < 0)
            if not len(rest):
                break
            lowest += int(rest[0])
        frontier = np.array([lowest])
        component[lowest] = made
        while len(frontier):
            count = at[frontier + 1] - at[frontier]
            source = np.repeat(frontier, count)
            reached = neighbours[np.repeat(at[frontier] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            new = component[reached] < 0
            reached, source = reached[new], source[new]
            _, first = np.unique(reached, return_index=True)
            first.sort()  # in order of being reached
            frontier, source = reached[first], source[first]
            turn = frontier[disagree(wound[source], wound[frontier])]
            wound[turn] = wound[turn][:, ::-1]
            component[frontier] = made
        made += 1
    return wound.astype(np.int64).reshape(-1, 3), component


def unorientable(faces: DataFrame, wound: DataFrame) -> DataFrame:
    """(mesh_id): meshes of which some neighbours still disagree as wound; they have a component that cannot be oriented."""
    return wound_against(wound, edge_pairs(faces)).where("against").select("mesh_id").distinct()


def orient_components(faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, a, b, c, component): faces wound to agree with their component's lowest face; numbers in order of lowest faces."""

    def run(key, table):
        table = table.sort_by("face_id")
        wound, component = search(np.stack([table[k].to_numpy() for k in "abc"], 1))
        return pa.table({"mesh_id": table["mesh_id"], "face_id": table["face_id"], **{k: pa.array(wound[:, i]) for i, k in enumerate("abc")}, "component": pa.array(component)})

    return faces.select("mesh_id", "face_id", "a", "b", "c").groupBy("mesh_id").applyInArrow(run, FACES + ", component bigint")


def propagate_components(faces: DataFrame, max_rounds: int = 200) -> DataFrame:
    """The same columns by rounds of joins, for meshes of any size.

    A mesh that turns out to have a component that cannot be oriented is given to the search, whose order
    decides there. Each face keeps the lowest face it has heard of and its parity to it. A round takes the
    best offer over the edges and then follows its root's own root, so rounds grow with the logarithm
    of a component's diameter in practice. Lineage is cut by a written table each round.
    """
    pairs = wound_against(faces, edge_pairs(faces)).select("mesh_id", "f1", "f2", F.col("against").cast("int").alias("w"))
    links = saved(pairs.union(pairs.select("mesh_id", "f2", "f1", "w")).toDF("mesh_id", "f", "g", "w"), "links")
    labels = saved(faces.select("mesh_id", F.col("face_id").alias("f"), F.col("face_id").alias("root"), F.lit(0).alias("turn")), "labels")
    before = None
    for _ in range(max_rounds):
        offers = links.join(labels.withColumnsRenamed({"f": "g"}), ["mesh_id", "g"]).select("mesh_id", "f", "root", F.col("turn").bitwiseXOR(F.col("w")).alias("turn"))
        best = offers.unionByName(labels).groupBy("mesh_id", "f").agg(F.min(F.struct("root", "turn")).alias("b")).select("mesh_id", "f", "b.*")
        best = saved(best, "labels")
        jump = best.select("mesh_id", F.col("f").alias("root"), F.col("root").alias("root2"), F.col("turn").alias("turn2"))
        labels = saved(best.join(jump, ["mesh_id", "root"]).select("mesh_id", "f", F.col("root2").alias("root"), F.col("turn").bitwiseXOR(F.col("turn2")).alias("turn")), "labels")
        state = labels.agg(F.sum(F.col("root").cast("decimal(38,0)")), F.sum("turn")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"propagate_components: no end after {max_rounds} rounds")
    order = Window.partitionBy("mesh_id").orderBy("root")
    out = faces.join(labels.withColumnRenamed("f", "face_id"), ["mesh_id", "face_id"])
    flip = F.col("turn") == 1
    wound = out.select("mesh_id", "face_id", F.when(flip, F.col("c")).otherwise(F.col("a")).alias("a"), "b", F.when(flip, F.col("a")).otherwise(F.col("c")).alias("c"), (F.dense_rank().over(order) - 1).cast("bigint").alias("component"))
    wound = saved(wound, "wound")
    odd = saved(unorientable(faces, wound), "unorientable")
    if not odd.limit(1).count():
        return wound
    return wound.join(odd, "mesh_id", "left_anti").unionByName(orient_components(faces.join(odd, "mesh_id", "left_semi")))
