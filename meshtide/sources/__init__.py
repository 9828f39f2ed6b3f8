"""Sources and sinks: OFF files, numpy arrays, results tables, polygon binaries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.model import AXES, FACES, RESULTS, VERTICES


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, text): OFF files under a path or glob, one row per file, named by its stem."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return read.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("mesh_id"), "text")


def parse_off(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OFF texts (mesh_id, text): OFF, three counts, vertex lines, then face rows whose first number, 3, is dropped."""
    words = texts.select("mesh_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    counted = words.select("mesh_id", "w", F.col("w")[1].cast("int").alias("nv"), F.col("w")[2].cast("int").alias("nf"))

    def rows(n: str, first, width: int):
        numbers = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: F.struct(i.cast("bigint").alias("i"), *(F.get("w", first + i * width + k).alias(f"v{k}") for k in range(width))))

    vertices = counted.select("mesh_id", F.explode(rows("nv", F.lit(4), 3)).alias("r"))
    faces = counted.select("mesh_id", F.explode(rows("nf", F.lit(4) + 3 * F.col("nv"), 4)).alias("r"))
    return (
        vertices.select("mesh_id", F.col("r.i").alias("vertex_id"), *(F.col(f"r.v{k}").cast("double").alias(x) for k, x in enumerate(AXES))),
        faces.select("mesh_id", F.col("r.i").alias("face_id"), *(F.col(f"r.v{k + 1}").cast("bigint").alias(x) for k, x in enumerate("abc"))),
    )


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_off(read_texts(spark, path))


def format_off(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, text): meshes as OFF texts, coordinates to three decimals."""
    v = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("nv"), F.array_sort(F.collect_list(F.struct("vertex_id", F.format_string("%.3f %.3f %.3f", *AXES).alias("line")))).alias("v"))
    f = faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("nf"), F.array_sort(F.collect_list(F.struct("face_id", F.format_string("3 %d %d %d", "a", "b", "c").alias("line")))).alias("f"))
    lines = F.concat(F.array(F.lit("OFF"), F.format_string("%d %d 0", "nv", F.coalesce("nf", F.lit(0)))), F.col("v.line"), F.coalesce(F.col("f.line"), F.array().cast("array<string>")))
    return v.join(f, "mesh_id", "left").select("mesh_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def write_off(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One text a mesh under path/mesh_id=<name>/."""
    # the writer ends the text with the line's end that is taken off here
    texts = format_off(vertices, faces).select("mesh_id", F.regexp_replace("text", r"\n\z", "").alias("text"))
    texts.write.mode("overwrite").partitionBy("mesh_id").text(path)


def from_arrays(spark: SparkSession, mesh_id: str, vertices, faces) -> tuple[DataFrame, DataFrame]:
    """One mesh from anything numpy reads as n x 3 numbers and m x 3 corners; faces given as floats are truncated."""
    v = np.asarray(vertices, np.float64).reshape(-1, 3)
    f = np.asarray(faces).astype(np.int64).reshape(-1, 3)
    if len(f) and (f.min() < 0 or f.max() >= len(v)):
        raise IndexError("a face has a corner that is no vertex")
    if not np.isfinite(v).all():
        raise ValueError("a vertex has a coordinate that is not finite")
    vt = [(mesh_id, i, *map(float, p)) for i, p in enumerate(v)]
    ft = [(mesh_id, i, *map(int, p)) for i, p in enumerate(f)]
    return spark.createDataFrame(vt, VERTICES), spark.createDataFrame(ft, FACES)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results table from CSV with a header; blanks are null."""
    return spark.read.csv(path, header=True, schema=RESULTS)


def format_results(results: DataFrame) -> DataFrame:
    """The results table as text columns: scores to four decimals, times to three."""
    score = F.format_string("%.4f", "backfacingness")
    times = {k: F.when(F.col(k).isNotNull(), F.format_string("%.3f", k)) for k in ("seconds", "cpu_seconds")}
    return results.select("mass", "triangles", "method", score.alias("backfacingness"), *(v.alias(k) for k, v in times.items()))


def write_results(results: DataFrame, path: str) -> None:
    format_results(results).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


# fixed values of the format: kinds of geometry by how they are laid out, and the flags of extended codes
WKB_POINT, WKB_LINE, WKB_RINGS = frozenset([1]), frozenset([2]), frozenset([3, 17])
WKB_HAS_Z, WKB_HAS_M, WKB_HAS_ID = 0x80000000, 0x40000000, 0x20000000


class Cursor:
    """A place in a well-known binary that moves on as values are taken; the byte order changes with each geometry."""

    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def take(self, layout: str, n: int = 1) -> np.ndarray:
        kind = np.dtype(self.order + layout)
        found = np.frombuffer(self.data, kind, n, self.at)
        self.at += kind.itemsize * n
        return found

    def number(self) -> int:
        return int(self.take("u4")[0])

    def points(self, n: int, width: int) -> np.ndarray:
        return self.take("f8", n * width).reshape(n, width)

    def head(self) -> tuple[int, bool, bool]:
        """Kind of the geometry that begins here, and whether its points have z and m."""
        self.order = "<" if self.take("u1")[0] else ">"
        code = self.number()
        if code & WKB_HAS_ID:
            self.number()
        thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
        return kind, bool(code & WKB_HAS_Z) or thousands in (1, 3), bool(code & WKB_HAS_M) or thousands in (2, 3)


def read_rings(data: bytes) -> list[list[list[tuple[float, float, float]]]]:
    """Polygons of a well-known binary: each a list of rings without their closing corner. Points and lines have none; what any other kind holds is read in turn."""
    cursor, polygons, waiting = Cursor(data), [], 1
    while waiting:
        waiting -= 1
        kind, z, m = cursor.head()
        width = 2 + z + m
        if kind in WKB_POINT:
            cursor.points(1, width)
        elif kind in WKB_LINE:
            cursor.points(cursor.number(), width)
        elif kind in WKB_RINGS:
            rings = [cursor.points(cursor.number(), width) for _ in range(cursor.number())]
            solid = [np.column_stack([r[:, :2], r[:, 2] if z else np.zeros(len(r))]) for r in rings]
            polygons.append([list(map(tuple, (r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r).tolist())) for r in solid])
        else:  # members follow one another, and theirs before the next
            waiting += cursor.number()
    return polygons


def rings_of(shapes: DataFrame) -> DataFrame:
    """(shape_id, polygon, ring, i, x, y, z) of shapes(shape_id, wkb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (shape, p, r, i, *corner)
                for shape, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if data
                for p, rings in enumerate(read_rings(bytes(data)))
                for r, ring in enumerate(rings)
                for i, corner in enumerate(ring)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shape_id", "polygon", "ring", "i", "x", "y", "z"])

    kind = shapes.schema["shape_id"].dataType.simpleString()
    return shapes.select("shape_id", "wkb").mapInArrow(run, f"shape_id {kind}, polygon int, ring int, i int, x double, y double, z double")


def read_written(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of what write_off left under path: one file a mesh, named by its folder."""
    return parse_off(spark.read.text(path, wholetext=True).select(F.col("mesh_id").cast("string").alias("mesh_id"), F.col("value").alias("text")))


def find_geodatabase(spark: SparkSession, path: str) -> str:
    """The first geodatabase folder inside a zip file, as <path>/<folder>.gdb; ValueError if it holds none."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    names = zipfile.ZipFile(io.BytesIO(bytes(content))).namelist()
    folders = [before for before, inside, _ in (n.partition(".gdb/") for n in names) if inside]
    if not folders:
        raise ValueError(f"no geodatabase in {path}")
    return f"{path}/{folders[0]}.gdb"
