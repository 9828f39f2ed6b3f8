"""Meshes as they arrive: a stream of OFF files, each scored or reoriented in the micro-batch that brings it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshtide import plans
from meshtide.sources import parse_off


def read_mesh_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """(mesh_id, text) of OFF files as they appear under path."""
    read = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
    return read.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("mesh_id"), F.col("value").alias("text"))


def process(stream: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run work(vertices, faces) on every micro-batch and append its rows to a Parquet table, once per batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        work(*parse_off(batch)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, resolution: int = 256) -> StreamingQuery:
    return process(read_mesh_stream(spark, path), lambda v, f: plans.measure_backfacingness(v, f, resolution), sink, checkpoint)


def reorient_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, **options) -> StreamingQuery:
    return process(read_mesh_stream(spark, path), lambda v, f: plans.reorient_facets_raycast(v, f, **options), sink, checkpoint)
