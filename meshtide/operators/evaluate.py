"""Questions over a table of results: results(mass, triangles, method, backfacingness, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.operators.staging import saved


def by_method(results: DataFrame, methods: list[str]) -> DataFrame:
    """A row per mass, its triangles and a column of scores per method."""
    return results.groupBy("mass").agg(F.max("triangles").alias("triangles"), *(F.max(F.when(F.col("method") == m, F.col("backfacingness"))).alias(m) for m in methods))


def summary(results: DataFrame) -> DataFrame:
    """Per method: mean score, population deviation, masses."""
    return results.groupBy("method").agg(F.avg("backfacingness").alias("mean"), F.stddev_pop("backfacingness").alias("deviation"), F.count(F.lit(1)).alias("masses"))


def largest_mixed(wide: DataFrame, method: str, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """The mass with the most triangles among those that score between low and high."""
    return wide.where(F.col(method).between(low, high)).orderBy(F.desc("triangles"), "mass").limit(1)


def most_improved(wide: DataFrame, before: str, after: str, k: int = 3) -> DataFrame:
    return wide.withColumn("change", F.col(after) - F.col(before)).orderBy("change", "mass").limit(k)


def worst(wide: DataFrame, method: str, k: int = 3) -> DataFrame:
    return wide.orderBy(F.desc(method), "mass").limit(k)


def widest_apart(wide: DataFrame, one: str, two: str) -> DataFrame:
    """The masses where one method exceeds the other most, either way: a single aggregation."""
    apart = F.col(one) - F.col(two)
    return wide.agg(F.max_by("mass", F.struct(apart, F.col("mass"))).alias("highest"), F.min_by("mass", F.struct(apart, F.col("mass"))).alias("lowest"))


def ray_budget(runs: DataFrame) -> DataFrame:
    """Per ray budget: fastest run and mean score, of runs(rays, backfacingness, seconds)."""
    return runs.groupBy("rays").agg(F.min("seconds").alias("seconds"), F.avg("backfacingness").alias("backfacingness"))


def select_corpus(scored: DataFrame, keep: int = 50, smallest: int = 300, largest_kept: int = 10) -> DataFrame:
    """(mass, reason): the largest masses, then of the others the most mixed with enough triangles."""
    large = scored.orderBy(F.desc("triangles"), "mass").limit(largest_kept).select("mass", F.lit("largest").alias("reason"))
    rest = scored.join(large.select("mass"), "mass", "left_anti").where(F.col("triangles") >= smallest)
    mixed = rest.orderBy(F.desc(F.least("backfacingness", 1 - F.col("backfacingness"))), "mass").limit(keep).select("mass", F.lit("mixed").alias("reason"))
    return large.unionByName(mixed)


def placed(table: DataFrame, *keys: str) -> DataFrame:
    """table with place, from 1, in the order of the keys. The table is sorted by ranges into many tasks; only their sizes meet."""
    dealt = saved(table.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()), "placed")
    # one row a range; its first number and how many rows are before it
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("first"))
    before = parts.select("part", "first", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return dealt.join(F.broadcast(before), "part").withColumn("place", F.col("n") - F.col("first") + F.col("before") + 1).drop("part", "n", "first", "before")
