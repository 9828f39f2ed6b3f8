"""What several operators need: saved intermediate tables and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = f"file://{tempfile.gettempdir()}/meshtide-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: the lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rejected rows, of some 100 bytes each, are broadcast up to so many; beyond, rows are shuffled to meet them.
FEW_ROWS = 250_000


def unused(columns: list[str], name: str) -> str:
    """A column name beginning with name that no column has, with underscores before it or not."""
    taken = {c.lower().lstrip("_") for c in columns}
    while name in taken:
        name += "x"
    return name


def without(docs: DataFrame, gone: DataFrame, keys: list[str], how: str = "left_anti") -> DataFrame:
    """The rows of docs whose keys are not among gone's (left_semi: are), nulls equal to nulls. gone has the columns keys, each with _ before it."""
    few = gone.count() <= FEW_ROWS
    met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return docs.join(F.broadcast(gone) if few else gone, met, how)


def keep_decided(docs: DataFrame, decided: DataFrame, own: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that decided(doc_id, own, kept) keeps, with all their columns; of rows that repeat a kept id and own one stays.

    own, of a row, tells the texts of one id apart. What is shuffled of docs is, where little is
    rejected, only rows that repeat.
    """
    keys = [unused(docs.columns, "keptbyid"), unused(docs.columns, "keptbyown")]
    rows = docs.select("*", F.col(id_col).alias(keys[0]), own.alias(keys[1]))
    each = decided.groupBy(F.col("doc_id").alias(f"_{keys[0]}"), F.col("own").alias(f"_{keys[1]}")).agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    each = saved(each.where("not kept or n > 1"), "decided")
    rows = without(rows, each.where("not kept").drop("kept", "n"), keys)
    several = each.where("kept").drop("kept", "n")
    if several.limit(1).count():
        rows = without(rows, several, keys).unionByName(without(rows, several, keys, "left_semi").dropDuplicates(keys))
    return rows.select(*docs.columns)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components as (node, component): component is the smallest node reachable.

    nodes has a column node; edges has a and b, of the same type. Rounds of large-star and
    small-star (each a grouping and a join, so no group is held in one task) shrink every
    component to a star around its smallest node; the number of rounds grows with the
    logarithm of a component's size.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # large star: every node tells its larger neighbours the smallest node it knows
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node links its smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    stars = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
