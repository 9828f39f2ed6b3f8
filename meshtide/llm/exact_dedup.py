"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is normalised, cut into chunks at places its own content chooses, and described
by its recipe: the ordered list of its chunks' identifiers. Texts don't move to be compared: what
is shuffled is one small row per document and one per chunk. An identifier is the chunk's
64-bit hash; before recipes are compared, all chunks of the corpus are gathered by
identifier and each identifier is verified to stand for one SHA-256 digest and length.
Where chunks share an identifier, the texts that hold it are compared by digests instead.

Groups of any size are pre-aggregated before they are shuffled, and the join that tells
each document its group is salted, so a group of a third of all rows is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.llm.shared import keep_decided, saved

SPACES = r"[\x20\x09-\x0D]+"

#: The bytes whose multiple modulo 256 is below 64: a quarter of all, spread over any alphabet.
_CUT = ["".join(f"\\x{b:02X}" for b in range(256) if b * m % 256 < 64) for m in (89, 211)]
#: Over a text's bytes: a chunk ends after two bytes of two such sets, 512 bytes at least and 8,192 at most. Words, spaces or a language play no part.
CHUNK = rf"(?s).{{512,8191}}?[{_CUT[0]}][{_CUT[1]}]|.{{1,8192}}"
#: Parts into which the rows of a group are dealt.
SALTS = 16
#: Identifiers that stand for several chunks are told to all tasks up to so many.
FEW = 10_000


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: str = CHUNK) -> DataFrame:
    """(doc_id, ids array<long>, digests array<binary>, lengths array<int>, text_sha256, salt) per row; lengths in bytes."""
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    # a character a byte, so that patterns see bytes
    cut = base.select("doc_id", "norm", F.regexp_extract_all(F.decode(F.col("norm").cast("binary"), "ISO-8859-1"), F.lit(chunk), F.lit(0)).alias("chunks"))
    return cut.select(
        "doc_id",
        F.transform("chunks", lambda c: F.xxhash64(c)).alias("ids"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
        F.transform("chunks", lambda c: F.length(c)).alias("lengths"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
    )


def unverified_chunks(recipes: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk: (id, digests). Expected to be empty."""
    chunks = recipes.select(F.explode(F.arrays_zip("ids", "digests", "lengths")).alias("c")).select("c.*")
    seen = chunks.groupBy("ids").agg(F.min("digests").alias("lo"), F.max("digests").alias("hi"), F.min("lengths").alias("least"), F.max("lengths").alias("most"))
    return seen.where((F.col("lo") != F.col("hi")) | (F.col("least") != F.col("most"))).select(F.col("ids").alias("id"), F.array("lo", "hi").alias("digests"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: str = CHUNK) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical after each run of ASCII white space became one space;
    null counts as empty, and empty texts equal each other. Of equal texts the row with the
    smallest doc_id stays; a null doc_id counts as larger than any other. Rows that tie, as they repeat a
    doc_id and its text, are members like any other: all rows with the kept id are kept. A text of any
    length has a recipe of all its chunks. An empty table gives an empty result. Columns besides the two
    named are not read, so theirs may clash with those added.
    """
    recipes = saved(chunk_recipes(docs, id_col, text_col, chunk), "recipes")
    bad = [r.id for r in unverified_chunks(recipes).select("id").limit(FEW + 1).collect()]
    none = F.array().cast("array<binary>")
    # a text with such an identifier is described by digests, and so are all texts equal to it
    if not bad:
        ids, exact = F.col("ids"), none
    elif len(bad) <= FEW:
        unsure = F.arrays_overlap("ids", F.array(*map(F.lit, bad)))
        ids, exact = F.when(unsure, F.array().cast("array<long>")).otherwise(F.col("ids")), F.when(unsure, F.col("digests")).otherwise(none)
    else:
        ids, exact = F.array().cast("array<long>"), F.col("digests")
    rows = recipes.select("doc_id", "text_sha256", "salt", ids.alias("recipe"), exact.alias("exact")).withColumn("at", F.xxhash64("recipe", "exact"))
    # a group is told to those parts of its rows that there are: its row is found under each of their salts
    groups = rows.groupBy("at", "recipe", "exact").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.collect_set("salt").alias("salts"))
    groups = groups.withColumn("salt", F.explode("salts")).drop("salts")
    return rows.join(groups, ["at", "recipe", "exact", "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts.

    Null counts as empty. The decision is of a row's id and text, so an id that other texts use too or a
    null id goes by its own text; of rows that repeat the kept id and text one stays. An empty table
    gives an empty result. Columns may have any names.
    """
    decided = exact_duplicates(docs, id_col, text_col).select("doc_id", F.unhex("text_sha256").alias("own"), "kept")
    return keep_decided(docs, decided, F.unhex(F.sha2(normalised(F.col(text_col)), 256)), id_col)
