"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short test item inside a long document is a question of containment, and plain MinHash
signatures of fixed length lose it: the longer the document, the smaller the Jaccard
similarity. Documents are therefore partitioned by size, and the length of the signature
grows with the partition: a document of n shingles has a one-permutation MinHash signature of
m bins, m the power of two from 2n up. A bin then holds half a shingle on average, so
each shingle of the item that the document contains is its bin's minimum with a probability
of at least 0.78. Items have a signature for each size of m; a document meets an item when
enough minima are equal, and pairs that meet are verified by the share of the item's
shingles that the document contains, shingle by shingle as text. Of an item of few shingles
too few minima may survive, so items of fewer than ten are looked up by all their shingles
and none is missed. Longer ones are missed at a share of 0.8 with a probability of
about 0.0002 at worst, at ten shingles.

All of it is DataFrame functions. Signatures of documents are made where they are read; only
equal minima are shuffled. Items' signatures and candidate documents are broadcast below a
checked size and joined by a shuffle above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.llm.shared import saved, unused, without

SHINGLE = 5
WORD = r"[^\x20\x09-\x0D]+"
#: Signatures have 2**LEAST_BITS bins at least; at most as many as the longest document present asks for.
LEAST_BITS = 7
#: Of an item's minima, the share that a candidate must have.
MEET = 0.2
#: Items of fewer distinct shingles are looked up by all of them, not by minima.
SHORT = 10
BROADCAST_ROWS = 2_000_000


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}', 0)"


def shingle_hashes(text: str, k: int = SHINGLE) -> Column:
    """Hashes of a text's word shingles, in order; an array is bound to a name by a transform of one element so that it is made once."""
    parts = ", ".join(f"wh[i + {j}]" for j in range(k))
    one = f"transform(sequence(0, size(wh) - {k}), i -> xxhash64({parts}))"
    return F.expr(rf"transform(array(transform({_words(text)}, w -> xxhash64(w))), wh -> if(size(wh) < {k}, cast(array() as array<bigint>), {one}))[0]".replace("\\", "\\\\"))


def shingle_texts(text: str, k: int = SHINGLE) -> Column:
    """The distinct word shingles of a text, joined by one space."""
    one = f"transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' '))"
    return F.expr(rf"array_distinct(transform(array({_words(text)}), w -> if(size(w) < {k}, cast(array() as array<string>), {one}))[0])".replace("\\", "\\\\"))


def minima(hashes: str, bits: str) -> Column:
    """The smallest hash of each of 2**bits bins that has one; the bin is the hash's leading bits, so a sorted array has bins in a row."""
    return F.expr(f"transform(array(sort_array({hashes})), s -> filter(s, (x, i) -> i = 0 or shiftrightunsigned(x, 64 - {bits}) <> shiftrightunsigned(s[greatest(i - 1, 0)], 64 - {bits})))[0]")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): documents that contain at least threshold of an item's shingles.

    Shingles are five consecutive words of the lower-cased text; n_shingles counts the item's
    distinct ones, n_shared those that the document has too. An item or document of fewer words
    (null or empty among them) has none and is in no pair. Repeated rows give one pair, null
    ids never pair. Empty tables give an empty result. Columns besides those named are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    t = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null")

    # a shingle begins with a word, a byte at least, and a space: no document has more than (bytes + 1) / 2
    longest = d.agg(F.max(F.octet_length("text"))).first()[0] or 0
    most_bits = max(LEAST_BITS, longest.bit_length())

    known = saved(t.select("item_id", shingle_hashes("text", shingle).alias("h"), shingle_texts("text", shingle).alias("item_shingles")).where("size(h) > 0"), "items")
    short = known.where(F.size("item_shingles") < SHORT).select("item_id", F.size("item_shingles").alias("n"), F.array_distinct("h").alias("h"))
    # should two shingles share a hash, the item needs one equal hash less
    needed = F.greatest(F.lit(1), F.ceil(threshold * F.col("n") - 1e-9).cast("int") - F.col("n") + F.size("h"))
    by_size = known.where(F.size("item_shingles") >= SHORT).select("item_id", "h", F.explode(F.sequence(F.lit(LEAST_BITS), F.lit(most_bits))).alias("bits"))
    by_minima = by_size.select("item_id", "bits", minima("h", "bits").alias("m")).select("item_id", "bits", F.greatest(F.lit(1), F.floor(MEET * F.size("m")).cast("int")).alias("needed"), F.explode("m").alias("least"))
    # bits of zero stand for all shingles
    signed = saved(by_minima.unionAll(short.select("item_id", F.lit(0).alias("bits"), needed.alias("needed"), F.explode("h").alias("least"))), "item-minima")
    few_items = signed.count() <= BROADCAST_ROWS

    hashed = d.select("doc_id", shingle_hashes("text", shingle).alias("h"))
    sized = hashed.select("doc_id", "h", F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(2.0 * F.greatest(F.size("h"), F.lit(1)))).cast("int")).alias("bits"))
    if signed.where("bits = 0").limit(1).count():
        both = F.concat(F.transform(minima("h", "bits"), lambda x: F.struct(F.col("bits"), x.alias("least"))), F.transform("h", lambda x: F.struct(F.lit(0).alias("bits"), x.alias("least"))))
        signatures = sized.select("doc_id", F.explode(both).alias("s")).select("doc_id", "s.bits", "s.least")
    else:
        signatures = sized.select("doc_id", "bits", F.explode(minima("h", "bits")).alias("least"))
    met = signatures.join(F.broadcast(signed) if few_items else signed, ["bits", "least"])
    # a repeated row or shingle counts again, which only lets a pair through to be verified
    candidates = met.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed")).where("n >= needed")
    candidates = saved(candidates.select("doc_id", "item_id"), "contamination-candidates")

    per_doc = candidates.groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids"))
    few_docs = candidates.count() <= BROADCAST_ROWS // 8
    texts = d.join(F.broadcast(per_doc) if few_docs else per_doc, "doc_id").select("doc_id", "item_ids", shingle_texts("text", shingle).alias("doc_shingles"))
    wanted = known.select("item_id", "item_shingles")
    pairs = texts.select("doc_id", "doc_shingles", F.explode("item_ids").alias("item_id")).join(F.broadcast(wanted) if few_items else wanted, "item_id")
    counted = pairs.select("doc_id", "item_id", F.size("item_shingles").alias("n_shingles"), F.size(F.array_intersect("item_shingles", "doc_shingles")).alias("n_shared"))
    verified = counted.where(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9)
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_shingles").cast("long").alias("n_shingles"), F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns.

    A row goes by its own text, whatever its id, null among them; rows that repeat go or stay together. A
    null or empty text, or one of fewer words than a shingle, stays. Empty tables of docs or items leave docs as
    they are. Columns may have any names.
    """
    own, key = F.unhex(F.sha2(F.col(text_col).cast("string"), 256)), unused(docs.columns, "ownsha")
    texts = docs.select(own.alias("sha"), F.col(text_col).alias("own_text"))
    gone = saved(contaminated(texts, items, threshold, "sha", "own_text").select(F.col("doc_id").alias(f"_{key}")).distinct(), "contaminated")
    return without(docs.select("*", own.alias(key)), gone, [key]).select(*docs.columns)
