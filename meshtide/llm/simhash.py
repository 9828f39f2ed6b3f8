"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most
``max_bits`` = 3 bits differ in at most three bytes, so they share at least five positional
bytes: that is the guaranteed minimum a pair's tally must reach. A list for each single
(position, byte) would hold every 256th fingerprint, and tallying over its pairs would grow
with the square of the corpus. The lists are therefore intersected several at a time. First
four at a time: every choice of five positions holds one of fourteen choices of four, so two
fingerprints with a tally of five share a posting of four. The pair of a posting that two
fingerprints share has its shared positional bytes tallied, and is retained if the tally
reaches the minimum. A posting that more share is intersected with a fifth position first;
there every pair is tallied in the same way. Retained pairs are verified, bit by bit.

Equal fingerprints are one entry of the index, however many documents have them. A posting
of five positions leaves three bytes open, so it never holds more than 2**24 entries; inside
one, not all pairs are written but a spanning forest of the links, as the result is components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.llm.arrowtext import ascii_lower, slices, spaced_words, utf8, word_spans
from meshtide.llm.shared import components, keep_decided, saved
from meshtide.llm.xxh64 import xxh64_spans

BYTES = 8
SHINGLE = 3
#: Shingles summed in one 16-bit counter at most.
CHUNK = 60_000
#: Postings up to this size are compared entry by entry in memory, larger ones by looking up each entry's neighbours.
DIRECT = 2_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text: a bit is set where over half of the shingles' hashes have it."""
    data, at = utf8(column)
    starts, ends, first = word_spans(data, at)
    data, starts, ends = spaced_words(ascii_lower(data), starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(n)), n)
    before = np.concatenate([[0], np.cumsum(n)])
    begin = first[row] + np.arange(before[-1]) - before[row]
    end = np.minimum(begin + shingle, first[row + 1]) - 1
    h = xxh64_spans(data, starts[begin], ends[end]) if len(begin) else np.zeros(0, np.uint64)
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    # counters: sixteen bits each, four to a word; a chunk is part of one row and small enough not to overflow
    chunks = np.unique(np.concatenate([before[:-1][n > 0], *(np.arange(b, b + k, CHUNK) for b, k in zip(before[:-1][n > CHUNK].tolist(), n[n > CHUNK].tolist(), strict=True))]))
    rows, back = np.unique(row[chunks], return_inverse=True)
    ones = np.zeros((len(rows), 64), np.int64)
    mask = np.uint64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((h >> np.uint64(k)) & mask, chunks)
        for lane in range(4):
            part = ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            ones[:, 16 * lane + k] = np.bincount(back, part, len(rows)).astype(np.int64)
    set_bits = 2 * ones > n[rows][:, None]
    out[rows] = (set_bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) per row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["doc_id", "fp"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fp long")


def spanning_links(values: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs of indices of a spanning forest of the links between distinct values of one posting."""
    n = len(values)
    least = BYTES - max_bits
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []

    def link(left: np.ndarray, right: np.ndarray) -> None:
        roots_differ = parent[left] != parent[right]
        for i, j in zip(left[roots_differ].tolist(), right[roots_differ].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((i, j))

    if n <= DIRECT:
        positional = values.view(np.uint8).reshape(n, BYTES)
        for i in range(n - 1):
            tally = (positional[i + 1 :] == positional[i]).sum(axis=1)
            near = np.flatnonzero(tally >= least) + i + 1
            near = near[np.bitwise_count(values[near] ^ values[i]) <= max_bits]
            link(np.full(len(near), i), near)
    else:
        varying = np.bitwise_or.reduce(values ^ values[0])
        bits = [np.uint64(1) << np.uint64(k) for k in range(64) if int(varying) >> k & 1]
        order = np.argsort(values)
        ordered = values[order]
        for size in range(1, max_bits + 1):
            for own in combinations(bits, size):
                flipped = values ^ np.bitwise_or.reduce(np.array(own, np.uint64))
                at = np.minimum(np.searchsorted(ordered, flipped), n - 1)
                # values that differ in these bits share the bytes without them, the guaranteed minimum at least
                hit = np.flatnonzero((ordered[at] == flipped) & (flipped > values))
                link(hit, order[at[hit]])
    return np.array(found, np.int64).reshape(-1, 2)


def covering_choices(size: int, of: int = BYTES) -> list[tuple[int, ...]]:
    """Choices of size - 1 positions such that every choice of size positions holds one of them, found greedily."""
    open_ = set(combinations(range(of), size))
    made = []
    while open_:
        best = max(combinations(range(of), size - 1), key=lambda c: (sum(set(c) <= set(x) for x in open_), c))
        made.append(best)
        open_ = {x for x in open_ if not set(best) <= set(x)}
    return made


def _key(positions: tuple[int, ...]) -> Column:
    """The posting's key: the positions and their bytes, hashed; two postings under one key do no harm, as pairs are verified."""
    return F.xxhash64(F.lit(sum(1 << k for k in positions)), F.col("fp").bitwiseAND(F.lit(_signed(sum(0xFF << 8 * k for k in positions)))))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of a pair: at how many of the eight positions both have the same byte."""
    differing = a.bitwiseXOR(b)
    same = [F.when(differing.bitwiseAND(F.lit(_signed(0xFF << 8 * k))) == 0, 1).otherwise(0) for k in range(BYTES)]
    return sum(same[1:], same[0])


def fingerprint_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) that differ in at most max_bits bits, max_bits < 7."""
    least = BYTES - max_bits
    choices = covering_choices(least)
    postings = fps.select("fp", F.posexplode(F.array(*map(_key, choices))).alias("choice", "key"))
    shared = postings.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = saved(postings.join(shared, ["choice", "key"]), "simhash-met")
    pairs = met.where("n = 2").groupBy("choice", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).select("a", "b")
    pairs = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= least).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # postings that more than two share are intersected with one position more, to the guaranteed minimum
    further = [F.array(*(_key(tuple(sorted((*c, k)))) for k in range(BYTES) if k not in c)) for c in choices]
    longer = met.where("n > 2").select("fp", F.explode(F.array(*further)[F.col("choice")]).alias("key")).distinct()
    crowded = longer.groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0):
                values = own.values.to_numpy().view(np.uint64)
                links = spanning_links(values, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(values[links[:, 0]].view(np.int64)), pa.array(values[links[:, 1]].view(np.int64))], ["a", "b"])

    return pairs.unionAll(crowded.select("fps").mapInArrow(forest, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Fingerprints of lower-cased (A to Z) three-word shingles, repeats included; a text of
    fewer words is one shingle, a text of none has fingerprint zero and links like any other.
    component_id is the smallest doc_id reachable over links of at most max_bits differing
    bits, itself included; null ids are passed over by the smallest. A bit that exactly half the shingles
    have is not set. Null and empty texts have no words. A text of any length has one fingerprint of all its
    shingles; it is held by one task. Repeated rows get the same result each. An empty table gives an empty
    result. Columns besides the two named are not read, so theirs may clash with those added.
    """
    each = saved(document_fingerprints(docs, id_col, text_col), "simhash-docs")
    fps = each.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = components(fps.select(F.col("fp").alias("node")), fingerprint_links(fps.select("fp"), max_bits))
    rooted = fps.join(nodes, fps["fp"] == nodes["node"]).select("fp", "rep", "component")
    smallest = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(smallest, "component").select("fp", "component_id")
    return each.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """The rows of docs that stay, one document of each component, with all their columns.

    Null and empty texts have fingerprint zero and are linked like any other. The decision is of a row's
    id and text: an id may stay with one text and go with another, and a null id stays only where its
    component has no id. The smallest id stays; of its texts, should it have several here, the one of the
    smallest SHA-256; of rows that repeat it, one. An empty table gives an empty result. Columns may have any names.
    """
    own = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    # the smallest of a component's keys has its smallest id, and a null only where it has no other
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), own.alias("sha")).alias("_own_key"), F.col(text_col).alias("_own_text"))
    each = near_duplicates(keyed, "_own_key", "_own_text", max_bits)
    decided = each.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.sha").alias("own"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return keep_decided(docs, decided, own, id_col)
