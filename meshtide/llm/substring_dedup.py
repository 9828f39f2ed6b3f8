"""Substring deduplication: a merged count-min sketch picks the windows worth grouping exactly.

First every partition counts its windows in a count-min sketch of its own. The sketches are
shuffled in sparse form (sorted cell gaps, about a byte a window and row), merged by cell
range, and reduced to one bit a cell: counted twice or more. As counts only ever err upwards,
a window all of whose cells are below two is unique, so no repeated window is lost.
A second pass over the texts sends only windows estimated as repeated to an exact grouping
that marks all but the earliest. Windows are grouped by 128 bits, two hashes of 64 built as
trees over the words' XXH3 digests, each with constants of its own; two different windows of
a corpus of 10^13 share them with a probability below 10^-12.

Four things keep what moves small. Documents whose whole word sequence a smaller doc_id has
too are found first by one small row per document and removed whole. Within a slice of a
partition the earliest occurrence of a window is found at once, and only that one is sent on:
a window that a third of all documents hold is a row per slice, not per document. The others
are known to be late and sent as runs of neighbouring windows. And the merged sketch has a
bounded size, two rows of at most ``max_cells`` bits, which workers map from the shared folder.
Beyond that size the sketch only lets more windows through to the exact grouping.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.llm.arrowtext import coded_words, digests, mix, slices, spaced_words, utf8, window_hashes, word_spans
from meshtide.llm.shared import saved, shared_folder
from meshtide.llm.store import Store

ROWS = 2
#: Windows of which a partition gathers the cells, and candidates it gathers, before it sends them on.
FLUSH, FLUSH_ASKED = 3_000_000, 700_000
#: Whole copies and ids of several texts are known to all tasks up to so many; beyond, copies are searched like other documents.
MAX_COPIES = 4_000_000
#: Documents with marks are known by their ids to all tasks up to so many.
MAX_MARKED = 1_000_000
#: Parts into which the copies of one text are dealt.
SALTS = 16
NO_ID = -(2**63)
BASE = "doc_id long, sig long, text string"


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word and the index of each row's first."""
    words, code, first, *_ = coded_words(column)
    both = digests(words)
    return both[:, 0][code], both[:, 1][code], first


def _windows(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie within one row, their two hashes, and the index of each row's first word."""
    one, two, first = _hashed(column)
    starts = np.arange(max(0, len(one) - window + 1))
    row_end = np.repeat(first[1:], np.diff(first))[: len(starts)]
    starts = starts[starts + window <= row_end]
    return starts, window_hashes(one, window, 0)[starts], window_hashes(two, window, 1)[starts], first


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each row's words joined by one space, as two columns, and their number."""
    data, at = utf8(column)
    starts, ends, first = word_spans(data, at)
    out, _, word_ends = spaced_words(data, starts, ends)
    bounds = np.concatenate([[0], word_ends + 1])[first]
    raw = memoryview(out)
    made = b"".join(xxhash.xxh3_128_digest(raw[a : max(a, b - 1)]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return np.frombuffer(made, "<i8").reshape(-1, 2), np.diff(first)


def keyed_documents(base: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """base as BASE, and (doc_id, sig, n_words, h1, h2, salt) of each row. sig tells the texts of one doc_id apart; it is 0 where there is one."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, n = _sequences(batch.column(1))
            salt = (np.arange(len(n)) % SALTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(salt)], ["doc_id", "n_words", "h1", "h2", "salt"])

    each = saved(base.mapInArrow(digest, "doc_id long, n_words long, h1 long, h2 long, salt int"), "substring-docs")
    sides = each.groupBy("doc_id").agg(*(f(x).alias(f"{f.__name__}_{x}") for x in ("h1", "h2") for f in (F.min, F.max)))
    several = saved(sides.where("min_h1 <> max_h1 or min_h2 <> max_h2").select("doc_id"), "substring-ids")
    n = several.count()
    if not n:
        return base.select("doc_id", F.lit(0).cast("long").alias("sig"), "text"), each.withColumn("sig", F.lit(0).cast("long"))
    every = n > MAX_COPIES
    store.write("several", np.zeros(0, np.int64) if every else np.sort(several.toArrow()["doc_id"].to_numpy()))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = store.open("several", np.int64)
        for batch in slices(batches):
            sig = _sequences(batch.column(1))[0][:, 0]
            if not every:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                sig = np.where(known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids, sig, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig), batch.column(1)], ["doc_id", "sig", "text"])

    own = each.withColumn("sig", F.col("h1")) if every else each.join(several.withColumn("_several", F.lit(True)), "doc_id", "left").withColumn("sig", F.when(F.col("_several"), F.col("h1")).otherwise(F.lit(0).cast("long"))).drop("_several")
    return base.mapInArrow(sign, BASE), own


def whole_copies(each: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, sig) of the documents of at least a window whose word sequence a smaller doc_id has too."""
    long = each.where(F.col("n_words") >= window)
    first = long.groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    # a group is told to those parts of its rows that there are, so that many copies of one text are dealt to many tasks
    first = first.withColumn("salt", F.explode("salts")).select("h1", "h2", "n_words", "salt", "keep")
    return long.join(first, ["h1", "h2", "n_words", "salt"]).where("doc_id > keep").select("doc_id", "sig").distinct()


class Copies:
    """The whole copies, in the shared folder, sorted by id; several texts of one id are told apart by sig."""

    def __init__(self, store: Store, copies: DataFrame):
        self.store, self.n = store, copies.count()
        self.n *= self.n <= MAX_COPIES
        if self.n:
            table = copies.toArrow()
            pairs = np.stack([table["doc_id"].to_numpy(), table["sig"].to_numpy()], 1)
            store.write("copies", pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))])

    def has(self, batch: pa.RecordBatch) -> np.ndarray:
        ids, sig = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not self.n:
            return np.zeros(len(ids), bool)
        known = self.store.open("copies", np.int64).reshape(-1, 2)
        lo, hi = np.searchsorted(known[:, 0], ids, "left"), np.searchsorted(known[:, 0], ids, "right")
        out = (lo < hi) & (known[np.minimum(lo, self.n - 1), 1] == sig)
        for i in np.flatnonzero(hi - lo > 1).tolist():
            out[i] = (known[lo[i] : hi[i], 1] == sig[i]).any()
        return out

    def without(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~self.has(batch))) if self.n else batch


def encode_gaps(cells: np.ndarray) -> np.ndarray:
    """Sorted cells as bytes: a gap below 255 is one byte, a byte of 255 adds 255 to the next gap."""
    gaps = np.diff(cells, prepend=0)
    long = gaps // 255
    ends = np.cumsum(long + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = gaps % 255
    return out


def decode_gaps(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.int64)[data != 255]


def _cells(h1: np.ndarray, h2: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [(h1 >> shift).astype(np.int32), (h2 >> shift).astype(np.int32)]


def merged_sketch(docs: DataFrame, window: int, bits: int, copies: Copies, store: Store) -> None:
    """Write ROWS rows of 2**bits cells (bits < 32), packed: a bit is set where windows of the corpus were counted twice or more."""
    large = min(bits, 22)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in range(ROWS):
                cells = np.concatenate([x[row] for x in held])
                cells.sort()
                fresh = np.ones(len(cells), bool)
                fresh[1:] = cells[1:] != cells[:-1]
                again = np.unique(cells[~fresh])
                cells = cells[fresh]
                names, cuts = np.unique(cells >> large, return_index=True)
                for k, own in zip(names.tolist(), np.split(cells, cuts[1:]), strict=True):
                    base = k << large
                    twice = again[np.searchsorted(again, base) : np.searchsorted(again, base + (1 << large))]
                    once = [encode_gaps(x - np.int32(base)).tobytes() for x in (own, twice)]
                    yield pa.RecordBatch.from_arrays([pa.array([row << 20 | k], pa.int32()), pa.array([once[0]], pa.binary()), pa.array([once[1]], pa.binary())], ["segment", "once", "twice"])
            held.clear()

        for batch in slices(copies.without(batches)):
            _, h1, h2, _ = _windows(batch.column(2), window)
            if len(h1):
                held.append(_cells(h1, h2, bits))
                n += len(h1)
            if n >= FLUSH:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if k not in seen:
                    seen[k], twice[k] = np.zeros(1 << large, bool), np.zeros(1 << large, bool)
                cells = decode_gaps(np.frombuffer(a.as_buffer(), np.uint8))
                twice[k][cells] |= seen[k][cells]
                seen[k][cells] = True
                twice[k][decode_gaps(np.frombuffer(b.as_buffer(), np.uint8))] = True
        for k, cells in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    # a partition that merges holds a few segments of 2**22 cells at a time
    pieces = docs.mapInArrow(sketch, "segment int, once binary, twice binary")
    merged = pieces.repartition(max(8, ROWS << max(0, bits - large - 2)), "segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for r in merged.toLocalIterator():  # at most ROWS * 2**bits / 8 bytes in all
        k, size = r["segment"], (1 << large) // 8
        at = (k & 0xFFFFF) * size
        out[k >> 20, at : at + size] = np.frombuffer(r["bits"], np.uint8)
    for row in range(ROWS):
        store.write(f"sketch-{row}", out[row])


def late_in_slice(ids: np.ndarray, sig: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and which windows so ordered are late already among these. Rows come document by document, starts ascending.

    Late: a smaller id among the same window's rows, or the row before is of the same document and window and starts earlier.
    """
    order = np.argsort(h1, kind="stable")
    ids, sig, at, h1, h2 = ids[order], sig[order], at[order], h1[order], h2[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    begins = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids, begins) if len(begins) else ids
    late = ids > np.repeat(least, np.diff(np.append(begins, len(order))))
    late[1:] |= same[1:] & (ids[1:] == ids[:-1]) & (sig[1:] == sig[:-1]) & (at[1:] > at[:-1])
    return order, late


def repeated_windows(docs: DataFrame, window: int, bits: int, copies: Copies, store: Store) -> DataFrame:
    """(doc_id, sig, at, n): n neighbouring windows from word at on whose word sequences also start earlier, whole copies left out."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [store.open(f"sketch-{row}", np.uint8) for row in range(ROWS)]
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def rows(ids, sig, at, n, h1, h2) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(ids), 1 << 18):
                own = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (ids, sig, at, n, h1.view(np.int64), h2.view(np.int64))], ["doc_id", "sig", "at", "n", "h1", "h2"])

        def flush() -> Iterator[pa.RecordBatch]:
            ids, sig, at, h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, late = late_in_slice(ids, sig, at, h1, h2)
            # the earliest here go on to be compared with other slices
            on = np.sort(order[~late])
            yield from rows(ids[on], sig[on], at[on], np.ones(len(on), np.int32), h1[on], h2[on])
            # the later ones are known: runs of neighbours, starts below zero, a key of their own
            known = np.sort(order[late])
            if len(known):
                ids, sig, at = ids[known], sig[known], at[known]
                cut = np.ones(len(known), bool)
                cut[1:] = (ids[1:] != ids[:-1]) | (sig[1:] != sig[:-1]) | (at[1:] != at[:-1] + 1)
                begins = np.flatnonzero(cut)
                key = mix(h1[known[begins]] + begins.astype(np.uint64))
                yield from rows(ids[begins], sig[begins], -at[begins] - 1, np.diff(np.append(begins, len(known))).astype(np.int32), key, np.zeros(len(begins), np.uint64))

        for batch in slices(copies.without(batches)):
            starts, h1, h2, first = _windows(batch.column(2), window)
            hit = np.ones(len(starts), bool)
            for cells, bitmap in zip(_cells(h1, h2, bits), bitmaps, strict=True):
                hit &= (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
            starts, h1, h2 = starts[hit], h1[hit], h2[hit]
            if len(starts):
                row = np.searchsorted(first, starts, "right") - 1
                ids, sig = (batch.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 1))
                held.append((ids, sig, (starts - first[row]).astype(np.int32), h1, h2))
                n += len(starts)
            if n >= FLUSH_ASKED:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    asked = docs.mapInArrow(ask, "doc_id long, sig long, at int, n int, h1 long, h2 long")
    order = Window.partitionBy("h1", "h2").orderBy("doc_id")
    late = asked.withColumn("r", F.rank().over(order)).where("at < 0 or r > 1")
    return late.select("doc_id", "sig", F.when(F.col("at") < 0, -F.col("at") - 1).otherwise(F.col("at")).alias("at"), "n")


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 28) -> DataFrame:
    """Remove words covered by windows that also start earlier: (doc_id, n_words, n_removed, kept_text, kept_sha256).

    Words are maximal runs of anything but ASCII white space; a window is ``window``
    consecutive words of one document. Earlier is in a document of smaller doc_id, or in the
    same document before. Windows are judged on the input. Null and empty texts have no words.
    doc_id must be an integer (bigint at most). Rows that repeat an id and its text are one
    document and get the same result each; rows of one id with different texts are documents
    of their own, none of them earlier than the other (ties stay). A null doc_id counts as the smallest
    integer. A text of any length is searched whole; it is held by one task. An empty table gives an
    empty result. Columns besides the two named are not read, so theirs may clash with those added.
    """
    spark = docs.sparkSession
    store = Store(f"{shared_folder(spark)}/substrings-{uuid.uuid4().hex}")
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base, each = keyed_documents(named, store)
    n_words = each.agg(F.sum("n_words")).first()[0] or 0
    bits = int(min(max_bits, max(16, np.ceil(np.log2(max(1, 2 * n_words))))))
    copies = Copies(store, saved(whole_copies(each, window), "substring-copies"))
    merged_sketch(base, window, bits, copies, store)
    marks = repeated_windows(base, window, bits, copies, store).groupBy("doc_id", "sig").agg(F.collect_list(F.struct("at", "n")).alias("late"))
    # only documents with marks are shuffled to meet them; the others are known by their ids up to a checked number
    marks = saved(marks, "substring-marks")
    nothing = F.array().cast("array<struct<at:int,n:int>>").alias("late")
    columns = ["doc_id", "sig", "text", "late"]
    if marks.count() <= MAX_MARKED:
        marked = F.broadcast(marks.select("doc_id", "sig"))
        met = base.join(marked, ["doc_id", "sig"], "left_semi").join(marks, ["doc_id", "sig"]).select(*columns)
        joined = base.join(marked, ["doc_id", "sig"], "left_anti").select("doc_id", "sig", "text", nothing).unionAll(met)
    else:
        joined = base.join(marks, ["doc_id", "sig"], "left").select(*columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = utf8(batch.column(2))
            starts, ends, first = word_spans(data, at)
            cover = np.zeros(len(starts) + 1, np.int64)
            late = batch.column(3)
            spans = late.flatten()
            begin, n = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(len(late)), late.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = first[row] + begin
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + n - 1 + window, -1)
            whole = np.flatnonzero(copies.has(batch))
            np.add.at(cover, first[whole], 1)
            np.add.at(cover, first[whole + 1], -1)
            kept = np.cumsum(cover)[:-1] == 0
            n = np.diff(first)
            kept_before = np.concatenate([[0], np.cumsum(kept)])
            n_kept = kept_before[first[1:]] - kept_before[first[:-1]]
            out, _, word_ends = spaced_words(data, starts[kept], ends[kept])
            bounds = np.concatenate([[0], word_ends + 1])[kept_before[first]]
            raw = out.tobytes()
            texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(n - n_kept), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    result = joined.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return result.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
