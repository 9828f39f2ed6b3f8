"""Line deduplication that can be taken back: reference counts and cuckoo filters, in shards.

The exact state is a table of reference counts: how many documents hold each line key.
Inserting documents adds to it, deleting documents subtracts; counts that reach zero go.
Beside it stand cuckoo filters, one a shard, of the keys held by at least ``min_docs``
documents. Filters support deletion, so a key leaves its filter when deleted
documents bring its count below the threshold, without rebuilding the shard.

Documents are cleaned by asking the filter of a line's shard; the exact table is asked about the
lines that a filter lets through, and about no others, whatever the size: filters and frequent
keys are broadcast up to a checked size, and beyond it lines meet their shard's filter in
a shuffle, salted so that a frequent line is no hot key, and what passes is joined to the table.
A key's shard comes from one half of its 128 bits, its place in the filter from the other; the
number of shards follows the number of frequent keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.llm.arrowtext import mix, slices
from meshtide.llm.shared import saved

STRIP = b" \t\n\x0b\x0c\r"
COUNTS = "h1 long, h2 long, refs long"
FILTERS = "shard int, filter binary"
BUCKET = 4
#: Frequent keys in a shard, about.
SHARD_KEYS = 1 << 17
#: The frequent keys' filters and exact keys are broadcast up to this size; beyond it, lines are dealt by shard.
BROADCAST_BYTES = 32 << 20
#: Parts into which the lines of a shard are dealt.
SALTS = 8


class CuckooFilter:
    """A cuckoo filter of 64-bit hashes: buckets of four 16-bit fingerprints, two buckets a key.

    A full filter grows by rehashing, which needs the keys: insert() says False and the
    caller, who has the exact table, builds a larger one.
    """

    def __init__(self, slots: int, cells: np.ndarray | None = None):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, slots) / BUCKET / 0.84))))
        self.cells = np.zeros((self.buckets, BUCKET), np.uint16) if cells is None else cells

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        slots = len(keys)
        while True:
            made = cls(slots)
            if made.insert_many(keys):
                return made
            slots = 2 * max(1, slots)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.cells = np.frombuffer(data, np.uint16).reshape(-1, BUCKET).copy()
        made.buckets = len(made.cells)
        return made

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints = np.where(prints == 0, 1, prints).astype(np.uint16)
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mix(np.asarray(prints, np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, key: int) -> bool:
        prints, first, second = (x[0] for x in self._places(np.array([key], np.uint64)))
        for at in (first, second):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = prints
                return True
        at = first
        for turn in range(200):
            slot = (int(at) + turn) % BUCKET
            prints, self.cells[at, slot] = self.cells[at, slot], prints
            at = self._other(np.array([at]), np.array([prints]))[0]
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = prints
                return True
        return False

    def insert_many(self, keys: np.ndarray) -> bool:
        """Insert all keys: as many as fit into the free slots of their first bucket, then of their second, the rest one by one."""
        keys = np.asarray(keys, np.uint64)
        for turn in (1, 2):
            places = self._places(keys)
            prints, at = places[0], places[turn]
            order = np.argsort(at, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(at[order], at[order])
            fits = rank < (self.cells == 0).sum(axis=1)[at]
            free = np.argsort(self.cells != 0, axis=1, kind="stable")  # of each bucket, the free slots first
            self.cells[at[fits], free[at[fits], rank[fits]]] = prints[fits]
            keys = keys[~fits]
        return all(map(self.insert, keys.tolist()))

    def delete(self, key: int) -> bool:
        """Take out one copy of the key's fingerprint; the key must have been inserted."""
        prints, first, second = (x[0] for x in self._places(np.array([key], np.uint64)))
        for at in (first, second):
            there = np.flatnonzero(self.cells[at] == prints)
            if len(there):
                self.cells[at, there[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.cells[first] == prints[:, None]) | (self.cells[second] == prints[:, None])).any(axis=1)


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A to Z in lower case."""
    return line.strip(STRIP).lower()


def _keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    lines = (text or "").encode().split(b"\n")
    return lines, [line_key(x) for x in lines]


def _digest(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def line_references(docs: DataFrame, text_col: str = "text", sign: int = 1) -> DataFrame:
    """Reference counts of the line keys of docs: each document counts once for each of its keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            refs: dict[bytes, int] = {}
            for text in batch.column(0).to_pylist():
                for key in set(_keys(text)[1]):
                    if key:
                        d = xxhash.xxh3_128_digest(key)
                        refs[d] = refs.get(d, 0) + 1
            h = np.frombuffer(b"".join(refs), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.fromiter(refs.values(), np.int64, len(refs)) * sign)], ["h1", "h2", "refs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, COUNTS).groupBy("h1", "h2").agg(F.sum("refs").alias("refs"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h2"), F.lit(shards)).cast("int").alias("shard")


def _build(key, table):
    made = CuckooFilter.build(table["h1"].to_numpy().view(np.uint64))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})


class LineIndex:
    """The incremental state: reference counts and, for each shard, a filter of the frequent keys.

    counts is a DataFrame of COUNTS; filters one of FILTERS. Both are
    immutable: insert() and delete() return a new index.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, min_docs: int, shards: int):
        self.counts, self.filters, self.min_docs, self.shards = counts, filters, min_docs, shards

    @classmethod
    def of(cls, docs: DataFrame, text_col: str = "text", min_docs: int = 10, shards: int | None = None) -> LineIndex:
        """The index of docs; without ``shards`` there are as many as its frequent keys ask for."""
        counts = saved(line_references(docs, text_col), "line-refs")
        frequent = counts.where(F.col("refs") >= min_docs)
        if shards is None:
            shards = max(1, -(-frequent.count() // SHARD_KEYS))
        filters = saved(frequent.select(_shard(shards), "h1").groupBy("shard").applyInArrow(_build, FILTERS), "line-filters")
        return cls(counts, filters, min_docs, shards)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(line_references(docs, text_col, 1))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Take documents out again; they must have been inserted with the same text."""
        return self._changed(line_references(docs, text_col, -1))

    def _changed(self, delta: DataFrame) -> LineIndex:
        least, shards = self.min_docs, self.shards
        both = self.counts.withColumn("old", F.col("refs")).unionByName(delta.withColumn("old", F.lit(0).cast("long")))
        merged = saved(both.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.sum("old").alias("old")), "line-refs")
        crossed = merged.where((F.col("refs") >= least) != (F.col("old") >= least))

        def change(key, left, right):
            data = left["filter"][0].as_py() if len(left) else None
            made = CuckooFilter(len(right)) if data is None else CuckooFilter.from_bytes(data)
            keys, up = right["h1"].to_numpy().view(np.uint64), right["up"].to_numpy(zero_copy_only=False)
            for k in keys[~up].tolist():
                made.delete(k)
            # a filter that is full is emptied here and rebuilt below from the exact table
            fits = made.insert_many(keys[up])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes() if fits else None], pa.binary())})

        changes = crossed.select(_shard(shards), "h1", (F.col("refs") >= least).alias("up"))
        changed = saved(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, FILTERS), "line-filters")
        counts = merged.where("refs > 0").select("h1", "h2", "refs")
        full = changed.where("filter is null").select("shard")
        rebuilt = counts.where(F.col("refs") >= least).select(_shard(shards), "h1").join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInArrow(_build, FILTERS)
        filters = saved(changed.where("filter is not null").unionByName(rebuilt), "line-filters")
        return LineIndex(counts, filters, least, shards)

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text, kept_sha256): lines with frequent keys dropped from docs."""
        frequent = self.counts.where(F.col("refs") >= self.min_docs).select("h1", "h2")
        base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
        if frequent.count() * 16 + size > BROADCAST_BYTES:
            return self._clean_by_shuffle(base, frequent)
        exact = frequent.toArrow()
        exact = np.stack([exact["h1"].to_numpy(), exact["h2"].to_numpy()], 1)
        exact = exact[np.lexsort((exact[:, 1], exact[:, 0]))]
        state = docs.sparkSession.sparkContext.broadcast((exact.tobytes(), {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}))
        shards = self.shards

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, filters = state.value
            table = np.frombuffer(data, np.int64).reshape(-1, 2)
            made = {k: CuckooFilter.from_bytes(v) for k, v in filters.items()}
            for batch in slices(batches, "text"):
                lines, keys, n = [], [], []
                for text in batch.column(1).to_pylist():
                    own, own_keys = _keys(text)
                    lines += own
                    keys += own_keys
                    n.append(len(own))
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)
                gone = known(table, h, passed(made, h, shards))
                gone &= np.fromiter(map(bool, keys), bool, len(keys))
                out, dropped, at = [], [], 0
                for k in n:
                    own = gone[at : at + k]
                    dropped.append(int(own.sum()))
                    out.append(b"\n".join(lines[at + i] for i in np.flatnonzero(~own).tolist()))
                    at += k
                yield _result(batch.column(0), n, dropped, out)

        return base.mapInArrow(drop, _schema(base))

    def _clean_by_shuffle(self, base: DataFrame, frequent: DataFrame) -> DataFrame:
        """The same where filters and keys are too many to broadcast: lines are dealt to their shard's filter, what passes is joined."""
        shards = self.shards
        # an id and its text's hash name a document; documents that share them have the same lines
        base = base.withColumn("own", F.xxhash64("text"))
        id_type = base.schema["doc_id"].dataType.simpleString()

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                row, h = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for d in {xxhash.xxh3_128_digest(k) for k in _keys(text)[1] if k}:
                        row.append(i)
                        h.append(d)
                pairs = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
                row = pa.array(row, pa.int64())
                salt = np.arange(len(pairs)) % SALTS
                columns = [pa.array((pairs[:, 1] % shards).astype(np.int32)), pa.array(salt.astype(np.int32)), batch.column(0).take(row), batch.column(2).take(row), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "salt", "doc_id", "own", "h1", "h2"])

        asked = base.mapInArrow(keyed, f"shard int, salt int, doc_id {id_type}, own long, h1 long, h2 long")
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "filter")
        met = asked.unionByName(filters, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, made = None, None  # a part's filter comes before its lines
            for batch in batches:
                places = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
                cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                    own = batch.slice(a, b - a)
                    if a < b and tuple(places[a]) != place:
                        place, made = tuple(places[a]), None
                    filters = own.column(6).drop_null()
                    if len(filters):
                        made = CuckooFilter.from_bytes(filters[0].as_py())
                    own = own.filter(own.column(6).is_null())
                    if made is not None and len(own):
                        hit = made.contains(own.column(4).to_numpy().view(np.uint64))
                        yield own.filter(pa.array(hit)).select(["doc_id", "own", "h1", "h2"])

        hits = met.mapInArrow(ask, f"doc_id {id_type}, own long, h1 long, h2 long").join(frequent, ["h1", "h2"])
        by_doc = hits.groupBy("doc_id", "own").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
        joined = base.join(by_doc, base["doc_id"].eqNullSafe(by_doc["doc_id"]) & (base["own"] == by_doc["own"]), "left").select(base["doc_id"], "text", "gone")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                n, dropped, out = [], [], []
                for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    lines, keys = _keys(text)
                    bad = {(x["h1"], x["h2"]) for x in gone or ()}
                    kept = [x for x, k in zip(lines, keys, strict=True) if not (k and bad and _digest(k) in bad)]
                    n.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                    out.append(b"\n".join(kept))
                yield _result(batch.column(0), n, dropped, out)

        return joined.mapInArrow(drop, _schema(base))


def passed(filters: dict[int, CuckooFilter], h: np.ndarray, shards: int) -> np.ndarray:
    """Rows of h (two columns of hash) that the filter of their shard lets through."""
    shard = h[:, 1] % shards
    order = np.argsort(shard, kind="stable")
    names, cuts = np.unique(shard[order], return_index=True)
    hits = [own[filters[k].contains(h[own, 0].view(np.uint64))] for k, own in zip(names.tolist(), np.split(order, cuts[1:]), strict=True) if k in filters]
    return np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)


def known(table: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which rows of h are in the sorted table; only the rows named are looked up."""
    gone = np.zeros(len(h), bool)
    some, back = np.unique(h[rows], axis=0, return_inverse=True) if len(rows) else (h[:0], rows)
    at, end = (np.searchsorted(table[:, 0], some[:, 0], side) for side in ("left", "right"))
    there = np.array([(table[a:b, 1] == x).any() for a, b, x in zip(at.tolist(), end.tolist(), some[:, 1].tolist(), strict=True)], bool)
    gone[rows] = there[back.reshape(-1)]
    return gone


def _schema(base: DataFrame) -> str:
    return f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def _result(ids: pa.Array, n: list[int], dropped: list[int], out: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in out])], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key is found in at least min_docs documents: (doc_id, n_lines, n_dropped, kept_text, kept_sha256).

    A text is split at \\n; null and empty texts are one empty line. A line's key is the line
    without ASCII white space at its ends, A to Z in lower case; an empty key is never dropped.
    A document that repeats a line counts once for it; a repeated row counts as a document of
    its own and gets the same result. Null ids pass through. A key in exactly min_docs documents
    goes; there are no other ties. A text of any length is cleaned whole; it is held by one task. An
    empty table gives an empty result. Columns besides the two named are not read, so theirs may
    clash with those added.
    """
    return LineIndex.of(docs, text_col, min_docs, shards).clean(docs, id_col, text_col)
