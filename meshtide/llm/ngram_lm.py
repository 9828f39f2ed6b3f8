"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped hash arrays.

The model is a set of sorted arrays in the folder that driver and executors share:

* the vocabulary: words' hashes, sorted, and their counts; a word is known by 96 bits of XXH3,
  64 to look it up and 32 more that are compared, and its number is its rank;
* for each word number: its continuation count and, as a context, its total and its
  counts of successors seen once, twice and more often;
* the bigrams: for each shard the sorted keys (number of the first word, number of the second) and counts.

Counting is two aggregations over the training texts: words, then bigrams of word numbers. Each
partition sums its own counts before they are shuffled, so a word that makes up a third of
all tokens is one row per slice, and bigrams are dealt by a hash of both words, so that a
frequent first word is spread over all shards. The tasks that merge a shard write its
arrays under a name that depends on the shard alone, by a rename, so a task that runs again
after a lost executor leaves the same file. Workers map the files and never load them.

Counts are 64-bit integers throughout; a file holds 32 bits a number where all of its numbers
fit. A pair of word numbers is one 64-bit key while the vocabulary is below 2^32 words, and
two columns from there on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.llm.arrowtext import coded_words, digests, mix, slices
from meshtide.llm.shared import saved, shared_folder
from meshtide.llm.store import Store

#: Digest of the token that ends a text: of bytes that no word is.
END = np.frombuffer(xxhash.xxh3_128_digest(b" end"), "<u8").reshape(1, 2)
#: Rows of counts that a partition gathers before it sends them on.
FLUSH = 3_000_000
#: Word numbers in one file of statistics.
BLOCK_BITS = 18
#: Tokens for each shard of the pairs, about, and shards at least.
SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 64
#: Vocabularies from this size on have pairs of two columns.
WIDE = 1 << 32
STATS = ["total", "n1", "n2", "n3", "n4", "more", "cont"]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens as two sorted columns of hashes (64 and 32 bits), each token's place in them, each text's first token.

    A text's tokens are its words in lower case (A to Z) and one END.
    """
    words, code, first, *_ = coded_words(column, lower=True)
    both = np.concatenate([digests(words), END])
    one, two = both[:, 0].view(np.int64), both[:, 1].astype(np.uint32).view(np.int32)
    bounds = first + np.arange(len(column) + 1)
    out = np.full(len(code) + len(column), len(words), np.int64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = code
    order = np.lexsort((two, one))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return one[order], two[order], rank[out], bounds


def is_training(id_col: Column, folds: int = 5, held_out: int = 1) -> Column:
    """Whether crc32 of the id as text leaves another remainder than held_out; a null id is for training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds != held_out, F.lit(True))


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (of one column or two), sorted, and the sum of n of each."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    fresh = np.ones(len(n), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(fresh)
    return [k[at] for k in keys], np.add.reduceat(n, at) if len(at) else n


def _counted(batches: Iterator[pa.RecordBatch], counts_of, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of a few slices at a time; counts_of gives a column's keys, as a list of columns, and their counts."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = summed([np.concatenate(x) for x in zip(*(k for k, _ in held), strict=True)], np.concatenate([n for _, n in held]))
        held.clear()
        for i in range(0, len(counts), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (*keys, counts)], names)

    for batch in slices(batches):
        held.append(counts_of(batch.column(0)))
        rows += len(held[-1][1])
        if rows >= FLUSH:
            yield from flush()
            rows = 0
    if held:
        yield from flush()


def packed(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in 32 bits if all fit, else in 64."""
    return numbers.astype(np.uint32) if not numbers.size or numbers.max() < 1 << 32 else numbers.astype(np.uint64)


def unpacked(store: Store, name: str, n: int) -> np.ndarray:
    """What packed() made of n numbers, of either width."""
    raw = store.open(name, np.uint8)
    return raw.view(np.uint64 if len(raw) == 8 * n else np.uint32)


class Vocabulary:
    """Word numbers by hash: files of sorted hashes, each of a range of its own."""

    def __init__(self, store: Store, bounds: list[tuple[str, int, int]]):
        self.store = store
        self.files = [f for f, _, _ in bounds]
        self.first = np.array([x for _, x, _ in bounds], np.int64)
        self.base = np.concatenate([[0], np.cumsum([n for _, _, n in bounds])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.base[-1])

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each of some sorted hashes."""
        number, count = np.full(len(one), -1, np.int64), np.zeros(len(one), np.int64)
        cuts = np.concatenate([[0], np.searchsorted(one, self.first[1:]), [len(one)]]) if len(self.first) else [0]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                name = self.files[k]
                own, more = self.store.open(f"words-{name}", np.int64), self.store.open(f"checks-{name}", np.int32)
                at = np.searchsorted(own, one[a:b])
                at, end = np.minimum(at, len(own) - 1), np.searchsorted(own, one[a:b], "right")
                while True:  # words that share 64 bits are neighbours
                    off = (at + 1 < end) & (more[at] != two[a:b])
                    if not off.any():
                        break
                    at = at + off
                hit = (own[at] == one[a:b]) & (more[at] == two[a:b])
                number[a:b] = np.where(hit, self.base[k] + at, -1)
                count[a:b] = np.where(hit, unpacked(self.store, f"counts-{name}", len(own))[at], 0)
        return number, count


class PairKeys:
    """Keys of pairs of word numbers: one column of 64 bits, or two columns if wide."""

    def __init__(self, wide: bool):
        self.wide = wide
        self.names = ["left", "right"] if wide else ["key"]

    def of(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        return [left, right] if self.wide else [(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).view(np.int64)]

    def numbers(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if self.wide:
            return keys[0], keys[1]
        key = keys[0].view(np.uint64)
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def shard(self, keys: list[np.ndarray], shards: int) -> np.ndarray:
        made = mix(keys[0].view(np.uint64))
        for k in keys[1:]:
            made = mix(made ^ k.view(np.uint64))
        return (made % np.uint64(shards)).astype(np.int32)

    def find(self, there: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Place of each key among the sorted keys of a shard, -1 if it is none; there is not empty."""
        there = there.reshape(-1, len(keys))
        at, end = np.searchsorted(there[:, 0], keys[0], "left"), np.searchsorted(there[:, 0], keys[0], "right")
        if self.wide:
            last = end
            while (open_ := at < end).any():
                middle = (at + end) // 2
                less = there[np.minimum(middle, len(there) - 1), 1] < keys[1]
                at, end = np.where(open_ & less, middle + 1, at), np.where(open_ & ~less, middle, end)
            end = last
        at_ = np.minimum(at, len(there) - 1)
        hit = (at < end) & np.logical_and.reduce([there[at_, k] == x for k, x in enumerate(keys)])
        return np.where(hit, at, -1)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """The modified Kneser-Ney discounts for counts of 0, 1, 2, 3 and more; half the count where counts of counts give none."""
    plain = [0.5, 1.0, 1.5]
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, *plain])
    y = n1 / (n1 + 2 * n2)
    made = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(d if 0 < d <= k else p for k, (d, p) in enumerate(zip(made, plain, strict=True), 1))])


class BigramModel:
    """The trained model: what scoring tasks need, arrays aside."""

    def __init__(self, store: Store, vocabulary: Vocabulary, keys: PairKeys, shards: int, n_tokens: int, pair_counts: tuple[float, ...], cont_counts: tuple[float, ...], cont_total: int, cont_more: float):
        self.store, self.vocabulary, self.keys, self.shards, self.n_tokens = store, vocabulary, keys, shards, n_tokens
        self.pair_discounts, self.cont_discounts = discounts(*pair_counts), discounts(*cont_counts)
        self.cont_total = cont_total
        d = self.cont_discounts
        given = d[1] * cont_counts[0] + d[2] * cont_counts[1] + d[3] * cont_more
        #: what every word gets, known or not, at the lowest order
        self.uniform = (given / cont_total if cont_total else 1.0) / (len(vocabulary) + 1)

    def _stats(self, numbers: np.ndarray) -> np.ndarray:
        """STATS of each of some sorted word numbers."""
        out = np.zeros((len(numbers), len(STATS)), np.int64)
        block = numbers >> BLOCK_BITS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(numbers)]]) if len(numbers) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = unpacked(self.store, f"stats-{block[a]}", len(STATS) << BLOCK_BITS).reshape(-1, len(STATS))
            if len(own):
                out[a:b] = own[numbers[a:b] & ((1 << BLOCK_BITS) - 1)]
        return out

    def _pair_counts(self, keys: list[np.ndarray]) -> np.ndarray:
        n = len(keys[0])
        shard = self.keys.shard(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        out = np.zeros(n, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [n]]) if n else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            k = shard[own[0]]
            there = self.store.open(f"pairs-{k}", np.int64)
            if len(there):
                at = self.keys.find(there, [x[own] for x in keys])
                out[own] = np.where(at >= 0, unpacked(self.store, f"pair-counts-{k}", len(there) // len(keys))[at], 0)
        return out

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """For each text: n_tokens, n_known, base_score and score."""
        one, two, at, bounds = tokens(column)
        number, count = self.vocabulary.find(one, two)
        v = len(self.vocabulary)
        base = np.log10((count + 0.5) / (self.n_tokens + 0.5 * (v + 1)))
        known = number >= 0
        stats = np.zeros((len(one), len(STATS)), np.int64)
        stats[known] = self._stats(number[known])
        start = self._stats(np.array([v]))
        cont = stats[:, 6]
        d = self.cont_discounts
        lowest = (cont - d[np.minimum(cont, 3)]) / max(1, self.cont_total) + self.uniform
        d = self.pair_discounts
        all_stats = np.concatenate([stats, start]).astype(float)
        total = all_stats[:, 0]
        given = (d[1] * all_stats[:, 1] + d[2] * all_stats[:, 2] + d[3] * (all_stats[:, 3] + all_stats[:, 4] + all_stats[:, 5])) / np.maximum(total, 1)
        given[total == 0] = 1.0
        before = np.empty(len(at), np.int64)
        before[1:] = at[:-1]
        before[bounds[:-1]] = len(one)
        numbers = np.append(number, v)
        seen = (numbers[before] >= 0) & (number[at] >= 0)
        # each pair of distinct words is looked up once
        some, back = np.unique(before[seen] * (len(one) + 1) + at[seen], return_inverse=True)
        pair = np.zeros(len(at), np.int64)
        pair[seen] = self._pair_counts(self.keys.of(numbers[some // (len(one) + 1)], number[some % (len(one) + 1)]))[back]
        p = np.maximum(pair - d[np.minimum(pair, 3)], 0) / np.maximum(total[before], 1) + given[before] * lowest[at]
        text = np.repeat(np.arange(len(column)), np.diff(bounds))
        return {
            "n_tokens": np.diff(bounds),
            "n_known": np.bincount(text, known[at], len(column)).astype(np.int64),
            "base_score": np.bincount(text, base[at], len(column)),
            "score": np.bincount(text, np.log10(p), len(column)),
        }


def train(texts: DataFrame, text_col: str = "text", wide: int = WIDE) -> BigramModel:
    """Count a model over all texts.

    Null and empty texts are one END each; a table of no rows gives a model that knows no
    word. Repeated rows count again. A text of any length is counted whole; it is held by one task.
    Columns besides the one named are not read. Pairs have two columns from ``wide`` words on.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    store = Store(f"{shared_folder(spark)}/bigram-model-{uuid.uuid4().hex}")

    def word_counts(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        one, two, at, _ = tokens(column)
        n = np.bincount(at, minlength=len(one))
        return [one[n > 0], two[n > 0]], n[n > 0]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, word_counts, ["one", "two", "n"])

    counted = saved(texts.mapInArrow(words, "one long, two int, n long").groupBy("one", "two").agg(F.sum("n").alias("n")), "words")
    n_words, n_tokens = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None and len(table):
            one = table["one"].to_numpy()
            name = f"{int(one[0]) & (2**64 - 1):016x}"
            store.write(f"words-{name}", one)
            store.write(f"checks-{name}", table["two"].to_numpy())
            store.write(f"counts-{name}", packed(table["n"].to_numpy()))
            yield pa.RecordBatch.from_pylist([{"file": name, "first": int(one[0]), "n": len(one)}])

    # ranges are of the first hash alone, so words that share it are in one file
    ranges = counted.repartitionByRange(max(1, n_words >> 20), "one").sortWithinPartitions("one", "two").mapInArrow(write_words, "file string, first long, n long")
    vocabulary = Vocabulary(store, sorted(((r["file"], r["first"], r["n"]) for r in ranges.collect()), key=lambda x: x[1]))
    shards = max(LEAST_SHARDS, -(-n_tokens // SHARD_TOKENS))
    v = len(vocabulary)
    of = PairKeys(v >= wide)

    def pair_counts(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        one, two, at, bounds = tokens(column)
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[bounds[:-1]] = len(one)
        numbers = np.append(vocabulary.find(one, two)[0], v)
        some, n = np.unique(before * (len(one) + 1) + at, return_counts=True)
        return of.of(numbers[some // (len(one) + 1)], numbers[some % (len(one) + 1)]), n

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _counted(batches, pair_counts, [*of.names, "n"]):
            shard = of.shard([batch.column(k).to_numpy() for k in range(len(of.names))], shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", *of.names, "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            shard, *columns = (x.to_numpy() for x in batch.columns)
            order = np.argsort(shard, kind="stable")
            names, cuts = np.unique(shard[order], return_index=True)
            for k, own in zip(names.tolist(), np.split(order, cuts[1:]), strict=True):
                held.setdefault(k, []).append([x[own] for x in columns])
        for k in list(held):
            *keys, n = (np.concatenate(x) for x in zip(*held.pop(k), strict=True))
            keys, n = summed(keys, n)
            store.write(f"pairs-{k}", np.stack(keys, 1))
            store.write(f"pair-counts-{k}", packed(n))
            left, right = of.numbers(keys)
            order = np.argsort(left, kind="stable")
            left, cuts = np.unique(left[order], return_index=True)
            columns = [np.add.reduceat(x[order].astype(np.int64), cuts) for x in (n, n == 1, n == 2, n == 3, n == 4, n > 4)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (left, *columns, np.zeros_like(left))], ["id", *STATS])
            right, counts = np.unique(right, return_counts=True)
            nothing = np.zeros_like(right)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (right, *[nothing] * 6, counts)], ["id", *STATS])

    dealt = texts.mapInArrow(pairs, "shard int, " + ", ".join(f"{x} long" for x in (*of.names, "n"))).repartition(shards, "shard")
    partial = dealt.mapInArrow(merge, "id long, " + ", ".join(f"{x} long" for x in STATS))
    stats = saved(partial.groupBy("id").agg(*(F.sum(x).alias(x) for x in STATS)), "word-stats")
    counts = stats.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in STATS), *(F.count_if(F.col("cont") == k).alias(f"c{k}") for k in range(1, 5)), F.count_if(F.col("cont") >= 3).alias("c_more")).first()

    def write_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            number = batch.column(0).to_numpy()
            values = np.stack([batch.column(k).to_numpy() for k in range(1, 8)], 1)
            for k in np.unique(number >> BLOCK_BITS).tolist():
                if k not in made:
                    made[k] = np.zeros((1 << BLOCK_BITS, len(STATS)), np.int64)
                own = number >> BLOCK_BITS == k
                made[k][number[own] & ((1 << BLOCK_BITS) - 1)] = values[own]
        for k, array in made.items():
            store.write(f"stats-{k}", packed(array))
            yield pa.RecordBatch.from_pylist([{"block": k}])

    blocks = (v >> BLOCK_BITS) + 1
    stats.select("id", *STATS).repartition(blocks, F.shiftright("id", BLOCK_BITS)).mapInArrow(write_stats, "block long").collect()
    return BigramModel(store, vocabulary, of, shards, n_tokens, (counts["n1"], counts["n2"], counts["n3"], counts["n4"]), (counts["c1"], counts["c2"], counts["c3"], counts["c4"]), counts["cont"], counts["c_more"])


def score_documents(docs: DataFrame, model: BigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row; logarithms to base 10.

    base_score is the add-half unigram score, score the interpolated bigram model's log
    probability of the text and its END. Null and empty texts are one END. A text of any length is
    scored whole; it is held by one task. Repeated rows are scored alike; null ids pass through; an
    empty table gives an empty result. Columns besides the two named are not read, so theirs may
    clash with those added.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(batch.num_rows, model.n_tokens)), pa.array(got["base_score"]), pa.array(got["score"])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
