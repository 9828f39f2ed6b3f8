"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n token ids is cut at the binary digits of n: as many pieces of ``max_length`` as
fit, then one piece for each further digit, from large to small. Every piece is a sequence of
its own, of a length that is a power of two, and goes to the bucket of that length: ``bucket``
names it, and write_buckets() lays the pieces out by it, so a batch is read from one bucket and
holds no padding. Nothing is shuffled: each document is cut where it is read, and a bucket
is written by all tasks at once, however many pieces share a length.

The vocabulary file is one of the tokenizers library. A plain byte-level one whose numbers are
its merges' ranks (the check is made when it is loaded) is handed to a faster encoder that
gives the same ids; any other file, and texts that hold the string of a special token, are
encoded by the library itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.llm.arrowtext import slices, utf8

END_ID = 1
MAX_LENGTH = 2048
# fixed value: how byte-level vocabularies of this kind split a text before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a tokenizer file says of itself where PIECES and ranks describe it whole.
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

_encoders: dict[str, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be printed, else the next one from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, described: dict):
        model, split = described["model"], described["pre_tokenizer"] or {}
        if described["normalizer"] or model.get("type") != "BPE" or any(split.get(k) != v for k, v in PLAIN.items()):
            return None
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        numbers, letters = model["vocab"], byte_letters()
        merged = [numbers["".join(x) if isinstance(x, list) else x.replace(" ", "")] for x in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or len(numbers) != 256 + len(merged) or not all(c in letters for w in numbers for c in w):
            return None
        import tiktoken

        return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks={bytes(map(letters.__getitem__, w)): i for w, i in numbers.items()}, special_tokens={})

    def ids(self, text: bytes) -> np.ndarray:
        string = text.decode(errors="replace")
        if self.fast is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(string, disallowed_special=())

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, each row ended by END_ID, and the offsets of the rows."""
        data, at = utf8(column)
        raw = memoryview(data)
        own = [self.ids(bytes(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])]).astype(np.int64)
        out = np.full(bounds[-1], END_ID, np.uint32)
        for x, a in zip(own, bounds[:-1].tolist(), strict=True):
            out[a : a + len(x)] = x
        return out, bounds


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()  # a worker keeps one vocabulary
        _encoders[path] = Encoder(path)
    return _encoders[path]


def binary_pieces(n: np.ndarray, max_length: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of every piece of documents of n ids: max_length again and again, then the digits of the rest."""
    digits = int(max_length).bit_length() - 1
    rest = n % max_length
    ones = (rest[:, None] >> np.arange(digits - 1, -1, -1)) & 1
    count = n // max_length + ones.sum(axis=1)
    row = np.repeat(np.arange(len(n)), count)
    order = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(row), max_length, np.int64)
    small = order >= (n // max_length)[row]
    at_row, digit = np.nonzero(ones)
    length[small] = 1 << (digits - 1 - digit)
    before = np.concatenate([[0], np.cumsum(length)])
    begin = np.concatenate([[0], np.cumsum(n)])
    return row, before[:-1] - begin[row], length


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids): a row per piece; ids only if asked for.

    A document's ids are its text's, without special tokens added, then END_ID; a null or
    empty text is END_ID alone. max_length is a power of two. bucket is the binary logarithm of
    length; sequences of one bucket need no padding. sequence_id tells the sequences of one
    result apart; offset is always 0. A text of any length is cut to its end; it is held by one
    task. There are no ties: pieces of one document are told apart by start. Repeated rows are
    packed each on their own, null ids pass through, an empty table gives an empty result,
    columns besides the two named are not read, so theirs may clash with those added.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path)
        for batch in slices(batches, "text", 1 << 20):
            ids, at = made.encode(batch.column(1))
            row, start, length = binary_pieces(np.diff(at), max_length)
            begin = at[row] + start
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.diff(at)[row]), pa.array(np.log2(length).astype(np.int32))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]).astype(np.int32)), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    made = base.mapInArrow(run, schema)
    return made.select(*names[:5], F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *names[5:])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Lay pieces out by bucket under path, one folder a length. Each task writes its own part of every bucket; nothing is shuffled."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length, all of them without padding; only their folder is read."""
    return spark.read.parquet(path).where(F.col("bucket") == length.bit_length() - 1)
