"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, and pieces of one length are one bucket.

A document of n tokens, its end token included, gives n // longest pieces of the longest length and then one piece for each binary digit
of the rest, longest first. A piece is a sequence of its own, so no sequence crosses documents and none is padded. A trainer
takes batches of one bucket: write_buckets() lays each length in a folder of its own.

One narrow pass, no shuffle. Sequence ids are made of the bucket, the partition that a piece was made in and a count in both: a lost task
that runs again reads the same rows and gives the same ids.

Tokens are those of the tokenizer file. They are found by tiktoken from the file's own vocabulary, which is faster; texts are taken in segments
that end before a single space between two other characters, where the pattern always parts tokens, so that
a very long text takes bounded memory. A segment that is still long has no such space; the tokenizers library itself encodes it.

Defined results: a null or empty text is its end token alone, one piece of length 1. Texts are read whole, however long. Repeated rows and
null ids give pieces of their own, told apart by their sequence ids; ties cannot arise. Columns other than id and text are
not read, so their names do not matter. No rows give no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from routinelens.llm.bpe import byte_alphabet

#: Longest sequence, and the id that ends each document.
LONGEST, END = 2048, 1
#: Characters of a segment before it is cut at the next place that parts tokens; one much longer has no such place.
SEGMENT, LONG_SEGMENT = 1 << 16, 1 << 17
#: Characters encoded between two batches of results.
BATCH_CHARS = 2_000_000
#: Fixed value: the pattern of byte-level pre-tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PART = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """The ids of whole texts, as the tokenizers library gives them without special tokens added."""

    def __init__(self, blob: str) -> None:
        self.whole = Tokenizer.from_str(blob)
        self.whole.no_truncation()
        self.whole.no_padding()
        file = json.loads(blob)
        kind = file["pre_tokenizer"] or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not file["normalizer"] and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"])
        self.fast = None
        if plain:
            byte = {c: b for b, c in enumerate(byte_alphabet())}
            special = {t["content"]: t["id"] for t in file["added_tokens"]}
            ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        parts = [self._segment(s) for s in segments(text)] if self.fast else [self._library(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _segment(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special="all") if len(text) <= LONG_SEGMENT else self._library(text)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def segments(text: str) -> Iterator[str]:
    """The text in turn, cut only before single spaces between two characters that are no white space."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _PART.search(text, at + SEGMENT)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of a document's pieces: full ones, then the powers of two of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


_LOADED: dict[int, Encoder] = {}


def _loaded(blob: str) -> Encoder:
    key = hash(blob)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(blob)
    return _LOADED[key]


def decompose(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end: int = END, with_ids: bool = True) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, bucket (its length's power), sequence_id, offset (zero) and, if asked for, ids.

    ``vocabulary`` is the path of a tokenizer file on the driver; ``longest`` a power of two.
    """
    if longest < 1 or longest & longest - 1:
        raise ValueError("the longest sequence must be a power of two")
    with open(vocabulary, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    long = ("start", "length", "ids_crc32", "doc_tokens", "bucket", "sequence_id", "offset")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in long]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _loaded(blob.value), TaskContext.get().partitionId()
        made = [0] * longest.bit_length()

        def out(batch: pa.RecordBatch, rows: list[int], columns: list[list[int]], ids: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.field("element", pa.int32(), False))))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            rows, columns, ids, size = [], [[] for _ in long], [], 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                tokens = np.append(encoder.encode(text), np.uint32(end)).astype("<u4")
                start = 0
                for length in binary_lengths(len(tokens), longest):
                    piece, bucket = tokens[start : start + length], length.bit_length() - 1
                    rows.append(i)
                    for column, value in zip(columns, (start, length, zlib.crc32(piece.tobytes()), len(tokens), bucket, bucket << 56 | part << 32 | made[bucket], 0)):
                        column.append(value)
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                    made[bucket] += 1
                    start += length
                size += len(text)
                if size >= BATCH_CHARS:
                    yield out(batch, rows, columns, ids)
                    rows, columns, ids, size = [], [[] for _ in long], [], 0
            yield out(batch, rows, columns, ids)

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, each length in a folder of its own, so that a batch of one length is read without a filter."""
    pieces.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
