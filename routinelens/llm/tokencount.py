"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but 16-bit little-endian ids, each document followed by the end-of-document id. A file is dealt out as byte
ranges, its blocks, over all tasks, whatever its size; a task reads a block by its place, searches it for the id in one vectorised
comparison, and yields one row: its number of tokens and the places of its separators. These rows are written once. A
prefix scan over the blocks of a file gives each block the last separator and the count of separators before it, which stitches the documents
that cross block borders, and so task borders.

Defined results: a null or empty document has 0 tokens; a very long one spans as many blocks as it takes; tokens after a file's last
separator are a document that is not ended; an empty file has no rows, nor has a table without documents; an odd last byte is an
error. Repeated rows are documents of their own. Columns other than the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.storage import materialise, new_path

END = 50256
#: Tokens in a block, and documents in a file that write_tokens makes.
BLOCK = 1 << 20
FILE_DOCUMENTS = 4000


def write_tokens(docs: DataFrame, path: str, ranks: str, pattern: str, text_col: str = "text") -> None:
    """Encode every whole text (null: empty) with the vocabulary file ``ranks`` and write token files to ``path``.

    The text writer puts the end-of-document id, as its line separator, after each document's bytes, and commits a
    task's files only when the task has ended.
    """
    with open(ranks, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(blob.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.column(0).slice(at, 500)
                yield pa.RecordBatch.from_arrays([pa.array([np.array(encoding.encode_ordinary(t.as_py() or ""), "<u2").tobytes() for t in some], pa.binary())], ["tokens"])

    rows = docs.select(text_col).mapInArrow(run, "tokens binary")
    separator = int(END).to_bytes(2, "little").decode("latin-1")
    rows.select(F.col("tokens").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)


_MADE: dict[int, object] = {}


def _encoding(blob: bytes, pattern: str):
    key = hash((blob, pattern))
    if key not in _MADE:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        _MADE[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[key]


def _open(path: str):
    """The file, for reading at any place: a local or mounted path, or a URI of a file system that pyarrow knows."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    return files.open_input_file(inner)


def blocks(spark: SparkSession, path: str, end: int = END, size: int = BLOCK) -> DataFrame:
    """One row per block, written once: file, block, n_tokens, ends (places of separators in the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, length in zip(*(c.to_pylist() for c in batch.columns)):
                at = 2 * size * block
                with _open(file) as f:
                    f.seek(at)
                    tokens = np.frombuffer(f.read(min(2 * size, length - at)), "<u2")
                ends = np.flatnonzero(tokens == end) + size * block
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "n_tokens", "ends"])

    # the contents are not selected, so this only lists the files
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select(F.col("path").alias("file"), "length")
    last = F.floor((F.col("length") - 1) / (2 * size))
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "length")
    dealt = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")
    return materialise(dealt.mapInArrow(run, "file string, block long, n_tokens long, ends array<long>"), "token-blocks")


def documents(scanned: DataFrame) -> DataFrame:
    """From blocks, one row per document: file, doc_no, start, n_tokens, ended. The blocks are read once."""
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    scan = scanned.select(
        "file",
        "ends",
        F.coalesce(F.last(last, ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"),
        (F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) + F.col("n_tokens")).alias("upto"),
        F.lead("file").over(order).isNull().alias("is_last"),
    )
    # the rest of a file after its last separator stands behind the file's separators, at the file's end
    open_rest = F.col("is_last") & (F.col("upto") > F.coalesce(last, F.col("carry")) + 1)
    all_ends = F.when(open_rest, F.concat("ends", F.array("upto"))).otherwise(F.col("ends"))
    every = scan.select("file", "carry", "done", "ends", F.posexplode(all_ends).alias("i", "end"))
    start = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("carry")) + 1
    return every.select("file", (F.col("done") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("i") < F.size("ends")).alias("ended"))


def count_tokens(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Write the documents as token files and count them: part, chunk (which name the file), doc_no, start, n_tokens."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, ranks, pattern, text_col)
    found = documents(blocks(spark, path))
    name = lambda k: F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)", k).cast("int")
    return found.select(name(1).alias("part"), name(2).alias("chunk"), "doc_no", "start", "n_tokens")
