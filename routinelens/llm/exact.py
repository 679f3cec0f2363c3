"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition yields a run: one row per normalised text it holds, with the count of its documents and
the one that stays. In each round ``FAN`` neighbouring runs become one: a sort-based aggregate merges their
rows in digest order and keeps the better survivor, so the rows of a text shrink to one per run before they
meet those of other runs. A run is spread over all tasks by digest, so no round ends in a single task, and a
text that a third of all rows share reaches any task as at most ``FAN`` rows a round.

Two texts are merged only where SHA-256, XXH64 and the length in bytes agree.

Defined results: a null text is the empty text; texts of nothing but white space are all equal. Of equal texts
the one with the most code points stays, then the smallest id (a null id comes last), then, for repeated
rows, the one that was read first. Texts of any length are hashed whole in the row that holds them. Columns other than the id and the text are not read by
exact_dedup(), so their names do not matter, and drop_exact_copies() packs them away while it works. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.storage import materialise

#: Runs merged into one in a round.
FAN = 8
#: At most so many places of copies are sent to all tasks.
SENT = 4_000_000
KEY = ("digest", "check", "n_bytes")


def normalised(text: Column) -> Column:
    """The text without the characters U+0009 to U+000D and U+0020."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def key_columns(text: Column) -> list[Column]:
    norm = normalised(text)
    return [F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(norm).alias("check"), F.octet_length(norm).alias("n_bytes")]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, written once: id, place, run, chars and the key of its text."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("place"),
        F.spark_partition_id().alias("run"),
        F.length(F.coalesce(text, F.lit(""))).alias("chars"),
        *key_columns(text),
    )
    return materialise(rows, "digest-runs")


def tree_merge(runs: DataFrame) -> DataFrame:
    """One row per distinct text: its key, group_size, keep_id and keep_place."""
    last = runs.agg(F.max("run")).first()[0] or 0
    best = F.struct((-F.col("chars")).alias("shorter"), F.col("id").isNull().alias("nameless"), "id", "place")
    merged = runs.groupBy("run", *KEY).agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
    while last > 0:
        last //= FAN
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
            .groupBy("run", *KEY)
            .agg(F.sum("group_size").alias("group_size"), F.min("best").alias("best"))
        )
    return merged.select(*KEY, "group_size", F.col("best.id").alias("keep_id"), F.col("best.place").alias("keep_place"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256 and the key of the text."""
    runs = digest_runs(docs, id_col, text_col)
    groups = tree_merge(runs)
    return runs.join(groups, list(KEY)).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("place") == F.col("keep_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows are told by a place of their own, so equal ids and texts do not matter.

    Texts are not shuffled while the places that go are few enough to be sent to all tasks; beyond that they are, once.
    """
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    held = materialise(docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), packed), "held-documents")
    runs = materialise(held.select("id", "place", F.spark_partition_id().alias("run"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), *key_columns(F.col("text"))), "digest-runs")
    gone = materialise(runs.join(tree_merge(runs), list(KEY)).filter("place <> keep_place").select("place"), "exact-copies")
    gone = F.broadcast(gone) if gone.count() <= SENT else gone
    return held.join(gone, "place", "left_anti").select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
