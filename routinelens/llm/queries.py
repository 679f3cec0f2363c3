"""The queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routinelens.llm import collocations, licences, revisits, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Where the public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routinelens.llm import bpe

    return bpe.encode(_table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from routinelens.llm import tokencount

    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).drop("n_looked")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routinelens.llm import simhash

    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve(*revisits.captures(_table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", revisits.flat(resolved["headers"]))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routinelens.llm import mixing

    return mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routinelens.llm import suffix

    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routinelens.llm import exact

    return exact.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routinelens.llm import pii

    return pii.scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routinelens.llm import quality

    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from routinelens.llm import packing

    return packing.decompose(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_licences": op3_licences,
    "op4_simhash": op4_simhash,
    "op5_revisits": op5_revisits,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_trie": op11_trie,
    "op12_packing": op12_packing,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_licences": licences.oracle(),
    "op5_revisits": revisits.oracle(),
    "op11_trie": trie.ORACLE,
    "op13_collocations": collocations.ORACLE,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY s) AS group_size,
               row_number() OVER w = 1 AS kept,
               s AS text_sha256
        FROM d WINDOW w AS (PARTITION BY s ORDER BY chars DESC, doc_id)""",
}
