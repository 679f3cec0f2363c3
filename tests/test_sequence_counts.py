"""Patterns are counted where their sequences are: the same as plain loops over them, and without a row for every place of a pattern."""

import random
import time
from itertools import combinations

import pytest

from routinelens.operators import sequences


def loop(rows, least):
    count = {}
    for items in rows:
        for n in (2, 3, 4):
            for found in combinations(items, n):
                count[found] = count.get(found, 0) + 1
    return {k: v for k, v in count.items() if v >= least}


@pytest.mark.parametrize("block, chains, dense", [(1 << 16, 1 << 20, 1 << 23), (40, 50, 0), (7, 1, 30_000)])
def test_patterns_equal_a_loop(spark, monkeypatch, block, chains, dense):
    for name, value in (("BLOCK", block), ("CHAINS", chains), ("DENSE", dense)):
        monkeypatch.setattr(sequences, name, value)
    rng = random.Random(9)
    rows = [rng.sample([f"light.{c}=on" for c in "abcdefghijklm"], rng.randrange(2, 12)) for _ in range(90)] + [[f"once.{k}", "light.a=on"] for k in range(20)]
    df = spark.createDataFrame([(f"s{k}", r) for k, r in enumerate(rows)], "seq_id string, items array<string>").repartition(3)
    for least in (1, 3, 9):
        got = sequences.patterns(df, least).collect()
        assert {tuple(r["items"]): r["support"] for r in got} == loop(rows, least) and len({tuple(r["items"]) for r in got}) == len(got)
        assert all(r["length"] == len(r["items"]) and r["pattern"] == ">".join(r["items"]) for r in got)


def test_no_sequences_have_no_patterns(spark):
    assert sequences.patterns(spark.createDataFrame([], "seq_id long, items array<string>"), 1).collect() == []


def test_long_sequences_are_counted_in_time(spark):
    df = spark.range(3000).selectExpr("id AS seq_id", "transform(sequence(0, 27), x -> concat('i', (x * 5 + id) % 28)) AS items")
    began = time.time()
    assert sequences.patterns(df, 3000).count() == 0
    assert sequences.patterns(df, 1).filter("length = 4").selectExpr("sum(support)").first()[0] == 3000 * 20475
    assert time.time() - began < 60  # 61 million places of patterns
