"""Phrase collocations against a plain count, over many small blocks, chunks and ranges, with nulls, ties, repeats and clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routinelens.llm import collocations


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                f.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    found = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    covered = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= 80 * f[lang, p[i : i + m]]:
                    covered.add((lang, p[i : i + m]))
    by = {}
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in by.items() for k, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["É", "ß", "日本", "New", "YORK", "İ"]
    rows = []
    for k in range(150):
        text = "".join(rng.choice(words[: 6 + k % 30]) + rng.choice([" "] * 9 + ["\t", ". ", ",", "\n", "  ", "\x0b", ";"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None, "und", ""])))
    rows += [("the very common phrase. " * 200, "en"), (None, "en"), ("", None), ("in new york city " * 30, "de"), ("a\x1cb a\x1cb", "en")]
    return rows + rows[:5]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_a_plain_count(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 50), ("CHUNK", 70), ("RANGE", 40), ("SAMPLE_BLOCKS", 5), ("SAMPLE_KEYS", 16), ("MAX_BITS", collocations._SEGMENT)):
            monkeypatch.setattr(collocations, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    df = df.select("*", *[F.lit("own").alias(c) for c in ("block", "ids", "id", "word", "n", "range", "hi", "lo", "a", "score", "rank")])
    got = collocations.collocations(df, least=4, top=40)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 40)
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([(None, "en"), ("few words here", None)], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(none.filter("false")).count() == 0


def test_radix_order_and_run_lengths():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 5000) << 40 | rng.integers(0, 5, 5000), rng.integers(0, 1 << 62, 5000) // (1 << 60) << 33]
    counts = rng.integers(1, 9, 5000)
    want = Counter()
    for *key, c in zip(*columns, counts):
        want[tuple(map(int, key))] += int(c)
    own, sums = collocations.run_lengths(columns, counts)
    assert list(zip(*map(np.ndarray.tolist, own), sums.tolist())) == [(*k, v) for k, v in sorted(want.items())]
    own, sums = collocations.run_lengths([np.array([5, 1 << 62, 5, 0])])
    assert own[0].tolist() == [0, 5, 1 << 62] and sums.tolist() == [1, 2, 1]
    assert np.array_equal(np.argsort(collocations._bytes(columns), kind="stable"), collocations.radix_order(columns))


def test_scores_pass_64_bits(spark):
    big = 1 << 43
    words = spark.createDataFrame([("en", "a", big + 1, 1), ("en", "b", big + 5, 2)], "lang string, word string, f long, gid long")
    pair = spark.createDataFrame([(1 << 32 | 2, 0, big)], "hi long, lo long, a long")
    assert collocations.scored(pair, words).first()["score"] == 2000000 * big // (2 * big + 6)
