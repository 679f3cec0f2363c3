import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = ("id", "key", "digest", "run", "place", "fp", "row", "kept", "cell", "features", "labelled_id", "words", "hits", "n_words", "fingerprint", "rate")


def edge_texts() -> list[tuple]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = [" ".join(word() for _ in range(90)) for _ in range(8)]
    texts = [None, "", " \t\n\x0b\x0c\r", "word", "Éa ÀB ÉÀ ß ſ KK İ Σς", "a" * 30_000, "MIT License. x the apache\nlicense mit LICENSE", "<|endoftext|> hi <|startoftext|>there", "日本語 テスト 한국어 é", "don't I'll we've 'S !!'s 12 34"]
    texts += prose + [prose[0], prose[0].replace(" ", "\n  "), prose[1] + " tail", prose[2] + " " + prose[2], prose[3] + "\n" + prose[3] + "\n\n" + prose[3]]
    texts += [" ".join(word() for _ in range(6000)), "same " * 400, "x | y | z " * 30, "a@b.co +1 (555) 123-4567 call 10.0.0.300 1.2.3.4.5 4111 1111-1111 1111 password=abcd1234efgh"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def edge_rows():
    rows = edge_texts()
    return rows + [rows[10], rows[2]]  # repeated rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(20)] + [(None, 0, 0), (3, None, 1), (999, 1, 1), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
