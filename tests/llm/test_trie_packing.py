"""Conversation trie and packing against brute force, with nulls, ties, repeats, long conversations, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routinelens.llm import packing, trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            sha = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            key = [int.from_bytes(sha[i : i + 8], "big", signed=True) for i in (0, 8)]
            turns[conv].append(((turn is not None, turn or 0, key), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        todo, saved, leaves = [node], 0, 0
        while todo:
            n = todo.pop()
            saved += (len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0)
            leaves += not children[n]
            todo += children[n]
        return leaves, saved

    out = []
    for node, cs in members.items():
        leaves, saved = below(node)
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rows = []
    for c in range(60):
        for t in range(c % 5 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"words of turn {t if c % 3 else 0} {'hot' if c < 40 else c % 7}"))
    rows += [(100, None, "user", "first"), (100, 1, None, None), (100, 2, "", ""), (101, 1, None, None), (101, 5, "user", " \t "), (None, 1, "user", "nobody's"), (140, 3, "a", "bc"), (141, 3, "ab", "c")]
    rows += [(7, 0, "user", "tie b"), (7, 0, "user", "tie a"), (7, 0, "user", "tie a")]  # ties and a repeated row
    rows += [(200 + k, t, "user", f"long {t}" if t < 40 + k else f"own {k}") for k in range(4) for t in range(45)]
    rows += [(5000 + k, 0, "user", "one very common conversation") for k in range(30)]
    return rows


@pytest.mark.parametrize("slot, run", [(trie.SLOT, trie.RUN), (4, 8)])
def test_trie_equals_brute_force(spark, monkeypatch, slot, run):
    monkeypatch.setattr(trie, "SLOT", slot)
    monkeypatch.setattr(trie, "RUN", run)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    df = df.select("*", *[F.lit("own").alias(c) for c in ("conv", "depth", "k1", "len", "since", "words", "slot")])
    got = trie.conversation_trie(df)
    assert dict(got.dtypes) == {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "user", "nobody's")], "conv_id long, turn int, role string, text string")
    assert trie.conversation_trie(none).count() == 0
    assert trie.conversation_trie(none.filter("false")).count() == 0


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing_equals_the_library(spark, edge, edge_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    want = defaultdict(list)
    for doc_id, text in edge_rows:
        want[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    rows = packing.decompose(edge, vocabulary()).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)  # a piece is a sequence
    parts = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) == 1 << r["bucket"] <= packing.LONGEST and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        parts[r["doc_id"], r["start"]].append(r)
    for doc_id, docs in want.items():
        got = [0] * len(docs)
        for k, ids in enumerate(docs):  # repeated rows give equal pieces, each as often
            start = 0
            while start < len(ids):
                here = parts[doc_id, start]
                assert len(here) == len(docs) and here[k]["ids"] == ids[start : start + here[k]["length"]] and here[k]["doc_tokens"] == len(ids)
                start += here[k]["length"]
                got[k] += 1
        assert got[0] == len(ids) // 2048 + (len(ids) % 2048).bit_count()
    assert sum(r["length"] for r in rows) == sum(len(ids) for docs in want.values() for ids in docs)


def test_packing_cuts_long_texts_where_tokens_part(spark, monkeypatch):
    from tokenizers import Tokenizer

    texts = ["it's a  b   c\n d <|endoftext|> e " * 40, "x" * 3000 + " y", " " * 500 + "z " * 300, "don't <|endoftext|>we'll 12 345!! ?\t a", "é ñ " * 200]
    encoder, tokenizer = packing._loaded(open(vocabulary(), encoding="utf-8").read()), Tokenizer.from_file(vocabulary())
    for size, long in ((64, 128), (7, 9)):
        monkeypatch.setattr(packing, "SEGMENT", size)
        monkeypatch.setattr(packing, "LONG_SEGMENT", long)
        for text in texts:
            assert "".join(packing.segments(text)) == text
            assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_edges(spark, empty, tmp_path):
    assert packing.decompose(empty, vocabulary()).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "two words"), (1, "")], "doc_id long, text string")
    rows = packing.decompose(nulls, vocabulary()).collect()
    assert sorted((str(r["doc_id"]), r["length"], r["doc_tokens"]) for r in rows) == [("1", 1, 1), ("None", 1, 1), ("None", 1, 3), ("None", 2, 3)]
    packing.write_buckets(packing.decompose(nulls, vocabulary()), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("bucket = 1").count() == 1
    with pytest.raises(ValueError):
        packing.decompose(nulls, vocabulary(), longest=1000)
    assert packing.binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8] and packing.binary_lengths(13, 4) == [4, 4, 4, 1]
