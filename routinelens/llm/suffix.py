"""Removal of repeated byte strings by a sparse suffix array with deep-shallow sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else in the corpus too.

1. Equal texts become one row with a count, in a table bucketed by the text's digest, which later steps join
   without another shuffle of texts.
2. Each window of LENGTH bytes chooses, of its GRAM-byte strings, the one of smallest hash (the leftmost of equal
   ones): its anchor. Equal windows choose alike, so windows need comparing only under one anchor string. The windows
   of one anchor are a run of neighbouring starts; its bytes are the anchor's payload.
3. Payloads are counted by (anchor hash, payload hash), which settles runs that are found twice as they stand and
   anchor strings that are found once. What is left are anchors with two or more different payloads.
4. Of these each payload is fetched once, and the suffixes that start at the anchors are sorted, and likewise the
   reversed prefixes that end there: multikey quicksort down to ``SHALLOW`` bytes, then a blind trie for every group
   that is still together. Order and common prefixes give, for each distance l between window start and anchor, which
   payloads agree on l bytes before and LENGTH - l bytes after it, byte by byte.
5. The runs found go back to the texts that hold them, and the texts are cut.

An anchor that many payloads share is split before it is sorted. Two payloads agree on a window whose anchor stands at a distance from a to b
only if they agree on the a bytes before the anchor and on the LENGTH - b bytes from it on. So each payload of such an anchor goes, for every interval
[a, b] of ``INTERVALS``, to the group of those that have these bytes in common, with the b - a bytes to either side that are left
to compare. Intervals are short where the common bytes are few; at a single distance nothing is left to compare, and a count by
group, which tasks share, settles it. Other anchors have the one interval of all distances. Either way the bytes are
compared by the same sort, and no result depends on where ``SPLIT`` stands.

Defined results: a null text is empty. Texts shorter than LENGTH bytes stay whole. Repeated rows are copies of each other.
Columns other than the id and the text are not read, so their names cannot clash. Texts of any length are handled in slices. Of equal hashes in
a window the leftmost is the anchor. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.storage import materialise, new_path

LENGTH = 200
GRAM = 32
SHALLOW = 8
#: The largest distance from the start of a window to its anchor.
FAR = LENGTH - GRAM
#: An anchor with more payloads than this is split by the intervals of distances below.
SPLIT = 500
INTERVALS = ((0, 0), (1, 1), (2, 3), (4, 7), (8, 15), (16, 31), (32, 63), (64, 104), (105, 136), (137, 152), (153, 160), (161, 164), (165, 166), (167, 167), (168, 168))
SLICE = 1 << 19
#: Texts handed on in one batch.
PACKED = 500
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = hashlib.sha256(b"").hexdigest()


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows its anchor's hash and place, its first start and the start after its last."""
    parts = []
    size = SLICE
    for base in range(0, max(0, len(text) - LENGTH + 1), size):
        parts.append(_runs(np.frombuffer(text, np.uint8)[base : base + size + LENGTH - 1], base))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(b: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h, mult, n = b.astype(np.uint64) + np.uint64(1), _STEP, 1
        while n < GRAM:
            h = h[:-n] * mult + h[n:]
            mult, n = mult * mult, 2 * n
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    mask = np.uint64((1 << 20) - 1)
    least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span, n = LENGTH - GRAM + 1, 1
    while 2 * n <= span:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    if span > n:
        least = np.minimum(least[: n - span], least[span - n :])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    place = (least[first] & mask).astype(np.int64)
    return h[place], place + base, first + base, np.append(first[1:], len(least)) + base


def payload_keys(text: bytes, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter([digest(text[a : b + LENGTH - 1]) for a, b in zip(first.tolist(), after.tolist())], np.uint64, len(first))


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie(items: list[bytes], members: list[int]) -> list[int]:
    """The members in the order of their strings, by a trie that keeps branching depths and single bytes only."""
    root: list = [0, {}]
    leaves: list[list[int]] = [[members[0]]]
    root[1][items[members[0]][0] if items[members[0]] else -1] = ~0
    for m in members[1:]:
        s = items[m]
        node = root
        while True:  # blind descent: skipped bytes are not compared
            key = s[node[0]] if node[0] < len(s) else -1
            down = node[1].get(key)
            if down is None:
                down = next(iter(node[1].values()))
            if isinstance(down, int):
                break
            node = down
        other = items[leaves[~down][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            leaves[~down].append(m)
            continue
        node = root  # second descent, to the edge where the strings part
        while True:
            key = other[node[0]] if node[0] < len(other) else -1
            if node[0] == depth:
                node[1][s[depth] if depth < len(s) else -1] = ~len(leaves)
                break
            down = node[1][key]
            if isinstance(down, int) or down[0] > depth:
                node[1][key] = [depth, {other[depth] if depth < len(other) else -1: down, s[depth] if depth < len(s) else -1: ~len(leaves)}]
                break
            node = down
        leaves.append([m])
    out: list[int] = []
    stack: list = [root]
    while stack:
        top = stack.pop()
        if isinstance(top, int):
            out += leaves[~top]
        else:
            stack += [top[1][k] for k in sorted(top[1], reverse=True)]
    return out


def deep_shallow(items: list[bytes]) -> list[int]:
    """The order of the strings: multikey quicksort to SHALLOW bytes, blind tries below."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(items))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if depth >= SHALLOW:
            out += blind_trie(items, group)
            continue
        keys = [items[i][depth] if depth < len(items[i]) else -1 for i in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        same = [i for i, k in zip(group, keys) if k == pivot]
        if len(same) == len(group):
            if pivot < 0:
                out += group
            else:
                stack.append((group, depth + 1))
            continue
        stack.append(([i for i, k in zip(group, keys) if k > pivot], depth))
        stack.append((same, depth + 1) if pivot >= 0 else (same, SHALLOW))
        stack.append(([i for i, k in zip(group, keys) if k < pivot], depth))
    return out


def repeats(before: list[bytes], after: list[bytes], twice: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """For payloads that agree around an anchor, the distances from window start to there whose windows another one has.

    before: the bytes before what they have in common, reversed; after: those behind it; length: how many bytes of both sides
    together a window has. For each payload, which itself has all windows that fit, half-open intervals of distances; those of a
    payload that is found twice are left out.
    """
    c = len(before)
    order_a, order_b = deep_shallow(after), deep_shallow(before)
    lcp_a = np.array([0] + [common(after[i], after[j]) for i, j in zip(order_a, order_a[1:])])
    lcp_b = np.array([0] + [common(before[i], before[j]) for i, j in zip(order_b, order_b[1:])])
    order_a, order_b = np.array(order_a), np.array(order_b)
    low = np.array([length - len(x) for x in after])
    high = np.array([len(x) for x in before])
    ends = np.unique(np.concatenate((lcp_b + 1, length - lcp_a, low, high + 1)))
    ends = ends[(ends >= max(0, int(low.min()))) & (ends <= int(high.max()) + 1)]
    once = ~np.array(twice)
    found: list[list[tuple[int, int]]] = [[] for _ in range(c)]
    kind = np.empty(c, np.int64)
    part = np.empty(c, np.int64)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        kind[order_a] = np.cumsum(lcp_a < length - a)
        part[order_b] = np.cumsum(lcp_b < a)
        live = np.flatnonzero((low <= a) & (high >= a))
        if len(live) < 2:
            continue
        _, which, count = np.unique(kind[live] * (c + 1) + part[live], return_inverse=True, return_counts=True)
        for i in live[(count[which] > 1) & once[live]].tolist():
            if found[i] and found[i][-1][1] == a:
                found[i][-1] = (found[i][-1][0], b)
            else:
                found[i].append((a, b))
    return found


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The documents (id, key, n_bytes, sha) and the name of a table in the shared folder: the distinct texts (key, compressed text, copies), bucketed by key."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(text)).alias("key")
    held = materialise(docs.select(F.col(id_col).alias("id"), key, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "documents")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, PACKED):
                some = column.slice(at, PACKED)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, PACKED), pa.array([squeeze(t.as_py()) for t in some], pa.binary())], ["key", "text"])

    # texts travel compressed: less to shuffle, and less that the JVM holds at a time
    long_enough = docs.select(key, text.alias("text")).filter(F.octet_length("text") >= LENGTH).mapInArrow(pack, "key binary, text binary")
    distinct = long_enough.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    distinct.write.option("path", new_path(spark, "texts")).option("compression", "uncompressed").bucketBy(n, "key").saveAsTable(name)
    return held, name


def _grams(texts: DataFrame) -> DataFrame:
    """Rows (key, kh, kp, n): each payload of each text, n counting the text's copies, 2 standing for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, unpack = batch.column(1), zstandard.ZstdDecompressor().decompress
            keys, of, kh, kp, n = batch.column(0), [], [], [], []
            held = 0
            for i in range(batch.num_rows):
                text = unpack(column[i].as_py())
                h, _, first, after = runs(text)
                pair = np.stack((h, payload_keys(text, first, after)), axis=1)
                pair, times = np.unique(pair, axis=0, return_counts=True)
                of.append(np.full(len(pair), i))
                kh.append(pair[:, 0])
                kp.append(pair[:, 1])
                n.append(np.minimum(2, times * batch.column(2)[i].as_py()))
                held += len(pair)
                if held > 500_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(of))), *(pa.array(np.concatenate(x).view(np.int64)) for x in (kh, kp, n))], ["key", "kh", "kp", "n"])
                    of, kh, kp, n, held = [], [], [], [], 0

    return texts.select("key", "text", "copies").mapInArrow(run, "key binary, kh long, kp long, n long")


def pieces(before: bytes, after: bytes, intervals: tuple[tuple[int, int], ...]) -> Iterator[tuple[bytes, int, int, bytes, bytes]]:
    """For each interval of distances that the payload has windows in: its group, the interval, and the bytes left to compare."""
    low, high = LENGTH - len(after), len(before)
    for a, b in intervals:
        if low <= b and high >= a:
            yield xxhash.xxh3_128_digest(bytes((a,)) + before[:a] + after[: LENGTH - b]), a, b, before[a:b], after[LENGTH - b : LENGTH - a]


def _payloads(wanted: DataFrame, intervals: tuple[tuple[int, int], ...]) -> DataFrame:
    """From rows (text, wanted: array of (kh, kp, n)): rows (g, a, b, kh, kp, n, before, after), one for each piece of each payload."""
    names = ["g", "a", "b", "kh", "kp", "n", "before", "after"]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, unpack = batch.column(0), zstandard.ZstdDecompressor().decompress
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                text = unpack(column[i].as_py())
                left = {(w["kh"], w["kp"]): w["n"] for w in batch.column(1)[i].as_py()}
                h, place, first, after = runs(text)
                signed = zip(h.view(np.int64).tolist(), payload_keys(text, first, after).view(np.int64).tolist(), place.tolist(), first.tolist(), after.tolist())
                for kh, kp, p, start, end in signed:
                    n = left.pop((kh, kp), None)
                    if n is not None:
                        for g, a, b, x, y in pieces(text[start:p][::-1], text[p : end + LENGTH - 1], intervals):
                            for column_of, v in zip(out, (g, a, b, kh, kp, n, x, y)):
                                column_of.append(v)
                if len(out[0]) > 50_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)
                    out = [[] for _ in names]

    return wanted.select("text", "wanted").mapInArrow(run, "g binary, a int, b int, kh long, kp long, n long, before binary, after binary")


_CUTS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_groups(payloads: DataFrame) -> DataFrame:
    """Rows (kh, kp, cuts) from pieces that lie together and in order by g."""

    def settle(group: list[tuple]) -> tuple[list, list, list]:
        shift, size = group[0][1], group[0][2] - group[0][1]
        found = repeats([g[6] for g in group], [g[7] for g in group], [g[5] > 1 for g in group], size)
        hit = [(g, f) for g, f in zip(group, found) if f]
        return [g[3] for g, _ in hit], [g[4] for g, _ in hit], [[{"a": a + shift, "b": b + shift} for a, b in f] for _, f in hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _CUTS)], ["kh", "kp", "cuts"])
            for x in out:
                x.clear()
            return made

        def close() -> None:
            if len(group) > 1:
                for x, y in zip(out, settle(group)):
                    x += y

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    close()
                    group = []
                group.append(row)
            yield flush()
        close()
        yield flush()

    return payloads.mapInArrow(run, "kh long, kp long, cuts array<struct<a:int,b:int>>")


def _counted(single: DataFrame) -> DataFrame:
    """Rows (kh, kp, cuts) from pieces at single distances: those of a group of two or more are found elsewhere too."""
    often = single.groupBy("g").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("g")
    cut = F.array(F.struct(F.col("a").alias("a"), (F.col("a") + 1).alias("b")))
    return single.filter("n = 1").join(often, "g").select("kh", "kp", cut.alias("cuts"))


def _cut(texts: DataFrame) -> DataFrame:
    """From rows (key, text, found: array of (kh, kp, cuts)), null cuts meaning all: rows (key, n_removed, n_spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, unpack = batch.column(1), zstandard.ZstdDecompressor().decompress
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text = unpack(column[i].as_py())
                found: dict[tuple[int, int], list | None] = {}
                for f in batch.column(2)[i].as_py():
                    cuts = f["cuts"]
                    found[f["kh"], f["kp"]] = None if cuts is None else (found.get((f["kh"], f["kp"])) or []) + cuts
                h, place, first, after = runs(text)
                edge = np.zeros(len(text) + 1, np.int32)
                keys = zip(h.view(np.int64).tolist(), payload_keys(text, first, after).view(np.int64).tolist(), place.tolist(), first.tolist(), after.tolist())
                for kh, kp, p, a, b in keys:
                    if (kh, kp) in found:
                        cuts = found[kh, kp]
                        for x, y in [(a, b)] if cuts is None else [(p - c["b"] + 1, p - c["a"] + 1) for c in cuts]:
                            edge[x] += 1
                            edge[y + LENGTH - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                kept.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["key", "n_removed", "n_spans", "kept"])

    return texts.mapInArrow(run, "key binary, n_removed long, n_spans long, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    held, name = _texts(docs, id_col, text_col)
    try:
        cut, copied = _found(docs.sparkSession.table(name))
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    every = held.join(copied, "key", "left").join(cut, "key", "left")
    return every.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _found(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the distinct texts, those that are cut (key, n_removed, n_spans, kept) and those that go whole as copies (key, copied); both written."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = materialise(_grams(texts), "payloads")
    counted = grams.groupBy("kh", "kp").agg(F.sum("n").alias("n"))
    anchors = counted.groupBy("kh").agg(F.count(F.lit(1)).alias("rivals"), F.sum("n").alias("total")).filter("total > 1").select("kh", "rivals")
    known = materialise(counted.join(anchors, "kh").select("kh", "kp", "n", "rivals"), "repeated-payloads")
    held_by = materialise(grams.select("key", "kh", "kp").join(known, ["kh", "kp"]), "payloads-of-texts")

    some = held_by.filter("rivals > 1").groupBy("kh", "kp").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("rivals").alias("rivals"))
    wanted = some.groupBy("key", (F.col("rivals") > SPLIT).alias("hot")).agg(F.collect_list(F.struct("kh", "kp", "n")).alias("wanted"))
    wanted = materialise(wanted, "wanted-payloads")
    # both kinds meet in one sort, so that its tasks are not those of the hot anchors alone
    lie_together = lambda rows: rows.repartition(parts, "g").sortWithinPartitions("g")
    few = _payloads(texts.join(wanted.filter("not hot"), "key"), ((0, FAR),))
    if wanted.filter("hot").isEmpty():
        found = _sorted_groups(lie_together(few))
    else:
        many = materialise(_payloads(texts.join(wanted.filter("hot"), "key"), INTERVALS), "split-payloads")
        found = _sorted_groups(lie_together(few.unionByName(many.filter("a < b")))).unionByName(_counted(many.filter("a = b")))
    found = materialise(found, "repeated-windows")

    whole = held_by.filter("n > 1").select("key", "kh", "kp", F.lit(None).cast("array<struct<a:int,b:int>>").alias("cuts"))
    partly = held_by.filter("n = 1 and rivals > 1").select("key", "kh", "kp").join(found, ["kh", "kp"])
    marks = whole.unionByName(partly).groupBy("key").agg(F.collect_list(F.struct("kh", "kp", "cuts")).alias("found"))
    single = texts.filter("copies = 1").select("key", "text")
    cut = materialise(_cut(single.join(marks, "key").select("key", "text", "found")), "cut-texts")
    return cut, materialise(texts.filter("copies > 1").select("key", F.lit(True).alias("copied")), "copied-texts")
