"""Phrase collocations: frequent words as numbers, n-grams as fixed-width keys, sorted in ranges and counted by runs.

1. Each task reads its texts once and writes blocks: a block's words numbered as they come (one int each, -1 ends a piece) and its own
   vocabulary with counts. No dictionary is needed to do so, and none is sent around.
2. Vocabularies summed give every word's count. Words of the least count or more get a number from 1 that stands for (language, word).
3. Each block gets the numbers of its own vocabulary only, by a join, and is rewritten: 0 parts what pieces' ends and rarer words part. Every phrase
   counted is of such words, so no count is lost.
4. Two-word keys (two numbers of four bytes) are sorted by radix and counted by runs within a task, cut at the bounds of ranges and merged per range: that is
   what is shuffled. A key is in a task's run once, so a word pair that is everywhere is one entry of each run.
5. Words of three- and four-word phrases must be frequent pairs throughout. A bitmap of hashed frequent pairs, of at most ``MAX_BITS`` bits whatever the
   input, parts the rest; it lets a few others pass, which their counts then drop. Their keys have 16 bytes and go the same way.
6. Parts of candidates are looked up by their keys; scores are whole numbers in decimals of 38 digits.

The bounds of ranges come from a bounded sample of keys. They only say which task counts a key.

Defined results: a null text is empty, a null language is ``und``, together with texts of that language. Texts are read whole; one of many words fills
several blocks, cut between pieces. Repeated rows count each time; ties are ordered as stated. Columns other than the two are not read. No rows, or no
phrase often enough, give no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.storage import materialise

#: Least count of a phrase, its most words, the share (of 100) of its places that a longer one has when it stands for it, and rows a language.
LEAST, WORDS, INSIDE, TOP = 30, 4, 80, 2000
#: Numbers of a block, keys sorted at a time, keys of a range as planned, bits of the bitmap at most and per pair.
BLOCK, CHUNK, RANGE, MAX_BITS, PER_PAIR = 1 << 19, 1 << 22, 1 << 20, 1 << 28, 16
#: Blocks and keys of each in the sample for bounds.
SAMPLE_BLOCKS, SAMPLE_KEYS = 64, 4096
_SEGMENT = 1 << 19
_PARTS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_HASH = (1_640_531_527, 1_103_515_245)
UNKNOWN = "und"


class _Numbers(dict):
    """Words to numbers; a new word takes the next one of a counter that all languages of a block share."""

    def __init__(self, counter: Iterator[int]) -> None:
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.counter)
        return n


def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int | None = None) -> DataFrame:
    """Rows of two kinds, written: a block's numbers (block, ids), and each word of it (block, id, lang, word, n)."""
    limit = size or BLOCK
    names = ["block", "ids", "id", "lang", "word", "n"]
    types = [pa.string(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int64()]

    def rows(name: str, ids: array, langs: dict[str, _Numbers]) -> Iterator[pa.RecordBatch]:
        made = np.frombuffer(ids, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([made.tobytes()], pa.binary()), *[pa.nulls(1, t) for t in types[2:]]], names)
        counts = np.bincount(made[made >= 0], minlength=1)
        for lang, numbers in langs.items():
            if numbers:
                own = np.fromiter(numbers.values(), np.int32, len(numbers))
                words = pa.array(list(numbers), pa.binary()).cast(pa.string())
                k = len(own)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), k), pa.nulls(k, pa.binary()), pa.array(own), pa.repeat(pa.scalar(lang), k), words, pa.array(counts[own], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, counter, langs = array("i"), count(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                name = lang.as_py()
                name = UNKNOWN if name is None else name
                if name not in langs:
                    langs[name] = _Numbers(counter)
                number = langs[name].__getitem__
                for piece in (text.as_py() or b"").lower().translate(_PARTS).split(b"\n"):
                    words = piece.split()
                    if words:
                        ids.extend(map(number, words))
                        ids.append(-1)
                        if len(ids) >= limit:
                            yield from rows(f"{part}-{nth}", ids, langs)
                            nth += 1
                            ids, counter = array("i"), count()
                            langs = {name: _Numbers(counter)}
                            number = langs[name].__getitem__
        if ids:
            yield from rows(f"{part}-{nth}", ids, langs)

    return materialise(docs.select(lang_col, text_col).mapInArrow(run, "block string, ids binary, id int, lang string, word string, n long"), "blocks")


def dictionary(held: DataFrame, least: int = LEAST) -> DataFrame:
    """From blocks(), words of the least count or more, written: lang, word, f and gid, a number from 1."""
    counts = held.filter("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    found = materialise(counts.withColumn("part", F.spark_partition_id()), "frequent-words")
    # one row a partition: how many words come before it
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = found.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select("part", before.alias("before"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("lang", "word"))
    numbered = found.withColumn("nth", nth).join(offsets, "part")
    # numbers have four bytes, of which the sign stays free
    gid = F.when(F.col("before") + F.col("nth") < 1 << 31, F.col("before") + F.col("nth")).otherwise(F.raise_error(F.lit("too many frequent words for numbers of four bytes")).cast("long"))
    return materialise(numbered.select("lang", "word", "f", gid.alias("gid")), "dictionary")


def encoded(held: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks in numbers of the dictionary, written: block, ids (ints; 0 parts) and n. Runs of one word are left out, as they have no phrase."""
    mapping = held.filter("word IS NOT NULL").select("block", "id", "lang", "word").join(words.select("lang", "word", F.col("gid").cast("int").alias("gid")), ["lang", "word"]).select(F.col("block").alias("own"), "id", "gid")
    texts = held.filter("ids IS NOT NULL").select("block", "ids")
    names = ["block", "ids", "n"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.int64())], names=names)
        ids = np.frombuffer(left.column("ids")[0].as_py(), np.int32)
        lookup = np.zeros(int(ids.max()) + 2, np.int32)  # the last place is for -1
        lookup[right.column("id").to_numpy()] = right.column("gid").to_numpy()
        new = np.concatenate(([0], lookup[ids], [0])).astype(np.int32)
        on = new > 0
        keep = np.flatnonzero(on[1:-1] & (on[:-2] | on[2:])) + 1  # words beside another
        if len(keep):
            breaks = np.flatnonzero(np.diff(keep) > 1) + 1
            new = np.append(np.insert(new[keep], breaks, 0), 0).astype(np.int32)
        else:
            new = new[:0]
        return pa.table([left.column("block").slice(0, 1), pa.array([new.tobytes()], pa.binary()), pa.array([len(new)], pa.int64())], names=names)

    return materialise(texts.groupBy("block").cogroup(mapping.groupBy("own")).applyInArrow(run, "block string, ids binary, n long").filter("n > 0"), "encoded-blocks")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of keys of one or more non-negative longs, by stable passes over digits of 16 bits, least first; digits that never change are passed over."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        spread = int(np.bitwise_or.reduce(column ^ column[:1])) if len(column) else 0
        for shift in (0, 16, 32, 48):
            if spread >> shift & 0xFFFF:
                digit = (column >> shift & 0xFFFF).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in order and how often each comes, or the sum of its counts."""
    n = len(columns[0])
    if not n:
        return columns, np.zeros(0, np.int64)
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, n)) if counts is None else np.add.reduceat(counts[order], starts)
    return [c[starts] for c in columns], sums


def _bytes(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as strings of bytes that sort as the keys do."""
    return np.ascontiguousarray(np.column_stack(columns).astype(">i8")).view(f"S{8 * len(columns)}")[:, 0]


def pair_keys(ids: np.ndarray) -> list[np.ndarray]:
    g = ids.astype(np.int64)
    at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0))
    return [g[at] << 32 | g[at + 1]]


def hashed(first: np.ndarray | Column, second: np.ndarray | Column) -> np.ndarray | Column:
    """A number under 2^63 of two under 2^31, before its middle bits are taken."""
    return first * _HASH[0] + second * _HASH[1]


def longer_keys(ids: np.ndarray, bitmap: np.ndarray) -> list[np.ndarray]:
    """Keys of the three and four words at each place whose pairs all pass the bitmap."""
    g = ids.astype(np.int64)
    bit = hashed(g[:-1], g[1:]) >> 24 & 8 * len(bitmap) - 1
    on = (g[:-1] > 0) & (g[1:] > 0) & (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
    three = np.flatnonzero(on[:-1] & on[1:])
    four = three[np.flatnonzero(on[np.minimum(three + 2, len(on) - 1)] & (three + 2 < len(on)))]
    at = np.concatenate((three, four))
    last = np.concatenate((np.zeros(len(three), np.int64), g[four + 3]))
    return [g[at] << 32 | g[at + 1], g[at + 2] << 32 | last]


def count_keys(blocks: DataFrame, kind: str, shared: object = None, least: int = LEAST) -> DataFrame:
    """Keys of the least count or more over all encoded blocks, written: hi, lo, a. kind: ``pair``, or ``longer`` with a broadcast bitmap."""
    width = 1 if kind == "pair" else 2
    chunk = CHUNK

    def keys(ids: bytes) -> list[np.ndarray]:
        found = np.frombuffer(ids, np.int32)
        return pair_keys(found) if kind == "pair" else longer_keys(found, np.frombuffer(shared.value, np.uint8))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column(0):
                own, _ = run_lengths(keys(ids.as_py()))
                n = len(own[0])
                some = [c[:: max(1, n // SAMPLE_KEYS)][:SAMPLE_KEYS] for c in own]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([b"".join(c.tobytes() for c in some)], pa.binary())], ["n", "keys"])

    n_blocks, n_ids = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    every = max(1, n_blocks // SAMPLE_BLOCKS)
    sample = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).select("ids").mapInArrow(sampled, "n long, keys binary").collect()
    parts = [np.frombuffer(r["keys"], np.int64).reshape(width, -1) for r in sample]
    bounds = np.zeros(0, f"S{8 * width}")
    if parts:
        ordered = np.sort(_bytes(list(np.concatenate(parts, axis=1))))
        share = sum(r["n"] for r in sample) / len(sample) * n_blocks  # keys to be merged, about
        ranges = int(max(1, min(len(ordered), share // RANGE)))
        bounds = np.unique(ordered[(np.arange(1, ranges) * len(ordered)) // ranges])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            own, sums = run_lengths([np.concatenate(c) for c in zip(*held)])
            cuts = [0, *np.searchsorted(_bytes(own), bounds).tolist(), len(sums)]
            rows = [(k, b"".join(c[i:j].tobytes() for c in own), sums[i:j].astype(np.int32).tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["range", "keys", "counts"])

        held, size = [], 0
        for batch in batches:
            for ids in batch.column(0):
                own = keys(ids.as_py())
                if len(own[0]):
                    held.append(own)
                    size += len(own[0])
                if size >= chunk:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merged(table: pa.Table) -> pa.Table:
        own = [np.concatenate(c) for c in zip(*[np.frombuffer(k.as_py(), np.int64).reshape(width, -1) for k in table.column("keys")])]
        sums = np.concatenate([np.frombuffer(c.as_py(), np.int32) for c in table.column("counts")]).astype(np.int64)
        own, sums = run_lengths(own, sums)
        at = np.flatnonzero(sums >= least)
        hi, lo = own[0][at], own[1][at] if width == 2 else np.zeros(len(at), np.int64)
        return pa.table([pa.array(hi), pa.array(lo), pa.array(sums[at])], names=["hi", "lo", "a"])

    counted = blocks.select("ids").mapInArrow(runs, "range int, keys binary, counts binary")
    return materialise(counted.groupBy("range").applyInArrow(merged, "hi long, lo long, a long"), f"{kind}-counts")


def pair_bitmap(pairs: DataFrame) -> bytes:
    """A bit for the hash of each pair; of fixed size at most, so it may go to all tasks."""
    wanted = PER_PAIR * pairs.count()
    bits = min(MAX_BITS, max(_SEGMENT, 1 << max(0, wanted - 1).bit_length()))
    low = F.col("hi").bitwiseAND(F.lit((1 << 32) - 1))
    bit = F.shiftright(hashed(F.shiftright("hi", 32), low), 24).bitwiseAND(F.lit(bits - 1))

    def segment(table: pa.Table) -> pa.Table:
        made = np.zeros(_SEGMENT, bool)
        made[table.column("bit").to_numpy() % _SEGMENT] = True
        return pa.table([table.column("segment").slice(0, 1), pa.array([np.packbits(made, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    found = pairs.select(bit.alias("bit")).distinct().select("bit", F.floor(F.col("bit") / _SEGMENT).alias("segment"))
    out = bytearray(bits // 8)
    for row in found.groupBy("segment").applyInArrow(segment, "segment long, bits binary").toLocalIterator():
        start = row["segment"] * _SEGMENT // 8
        out[start : start + _SEGMENT // 8] = row["bits"]
    return bytes(out)


def _id(k: int) -> Column:
    column = F.col("hi") if k < 3 else F.col("lo")
    return F.shiftright(column, 32) if k % 2 else column.bitwiseAND(F.lit((1 << 32) - 1))


#: Looked up of each candidate: its words (1 to 4) and its parts of two words or more, as (first word, words).
_LOOKUPS = {2: [], 3: [(1, 2), (2, 2)], 4: [(1, 2), (2, 2), (3, 2), (1, 3), (2, 3)]}


def scored(candidates: DataFrame, words: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Per candidate that no longer one stands for: lang, phrase, a, l, r and score."""
    size = F.when(F.col("lo") == 0, 2).when(_id(4) == 0, 3).otherwise(4)

    def key(first: int, n: int) -> tuple[Column, Column]:
        ids = [_id(first + k) for k in range(n)] + [F.lit(0).cast("long")] * (4 - n)
        return F.shiftleft(ids[0], 32).bitwiseOR(ids[1]), F.shiftleft(ids[2], 32).bitwiseOR(ids[3])

    def wanted(n: int) -> Column:
        parts = [(k, 1) for k in range(1, n + 1)] + _LOOKUPS[n]
        return F.array(*[F.struct(F.lit(10 * first + m).alias("role"), key(first, m)[0].alias("phi"), key(first, m)[1].alias("plo")) for first, m in parts])

    asked = candidates.select("hi", "lo", "a", F.explode(F.when(size == 2, wanted(2)).when(size == 3, wanted(3)).otherwise(wanted(4))).alias("p")).select("hi", "lo", "a", "p.*")
    known = words.select(F.shiftleft("gid", 32).alias("phi"), F.lit(0).cast("long").alias("plo"), "f", "word", "lang")
    known = known.unionByName(candidates.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("a").alias("f"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("lang")))
    found = asked.join(known, ["phi", "plo"])
    f = lambda first, n: F.max(F.when(F.col("role") == 10 * first + n, F.col("f"))).alias(f"f{first}{n}")
    w = lambda k: F.max(F.when(F.col("role") == 10 * k + 1, F.col("word"))).alias(f"w{k}")
    pieces = [(k, 1) for k in range(1, 5)] + _LOOKUPS[4]
    each = found.groupBy("hi", "lo", "a").agg(F.max("lang").alias("lang"), *[f(*p) for p in pieces], *[w(k) for k in range(1, 5)])
    longer = asked.filter("role % 10 > 1").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.max("a").alias("within"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    each = each.join(longer, ["hi", "lo"], "left").filter(F.col("within").isNull() | (wide("within") * 100 < wide("a") * inside))

    def cut(k: int, n: int) -> Column:
        left, right = f"f1{k}", f"f{k + 1}{n - k}"
        whole = F.expr(f"(CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST({left} AS DECIMAL(20,0)) + CAST({right} AS DECIMAL(20,0)))")
        return F.struct(whole.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    cuts = {n: F.array_min(F.array(*[cut(k, n) for k in range(1, n)])) for n in (2, 3, 4)}
    best = F.when(F.col("w3").isNull(), cuts[2]).when(F.col("w4").isNull(), cuts[3]).otherwise(cuts[4])
    return each.select("lang", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Per language its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    held = blocks(docs, text_col, lang_col)
    totals = held.filter("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    words = dictionary(held, least)
    texts = encoded(held, words)
    pairs = count_keys(texts, "pair", None, least)
    longer = count_keys(texts, "longer", spark.sparkContext.broadcast(pair_bitmap(pairs)), least)
    found = scored(pairs.unionByName(longer), words)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's rows are thinned in 64 shares first, so that no task ranks more than 64 times the rows asked for
    share = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("share")
    some = found.select("*", share).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
    WITH cut AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
    phrases AS (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM places) WHERE i + k - 1 <= len(w)),
    counts AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, p, count(*) AS f FROM phrases GROUP BY lang, k, p HAVING count(*) >= 30),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    inner_parts AS (
        SELECT lang, array_to_string(p[s:s + m - 1], ' ') AS phrase, max(f) AS within
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest([2, 3]) AS m FROM counts WHERE k > 2) WHERE m < k)
        GROUP BY 1, 2),
    kept AS (SELECT c.* FROM counts c LEFT JOIN inner_parts i USING (lang, phrase) WHERE c.k > 1 AND (i.within IS NULL OR 100 * i.within < 80 * c.f)),
    cuts AS (SELECT *, unnest(range(1, k)) AS c FROM kept),
    looked AS (
        SELECT cuts.lang, cuts.phrase, cuts.f AS a, cuts.c, x.f AS l, y.f AS r, (2000000::HUGEINT * cuts.f) // (x.f + y.f) AS score
        FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.p[1:cuts.c], ' ')
                  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.p[cuts.c + 1:], ' ')),
    best AS (SELECT * FROM looked QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
    SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000"""
