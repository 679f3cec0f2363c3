"""Ordered item sequences: context groups and activity sessions, and the patterns in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens import model
from routinelens.model import DAY, NO_READING
from routinelens.operators.signals import number
from routinelens.storage import materialise

#: Fixed value: the longest pattern.
MAX_LENGTH = 4
CAUSES = ("human", "device", "automation", "script")
#: Pairs that are looked at together and that make a task, chains that are made at once, and counts that are kept as a plain array.
BLOCK, TASK, CHAINS, DENSE = 1 << 16, 1 << 18, 1 << 20, 1 << 23


def usable(annotated: DataFrame) -> DataFrame:
    rows = annotated.filter(model.is_transition() & ~F.lower("state").isin(*NO_READING) & F.col("cause").isin(*CAUSES) & number(F.col("state")).isNull())
    return rows.select("sid", "us", "context", "cause", "chain_depth", F.concat_ws("=", "entity_id", F.lower("state")).alias("item"))


def sessions(rows: DataFrame, gap_us: int) -> DataFrame:
    """``rows`` with session_id, the first sid of its activity session; a gap of more than ``gap_us`` ends a session.

    The islands are global, so they are found day by day: each day is a window of its own, and the last time before it
    comes from a table of one row a day. A session that crosses midnight is joined by a running count over days.
    The rows are written first, as they are read for the days, their ends and their sessions.
    """
    rows = materialise(rows, "usable")
    d = rows.withColumn("d", model.day(F.col("us")))
    ends = d.groupBy("d").agg(F.max("us").alias("last"))
    carry = ends.select("d", F.lag("last").over(W.orderBy("d")).alias("before"))  # one row a day
    by = W.partitionBy("d").orderBy("us", "sid")
    prev = F.coalesce(F.lag("us").over(by), F.col("before"))
    marked = d.join(carry, "d").withColumn("starts", prev.isNull() | (F.col("us") - prev > gap_us))
    first = F.last(F.when(F.col("starts"), F.col("sid")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    local = marked.withColumn("local", first)
    tails = local.groupBy("d").agg(F.max_by("local", F.struct("us", "sid")).alias("tail"), F.max_by("sid", F.when(F.col("starts"), F.struct("us", "sid"))).alias("start"))
    open_ = tails.select("d", F.last("start", ignorenulls=True).over(W.orderBy("d").rowsBetween(W.unboundedPreceding, -1)).alias("open"))  # one row a day
    return local.join(open_, "d").select(*[F.col(c) for c in rows.columns], F.coalesce("local", "open").alias("session_id"))


def session_summary(rows: DataFrame) -> DataFrame:
    """Per session: rows, human rows, start and end."""
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cause") == "human").alias("human"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def _ordered(rows: DataFrame, key: str) -> DataFrame:
    """Items of each group in order of their first time, each once; groups of two or more."""
    firsts = rows.groupBy(key, "item").agg(F.min(F.struct("us", "sid")).alias("at"))
    return firsts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("s")).select(F.col(key).alias("seq_id"), F.col("s.item").alias("items")).filter(F.size("items") > 1)


def session_sequences(with_sessions: DataFrame) -> DataFrame:
    """Sequences of the sessions of two or more rows, one of them human; the rows are read once."""
    firsts = with_sessions.groupBy("session_id", "item").agg(F.min(F.struct("us", "sid")).alias("at"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("cause") == "human").alias("human"))
    held = firsts.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("s"), F.sum("n").alias("n"), F.sum("human").alias("human"))
    return held.filter("n > 1 and human > 0").select(F.col("session_id").alias("seq_id"), F.col("s.item").alias("items")).filter(F.size("items") > 1)


def context_sequences(rows: DataFrame) -> DataFrame:
    """Sequences of the contexts of two or more rows that are automated or have a parent."""
    held = rows.filter(F.col("context").isNotNull() & (F.col("cause").isin("automation", "script") | (F.col("chain_depth") > 0)))
    many = held.groupBy("context").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("context")
    return _ordered(held.join(many, "context", "left_semi"), "context")


class _Counts:
    """Counts of keys below a size: a plain array if that is small, else partial counts that are given out at once."""

    def __init__(self, length: int, items: int):
        self.length, self.items = length, items
        self.held = np.zeros(items**length, np.int64) if items**length <= DENSE else None

    def add(self, prefix: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count chains by the key of all their items but the last, and the last."""
        if self.held is not None:
            self.held += np.bincount(prefix * self.items + last, minlength=len(self.held))
        elif len(last):
            heads, place = np.unique(prefix, return_inverse=True)  # with four items a key of all would pass 64 bits
            keys, n = np.unique(place * self.items + last, return_counts=True)
            yield from self._rows(heads[keys // self.items], keys % self.items, n)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            keys = np.flatnonzero(self.held)
            yield from self._rows(keys // self.items, keys % self.items, self.held[keys])

    def _rows(self, prefix: np.ndarray, last: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = [last]
        for _ in range(self.length - 1):
            codes.insert(0, prefix % self.items)
            prefix = prefix // self.items
        for at in range(0, len(n), BLOCK):
            some = [pa.array(c[at : at + BLOCK], pa.int64()) for c in codes]
            some += [pa.nulls(len(some[0]), pa.int64())] * (MAX_LENGTH - self.length)
            yield pa.RecordBatch.from_arrays([*some, pa.array(n[at : at + BLOCK], pa.int64())], ["i1", "i2", "i3", "i4", "n"])


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose sizes add up to CHAINS at most, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHAINS, side="right")))
        yield slice(at, to)
        at = to


def _chains(seq: np.ndarray, p1: np.ndarray, i1: np.ndarray, p2: np.ndarray, i2: np.ndarray, items: int, three: _Counts, four: _Counts) -> Iterator[pa.RecordBatch]:
    """Count the triples and quadruples, of whole sequences, that all pairs in them are given for; pairs are sorted by sequence and places."""
    where = np.cumsum(np.append(0, seq[1:] != seq[:-1]))
    wide = np.zeros(where[-1] + 1, np.int64)
    np.maximum.at(wide, where, p2 + 1)
    base = np.append(0, np.cumsum(wide))
    a, b = base[where] + p1, base[where] + p2
    first = np.searchsorted(a, np.arange(base[-1] + 1))  # where the pairs that start at each place begin
    degree = np.diff(first)
    square = np.append(0, np.cumsum(wide**2))
    if square[-1] <= 8 * DENSE:
        given, row = np.zeros(square[-1], bool), square[:-1][where]
        at_a, at_b = row + p1 * wide[where], row + p2 * wide[where]
        given[at_a + p2] = True
        linked = lambda start, k: given[start + p2[k]]
    else:
        at_a, at_b, keys = a * base[-1], b * base[-1], a * base[-1] + b
        linked = lambda start, k: keys[np.minimum(np.searchsorted(keys, start + b[k]), len(keys) - 1)] == start + b[k]

    def grown(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which chain, and which pair goes on from its end."""
        many = degree[ends]
        chain = np.repeat(np.arange(len(ends)), many)
        return chain, np.arange(len(chain)) - np.repeat(np.cumsum(many) - many, many) + first[ends][chain]

    for some in _parts(degree[b]):
        e, f = grown(b[some])
        e = e + some.start
        keep = linked(at_a[e], f)
        e, f = e[keep], f[keep]
        pair = i1[e] * items + i2[e]
        yield from three.add(pair, i2[f])
        triple = pair * items + i2[f]
        for part in _parts(degree[b[f]]):
            t, g = grown(b[f[part]])
            t = t + part.start
            keep = linked(at_a[e[t]], g)
            t, g = t[keep], g[keep]
            keep = linked(at_b[e[t]], g)
            yield from four.add(triple[t[keep]], i2[g[keep]])


def _counted(items: int):
    """A function over rows (seq_id, p1, i1, p2, i2), sorted, that counts longer chains of them in blocks of whole sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        three, four, held, rows = _Counts(3, items), _Counts(4, items), [], 0

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = pa.concat_tables(held)
            seq = table["seq_id"].combine_chunks().dictionary_encode().indices.to_numpy()
            cut = len(seq) if last else int(np.searchsorted(seq, seq[-1]))  # the last sequence may go on
            if cut:
                yield from _chains(seq[:cut], *[table[c].to_numpy()[:cut].astype(np.int64) for c in ("p1", "i1", "p2", "i2")], items, three, four)
            held = [table.slice(cut)]
            rows = len(seq) - cut

        due = BLOCK
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
                if rows >= due:
                    yield from block(False)
                    due = max(BLOCK, 2 * rows)  # a sequence of more pairs than a block is not looked at batch by batch
        if rows:
            yield from block(True)
        yield from three.rest()
        yield from four.rest()

    return run


def patterns(sequences: DataFrame, min_support: int) -> DataFrame:
    """Ordered patterns of two to four items, their text (joined by >) and in how many sequences they are found.

    As items are distinct in a sequence, a pattern is found at most once in each. Pairs are counted first; longer ones grow
    only where all their pairs are frequent. They are counted, as numbers of items, where their sequences are: what is shuffled are
    pairs in sequences and counts of a task, not every place of a pattern.
    """
    places = materialise(sequences.select("seq_id", F.posexplode("items").alias("pos", "item")), "places")
    names = materialise(places.select("item").distinct().select("item", (F.row_number().over(W.orderBy("item")) - 1).cast("long").alias("code")), "items")  # one row an item
    coded = materialise(places.join(names, "item").groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("s")).select("seq_id", F.col("s.code").alias("codes")), "coded")
    one = coded.select("seq_id", "codes", F.posexplode("codes").alias("p1", "i1"))
    two = one.select("seq_id", "p1", "i1", F.posexplode(F.slice("codes", F.col("p1") + 2, F.size("codes"))).alias("k", "i2")).select("seq_id", "p1", "i1", (F.col("p1") + F.col("k") + 1).alias("p2"), "i2")
    often = materialise(two.groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support), "frequent-pairs")
    spark = sequences.sparkSession
    tasks = max(1, min(-(-(often.agg(F.sum("support")).first()[0] or 0) // TASK), 2 * spark.sparkContext.defaultParallelism))
    kept = two.join(often.select("i1", "i2"), ["i1", "i2"], "left_semi").select("seq_id", "p1", "i1", "p2", "i2").repartition(tasks, "seq_id").sortWithinPartitions("seq_id", "p1", "p2")
    longer = kept.mapInArrow(_counted(max(1, names.count())), "i1 long, i2 long, i3 long, i4 long, n long").groupBy("i1", "i2", "i3", "i4").agg(F.sum("n").alias("support")).filter(F.col("support") >= min_support)
    none = F.lit(None).cast("long")
    out = often.select("i1", "i2", none.alias("i3"), none.alias("i4"), "support").unionByName(longer)
    for c in ("i1", "i2", "i3", "i4"):
        out = out.join(names.select(F.col("code").alias(c), F.col("item").alias(f"{c}_name")), c, "left")
    out = out.withColumn("items", F.filter(F.array("i1_name", "i2_name", "i3_name", "i4_name"), lambda x: x.isNotNull()))
    return out.select(F.array_join("items", ">").alias("pattern"), F.size("items").alias("length"), "support", "items")


def all_sequences(rows: DataFrame, gap_us: int) -> DataFrame:
    """Context sequences and session sequences, each with every item once, where it first came."""
    told = lambda found, kind: found.select(F.concat_ws(":", F.lit(kind), F.col("seq_id").cast("string")).alias("seq_id"), "items")
    return told(context_sequences(rows), "context").unionByName(told(session_sequences(sessions(rows, gap_us)), "session"))


def _within(short: str, long: str):
    """Whether the items of ``short`` stand in ``long`` in their order; items of a pattern are distinct."""
    place = F.transform(short, lambda x: F.array_position(F.col(long), x))
    return F.forall(place, lambda p: p > 0) & (F.array_sort(place) == place)


def prune(found: DataFrame, slack: float = 1.1) -> DataFrame:
    """Without patterns that a kept longer one contains with at least its support by the slack; the longest are kept first."""
    kept = found.filter(F.col("length") == MAX_LENGTH)
    for length in range(MAX_LENGTH - 1, 1, -1):
        here = found.filter(F.col("length") == length)
        # a longer pattern holds the first item of a shorter one, so the join is on items
        longer = kept.select(F.col("items").alias("long"), F.col("support").alias("long_support"), F.explode("items").alias("first"))
        hidden = here.withColumn("first", F.col("items")[0]).join(longer, "first").filter((F.col("support") <= F.col("long_support") * slack) & _within("items", "long"))
        kept = materialise(kept.unionByName(here.join(hidden.select("items").distinct(), "items", "left_anti").select(*kept.columns)), "kept-patterns")
    return kept


def candidates(kept: DataFrame, sequences: DataFrame, human_items: DataFrame, actionable: list[str], services: DataFrame) -> DataFrame:
    """Routines: the first item triggers, the actionable later steps with two or more human rows and a service are the actions.

    At least two actions; confidence is support among the sequences that hold the trigger. human_items (item, n), services (item, service).
    """
    holds = sequences.select(F.explode("items").alias("trigger")).groupBy("trigger").agg(F.count(F.lit(1)).alias("opportunities"))
    steps = kept.select("pattern", "support", F.col("items")[0].alias("trigger"), F.posexplode("items").alias("pos", "item")).filter("pos > 0")
    usable_steps = steps.filter(F.split_part("item", F.lit("."), F.lit(1)).isin(*actionable)).join(human_items.filter("n >= 2").select("item"), "item").join(services, "item")
    rules = usable_steps.groupBy("pattern", "support", "trigger").agg(F.sort_array(F.collect_list(F.struct("pos", "item", "service"))).alias("actions")).filter(F.size("actions") >= 2)
    rated = rules.join(holds, "trigger").withColumn("confidence", F.col("support") / F.col("opportunities"))
    return rated.select("pattern", "trigger", F.array_join("actions.item", ">").alias("actions"), F.col("actions.item").alias("steps"), "support", "opportunities", "confidence", (F.col("confidence") * F.least(F.col("support") / 10.0, F.lit(1.0))).alias("score"))
