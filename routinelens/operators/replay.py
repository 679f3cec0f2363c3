"""Replay of rules over history: fires, conditions, bursts, matching, gates and holdout verdicts.

Rules are rows (rule_id, kind, at_minute, entity_id, to_state, above, below, target_entity, target_state). They are few; the
joins to history are equi-joins on the entity and left to the planner to broadcast by size.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.model import DAY, HOUR, MINUTE, RISKY, SECOND, SECURITY
from routinelens.operators.signals import value_at
from routinelens.storage import materialise

BURST = 60 * SECOND
EVENT_TOLERANCE = 300 * SECOND
#: Windows of a collapse that make a chunk of time.
CHUNK = 256
FOUND = pa.schema([("rule_id", pa.string()), ("us", pa.int64()), ("sid", pa.int64())])


def time_fires(rules: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Each day at the rule's minute, both ends of the window included."""
    days = F.sequence(F.lit(start_us // DAY), F.lit(end_us // DAY))
    made = rules.filter("kind = 'time' and at_minute is not null").select("rule_id", F.explode(F.transform(days, lambda d: d.cast("long") * DAY + F.col("at_minute").cast("long") * MINUTE)).alias("us"), F.lit("time").alias("kind"))
    return made.filter(F.col("us").between(start_us, end_us))


def _history(points: DataFrame) -> W:
    return W.partitionBy("entity_id").orderBy("us", "sid")


def state_fires(rules: DataFrame, points: DataFrame) -> DataFrame:
    """Entering the state, the first sample counts; any change if there is no state."""
    rows = points.withColumn("now", F.lower("str")).withColumn("prev", F.lag(F.lower("str")).over(_history(points)))
    hit = F.when(F.col("to_state").isNull(), F.col("prev").isNotNull() & (F.col("prev") != F.col("now"))).otherwise((F.col("now") == F.lower("to_state")) & ~F.col("prev").eqNullSafe(F.col("now")))
    return rows.select("entity_id", "us", "now", "prev").join(rules.filter("kind = 'state'").select("rule_id", "entity_id", "to_state"), "entity_id").filter(hit).select("rule_id", "us", F.lit("state").alias("kind"))


def numeric_fires(rules: DataFrame, points: DataFrame) -> DataFrame:
    """Entering the open band; the first sample never fires; a text arms it again."""
    rows = points.select("entity_id", "us", "num", F.lag("num").over(_history(points)).alias("prev"), F.lag("us").over(_history(points)).isNotNull().alias("later"))
    inside = lambda c: F.coalesce((F.col("above").isNull() | (F.col(c) > F.col("above"))) & (F.col("below").isNull() | (F.col(c) < F.col("below"))) & F.col(c).isNotNull(), F.lit(False))
    joined = rows.join(rules.filter("kind = 'numeric'").select("rule_id", "entity_id", "above", "below"), "entity_id")
    return joined.filter(F.col("later") & inside("num") & ~inside("prev")).select("rule_id", "us", F.lit("numeric").alias("kind"))


def all_fires(rules: DataFrame, points: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """All kinds, one fire per rule and time; of equal times the tighter kind (not a clock) stays."""
    every = time_fires(rules, start_us, end_us).unionByName(state_fires(rules, points)).unionByName(numeric_fires(rules, points))
    inside = every.filter(F.col("us").between(start_us, end_us))
    return inside.groupBy("rule_id", "us").agg(F.max(F.struct((F.col("kind") != "time").alias("tight"), "kind"))["kind"].alias("kind"))


def time_condition(after: int | None, before: int | None, weekdays: list[int] | None):
    """A column over us: minute granular, both bounds inclusive, around midnight if after > before."""
    minute = F.floor(F.pmod("us", F.lit(DAY)) / MINUTE)
    ok = F.lit(True)
    if weekdays:
        ok = ok & F.pmod(F.floor(F.col("us") / DAY) + 3, F.lit(7)).isin(*weekdays)
    if after is not None and before is not None and after > before:
        return ok & ((minute >= after) | (minute <= before))
    if after is not None:
        ok = ok & (minute >= after)
    return ok & (minute <= before) if before is not None else ok


def _last_kept(us: np.ndarray, window_us: int) -> np.ndarray:
    """For each of the sorted times the last one kept if it is kept itself."""
    after = np.searchsorted(us, us + window_us, side="right")
    last = us.copy()
    for i in range(len(us) - 1, -1, -1):
        if after[i] < len(us):
            last[i] = last[after[i]]
    return last


def collapse(fires: DataFrame, window_us: int = BURST) -> DataFrame:
    """Keep a fire if it is more than the window after the last kept one; of a burst the first kind that is not a clock's is told.

    Chunks of time are folded on their own, whatever their density: each tells, for the times of its first window, which fire it keeps last if it
    begins there; a scan over these steps, a few a chunk, tells what each chunk comes after, and a second pass keeps. ``fires`` is read twice.
    """
    wide = CHUNK * window_us
    dealt = fires.select("rule_id", "us", "kind", F.floor(F.col("us") / wide).alias("chunk"))
    at = pa.int64()

    def steps(key, rows):
        us = np.unique(rows["us"].to_numpy())
        some = us[: np.searchsorted(us, key[1].as_py() * wide + window_us) + 1]  # the first kept one is among these
        last = _last_kept(us, window_us)[: len(some)]
        ends = np.append(np.flatnonzero(last[1:] != last[:-1]), len(some) - 1)
        return pa.table({"rule_id": pa.array([key[0].as_py()] * len(ends), pa.string()), "chunk": pa.array([key[1].as_py()] * len(ends), at), "upto": pa.array(some[ends], at), "last": pa.array(last[ends], at)})

    def scan(key, rows):
        chunks: dict[int, list] = {}
        for chunk, upto, last in sorted(zip(rows["chunk"].to_pylist(), rows["upto"].to_pylist(), rows["last"].to_pylist())):
            chunks.setdefault(chunk, []).append((upto, last))
        before, last = [], None
        for ends in chunks.values():
            before.append(last)
            last = next((kept for upto, kept in ends if last is None or upto > last + window_us), last)
        return pa.table({"rule_id": pa.array([key[0].as_py()] * len(before), pa.string()), "chunk": pa.array(list(chunks), at), "before": pa.array(before, at)})

    def keep(key, rows):
        rows = rows.sort_by("us")
        us, before = rows["us"].to_numpy(), rows["before"][0].as_py()
        after = np.searchsorted(us, us + window_us, side="right")
        of, i = np.empty(len(us), np.int64), 0 if before is None else int(np.searchsorted(us, before + window_us, side="right"))
        of[:i] = before or 0
        while i < len(us):
            of[i : after[i]] = us[i]
            i = after[i]
        return pa.table({"rule_id": rows["rule_id"].cast(pa.string()), "at": pa.array(of, at), "us": rows["us"].cast(at), "kind": rows["kind"].cast(pa.string())})

    told = dealt.groupBy("rule_id", "chunk").applyInArrow(steps, "rule_id string, chunk long, upto long, last long")
    before = told.groupBy("rule_id").applyInArrow(scan, "rule_id string, chunk long, before long")
    bursts = dealt.join(before, ["rule_id", "chunk"]).groupBy("rule_id", "chunk").applyInArrow(keep, "rule_id string, at long, us long, kind string")
    first = lambda some: F.min(F.when(some, F.struct("us", "kind")))["kind"]
    return bursts.groupBy("rule_id", F.col("at").alias("us")).agg(F.coalesce(first(F.col("kind") != "time"), first(F.lit(True))).alias("kind"))


def ground_truth(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """Human transitions that reach the rule's target."""
    goal = rules.select("rule_id", F.col("target_entity").alias("entity_id"), F.lower("target_state").alias("state"))
    return actions.select("entity_id", "state", "us", "sid").join(goal, ["entity_id", "state"]).select("rule_id", "us", "sid")


def _reaches(f: np.ndarray, tol: np.ndarray, own: np.ndarray, t: np.ndarray, reach: int) -> np.ndarray:
    """How far from each fire the truth it takes can be, from sorted times of fires and truth.

    Earlier fires that reach the same truth can take no more than one each, so a fire with m - 1 of them takes one of its m nearest. What is found
    makes the reaches shorter, and so the number of earlier fires that count.
    """
    far = tol.copy()
    n = np.arange(len(f)) - np.searchsorted(f, f - 2 * reach)
    for _ in range(4):
        at = np.searchsorted(t, f)
        left, right = at - n - 1, at + n
        d = np.full(len(f), np.iinfo(np.int64).max)
        some = left >= 0
        d[some] = f[some] - t[left[some]]
        some = right < len(t)
        d[some] = np.minimum(d[some], t[right[some]] - f[some])
        far = np.where(own, np.minimum(far, d), tol)
        most = int(n.max())
        if most == 0 or most > 256:
            break
        n = np.zeros(len(f), np.int64)
        for k in range(1, min(most, len(f) - 1) + 1):
            n[k:] += f[:-k] + far[:-k] >= f[k:] - far[k:]
    return far


def _take(f: list[int], tol: list[int], t: list[int]) -> list[int | None]:
    """For each fire in order the place of the nearest truth that is free, the earlier of equally near ones. All are sorted by time."""
    up, down = list(range(len(t) + 1)), list(range(len(t) + 1))  # the next free place from one on, and up to one (from 1, 0 is none)

    def free(way, i):
        root = i
        while way[root] != root:
            root = way[root]
        while way[i] != root:
            way[i], i = root, way[i]
        return root

    out: list[int | None] = []
    for us, far in zip(f, tol):
        at = bisect_left(t, us)
        late, early = free(up, at), free(down, at) - 1
        best = None
        if late < len(t) and t[late] - us <= far:
            best = late
        if early >= 0 and us - t[early] <= far and (best is None or us - t[early] <= t[late] - us):
            best = early
        if best is not None:
            up[best], down[best + 1] = best + 1, best
        out.append(best)
    return out


def match(fires: DataFrame, truth: DataFrame, clock_us: int, event_us: int = EVENT_TOLERANCE) -> DataFrame:
    """Each fire with whether it is matched, and each truth that is not: rows (rule_id, us, what).

    Fires in time order take the nearest unmatched truth within their tolerance, the earlier of equally near ones. Chunks of time tell which truth
    any fire can take; only that, a few for each fire, is folded, in islands of the common timeline: events further apart than the larger
    tolerance do not interact. Truth that nothing can take is missed without a fold.
    """
    reach = max(clock_us, event_us)
    wide = 16 * reach
    slot = lambda by: F.floor((F.col("us") + by) / wide)
    tolerance = F.when(F.col("kind") == "time", clock_us).otherwise(event_us).cast("long").alias("tol")
    fired = fires.select("rule_id", "us", tolerance)
    none = F.lit(None).cast("long")
    # fires that a chunk inherits only count as earlier ones
    dealt = fired.select("rule_id", "us", "tol", none.alias("sid"), F.explode(F.array_distinct(F.array(slot(0), slot(2 * reach)))).alias("chunk")).unionByName(
        truth.select("rule_id", "us", none.alias("tol"), F.col("sid").cast("long").alias("sid"), F.explode(F.array_distinct(F.array(slot(-reach), slot(reach)))).alias("chunk"))
    )

    def near(key, rows):
        rows = rows.sort_by([("us", "ascending"), ("tol", "ascending"), ("sid", "ascending")])
        is_fire = rows["tol"].is_valid().to_numpy()
        us = rows["us"].to_numpy()
        f, t = us[is_fire], us[~is_fire]
        tol = rows["tol"].filter(pa.array(is_fire)).to_numpy()
        own = f >= key[1].as_py() * wide
        kept = np.zeros(len(t) + 1, np.int64)
        if own.any() and len(t):
            far = _reaches(f, tol, own, t, reach)[own]
            np.add.at(kept, np.searchsorted(t, f[own] - far), 1)
            np.add.at(kept, np.searchsorted(t, f[own] + far, side="right"), -1)
        return rows.select(["rule_id", "us", "sid"]).filter(pa.array(~is_fire)).filter(pa.array(np.cumsum(kept)[:-1] > 0)).cast(FOUND)

    some = dealt.groupBy("rule_id", "chunk").applyInArrow(near, "rule_id string, us long, sid long").distinct()
    both = fired.withColumn("sid", none).unionByName(some.withColumn("tol", none))
    by = W.partitionBy("rule_id").orderBy("us", "tol", "sid")
    marked = both.withColumn("new", F.when(F.col("us") - F.lag("us").over(by) <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))

    def fold(rows):
        rows = rows.sort_by([("us", "ascending"), ("tol", "ascending"), ("sid", "ascending")])
        is_fire = rows["tol"].is_valid()
        f, t = rows.filter(is_fire), rows.filter(pa.compute.invert(is_fire))
        places = pa.array(_take(f["us"].to_pylist(), f["tol"].to_pylist(), t["us"].to_pylist()), pa.int64())
        return pa.table({"rule_id": f["rule_id"].cast(pa.string()), "us": f["us"].cast(pa.int64()), "at": t["us"].cast(pa.int64()).take(places), "sid": t["sid"].cast(pa.int64()).take(places)})

    told = materialise(marked.groupBy("rule_id", "island").applyInArrow(fold, "rule_id string, us long, at long, sid long"), "matched-fires")
    taken = told.filter("at is not null").select("rule_id", F.col("at").alias("us"), "sid")
    missed = truth.select("rule_id", "us", F.col("sid").cast("long").alias("sid")).join(taken, ["rule_id", "us", "sid"], "left_anti")
    return told.select("rule_id", "us", F.when(F.col("at").isNull(), "false").otherwise("true").alias("what")).unionByName(missed.select("rule_id", "us", F.lit("missed").alias("what")))


def counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("rule_id").agg(*[F.count_if(F.col("what") == k).alias(n) for k, n in (("true", "true_fires"), ("false", "false_fires"), ("missed", "missed"))])


def suppressed(fires: DataFrame, kept: DataFrame) -> DataFrame:
    """Per rule the fires that a collapse took out (rule_id, bursts)."""
    return fires.groupBy("rule_id").agg(F.count(F.lit(1)).alias("all")).join(kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("kept")), "rule_id", "left").select("rule_id", (F.col("all") - F.coalesce("kept", F.lit(0))).alias("bursts"))


def nuisances(matched: DataFrame, targets: DataFrame, overrides: DataFrame, window_us: int) -> DataFrame:
    """Per rule its false fires that an override of a target follows within the window (rule_id, nuisance).

    matched (rule_id, us, what), targets (rule_id, target_entity), overrides (entity_id, us). A range join by time buckets as wide as the window.
    """
    bucket = lambda c: F.floor(c / window_us)
    false = matched.filter("what = 'false'").select("rule_id", "us").distinct().join(targets.select("rule_id", F.col("target_entity").alias("entity_id")).distinct(), "rule_id")
    near = false.withColumn("bucket", F.explode(F.array(bucket(F.col("us")), bucket(F.col("us")) + 1)))
    late = overrides.select("entity_id", F.col("us").alias("at"), bucket(F.col("us")).alias("bucket"))
    hit = near.join(late, ["entity_id", "bucket"]).filter((F.col("at") >= F.col("us")) & (F.col("at") - F.col("us") <= window_us))
    return hit.select("rule_id", "us").distinct().groupBy("rule_id").agg(F.count(F.lit(1)).alias("nuisance"))


@dataclass(frozen=True)
class Bars:
    """What a rule has to reach, and more of it where it moves something that matters."""

    min_true: int = 4
    precision: float = 0.7
    recall: float = 0.25
    false_week: float = 3.0
    nuisance: int = 0
    bursts: float = 3.0
    risky_true: int = 12
    risky_precision: float = 0.95
    risky_false_week: float = 0.0
    allow_security: bool = False
    holdout: float = 0.25
    min_train_days: float = 14.0
    min_holdout_days: float = 7.0


def gates(counted: DataFrame, days: float | Column, bars: Bars = Bars(), scale: float | Column = 1.0) -> DataFrame:
    """precision, recall, false fires a week, the reasons for which a rule does not pass, and whether it passes.

    counted: rule_id, true_fires, false_fires, missed and, where they are known, bursts, nuisance, service and target domain. A part
    of the window has its floor of true fires scaled, never below two. A service that leaves the home less secured is refused first; a rule
    without fires and truth is not judged, and does not pass.
    """
    known = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in counted.columns else F.lit(other)
    t, f, m = F.col("true_fires"), F.col("false_fires"), F.col("missed")
    days = F.lit(float(days)) if isinstance(days, (int, float)) else days
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    risky = known("domain", "").isin(*RISKY)
    base = F.when(risky, max(bars.min_true, bars.risky_true)).otherwise(bars.min_true)
    floor = F.when(scale == 1.0, base).otherwise(F.greatest(F.lit(2), F.ceil(base * scale)))
    rated = counted.withColumn("precision", F.try_divide(t, t + f)).withColumn("recall", F.try_divide(t, t + m)).withColumn("false_week", f * 7.0 / F.greatest(days, F.lit(0.01)))
    why = F.array_compact(
        F.array(
            F.when(F.col("precision").isNull(), "never fired"),
            F.when(F.col("precision").isNotNull() & (t < floor), "few"),
            F.when(F.col("precision") < F.when(risky, max(bars.precision, bars.risky_precision)).otherwise(bars.precision), "precision"),
            F.when(F.col("precision").isNotNull() & (F.col("recall") < bars.recall), "recall"),
            F.when(F.col("false_week") > F.when(risky, min(bars.false_week, bars.risky_false_week)).otherwise(bars.false_week), "noisy"),
            F.when(known("bursts", 0) > bars.bursts * F.greatest(t + f, F.lit(1)), "bursts"),
            F.when(known("nuisance", 0) > bars.nuisance, "nuisance"),
        )
    )
    refused = known("service", "").isin(*SECURITY) & F.lit(not bars.allow_security)
    reasons = F.when(refused, "security").when(t + f + m == 0, "nothing to judge").otherwise(F.array_join(why, ","))
    return rated.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def split(start_us: int, end_us: int, bars: Bars = Bars(), offset_us: int = 0) -> int:
    """Where the holdout begins: the last share of the time, at the nearest local midnight unless a part would fall below its minimum."""
    end_us = max(start_us, end_us)
    raw = end_us - int((end_us - start_us) * bars.holdout)
    snapped = min(max((raw + offset_us + DAY // 2) // DAY * DAY - offset_us, start_us), end_us)
    enough = (snapped - start_us) / DAY >= bars.min_train_days and (end_us - snapped) / DAY >= bars.min_holdout_days
    return snapped if enough else raw


def segments(fires: DataFrame, truth: DataFrame, start_us: int, cut_us: int, end_us: int) -> tuple[DataFrame, DataFrame]:
    """Fires and truth once for each of full, train and holdout, told by the rule id's prefix, so that one pass judges all three.

    A fire at the cut itself counts in both parts; truth is split before and from it.
    """
    at = F.col("us")
    part = lambda late: F.array_compact(F.array(F.lit("full"), F.when(at < cut_us if not late else at <= cut_us, "train"), F.when(at >= cut_us, "holdout")))
    put = lambda rows, late: rows.filter(at.between(start_us, end_us)).withColumn("seg", F.explode(part(late))).withColumn("rule_id", F.concat_ws(":", "seg", "rule_id")).drop("seg")
    return put(fires, True), put(truth, False)


def backtest(rules: DataFrame, fires: DataFrame, truth: DataFrame, overrides: DataFrame, start_us: int, end_us: int, bars: Bars = Bars(), clock_us: int = 900 * SECOND, override_us: int = 120 * SECOND) -> DataFrame:
    """Per rule and segment (full, train, holdout) its counts and gates.

    rules (rule_id, target_entity, service); fires before any collapse; truth of ground_truth(); overrides (entity_id, us).
    """
    cut = split(start_us, end_us, bars)
    every, true = segments(fires, truth, start_us, cut, end_us)
    every = materialise(every.select("rule_id", "us", "kind"), "fires")
    kept = materialise(collapse(every), "kept-fires")
    matched = match(kept, true, clock_us)
    names = F.explode(F.array(*map(F.lit, ("full", "train", "holdout"))))
    keyed = rules.withColumn("seg", names).withColumn("rule_id", F.concat_ws(":", "seg", "rule_id"))
    facts = keyed.groupBy("rule_id", "seg").agg(F.min("service").alias("service"), F.min(F.split_part("target_entity", F.lit("."), F.lit(1))).alias("domain"))
    found = facts.join(counts(matched), "rule_id", "left").join(suppressed(every, kept), "rule_id", "left").join(nuisances(matched, keyed, overrides, 4 * override_us), "rule_id", "left")
    found = found.na.fill(0, ["true_fires", "false_fires", "missed", "bursts", "nuisance"])
    length = {"full": end_us - start_us, "train": cut - start_us, "holdout": end_us - cut}
    by = lambda f: F.when(F.col("seg") == "full", f("full")).when(F.col("seg") == "train", f("train")).otherwise(f("holdout"))
    rated = gates(found, by(lambda k: F.lit(length[k] / DAY)), bars, by(lambda k: F.lit(length[k] / length["full"] if length["full"] else 1.0)))
    return rated.withColumn("rule_id", F.split_part("rule_id", F.lit(":"), F.lit(2)))


def verdicts(judged: DataFrame, start_us: int, end_us: int, bars: Bars = Bars()) -> DataFrame:
    """Per rule, from rows of backtest(): validation (in_sample or holdout), its reason, and whether it passes: then full and holdout both do.

    Without enough days, or without fires and truth in the holdout, the whole window decides; fires against no truth there fail.
    """
    cut = split(start_us, end_us, bars)
    enough = (cut - start_us) / DAY >= bars.min_train_days and (end_us - cut) / DAY >= bars.min_holdout_days
    whole = judged.filter("seg = 'full'").select("rule_id", "true_fires", "precision", F.col("passed").alias("ok"), "reasons")
    late = judged.filter("seg = 'holdout'").select("rule_id", F.col("true_fires").alias("late_true"), F.col("passed").alias("late_ok"), (F.col("true_fires") + F.col("missed")).alias("acts"), (F.col("true_fires") + F.col("false_fires")).alias("fired"))
    why = (
        F.when(F.lit(not enough), "insufficient_history")
        .when((F.col("acts") == 0) & (F.col("fired") == 0), "no_activity_in_holdout")
        .when(F.col("acts") == 0, "behaviour_absent_in_holdout")
        .otherwise("evaluated")
    )
    rows = whole.join(late, "rule_id").withColumn("reason", why)
    passed = F.when(F.col("reason") == "behaviour_absent_in_holdout", False).when(F.col("reason") == "evaluated", F.col("ok") & F.col("late_ok")).otherwise(F.col("ok"))
    kind = F.when(F.col("reason").isin("evaluated", "behaviour_absent_in_holdout"), "holdout").otherwise("in_sample")
    return rows.select("rule_id", "true_fires", "late_true", kind.alias("validation"), "reason", passed.alias("passed"), "precision")


def settle(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """``candidates`` (rule_id, score, ...) with passed, and the score of those that pass drawn half way to the precision."""
    told = candidates.join(decided.select("rule_id", "passed", "precision"), "rule_id")
    return told.withColumn("score", F.when(F.col("passed") & F.col("precision").isNotNull(), (F.col("score") + F.col("precision")) / 2).otherwise(F.col("score"))).drop("precision")


def unsupported(rules: DataFrame) -> DataFrame:
    """Rules whose trigger kind cannot be replayed (rule_id, kind)."""
    return rules.filter(~F.col("kind").isin("time", "state", "numeric")).select("rule_id", "kind")


def conditions_hold(fires: DataFrame, conditions: DataFrame, points: DataFrame, staleness_us: int = 6 * HOUR) -> DataFrame:
    """Fires whose rule's conditions all hold at that time.

    conditions (rule_id, kind, entity_id, state, above, below, after_minute, before_minute, weekdays): time, state and numeric ones; other
    kinds never hold. States are read as-of, not older than the staleness, whatever their case; bounds of numbers are strict, those of times include.
    """
    every = fires.join(conditions.withColumnRenamed("kind", "what"), "rule_id")
    read = value_at(every.filter("what in ('state', 'numeric')"), points, staleness_us)
    number = F.coalesce((F.col("above").isNull() | (F.col("num") > F.col("above"))) & (F.col("below").isNull() | (F.col("num") < F.col("below"))), F.lit(False)) & F.col("num").isNotNull()
    seen = F.when(F.col("what") == "state", F.coalesce(F.lower("str") == F.lower("state"), F.lit(False))).otherwise(number)
    minute = F.floor(F.pmod("us", F.lit(DAY)) / MINUTE)
    after, before = F.coalesce("after_minute", F.lit(0)), F.coalesce("before_minute", F.lit(1439))
    clock = F.when(after > before, (minute >= after) | (minute <= before)).otherwise((minute >= after) & (minute <= before))
    today = F.pmod(F.floor(F.col("us") / DAY) + 3, F.lit(7)).cast("int")
    clock = clock & (F.col("weekdays").isNull() | F.array_contains("weekdays", today))
    names = ["rule_id", "us", "kind"]
    told = read.select(*names, seen.alias("ok")).unionByName(every.filter("what not in ('state', 'numeric')").select(*names, F.when(F.col("what") == "time", clock).otherwise(False).alias("ok")))
    failed = told.groupBy(*names).agg(F.bool_and("ok").alias("ok")).filter("not ok").select("rule_id", "us")
    return fires.join(failed, ["rule_id", "us"], "left_anti")
