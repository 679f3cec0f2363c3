"""From a history to ranked, checked and stored rules in one call, over the operators of this package.

Miners see the training part only. Each candidate is replayed over the whole window and over the part held out, checked against the rules
that a home already has, given the chance that it is accepted, and merged into the stored suggestions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.learn import ranking
from routinelens.model import ACTIONABLE, HOUR, SECOND, is_transition
from routinelens.operators import association, causality, conditional, conflicts, crossings, dimensions, habits, replay, sequences, signals, store
from routinelens.storage import materialise


@dataclass(frozen=True)
class Options:
    """Bars of the miners and of the replay."""

    bandwidth: int = 20
    min_occurrences: int = 6
    min_consistency: float = 0.6
    gap_us: int = 300 * SECOND
    around_us: int = 120 * SECOND
    min_support: int = 4
    lead_us: int = 900 * SECOND
    crossing_recall: float = 0.5
    crossing_strength: float = 0.4
    staleness_us: int = 3 * HOUR
    override_us: int = 120 * SECOND
    miners: tuple[str, ...] = ("time_of_day", "sequence", "conditional", "motif", "association")
    bars: replay.Bars = field(default_factory=replay.Bars)


class Result(NamedTuple):
    """candidates with their verdicts and probability; judged, a row for each segment; found conflicts with existing rules; and the stored suggestions."""

    candidates: DataFrame
    judged: DataFrame
    found: DataFrame
    stored: DataFrame


RULE = ("kind", "at_minute", "entity_id", "to_state", "above", "below", "target_entity", "target_state")
TABLE = "id string, miner string, score double, status string, seen_count long, last_run int"
CONDITION = "rule_id string, kind string, entity_id string, state string, above double, below double, after_minute int, before_minute int, weekdays array<int>"
EXISTING = "rule_id string, enabled boolean, trigger_entity string, trigger_minute int, target_entity string, target_state string"


def _rules(found: DataFrame, miner: str, **columns: Column) -> DataFrame:
    """Candidates of a miner as rules; what they do and when names them, so a later run meets them again."""
    kinds = {"at_minute": "int", "above": "double", "below": "double"}
    told = found.select(*[(columns[c] if c in columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RULE], columns["score"].cast("double").alias("score"), *[columns.get(c, F.lit(None)).cast("double").alias(c) for c in ("consistency", "confidence", "lift", "occurrences")], columns.get("only", F.lit(None)).cast(f"array<struct<{CONDITION.replace('rule_id string, ', '').replace(' ', ':').replace(',:', ',')}>>").alias("only"))
    name = F.sha2(F.to_json(F.struct(F.lit(miner), *RULE, "only")), 256)
    return told.select(F.left(name, F.lit(16)).alias("rule_id"), F.lit(miner).alias("miner"), *told.columns)


def _condition(kind: str, entity: Column | None = None, state: Column | None = None, above: Column | None = None, below: Column | None = None, weekdays: Column | None = None) -> Column:
    null = F.lit(None)
    said = (("kind", F.lit(kind), "string"), ("entity_id", entity, "string"), ("state", state, "string"), ("above", above, "double"), ("below", below, "double"), ("after_minute", None, "int"), ("before_minute", None, "int"), ("weekdays", weekdays, "array<int>"))
    return F.struct(*[(null if c is None else c).cast(t).alias(n) for n, c, t in said])


def _item(column: str, k: int) -> Column:
    return F.split_part(column, F.lit("="), F.lit(k))


def mined(rows: DataFrame, start_us: int, end_us: int, options: Options) -> DataFrame:
    """Rules of all miners from annotated rows: rule_id, miner, the columns of RULE, score, measures and the conditions (only)."""
    acts = materialise(habits.human_actions(rows), "actions")
    points = materialise(signals.build(rows), "points")
    services = dimensions.service_for(acts.select("entity_id", "domain", "state").distinct()).filter("service is not null").select(F.concat_ws("=", "entity_id", "state").alias("item"), "service")
    made = []
    if "time_of_day" in options.miners:
        days = dict(habits.FILTERS)
        only = F.when(F.col("filter") != "all", F.array(_condition("time", weekdays=F.when(F.col("filter") == "weekdays", F.array(*map(F.lit, days["weekdays"]))).otherwise(F.array(*map(F.lit, days["weekends"]))))))
        found = habits.time_of_day(acts, start_us, end_us, options.bandwidth, options.min_occurrences, options.min_consistency)
        made.append(_rules(found, "time_of_day", kind=F.lit("time"), at_minute=F.floor(F.col("minute") + 0.5) % 1440, target_entity=F.col("entity_id"), target_state=F.col("state"), score=F.col("score"), consistency=F.col("consistency"), occurrences=F.col("hits"), only=only))
    if "sequence" in options.miners:
        every = materialise(sequences.all_sequences(sequences.usable(rows), options.gap_us), "sequences")
        human = acts.groupBy(F.concat_ws("=", "entity_id", "state").alias("item")).agg(F.count(F.lit(1)).alias("n"))
        routines = sequences.candidates(sequences.prune(sequences.patterns(every, options.min_support)), every, human, list(ACTIONABLE), services)
        steps = routines.select("trigger", "support", "confidence", "score", F.explode("steps").alias("step")).groupBy("trigger", "step").agg(F.max(F.struct("score", "confidence", "support")).alias("b"))
        made.append(_rules(steps, "sequence", kind=F.lit("state"), entity_id=_item("trigger", 1), to_state=_item("trigger", 2), target_entity=_item("step", 1), target_state=_item("step", 2), score=F.col("b.score"), confidence=F.col("b.confidence"), occurrences=F.col("b.support")))
    if "association" in options.miners:
        items = rows.filter(is_transition()).select("sid", "us", F.concat_ws("=", "entity_id", F.lower("state")).alias("item"), "cause")
        pairs = association.rules(items, options.around_us)
        made.append(_rules(pairs, "association", kind=F.lit("state"), entity_id=_item("a", 1), to_state=_item("a", 2), target_entity=_item("c", 1), target_state=_item("c", 2), score=F.col("score"), confidence=F.col("confidence"), lift=F.col("lift"), occurrences=F.col("n")))
    if "conditional" in options.miners:
        moments = acts.select("entity_id", "state", "us")
        marked = moments.withColumn("positive", F.lit(True)).unionByName(conditional.background(moments, start_us, end_us, 60 * SECOND).withColumn("positive", F.lit(False)))
        kinds = signals.catalogue(points).select(F.col("entity_id").alias("signal"), "numeric", F.when(F.col("numeric"), 0).otherwise(1).alias("place"))
        outside = materialise(kinds.filter(~F.split_part("signal", F.lit("."), F.lit(1)).isin(*ACTIONABLE)), "signals")
        names = sorted(r["signal"] for r in outside.select("signal").collect())  # the sensors and people of a home
        if names:
            read = signals.values_at(marked, points, names, options.staleness_us)
            best = conditional.conditions(read, outside.select("signal", "numeric"), outside.select("signal", "place"))
            bound = lambda side: F.when(F.split_part("test", F.lit(" "), F.lit(1)) == side, F.split_part("test", F.lit(" "), F.lit(2)).try_cast("double"))
            value = F.when(F.col("test").startswith("is "), F.expr("substring(test, 4)"))
            each = best.select("entity_id", "state", "rank", "signal", "coverage", "lift", "strength", bound("above").alias("hi"), bound("below").alias("lo"), value.alias("value"))
            second = each.filter("rank = 2").select("entity_id", "state", F.array(F.when(F.col("value").isNotNull(), _condition("state", F.col("signal"), F.col("value"))).otherwise(_condition("numeric", F.col("signal"), None, F.col("hi"), F.col("lo")))).alias("only"))
            both = each.filter("rank = 1").join(second, ["entity_id", "state"], "left")
            made.append(_rules(both, "conditional", kind=F.when(F.col("value").isNotNull(), "state").otherwise("numeric"), entity_id=F.col("signal"), to_state=F.col("value"), above=F.col("hi"), below=F.col("lo"), target_entity=F.col("entity_id"), target_state=F.col("state"), score=F.least("strength", F.lit(1.0)), confidence=F.col("coverage"), lift=F.col("lift"), only=F.col("only")))
    if "motif" in options.miners:
        scored = crossings.matched(crossings.crossings(points, crossings.deciles(points)), acts.select(F.concat_ws("=", "entity_id", "state").alias("kind"), "us"), options.lead_us)
        best = crossings.best_crossing(scored.filter(F.col("entity_id") != _item("kind", 1)), options.crossing_recall, options.crossing_strength)
        falls = F.col("direction") == "falling"
        made.append(_rules(best, "motif", kind=F.lit("numeric"), entity_id=F.col("entity_id"), above=F.when(~falls, F.col("threshold")), below=F.when(falls, F.col("threshold")), target_entity=_item("kind", 1), target_state=_item("kind", 2), score=F.col("strength"), consistency=F.col("recall"), confidence=F.col("precision"), occurrences=F.col("hits")))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    able = services.select(_item("item", 1).alias("target_entity"), F.expr("substring(item, instr(item, '=') + 1)").alias("target_state"), "service")
    # a rule on its own target, or without a service, cannot be made
    return every.filter(~F.col("entity_id").eqNullSafe(F.col("target_entity"))).join(able, ["target_entity", "target_state"]).dropDuplicates(["rule_id"])


def run(changes: DataFrame, run_number: int = 1, table: DataFrame | None = None, existing: DataFrame | None = None, devices: DataFrame | None = None, labelled: DataFrame | None = None, options: Options = Options()) -> Result:
    """Mine, replay, check, rank and store. ``changes`` are state changes, or annotated ones if they have causes.

    existing: rules of the home as conflicts.check() takes them; devices (entity_id, device_id); labelled: earlier decisions for ranking.rank();
    table: the suggestions of earlier runs.
    """
    spark = changes.sparkSession
    rows = materialise(changes if "cause" in changes.columns else causality.annotate(changes), "annotated-run")
    start, end = rows.agg(F.min("us"), F.max("us")).first()
    empty = lambda schema: spark.createDataFrame([], schema)
    cut = replay.split(start, end, options.bars) if start is not None else 0
    rules = materialise(mined(rows.filter(F.col("us") < cut), start or 0, cut, options), "mined-rules")
    points = signals.build(rows)
    conditions = rules.filter("only is not null").select("rule_id", F.explode("only").alias("c")).select("rule_id", "c.*")
    fires = replay.conditions_hold(replay.all_fires(rules.select("rule_id", *RULE), points, start or 0, end or 0), conditions, points)
    truth = replay.ground_truth(rules, habits.human_actions(rows))
    undone = causality.overrides(rows, options.override_us).select("entity_id", "us")
    judged = materialise(replay.backtest(rules.select("rule_id", "target_entity", "service"), fires, truth, undone, start or 0, end or 0, options.bars), "judged-rules")
    decided = replay.verdicts(judged, start or 0, end or 0, options.bars)
    settled = materialise(replay.settle(rules, decided).join(decided.select("rule_id", "validation", "reason"), "rule_id", "left"), "settled-rules")
    # against what the home has, not against each other
    own = existing if existing is not None else empty(EXISTING)
    as_rule = settled.select("rule_id", F.lit(True).alias("enabled"), F.col("entity_id").alias("trigger_entity"), F.col("at_minute").alias("trigger_minute"), "target_entity", "target_state")
    both = as_rule.unionByName(own.select(*as_rule.columns))
    new = settled.select("rule_id").distinct()
    old = own.select("rule_id").distinct()
    pairs = conflicts.check(both, devices if devices is not None else empty("entity_id string, device_id string"))
    mixed = pairs.join(new.select(F.col("rule_id").alias("rule_a"), F.lit(True).alias("new_a")), "rule_a", "left").join(new.select(F.col("rule_id").alias("rule_b"), F.lit(True).alias("new_b")), "rule_b", "left")
    with_old = mixed.filter((F.col("kind") == "loop") & F.col("new_a")).join(old, F.contains(F.concat(F.lit(">"), "detail", F.lit(">")), F.concat(F.lit(">"), "rule_id", F.lit(">"))), "left_semi")
    told = mixed.filter(F.col("kind") != "loop").filter((F.col("new_a").isNotNull() != F.col("new_b").isNotNull()) | ((F.col("kind") == "self") & F.col("new_a"))).unionByName(with_old)
    found = materialise(told.select("kind", "rule_a", "rule_b", "detail", "severity"), "found-conflicts")
    bad = conflicts.blocked(found).join(new, "rule_id", "left_semi").withColumn("blocked", F.lit(True))
    full = judged.filter("seg = 'full'").select("rule_id", "true_fires", "false_fires", "missed", "precision", "recall", F.col("false_week").alias("false_fires_per_week"))
    known = settled.join(full, "rule_id", "left").join(bad, "rule_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))).withColumn("domains", F.array(F.split_part("target_entity", F.lit("."), F.lit(1))))
    none = known.withColumn("label", F.lit(1)).withColumn("decided_at", F.lit(0)).limit(0)
    ranked = materialise(ranking.rank(known, labelled if labelled is not None else none), "ranked-rules")
    good = ranked.filter("passed and not blocked").select(F.col("rule_id").alias("id"), "miner", "score")
    stored = materialise(store.prune(store.upsert(table if table is not None else empty(TABLE), good, run_number), run_number), "suggestions")
    return Result(ranked, judged, found, stored)
