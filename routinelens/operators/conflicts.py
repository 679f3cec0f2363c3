"""Conflicts between rules: (rule_id, enabled, trigger_entity, trigger_minute, target_entity, target_state) rows, a row per trigger and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routinelens.functions import circular
from routinelens.storage import materialise

NEAR_MINUTES = 45
#: A rule and three others may make a loop.
MAX_HOPS = 4


def _overlap(a: str, b: str):
    """Triggers that can fire together: a shared entity, or clock times within 45 minutes."""
    shared = F.col(f"{a}.trigger_entity") == F.col(f"{b}.trigger_entity")
    near = circular.distance(F.col(f"{a}.trigger_minute"), F.col(f"{b}.trigger_minute")) <= NEAR_MINUTES
    return F.coalesce(shared, F.lit(False)) | F.coalesce(near, F.lit(False))


def inconsistent(rules: DataFrame) -> DataFrame:
    """Pairs that set one entity to different states on triggers that may overlap; disabled rules are left out.

    Two rules that pull one entity opposite ways are told even without evidence that they fire together: only clock times apart rule it out,
    and these only if both rules have one.
    """
    clocks = rules.groupBy("rule_id").agg(F.max(F.col("trigger_minute").isNotNull()).alias("clock"))
    live = rules.filter("enabled").join(clocks, "rule_id")
    pairs = live.alias("a").join(live.alias("b"), F.col("a.target_entity") == F.col("b.target_entity")).filter("a.rule_id < b.rule_id and a.target_state <> b.target_state")
    return pairs.filter(_overlap("a", "b") | ~(F.col("a.clock") & F.col("b.clock"))).select(F.col("a.rule_id").alias("rule_a"), F.col("b.rule_id").alias("rule_b"), F.col("a.target_entity").alias("entity_id"), F.lit("inconsistent").alias("kind")).distinct()


def redundant(rules: DataFrame) -> DataFrame:
    """Pairs that set one entity to the same state on overlapping triggers; disabled rules count too."""
    pairs = rules.alias("a").join(rules.alias("b"), (F.col("a.target_entity") == F.col("b.target_entity")) & (F.col("a.target_state") == F.col("b.target_state"))).filter("a.rule_id < b.rule_id")
    return pairs.filter(_overlap("a", "b")).select(F.col("a.rule_id").alias("rule_a"), F.col("b.rule_id").alias("rule_b"), F.col("a.target_entity").alias("entity_id"), F.lit("redundant").alias("kind")).distinct()


def self_conflicts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_id", "target_entity").agg(F.countDistinct("target_state").alias("states")).filter("states > 1").select("rule_id", F.col("target_entity").alias("entity_id"))


def loops(rules: DataFrame) -> DataFrame:
    """Rules that their own targets can trigger again through enabled rules, ``MAX_HOPS`` in all at most, with the shortest way, of equal ones the first.

    A frontier of one way for each start and place reached, each place once: rows grow with pairs of rules, not with ways.
    """
    edge = rules.filter("enabled").select("rule_id", "trigger_entity", "target_entity").distinct()
    step = edge.alias("x").join(edge.alias("y"), F.col("x.target_entity") == F.col("y.trigger_entity")).select(F.col("x.rule_id").alias("a"), F.col("y.rule_id").alias("b")).distinct()
    step = materialise(step, "rule-steps")
    path = step.select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("a", "b").alias("path"))
    closed, seen = path.filter("start = at"), path.select("start", "at")
    for _ in range(MAX_HOPS - 1):
        open_ = path.filter("start <> at")
        more = open_.join(step, open_["at"] == step["a"]).select("start", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
        path = materialise(more.groupBy("start", "at").agg(F.min("path").alias("path")).join(seen, ["start", "at"], "left_anti"), "rule-ways")
        closed, seen = closed.unionByName(path.filter("start = at")), seen.unionByName(path.select("start", "at"))
    ways = closed.groupBy("start").agg(F.min(F.struct(F.size("path").alias("n"), "path"))["path"].alias("path"))
    return ways.select(F.col("start").alias("rule_id"), F.array_join("path", ">").alias("way"))


def device_races(rules: DataFrame, devices: DataFrame) -> DataFrame:
    """Enabled rules with overlapping triggers that act on different entities (entity_id, device_id) of one device."""
    held = rules.filter("enabled").join(devices.select(F.col("entity_id").alias("target_entity"), "device_id"), "target_entity")
    pairs = held.alias("a").join(held.alias("b"), F.col("a.device_id") == F.col("b.device_id")).filter("a.rule_id < b.rule_id and a.target_entity <> b.target_entity")
    return pairs.filter(_overlap("a", "b")).select(F.col("a.rule_id").alias("rule_a"), F.col("b.rule_id").alias("rule_b"), F.col("a.device_id").alias("device_id")).distinct()


#: How severe each kind of conflict is.
SEVERITY = {"loop": 3, "inconsistent": 3, "self": 3, "race": 2, "redundant": 2, "unresolved": 2}


def expand(targets: DataFrame, entities: DataFrame) -> DataFrame:
    """Targets (rule_id, entity_id, area_id, device_id, state) as entities (rule_id, target_entity, target_state, resolved).

    An area or a device stands for all its entities (entity_id, area_id, device_id); one that has none is not resolved.
    """
    own = targets.filter("entity_id is not null").select("rule_id", F.col("entity_id").alias("target_entity"), F.col("state").alias("target_state"), F.lit(True).alias("resolved"))
    held = lambda key: targets.filter(F.col("entity_id").isNull() & F.col(key).isNotNull()).select("rule_id", key, "state").join(entities.select(key, F.col("entity_id").alias("target_entity")), key, "left").select("rule_id", "target_entity", F.col("state").alias("target_state"), F.col("target_entity").isNotNull().alias("resolved"))
    return own.unionByName(held("area_id")).unionByName(held("device_id")).distinct()


def unresolved(expanded: DataFrame) -> DataFrame:
    """Rules with a target that cannot be enumerated."""
    return expanded.filter("not resolved").select("rule_id").distinct()


def siblings(entities: DataFrame) -> DataFrame:
    """Pairs (entity_id, sibling) of one device."""
    a, b = entities.select("device_id", "entity_id"), entities.select("device_id", F.col("entity_id").alias("sibling"))
    return a.join(b, "device_id").filter("entity_id <> sibling").select("entity_id", "sibling")


def _without(pairs: DataFrame, proven: DataFrame | None) -> DataFrame:
    """Pairs of rules but for those that provably never hold together (rule_a < rule_b)."""
    return pairs if proven is None else pairs.join(proven, ["rule_a", "rule_b"], "left_anti")


def check(rules: DataFrame, devices: DataFrame, proven: DataFrame | None = None, expanded: DataFrame | None = None) -> DataFrame:
    """All checks as rows (kind, rule_a, rule_b, detail, severity), each once, the most severe first.

    With targets from expand(), enabled rules that have one which cannot be enumerated are unresolved: they may touch what any other rule does.
    """
    rows = [
        _without(inconsistent(rules), proven).select("kind", "rule_a", "rule_b", F.col("entity_id").alias("detail")),
        _without(redundant(rules), proven).select("kind", "rule_a", "rule_b", F.col("entity_id").alias("detail")),
        _without(device_races(rules, devices), proven).select(F.lit("race").alias("kind"), "rule_a", "rule_b", F.col("device_id").alias("detail")),
        self_conflicts(rules).select(F.lit("self").alias("kind"), F.col("rule_id").alias("rule_a"), F.col("rule_id").alias("rule_b"), F.col("entity_id").alias("detail")),
        loops(rules).select(F.lit("loop").alias("kind"), F.col("rule_id").alias("rule_a"), F.col("rule_id").alias("rule_b"), F.col("way").alias("detail")),
    ]
    if expanded is not None:
        off = rules.filter("not enabled").select("rule_id").distinct()
        rows.append(unresolved(expanded).join(off, "rule_id", "left_anti").select(F.lit("unresolved").alias("kind"), F.col("rule_id").alias("rule_a"), F.col("rule_id").alias("rule_b"), F.lit(None).cast("string").alias("detail")))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    level = F.element_at(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    return every.distinct().withColumn("severity", level).orderBy(F.desc("severity"), "kind", "rule_a", "rule_b", "detail")


def blocked(found: DataFrame) -> DataFrame:
    """Rules with a conflict of the highest severity."""
    worst = found.filter(F.col("severity") >= 3)
    return worst.select(F.explode(F.array("rule_a", "rule_b")).alias("rule_id")).distinct()


def audit(rules: DataFrame, signatures: DataFrame, proven: DataFrame | None = None) -> DataFrame:
    """Existing enabled rules against each other: (kind, rule_a, rule_b, entity_id, severity).

    Different states on overlapping triggers are an error, or a warning where the rules' conditions (rule_id, signature) differ; equal states
    are information. Two rules that act on each other's triggers are a loop, whether enabled or not.
    """
    live = rules.filter("enabled and target_state is not null")
    said = lambda k: signatures.select(F.col("rule_id").alias(f"rule_{k}"), F.col("signature").alias(f"sig_{k}"))
    pairs = live.alias("a").join(live.alias("b"), F.col("a.target_entity") == F.col("b.target_entity")).filter("a.rule_id < b.rule_id").filter(_overlap("a", "b"))
    pairs = pairs.select(F.col("a.rule_id").alias("rule_a"), F.col("b.rule_id").alias("rule_b"), F.col("a.target_entity").alias("entity_id"), (F.col("a.target_state") != F.col("b.target_state")).alias("other")).distinct()
    told = _without(pairs, proven).join(said("a"), "rule_a", "left").join(said("b"), "rule_b", "left")
    differ = ~F.col("sig_a").eqNullSafe(F.col("sig_b"))
    kind = F.when(F.col("other"), "inconsistent").otherwise("redundant")
    severity = F.when(~F.col("other"), "info").when(differ, "warning").otherwise("error")
    values = told.select(kind.alias("kind"), "rule_a", "rule_b", "entity_id", severity.alias("severity"))
    edge = rules.select("rule_id", "trigger_entity", "target_entity").distinct()
    x, y = edge.alias("x"), edge.alias("y")
    through = x.join(y, F.col("x.target_entity") == F.col("y.trigger_entity")).filter("x.rule_id <> y.rule_id").select(F.col("x.rule_id").alias("rule_a"), F.col("y.rule_id").alias("rule_b"), F.col("x.target_entity").alias("entity_id")).distinct()
    back = through.select(F.col("rule_b").alias("rule_a"), F.col("rule_a").alias("rule_b")).distinct()
    mutual = through.join(back, ["rule_a", "rule_b"], "left_semi").select(F.lit("loop").alias("kind"), "rule_a", "rule_b", "entity_id", F.lit("error").alias("severity"))
    return values.unionByName(mutual).distinct()
