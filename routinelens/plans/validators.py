"""Checks of what a language model proposes, as joins with what is known: nothing that is not known gets through.

Proposals are rows; the model itself is a plug-in outside this package.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.functions import circular

#: What a triage verdict does to a score, the longest mode label, the shortest precondition, the most gap proposals.
PENALTY = {"unlikely": 0.5, "coincidence": 0.25}
LABEL_LENGTH, PRECONDITION_LENGTH, MOST_GAPS = 40, 20, 5


def unknown_references(references: DataFrame, known: DataFrame) -> DataFrame:
    """References (rule_id, kind, name) to entities, areas, devices or services that are not known (kind, name)."""
    return references.join(known.select("kind", "name").distinct(), ["kind", "name"], "left_anti")


def static_targets(actions: DataFrame) -> DataFrame:
    """Actions (rule_id, target, service) whose target or service is a template or all there is, which cannot be checked."""
    loose = lambda c: F.coalesce(F.col(c).contains("{{") | F.col(c).contains("{%") | (F.lower(F.trim(c)) == "all") | (F.trim(c) == ""), F.lit(True))
    return actions.filter(loose("target") | loose("service"))


def semantic_form(rule: dict) -> tuple:
    """What a rule does, whatever the spelling: lists in order where order tells, sets sorted, keys renamed, defaults left out."""
    names = {"platform": "trigger", "service": "action", "triggers": "trigger", "conditions": "condition", "actions": "action"}

    def canonical(value):
        if isinstance(value, dict):
            return tuple(sorted((names.get(k, k), canonical(v)) for k, v in value.items() if k not in ("id", "alias", "description") and v not in (None, "", [], {})))
        if isinstance(value, (list, tuple)):
            return tuple(canonical(v) for v in value) if len(value) != 1 else canonical(value[0])
        return re.sub(r"^(\d\d:\d\d)$", r"\1:00", value) if isinstance(value, str) else float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value

    part = lambda k: canonical(rule.get(k) or rule.get(f"{k}s") or [])
    return part("trigger"), part("condition"), part("action"), rule.get("mode", "single")


def differences(a: dict, b: dict) -> list[str]:
    """The parts in which two rules differ in meaning."""
    return [name for name, x, y in zip(("trigger", "condition", "action", "mode"), semantic_form(a), semantic_form(b)) if x != y]


def triaged(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``candidates`` (id, score, ...) with scores lowered by verdicts (id, verdict); other verdicts change nothing."""
    lower = F.coalesce(F.element_at(F.create_map(*[x for k, v in PENALTY.items() for x in (F.lit(k), F.lit(v))]), F.col("verdict")), F.lit(1.0))
    one = verdicts.groupBy("id").agg(F.min("verdict").alias("verdict"))
    return candidates.join(one, "id", "left").withColumn("score", F.col("score") * F.when(F.col("verdict").isNull(), 1.0).otherwise(lower)).drop("verdict")


def reviewed(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Audit findings (finding_id, severity) softened or hidden by verdicts (finding_id, verdict); an error is never hidden, only softened."""
    one = verdicts.groupBy("finding_id").agg(F.min("verdict").alias("verdict"))
    told = findings.join(one, "finding_id", "left")
    softer = F.when((F.col("verdict").isin("intended", "harmless")) & (F.col("severity") == "error"), "warning").when((F.col("verdict") == "harmless") & (F.col("severity") == "warning"), "info").otherwise(F.col("severity"))
    hidden = (F.col("verdict") == "intended") & (F.col("severity") == "info")
    return told.withColumn("hidden", F.coalesce(hidden, F.lit(False))).withColumn("severity", softer).drop("verdict")


def merged_roles(roles: DataFrame, proposed: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Roles and proposed ones (role, entity_id) of known entities and roles (role); nothing is taken away."""
    more = proposed.select("role", "entity_id").join(entities.select("entity_id"), "entity_id", "left_semi").join(allowed.select("role"), "role", "left_semi")
    return roles.select("role", "entity_id").unionByName(more.select("role", "entity_id")).distinct()


def inventory(entities: DataFrame) -> DataFrame:
    """One row: a digest of the ids and names, by which an earlier classification is known to be of the same home.

    Digests of the rows are summed, so the rows need no order and no task holds them all.
    """
    row = F.xxhash64(F.concat_ws("|", "entity_id", F.coalesce("name", F.lit("")))).cast("decimal(38,0)")
    return entities.agg(F.count(F.lit(1)).alias("entities"), F.sum(row).cast("string").alias("digest"))


def inferred_areas(entities: DataFrame, areas: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed areas (entity_id, area_name) of entities without one, where exactly one area (area_id, name) has the name, whatever its case."""
    one = areas.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("area_id").alias("area_id")).filter("n = 1")
    bare = entities.filter("area_id is null").select("entity_id")
    said = proposed.withColumn("key", F.lower(F.trim("area_name"))).join(bare, "entity_id", "left_semi").join(one, "key")
    return said.groupBy("entity_id").agg(F.min("area_id").alias("area_id"), F.countDistinct("area_id").alias("n")).filter("n = 1").select("entity_id", "area_id")


def learned_preferences(drafts: DataFrame, dismissals: DataFrame, least: int = 2) -> DataFrame:
    """Drafts (pref_id, text, cited: array of ids) that cite at least two different known dismissals (id)."""
    cited = drafts.select("pref_id", F.explode(F.array_distinct("cited")).alias("id")).join(dismissals.select("id").distinct(), "id", "left_semi")
    enough = cited.groupBy("pref_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return drafts.join(enough.select("pref_id"), "pref_id", "left_semi")


def suppressions(proposed: DataFrame, preferences: DataFrame) -> DataFrame:
    """Proposed links (id, pref_id) that name an active preference (pref_id, active)."""
    return proposed.join(preferences.filter("active").select("pref_id"), "pref_id", "left_semi").distinct()


def gap_proposals(proposed: DataFrame, known: DataFrame, entities: DataFrame) -> DataFrame:
    """Proposals (n, title, benefit, precondition, cited: array of ids) that are complete, say what they need, are new and cite known entities only."""
    whole = proposed.filter((F.length(F.trim("title")) > 0) & (F.length(F.trim("benefit")) > 0) & (F.length(F.trim("precondition")) >= PRECONDITION_LENGTH))
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    fresh = whole.withColumn("key", key("title")).join(known.select(key("title").alias("key")).distinct(), "key", "left_anti")
    invented = fresh.select("n", F.explode("cited").alias("entity_id")).join(entities.select("entity_id"), "entity_id", "left_anti").select("n").distinct()
    once = fresh.join(invented, "n", "left_anti").groupBy("key").agg(F.min("n").alias("n")).select("n")
    return proposed.join(once, "n", "left_semi").orderBy("n").limit(MOST_GAPS)


def mode_labels(proposed: DataFrame, states: DataFrame) -> DataFrame:
    """Labels (mode, label) of known modes (mode), not empty and not too long; of several of a mode the first by text."""
    good = proposed.withColumn("label", F.trim("label")).filter((F.length("label") > 0) & (F.length("label") <= LABEL_LENGTH)).join(states.select("mode").distinct(), "mode", "left_semi")
    return good.groupBy("mode").agg(F.min("label").alias("label"))


def hypotheses(proposed: DataFrame, signals: DataFrame, most: int = 3) -> DataFrame:
    """Proposed conditions (rule_id, n, kind, entity_id, state, above, below) on known signals (entity_id, numeric), at most ``most`` a rule.

    A numeric test needs a numeric signal and a bound, a state test a state; the rest goes.
    """
    told = proposed.join(signals.select("entity_id", "numeric"), "entity_id")
    fits = ((F.col("kind") == "numeric") & F.col("numeric") & (F.col("above").isNotNull() | F.col("below").isNotNull())) | ((F.col("kind") == "state") & ~F.col("numeric") & F.col("state").isNotNull())
    ranked = told.filter(fits).groupBy("rule_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "kind", "entity_id", "state", "above", "below"))), 1, most).alias("c"))  # a model proposes a handful a rule
    return ranked.select("rule_id", F.explode("c").alias("c")).select("rule_id", "c.*")


def _clock(minute: Column) -> Column:
    seconds = F.bround(minute * 60).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def scenes(rules: DataFrame, within_minutes: float = 20) -> DataFrame:
    """Rules (rule_id, kind, trigger, minute, target_entity, target_state) that can be one scene: (scene, rules, entities).

    At least two rules of one state trigger, or of clock times that all lie within the minutes of each other, around midnight too, so that one anchor stands
    for all; they must not set one entity to two states. Other kinds of trigger have no stand-in and make no scene. A clock rule may be in
    several scenes, each a largest group.
    """
    groups = circular.tight_groups(rules.filter("kind = 'time'"), within_minutes)
    clock = rules.filter("kind = 'time'").withColumn("minute", F.col("minute").cast("double")).join(groups, "minute").withColumn("scene", F.concat(F.lit("time:"), _clock(F.col("anchor"))))
    state = rules.filter("kind = 'state'").withColumn("scene", F.concat_ws(":", "kind", "trigger"))
    keyed = clock.select("scene", "rule_id", "target_entity", "target_state").unionByName(state.select("scene", "rule_id", "target_entity", "target_state"))
    torn = keyed.groupBy("scene", "target_entity").agg(F.countDistinct("target_state").alias("states")).filter("states > 1").select("scene").distinct()
    made = keyed.join(torn, "scene", "left_anti").groupBy("scene").agg(F.countDistinct("rule_id").alias("rules"), F.countDistinct("target_entity").alias("entities"))
    return made.filter("rules > 1 and entities > 1")
