"""Health of applied rules from what they did, stale automations, and gaps in what a home can sense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.model import ACTIONABLE, DAY

#: The bars of the verdicts.
MIN_DAYS, MIN_FIRES, MIN_PREDICTED = 7, 5, 3
OVERRIDDEN, NOISY, SHORTFALL = 0.6, 0.3, 0.3
STALE_DAYS = 30


def facts(applied: DataFrame, automations: DataFrame, predicted: DataFrame, triggered: DataFrame, overrides: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """What is known of each applied rule since it was applied, or since the window's start.

    applied (rule_id, applied_us, shipped), automations (rule_id, entity_id, enabled, config), predicted fires (rule_id, us, error),
    triggered (entity_id, us) and overrides (automation, us). Counts are taken in the window, both ends included. A null
    config could not be read, so it is not held against what was shipped.
    """
    held = applied.join(automations, "rule_id", "left").withColumn("from_us", F.greatest(F.col("applied_us"), F.lit(start_us)))
    to = F.greatest(F.lit(end_us), F.col("from_us"))
    since = held.select("rule_id", "entity_id", "from_us", to.alias("to_us"))
    inside = lambda rows, keys: rows.join(since, keys).filter(F.col("us").between(F.col("from_us"), F.col("to_us"))).groupBy("rule_id")
    fires = inside(predicted, "rule_id").agg(F.count("us").alias("predicted"))
    broken = predicted.groupBy("rule_id").agg(F.max(F.coalesce("error", F.lit(False))).alias("broken"))
    real = inside(triggered, "entity_id").agg(F.count("us").alias("actual"))
    undone = inside(overrides.withColumnRenamed("automation", "entity_id"), "entity_id").agg(F.count("us").alias("overridden"))
    every = held.join(fires, "rule_id", "left").join(broken, "rule_id", "left").join(real, "rule_id", "left").join(undone, "rule_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.select(
        "rule_id",
        F.col("enabled").isNotNull().alias("present"),
        F.coalesce(F.col("config") != F.col("shipped"), F.lit(False)).alias("edited"),
        F.col("entity_id").isNotNull().alias("live"),
        F.coalesce("enabled", F.lit(False)).alias("enabled"),
        ((to - F.col("from_us")) / DAY).alias("days"),
        F.coalesce("broken", F.lit(False)).alias("error"),
        *[number(c) for c in ("predicted", "actual", "overridden")],
    )


def verdict(known: DataFrame, min_days: float = MIN_DAYS, min_fires: int = MIN_FIRES, min_predicted: int = MIN_PREDICTED) -> DataFrame:
    """From rows of facts() the first status that applies, and the share of fires that were undone."""
    share = F.try_divide("overridden", "actual")
    status = (
        F.when(~F.col("present"), "deleted")
        .when(F.col("edited"), "edited")
        .when(~F.col("live"), "insufficient_data")
        .when(~F.col("enabled"), "disabled")
        .when((F.col("days") < min_days) | F.col("error"), "insufficient_data")
        .when((F.col("actual") == 0) & (F.col("predicted") < min_predicted), "insufficient_data")
        .when(F.col("actual") == 0, "dormant")
        .when(F.col("actual") < min_fires, "insufficient_data")
        .when(share >= OVERRIDDEN, "overridden")
        .when(share >= NOISY, "noisy")
        .when((F.col("predicted") > 0) & (F.col("actual") < SHORTFALL * F.col("predicted")), "underperforming")
        .otherwise("healthy")
    )
    return known.select("rule_id", status.alias("status"), share.alias("override_share"))


def stale(automations: DataFrame, now_us: int | Column, age_days: float = STALE_DAYS) -> DataFrame:
    """Automations (id, state, last_triggered_us) that are off, never ran, or ran too long ago, with a score that only age raises."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    age = (now - F.col("last_triggered_us")) / DAY
    why = F.when(F.lower("state") == "off", "off").when(F.col("last_triggered_us").isNull(), "never").when(age > age_days, "old")
    score = F.least(0.4 + F.when(F.col("reason") == "old", age).otherwise(0.0) / 365, F.lit(0.9))
    return automations.withColumn("reason", why).filter("reason is not null").select("id", "reason", score.alias("score"))


def gap_rules() -> list[tuple[str, str, float, Column]]:
    """The rules (gap, kind, score, when it applies), over one row of role presence, counts and retention."""
    has = lambda role: F.coalesce(F.array_contains("roles", role), F.lit(False))
    hands = F.col("hand_actions") >= 20
    loads, price = has("deferrable_loads") | has("ev_charger"), has("energy_price") | has("price_level")
    return [
        ("history too short", "infrastructure", 0.9, F.coalesce(F.col("file_store") & (F.col("history_days") < 14), F.lit(False))),
        ("nobody's presence is tracked", "integration", 0.85, ~has("person") & ~has("device_tracker")),
        ("presence sensor where motion alone is seen", "hardware", 0.8, hands & ~has("room_presence") & has("motion") & ~has("occupancy")),
        ("no motion or presence sensor at all", "hardware", 0.75, hands & ~has("room_presence") & ~has("motion") & ~has("occupancy")),
        ("loads that could move, no price", "integration", 0.7, loads & ~price),
        ("heating without the outdoor temperature", "integration", 0.7, has("thermostat") & ~has("outdoor_temperature") & ~has("weather")),
        ("price and loads, nothing moves them", "integration", 0.65, loads & price & ~F.col("shifts_loads")),
        ("solar production without a forecast", "integration", 0.6, has("solar_production") & ~has("solar_forecast")),
        ("weekday rules without a workday calendar", "integration", 0.55, (F.col("weekday_rules") > 0) & ~has("workday")),
        ("price and loads, carbon intensity unknown", "integration", 0.4, loads & price & ~has("carbon_intensity")),
    ]


def gaps(known: DataFrame) -> DataFrame:
    """Gaps by score, from one row (roles array, hand_actions, weekday_rules, shifts_loads, file_store, history_days)."""
    found = F.array(*[F.when(when, F.struct(F.lit(g).alias("gap"), F.lit(kind).alias("kind"), F.lit(score).alias("score"))) for g, kind, score, when in gap_rules()])
    return known.select(F.explode(F.array_compact(found)).alias("g")).select("g.*").orderBy(F.desc("score"), "gap")


def gap_facts(roles: DataFrame, by_domain: DataFrame, weekday_rules: int = 0, shifts_loads: bool = False, history_days: float | None = None, file_store: bool = True) -> DataFrame:
    """The one row that gaps() reads, from roles (role, entity_id) and human actions by domain (domain, n)."""
    present = roles.agg(F.array_sort(F.collect_set("role")).alias("roles"))  # roles are a fixed list
    hands = by_domain.agg(F.coalesce(F.sum(F.when(F.col("domain").isin("light", "switch"), F.col("n"))), F.lit(0)).alias("hand_actions"))
    return present.join(hands).select("*", F.lit(weekday_rules).alias("weekday_rules"), F.lit(shifts_loads).alias("shifts_loads"), F.lit(file_store).alias("file_store"), F.lit(history_days).cast("double").alias("history_days"))


def unused(changes: DataFrame, entities: DataFrame, window: str | None = None) -> DataFrame:
    """Entities (entity_id, domain, hidden, disabled, category) that can be acted on and that nobody touched, with their passive changes.

    Scenes, scripts, hidden, disabled and configuration or diagnostic entities do not count. With a ``window``, a column of the changes
    such as the day, each of its values that has any change is judged by itself; the values are few, as days are.
    """
    own = F.col("domain").isin(*[d for d in ACTIONABLE if d not in ("scene", "script")]) & ~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("disabled", F.lit(False)) & F.col("category").isNull()
    held = entities.filter(own).select("entity_id").distinct()
    keys = ["entity_id"] + ([window] if window else [])
    if window:
        held = held.join(F.broadcast(changes.select(window).distinct()))
    counts = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cause") == "human").alias("touched"))
    found = held.join(counts, keys, "left").filter("coalesce(touched, 0) = 0")
    return found.select(*keys, F.coalesce("n", F.lit(0)).alias("passive"))
