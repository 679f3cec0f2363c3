"""Conditions as facts, and pairs of facts that cannot both hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.functions import circular

#: Weekdays, Monday first.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
LAST_MINUTE = 1439


def _texts(json: Column, path: str) -> Column:
    """The text at a path, or the texts of a list there, as an array."""
    raw = F.get_json_object(json, path)
    one = F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.array(raw))
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(one)


def facts(rows: DataFrame) -> DataFrame:
    """From rows (rule_id, condition: JSON text) facts (rule_id, kind, entity_id, states, above, below, after, before, weekdays, sun).

    kind is state, numeric, time, sun, or unknown for what cannot be told: no or several entities, no states or bounds, other kinds.
    """
    c = F.col("condition")
    text = lambda k: F.get_json_object(c, f"$.{k}")
    what = F.lower(F.trim(F.coalesce(text("condition"), text("kind"), F.lit(""))))
    ids = _texts(c, "$.entity_id")
    entity = F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))
    states = F.array_sort(F.array_distinct(F.transform(_texts(c, "$.state"), lambda s: F.lower(F.trim(s)))))
    above, below = text("above").try_cast("double"), text("below").try_cast("double")
    days = F.array_sort(F.array_intersect(F.transform(_texts(c, "$.weekday"), lambda d: F.lower(F.left(F.trim(d), F.lit(3)))), F.array(*map(F.lit, WEEKDAYS))))
    up = ((text("after") == "sunrise") & text("before").isNull()) | ((text("before") == "sunset") & text("after").isNull())
    down = ((text("after") == "sunset") & text("before").isNull()) | ((text("before") == "sunrise") & text("after").isNull())
    sun = F.when(up, "above_horizon").when(down, "below_horizon")
    kind = (
        F.when((what == "state") & entity.isNotNull() & (F.size(states) > 0), "state")
        .when((what == "numeric_state") & entity.isNotNull() & (above.isNotNull() | below.isNotNull()), "numeric")
        .when(what == "time", "time")
        .when((what == "sun") & sun.isNotNull(), "sun")
        .otherwise("unknown")
    )
    told = rows.select("rule_id", c.alias("condition"), kind.alias("kind"))
    only = lambda k, v: F.when(F.col("kind") == k, v)
    return told.select(
        "rule_id", "kind", F.when(F.col("kind").isin("state", "numeric"), entity).alias("entity_id"), only("state", states).alias("states"), only("numeric", above).alias("above"), only("numeric", below).alias("below"),
        only("time", circular.parse(text("after"))).alias("after"), only("time", circular.parse(text("before"))).alias("before"), only("time", days).alias("weekdays"), only("sun", sun).alias("sun"),
    )


def _spans(after: str, before: str) -> Column:
    """The minutes of a time window as one or, around midnight, two closed spans."""
    a, b = F.coalesce(F.col(after), F.lit(0)), F.coalesce(F.col(before), F.lit(LAST_MINUTE))
    span = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    return F.when(a <= b, F.array(span(a, b))).otherwise(F.array(span(a, F.lit(LAST_MINUTE)), span(F.lit(0), b)))


def contradiction(x: str = "a", y: str = "b") -> Column:
    """Whether the facts of two aliases cannot both hold; what cannot be told does not contradict. Touching windows overlap."""
    col = lambda side, name: F.col(f"{side}.{name}")
    same = (col(x, "kind") == col(y, "kind")) & col(x, "entity_id").eqNullSafe(col(y, "entity_id"))
    kind = col(x, "kind")
    days = (F.size(col(x, "weekdays")) > 0) & (F.size(col(y, "weekdays")) > 0) & ~F.arrays_overlap(col(x, "weekdays"), col(y, "weekdays"))
    meet = F.exists(_spans(f"{x}.after", f"{x}.before"), lambda s: F.exists(_spans(f"{y}.after", f"{y}.before"), lambda t: (s["a"] <= t["b"]) & (t["a"] <= s["b"])))
    hit = (
        F.when(kind == "state", ~F.arrays_overlap(col(x, "states"), col(y, "states")))
        .when(kind == "numeric", F.coalesce(col(x, "below") <= col(y, "above"), F.lit(False)) | F.coalesce(col(y, "below") <= col(x, "above"), F.lit(False)))
        .when(kind == "time", days | ~meet)
        .when(kind == "sun", col(x, "sun") != col(y, "sun"))
    )
    return same & F.coalesce(hit, F.lit(False))


def exclusive(told: DataFrame) -> DataFrame:
    """Pairs of rules that provably never hold together: one contradicting pair of facts is enough. A pair not given is not proven."""
    a, b = told.alias("a"), told.alias("b")
    near = (F.col("a.kind") == F.col("b.kind")) & F.col("a.entity_id").eqNullSafe(F.col("b.entity_id")) & (F.col("a.rule_id") < F.col("b.rule_id"))
    return a.join(b, near).filter(contradiction()).select(F.col("a.rule_id").alias("rule_a"), F.col("b.rule_id").alias("rule_b")).distinct()


def signature(told: DataFrame) -> DataFrame:
    """Per rule its conditions as one text (rule_id, signature), by which conditions are told to differ."""
    part = lambda name: F.coalesce(F.concat(F.lit(f"{name}="), F.col(name).cast("string")), F.lit(""))
    some = lambda name: F.coalesce(F.concat(F.lit(f"{name}="), F.array_join(name, "|")), F.lit(""))
    text = F.concat_ws(" ", "kind", F.coalesce("entity_id", F.lit("")), some("states"), part("above"), part("below"), part("after"), part("before"), some("weekdays"), part("sun"))
    return told.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("signature"))
