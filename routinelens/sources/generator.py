"""A home's history with planted routines, for tests of the miners: seeded, and made by Spark from a range of days.

Each day and part of a routine draws from hashes of (seed, day, part), so that the rows do not depend on how the days are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.model import DAY, HOUR, MINUTE, SECOND

CHANGE = "array<struct<at:bigint,entity_id:string,state:string,cause:string,cause_entity:string>>"


def _chance(seed: int, part: str) -> Column:
    """Uniform in [0, 1), by day and part."""
    return F.pmod(F.xxhash64(F.lit(seed), "day", F.lit(part)), F.lit(1 << 40)) / float(1 << 40)


def _around(seed: int, part: str, minute: float, spread: float) -> Column:
    """Microseconds of the day, uniform around a minute."""
    return F.floor((minute + (2 * _chance(seed, part) - 1) * spread) * MINUTE)


def _change(at: Column, entity: str, state: Column | str, cause: str = "human", by: str | None = None) -> Column:
    state = F.lit(state) if isinstance(state, str) else state
    return F.struct(at.cast("long").alias("at"), F.lit(entity).alias("entity_id"), state.alias("state"), F.lit(cause).alias("cause"), F.lit(by).cast("string").alias("cause_entity"))


def planted_home(spark: SparkSession, days: int = 45, start_day: int = 19_800, seed: int = 7, messy: bool = False) -> DataFrame:
    """State changes (sid, us, entity_id, domain, state, old_state, num, cause, cause_entity, context, chain_depth), one part a line:

    a kitchen light at 06:30 on weekdays, off an hour later; an arrival at 17:45, the hall light after it and heating after that; a heater
    switched on at 19:00 a minute or two after a reading below eight degrees; an automation that dims the bedroom, undone by hand seven
    times of ten; an outdoor temperature each hour. A messy home has dropouts too: rows that read unavailable and come back.
    """
    rows = spark.range(start_day, start_day + days).withColumnRenamed("id", "day")
    yes = lambda part, p: _chance(seed, part) < p
    weekday = F.pmod(F.col("day") + 3, F.lit(7)) < 5
    wake, home, warm, dim = _around(seed, "wake", 390, 6), _around(seed, "home", 1065, 25), _around(seed, "warm", 1140, 40), _around(seed, "dim", 1335, 4)
    cold = yes("cold", 0.5)
    evening = F.when(cold, 3 + 4 * _chance(seed, "low")).otherwise(10 + 6 * _chance(seed, "high"))
    when = lambda ok, *made: F.when(ok, F.array(*made)).otherwise(F.array().cast(CHANGE))
    degrees = lambda v: F.format_string("%.1f", v)
    parts = [
        when(weekday & yes("kitchen", 0.9), _change(wake, "light.kitchen", "on"), _change(wake + HOUR, "light.kitchen", "off")),
        when(yes("arrive", 0.85), _change(home, "person.alex", "home", "device"), _change(home + 40 * SECOND, "light.hallway", "on"), _change(home + 95 * SECOND, "climate.living_room", "heat"), _change(home + 4 * HOUR, "light.hallway", "off"), _change(home + 4 * HOUR + MINUTE, "climate.living_room", "off"), _change(home + 14 * HOUR, "person.alex", "not_home", "device")),
        when(F.lit(True), _change(warm - 120 * SECOND, "sensor.outdoor_temperature", degrees(evening), "device")),
        when(cold, _change(warm, "switch.heater", "on"), _change(warm + 90 * MINUTE, "switch.heater", "off")),
        when(F.lit(True), _change(dim, "light.bedroom", "off", "automation", "automation.bedtime_dim")),
        when(yes("undo", 0.7), _change(dim + F.floor((15 + 75 * _chance(seed, "late")) * SECOND), "light.bedroom", "on")),
        when(yes("bed", 0.9), _change(dim - 3 * HOUR, "light.bedroom", "on")),
        F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.struct((h.cast("long") * HOUR).alias("at"), F.lit("sensor.outdoor_temperature").alias("entity_id"), degrees(14 + 3 * F.sin((h - 9) * 0.2618)).alias("state"), F.lit("device").alias("cause"), F.lit(None).cast("string").alias("cause_entity"))),
    ]
    if messy:
        parts.append(when(yes("drop", 0.4), _change(_around(seed, "gone", 700, 300), "light.kitchen", "unavailable", "device"), _change(_around(seed, "gone", 700, 300) + 3 * SECOND, "light.kitchen", "off", "device")))
    made = rows.select("day", F.explode(F.concat(*[p.cast(CHANGE) for p in parts])).alias("c")).select("day", "c.*")
    us = F.col("day") * DAY + F.col("at")
    told = made.select(F.xxhash64(us, "entity_id", "state").alias("sid"), us.alias("us"), "entity_id", F.split_part("entity_id", F.lit("."), F.lit(1)).alias("domain"), "state", F.when(F.col("entity_id").startswith("sensor."), F.col("state").try_cast("double")).alias("num"), "cause", "cause_entity")
    old = F.lag("state").over(W.partitionBy("entity_id").orderBy("us", "sid"))
    return told.withColumn("old_state", old).withColumn("context", F.col("sid")).withColumn("chain_depth", F.lit(0))
