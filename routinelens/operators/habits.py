"""Human actions and the hours at which they recur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens import model
from routinelens.functions import circular
from routinelens.model import ACTIONABLE, NO_READING

#: The day filters in the order in which they are tried, with the weekdays (0 is Monday) of each.
FILTERS = (("all", (0, 1, 2, 3, 4, 5, 6)), ("weekdays", (0, 1, 2, 3, 4)), ("weekends", (5, 6)))
#: A restricted filter must be better than all days by more than this.
MARGIN = 0.15


def human_actions(annotated: DataFrame, actionable: tuple[str, ...] = ACTIONABLE) -> DataFrame:
    """Transitions that people made of entities that can be acted on, with day, minute and weekday."""
    rows = annotated.filter((F.col("cause") == "human") & F.col("domain").isin(*actionable) & ~F.lower("state").isin(*NO_READING) & model.is_transition())
    us = F.col("us")
    return rows.select("sid", "us", "entity_id", "domain", F.lower("state").alias("state"), "context", model.day(us).alias("day"), model.minute_of_day(us).alias("minute"), model.weekday(us).alias("wd"))


def eligible_days(start_us: int, end_us: int, spark) -> DataFrame:
    """Per filter the days from start to end, both included."""
    first, last = start_us // model.DAY, end_us // model.DAY
    days = spark.range(first, last + 1).select(F.pmod(F.col("id") + 3, F.lit(7)).alias("wd"))
    return days.agg(*[F.count_if(F.col("wd").isin(*wds)).alias(k) for k, wds in FILTERS]).select(F.explode(F.create_map(*[x for k, _ in FILTERS for x in (F.lit(k), F.col(k))])).alias("filter", "days"))


def first_per_day(actions: DataFrame) -> DataFrame:
    """The first action of each entity, state and day, once for each day filter that has the day."""
    ones = actions.groupBy("entity_id", "state", "day").agg(F.min(F.struct("us", "sid", "minute", "wd")).alias("f")).select("entity_id", "state", "day", "f.*")
    kinds = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("filter"), F.array(*map(F.lit, wds)).alias("wds")) for i, (k, wds) in enumerate(FILTERS)]), lambda f: F.array_contains(f["wds"], F.col("wd")))
    return ones.select("entity_id", "state", "day", "us", "minute", F.explode(kinds).alias("k")).select("entity_id", "state", "day", "us", "minute", "k.rank", "k.filter")


def clusters(daily: DataFrame, bandwidth: int, min_days: int) -> DataFrame:
    """Per entity, state and filter: the densest circular cluster of minutes: centre and members.

    Candidate centres are the observed minutes, at most 1440 a group, whatever the number of days; their counts meet
    pairwise per group. The smallest of equal centres wins; the circular mean of its members replaces it if it keeps as many.
    """
    key = ["entity_id", "state", "rank", "filter"]
    counts = daily.groupBy(*key, "minute").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(W.partitionBy(*key))).filter(F.col("total") >= min_days)
    centres = counts.select(*key, F.col("minute").alias("centre"))
    near = centres.join(counts, key).filter(circular.distance(F.col("minute"), F.col("centre")) <= bandwidth)
    sums = near.groupBy(*key, "centre").agg(F.sum("n").alias("members"), F.sum(F.col("n") * F.sin(F.col("minute") * circular._TURN)).alias("s"), F.sum(F.col("n") * F.cos(F.col("minute") * circular._TURN)).alias("c"))
    best = sums.groupBy(*key).agg(F.max(F.struct("members", (-F.col("centre")).alias("minus"), "s", "c")).alias("b"))
    refined = best.select(*key, F.col("b.members").alias("members"), (-F.col("b.minus")).cast("double").alias("centre"), F.pmod(F.atan2("b.s", "b.c") / circular._TURN, F.lit(1440.0)).alias("mean"))
    again = refined.join(counts, key).groupBy(*key, "members", "centre", "mean").agg(F.sum(F.when(circular.distance(F.col("minute").cast("double"), F.col("mean")) <= bandwidth, F.col("n")).otherwise(0)).alias("kept"))
    better = F.col("kept") >= F.col("members")
    return again.select(*key, F.when(better, F.col("mean")).otherwise(F.col("centre")).alias("centre"), F.when(better, F.col("kept")).otherwise(F.col("members")).alias("members"))


def time_of_day(actions: DataFrame, start_us: int, end_us: int, bandwidth: int = 20, min_occurrences: int = 6, min_consistency: float = 0.6) -> DataFrame:
    """Habits: entity_id, state, filter, hits, days, consistency, minute and score."""
    key = ["entity_id", "state"]
    busy = actions.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_occurrences).select(*key)
    daily = first_per_day(actions.join(busy, key, "left_semi"))
    found = clusters(daily, bandwidth, min_occurrences)
    hits = daily.join(found, [*key, "rank", "filter"]).filter(circular.distance(F.col("minute").cast("double"), F.col("centre")) <= bandwidth)
    counted = hits.groupBy(*key, "rank", "filter").agg(F.count(F.lit(1)).alias("hits"), circular.mean(F.col("minute")).alias("minute"), circular.std(F.col("minute")).alias("spread")).filter(F.col("hits") >= min_occurrences)
    days = eligible_days(start_us, end_us, actions.sparkSession)
    rated = counted.join(days, "filter").filter("days > 0").withColumn("consistency", F.least(F.col("hits") / F.col("days"), F.lit(1.0)))
    worth = F.when(F.col("rank") == 0, F.col("consistency")).otherwise(F.col("consistency") - MARGIN)
    best = rated.groupBy(*key).agg(F.max_by(F.struct("filter", "hits", "days", "consistency", "minute", "spread"), F.struct(worth, -F.col("rank"))).alias("b")).select(*key, "b.*")
    score = F.col("consistency") * F.least(F.col("hits") / F.lit(max(min_occurrences, 1)), F.lit(2.0)) / 2
    return best.filter(F.col("consistency") >= min_consistency).withColumn("score", score)
