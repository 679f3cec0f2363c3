"""Conditions that separate the moments of an action from the same hours of other days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.model import DAY

COVERAGE, LIFT = 0.75, 1.4
MIN_POSITIVE, MIN_BACKGROUND = 4, 10


def background(actions: DataFrame, start_us: int, end_us: int, grain_us: int = 1) -> DataFrame:
    """Per action kind (entity_id, state) the times of day of its actions on days without one.

    Days are left out by their number since the window's start, but generated from UTC midnight of its first day; the two
    differ unless the window starts at midnight. Times are within [start, end). Times of day are told apart by ``grain_us``: exact
    ones make rows with the square of the history, minutes at most 1440 a free day.
    """
    key = ["entity_id", "state"]
    times = actions.select(*key, (F.floor(F.pmod("us", F.lit(DAY)) / grain_us) * grain_us).alias("tod")).distinct()
    busy = actions.select(*key, F.floor((F.col("us") - start_us) / DAY).alias("n")).distinct()
    count = (end_us - start_us) // DAY + 1
    free = actions.select(*key).distinct().withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(busy, [*key, "n"], "left_anti")
    made = free.join(times, key).withColumn("us", F.lit(start_us - start_us % DAY) + F.col("n") * DAY + F.col("tod"))
    return made.filter((F.col("us") >= start_us) & (F.col("us") < end_us)).select(*key, "us")


def numeric_stump(samples: DataFrame, coverage: float = COVERAGE, lift: float = LIFT) -> DataFrame:
    """From rows (entity_id, state, signal, positive, num): the best threshold per kind and signal that clears both bars.

    Thresholds are the distinct values to two places, both directions strict. Samples are first counted below, at and above the
    threshold that they round to: rounding keeps their order, so a running sum over one row a threshold gives the counts at each.
    """
    key = ["entity_id", "state", "signal"]
    rows = samples.filter("num is not null").select(*key, "positive", "num", F.round("num", 2).alias("cut"))
    total = W.partitionBy(*key)
    sides = {"p": F.col("positive"), "b": ~F.col("positive")}
    points = rows.groupBy(*key, "cut").agg(*[F.count_if(side & when).alias(f"{c}_{name}") for c, side in sides.items() for name, when in (("all", F.lit(True)), ("less", F.col("num") < F.col("cut")), ("more", F.col("num") > F.col("cut")))])
    upto = total.orderBy("cut").rowsBetween(W.unboundedPreceding, 0)
    sums = points.select(
        *key, "cut", F.count(F.lit(1)).over(total).alias("cuts"), *[F.sum(f"{c}_all").over(total).alias(f"n{c}") for c in sides],
        *[(F.sum(f"{c}_all").over(upto) - F.col(f"{c}_all") + F.col(f"{c}_less")).alias(f"{c}_below") for c in sides], *[(F.sum(f"{c}_all").over(upto) - F.col(f"{c}_more")).alias(f"{c}_upto") for c in sides],
    )
    tried = sums.select(
        *key, "np", "nb", "cuts", "cut",
        F.explode(F.array(
            F.struct(F.lit("below").alias("direction"), F.lit(0).alias("late"), F.col("p_below").alias("p"), F.col("b_below").alias("b")),
            F.struct(F.lit("above").alias("direction"), F.lit(1).alias("late"), (F.col("np") - F.col("p_upto")).alias("p"), (F.col("nb") - F.col("b_upto")).alias("b")),
        )).alias("t"),
    ).select(*key, "np", "nb", "cuts", "cut", "t.*")
    rated = tried.withColumn("coverage", F.col("p") / F.col("np")).withColumn("baseline", F.greatest(F.col("b"), F.lit(0.5)) / F.col("nb"))
    rated = rated.withColumn("lift", F.col("coverage") / F.col("baseline")).filter((F.col("np") >= MIN_POSITIVE) & (F.col("nb") >= MIN_BACKGROUND) & (F.col("cuts") >= 2))
    good = rated.filter((F.col("coverage") >= coverage) & (F.col("lift") >= lift)).withColumn("strength", F.col("coverage") * F.least(F.col("lift") / 2, F.lit(1.0)))
    best = F.row_number().over(total.orderBy(F.desc("strength"), "cut", "late"))
    return good.withColumn("rank", best).filter("rank = 1").select(*key, "direction", "cut", "coverage", "lift", "strength")


def categorical_split(samples: DataFrame, coverage: float = 0.0, lift: float = 0.0) -> DataFrame:
    """From rows (entity_id, state, signal, positive, us, str): the modal value at actions, the first seen of equal ones."""
    key = ["entity_id", "state", "signal"]
    rows = samples.filter("str is not null")
    totals = rows.groupBy(*key).agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nb"))
    values = rows.groupBy(*key, "str").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("b"), F.min(F.when(F.col("positive"), F.col("us"))).alias("first"))
    modal = values.filter("p > 0").groupBy(*key).agg(F.max(F.struct("p", (-F.col("first")).alias("early"), "str", "b")).alias("m"))
    rated = modal.join(totals, key).filter((F.col("np") >= MIN_POSITIVE) & (F.col("nb") >= MIN_BACKGROUND))
    rated = rated.select(*key, F.col("m.str").alias("value"), (F.col("m.p") / F.col("np")).alias("coverage"), (F.greatest("m.b", F.lit(0.5)) / F.col("nb")).alias("baseline"))
    rated = rated.withColumn("lift", F.col("coverage") / F.col("baseline")).withColumn("strength", F.col("coverage") * F.least(F.col("lift") / 2, F.lit(1.0)))
    return rated.filter((F.col("coverage") >= coverage) & (F.col("lift") >= lift))


def conditions(samples: DataFrame, kinds: DataFrame, order: DataFrame, most: int = 2, coverage: float = COVERAGE, lift: float = LIFT) -> DataFrame:
    """Per action kind its strongest signals, at most ``most``: the first is the trigger, others are conditions.

    samples (entity_id, state, signal, positive, us, num, str), kinds (signal, numeric), order (signal, place) to settle equal strengths.
    """
    told = samples.join(kinds, "signal")
    stumps = numeric_stump(told.filter("numeric"), coverage, lift).select("entity_id", "state", "signal", F.concat_ws(" ", "direction", F.col("cut").cast("string")).alias("test"), "coverage", "lift", "strength")
    splits = categorical_split(told.filter("not numeric"), coverage, lift).select("entity_id", "state", "signal", F.concat(F.lit("is "), F.col("value")).alias("test"), "coverage", "lift", "strength")
    ranked = stumps.unionByName(splits).join(order, "signal").withColumn("rank", F.row_number().over(W.partitionBy("entity_id", "state").orderBy(F.desc("strength"), "place", "signal")))
    return ranked.filter(F.col("rank") <= most).select("entity_id", "state", "rank", "signal", "test", "coverage", "lift", "strength")
