"""Clock arithmetic on minutes of the day, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD = 1440
_TURN = 2 * math.pi / PERIOD


def distance(a: Column, b: Column, period: int = PERIOD) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, period - d)


def mean(minute: Column) -> Column:
    """Aggregate: the circular mean; where all cancel out, the smallest value, as rows have no first."""
    s, c = F.sum(F.sin(minute * _TURN)), F.sum(F.cos(minute * _TURN))
    turned = F.pmod(F.atan2(s, c) / _TURN, F.lit(float(PERIOD)))
    return F.when((F.abs(s) < 1e-9) & (F.abs(c) < 1e-9), F.min(minute).cast("double")).otherwise(turned)


def std(minute: Column) -> Column:
    """Aggregate: the circular standard deviation in minutes; 0 for fewer than two values."""
    r = F.sqrt(F.pow(F.avg(F.sin(minute * _TURN)), 2) + F.pow(F.avg(F.cos(minute * _TURN)), 2))
    spread = F.sqrt(-2 * F.log(F.greatest(F.least(r, F.lit(1.0)), F.lit(1e-9)))) / _TURN
    return F.when(F.count(minute) < 2, 0.0).otherwise(spread)


def hhmm(minute: Column) -> Column:
    """HH:MM:00 of a minute, rounded half to even."""
    m = F.pmod(F.bround(minute).cast("long"), F.lit(PERIOD))
    return F.format_string("%02d:%02d:00", F.floor(m / 60), m % 60)


def parse(text: Column) -> Column:
    """Minutes of a strict HH:MM or HH:MM:SS, else null."""
    part = lambda k: F.regexp_extract(text, r"^([01][0-9]|2[0-3]):([0-5][0-9])(:[0-5][0-9])?$", k)
    return F.when(part(1) != "", part(1).cast("int") * 60 + part(2).cast("int"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts end in an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))).otherwise(t)


def tight_groups(times: DataFrame, within: float, period: int = PERIOD) -> DataFrame:
    """Rows (anchor, minute): for times of day (minute) all largest groups that lie within so many minutes, also around midnight.

    A group is told by its first time on the way round the clock. Distinct minutes of a day are few, so the window over three turns of the clock is one
    small task whatever the input.
    """
    once = times.select(F.col("minute").cast("double").alias("minute")).filter("minute is not null").distinct()
    turns = once.select("minute", F.explode(F.array(*[F.lit(float(k * period)) for k in (0, 1, 2)])).alias("turn")).withColumn("at", F.col("minute") + F.col("turn"))
    ahead = W.orderBy("at").rangeBetween(0, within)
    spans = turns.select("minute", "turn", "at", F.max("at").over(ahead).alias("last"), F.collect_list("minute").over(ahead).alias("members"))
    before = spans.select("*", F.lag("last").over(W.orderBy("at")).alias("covered"))
    first = before.filter((F.col("turn") == period) & (F.col("covered").isNull() | (F.col("last") > F.col("covered"))))
    return first.select(F.col("minute").alias("anchor"), F.explode(F.array_distinct("members")).alias("minute"))
