"""Signals: right-continuous step functions of entities, read by as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.model import HOUR, NO_READING
from routinelens.operators.asof import asof, asof_all


def number(state: Column) -> Column:
    """The state as a number; texts for infinity and not-a-number are none."""
    n = state.try_cast("double")
    return F.when(state.rlike("[0-9]"), F.when(~F.isnan(n) & ~F.abs(n).isin(float("inf")), n))  # a failed cast is slow, and words like "on" are told by their letters


def build(changes: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Points (entity_id, us, sid, num, str) of the wanted entities; ``entity#attribute`` reads an attribute."""
    rows = changes.filter(~F.lower("state").isin(*NO_READING))
    plain = rows if wanted is None else rows.filter(F.col("entity_id").isin(*[w for w in wanted if "#" not in w]))
    points = plain.select("entity_id", "us", "sid", number(F.col("state")).alias("num"), F.col("state").alias("str"))
    for name in [w for w in wanted or [] if "#" in w]:
        entity, attribute = name.split("#", 1)
        value = F.col("attributes")[attribute]
        points = points.unionByName(changes.filter((F.col("entity_id") == entity) & value.isNotNull()).select(F.lit(name).alias("entity_id"), "us", "sid", number(value).alias("num"), value.alias("str")))
    return points


def value_at(probes: DataFrame, points: DataFrame, staleness_us: int | None = None, width: int | None = None) -> DataFrame:
    """``probes`` (entity_id, us, ...) with num and str of the last point at or before each, not older than staleness."""
    return asof(probes, points, ["entity_id"], "us", "sid", ["num", "str"], width=width, staleness=staleness_us)


def values_at(moments: DataFrame, points: DataFrame, names: list[str], staleness_us: int | None = None, width: int | None = None) -> DataFrame:
    """``moments`` (us, ...) with each named signal's num and str then: one row a moment and signal (column signal), read in one pass."""
    return asof_all(moments, points.withColumnRenamed("entity_id", "signal"), "signal", names, "us", "sid", ["num", "str"], width=width, staleness=staleness_us)


def catalogue(points: DataFrame) -> DataFrame:
    """Per entity: points, whether all are numbers, range, and the number of distinct states."""
    return points.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count("num") == F.count(F.lit(1))).alias("numeric"), F.min("num").alias("low"), F.max("num").alias("high"), F.countDistinct("str").alias("states")
    )


def distinct_values(points: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` distinct values of each entity in order of their first time."""
    firsts = points.groupBy("entity_id", "str").agg(F.min(F.struct("us", "sid")).alias("first"))
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy("entity_id").orderBy("first")))
    return ranked.filter(F.col("rank") <= limit).select("entity_id", "str", "rank")


def top_up(points: DataFrame, statistics: DataFrame, end_us: int, few: int = 24) -> DataFrame:
    """Add hourly statistics (entity_id, start_us, mean, max) to numeric entities with fewer than ``few`` points.

    A statistic counts at the close of its hour, strictly before the end; only outside the raw points' time range.
    """
    raw = points.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), (F.count("num") == F.count(F.lit(1))).alias("numeric"))
    stats = statistics.select("entity_id", (F.col("start_us") + HOUR).alias("us"), F.coalesce("mean", "max").alias("num")).filter((F.col("us") < end_us) & F.col("num").isNotNull())
    more = stats.join(raw, "entity_id", "left").filter(F.col("n").isNull() | (F.col("numeric") & (F.col("n") < few) & ((F.col("us") < F.col("first")) | (F.col("us") > F.col("last")))))
    return points.unionByName(more.select("entity_id", "us", F.lit(-1).cast("long").alias("sid"), "num", F.col("num").cast("string").alias("str")))
