"""Activity levels in bins, and tokens of context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens import model
from routinelens.model import DAY, MINUTE

BIN = 15 * MINUTE
#: States in which an entity is not active.
INACTIVE = ("off", "not_home", "away", "closed", "locked", "docked", "idle", "paused", "standby", "none", "unknown", "unavailable", "")


#: The buckets of what can be acted on, and of who is there.
BUCKETS = {
    "light": ("light",),
    "switch": ("switch", "input_boolean"),
    "media_player": ("media_player",),
    "climate": ("climate", "water_heater"),
    "other_actionable": ("cover", "lock", "fan", "humidifier", "input_number", "input_select", "select", "number", "siren", "valve", "lawn_mower", "scene", "script", "vacuum"),
    "presence": ("person", "device_tracker"),
}


def bucketed(changes: DataFrame) -> DataFrame:
    """The changes whose domain has a bucket, under its name; readings of sensors have none."""
    bucket = F.coalesce(*[F.when(F.col("domain").isin(*domains), name) for name, domains in BUCKETS.items()])
    return changes.withColumn("domain", bucket).filter("domain is not null")


def bins(changes: DataFrame, start_us: int, end_us: int, width_us: int = BIN) -> DataFrame:
    """Active entities per domain at the close of each bin of the window; earlier rows count into the first bin.

    Changes of activity become +1 or -1 edges, summed by bin; the level is their running sum over the bins. The spine is a
    row a bin and domain, whatever the number of changes.
    """
    rows = changes.filter(F.col("us") < end_us).withColumn("active", (~F.lower("state").isin(*INACTIVE)).cast("int"))
    edge = F.col("active") - F.coalesce(F.lag("active").over(W.partitionBy("entity_id").orderBy("us", "sid")), F.lit(0))
    number = F.greatest(F.floor((F.col("us") - start_us) / width_us), F.lit(0))
    moved = rows.withColumn("edge", edge).filter("edge <> 0").groupBy("domain", number.alias("bin")).agg(F.sum("edge").alias("edge"))
    count = -(-(end_us - start_us) // width_us)
    spine = changes.select("domain").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    level = F.sum(F.coalesce("edge", F.lit(0))).over(W.partitionBy("domain").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return spine.join(moved, ["domain", "bin"], "left").select("domain", "bin", level.alias("active"))


def vocabulary(rows: DataFrame, size: int = 48) -> DataFrame:
    """The most frequent items, then by name."""
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(size)


def gap_bucket(gap_us):
    """0 under ten seconds, 1 under a minute, 2 under ten minutes, 3 under an hour, 4 beyond or without a gap."""
    return F.when(gap_us < MINUTE // 6, 0).when(gap_us < MINUTE, 1).when(gap_us < 10 * MINUTE, 2).when(gap_us < 60 * MINUTE, 3).otherwise(4)


def windows(rows: DataFrame, size: int = 6) -> DataFrame:
    """Each row with the items before it, the oldest first, in one running list over all history.

    Days are windows of their own, for all tasks to share; what runs across midnight comes from a table of one row a day, the
    last ``size`` items and the last time of each day, carried over days that have fewer.
    """
    held = rows.withColumn("d", F.floor(F.col("us") / DAY))
    by = W.partitionBy("d").orderBy("us", "sid")
    tails = held.withColumn("back", F.row_number().over(W.partitionBy("d").orderBy(F.desc("us"), F.desc("sid")))).filter(F.col("back") <= size)
    ends = tails.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("us", "sid", "item"))).alias("tail"), F.max("us").alias("last"))
    days = W.orderBy("d").rowsBetween(-size, -1)  # one row a day; any day holds an item or more
    carry = ends.select("d", F.flatten(F.collect_list("tail").over(days)).alias("earlier"), F.lag("last").over(W.orderBy("d")).alias("last"))
    own = held.join(carry, "d").withColumn("own", F.collect_list("item").over(by.rowsBetween(-size, -1)))
    both = F.concat(F.col("earlier.item"), F.col("own"))
    gap = F.col("us") - F.coalesce(F.lag("us").over(by), F.col("last"))
    return own.select(*rows.columns, F.slice(both, F.greatest(F.lit(1), F.size(both) - size + 1), size).alias("before"), gap_bucket(gap).alias("gap"))


def usable(annotated: DataFrame) -> DataFrame:
    return annotated.filter(model.is_transition() & F.col("num").isNull()).select("sid", "us", "cause", F.concat_ws("=", "entity_id", "state").alias("item"))
