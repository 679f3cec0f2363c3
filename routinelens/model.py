"""The state-change table and its projection from the driver's ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
#: States that mean no reading.
NO_READING = ("unknown", "unavailable", "")
#: Domains whose entities can be acted on.
ACTIONABLE = ("light", "switch", "fan", "cover", "climate", "media_player", "lock", "vacuum", "humidifier", "water_heater", "input_boolean", "input_number", "input_select", "select", "number", "siren", "valve", "lawn_mower", "scene", "script")
#: Domains where a wrong rule costs more, and services that leave a home less secured.
RISKY = ("lock", "cover", "valve", "alarm_control_panel", "water_heater", "siren", "lawn_mower", "vacuum")
SECURITY = ("lock.unlock", "lock.open", "cover.open_cover", "cover.open_cover_tilt", "valve.open_valve", "alarm_control_panel.alarm_disarm")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def day(us: Column, offset_us: int = 0) -> Column:
    """Local day number since 1970-01-01."""
    return F.floor((us + offset_us) / DAY)


def minute_of_day(us: Column, offset_us: int = 0) -> Column:
    return F.floor(F.pmod(us + offset_us, F.lit(DAY)) / MINUTE).cast("int")


def weekday(us: Column, offset_us: int = 0) -> Column:
    """0 is Monday."""
    return F.pmod(day(us, offset_us) + 3, F.lit(7)).cast("int")


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as state changes: sid, us, entity_id, domain, state, num, old_state, context, parent, user, origin kind."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind, even = F.col("event_type"), k % 2 == 0
    prefix = F.when(kind == "click", "light.z").when(kind == "view", "media_player.z").when(kind == "purchase", "switch.z").when(kind == "signup", "person.p").otherwise("sensor.t")
    state = (
        F.when(kind.isin("click", "purchase"), F.when(even, "on").otherwise("off"))
        .when(kind == "view", F.when(even, "playing").otherwise("off"))
        .when(kind == "signup", F.when(even, "home").otherwise("not_home"))
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    )
    entity = F.concat(prefix, (F.col("user_id") % 4).cast("string"))
    rows = e.select(
        F.col("event_id").alias("sid"),
        micros(F.col("ts")).alias("us"),
        entity.alias("entity_id"),
        F.split_part(entity, F.lit("."), F.lit(1)).alias("domain"),
        state.alias("state"),
        F.when(kind == "error", F.col("value")).alias("num"),
        F.when(~((k % 10 == 9) & (k >= 50)), F.col("event_id")).alias("context"),
        F.when((k % 10).isin(6, 7), F.col("event_id") - 1).alias("parent"),
        F.when(k % 10 <= 5, F.col("user_id")).alias("user"),
        F.when(k % 10 == 8, "automation").when((k % 10 == 9) & (k < 50), "script").alias("origin"),
        F.concat(F.when(k % 10 == 8, "automation.r").when((k % 10 == 9) & (k < 50), "script.r"), (F.col("user_id") % 4).cast("string")).alias("origin_entity"),
    )
    return rows.withColumn("old_state", F.lag("state").over(W.partitionBy("entity_id").orderBy("us", "sid")))


def is_transition() -> Column:
    return F.col("old_state").isNotNull() & (F.col("old_state") != F.col("state"))


#: The same projection, with causes, as the first part of the SQL that results are compared with.
PRELUDE = """
WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) AS us FROM events),
base0 AS (SELECT event_id AS sid, us,
    CASE event_type WHEN 'click' THEN 'light.z' WHEN 'view' THEN 'media_player.z' WHEN 'purchase' THEN 'switch.z'
                    WHEN 'signup' THEN 'person.p' ELSE 'sensor.t' END || (user_id % 4) AS entity_id,
    CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN k % 2 = 0 THEN 'on' ELSE 'off' END
         WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'playing' ELSE 'off' END
         WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'home' ELSE 'not_home' END
         ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS state,
    CASE WHEN event_type = 'error' THEN value END AS num,
    CASE WHEN k % 10 = 9 AND k >= 50 THEN NULL ELSE event_id END AS context,
    CASE WHEN k % 10 IN (6, 7) THEN event_id - 1 END AS parent,
    CASE WHEN k % 10 <= 5 THEN user_id END AS usr,
    CASE WHEN k % 10 = 8 THEN 'automation' WHEN k % 10 = 9 AND k < 50 THEN 'script' END AS origin,
    CASE WHEN k % 10 = 8 THEN 'automation.r' WHEN k % 10 = 9 AND k < 50 THEN 'script.r' END || (user_id % 4) AS origin_entity
    FROM e),
base AS (SELECT *, split_part(entity_id, '.', 1) AS domain,
    lag(state) OVER (PARTITION BY entity_id ORDER BY us, sid) AS old_state FROM base0),
walk AS (SELECT sid, context AS cur, 0 AS depth FROM base WHERE context IS NOT NULL
    UNION ALL
    SELECT w.sid, b.parent, w.depth + 1 FROM walk w JOIN base b ON b.context = w.cur
    WHERE b.origin IS NULL AND b.usr IS NULL AND b.parent IS NOT NULL AND w.depth < 12),
tip AS (SELECT sid, max_by(cur, depth) AS cur, max(depth) AS depth FROM walk GROUP BY sid),
ann AS (SELECT b.*, b.us // 86400000000 AS day, (b.us // 60000000) % 1440 AS minute, (b.us // 86400000000 + 3) % 7 AS wd,
    CASE WHEN b.context IS NULL THEN CASE WHEN b.usr IS NULL THEN 'unknown' ELSE 'human' END
         WHEN t.origin IS NOT NULL THEN t.origin WHEN t.usr IS NOT NULL THEN 'human' ELSE 'device' END AS cause,
    CASE WHEN b.context IS NOT NULL THEN t.origin_entity END AS cause_entity,
    CASE WHEN b.context IS NULL THEN 0 WHEN t.origin IS NOT NULL OR t.usr IS NOT NULL THEN tip.depth ELSE tip.depth + 1 END AS chain_depth
    FROM base b LEFT JOIN tip USING (sid) LEFT JOIN base t ON t.context = tip.cur)
"""
