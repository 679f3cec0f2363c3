"""Root causes of state changes, and human corrections of automated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hops followed from a context to its root.
MAX_DEPTH = 12
_DOUBLINGS = 4


def build_index(changes: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row per context: parent, user, origin, origin_entity.

    The first parent that is not the context itself and the first user win, events before states, then by time; an
    automation origin beats a script origin.
    """
    cols = ["context", "parent", "user", "origin", "origin_entity"]
    rows = changes.select(F.struct(F.lit(1).alias("late"), "us", "sid").alias("at"), *cols)
    if events is not None:
        rows = rows.unionByName(events.select(F.struct(F.lit(0).alias("late"), "us", "sid").alias("at"), *cols))
    named = rows.filter("context is not null")
    proper = F.when(F.col("parent") != F.col("context"), F.col("at"))
    origin = F.when(F.col("origin").isNotNull(), F.struct((F.col("origin") != "automation").alias("other"), "at"))
    return named.groupBy("context").agg(
        F.min_by("parent", proper).alias("parent"),
        F.min_by("user", F.when(F.col("user").isNotNull(), F.col("at"))).alias("user"),
        F.min_by("origin", origin).alias("origin"),
        F.min_by("origin_entity", origin).alias("origin_entity"),
    )


def roots(index: DataFrame) -> DataFrame:
    """One row per context that must walk: context, tip (the context that decides) and depth.

    Path doubling: after k joins a path has up to 2^k hops, so four joins of the walking contexts alone cover the cap
    of MAX_DEPTH whatever the length of the chains; a repeated context ends a path where it would end the walk.
    """
    walking = index.filter("origin is null and user is null and parent is not null")
    path = walking.select("context", F.array("context", "parent").alias("path"), F.col("parent").alias("next"))
    for _ in range(_DOUBLINGS):
        ahead = path.select(F.col("context").alias("next"), F.col("path").alias("ahead"), F.col("next").alias("then"))
        path = path.join(ahead, "next", "left").select(
            "context",
            F.when(F.col("ahead").isNotNull(), F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.col("ahead"))).otherwise(F.col("path")).alias("path"),
            F.col("then").alias("next"),
        )
    distinct = F.array_distinct("path")
    full = F.size(distinct) > MAX_DEPTH + 1
    cyclic = F.size(distinct) < F.size("path")
    return path.select(
        "context",
        F.when(~full & ~cyclic, F.element_at("path", -1)).alias("tip"),
        F.when(full, MAX_DEPTH).otherwise(F.size(distinct) - 1).alias("hops"),
    )


def annotate(changes: DataFrame, events: DataFrame | None = None, excluded_users: list | None = None) -> DataFrame:
    """``changes`` with cause, cause_entity and chain_depth.

    At each hop an origin beats a user; a row without context is human if it has a user, else unknown; a walk that finds
    nothing is human if the row has a user, else a device whose depth counts the hop that failed.
    """
    index = build_index(changes, events)
    tips = roots(index)
    ends = index.select(F.col("context").alias("tip"), F.col("user").alias("tip_user"), F.col("origin").alias("tip_origin"), F.col("origin_entity").alias("tip_entity"))
    decided = index.select("context").join(tips, "context", "left").select("context", F.coalesce("tip", F.when(F.col("hops").isNull(), F.col("context"))).alias("tip"), F.coalesce("hops", F.lit(0)).alias("hops"))
    decided = decided.join(ends, "tip", "left").drop("tip")
    out = changes.join(decided, "context", "left")
    human = F.when(F.col("context").isNull(), F.col("user")).otherwise(F.coalesce("tip_user", F.when(F.col("tip_origin").isNull(), F.col("user"))))
    cause = (
        F.when(F.col("context").isNull(), F.when(F.col("user").isNull(), "unknown").otherwise("human"))
        .when(F.col("tip_origin").isNotNull(), F.col("tip_origin"))
        .when(human.isNotNull(), "human")
        .otherwise("device")
    )
    depth = F.when(F.col("context").isNull(), 0).when(F.col("tip_origin").isNotNull() | F.col("tip_user").isNotNull(), F.col("hops")).otherwise(F.col("hops") + 1)
    entity = F.when(F.col("context").isNotNull(), F.col("tip_entity"))
    if excluded_users:
        cause = F.when((cause == "human") & human.isin(*excluded_users), "automation").otherwise(cause)
    return out.select(*[F.col(c) for c in changes.columns], cause.alias("cause"), entity.alias("cause_entity"), depth.alias("chain_depth"))


def overrides(annotated: DataFrame, window_us: int = 120_000_000, with_devices: bool = False) -> DataFrame:
    """Human changes that undo an automated one within the window (inclusive).

    An automated change is pending until a human change of another state; of the human changes that follow it only the
    first with another state can be a correction, and it is one if it is not too late. Time only grows, so once one is too
    late all later ones are.
    """
    people = ["human", "device"] if with_devices else ["human"]
    by = W.partitionBy("entity_id").orderBy("us", "sid")
    automated = F.col("cause").isin("automation", "script")
    pending = F.last(F.when(automated, F.struct("sid", "us", "state", "cause_entity")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = annotated.withColumn("pending", pending).filter(F.col("cause").isin(people) & F.col("pending").isNotNull() & (F.col("state") != F.col("pending.state")))
    first = F.row_number().over(W.partitionBy("entity_id", "pending.sid").orderBy("us", "sid"))
    found = rows.withColumn("n", first).filter((F.col("n") == 1) & (F.col("us") - F.col("pending.us") <= window_us))
    return found.select("entity_id", "us", F.col("pending.cause_entity").alias("automation"), F.col("pending.state").alias("automation_state"), F.col("state").alias("human_state"), (F.col("us") - F.col("pending.us")).alias("delay_us"), "context")


def override_summary(found: DataFrame) -> DataFrame:
    """Per automation: how often it is undone, on how many entities, and which states people prefer (state=count)."""
    states = found.groupBy("automation", "human_state").agg(F.count(F.lit(1)).alias("n"))
    liked = states.groupBy("automation").agg(F.sort_array(F.collect_list(F.concat_ws("=", "human_state", "n"))).alias("liked"))
    total = found.groupBy("automation").agg(F.count(F.lit(1)).alias("overrides"), F.countDistinct("entity_id").alias("entities"))
    return total.join(liked, "automation").select("automation", "overrides", "entities", F.array_join("liked", ",").alias("preferred"))


def cause_histogram(annotated: DataFrame, flag_share: float = 0.1) -> DataFrame:
    """Rows per cause, and whether so many are unknown that causes should not be trusted."""
    counts = annotated.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.select("cause", "n", ((F.col("cause") == "unknown") & (F.col("n") >= flag_share * total)).alias("flagged"))
