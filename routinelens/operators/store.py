"""Tables of suggestions, overrides and shadow fires as key merges of DataFrames; a caller writes the result as the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, fresh: DataFrame, run: int) -> DataFrame:
    """Suggestions (id, miner, score, status, seen_count, last_run): a known id keeps its status and counts one sighting more."""
    old = table.select("id", *[F.col(c).alias(f"old_{c}") for c in ("miner", "score", "status", "seen_count", "last_run")])
    both = old.join(fresh, "id", "full_outer")
    seen = F.col("score").isNotNull()
    return both.select(
        "id", F.coalesce("miner", "old_miner").alias("miner"), F.coalesce("score", "old_score").alias("score"), F.coalesce("old_status", F.lit("new")).alias("status"),
        (F.coalesce("old_seen_count", F.lit(0)) + seen.cast("int")).alias("seen_count"), F.when(seen, run).otherwise(F.col("old_last_run")).alias("last_run"),
    )


def prune(table: DataFrame, run: int) -> DataFrame:
    """Without new or suppressed suggestions of earlier runs."""
    return table.filter(~(F.col("status").isin("new", "suppressed") & (F.col("last_run") < run)))


def top(table: DataFrame, limit: int, status: str | None = None, miner: str | None = None) -> DataFrame:
    """By acceptance probability (unknown last), score and last sighting, of one status or miner if asked."""
    for column, value in (("status", status), ("miner", miner)):
        table = table if value is None else table.filter(F.col(column) == value)
    return table.orderBy(F.col("probability").desc_nulls_last(), F.desc("score"), F.desc("last_run"), "id").limit(limit)


def insert_ignore(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those rows of ``fresh`` whose key it does not have; of rows of one key in ``fresh``, one."""
    return table.unionByName(fresh.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def dismiss(table: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("gone")).distinct()
    return table.join(gone, "id", "left").withColumn("status", F.when(F.col("gone"), "dismissed").otherwise(F.col("status"))).drop("gone")


def shadow_report(fires: DataFrame) -> DataFrame:
    return fires.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fires"), F.count_if("matched").alias("matched"), F.max("us").alias("last_us"))


def ranking_labels(feedback: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The latest accepted or dismissed feedback (id, n, decision) of each suggestion with its snapshot at decision."""
    latest = feedback.filter(F.col("decision").isin("accepted", "dismissed")).groupBy("id").agg(F.max_by("decision", "n").alias("decision"))
    return latest.join(snapshots, "id").withColumn("label", (F.col("decision") == "accepted").cast("int"))


def merge(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``fresh`` in place of the rows of ``table`` with its keys: back-tests, health, gaps, models and generations are kept so."""
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def decide(table: DataFrame, feedback: DataFrame, id_: str, decision: str, n: int, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The suggestions and the feedback log after one is accepted, dismissed or restored; the log keeps its score and sightings then."""
    status = {"accepted": "accepted", "dismissed": "dismissed", "restored": "new"}[decision]
    snap = table.filter(F.col("id") == id_).select("id", F.lit(decision).alias("decision"), F.lit(n).cast("long").alias("n"), F.lit(reason).cast("string").alias("reason"), "score", "seen_count")
    return table.withColumn("status", F.when(F.col("id") == id_, status).otherwise(F.col("status"))), feedback.unionByName(snap)


def suppress(table: DataFrame, links: DataFrame, preferences: DataFrame) -> DataFrame:
    """New suggestions that an active preference (pref_id, active) is linked to (id, pref_id) become suppressed, and note it."""
    hidden = links.join(preferences.filter("active").select("pref_id"), "pref_id", "left_semi").groupBy("id").agg(F.min("pref_id").alias("hidden_by"))
    told = table.drop("hidden_by").join(hidden, "id", "left")
    gone = (F.col("status") == "new") & F.col("hidden_by").isNotNull()
    return told.withColumns({"status": F.when(gone, "suppressed").otherwise(F.col("status")), "hidden_by": F.when(gone, F.col("hidden_by"))})


def unhide(table: DataFrame, inactive: DataFrame) -> DataFrame:
    """Suggestions that a preference no longer active (pref_id) had suppressed are new again."""
    back = table.join(inactive.select(F.col("pref_id").alias("hidden_by"), F.lit(True).alias("back")).distinct(), "hidden_by", "left")
    free = F.coalesce("back", F.lit(False)) & (F.col("status") == "suppressed")
    return back.select(*[(F.when(free, "new").otherwise(F.col(c)) if c == "status" else F.when(~free, F.col(c)) if c == "hidden_by" else F.col(c)).alias(c) for c in table.columns])


def set_active(preferences: DataFrame, pref_id: str, active: bool) -> DataFrame:
    return preferences.withColumn("active", F.when(F.col("pref_id") == pref_id, active).otherwise(F.col("active")))


def close_interrupted(runs: DataFrame, now_us: int) -> DataFrame:
    """Runs (run, started_us, finished_us, status) that never finished end now, as interrupted."""
    open_ = F.col("finished_us").isNull()
    return runs.withColumn("status", F.when(open_, "interrupted").otherwise(F.col("status"))).withColumn("finished_us", F.coalesce("finished_us", F.lit(now_us)))


def first_seen(table: DataFrame, run: int, most: int = 5) -> DataFrame:
    """What a run found for the first time, as one row: how many, and the ids of the best, to be announced."""
    fresh = table.filter((F.col("status") == "new") & (F.col("seen_count") == 1) & (F.col("last_run") == run))
    best = fresh.orderBy(F.desc("score"), "id").limit(most)
    return fresh.agg(F.count(F.lit(1)).alias("n")).join(best.agg(F.array_sort(F.collect_list("id")).alias("ids")))


def dismissed(table: DataFrame, feedback: DataFrame, latest: int = 200) -> DataFrame:
    """Dismissed suggestions with the newest reason given, the newest dismissals first."""
    why = feedback.filter("decision = 'dismissed'").groupBy("id").agg(F.max_by("reason", "n").alias("reason"), F.max("n").alias("n"))
    return table.filter("status = 'dismissed'").select("id", "miner").join(why, "id", "left").orderBy(F.col("n").desc_nulls_last(), "id").limit(latest)
