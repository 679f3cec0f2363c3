"""Automation files: raw automations as JSON documents, in one neutral shape.

Rows (key, automation, source) hold one automation's JSON text each. Steps may be nested as deep as they like: each level of branches is
one projection, written before the next, until a level has no steps. A list and a single value are read alike, but for branches, which are lists.
What is not an object is no automation, trigger, condition or step, and a text without a dot is no entity. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routinelens.storage import materialise

#: The state that a service leads to, by its name without the domain.
REACHED = {"turn_on": "on", "turn_off": "off", "open_cover": "open", "close_cover": "closed", "lock": "locked", "unlock": "unlocked", "media_play": "playing", "media_pause": "paused"}
#: Where a step keeps further steps.
BRANCHES = ("choose", "then", "else", "default", "sequence", "actions")
_NONE = "array<string>"


def _list(json: Column, path: str, single: bool = True) -> Column:
    """The values at a path as texts, objects as JSON; a single value is a list of one, or none."""
    raw = F.get_json_object(json, path)
    none = F.array().cast(_NONE)
    found = F.when(raw.startswith("["), F.from_json(raw, _NONE)).otherwise(F.array(raw) if single else none)
    return F.filter(F.coalesce(F.when(raw.isNull(), none).otherwise(found), none), lambda x: x.isNotNull())


def _objects(values: Column) -> Column:
    return F.filter(values, lambda x: x.startswith("{"))


def _either(json: Column, *paths: str) -> Column:
    """The first of the lists that is not empty."""
    first, *rest = paths
    return F.when(F.size(_list(json, first)) > 0, _list(json, first)).otherwise(_either(json, *rest)) if rest else _list(json, first)


def _entities(json: Column, path: str) -> Column:
    """Entity ids at a path: a text, a list, or an object that names them as entity_id or entity."""
    inner = lambda x: F.when(x.startswith("{"), F.concat(_list(x, "$.entity_id"), _list(x, "$.entity"))).otherwise(F.array(x))
    return F.filter(F.flatten(F.transform(_list(json, path), inner)), lambda x: x.contains(".") & ~x.startswith("{"))


def _text(json: Column, *paths: str) -> Column:
    """The first text at the paths that is not empty."""
    texts = [F.get_json_object(json, p) for p in paths]
    return F.coalesce(*[F.when((t != "") & ~t.startswith("{") & ~t.startswith("["), t) for t in texts])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The automations of JSON files, each a list or one, that have a trigger; key is file and place."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.posexplode(_objects(_list(F.col("value"), "$"))).alias("at", "automation"))
    told = files.filter(F.size(_either(F.col("automation"), "$.trigger", "$.triggers")) > 0)
    return told.select(F.concat_ws("#", "source", "at").alias("key"), "automation", "source")


def normalise(rows: DataFrame) -> DataFrame:
    """Per automation: key, id, alias, mode, trigger_entities, trigger_times, trigger_kinds, condition_entities, source."""
    raw = F.col("automation")
    triggers, conditions = _objects(_either(raw, "$.trigger", "$.triggers")), _objects(_either(raw, "$.condition", "$.conditions"))
    kind = lambda t: F.coalesce(_text(t, "$.platform", "$.trigger"), F.lit(""))
    times = F.flatten(F.transform(F.filter(triggers, lambda t: kind(t) == "time"), lambda t: _list(t, "$.at")))
    every = lambda steps: F.array_sort(F.array_distinct(F.flatten(F.transform(steps, lambda t: _entities(t, "$.entity_id")))))
    named = F.get_json_object(raw, "$.id")
    return rows.select(
        "key", named.alias("id"), F.coalesce(_text(raw, "$.alias", "$.id"), F.lit("unnamed automation")).alias("alias"), F.coalesce(_text(raw, "$.mode"), F.lit("single")).alias("mode"),
        every(triggers).alias("trigger_entities"), times.alias("trigger_times"), F.transform(triggers, kind).alias("trigger_kinds"), every(conditions).alias("condition_entities"), "source",
    )


def actions(rows: DataFrame) -> DataFrame:
    """Per call of a service or scene: key, path (the places that lead to its step), service, entity_ids, area_ids, device_ids, target_state, data."""
    step = F.col("step")
    service = _text(step, "$.service", "$.action")
    reached = F.element_at(F.create_map(*[F.lit(x) for pair in REACHED.items() for x in pair]), F.regexp_replace(service, r"^[^.]*\.", ""))
    ids = F.array_sort(F.array_distinct(F.concat(*[_entities(step, p) for p in ("$.entity_id", "$.target", "$.data.entity_id")])))
    more = lambda k: F.concat(_list(step, f"$.target.{k}"), _list(step, f"$.data.{k}"))
    none = F.array().cast(_NONE)
    called = F.struct(service.alias("service"), ids.alias("entity_ids"), more("area_id").alias("area_ids"), more("device_id").alias("device_ids"), F.coalesce(reached, _text(step, "$.data.hvac_mode"), _text(step, "$.data.option")).alias("target_state"), F.get_json_object(step, "$.data").alias("data"))
    scene = F.struct(F.lit("scene.turn_on").alias("service"), _entities(step, "$.scene").alias("entity_ids"), none.alias("area_ids"), none.alias("device_ids"), F.lit(None).cast("string").alias("target_state"), F.lit(None).cast("string").alias("data"))
    within = lambda item: F.when(F.get_json_object(item, "$.sequence").isNotNull(), _list(item, "$.sequence")).otherwise(F.array(item))
    below = F.concat(*[F.flatten(F.transform(_list(step, f"$.{k}", False), within)) for k in BRANCHES], _list(step, "$.repeat.sequence"))
    level = rows.select("key", F.posexplode(_objects(_either(F.col("automation"), "$.action", "$.actions"))).alias("at", "step")).select("key", F.array("at").alias("path"), "step")
    found = None
    while True:
        level = materialise(level, "automation-steps")
        made = F.array_compact(F.array(F.when(service.isNotNull(), called), F.when(F.get_json_object(step, "$.scene").isNotNull(), scene)))
        here = level.select("key", "path", F.explode(made).alias("a")).select("key", "path", "a.*")
        found = here if found is None else found.unionByName(here)
        if level.isEmpty():
            return found
        level = level.select("key", "path", F.posexplode(_objects(below)).alias("at", "step")).select("key", F.concat("path", F.array("at")).alias("path"), "step")


def targets(called: DataFrame) -> DataFrame:
    """From actions() rows (rule_id, entity_id, area_id, device_id, state), as conflicts.expand() reads them."""
    none = F.lit(None).cast("string")
    one = lambda column, name: called.select(F.col("key").alias("rule_id"), F.explode(column).alias("x"), F.col("target_state").alias("state")).select("rule_id", *[(F.col("x") if k == name else none).alias(k) for k in ("entity_id", "area_id", "device_id")], "state")
    return one("entity_ids", "entity_id").unionByName(one("area_ids", "area_id")).unionByName(one("device_ids", "device_id")).distinct()


def started(called: DataFrame) -> DataFrame:
    """The scripts and automations that automations start: (key, entity_id)."""
    by = F.when(F.col("service").isin("automation.trigger", "script.turn_on"), F.col("entity_ids")).when(F.col("service").startswith("script."), F.array("service"))
    return called.select("key", F.explode(by).alias("entity_id")).distinct()


def attach(told: DataFrame, live: DataFrame) -> DataFrame:
    """normalise() rows with entity_id and enabled, from live automations (entity_id, unique_id, name, state) of the same id.

    Live automations that no file has become rows of their own, with source states-only. Of several live ones of one id the first by entity_id counts.
    """
    on = F.lower(F.coalesce("state", F.lit("on"))) != "off"
    first = live.filter("unique_id is not null").groupBy(F.col("unique_id").alias("id")).agg(F.min(F.struct("entity_id", on.alias("enabled"))).alias("l"))
    met = told.join(first, "id", "left").select(*told.columns, F.col("l.entity_id").alias("entity_id"), F.coalesce("l.enabled", F.lit(True)).alias("enabled"))
    rest = live.join(met.filter("entity_id is not null").select("entity_id"), "entity_id", "left_anti")
    none = F.array().cast(_NONE)
    lists = [none.alias(c) for c in ("trigger_entities", "trigger_times", "trigger_kinds", "condition_entities")]
    alone = rest.select(F.col("entity_id").alias("key"), F.coalesce("unique_id", F.lit("")).alias("id"), F.coalesce("name", "entity_id").alias("alias"), F.lit("single").alias("mode"), *lists, F.lit("states-only").alias("source"), "entity_id", on.alias("enabled"))
    return met.unionByName(alone)
