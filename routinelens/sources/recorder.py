"""History scans: normalised or flat recorder tables, whatever their context columns, as one state-change schema."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer attribute texts are not parsed.
MAX_ATTRIBUTES = 16 * 1024


def window(rows: DataFrame, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Half-open [start, end); an open end is the newest row, which a run therefore leaves out."""
    if start_us is not None:
        rows = rows.filter(F.col("us") >= start_us)
    if end_us is None:
        end_us = rows.agg(F.max("us")).first()[0]
    return rows if end_us is None else rows.filter(F.col("us") < end_us)


def included(domains: list[str], patterns: list[str]) -> Column:
    """Not an excluded domain, not an id or glob of ``patterns``, and with a dot."""
    keep = F.instr("entity_id", ".") > 0
    if domains:
        keep = keep & ~F.split_part("entity_id", F.lit("."), F.lit(1)).isin(*domains)
    for p in patterns:
        keep = keep & ~F.col("entity_id").rlike(fnmatch.translate(p).replace("(?s:", "(?s)(?:", 1))
    return keep


def _context(states: DataFrame, kind: str) -> Column:
    """A context id: lower-case hex of the binary column, else the text column, else null; empty is null."""
    if f"context_{kind}_bin" in states.columns:
        return F.lower(F.hex(F.nullif(F.col(f"context_{kind}_bin"), F.lit(b""))))
    if f"context_{kind}" in states.columns:
        return F.nullif(F.col(f"context_{kind}"), F.lit(""))
    return F.lit(None).cast("string")


def attributes(text: Column) -> Column:
    """Attribute JSON as a map; text that is too long, invalid or not an object gives an empty map."""
    parsed = F.from_json(F.when(F.length(text) <= MAX_ATTRIBUTES, text), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def state_changes(states: DataFrame, meta: DataFrame | None = None, attrs: DataFrame | None = None) -> DataFrame:
    """Recorder states with entity ids, the previous state by ``old_state_id``, contexts and attributes.

    A row without state is dropped. The previous state is looked up by id, not by order, so that the first row of a
    window still has one. ``meta`` is small (a row an entity) and left to the planner to broadcast by size.
    """
    rows = states if meta is None else states.join(meta.select("metadata_id", "entity_id"), "metadata_id")
    old = states.select(F.col("state_id").alias("old_state_id"), F.col("state").alias("old_state"))
    rows = rows.join(old, "old_state_id", "left")
    if attrs is not None and "attributes_id" in rows.columns:
        rows = rows.join(attrs.select("attributes_id", "shared_attrs"), "attributes_id", "left")
    text = F.col("shared_attrs") if "shared_attrs" in rows.columns else F.lit(None).cast("string")
    us = F.round(F.col("last_updated_ts") * 1_000_000).cast("long")
    return rows.filter("state is not null").select(
        F.col("state_id").alias("sid"), us.alias("us"), "entity_id", F.split_part("entity_id", F.lit("."), F.lit(1)).alias("domain"), "state", "old_state",
        attributes(text).alias("attributes"), _context(rows, "id").alias("context"), _context(rows, "parent_id").alias("parent"), _context(rows, "user_id").alias("user"),
    )


def events(rows: DataFrame, types: DataFrame | None, data: DataFrame | None, wanted: tuple[str, ...] = ("automation_triggered", "script_started")) -> DataFrame:
    """Events of the wanted types, with the first entity that their data names, as origins for the causal index."""
    named = rows if types is None else rows.join(types, "event_type_id")
    named = named.filter(F.col("event_type").isin(*wanted))
    if data is not None:
        named = named.join(data.select("data_id", "shared_data"), "data_id", "left")
    text = F.col("shared_data")
    entity = F.coalesce(F.get_json_object(text, "$.entity_id[0]"), F.get_json_object(text, "$.entity_id"))
    origin = F.when(F.col("event_type") == "automation_triggered", "automation").when(F.col("event_type") == "script_started", "script")
    return named.select(F.col("event_id").alias("sid"), F.round(F.col("time_fired_ts") * 1_000_000).cast("long").alias("us"), _context(named, "id").alias("context"), _context(named, "parent_id").alias("parent"), _context(named, "user_id").alias("user"), origin.alias("origin"), entity.alias("origin_entity"))


def statistics(rows: DataFrame, meta: DataFrame, ids: list[str] | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Statistics rows by id and time, half-open."""
    out = rows.join(meta.select(F.col("id").alias("metadata_id"), "statistic_id"), "metadata_id")
    if ids is not None:
        out = out.filter(F.col("statistic_id").isin(*ids))
    if start is not None:
        out = out.filter(F.col("start_ts") >= start)
    if end is not None:
        out = out.filter(F.col("start_ts") < end)
    return out.select("statistic_id", "start_ts", "mean", "min", "max", "state", "sum").orderBy("statistic_id", "start_ts")


def statistic_ids(meta: DataFrame) -> DataFrame:
    return meta.select("statistic_id").distinct()


def seconds(value: Column) -> Column:
    """Epoch seconds of a column that holds them as numbers, as text of a number, or as ISO texts."""
    return F.coalesce(value.try_cast("double"), value.cast("string").try_cast("timestamp").cast("double"))


def probe(tables: dict[str, DataFrame]) -> dict:
    """What a recorder offers: its layout, context kind, and oldest and newest time."""
    states = tables.get("states")
    columns = set(states.columns) if states is not None else set()
    bounds = states.agg(F.min(seconds(F.col("last_updated_ts"))), F.max(seconds(F.col("last_updated_ts")))).first() if "last_updated_ts" in columns else (None, None)
    return {"tables": sorted(tables), "normalised": "states_meta" in tables and "metadata_id" in columns, "context": "binary" if "context_id_bin" in columns else "text" if "context_id" in columns else None, "oldest": bounds[0], "newest": bounds[1]}
