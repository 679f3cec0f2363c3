"""Entity dimension, signal roles and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The service of a (domain, state), then of a state in any domain.
SERVICES = (("light", "on", "light.turn_on"), ("light", "off", "light.turn_off"), ("switch", "on", "switch.turn_on"), ("switch", "off", "switch.turn_off"), ("media_player", "playing", "media_player.media_play"), ("media_player", "off", "media_player.turn_off"), ("cover", "open", "cover.open_cover"), ("cover", "closed", "cover.close_cover"), ("lock", "locked", "lock.lock"), ("lock", "unlocked", "lock.unlock"))
GENERIC = (("on", "turn_on"), ("off", "turn_off"))
#: Words that name a signal's role; they begin where no letter or digit precedes.
PRICE = ("tibber.*price", "electricity_price", "electricity_market_price", "nordpool", "energi_data_service", "awattar", "epex", "entsoe", "current_electricity", "spot_price", "energy_price")
PRICE_LEVEL = ("price_level", "electricity_price_level", "tibber.*level")
SOLAR_FORECAST = ("solcast", "forecast_solar", "energy_production_today", "energy_next_hour", "pv_forecast", "estimated_energy")
SOLAR_PRODUCTION = ("pv_power", "solar_power", "inverter", "solaredge", "fronius", "huawei_solar", "sma_")
CARBON = ("carbon_intensity", "co2_intensity", "co2_signal", "electricity_maps")
WARNING = ("dwd_weather_warnings", "weather_warning", "warning_level", "meteoalarm")
HOLIDAY = ("holiday", "schulferien", "feiertag")
ROOM_PRESENCE = ("espresense", "bermuda", "room_presence", "ble_?tracker", "_area$")
DEFERRABLE = ("dishwasher", "washing_machine", "washer", "dryer", "tumble", "geschirrsp", "waschmaschine", "water_heater", "boiler", "heat_pump", "pool_pump")
CHARGER = ("wallbox", "charger", "easee", "go_?e", "keba", "openevse", "zaptec", "ev_?charg")
RADAR = ("fp2", "fp1", "mmwave", "presence.?sensor", "everything.?presence", "ld2410", "ld2450")
OUTDOOR = ("outdoor", "outside", "external", "garden", "aussen", "balcony")


def service_for(rows: DataFrame) -> DataFrame:
    """``rows`` (domain, state) with service: the table's, else a climate mode, select option, scene or script, else on and off."""
    table = rows.sparkSession.createDataFrame(list(SERVICES), "domain string, state string, known string")
    joined = rows.join(F.broadcast(table), ["domain", "state"], "left")  # a fixed table of a few rows
    other = F.when(F.col("domain") == "climate", "climate.set_hvac_mode").when(F.col("domain").isin("select", "input_select"), F.concat("domain", F.lit(".select_option"))).when(F.col("domain").isin("scene", "script"), F.concat("domain", F.lit(".turn_on")))
    for state, verb in GENERIC:
        other = F.coalesce(other, F.when(F.col("state") == state, F.lit(f"homeassistant.{verb}")))
    return joined.withColumn("service", F.coalesce("known", other)).drop("known")


def _named(words: tuple[str, ...]) -> Column:
    """Whether the row's text has one of the words, which may start only where no letter or digit precedes."""
    return F.col("text").rlike("|".join(f"(?<![a-z0-9]){w}" if w[0].isalnum() else w for w in words))


def roles(entities: DataFrame) -> DataFrame:
    """Rows (role, entity_id), each once, of entities (entity_id, domain and, where known, device_class, platform, name, model, temperature).

    The text searched is id, name and model, not the platform. Where a kind of entity has alternatives, the first that fits counts. A weather
    entity's temperature attribute is an outdoor temperature only if no sensor is one.
    """
    have = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in entities.columns else F.lit("")
    text = F.lower(F.concat_ws(" ", "entity_id", have("name"), have("model")))
    rows = entities.select("entity_id", "domain", have("device_class").alias("device_class"), have("platform").alias("platform"), text.alias("text"), (have("temperature") != "").alias("warm"))
    d, device, platform = F.col("domain"), F.col("device_class"), F.col("platform")
    sensor, binary = d == "sensor", d == "binary_sensor"
    outdoor = _named(OUTDOOR) & ((device == "temperature") | _named(("temp",)))
    lux = (device == "illuminance") | _named(("lux",))
    occupied = binary & ((device == "occupancy") | _named(("occupancy", "presence")))
    workday = _named(("workday",)) | (platform == "workday")
    plain = {x: d == x for x in ("sun", "weather", "calendar", "person", "device_tracker")} | {"thermostat": d == "climate"}
    told = {
        **plain,
        "room_presence": (d.isin("device_tracker", "sensor") & _named(ROOM_PRESENCE)) | (occupied & _named(RADAR)),
        "occupancy": occupied,
        "motion": binary & ((device == "motion") | _named(("motion",))),
        "workday": binary & workday,
        "holiday": binary & ~workday & _named(HOLIDAY),
        "outdoor_temperature": sensor & outdoor,
        "illuminance": sensor & ~outdoor & lux,
        "power": sensor & ~outdoor & ~lux & (device == "power"),
        "energy": sensor & ~outdoor & ~lux & (device == "energy"),
        "price_level": sensor & _named(PRICE_LEVEL),
        "energy_price": sensor & ~_named(PRICE_LEVEL) & _named(PRICE),
        "solar_forecast": sensor & _named(SOLAR_FORECAST),
        "solar_production": sensor & ~_named(SOLAR_FORECAST) & _named(SOLAR_PRODUCTION),
        "carbon_intensity": sensor & _named(CARBON),
        "weather_warning": sensor & (_named(WARNING) | (platform == "dwd_weather_warnings")),
        "deferrable_loads": d.isin("switch", "sensor", "binary_sensor", "vacuum", "water_heater") & _named(DEFERRABLE),
        "ev_charger": d.isin("switch", "sensor", "binary_sensor", "vacuum", "water_heater") & _named(CHARGER),
    }
    found = rows.select(F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(role)) for role, hit in told.items()]))).alias("role"), "entity_id").distinct()
    fallback = rows.filter((d == "weather") & F.col("warm")).select(F.lit("outdoor_temperature").alias("role"), F.concat("entity_id", F.lit("#temperature")).alias("entity_id"))
    least = fallback.groupBy("role").agg(F.min("entity_id").alias("entity_id"))
    return found.unionByName(least.join(found.select("role").distinct(), "role", "left_anti"))


def registry(entities: DataFrame, devices: DataFrame, areas: DataFrame) -> DataFrame:
    """Entities with area (own, else the device's), labels of both, and name by user, device name or original name."""
    d = devices.select("device_id", F.col("area_id").alias("device_area"), F.col("labels").alias("device_labels"))
    a = areas.select("area_id", F.col("name").alias("area_name"))
    empty = F.array().cast("array<string>")
    rows = entities.join(d, "device_id", "left").withColumn("area_id", F.coalesce("area_id", "device_area")).join(a, "area_id", "left")
    return rows.select("entity_id", "area_id", "area_name", F.array_sort(F.array_union(F.coalesce("labels", empty), F.coalesce("device_labels", empty))).alias("labels"), F.coalesce("name_by_user", "name", "original_name").alias("name"), "unit")


def merge_states(known: DataFrame, states: DataFrame) -> DataFrame:
    """Live states make rows that the registry lacks and win for name and unit; a registry area is never overwritten."""
    s = states.select("entity_id", F.col("friendly_name").alias("live_name"), F.col("unit").alias("live_unit"))
    both = known.withColumn("registered", F.lit(True)).join(s.withColumn("live", F.lit(True)), "entity_id", "full_outer")
    source = F.when(F.col("registered") & F.col("live"), "both").when(F.col("registered"), "registry").otherwise("states")
    return both.select("entity_id", "area_id", "area_name", "labels", F.coalesce("live_name", "name").alias("name"), F.coalesce("live_unit", "unit").alias("unit"), source.alias("source"))


def seed(known: DataFrame, recorded: DataFrame) -> DataFrame:
    """``known`` and a bare row, of source recorder, for each id (entity_id) of the history that it lacks."""
    more = recorded.select("entity_id").distinct().join(known.select("entity_id"), "entity_id", "left_anti")
    return known.unionByName(more.withColumn("source", F.lit("recorder")), allowMissingColumns=True)


def best_source(storage: DataFrame | None, live: DataFrame | None, states: DataFrame | None) -> DataFrame | None:
    """The first source that there is and that has rows: stored registries, live registry lists, states alone."""
    for source in (storage, live, states):
        if source is not None and not source.isEmpty():
            return source
    return None


def search(known: DataFrame, text: str = "", domain: str | None = None, area_id: str | None = None) -> DataFrame:
    """Entities by domain, area and a part of id, name or area name, whatever its case."""
    rows = known if domain is None else known.filter(F.split_part("entity_id", F.lit("."), F.lit(1)) == domain)
    rows = rows if area_id is None else rows.filter(F.col("area_id") == area_id)
    return rows.filter(F.lower(F.concat_ws(" ", "entity_id", "name", "area_name")).contains(text.lower()))


def stats(known: DataFrame) -> DataFrame:
    """One row: entities by source, and how many have an area."""
    by = [F.count_if(F.col("source") == s).alias(s) for s in ("registry", "states", "both", "recorder")]
    return known.agg(F.count(F.lit(1)).alias("entities"), *by, F.count("area_id").alias("with_area"))


def display_name(entity_id: Column, name: Column) -> Column:
    """The name, else the id's last part with its words in title case."""
    return F.coalesce(name, F.initcap(F.replace(F.element_at(F.split(entity_id, "[.]"), -1), F.lit("_"), F.lit(" "))))
