"""Registry files: entities, devices and areas as JSON documents with their rows under ``data``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The list of each registry file that holds its active rows; lists of deleted rows are not read.
LISTS = {"entity": "entities", "device": "devices", "area": "areas"}
ENTITY = "array<struct<entity_id:string,device_id:string,area_id:string,labels:array<string>,name:string,original_name:string,platform:string,disabled_by:string,hidden_by:string,original_device_class:string,device_class:string,unit_of_measurement:string,aliases:array<string>,options:map<string,string>>>"
DEVICE = "array<struct<id:string,area_id:string,labels:array<string>,name:string,name_by_user:string,model:string>>"
AREA = "array<struct<id:string,area_id:string,name:string,floor_id:string,aliases:array<string>>>"
SHAPES = {"entity": ENTITY, "device": DEVICE, "area": AREA}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The active rows of a registry file; a file that is malformed, or has no list, has none."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json(F.get_json_object("value", f"$.data.{LISTS[kind]}"), SHAPES[kind])
    return text.select(F.explode(rows).alias("r")).select("r.*")


def entities(rows: DataFrame) -> DataFrame:
    """Entity rows as dimensions.registry() reads them, with class, platform, aliases and whether they are enabled and visible."""
    spoken = F.from_json(F.get_json_object(F.col("options")["conversation"], "$.aliases"), "array<string>")
    none = F.array().cast("array<string>")
    return rows.filter(F.col("entity_id").isNotNull()).select(
        "entity_id", "device_id", "area_id", "labels", F.lit(None).cast("string").alias("name_by_user"), "name", "original_name", F.col("unit_of_measurement").alias("unit"),
        F.coalesce("device_class", "original_device_class").alias("device_class"), "platform", F.coalesce("aliases", spoken, none).alias("aliases"),
        F.col("disabled_by").isNull().alias("enabled"), F.col("hidden_by").isNull().alias("visible"),
    )


def devices(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id").isNotNull()).select(F.col("id").alias("device_id"), "area_id", "labels", F.coalesce("name_by_user", "name").alias("name"), "model")


def areas(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("area_id", "id").alias("area_id"), "name", "floor_id", "aliases").filter("area_id is not null")
