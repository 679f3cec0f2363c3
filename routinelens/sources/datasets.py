"""Public smart-home text formats as state changes (n, us, entity_id, state, old_state, cause)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.model import SECOND, micros

#: The letters of a sensor id, its domain, and whether its changes are a person's doing.
PREFIXES = (("AD", "sensor", False), ("M", "binary_sensor", False), ("MA", "binary_sensor", False), ("D", "binary_sensor", True), ("L", "light", True), ("LS", "sensor", False), ("T", "sensor", False), ("I", "binary_sensor", True), ("P", "sensor", False), ("E", "switch", True))
#: Texts that mean on and off.
ON, OFF = ("on", "open", "present", "1"), ("off", "close", "closed", "absent", "0")


def lines(spark, path: str) -> DataFrame:
    """Rows (file, n, line) in file order."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line"))


def _moment(text: Column) -> Column:
    return micros(text.try_cast("timestamp_ntz"))


def _choose(key: Column, values: dict, default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def casas(rows: DataFrame) -> DataFrame:
    """``date time sensor value [activity begin|end]``; lines that do not parse are left out. Keeps activity and marker."""
    words = F.filter(F.split(F.col("line"), r"\s+"), lambda w: w != "")
    part = lambda k: F.get("w", F.lit(k))
    letters = F.upper(F.regexp_extract(part(2), r"^[A-Za-z]+", 0))
    prefix = F.when(letters == "", "M").otherwise(letters)
    value = F.lower(part(3))
    state = F.when(value.isin(*ON), "on").when(value.isin(*OFF), "off").otherwise(value)
    label = F.slice("w", 5, F.size("w"))
    read = rows.select("n", words.alias("w")).filter(F.size("w") >= 4).select(
        "n", _moment(F.concat_ws(" ", part(0), part(1))).alias("us"),
        F.concat(_choose(prefix, {p: d for p, d, _ in PREFIXES}, F.lit("binary_sensor")), F.lit("."), F.lower(part(2))).alias("entity_id"), state.alias("state"),
        F.when(_choose(prefix, {p: h for p, _, h in PREFIXES}, F.lit(False)), "human").otherwise("device").alias("cause"),
        F.get(label, F.lit(0)).alias("activity"), F.when(F.size(label) > 1, F.lower(F.element_at(label, -1))).alias("marker"),
    ).filter("us is not null")
    return read.withColumn("old_state", F.lag("state").over(W.partitionBy("entity_id").orderBy("n")))


def activities(parsed: DataFrame) -> DataFrame:
    """(activity, start_us, end_us): an end closes the activity's latest begin that is still open."""
    by = W.partitionBy("activity").orderBy("n")
    marks = parsed.filter(F.col("marker").isin("begin", "end")).withColumn("before", F.lag(F.struct("marker", "us")).over(by))
    return marks.filter((F.col("marker") == "end") & (F.col("before.marker") == "begin")).select("activity", F.col("before.us").alias("start_us"), F.col("us").alias("end_us"))


def aras(rows: DataFrame, start_us: int, step_us: int = SECOND) -> DataFrame:
    """One line a second: 0/1 columns and two activity labels; a change is a column that differs from the line before.

    Files are days and run apart; line numbers count from the file's first line.
    """
    by = W.partitionBy("file").orderBy("n")
    cut = rows.withColumn("i", F.row_number().over(by) - 1).withColumn("c", F.split("line", r"\s+")).filter(F.size("c") >= 3)
    cut = cut.select("file", "n", "i", F.slice("c", F.lit(1), F.size("c") - 2).alias("c")).withColumn("p", F.lag("c").over(by)).filter("p is not null")
    moved = cut.select("i", "n", "p", F.posexplode("c").alias("k", "new")).withColumn("old", F.get("p", F.col("k"))).filter("old is not null and old <> new")
    word = lambda c: F.when(F.col(c) == "1", "on").otherwise("off")
    return moved.select("n", (F.lit(start_us) + F.col("i") * step_us).alias("us"), F.format_string("binary_sensor.sensor_%02d", "k").alias("entity_id"), word("new").alias("state"), word("old").alias("old_state"), F.lit("human").alias("cause"))


def kasteren(rows: DataFrame) -> DataFrame:
    """``start end sensor value`` intervals as an on and an off change: columns by tabs, else by single words."""
    tabs = F.filter(F.split("line", "\t"), lambda c: F.trim(c) != "")
    words = F.filter(F.split("line", " "), lambda c: F.trim(c) != "")
    good = rows.withColumn("p", F.when(F.size(tabs) > 2, tabs).otherwise(words)).filter(F.size("p") > 2)  # a heading has no times and goes below
    entity = F.concat(F.lit("binary_sensor."), F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col("p")[2])), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    spans = good.select("n", entity.alias("entity_id"), _moment(F.trim(F.col("p")[0])).alias("a"), _moment(F.trim(F.col("p")[1])).alias("b")).filter("a is not null and b is not null")
    two = F.array(F.struct(F.col("a").alias("us"), F.lit("on").alias("state"), F.lit("off").alias("old_state")), F.struct(F.col("b").alias("us"), F.lit("off").alias("state"), F.lit("on").alias("old_state")))
    return spans.select("n", "entity_id", F.explode(two).alias("c")).select("n", "c.us", "entity_id", "c.state", "c.old_state", F.lit("human").alias("cause"))


def aras_activities(rows: DataFrame, start_us: int, step_us: int = SECOND) -> DataFrame:
    """(resident, activity, start_us, end_us): runs of equal labels in the last two columns of each file."""
    by = W.partitionBy("file").orderBy("n")
    cut = rows.withColumn("i", F.row_number().over(by) - 1).withColumn("c", F.split("line", r"\s+")).filter(F.size("c") >= 3)
    told = cut.select("file", "i", F.posexplode(F.slice("c", -2, 2)).alias("resident", "activity"))
    own = W.partitionBy("file", "resident").orderBy("i")
    marked = told.withColumn("new", (~F.col("activity").eqNullSafe(F.lag("activity").over(own))).cast("int")).withColumn("run", F.sum("new").over(own))
    runs = marked.groupBy("file", "resident", "run", "activity").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    return runs.select("resident", "activity", (F.lit(start_us) + F.col("a") * step_us).alias("start_us"), (F.lit(start_us) + (F.col("b") + 1) * step_us).alias("end_us"))


def load(spark, path: str, kind: str, start_us: int = 0) -> DataFrame:
    """A data set by the name of its format: casas, aras (lines from ``start_us`` on) or kasteren."""
    rows = lines(spark, path)
    readers = {"casas": casas, "aras": lambda r: aras(r, start_us), "kasteren": kasteren}
    if kind not in readers:
        raise ValueError(f"no data set format {kind}")
    return readers[kind](rows)


def stats(parsed: DataFrame) -> DataFrame:
    """One row: changes, entities, human changes and the time window."""
    return parsed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities"), F.count_if(F.col("cause") == "human").alias("human"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
