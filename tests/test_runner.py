"""One call from the history of a planted home to stored rules."""

import pytest
from pyspark.sql import functions as F

from routinelens import runner
from routinelens.operators import replay
from routinelens.sources import generator


@pytest.fixture(scope="module")
def result(spark):
    rows = generator.planted_home(spark, days=60)
    options = runner.Options(bandwidth=30, min_occurrences=5, crossing_strength=0.2, bars=replay.Bars(min_true=3, precision=0.5))
    existing = spark.createDataFrame([("old night", True, None, 1200, "light.hallway", "off"), ("old copy", True, None, 392, "light.kitchen", "on"), ("old off", True, "binary_sensor.k", None, "switch.heater", "off")], runner.EXISTING)
    return rows, options, existing, runner.run(rows, 1, existing=existing, options=options)


def test_planted_rules_pass_and_are_stored(result):
    _, _, _, out = result
    rows = out.candidates.collect()
    rules = {(r["miner"], r["target_entity"], r["target_state"]): r for r in rows if r["miner"] != "sequence" or r["entity_id"] == "person.alex"}
    wake = rules["time_of_day", "light.kitchen", "on"]
    assert abs(wake["at_minute"] - 390) < 6 and wake["passed"] and wake["validation"] == "holdout" and [c["weekdays"] for c in wake["only"]] == [[0, 1, 2, 3, 4]]
    hall = rules["sequence", "light.hallway", "on"]
    assert (hall["entity_id"], hall["to_state"], hall["passed"]) == ("person.alex", "home", True) and hall["precision"] > 0.9
    heater = rules["motif", "switch.heater", "on"]
    assert heater["entity_id"] == "sensor.outdoor_temperature" and heater["below"] is not None and heater["above"] is None
    assert all(0 < r["probability"] < 1 for r in rows) and len({r["rule_id"] for r in rows}) == len(rows)
    kept = {r["id"] for r in out.stored.collect()}
    assert wake["rule_id"] in kept and kept == {r["rule_id"] for r in rows if r["passed"] and not r["blocked"]}


def test_conflicts_are_those_with_existing_rules(result):
    _, _, existing, out = result
    old = {r["rule_id"] for r in existing.collect()}
    rules = {r["rule_id"]: r for r in out.candidates.collect()}
    found = out.found.collect()
    assert all(len({r["rule_a"], r["rule_b"]} & old) == 1 for r in found)
    kinds = {(r["kind"], ({r["rule_a"], r["rule_b"]} & old).pop()) for r in found}
    assert ("redundant", "old copy") in kinds and ("inconsistent", "old off") in kinds and ("inconsistent", "old night") in kinds
    assert {i for i, r in rules.items() if r["blocked"]} == {({r["rule_a"], r["rule_b"]} - old).pop() for r in found if r["severity"] >= 3}


def test_a_second_run_meets_its_rules_again(result):
    rows, options, existing, out = result
    again = runner.run(rows, 2, out.stored, existing, options=options).stored.collect()
    assert {r["id"] for r in again} == {r["id"] for r in out.stored.collect()} and {(r["seen_count"], r["last_run"]) for r in again} == {(2, 2)}


def test_no_history_no_rules(result):
    rows, options, _, _ = result
    out = runner.run(rows.filter(F.lit(False)), options=options)
    assert out.candidates.count() == out.stored.count() == out.found.count() == 0
