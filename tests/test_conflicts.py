"""Conflict checks, scenes, number checks and unused entities on planted cases."""

import random

import pytest
from pyspark.sql import functions as F

from routinelens.functions import circular
from routinelens.operators import conflicts, health, sequences
from routinelens.plans import rules, validators

RULE = "rule_id string, enabled boolean, trigger_entity string, trigger_minute int, target_entity string, target_state string"


def row(name, trigger, target, state="on", enabled=True, minute=None):
    return (name, enabled, trigger, minute, target, state)


def test_loops_of_one_to_four_rules(spark):
    ring = lambda names, **off: [row(n, f"e.{n}", f"e.{m}", enabled=off.get(n, True)) for n, m in zip(names, [*names[1:], names[0]])]
    made = ring("a") + ring("bc") + ring("def") + ring("ghij") + ring("klmno") + ring("pqr", q=False)
    made += [row("g2", "e.g", "e.h")]  # as short a way by another rule; the first by name is told
    got = {r["rule_id"]: r["way"] for r in conflicts.loops(spark.createDataFrame(made, RULE)).collect()}
    assert got == {
        "a": "a>a", "b": "b>c>b", "c": "c>b>c", "d": "d>e>f>d", "e": "e>f>d>e", "f": "f>d>e>f", "g": "g>h>i>j>g", "g2": "g2>h>i>j>g2", "h": "h>i>j>g>h", "i": "i>j>g>h>i", "j": "j>g>h>i>j",
    }


def test_loops_of_random_rules_equal_a_search(spark):
    rng = random.Random(6)
    made = [row(f"r{k}", f"e{rng.randrange(14)}", f"e{rng.randrange(14)}", enabled=rng.random() < 0.9) for k in range(40)]
    live = [(r[0], r[2], r[4]) for r in made if r[1]]
    after = {n: sorted(m for m, trigger, _ in live if trigger == target) for n, _, target in live}
    want = {}
    for start in after:
        ways = [[start]]
        for _ in range(4):
            ways = [[*w, m] for w in ways for m in after[w[-1]] if m == start or m not in w]
            if closed := [w for w in ways if w[-1] == start]:
                want[start] = ">".join(min(closed))
                break
            ways = [w for w in ways if w[-1] != start]
    assert {r["rule_id"]: r["way"] for r in conflicts.loops(spark.createDataFrame(made, RULE)).collect()} == want


def test_opposite_states_need_no_shared_trigger(spark):
    made = [
        row("arrive", "person.p", "light.x"), row("evening", None, "light.x", "off", minute=1200), row("night", None, "light.x", minute=100), row("late", None, "light.x", "off", minute=1190),
        row("gone", "person.q", "light.x", "off", enabled=False), row("other", "person.q", "light.y", "off"), row("both", "person.q", "light.x", minute=100),
    ]
    pairs = {(r["rule_a"], r["rule_b"]) for r in conflicts.inconsistent(spark.createDataFrame(made, RULE)).collect()}
    assert pairs == {("arrive", "evening"), ("arrive", "late")}  # clocks apart rule the others out
    same = {(r["rule_a"], r["rule_b"]) for r in conflicts.redundant(spark.createDataFrame(made, RULE)).collect()}
    assert same == {("evening", "late"), ("both", "night")}  # near-duplicates need evidence


def test_check_tells_unresolved_targets(spark):
    made = spark.createDataFrame([row("a", "e.1", "light.x"), row("off", "e.1", "light.y", enabled=False)], RULE)
    targets = spark.createDataFrame([("a", None, "hall", None, "on"), ("off", None, "hall", None, "on"), ("new", None, None, "d9", "on"), ("known", None, "kitchen", None, "on")], "rule_id string, entity_id string, area_id string, device_id string, state string")
    held = spark.createDataFrame([("light.k", "kitchen", "d1")], "entity_id string, area_id string, device_id string")
    found = conflicts.check(made, held.select("entity_id", "device_id"), expanded=conflicts.expand(targets, held)).collect()
    assert [(r["kind"], r["rule_a"], r["severity"]) for r in found] == [("unresolved", "a", 2), ("unresolved", "new", 2)]


def test_tight_groups_go_round_midnight(spark):
    minutes = [1199, 1201, 1438, 2, 700, 715, 730, 710]
    got = {}
    for r in circular.tight_groups(spark.createDataFrame([(m,) for m in minutes + [700]], "minute int"), 20).collect():
        got.setdefault(r["anchor"], set()).add(r["minute"])
    assert got == {1199.0: {1199.0, 1201.0}, 1438.0: {1438.0, 2.0}, 700.0: {700.0, 710.0, 715.0}, 710.0: {710.0, 715.0, 730.0}}
    rng = random.Random(4)
    some = sorted({rng.randrange(1440) for _ in range(60)})
    members = {s: frozenset(m for m in some if (m - s) % 1440 <= 25) for s in some}
    want = {s: m for s, m in members.items() if not any(m < o or (m == o and t != s and (s - t) % 1440 <= 25) for t, o in members.items())}
    got = {}
    for r in circular.tight_groups(spark.createDataFrame([(m,) for m in some], "minute int"), 25).collect():
        got.setdefault(int(r["anchor"]), set()).add(int(r["minute"]))
    assert {s: frozenset(m) for s, m in got.items()} == want
    assert circular.tight_groups(spark.createDataFrame([], "minute int"), 20).count() == 0


def test_scenes_share_one_anchor(spark):
    schema = "rule_id string, kind string, trigger string, minute int, target_entity string, target_state string"
    made = [("a", "time", None, 1199, "light.a", "on"), ("b", "time", None, 1201, "light.b", "on"), ("c", "time", None, 1438, "light.a", "off"), ("d", "time", None, 2, "light.b", "off"), ("e", "numeric", "s.t", None, "light.a", "on"), ("f", "numeric", "s.t", None, "light.b", "on"), ("g", "time", None, 600, "light.a", "on"), ("h", "time", None, 601, "light.a", "off")]
    assert sorted(map(tuple, validators.scenes(spark.createDataFrame(made, schema)).collect())) == [("time:19:59:00", 2, 2), ("time:23:58:00", 2, 2)]


def test_invented_numbers():
    known = {"occurrences": 30, "opportunities": 34, "window_days": 45, "share": 0.88, "total": 1234}
    assert rules.invented_numbers("30 of 34 times, 88% in 45 days, 1,234 rows, 30 out of the 34", known) == []
    assert rules.invented_numbers("30 of 45 days", known) == ["30", "45"]
    assert rules.invented_numbers("only 1 time, twice a day or thirty times", known) == ["1", "thirty", "twice"]
    assert rules.invented_numbers("12,345 rows", known) == ["12345"]


def test_items_may_hold_the_sign_that_joins_patterns(spark):
    odd = ["sensor.a=x>y", "light.b=on", "light.c=>"]
    rows = spark.createDataFrame([(k, odd if k < 4 else odd[:2]) for k in range(6)], "seq_id long, items array<string>")
    found = sequences.patterns(rows, 3)
    kept = sorted((tuple(r["items"]), r["support"]) for r in sequences.prune(found).collect())
    assert kept == [(tuple(odd[:2]), 6), (tuple(odd), 4)]  # the others are no more frequent than the whole
    human = spark.createDataFrame([(odd[1], 9), (odd[2], 9)], "item string, n long")
    services = spark.createDataFrame([(odd[1], "light.turn_on"), (odd[2], "light.odd")], "item string, service string")
    made = sequences.candidates(sequences.prune(found), rows, human, ["light"], services).collect()
    assert [(r["trigger"], r["steps"], r["support"], r["opportunities"]) for r in made] == [(odd[0], odd[1:], 4, 6)]


@pytest.mark.parametrize("window", [None, "day"])
def test_unused_entities_of_a_registry(spark, window):
    entities = spark.createDataFrame([("light.a", "light", False, False, None), ("light.b", "light", None, None, None), ("light.c", "light", True, False, None), ("light.d", "light", False, True, None), ("switch.e", "switch", False, False, "config"), ("scene.f", "scene", False, False, None), ("sensor.g", "sensor", False, False, None), ("switch.h", "switch", False, False, None)], "entity_id string, domain string, hidden boolean, disabled boolean, category string")
    changes = spark.createDataFrame([("light.a", "human", 1), ("light.a", "device", 2), ("light.b", "automation", 1), ("light.b", "unknown", 1), ("light.c", "device", 1)], "entity_id string, cause string, day int")
    got = sorted(map(tuple, health.unused(changes, entities, window).collect()))
    if window:
        assert got == [("light.a", 2, 1), ("light.b", 1, 2), ("light.b", 2, 0), ("switch.h", 1, 0), ("switch.h", 2, 0)]
    else:
        assert got == [("light.b", 2), ("switch.h", 0)]
    assert health.unused(changes.withColumn("cause", F.lit("human")), entities.limit(1), window).count() == 0
