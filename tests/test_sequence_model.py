"""The recurrent sequence model: gradients, data-parallel steps against one process, and the rules of a planted habit."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routinelens.learn import sequence
from routinelens.model import DAY, MINUTE, SECOND

SLOT = "struct<item:int,time:int,entity_id:string,state:string>"


def random_examples(n, words, seed=1):
    rng = np.random.default_rng(seed)
    return rng.integers(0, words + 2, (n, 6)), rng.integers(0, 10, (n, 6)), rng.integers(0, words, n)


def test_gradient_is_the_slope_of_the_loss():
    items, times, labels = random_examples(7, 5)
    flat = sequence.initial(5)
    loss, slope = sequence.gradient(flat, 5, items, times, labels)
    rng = np.random.default_rng(2)
    for k in rng.choice(len(flat), 60, replace=False):
        step = np.zeros(len(flat))
        step[k] = 1e-5
        there, back = (sequence.gradient(flat + s, 5, items, times, labels)[0] for s in (step, -step))
        assert abs((there - back) / 2e-5 - slope[k]) < 1e-5 * max(1, abs(slope[k]))
    assert abs(loss - 7 * np.log(5)) < 7


@pytest.mark.parametrize("partitions, fan", [(1, 32), (7, 32), (9, 2)])
def test_steps_over_partitions_equal_one_process(spark, monkeypatch, partitions, fan):
    monkeypatch.setattr(sequence, "FAN", fan)
    items, times, labels = random_examples(90, 4)
    rows = [(int(v), [(int(i), int(t), "e", "s") for i, t in zip(a, b)]) for a, b, v in zip(items, times, labels)]
    df = spark.createDataFrame(rows, f"label int, context array<{SLOT}>").repartition(partitions)
    model = sequence.fit(df, list("abcd"), steps=6)
    params, speed, want = sequence.initial(4), 0.0, []
    ridge = sequence.pack({n: np.full(s, sequence.RIDGE if n[0] in "WU" else 0.0) for n, s in sequence.shapes(4).items()}, 4)
    for _ in range(6):
        loss, slope = sequence.gradient(params, 4, items, times, labels)
        want.append(loss / 90)
        speed = sequence.MOMENTUM * speed - sequence.RATE * (slope / 90 + ridge * params)
        params = params + speed
    assert np.allclose(model.losses, want, atol=1e-9) and np.allclose(model.params, params, atol=1e-8) and model.losses[-1] < model.losses[0]
    p = sequence.probabilities(df, model)
    log, _ = sequence.forward(model.parts(), items, times)
    assert sorted(round(r["p"], 9) for r in p.collect()) == sorted(np.round(np.exp(log[np.arange(90), labels]), 9).tolist())


def history(spark):
    """Each evening the door opens and then someone turns the lamp on; other things come and go."""
    rng, rows, states = random.Random(3), [], {}

    def say(us, entity, state, cause):
        rows.append((len(rows), us, cause, entity, entity.split(".")[0], state, states.get(entity)))
        states[entity] = state

    for d in range(60):
        t = d * DAY + 18 * 60 * MINUTE
        for k in range(rng.randint(1, 3)):
            e = rng.choice(["switch.fan", "light.hall", "media_player.tv"])
            say(t - (30 - 8 * k) * MINUTE, e, rng.choice(["on", "off"]), rng.choice(["human", "device"]))
        say(t, "binary_sensor.door", "on", "device")
        say(t + 30 * SECOND, "light.lamp", "on", "human")
        say(t + 40 * MINUTE, "binary_sensor.door", "off", "device")
        say(t + 200 * MINUTE, "light.lamp", "off", "automation")
    return spark.createDataFrame(rows, "sid long, us long, cause string, entity_id string, domain string, state string, old_state string")


def test_a_planted_rule_comes_out(spark):
    rows = history(spark)
    services = rows.filter("domain <> 'binary_sensor'").select(F.concat_ws("=", "entity_id", "state").alias("item"), F.lit("turn").alias("service")).distinct()
    found = sequence.mine(rows, services, steps=60).collect()
    heads = {(r["trigger"]["entity_id"], r["trigger"]["state"], r["entity_id"], r["state"]) for r in found}
    assert ("binary_sensor.door", "on", "light.lamp", "on") in heads
    for r in found:
        assert r["trigger"]["entity_id"] != r["entity_id"] and r["occurrences"] >= 5 and r["confidence"] >= 0.75 and r["model_confidence"] >= 0.6
    words = sequence.vocabulary(sequence.events(rows))
    told = sequence.examples(sequence.events(rows), words, services)
    model = sequence.fit(told, words, 60)
    assert model.losses[-1] < 0.6 * model.losses[0]
    assert sequence.fit(told.limit(10), words) is None


def test_supersets_of_kept_rules_go(spark):
    t = ("door", "on")
    c1, c2 = ("a", "on"), ("b", "on")
    rows = [(t, [], "lamp", "on", 0.9)] * 8 + [(t, [], "fan", "on", 0.9)] * 2  # 0.8
    rows += [(t, [c1], "lamp", "on", 0.9)] * 9 + [(t, [c1], "fan", "on", 0.9)] * 2  # 0.818: hardly more
    rows += [(t, [c2], "lamp", "on", 0.9)] * 9 + [(t, [c2], "fan", "on", 0.9)]  # 0.9: more
    rows += [(t, [c1, c2], "lamp", "on", 0.9)] * 10 + [(t, [c1, c2], "fan", "on", 0.9)]  # 0.909: hardly more than with c2
    rows += [(("x", "on"), [c1, c2], "lamp", "on", 0.9)] * 6 + [(("y", "on"), [], "lamp", "on", 0.1)] * 9 + [(("z", "on"), [], "lamp", "on", 0.9)] * 4
    pair = "struct<entity_id:string,state:string>"
    df = spark.createDataFrame(rows, f"trigger {pair}, conditions array<{pair}>, entity_id string, state string, p double")
    got = sorted((r["trigger"]["entity_id"], len(r["conditions"]), r["occurrences"], r["opportunities"]) for r in sequence.rules(df).collect())
    assert got == [("door", 0, 8, 10), ("door", 1, 9, 10), ("x", 2, 6, 6)]


def test_contexts_become_triggers_and_conditions(spark):
    slot = lambda n, e: (n, 1, e, "on")
    rows = [("t", [slot(0, ""), slot(5, "a"), slot(1, "z"), slot(4, "b"), slot(5, "a"), slot(3, "g")]), ("t", [slot(0, "")] * 5 + [slot(1, "g")]), ("t", [slot(0, "")] * 5 + [slot(4, "t")]), ("t", [slot(6, "c"), slot(4, "t"), slot(5, "a"), slot(3, "g"), slot(4, "b"), slot(3, "g")])]
    df = spark.createDataFrame(rows, f"entity_id string, context array<{SLOT}>")
    got = sorted((r["trigger"]["entity_id"], tuple(c["entity_id"] for c in r["conditions"])) for r in sequence.signatures(df).collect())
    assert got == [("g", ("a", "b")), ("g", ("a", "b"))]


def test_batches_are_read_in_slices_without_python_lists(monkeypatch):
    monkeypatch.setattr(sequence, "SLICE", 16)
    items, times, labels = random_examples(60, 5, seed=4)
    batch = pa.RecordBatch.from_arrays([pa.array(items.tolist(), pa.list_(pa.int32())), pa.array(times.tolist(), pa.list_(pa.int32())), pa.array(labels, pa.int64())], ["items", "times", "label"]).slice(5, 50)
    parts = list(sequence._arrays(batch))
    assert [len(p[2]) for p in parts] == [16, 16, 16, 2]
    for k, want in enumerate((items, times, labels)):
        assert (np.concatenate([p[k] for p in parts]) == want[5:55]).all()
    flat = sequence.initial(5)
    whole, each = sequence.gradient(flat, 5, items[5:55], times[5:55], labels[5:55]), [sequence.gradient(flat, 5, *p) for p in parts]
    assert abs(whole[0] - sum(e[0] for e in each)) < 1e-9 and np.allclose(whole[1], sum(e[1] for e in each), atol=1e-9)
