"""Hand-made cases and plain loops for the operators whose order matters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routinelens.learn import home_mode, ranking
from routinelens.model import DAY, HOUR, MINUTE, SECOND
from routinelens import model
from routinelens.functions import circular
from routinelens.operators import activity, asof, causality, conditional, conditions, conflicts, crossings, dimensions, habits, health, replay, sequences, signals, store
from routinelens.sources import generator, recorder

CHANGE = "sid long, us long, entity_id string, domain string, state string, num double, old_state string, context long, parent long, user long, origin string, origin_entity string"


def change(sid, us, state, context=None, parent=None, user=None, origin=None):
    return (sid, us, "light.a", "light", state, None, None, context, parent, user, origin, origin and f"{origin}.x")


def test_root_causes(spark):
    rows = [
        change(1, 1, "on", 10, None, 7), change(2, 2, "off", 11, 10), change(3, 3, "on", 12, None, None, "automation"), change(4, 4, "off", 13, 12), change(5, 5, "on", 14, 99),
        change(6, 6, "on"), change(7, 7, "on", None, None, 5), change(8, 8, "on", 20, 21), change(9, 9, "on", 21, 20), change(10, 10, "on", 30), change(11, 11, "on", 12, None, 3),
    ]
    rows += [change(100 + i, 100 + i, "on", 200 + i, 199 + i if i else None, None, None if i else "script") for i in range(16)]
    got = {r["sid"]: (r["cause"], r["chain_depth"]) for r in causality.annotate(spark.createDataFrame(rows, CHANGE)).collect()}
    assert got[1] == ("human", 0) and got[2] == ("human", 1) and got[3] == ("automation", 0) and got[4] == ("automation", 1)
    assert got[5] == ("device", 2) and got[6] == ("unknown", 0) and got[7] == ("human", 0) and got[8] == ("device", 2) and got[10] == ("device", 1)
    assert got[11] == ("automation", 0)
    assert got[112] == ("script", 12) and got[113] == ("device", 13)


def loop_overrides(rows, window):
    pending, out = None, []
    for us, sid, cause, state in sorted(rows):
        if cause in ("automation", "script"):
            pending = (us, state)
        elif cause == "human" and pending:
            if us - pending[0] > window:
                pending = None
            elif state != pending[1]:
                out.append((us, pending[1], state))
                pending = None
    return out


def test_overrides_equal_the_state_machine(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for e in range(40):
        own = [(rng.randrange(60), i, rng.choice(["human", "automation", "device", "script"]), rng.choice(["on", "off"])) for i in range(25)]
        want |= {(f"e{e}", *o) for o in loop_overrides(own, 5)}
        rows += [(f"e{e}", us, sid, cause, state, "a", None) for us, sid, cause, state in own]
    df = spark.createDataFrame(rows, "entity_id string, us long, sid long, cause string, state string, cause_entity string, context string")
    assert {(r["entity_id"], r["us"], r["automation_state"], r["human_state"]) for r in causality.overrides(df, 5).collect()} == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_equals_a_loop(spark, inclusive):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), rng.randrange(300)) for i in range(150)]
    right = [(i, rng.choice("ab"), rng.randrange(300), i * 1.5) for i in range(60)]
    got = asof.asof(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "tie long, k string, t long, v double"), ["k"], "t", "tie", ["v"], width=7, inclusive=inclusive, staleness=40)
    for r in got.collect():
        before = [x for x in right if x[1] == r["k"] and (x[2] <= r["t"] if inclusive else x[2] < r["t"])]
        last = max(before, key=lambda x: (x[2], x[0]), default=None)
        assert r["v"] == (last[3] if last and r["t"] - last[2] <= 40 else None)
    assert got.count() == len(left)


def test_bursts_keep_what_is_far_from_the_last_kept(spark):
    rows = [("r", s * SECOND, "time") for s in (0, 50, 100, 150, 300)] + [("q", 0, "time"), ("q", 10 * SECOND, "state")]
    got = replay.collapse(spark.createDataFrame(rows, "rule_id string, us long, kind string")).collect()
    assert sorted((r["us"] // SECOND) for r in got if r["rule_id"] == "r") == [0, 100, 300]
    assert [r["kind"] for r in got if r["rule_id"] == "q"] == ["state"]


def test_matching_equals_a_loop(spark):
    rng = random.Random(2)
    fires, truth, want = [], [], {}
    for n in range(40):
        f = sorted(rng.sample(range(120), rng.randint(1, 9)))
        t = [(rng.randrange(120), i) for i in range(rng.randint(0, 9))]
        fires += [(f"r{n}", us, "state") for us in f]
        truth += [(f"r{n}", us, sid) for us, sid in t]
        free, hits = sorted(t), 0
        for us in f:
            near = [x for x in free if abs(x[0] - us) <= 10]
            if near:
                free.remove(min(near, key=lambda x: (abs(x[0] - us), x)))
                hits += 1
        want[f"r{n}"] = (hits, len(f) - hits, len(free))
    got = replay.counts(replay.match(spark.createDataFrame(fires, "rule_id string, us long, kind string"), spark.createDataFrame(truth, "rule_id string, us long, sid long"), 10, 10))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_crossing_matches_equal_a_loop(spark):
    rng = random.Random(3)
    c, a = sorted(rng.sample(range(2000), 60)), sorted(rng.sample(range(2000), 50))
    used, hits = set(), 0
    for t in a:
        for i, x in enumerate(c):
            if 0 <= t - x <= 15 and i not in used:
                used.add(i)
                hits += 1
                break
    found = spark.createDataFrame([("s", 1.0, "rising", x) for x in c], "entity_id string, threshold double, direction string, us long")
    got = crossings.matched(found, spark.createDataFrame([("s", t) for t in a], "entity_id string, us long"), 15).first()
    assert (got["crossings"], got["actions"], got["hits"]) == (60, 50, hits)


def test_a_planted_habit_is_found_and_noise_is_not(spark):
    rng = random.Random(9)
    rows = []
    for d in range(42):
        if d % 7 < 5:
            rows.append((len(rows), (19723 + d) * DAY + 390 * MINUTE + rng.randint(-6, 6) * MINUTE, "light.kitchen", "on"))
        if rng.random() < 0.5:
            rows.append((len(rows), (19723 + d) * DAY + rng.randrange(1440) * MINUTE, "light.hall", "on"))
    df = spark.createDataFrame(rows, "sid long, us long, entity_id string, state string")
    us = F.col("us")
    acts = df.select("*", F.floor(us / DAY).alias("day"), F.floor(us % DAY / MINUTE).cast("int").alias("minute"), ((F.floor(us / DAY) + 3) % 7).cast("int").alias("wd"))
    got = habits.time_of_day(acts, 19723 * DAY, (19723 + 41) * DAY).collect()
    assert [r["entity_id"] for r in got] == ["light.kitchen"]
    assert abs(got[0]["minute"] - 390) < 6 and got[0]["filter"] == "weekdays"


def test_sessions_cross_midnight(spark):
    rows = [(1, DAY - 2 * MINUTE, "human", "a"), (2, DAY + MINUTE, "human", "b"), (3, DAY + 3 * MINUTE, "device", "a"), (4, DAY + HOUR, "device", "c")]
    df = spark.createDataFrame(rows, "sid long, us long, cause string, item string")
    got = {r["sid"]: r["session_id"] for r in sequences.sessions(df, 5 * MINUTE).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert [r["items"] for r in sequences.session_sequences(sequences.sessions(df, 5 * MINUTE)).collect()] == [["a", "b"]]


def test_recorder_scan(spark):
    states = spark.createDataFrame([(1, 1, "on", 5, None, 10.0, bytearray(b"\x01\xff")), (2, 1, "off", None, 1, 20.0, bytearray(b"")), (3, 2, None, None, None, 30.0, None)], "state_id long, metadata_id long, state string, attributes_id long, old_state_id long, last_updated_ts double, context_id_bin binary")
    meta = spark.createDataFrame([(1, "light.a"), (2, "sensor.b")], "metadata_id long, entity_id string")
    attrs = spark.createDataFrame([(5, '{"b": 3}')], "attributes_id long, shared_attrs string")
    rows = {r["sid"]: r for r in recorder.state_changes(states, meta, attrs).collect()}
    assert set(rows) == {1, 2} and rows[2]["old_state"] == "on" and rows[1]["context"] == "01ff" and rows[2]["context"] is None
    assert rows[1]["attributes"] == {"b": "3"} and rows[2]["attributes"] == {}
    assert recorder.probe({"states": states, "states_meta": meta})["normalised"]


def test_ranking_falls_back_to_the_prior(spark):
    centre = np.array([ranking.BIAS, *ranking.prior().values()])
    x = np.zeros((2, len(centre) - 1))
    assert np.allclose(ranking.train(x, np.array([0.0, 1.0]), centre), centre)
    rng = np.random.default_rng(0)
    x = np.zeros((60, len(centre) - 1))
    x[:, 0] = rng.normal(size=60)
    y = (x[:, 0] < 0).astype(float)
    assert ranking.train(x, y, centre)[1] < centre[1]
    rows = [("a", 0.9, 0.5, "holdout", ["light"], "sequence", 2.0), ("b", None, None, None, ["lock", "sun"], "other", None)]
    got = spark.createDataFrame(rows, "rule_id string, precision double, recall double, validation string, domains array<string>, miner string, occurrences double")
    made = {r.rule_id: r for r in got.select("rule_id", *ranking.features(got)).collect()}
    assert set(ranking.prior()) | {"rule_id"} == set(got.select("rule_id", *ranking.features(got)).columns) and len(ranking.prior()) == 38 + 3 + 12 + 10
    assert made["a"].holdout_validated == 1 and made["a"].miner_sequence == 1 and abs(made["a"].occurrences - np.log(3)) < 1e-9 and made["a"].domain_light == 1
    assert made["b"].precision_missing == 1 and made["b"].risky_domain == 1 and made["b"].domain_other == 1 and made["b"].miner_other == 1 and made["b"].has_backtest == 0
    ranked = {r.rule_id: r.probability for r in ranking.rank(got, got.withColumn("label", F.lit(1)).withColumn("decided_at", F.lit(1)).limit(0)).collect()}
    assert ranked["a"] > 0.5 > ranked["b"]


def test_two_planted_modes_are_recovered(spark):
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1] * 8, 40)
    rows = [(d, int(i), int(v)) for d in ("light", "switch") for i, v in enumerate(rng.poisson(np.where(truth, 9, 1)))]
    got = home_mode.modes(spark.createDataFrame(rows, "domain string, bin long, active long"), (2,)).orderBy("bin").toPandas()
    assert (got["mode"].to_numpy() == truth).mean() > 0.95


def test_home_modes_cover_the_whole_history(spark):
    from routinelens import catalog

    data = "/root/testdata/sf0.001"
    first, last = catalog._bounds(spark, data)
    got = sorted(r["bin"] for r in catalog.home_mode(spark, data).select("bin").collect())
    assert got == list(range((last - first) // (15 * MINUTE) + 1)) and len(got) > 20 * 96


def test_streaming_corrections_equal_the_batch(spark, tmp_path):
    from routinelens.streaming import live

    rng = random.Random(6)
    rows = [(i, i * 3, rng.choice(["human", "automation"]), rng.choice(["on", "off"]), rng.choice(["a", "b"]), "x", None) for i in range(80)]
    schema = "sid long, us long, cause string, state string, entity_id string, cause_entity string, context string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.corrections(stream, 6).writeStream.format("memory").queryName("corrections").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.entity_id, r.us, r.automation_state, r.human_state) for r in spark.table("corrections").collect()}
    assert got == {(r.entity_id, r.us, r.automation_state, r.human_state) for r in causality.overrides(df, 6).collect()} and got


@pytest.fixture(scope="module", params=[False, True], ids=["tidy", "messy"])
def home(spark, request):
    rows = generator.planted_home(spark, days=45, messy=request.param).cache()
    return rows, *rows.agg(F.min("us"), F.max("us")).first()


def test_planted_habit(home):
    rows, start, end = home
    got = {(r.entity_id, r.state): r for r in habits.time_of_day(habits.human_actions(rows), start, end, bandwidth=30, min_occurrences=5).collect()}
    wake = got["light.kitchen", "on"]
    assert wake["filter"] == "weekdays" and abs(wake["minute"] - 390) < 5 and wake["consistency"] > 0.7


def test_planted_routine(spark, home):
    rows, _, _ = home
    all_rows = sequences.all_sequences(sequences.usable(rows), 300 * SECOND)
    kept = sequences.prune(sequences.patterns(all_rows, 4))
    item = F.concat_ws("=", "entity_id", "state").alias("item")
    human = habits.human_actions(rows).groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    services = spark.createDataFrame([("light.hallway=on", "light.turn_on"), ("climate.living_room=heat", "climate.set_hvac_mode")], "item string, service string")
    got = {r.trigger: r for r in sequences.candidates(kept, all_rows, human, list(model.ACTIONABLE), services).collect()}
    arrival = got["person.alex=home"]
    assert arrival.actions == "light.hallway=on>climate.living_room=heat" and arrival.confidence > 0.9 and arrival.score > 0.9


def test_planted_condition_and_crossing(home):
    rows, start, end = home
    points = signals.build(rows)
    acts = habits.human_actions(rows).filter("entity_id = 'switch.heater' and state = 'on'")
    back = conditional.background(acts, start, end).withColumn("positive", F.lit(False))
    probes = acts.select("entity_id", "state", "us").withColumn("positive", F.lit(True)).unionByName(back).withColumn("kind_entity", F.col("entity_id")).withColumn("entity_id", F.lit("sensor.outdoor_temperature"))
    samples = signals.value_at(probes, points, 3 * HOUR).select(F.col("kind_entity").alias("entity_id"), "state", F.col("entity_id").alias("signal"), "positive", "us", "num", "str")
    kinds = samples.select("signal").distinct().withColumn("numeric", F.lit(True))
    best = conditional.conditions(samples, kinds, kinds.select("signal", F.lit(0).alias("place"))).first()
    assert best.signal == "sensor.outdoor_temperature" and best.test.startswith("below") and 6.5 < float(best.test.split()[1]) < 11 and best.coverage > 0.9
    tried = acts.select(F.lit("heater").alias("kind"), F.lit("sensor.outdoor_temperature").alias("entity_id"), "us")
    cross = crossings.best_crossing(crossings.matched(crossings.crossings(points, crossings.deciles(points)), tried, 900 * SECOND), strength=0.2).first()
    assert cross.kind == "heater" and cross.direction == "falling" and cross.recall > 0.5


def test_planted_overrides(home):
    rows, _, _ = home
    got = causality.override_summary(causality.overrides(rows, 120 * SECOND)).first()
    assert got.automation == "automation.bedtime_dim" and 20 <= got.overrides <= 42


def test_gates_of_risky_and_security_rules(spark):
    rows = [("plain", 5, 0, 1, 0, 0, "light.turn_on", "light"), ("lock", 5, 0, 1, 0, 0, "lock.lock", "lock"), ("open", 50, 0, 0, 0, 0, "lock.unlock", "lock"), ("flaps", 5, 0, 1, 40, 0, "light.turn_on", "light"), ("nuisance", 5, 1, 1, 0, 1, "light.turn_on", "light"), ("never", 0, 0, 4, 0, 0, "light.turn_on", "light"), ("nothing", 0, 0, 0, 0, 0, "light.turn_on", "light")]
    df = spark.createDataFrame(rows, "rule_id string, true_fires long, false_fires long, missed long, bursts long, nuisance long, service string, domain string")
    got = {r.rule_id: r.reasons for r in replay.gates(df, 30.0).collect()}
    assert got == {"plain": "", "lock": "few", "open": "security", "flaps": "bursts", "nuisance": "nuisance", "never": "never fired", "nothing": "nothing to judge"}
    scaled = {r.rule_id: r.passed for r in replay.gates(df, 7.5, scale=0.25).collect()}
    assert scaled["plain"] and scaled["lock"]
    assert replay.gates(df, 30.0, replay.Bars(allow_security=True)).filter("rule_id = 'open'").first().passed


def test_split_at_midnight_unless_a_part_is_too_short():
    assert replay.split(0, 40 * DAY + HOUR) == 30 * DAY and replay.split(5 * HOUR, 40 * DAY + 5 * HOUR) % DAY == 0
    assert replay.split(0, 10 * DAY) == 10 * DAY - int(2.5 * DAY) and replay.split(5, 3) == 5


def test_windows_cross_midnight(spark):
    rng = random.Random(3)
    rows = sorted((rng.randrange(6 * DAY) if k else 2 * DAY, k, f"i{k}") for k in range(60))
    rows = [(us, k, x) for us, k, x in rows if not DAY <= us < 2 * DAY]  # a day without rows
    got = {r.sid: r for r in activity.windows(spark.createDataFrame(rows, "us long, sid long, item string")).collect()}
    for n, (us, sid, _) in enumerate(rows):
        gap = us - rows[n - 1][0] if n else None
        want = 4 if gap is None else sum(gap >= x for x in (10 * SECOND, MINUTE, 10 * MINUTE, HOUR))
        assert got[sid].before == [x for _, _, x in rows[max(0, n - 6) : n]] and got[sid].gap == want


def test_conditions_as_facts(spark):
    rows = ['{"condition": "state", "entity_id": ["a.b"], "state": ["On", "off "]}', '{"condition": "state", "entity_id": ["a.b", "a.c"], "state": "on"}', '{"condition": "numeric_state", "entity_id": "s.t", "above": "5", "below": null}', '{"condition": "numeric_state", "entity_id": "s.t"}', '{"condition": "time", "after": "22:00:00", "before": "06:00", "weekday": ["Monday", "xyz"]}', '{"condition": "sun", "after": "sunset"}', '{"condition": "sun", "before": "sunset"}', "not json", '{"condition": "zone"}']
    told = conditions.facts(spark.createDataFrame([(str(k), c) for k, c in enumerate(rows)], "rule_id string, condition string"))
    got = {r.rule_id: r for r in told.collect()}
    assert [got[str(k)].kind for k in range(9)] == ["state", "unknown", "numeric", "unknown", "time", "sun", "sun", "unknown", "unknown"]
    assert got["0"].states == ["off", "on"] and got["2"].above == 5.0 and (got["4"].after, got["4"].before, got["4"].weekdays) == (1320, 360, ["mon"])
    assert [tuple(r) for r in conditions.exclusive(told).collect()] == [("5", "6")]
    clock = lambda k, a, b, d="[]": (k, f'{{"condition": "time", "after": "{a}", "before": "{b}", "weekday": {d}}}')
    times = [clock("a", "22:00", "06:00"), clock("b", "06:00", "07:00"), clock("c", "07:01", "21:59"), clock("d", "00:00", "23:59", '["sat"]'), clock("e", "00:00", "23:59", '["sun"]')]
    got = conditions.exclusive(conditions.facts(spark.createDataFrame(times, "rule_id string, condition string"))).collect()
    assert sorted(tuple(r) for r in got) == [("a", "c"), ("b", "c"), ("d", "e")]
    assert len({r.signature for r in conditions.signature(told).collect()}) == 6


def test_stale_and_health(spark):
    now = 1_706_000_000_000_000
    rows = [("x", "OFF", now - 100 * DAY), ("y", "on", None), ("z", "on", now - 100 * DAY), ("ok", "on", now - DAY), ("month", "on", now - 31 * DAY)]
    got = {r.id: (r.reason, round(r.score, 6)) for r in health.stale(spark.createDataFrame(rows, "id string, state string, last_triggered_us long"), now).collect()}
    assert got == {"x": ("off", 0.4), "y": ("never", 0.4), "z": ("old", round(0.4 + 100 / 365, 6)), "month": ("old", round(0.4 + 31 / 365, 6))}
    facts = [("gone", False, False, True, True, 30.0, False, 5, 5, 0), ("edited", True, True, True, True, 30.0, False, 5, 5, 0), ("dead", True, False, False, False, 30.0, False, 5, 5, 0), ("off", True, False, True, False, 30.0, False, 5, 5, 0), ("young", True, False, True, True, 3.0, False, 5, 5, 0), ("broken", True, False, True, True, 30.0, True, 9, 9, 0), ("quiet", True, False, True, True, 30.0, False, 2, 0, 0), ("dormant", True, False, True, True, 30.0, False, 3, 0, 0), ("few", True, False, True, True, 30.0, False, 4, 4, 4), ("undone", True, False, True, True, 30.0, False, 9, 10, 6), ("noisy", True, False, True, True, 30.0, False, 9, 10, 3), ("weak", True, False, True, True, 30.0, False, 40, 10, 0), ("fine", True, False, True, True, 30.0, False, 3, 10, 2)]
    schema = "rule_id string, present boolean, edited boolean, live boolean, enabled boolean, days double, error boolean, predicted int, actual int, overridden int"
    got = {r.rule_id: r.status for r in health.verdict(spark.createDataFrame(facts, schema)).collect()}
    assert got == {"gone": "deleted", "edited": "edited", "dead": "insufficient_data", "off": "disabled", "young": "insufficient_data", "broken": "insufficient_data", "quiet": "insufficient_data", "dormant": "dormant", "few": "insufficient_data", "undone": "overridden", "noisy": "noisy", "weak": "underperforming", "fine": "healthy"}


def test_roles(spark):
    rows = [("sensor.mangoethanol", "x", None, None), ("sensor.go_echarger", "x", None, None), ("sensor.garden", "x", "temperature", None), ("sensor.garden_template", "x", None, "template"), ("sensor.a", "Tibber price level", None, None), ("sensor.b", "Tibber price", None, None), ("binary_sensor.w", "x", None, "workday"), ("binary_sensor.fp2", "presence", None, None), ("weather.home", "x", None, None), ("sensor.lux_hall", "x", None, None)]
    df = spark.createDataFrame([(e, e.split(".")[0], n, c, p, 20.0 if e.startswith("weather") else None) for e, n, c, p in rows], "entity_id string, domain string, name string, device_class string, platform string, temperature double")
    got = {(r.role, r.entity_id) for r in dimensions.roles(df).collect()}
    assert got == {("ev_charger", "sensor.go_echarger"), ("outdoor_temperature", "sensor.garden"), ("outdoor_temperature", "sensor.garden_template"), ("price_level", "sensor.a"), ("energy_price", "sensor.b"), ("workday", "binary_sensor.w"), ("occupancy", "binary_sensor.fp2"), ("room_presence", "binary_sensor.fp2"), ("weather", "weather.home"), ("illuminance", "sensor.lux_hall")}
    assert ("outdoor_temperature", "weather.home#temperature") in {(r.role, r.entity_id) for r in dimensions.roles(df.filter("domain = 'weather'")).collect()}


def test_decisions_and_runs(spark):
    table = spark.createDataFrame([("a", "tod", 0.5, "new", 2, 1)], "id string, miner string, score double, status string, seen_count int, last_run int")
    log = spark.createDataFrame([], "id string, decision string, n long, reason string, score double, seen_count int")
    table, log = store.decide(table, log, "a", "dismissed", 1, "no")
    assert table.first().status == "dismissed" and [tuple(r) for r in store.dismissed(table, log).collect()] == [("a", "tod", "no", 1)]
    table, log = store.decide(table, log, "a", "restored", 2)
    assert table.first().status == "new" and log.count() == 2
    runs = spark.createDataFrame([(1, 5, None, "running"), (2, 6, 8, "done")], "run int, started_us long, finished_us long, status string")
    assert sorted(tuple(r) for r in store.close_interrupted(runs, 9).collect()) == [(1, 5, 9, "interrupted"), (2, 6, 8, "done")]
    assert circular is not None and conflicts.siblings(spark.createDataFrame([("d", "x"), ("d", "y"), ("e", "z")], "device_id string, entity_id string")).count() == 2


def test_modes_are_summed_up_and_keep_their_numbers(spark):
    quiet, busy = range(0, 28), range(72, 88)  # from midnight, and from 18:00, of one day in quarters of an hour
    decoded = spark.createDataFrame([(b, 3) for b in quiet] + [(b, 1) for b in busy], "bin long, mode int")
    levels = spark.createDataFrame([(d, b, (4 if d == "light" else 1 if d == "media_player" else 0) * int(b in busy)) for d in ("light", "media_player", "lock") for b in [*quiet, *busy]], "domain string, bin long, active long")
    dense = home_mode.occupied(decoded)
    assert {r["mode"] for r in dense.collect()} == {0, 1} and dense.filter("mode = 0").count() == len(busy)
    got = {r["mode"]: r for r in home_mode.summaries(dense, levels).collect()}
    assert (got[0]["share"], got[0]["typical_time"], got[0]["top_domains"]) == (round(16 / 44, 4), "19:52:00", ["light", "media_player"])
    assert (got[1]["share"], got[1]["typical_time"], got[1]["top_domains"]) == (round(28 / 44, 4), "03:22:00", []) and got[1]["spread_minutes"] > got[0]["spread_minutes"] > 0
    now = home_mode.profiles(dense, levels)
    swapped = now.withColumn("mode", 1 - now["mode"])
    again = {r["bin"]: r["mode"] for r in home_mode.aligned(dense, now, swapped).collect()}
    assert all(again[b] == 1 for b in busy) and all(again[b] == 0 for b in quiet)
    assert home_mode.aligned(dense, now, now.filter("mode = 0")) is dense and home_mode.summaries(dense.filter("false"), levels).count() == 0
