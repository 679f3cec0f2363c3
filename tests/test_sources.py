from routinelens.plans import rules
from routinelens.sources import datasets


def rows(spark, *text):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n long, line string")


def test_casas(spark):
    got = datasets.casas(rows(spark, "2010-11-04 00:03:50.209589 M003 ON Sleep begin", "2010-11-04 05:40:43 D001 OPEN", "bad line", "2010-11-04 05:41:00 M003 OFF Sleep end", "2010-11-04 05:42:00 LS01 12", "2010-13-04 05:42:00 M1 ON"))
    found = {r["n"]: (r["entity_id"], r["state"], r["old_state"], r["cause"]) for r in got.collect()}
    assert found == {0: ("binary_sensor.m003", "on", None, "device"), 1: ("binary_sensor.d001", "on", None, "human"), 3: ("binary_sensor.m003", "off", "on", "device"), 4: ("sensor.ls01", "12", None, "device")}
    assert [(r["activity"], r["end_us"] - r["start_us"] > 0) for r in datasets.activities(got).collect()] == [("Sleep", True)]


def test_aras_and_kasteren(spark):
    got = datasets.aras(rows(spark, "0 1 0 2 3", "1 1 0 2 3", "1 0 0 2 3"), 1_000_000)
    assert sorted((r["us"], r["entity_id"], r["state"]) for r in got.collect()) == [(2_000_000, "binary_sensor.sensor_00", "on"), (3_000_000, "binary_sensor.sensor_01", "off")]
    two = datasets.kasteren(rows(spark, "start end sensor", "2008-02-25 00:20:14\t2008-02-25 00:22:57\tHall-Bedroom door\t1", ""))
    assert sorted((r["entity_id"], r["state"], r["old_state"]) for r in two.collect()) == [("binary_sensor.hall_bedroom_door", "off", "on"), ("binary_sensor.hall_bedroom_door", "on", "off")]


def test_rules():
    t, a = [{"kind": "time", "at": "06:30:00", "entity_id": None}], [{"service": "light.turn_on", "entity_id": "light.k", "data": {}}]
    assert rules.signature("tod", t, [], a) == rules.signature("tod", [{"kind": "time", "at": "06:30:00"}], [], a) != rules.signature("tod", t, [{"kind": "state", "entity_id": "x", "state": "on"}], a)
    assert rules.sentence(t, [], a) == "At 06:30, turn on light.k"
    assert rules.automation("1", "x", t, [], a)["triggers"] == [{"trigger": "time", "at": "06:30:00"}]
    assert rules.invented_numbers("8 of 10 days, 80% and 77", {"hits": 8, "days": 10, "share": 0.8}) == ["77"]
    assert rules.target_state("light.turn_on") == "on" and rules.target_state("media_player.media_play") is None


def test_registry_files(spark, tmp_path):
    import json

    from routinelens.sources import registry

    rows = [{"entity_id": "light.a", "device_id": "d", "labels": ["x"], "options": {"conversation": {"aliases": ["lamp"]}}}, {"entity_id": "light.b", "disabled_by": "user", "aliases": ["b"]}, {"name": "no id"}]
    path = tmp_path / "entities"
    path.write_text(json.dumps({"version": 1, "data": {"entities": rows, "deleted_entities": [{"entity_id": "light.ghost"}] * 5}}, indent=1))
    got = {r.entity_id: r for r in registry.entities(registry.read(spark, str(path), "entity")).collect()}
    assert set(got) == {"light.a", "light.b"} and got["light.a"].aliases == ["lamp"] and not got["light.b"].enabled and got["light.b"].aliases == ["b"]
    path.write_text("{broken")
    assert registry.read(spark, str(path), "device").count() == 0
    path.write_text(json.dumps({"data": {"areas": [{"id": "k", "name": "Kitchen"}]}}))
    assert registry.areas(registry.read(spark, str(path), "area")).first().area_id == "k"


def test_dataset_activities_and_dispatch(spark, tmp_path):
    from routinelens.sources import datasets

    path = tmp_path / "day.txt"
    path.write_text("\n".join(["0 1 7 3", "1 1 7 3", "1 0 8 3", "1 0 8 3"]))
    runs = sorted((r.resident, r.activity, r.start_us // 1_000_000, r.end_us // 1_000_000) for r in datasets.aras_activities(datasets.lines(spark, str(path)), 0).collect())
    assert runs == [(0, "7", 0, 2), (0, "8", 2, 4), (1, "3", 0, 4)]
    one = datasets.stats(datasets.load(spark, str(path), "aras")).first()
    assert (one.n, one.entities, one.human) == (2, 2, 2)


def test_statistics(spark):
    from pyspark.sql import functions as F

    from routinelens.sources import recorder

    meta = spark.createDataFrame([(1, "s.a"), (2, "s.b")], "id long, statistic_id string")
    rows = spark.createDataFrame([(2, 10.0, 1.0), (1, 20.0, 2.0), (1, 10.0, 3.0), (1, 30.0, 4.0)], "metadata_id long, start_ts double, mean double")
    for c in ("min", "max", "state", "sum"):
        rows = rows.withColumn(c, F.lit(0.0))
    got = [(r.statistic_id, r.start_ts) for r in recorder.statistics(rows, meta, ["s.a"], 10.0, 30.0).collect()]
    assert got == [("s.a", 10.0), ("s.a", 20.0)] and recorder.statistic_ids(meta).count() == 2
    texts = spark.createDataFrame([("12.5",), ("1970-01-01T00:01:00+00:00",), ("x",)], "t string").select(recorder.seconds(F.col("t")).alias("s"))
    assert [r.s for r in texts.collect()] == [12.5, 60.0, None]


def test_automation_files(spark, tmp_path):
    import json

    from routinelens.sources import automations

    deep = {"service": "light.turn_on", "target": {"entity_id": ["light.a", "light.b"], "area_id": "hall"}}
    for _ in range(4):
        deep = {"if": [], "then": [{"repeat": {"count": 2, "sequence": deep}}], "else": [{"scene": "scene.night"}]}
    listed = [
        {"id": 7, "alias": "Evening", "mode": "restart", "trigger": [{"platform": "time", "at": ["18:00", "19:00"]}, {"trigger": "state", "entity_id": "switch.x"}], "condition": {"condition": "state", "entity_id": ["person.p", "nodot"]}, "action": [deep, "wait", {"delay": 5}]},
        {"triggers": {"platform": "sun"}, "actions": {"choose": [{"conditions": [], "sequence": {"action": "climate.set_hvac_mode", "data": {"hvac_mode": "heat", "entity_id": "climate.c", "device_id": "d1"}}}], "default": [{"service": "script.bedtime"}, {"service": "automation.trigger", "entity_id": "automation.z"}]}},
        {"alias": "no trigger", "action": []},
        "not an automation",
    ]
    (tmp_path / "automations.json").write_text(json.dumps(listed))
    (tmp_path / "broken.json").write_text("{")
    rows = automations.read(spark, str(tmp_path))
    told = {r.key: r for r in automations.normalise(rows).collect()}
    one, two = told["automations.json#0"], told["automations.json#1"]
    assert len(told) == 2 and (one.id, one.alias, one.mode, one.trigger_times, one.trigger_kinds, one.trigger_entities, one.condition_entities) == ("7", "Evening", "restart", ["18:00", "19:00"], ["time", "state"], ["switch.x"], ["person.p"])
    assert (two.id, two.alias, two.mode, two.trigger_kinds) == (None, "unnamed automation", "single", ["sun"])
    called = automations.actions(rows)
    got = sorted((r.key[-1], r.service, tuple(r.entity_ids), r.target_state) for r in called.collect())
    assert got == sorted([("0", "light.turn_on", ("light.a", "light.b"), "on")] + [("0", "scene.turn_on", ("scene.night",), None)] * 4 + [("1", "climate.set_hvac_mode", ("climate.c",), "heat"), ("1", "script.bedtime", (), None), ("1", "automation.trigger", ("automation.z",), None)])
    assert {(r.entity_id, r.area_id, r.device_id) for r in automations.targets(called).collect()} >= {("light.a", None, None), (None, "hall", None), (None, None, "d1")}
    assert {r.entity_id for r in automations.started(called).collect()} == {"script.bedtime", "automation.z"}
    live = spark.createDataFrame([("automation.evening", "7", "Evening", "off"), ("automation.other", None, "Other", None)], "entity_id string, unique_id string, name string, state string")
    met = {(r.alias, r.entity_id, r.enabled, r.source) for r in automations.attach(automations.normalise(rows), live).collect()}
    assert met == {("Evening", "automation.evening", False, "automations.json"), ("unnamed automation", None, True, "automations.json"), ("Other", "automation.other", True, "states-only")}
    assert automations.actions(rows.filter("false")).count() == 0
