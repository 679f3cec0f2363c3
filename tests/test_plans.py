"""Rules in words, their meaning, and the checks of proposals."""

from routinelens.plans import rules, validators

DO = [{"service": "light.turn_on", "entity_id": "light.hall", "data": {"level": 5}}]


def test_sentences():
    assert rules.sentence([{"kind": "time", "at": "06:30:00"}], [{"weekday": ["mon", "tue"]}], DO) == "At 06:30, turn on light.hall (level=5) - but only if on mon, tue"
    assert rules.sentence([{"kind": "state", "entity_id": "person.a", "to_state": "home", "for_seconds": 30}], [{"entity_id": "sun.sun", "state": "up"}], DO[:1]).startswith("When person.a becomes 'home' for 30s, turn on light.hall")
    assert rules.sentence([], [], DO).startswith("When always, ") and rules.sentence([{"kind": "sun", "event": "sunset", "offset": "-00:10"}], [], DO).startswith("At sunset -00:10, ")
    assert rules.sentence([{"kind": "state", "entity_id": "a.b"}, {"kind": "numeric_state", "entity_id": "s.t", "above": 5.0, "below": 9}], [{"kind": "time", "after": "22:00"}], DO).endswith("but only if after 22:00")
    assert rules.evidence({"occurrences": 4, "opportunities": 5, "confidence": 0.8, "spread_minutes": 6.2}) == "4 of 5, confidence 80%, ±6 min"
    assert rules.touched([{"entity_id": "b.b"}, {"entity_id": "a.a"}, {}], DO) == (["a.a", "b.b"], ["light.hall"])


def test_meaning_of_rules():
    a = {"id": "1", "alias": "x", "trigger": [{"platform": "time", "at": "06:30"}], "action": [{"service": "light.turn_on", "target": {"entity_id": ["light.a"]}}]}
    b = {"triggers": {"trigger": "time", "at": "06:30:00"}, "conditions": [], "actions": {"action": "light.turn_on", "target": {"entity_id": "light.a"}}, "mode": "single"}
    assert validators.differences(a, b) == [] and validators.differences(a, {**b, "mode": "restart"}) == ["mode"]
    assert validators.differences(a, {**b, "actions": {"action": "light.turn_off", "target": {"entity_id": "light.a"}}}) == ["action"]


def test_proposals(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    ids = lambda frame, *c: sorted(tuple(r) for r in frame.select(*c).collect())
    known = df([("light.a", None), ("light.b", "hall")], "entity_id string, area_id string")
    refs = df([("r", "entity", "light.a"), ("r", "entity", "light.x"), ("r", "service", "light.a")], "rule_id string, kind string, name string")
    assert ids(validators.unknown_references(refs, df([("entity", "light.a")], "kind string, name string")), "kind", "name") == [("entity", "light.x"), ("service", "light.a")]
    assert validators.static_targets(df([("r", "light.a", "light.turn_on"), ("q", "{{ x }}", "s"), ("p", "all", "s"), ("o", None, "s")], "rule_id string, target string, service string")).count() == 3
    assert ids(validators.triaged(df([("a", 0.8), ("b", 0.8), ("c", 0.8)], "id string, score double"), df([("a", "unlikely"), ("b", "fine")], "id string, verdict string")), "id", "score") == [("a", 0.4), ("b", 0.8), ("c", 0.8)]
    audit = validators.reviewed(df([(1, "error"), (2, "info"), (3, "warning")], "finding_id int, severity string"), df([(1, "intended"), (2, "intended"), (3, "harmless")], "finding_id int, verdict string"))
    assert ids(audit, "finding_id", "severity", "hidden") == [(1, "warning", False), (2, "info", True), (3, "info", False)]
    areas = df([("hall", "Hall"), ("attic", "Attic"), ("attic2", "attic")], "area_id string, name string")
    said = df([("light.a", " HALL"), ("light.b", "attic"), ("light.x", "hall")], "entity_id string, area_name string")
    assert ids(validators.inferred_areas(known, areas, said), "entity_id", "area_id") == [("light.a", "hall")]
    drafts = df([("p", "t", ["1", "2"]), ("q", "t", ["1", "1"]), ("r", "t", ["1", "9"])], "pref_id string, text string, cited array<string>")
    assert ids(validators.learned_preferences(drafts, df([("1",), ("2",)], "id string")), "pref_id") == [("p",)]
    long = "needs a thing that is long enough"
    props = df([(1, "New!", "b", long, ["light.a"]), (2, "new", "b", long, ["light.a"]), (3, "Old one", "b", long, []), (4, "X", "b", long, ["no.no"]), (5, "Y", "b", "short", []), (6, "", "b", long, [])], "n int, title string, benefit string, precondition string, cited array<string>")
    assert ids(validators.gap_proposals(props, df([("old ONE",)], "title string"), known), "n") in ([(1,)], [(1,), (2,)])
    labels = df([(0, " Night "), (1, "x" * 41), (7, "Day"), (0, "Zzz")], "mode int, label string")
    assert ids(validators.mode_labels(labels, df([(0,), (1,)], "mode int")), "mode", "label") == [(0, "Night")]
    roles = df([("person", "person.a")], "role string, entity_id string")
    more = df([("motion", "light.a"), ("nonsense", "light.a"), ("motion", "no.no")], "role string, entity_id string")
    assert ids(validators.merged_roles(roles, more, known, df([("motion",)], "role string")), "role") == [("motion",), ("person",)]
    hyp = df([("r", 1, "numeric", "s.t", None, 5.0, None), ("r", 2, "numeric", "s.t", None, None, None), ("r", 3, "state", "b.s", "on", None, None), ("r", 4, "state", "s.t", "on", None, None), ("r", 5, "state", "x.x", "on", None, None)], "rule_id string, n int, kind string, entity_id string, state string, above double, below double")
    assert ids(validators.hypotheses(hyp, df([("s.t", True), ("b.s", False)], "entity_id string, numeric boolean")), "n") == [(1,), (3,)]
    scene = df([("a", "time", None, 400, "light.a", "on"), ("b", "time", None, 405, "light.b", "on"), ("c", "state", "p.a", None, "light.a", "on"), ("d", "state", "p.a", None, "light.a", "off")], "rule_id string, kind string, trigger string, minute int, target_entity string, target_state string")
    assert ids(validators.scenes(scene), "rules", "entities") == [(2, 2)]
    assert validators.inventory(df([("a", "x"), ("b", None)], "entity_id string, name string")).first() == validators.inventory(df([("b", None), ("a", "x")], "entity_id string, name string")).first()


def test_options(spark, tmp_path):
    from routinelens.plans import options

    plain = options.resolve()
    assert set(plain) == set(options.SETTINGS) and plain["min_occurrences"] == 5 and plain["min_lift"] == 1.5 and "sun" in plain["excluded_domains"]
    got = options.resolve({"min_occurrences": "1", "min_support": 7, "min_lift": "much", "allow_security_actions": " Yes ", "excluded_domains": "Camera, ,vacuum", "excluded_users": ["u", None, ""], "unheard": 1, "min_confidence": None, "health_noisy_override_rate": 0.8, "backtest_holdout_fraction": "0.95", "ranking_prior_strength": 0})
    assert (got["min_occurrences"], got["min_support"], got["min_lift"], got["allow_security_actions"], got["excluded_users"], got["min_confidence"]) == (2, 1.0, 1.5, True, ("u",), 0.6)
    assert {"camera", "vacuum", "sun"} <= set(got["excluded_domains"]) and "unheard" not in got and got["health_overridden_override_rate"] == 0.8 and got["backtest_holdout_fraction"] == 0.9 and got["ranking_prior_strength"] == 0.01
    for name, text in (("good", '{"min_occurrences": 9}'), ("broken", "{"), ("list", "[1]"), ("empty", "")):
        (tmp_path / name).write_text(text)
    assert [options.load(spark, str(tmp_path / n))["min_occurrences"] for n in ("good", "broken", "list", "empty")] == [9, 5, 5, 5]
