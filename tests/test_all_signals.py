"""Signals read together in one pass, and actions matched with crossings of all signals, against plain loops."""

import random

import pytest

from routinelens.model import DAY, MINUTE
from routinelens.operators import asof, conditional, crossings, signals


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_values_of_all_signals_equal_a_loop(spark, width):
    rng = random.Random(2)
    points = [(rng.choice(["a", "b", "c", "d"]), rng.randrange(300), k, float(k), f"s{k}") for k in range(150)] + [("a", 50, 900, None, "x"), ("a", None, 901, 1.0, "y")]
    moments = [(rng.randrange(-5, 320), f"m{k}") for k in range(60)] + [(10, "same"), (10, "same")]
    df = spark.createDataFrame(points, "entity_id string, us long, sid long, num double, str string").repartition(4)
    got = signals.values_at(spark.createDataFrame(moments, "us long, name string"), df, ["a", "b", "none"], 20, width)
    want = []
    for us, name in moments:
        for s in ("a", "b", "none"):
            last = max(((u, k, n, t) for e, u, k, n, t in points if e == s and u is not None and u <= us), default=None)
            want.append((us, name, s, *(last[2:] if last and us - last[0] <= 20 else (None, None))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert signals.values_at(spark.createDataFrame([], "us long, name string"), df, ["a"]).count() == 0


def test_kinds_meet_all_signals(spark):
    rng = random.Random(8)
    found = [(e, t, d, rng.randrange(900)) for e in ("s", "t") for t in (1.0, 2.0) for d in ("rising", "falling") for _ in range(25)]
    found += found[:6]  # equal times of one threshold
    acts = [(k, rng.randrange(900)) for k in ("k1", "k2") for _ in range(40)] + [("k1", 5), ("k1", 5), ("far", 100_000)]
    want = {}
    for kind in ("k1", "k2", "far"):
        times = sorted(us for k, us in acts if k == kind)
        for key in sorted({f[:3] for f in found}):
            free, hits = sorted(f[3] for f in found if f[:3] == key), 0
            total = len(free)
            for us in times:
                near = [c for c in free if 0 <= us - c <= 12]
                if near:
                    free.remove(near[0])
                    hits += 1
            if hits:
                want[(kind, *key)] = (total, len(times), hits)
    got = crossings.matched(spark.createDataFrame(found, "entity_id string, threshold double, direction string, us long"), spark.createDataFrame(acts, "kind string, us long"), 12)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == want


def test_background_by_minutes_is_bounded(spark):
    acts = [("light.a", "on", d * DAY + k * 1_000_000 + k) for d in (0, 2) for k in range(300)]
    df = spark.createDataFrame(acts, "entity_id string, state string, us long")
    exact = conditional.background(df, 0, 5 * DAY).count()
    minutes = sorted(r["us"] for r in conditional.background(df, 0, 5 * DAY, MINUTE).collect())
    assert exact == 3 * 300 and minutes == [d * DAY + m * MINUTE for d in (1, 3, 4) for m in range(5)]


def test_asof_all_keeps_clashing_names(spark):
    left = spark.createDataFrame([(1, "kept")], "us long, local string")
    right = spark.createDataFrame([("a", 1, 1, 2.0)], "key string, us long, tie long, v double")
    assert [tuple(r) for r in asof.asof_all(left, right, "key", ["a"], "us", "tie", ["v"]).collect()] == [(1, "kept", "a", 2.0)]
