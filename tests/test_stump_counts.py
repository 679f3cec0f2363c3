"""Thresholds of dense samples: the same as a plain loop, from one row a threshold."""

import random

from pyspark.sql import functions as F

from routinelens.operators import conditional
from routinelens.operators.signals import number


def loop(rows, coverage, lift):
    best = None
    np_, nb = sum(p for p, _ in rows), sum(not p for p, _ in rows)
    cuts = sorted({float(f"{int(abs(v) * 100 + 0.5) / 100 * (1 if v >= 0 else -1):.2f}") for _, v in rows})
    for cut in cuts:
        for late, direction in enumerate(("below", "above")):
            hit = [p for p, v in rows if (v < cut if late == 0 else v > cut)]
            c = sum(hit) / np_
            gain = c / (max(len(hit) - sum(hit), 0.5) / nb)
            if c >= coverage and gain >= lift:
                rank = (-(c * min(gain / 2, 1.0)), cut, late)
                best = min(best, (rank, direction, cut, c, gain)) if best else (rank, direction, cut, c, gain)
    return None if best is None else best[1:]


def test_stumps_equal_a_loop(spark):
    rng = random.Random(12)
    rows = {}
    for n in range(6):
        rows[f"s{n}"] = [(rng.random() < 0.4, rng.gauss(0, 0.02 * (n + 1)) + rng.choice((0, 0.01, 1, -2.5))) for _ in range(40 * (n + 1))]
        rows[f"s{n}"] += [(k % 2 == 0, k / 100) for k in range(20)]
    df = spark.createDataFrame([("light.a", "on", s, p, v) for s, some in rows.items() for p, v in some], "entity_id string, state string, signal string, positive boolean, num double").repartition(3)
    for coverage, lift in ((0.2, 0.5), (0.75, 1.0)):
        got = {r["signal"]: (r["direction"], r["cut"], r["coverage"], r["lift"]) for r in conditional.numeric_stump(df, coverage, lift).collect()}
        assert got == {s: found for s, some in rows.items() if (found := loop(some, coverage, lift))}


def test_windows_hold_a_row_a_threshold(spark):
    df = spark.range(400_000).selectExpr("'light.a' AS entity_id", "'on' AS state", "'s' AS signal", "id % 3 = 0 AS positive", "id % 7 / 100.0D + id / 1e9 AS num")
    found = conditional.numeric_stump(df, 0.2, 0.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" in plan[plan.rindex("Window") :]  # samples are counted before any window
    assert found.count() == 1


def test_words_are_no_numbers(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "1f", "on", "", "NaN", "Infinity", "-inf", "1e999", "x1", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(number(F.col("t"))).collect()]
    plain = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").try_cast("double")).collect()]
    assert got == [None if v is None or v != v or abs(v) == float("inf") else v for v in plain]
