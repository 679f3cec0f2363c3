"""Motifs against a quadratic loop over all pairs of windows."""

import math
import random

import pytest

from routinelens.model import HOUR
from routinelens.operators import motifs


def brute(values, window):
    def normal(w):
        mean = sum(w) / window
        size = math.sqrt(sum((v - mean) ** 2 for v in w) / window)
        return None if size < 1e-12 else [(v - mean) / size for v in w]

    w = [normal(values[i : i + window]) for i in range(len(values) - window + 1)]
    best = []
    for i, x in enumerate(w):
        for j, y in enumerate(w):
            if abs(i - j) > math.ceil(window / 4):
                square = 0 if x is None and y is None else window if x is None or y is None else sum((p - q) ** 2 for p, q in zip(x, y))
                best.append((i, round(math.sqrt(max(0, square)), 4), j))
    least = {}
    for i, d, j in best:
        least[i] = min(least.get(i, (d, j)), (d, j))
    return least


def series(rng):
    planted = [rng.gauss(0, 5) for _ in range(12)]
    out = {"sensor.noise": [rng.gauss(20, 3) for _ in range(150)], "sensor.short": [rng.random() for _ in range(47)], "sensor.flat": [rng.gauss(0, 1) for _ in range(30)] + [7.0] * 20 + [rng.gauss(0, 1) for _ in range(30)] + [7.0] * 13}
    walk = [rng.gauss(0, 1) for _ in range(160)]
    for at in (20, 111):
        walk[at : at + 12] = [3 * v + at for v in planted]
    out["sensor.walk"] = walk
    return out


@pytest.mark.parametrize("tile", [1024, 37, 12])
def test_profile_and_motifs_equal_a_loop(spark, tile):
    made = series(random.Random(3))
    rows = [(e, k * 7 * HOUR, k, v) for e, values in made.items() for k, v in enumerate(values)] + [("sensor.noise", 3, 1, None), ("sensor.noise", 4, 2, float("nan"))]
    points = spark.createDataFrame(rows, "entity_id string, us long, sid long, num double").repartition(4)
    got = {(r["entity_id"], r["i"]): (round(r["distance"], 4), r["neighbour"]) for r in motifs.profile(points, tile=tile).collect()}
    want = {(e, i): best for e, values in made.items() if len(values) >= 48 for i, best in brute(values, 12).items()}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 2e-4 for k in want)
    assert all(got[k][1] == want[k][1] for k in want if want[k][0] > 0.01 or k[0] == "sensor.walk")
    found = motifs.motifs(points, tile=tile).collect()
    for entity, values in made.items():
        mine = sorted((r["rank"], r["i"], r["start_us"]) for r in found if r["entity_id"] == entity)
        first = sorted((d, i) for i, (d, _) in brute(values, 12).items())[:3] if len(values) >= 48 else []
        assert [i for _, i, _ in mine] == [i for _, i in first] or entity == "sensor.flat"
        assert all(us == i * 7 * HOUR for _, i, us in mine) and len(mine) == len(first)
    assert {r["i"] for r in found if r["entity_id"] == "sensor.walk" and r["rank"] < 3} == {20, 111}


def test_no_points_no_motifs(spark):
    assert motifs.motifs(spark.createDataFrame([], "entity_id string, us long, sid long, num double")).count() == 0


@pytest.mark.parametrize("tile", [13, 64])
def test_the_nearest_are_those_of_the_profile(spark, tile):
    rng = random.Random(11)
    made = {**series(rng), "sensor.long": [rng.gauss(0, 1) for _ in range(1500)], "sensor.same": [float(k % 5) for k in range(300)]}
    rows = [(e, k * HOUR, k, v) for e, values in made.items() for k, v in enumerate(values)]
    points = spark.createDataFrame(rows, "entity_id string, us long, sid long, num double").repartition(4)
    whole = {}
    for r in motifs.profile(points, tile=tile).collect():
        whole.setdefault(r["entity_id"], []).append((r["distance"], r["i"], r["neighbour"]))
    want = {(e, k + 1, i, j, d) for e, some in whole.items() for k, (d, i, j) in enumerate(sorted(some)[:3])}
    assert {(r["entity_id"], r["rank"], r["i"], r["neighbour"], r["distance"]) for r in motifs.motifs(points, tile=tile).collect()} == want


def test_few_windows_of_a_long_series_are_worked_out(spark):
    rows = [("s", k, k, random.Random(k).random()) for k in range(4000)]
    points = spark.createDataFrame(rows, "entity_id string, us long, sid long, num double")
    assert 3 <= motifs.nearest(points, tile=256).count() < 400  # of 3989
