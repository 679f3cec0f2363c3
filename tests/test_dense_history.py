"""Histories without gaps: folds by chunks give what plain loops over the whole give, and do not slow down with the square."""

import random
import time

from routinelens.model import SECOND
from routinelens.operators import association, crossings, replay


def collapse_loop(rows, window):
    """Rows (us, kind) of one rule."""
    kept = []
    for us, kind in sorted(rows):
        if kept and us - kept[-1][0] <= window:
            kept[-1] = (kept[-1][0], kind if kept[-1][1] == "time" else kept[-1][1])
        else:
            kept.append((us, kind))
    return kept


def test_collapse_across_chunks_equals_a_loop(spark):
    rng = random.Random(4)
    made = {f"r{n}": [(rng.randrange(40 * 256), rng.choice(("time", "time", "state", "numeric"))) for _ in range(n * 300)] for n in range(1, 6)}
    made["sparse"] = [(k * 100_000 - 300_000, "time") for k in range(9)]
    rows = [(r, us, kind) for r, some in made.items() for us, kind in {us: (us, kind) for us, kind in some}.values()]
    got = replay.collapse(spark.createDataFrame(rows, "rule_id string, us long, kind string").repartition(5), 7)
    want = {(r, *k) for r in made for k in collapse_loop([x[1:] for x in rows if x[0] == r], 7)}
    found = [tuple(x) for x in got.select("rule_id", "us", "kind").collect()]
    assert set(found) == want and len(found) == len(want)


def test_matching_across_chunks_equals_a_loop(spark):
    rng = random.Random(5)
    fires, truth, want = [], [], set()
    for n in range(24):
        rule, far = f"r{n}", 4000
        f = sorted({rng.randrange(far): rng.choice(("time", "state")) for _ in range(rng.choice((5, 150, 900)))}.items())
        t = sorted((rng.randrange(far), k) for k in range(rng.choice((0, 20, 300, 3000))))
        fires += [(rule, us, kind) for us, kind in f]
        truth += [(rule, us, sid) for us, sid in t]
        free = list(t)
        for us, kind in f:
            near = [x for x in free if abs(x[0] - us) <= (30 if kind == "time" else 10)]
            if near:
                free.remove(min(near, key=lambda x: (abs(x[0] - us), x)))
            want.add((rule, us, "true" if near else "false"))
        want |= {(rule, us, "missed", k) for k, (us, _) in enumerate(free)}
    got = replay.match(spark.createDataFrame(fires, "rule_id string, us long, kind string"), spark.createDataFrame(truth, "rule_id string, us long, sid long"), 30, 10).collect()
    assert {tuple(r) for r in got if r.what != "missed"} == {w for w in want if len(w) == 3}
    assert sorted(tuple(r) for r in got if r.what == "missed") == sorted(w[:3] for w in want if len(w) == 4)


def test_a_month_without_gaps_is_folded_in_linear_time(spark):
    n = 150_000
    fires = spark.range(n).selectExpr("'r' AS rule_id", f"id * {17 * SECOND} AS us", "'state' AS kind")
    truth = spark.range(n).selectExpr("'r' AS rule_id", f"id * {17 * SECOND} + 3 AS us", "id AS sid")
    began = time.time()
    found = replay.counts(replay.match(replay.collapse(fires), truth, 900 * SECOND)).first()
    assert tuple(found) == ("r", n // 4, 0, n - n // 4)
    assert time.time() - began < 60


def test_crossings_across_chunks_equal_a_loop(spark):
    rng = random.Random(6)
    lead, far = 12, 1500
    found = [(e, t, d, rng.randrange(far)) for e, many in (("s", 900), ("t", 60), ("u", 4000)) for t in (1.0, 2.0) for d in ("rising", "falling") for _ in range(many)]
    acts = [(k, rng.randrange(far)) for k, many in (("k1", 1000), ("k2", 60), ("k3", 3000)) for _ in range(many)]
    want = {}
    for kind in ("k1", "k2", "k3"):
        times = sorted(us for k, us in acts if k == kind)
        for key in sorted({f[:3] for f in found}):
            c, p, hits = sorted(f[3] for f in found if f[:3] == key), 0, 0
            for us in times:
                while p < len(c) and c[p] < us - lead:
                    p += 1
                if p < len(c) and c[p] <= us:
                    p, hits = p + 1, hits + 1
            want[(kind, *key)] = (len(c), len(times), hits)
    got = crossings.matched(spark.createDataFrame(found, "entity_id string, threshold double, direction string, us long"), spark.createDataFrame(acts, "kind string, us long"), lead)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == want


def test_crossings_are_matched_without_their_pairs(spark):
    found = spark.range(20_000).selectExpr("'s' AS entity_id", "1.0D AS threshold", "'rising' AS direction", "id AS us")
    acts = spark.range(20_000).selectExpr("concat('k', id % 4) AS kind", "id AS us")
    began = time.time()
    assert {r.kind: r.hits for r in crossings.matched(found, acts, 5000).collect()} == {f"k{i}": 5000 for i in range(4)}
    assert time.time() - began < 30  # 400 million pairs lie within the lead


def test_baskets_and_pairs_equal_loops(spark):
    rng = random.Random(7)
    items = [(k, rng.randrange(900), f"light.{rng.choice('abcdef')}=on", rng.choice(("human", "device"))) for k in range(700)] + [(1000, 5000, "light.a=on", "human"), (1001, 9000, "light.b=on", "human"), (1002, 9007, "light.c=on", "device")]
    held = {}
    for sid, us, _, cause in items:
        if cause == "human":
            firsts = {}
            for _, at, item, _ in sorted(items, key=lambda x: -x[1]):
                if abs(at - us) <= 7:
                    firsts[item] = at
            if len(firsts) > 1:
                held[sid] = firsts
    found = spark.createDataFrame(items, "sid long, us long, item string, cause string").repartition(5)
    assert sorted(tuple(r) for r in association.baskets(found, 7).select("anchor", "item", "us").collect()) == sorted((s, i, u) for s, f in held.items() for i, u in f.items())
    want = {}
    for f in held.values():
        for a in f:
            for c in f:
                n, forward = want.get((a, c), (0, 0))
                want[(a, c)] = (n + 1, forward + (f[a] < f[c]))
    want[(None, None)] = (len(held), 0)
    assert {(r.a, r.c): (r.n, r.forward) for r in association.counts(found, 7).collect()} == want
    assert association.pairs(found, 7).count() == sum(a != c for a, c in want if a)


def test_dense_baskets_do_not_pair_all_that_is_near(spark):
    found = spark.range(60_000).selectExpr("id AS sid", "id AS us", "concat('light.', id % 5, '=on') AS item", "'human' AS cause")
    began = time.time()
    assert association.baskets(found, 10_000).count() == 300_000
    assert time.time() - began < 30  # a billion pairs lie within the window
