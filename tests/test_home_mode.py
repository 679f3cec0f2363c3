"""Household modes: the scan against a plain loop, the number of modes of planted homes and of noise."""

import numpy as np
import pandas as pd
import pytest

from routinelens.learn import home_mode
from routinelens.operators import activity

#: Levels of log(1 + active) of each regime.
BUSY = {2: [(1.5, 1.5, 1.5), (3, 2.5, 2)], 3: [(1.5, 1.5, 1.5), (3, 1.5, 2), (1.5, 3, 3)], 4: [(1.5, 1.5, 1.5), (3, 1.5, 1.5), (1.5, 3, 1.5), (3, 3, 3)]}


def planted(k, n, seed):
    """Regimes whose stays are of about constant length, as in homes."""
    rng = np.random.default_rng(seed)
    truth = []
    while len(truth) < n:
        truth += [(truth[-1] + 1 + rng.integers(k - 1)) % k if truth else 0] * int(rng.integers(16, 40))
    truth = np.array(truth[:n])
    return np.round(np.expm1(np.array(BUSY[k])[truth] + rng.normal(0, 0.3, (n, 3)))).clip(0), truth


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(bin=np.arange(len(x)) + 7))


@pytest.mark.parametrize("chunk", [1024, 100, 7])
def test_scan_equals_a_loop(spark, chunk):
    x, _ = planted(3, 500, 1)
    model = max(home_mode.fits(np.log1p(x), 3, 2, 5, 1e-3), key=lambda m: m.like)
    b, _ = home_mode._scaled(np.log1p(x), model.mean, model.var)
    now, want = model.start * b[0], []
    for i in range(len(b)):
        now = now if not i else now @ model.step * b[i]
        now = now / now.sum()
        want.append(now)
    got = home_mode.chances(frame(spark, x), list("abc"), model, chunk).orderBy("bin").toPandas()
    assert got["bin"].tolist() == list(range(7, 507))
    assert np.abs(np.stack(got["chances"]) - np.array(want)).max() < 1e-9


@pytest.mark.parametrize("k", [2, 3, 4])
def test_planted_homes_get_their_number_of_modes(spark, k):
    x, truth = planted(k, 2400, 10 + k)
    model = home_mode.fit(frame(spark, x), list("abc"))
    assert len(model.step) == k
    got = home_mode.chances(frame(spark, x), list("abc"), model).orderBy("bin").toPandas()
    mode = np.stack(got["chances"]).argmax(axis=1)
    assert sum(np.bincount(truth[mode == m]).max() for m in range(k) if (mode == m).any()) > 0.95 * len(x)


def test_noise_gets_two_modes(spark):
    """One regime only. Small skewed counts may get more, as a mixture fits their skew on any bins."""
    x = np.round(np.expm1(2.5 + np.random.default_rng(5).normal(0, 0.3, (2000, 3))))
    assert len(home_mode.fit(frame(spark, x), list("abc")).step) == 2


def test_few_bins(spark):
    x, _ = planted(2, 600, 3)
    assert len(home_mode.fit(frame(spark, x), list("abc")).step) == 2  # too few to hold out: by BIC
    assert home_mode.fit(frame(spark, x[:300]), list("abc")) is None and home_mode.fit(frame(spark, x).filter("false"), list("abc")) is None
    levels = spark.createDataFrame([("light", b, b % 3) for b in range(50)], "domain string, bin long, active long")
    assert home_mode.modes(levels).count() == 0


def test_buckets(spark):
    rows = spark.createDataFrame([("cover",), ("person",), ("sensor",), ("input_boolean",), ("light",)], "domain string")
    assert sorted(r["domain"] for r in activity.bucketed(rows).collect()) == ["light", "other_actionable", "presence", "switch"]
    from routinelens.model import ACTIONABLE

    assert {d for domains in activity.BUCKETS.values() for d in domains} == {*ACTIONABLE, "person", "device_tracker"}
