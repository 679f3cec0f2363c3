"""Household modes: a diagonal Gaussian hidden Markov model of activity bins, its number of modes chosen on bins held out.

Fits are on the last ``MAX_BINS`` bins, a bounded sample, one task for each number of modes. Decoding covers every bin of the history: forward
filtering is a product of small matrices, one a bin, and products are associative. Chunks of bins are multiplied in parallel, a
prefix scan over one matrix a chunk gives the state that each chunk starts from, and a second pass filters inside the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routinelens.functions import circular
from routinelens.storage import materialise

#: Bins used for training, the last ones of the window: 60 days of 15 minutes. Bins of a chunk.
MAX_BINS, CHUNK = 5760, 1024
#: Numbers of modes tried, restarts and rounds of a fit to choose by and of the one kept.
COUNTS = (2, 3, 4, 5)
CHOOSE, KEEP = (4, 10), (3, 25)
#: The share of bins held out, the least bins to hold out any, the least bins a mode, the standard errors that a gain must pass, how far apart in pooled
#: deviations a mode must be to be new, and the floors of variances.
HELD_OUT, LEAST_BINS, BINS_EACH, ERRORS, APART = 0.2, 1000, 200, 2.0, 1.0
FLOOR, FLOOR_SHARE = 1e-3, 0.05
SEED = 17


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    like: float = 0.0

    def flat(self) -> list[float]:
        return np.concatenate([x.ravel() for x in (self.start, self.step, self.mean, self.var, np.array([self.like]))]).tolist()

    @staticmethod
    def of(flat: list[float], k: int) -> Model:
        x = np.array(flat)
        d = (len(x) - 1 - k - k * k) // (2 * k)
        cut = np.split(x, np.cumsum([k, k * k, k * d, k * d]))
        return Model(cut[0], cut[1].reshape(k, k), cut[2].reshape(k, d), cut[3].reshape(k, d), float(cut[4][0]))


def _scaled(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities (..., bin, mode) over each bin's largest, and the logarithm of that."""
    log = -0.5 * ((x[:, None, :] - mean[..., None, :, :]) ** 2 / var[..., None, :, :] + np.log(2 * np.pi * var[..., None, :, :])).sum(axis=-1)
    top = log.max(axis=-1, keepdims=True)
    return np.maximum(np.exp(log - top), 1e-200), top[..., 0]


def fits(x: np.ndarray, k: int, restarts: int, rounds: int, floor: float, warm: Model | None = None) -> list[Model]:
    """Models by expectation-maximisation from several starts at once, which are seeded; ``warm`` is one more start."""
    rng = np.random.default_rng(SEED + k)
    mean = np.stack([x[rng.choice(len(x), k, replace=False)] + rng.normal(0, 1e-3, (k, x.shape[1])) for _ in range(restarts)])
    var = np.tile(x.var(axis=0) + floor, (restarts, k, 1))
    step = np.tile(np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), (restarts, 1, 1))
    start = np.full((restarts, k), 1 / k)
    if warm is not None:
        mean, var, step, start = (np.concatenate([a, b[None]]) for a, b in ((mean, warm.mean), (var, warm.var), (step, warm.step), (start, warm.start)))
    t, last = len(x), None
    for _ in range(rounds):
        b, top = _scaled(x, mean, var)
        b = np.ascontiguousarray(b.transpose(1, 0, 2))
        alpha, beta, scale = np.empty_like(b), np.ones_like(b), np.empty(b.shape[:2])
        now = start * b[0]
        for i in range(t):
            if i:
                now = np.matmul(alpha[i - 1][:, None, :], step)[:, 0] * b[i]
            scale[i] = now.sum(axis=1)
            alpha[i] = now / scale[i][:, None]
        back = np.ascontiguousarray(step.transpose(0, 2, 1))
        for i in range(t - 2, -1, -1):
            beta[i] = np.matmul((b[i + 1] * beta[i + 1])[:, None, :], back)[:, 0] / scale[i + 1][:, None]
        like = np.log(scale).sum(axis=0) + top.sum(axis=1)
        g = alpha * beta
        g /= g.sum(axis=2, keepdims=True)
        step = step * np.einsum("tri,trj->rij", alpha[:-1], b[1:] * beta[1:] / scale[1:, :, None])
        step = (step + 1e-12) / (step + 1e-12).sum(axis=2, keepdims=True)
        start = g[0]
        weight = g.sum(axis=0)[:, :, None] + 1e-9
        mean = np.einsum("trk,td->rkd", g, x) / weight
        var = np.maximum(np.einsum("trk,td->rkd", g, x**2) / weight - mean**2, floor)
        if last is not None and np.all(like - last < 1e-4 * np.abs(like)):
            break
        last = like
    return [Model(*parts, float(v)) for *parts, v in zip(start, step, mean, var, like)]


def stationary(step: np.ndarray) -> np.ndarray:
    """The long-run share of each mode."""
    values, vectors = np.linalg.eig(step.T)
    v = np.clip(np.real(vectors[:, np.abs(values - 1).argmin()]), 0, None)
    return v / v.sum() if v.sum() > 0 else np.full(len(step), 1 / len(step))


def filtered(x: np.ndarray, model: Model, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance of each mode of each bin given the bins up to it, and the log-likelihood of each bin given those before. ``start``: chances before the first bin's evidence."""
    b, top = _scaled(x, model.mean, model.var)
    out, like, now = np.empty_like(b), np.empty(len(b)), start
    for i in range(len(b)):
        now = (now if not i else out[i - 1] @ model.step) * b[i]
        total = now.sum()
        like[i], out[i] = np.log(total), now / total
    return out, like + top


def gap(mean_a: np.ndarray, var_a: np.ndarray, mean_b: np.ndarray, var_b: np.ndarray, floor: float) -> float:
    """How far two modes are apart, in pooled deviations."""
    return float(np.linalg.norm((mean_a - mean_b) / np.sqrt(np.maximum((var_a + var_b) / 2, floor))))


def new_mode(small: Model, large: Model, floor: float) -> bool:
    """Whether the larger model has a mode unlike all of the smaller one: splitting one mode in two also fits better, as stays are not geometric."""
    return any(min(gap(m, v, n, w, floor) for n, w in zip(small.mean, small.var)) >= APART for m, v in zip(large.mean, large.var))


def chosen(tried: dict[int, tuple[Model, np.ndarray, float]], floor: float) -> int:
    """The number of modes: from the fewest up, a larger one must add a mode of its own and gain on the best so far.

    ``tried``: model, log-likelihood of each held-out bin (empty: none held out) and BIC. The gain is the mean difference on the same bins, and must be over
    ``ERRORS`` standard errors; without bins held out, a lower BIC.
    """
    best, *rest = sorted(tried)
    for k in rest:
        (small, before, bic), (large, after, other) = tried[best], tried[k]
        if len(before) and len(after):
            d = after - before
            error = d.std(ddof=1) / np.sqrt(len(d)) if len(d) > 1 else 0.0
            gains = d.mean() > max(0.0, ERRORS * error)
        else:
            gains = other < bic
        if gains and new_mode(small, large, floor):
            best = k
    return best


def floor_of(x: np.ndarray) -> float:
    return float(max(FLOOR, FLOOR_SHARE * x.var(axis=0).mean())) if len(x) else FLOOR


def _features(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    return np.log1p(np.maximum(pdf[cols].to_numpy(float), 0))


def fit(wide: DataFrame, cols: list[str], counts: tuple[int, ...] = COUNTS) -> Model | None:
    """The model of the last ``MAX_BINS`` bins, or none if there are too few."""
    spark = wide.sparkSession
    last = wide.agg(F.max("bin")).first()[0]
    if last is None:
        return None
    seen = materialise(wide.filter(F.col("bin") > last - MAX_BINS), "training-bins")
    tries = lambda ks: seen.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int")))  # noqa: E731  a fixed handful of rows

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        x, k = _features(pdf.sort_values("bin"), cols), int(pdf["k"].iloc[0])
        floor = floor_of(x)
        cut = int(len(x) * (1 - HELD_OUT)) if len(x) >= LEAST_BINS else len(x)
        if cut < k * BINS_EACH:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("k", "model", "held", "bic", "floor")})
        model = max(fits(x[:cut], k, *CHOOSE, floor), key=lambda m: m.like)
        held = filtered(x[cut:], model, stationary(model.step))[1] if cut < len(x) else np.zeros(0)
        bic = (k - 1 + k * (k - 1) + 2 * k * x.shape[1]) * np.log(cut) - 2 * model.like
        return pd.DataFrame({"k": [k], "model": [model.flat()], "held": [held.tolist()], "bic": [bic], "floor": [floor]})

    # a few models and at most a fifth of MAX_BINS numbers each
    rows = tries(counts).groupBy("k").applyInPandas(choose, "k int, model array<double>, held array<double>, bic double, floor double").collect()
    if not rows:
        return None
    k = chosen({r["k"]: (Model.of(r["model"], r["k"]), np.array(r["held"]), r["bic"]) for r in rows}, rows[0]["floor"])
    warm = next(r["model"] for r in rows if r["k"] == k)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _features(pdf.sort_values("bin"), cols)
        made = fits(x, k, *KEEP, floor_of(x), Model.of(warm, k))
        used = lambda m: len(set(filtered(x, m, m.start)[0].argmax(axis=1).tolist()))
        return pd.DataFrame({"model": [max(made, key=lambda m: (used(m), m.like)).flat()]})

    return Model.of(tries([k]).groupBy("k").applyInPandas(keep, "model array<double>").first()["model"], k)


def chances(wide: DataFrame, cols: list[str], model: Model, chunk: int = CHUNK) -> DataFrame:
    """Per bin of the whole history the chance of each mode given the bins up to it: (bin, chances)."""
    k = len(model.step)
    keyed = wide.withColumn("chunk", F.floor((F.col("bin") - F.lit(wide.agg(F.min("bin")).first()[0] or 0)) / chunk))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        b, _ = _scaled(_features(pdf.sort_values("bin"), cols), model.mean, model.var)
        first = pdf["chunk"].iloc[0] == 0
        # the first chunk starts from the model, whatever comes in: all rows are its own
        now = np.tile(model.start * b[0], (k, 1)) if first else model.step * b[0]
        for row in b[1:]:
            now = (now / now.max()) @ model.step * row
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "product": [(now / now.max()).ravel().tolist()]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, starts = pdf.sort_values("chunk"), np.full(k, 1 / k), []
        for p in pdf["product"]:
            starts.append(now.tolist())
            now = now @ np.array(p).reshape(k, k)
            now = now / now.sum()
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "start": starts})

    def inside(key: tuple, own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("bin")
        start = model.start if key[0] == 0 else np.array(before["start"].iloc[0]) @ model.step
        p, _ = filtered(_features(own, cols), model, start)
        return pd.DataFrame({"bin": own["bin"].to_numpy(), "chances": list(p)})

    products = keyed.groupBy("chunk").applyInPandas(product, "chunk long, product array<double>")
    # one small matrix for each chunk of ten days and more
    starts = products.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(scan, "chunk long, start array<double>").select(F.col("chunk").alias("at"), "start")
    return keyed.groupBy("chunk").cogroup(starts.groupBy("at")).applyInPandas(inside, "bin long, chances array<double>")


def modes(levels: DataFrame, counts: tuple[int, ...] = COUNTS) -> DataFrame:
    """From activity (domain, bin, active) the mode of each bin: (bin, mode), modes in order of their activity; no rows if there are too few bins to fit."""
    wide = levels.groupBy("bin").pivot("domain").agg(F.first("active")).na.fill(0)
    cols = [c for c in wide.columns if c != "bin"]
    wide = materialise(wide, "bins")
    model = fit(wide, cols, counts)
    if model is None:
        return wide.filter("false").select("bin", F.lit(0).alias("mode"))
    rank = F.array(*[F.lit(int(r)) for r in np.argsort(np.argsort(model.mean.sum(axis=1)))])
    best = F.array_position("chances", F.array_max("chances")) - 1
    return chances(wide, cols, model).select("bin", F.get(rank, best.cast("int")).alias("mode"))


def occupied(decoded: DataFrame) -> DataFrame:
    """Rows (bin, mode) with the modes that any bin has numbered from 0 without gaps, in their order."""
    used = decoded.select("mode").distinct().agg(F.array_sort(F.collect_set("mode")).alias("used"))  # one row of a handful of modes
    return decoded.crossJoin(F.broadcast(used)).select("bin", (F.array_position("used", F.col("mode")) - 1).cast("int").alias("mode"))


#: Domains less active than this are not named in a summary, nor more than so many.
NAMED, TOP = 0.05, 3


def summaries(decoded: DataFrame, levels: DataFrame, minutes: int = 15, first_minute: int = 0) -> DataFrame:
    """Per mode: share of the bins, typical_time and spread_minutes around the clock, and top_domains by mean activity.

    Bins are numbered from ``first_minute`` of a day, ``minutes`` long each. Means are those of log(1 + active), as the fit sees them.
    """
    minute = (F.col("bin") * minutes + first_minute) % circular.PERIOD
    shape = decoded.groupBy("mode").agg(F.count(F.lit(1)).alias("bins"), circular.hhmm(circular.mean(minute)).alias("typical_time"), F.round(circular.std(minute), 1).alias("spread_minutes"))
    total = decoded.agg(F.count(F.lit(1)).alias("total"))  # one row
    mean = F.expm1(F.sum(F.log1p(F.greatest(F.col("active"), F.lit(0)).cast("double"))) / F.first("bins"))
    means = levels.join(decoded, "bin").join(F.broadcast(shape.select("mode", "bins")), "mode").groupBy("mode", "domain").agg(mean.alias("mean")).filter(F.col("mean") > NAMED)
    tops = means.groupBy("mode").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "domain"))), 1, TOP)["domain"].alias("top_domains"))
    told = shape.crossJoin(F.broadcast(total)).join(tops, "mode", "left")
    return told.select("mode", F.round(F.col("bins") / F.col("total"), 4).alias("share"), "typical_time", "spread_minutes", F.coalesce("top_domains", F.array().cast("array<string>")).alias("top_domains"))


def profiles(decoded: DataFrame, levels: DataFrame) -> DataFrame:
    """Per mode and domain the mean of log(1 + active): (mode, domain, mean)."""
    return levels.join(decoded, "bin").groupBy("mode", "domain").agg(F.avg(F.log1p(F.greatest(F.col("active"), F.lit(0)).cast("double"))).alias("mean"))


def aligned(decoded: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (bin, mode) under the numbers of an earlier run's modes: the order whose profiles are nearest to that run's.

    Left as it is if the runs differ in the number of modes or in their domains. Profiles are a few modes times a few domains.
    """
    tables = [frame.toPandas().pivot(index="mode", columns="domain", values="mean").fillna(0.0) for frame in (now, before)]
    new, old = tables
    if list(new.index) != list(old.index) or list(new.columns) != list(old.columns) or not len(new):
        return decoded
    gaps = ((old.to_numpy()[:, None] - new.to_numpy()[None]) ** 2).sum(axis=2) ** 0.5
    best = min(permutations(range(len(new))), key=lambda order: sum(gaps[i, j] for i, j in enumerate(order)))
    name = F.create_map(*[F.lit(int(x)) for i, j in enumerate(best) for x in (new.index[j], old.index[i])])
    return decoded.select("bin", F.element_at(name, F.col("mode")).cast("int").alias("mode"))
