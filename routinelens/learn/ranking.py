"""Acceptance ranking: logistic regression centred on a prior, fitted to the few labelled decisions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.model import RISKY

#: Measures of a candidate with what is believed of them before any decision, and of their absence.
PRIOR = {
    "occurrences": 0.15, "opportunities": 0.0, "consistency": 1.2, "support": 0.4, "confidence": 1.0, "lift": 0.3, "spread_minutes": -0.3,
    "precision": 2.0, "recall": 0.8, "false_fires_per_week": -0.6, "true_fires": 0.25, "holdout_days": 0.2,
    "n_triggers": 0.0, "n_conditions": 0.1, "n_actions": 0.0, "n_entities": -0.1, "conflict_count": -0.9, "worst_conflict_severity": -0.4, "seen_count": 0.0,
}
MISSING = {"precision": -0.5}
FLAGS = {"holdout_validated": 1.0, "has_backtest": 0.3, "risky_domain": -1.0}
#: Measures that count by their logarithm, and the domains and miners that have a column each.
LOGGED = ("occurrences", "opportunities", "lift", "spread_minutes", "false_fires_per_week", "true_fires", "holdout_days", "n_entities", "conflict_count", "seen_count")
DOMAINS = ("light", "switch", "climate", "cover", "lock", "fan", "media_player", "sensor", "binary_sensor", "person", "device_tracker")
MINERS = ("time_of_day", "association", "sequence", "conditional", "motif", "energy_shift", "stale_automation", "unused_entity", "scene")
BIAS = -1.0
#: Decisions that the fit reads: the latest ones.
MAX_DECISIONS = 10_000


def prior() -> dict[str, float]:
    """Every feature in order with its weight before any decision."""
    out: dict[str, float] = {}
    for name, w in PRIOR.items():
        out[name], out[f"{name}_missing"] = w, MISSING.get(name, 0.0)
    out |= FLAGS
    out |= {f"domain_{d}": 0.0 for d in (*DOMAINS, "other")}
    return out | {f"miner_{m}": 0.0 for m in (*MINERS, "other")}


def features(candidates: DataFrame) -> list[Column]:
    """The features of candidates (measures, validation, domains array, miner), named as prior() has them; measures may be null or absent."""
    have = lambda c, kind: F.col(c).cast(kind) if c in candidates.columns else F.lit(None).cast(kind)
    out = []
    for name in PRIOR:
        v = have(name, "double")
        scaled = F.log1p(F.greatest(v, F.lit(0.0))) if name in LOGGED else v
        out += [F.coalesce(scaled, F.lit(0.0)).alias(name), v.isNull().cast("double").alias(f"{name}_missing")]
    judged = have("precision", "double").isNotNull() | have("true_fires", "double").isNotNull()
    domains = F.coalesce(have("domains", "array<string>"), F.array().cast("array<string>"))
    miner = F.coalesce(have("miner", "string"), F.lit(""))
    number = lambda c, name: F.coalesce(c, F.lit(False)).cast("double").alias(name)
    out += [number(judged & (have("validation", "string") == "holdout"), "holdout_validated"), number(judged, "has_backtest"), number(F.arrays_overlap(domains, F.array(*map(F.lit, RISKY))), "risky_domain")]
    out += [number(F.array_contains(domains, d), f"domain_{d}") for d in DOMAINS] + [number(F.size(F.array_except(domains, F.array(*map(F.lit, DOMAINS)))) > 0, "domain_other")]
    return out + [number(miner == m, f"miner_{m}") for m in MINERS] + [number(~miner.isin(*MINERS), "miner_other")]


def fit(x: np.ndarray, y: np.ndarray, centre: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps to the maximum a posteriori weights, bias first, pulled to ``centre``."""
    rows = np.hstack([np.ones((len(x), 1)), x])
    beta = centre.astype(float).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -50, 50)))
        gradient = rows.T @ (p - y) + strength * (beta - centre)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + strength * np.eye(len(beta)), gradient)
        beta -= step / max(1.0, np.abs(step).max())  # full Newton steps can overshoot from a prior that is far off
        if np.abs(step).max() < 1e-9:
            break
    return beta


def loss(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = np.clip(1 / (1 + np.exp(-(beta[0] + x @ beta[1:]))), 1e-9, 1 - 1e-9)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def train(x: np.ndarray, y: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Fitted weights if, left out one by one, they beat the prior by more than one standard error; else the prior.

    Columns are put on one scale before the fit, and so are the prior's weights; what is returned is on the columns' own scale.
    """
    if len(y) < 4:
        return centre
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = (x - mean) / spread
    there = np.concatenate(([centre[0] + mean @ centre[1:]], centre[1:] * spread))
    gains = []
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        gains.append(loss(z[i : i + 1], y[i : i + 1], there)[0] - loss(z[i : i + 1], y[i : i + 1], fit(z[rest], y[rest], there))[0])
    g = np.array(gains)
    if g.mean() <= g.std(ddof=1) / np.sqrt(len(g)):
        return centre
    beta = fit(z, y, there)
    return np.concatenate(([beta[0] - (beta[1:] / spread) @ mean], beta[1:] / spread))


def probability(beta: np.ndarray) -> Column:
    total = F.lit(float(beta[0]))
    for name, b in zip(prior(), beta[1:]):
        total = total + F.col(f"_f.{name}") * float(b)
    return 1 / (1 + F.exp(-total))


def rank(candidates: DataFrame, labelled: DataFrame) -> DataFrame:
    """``candidates`` with the acceptance probability, from decisions (candidate columns, label, decided_at); the latest MAX_DECISIONS count."""
    names = list(prior())
    centre = np.array([BIAS, *prior().values()])
    latest = labelled.orderBy(F.desc("decided_at")).limit(MAX_DECISIONS) if "decided_at" in labelled.columns else labelled.limit(0)
    rows = latest.select(F.struct(*features(latest)).alias("_f"), F.col("label").alias("_label")).select("_f.*", "_label").toPandas()
    beta = train(rows[names].to_numpy(float), rows["_label"].to_numpy(float), centre) if len(rows) else centre
    return candidates.withColumn("_f", F.struct(*features(candidates))).withColumn("probability", probability(beta)).drop("_f")


def confidence_note(decisions: int) -> str:
    """How far a probability may be trusted by the number of decisions behind it."""
    return "prior only" if decisions < 4 else "few decisions" if decisions < 20 else "learned from decisions"
