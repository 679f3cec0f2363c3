"""Options of an analysis: typed, held within bounds, with defaults for what is missing or cannot be read."""

from __future__ import annotations

import json
from types import MappingProxyType
from typing import Any

from pyspark.sql import SparkSession

#: Default, least and largest value of each option; None is no bound. A default's type is the option's type.
SETTINGS: dict[str, tuple] = {
    "analysis_window_days": (0, None, None),
    "max_auto_window_days": (60, None, None),
    "min_consistency": (0.6, 0.0, 1.0),
    "min_occurrences": (5, 2, None),
    "time_cluster_minutes": (30, None, None),
    "min_support": (0.02, 0.0, 1.0),
    "min_confidence": (0.6, 0.0, 1.0),
    "min_lift": (1.5, None, None),
    "association_window_seconds": (300, 1, None),
    "sequence_min_occurrences": (4, 2, None),
    "override_window_seconds": (120, 1, None),
    "backtest_min_precision": (0.7, 0.0, 1.0),
    "backtest_max_false_fires_per_week": (3.0, None, None),
    "backtest_match_tolerance_seconds": (900, 1, None),
    "backtest_min_true_fires": (4, 1, None),
    "backtest_min_recall": (0.25, 0.0, 1.0),
    "backtest_max_nuisance_fires": (0, 0, None),
    "backtest_holdout_fraction": (0.25, 0.0, 0.9),
    "backtest_min_holdout_days": (7, 1, None),
    "backtest_min_train_days": (14, 1, None),
    "allow_security_actions": (False, None, None),
    "health_min_days": (7, 1, None),
    "health_min_predicted_for_dormant": (3, 1, None),
    "health_noisy_override_rate": (0.3, 0.0, 1.0),
    "health_overridden_override_rate": (0.6, 0.0, 1.0),
    "health_min_fires_for_verdict": (5, 1, None),
    "health_shortfall_ratio": (0.3, 0.0, 1.0),
    "stale_automation_days": (30, 1, None),
    "excluded_domains": ((), None, None),
    "excluded_entities": ((), None, None),
    "excluded_users": ((), None, None),
    "home_mode_enabled": (True, None, None),
    "home_mode_min_train_days": (14, 1, None),
    "ranking_enabled": (True, None, None),
    "ranking_prior_strength": (30.0, 0.01, None),
    "sequence_model_enabled": (False, None, None),
    "sequence_model_min_train_days": (30, 1, None),
    "sequence_model_min_confidence": (0.75, 0.0, 1.0),
    "sequence_model_min_model_probability": (0.6, 0.0, 1.0),
    "sequence_model_min_occurrences": (5, 2, None),
}
#: Texts that mean yes, and domains that are always left out.
YES = ("1", "true", "yes", "on")
NEVER = ("persistent_notification", "update", "sun", "tts", "stt", "conversation", "assist_satellite")


def _typed(value: Any, default: Any) -> Any:
    """The value in the default's type; the default where it cannot be read so."""
    if value is None:
        return default
    if isinstance(default, bool):
        return value.strip().lower() in YES if isinstance(value, str) else bool(value)
    if isinstance(default, tuple):
        found = value.split(",") if isinstance(value, str) else value if isinstance(value, (list, tuple)) else default
        return tuple(str(v).strip() for v in found if v is not None and str(v).strip())
    try:
        made = type(default)(value)
        return made if made == made else default  # not a number
    except (TypeError, ValueError, OverflowError):
        return default


def resolve(given: dict[str, Any] | None = None) -> MappingProxyType:
    """All options, read-only; unknown names are left out.

    A bar of overridden rules below that of noisy ones is raised to it, as else no rule could be noisy only.
    """
    given = given if isinstance(given, dict) else {}
    out: dict[str, Any] = {}
    for name, (default, least, most) in SETTINGS.items():
        value = _typed(given.get(name), default)
        if least is not None:
            value = max(value, least)
        out[name] = value if most is None else min(value, most)
    out["health_overridden_override_rate"] = max(out["health_overridden_override_rate"], out["health_noisy_override_rate"])
    out["excluded_domains"] = tuple(sorted({*NEVER, *(d.lower() for d in out["excluded_domains"])}))
    out["excluded_entities"] = tuple(sorted({e.lower() for e in out["excluded_entities"]}))
    return MappingProxyType(out)


def load(spark: SparkSession, path: str) -> MappingProxyType:
    """The options of a JSON file; one that is malformed or no object gives the defaults."""
    row = spark.read.text(path, wholetext=True).first()
    try:
        return resolve(json.loads(row[0])) if row else resolve()
    except ValueError:
        return resolve()
