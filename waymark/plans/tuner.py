"""Presets and overrides of ranking settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from waymark.config import DEFAULT, Config

# Heuristics and the settings that their parameters stand for.
HEURISTICS: dict[str, dict[str, str]] = {
    "depth_weight": {"root": "weight_shallow", "moderate": "weight_moderate", "deep": "weight_deep", "vendor": "weight_vendor"},
    "chat_boost": {"multiplier": "boost_focus"},
    "git_recency": {"max_boost": "recency_max", "decay_days": "recency_days"},
    "git_churn": {"max_boost": "churn_max", "threshold": "churn_threshold"},
    "temporal_coupling": {"boost": "boost_mate"},
    "caller_boost": {"bias": "reverse_bias"},
    "mentioned_idents": {"boost": "boost_ident"},
    "pagerank_alpha": {"alpha": "alpha"},
    "symbol_vs_file": {"symbol_rank": "symbol_rank"},
    "vendor_filter": {},
    "orphan_filter": {},
    "exclude_unranked": {"enabled": "exclude_unranked", "threshold": "unranked"},
}
# Presets.
_DEPTH = {"root": 1.0, "moderate": 0.5, "deep": 0.25, "vendor": 0.01}
_COMMON = {"pagerank_alpha": {"alpha": 0.85}, "symbol_vs_file": {"symbol_rank": True}}
PRESETS: dict[str, dict[str, dict]] = {
    "default": {"depth_weight": _DEPTH, "chat_boost": {"multiplier": 20.0}, "temporal_coupling": {"enabled": True, "boost": 1.5}, "vendor_filter": {"enabled": True}} | _COMMON,
    "minimal": dict(_COMMON),
    "debug": {"depth_weight": _DEPTH, "chat_boost": {"multiplier": 30.0}, "git_recency": {"enabled": True, "max_boost": 3.0, "decay_days": 14}, "caller_boost": {"enabled": True, "bias": 3.0}} | _COMMON,
    "refactor": {"depth_weight": _DEPTH, "chat_boost": {"multiplier": 10.0}, "git_churn": {"enabled": True, "max_boost": 2.5, "threshold": 3}, "temporal_coupling": {"enabled": True, "boost": 2.0}} | _COMMON,
    "explore": {"depth_weight": {"root": 0.8, "moderate": 0.6, "deep": 0.4, "vendor": 0.1}, "chat_boost": {"multiplier": 5.0}, "vendor_filter": {"enabled": True}} | _COMMON,
}
_SWITCHED = ("git_recency", "git_churn", "caller_boost", "temporal_coupling")


@dataclass(frozen=True)
class TunerState:
    """Enabled heuristics with their parameters."""

    enabled: dict[str, dict] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TunerState:
        return cls(json.loads(text).get("enabled", {}))

    @classmethod
    def preset(cls, name: str) -> TunerState:
        return cls(PRESETS[name])

    def warnings(self) -> list[str]:
        """X53."""
        return [f"unknown heuristic: {name}" for name in self.enabled if name not in HEURISTICS]


def overrides(state: TunerState) -> dict[str, object]:
    """Settings by name; switched heuristics count only where enabled, and history ones turn history on."""
    out: dict[str, object] = {}
    for name, values in state.enabled.items():
        if name in _SWITCHED and not values.get("enabled", False):
            continue
        if name in ("git_recency", "git_churn"):
            out["git_weight"] = True
        out |= {setting: values[key] for key, setting in HEURISTICS.get(name, {}).items() if key in values}
    return out


def configured(state: TunerState, config: Config = DEFAULT) -> Config:
    """Q24: overrides take effect."""
    return config.with_overrides(**overrides(state))
