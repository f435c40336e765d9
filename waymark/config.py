"""Constants of ranking, history, packing and rendering."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

LOW, MEDIUM, HIGH = 1, 2, 3


@dataclass(frozen=True)
class Config:
    """Every tunable number; ``with_overrides`` makes a changed copy."""

    # PageRank.
    alpha: float = 0.85
    tolerance: float = 1e-6
    max_iterations: int = 100
    weight_shallow: float = 1.0
    weight_moderate: float = 0.5
    weight_deep: float = 0.1
    weight_vendor: float = 0.01
    depth_shallow: int = 2
    depth_moderate: int = 4
    focus_multiplier: float = 100.0
    vendor_patterns: tuple[str, ...] = ("node_modules", "vendor", "third_party", "torchhub", "__pycache__", "site-packages")
    # Boosts.
    boost_ident: float = 10.0
    boost_file: float = 5.0
    boost_focus: float = 20.0
    boost_mate: float = 3.0
    unranked: float = 1e-4
    # Budget and rendering.
    map_tokens: int = 24_576
    tool_tokens: int = 8_192
    no_focus_multiplier: int = 8
    window_padding: int = 1_024
    overflow_rows: int = 2_000
    overflow_files: int = 30
    coverage_weight: int = 10
    detail_weight: int = 1
    max_fields: int = 10
    count_all_below: int = 200
    sample_lines: int = 100
    stats_files: int = 500
    clusters: int = 10
    cluster_symbols: int = 5
    flat_tags: int = 20
    # History.
    recency_days: float = 30.0
    recency_max: float = 2.0
    churn_threshold: int = 5
    churn_max: float = 1.5
    author_boost: float = 1.5
    badge_recent_days: int = 7
    badge_churn: int = 10
    crystal_age: int = 180
    crystal_quiet: int = 30
    rotting_age: int = 90
    rotting_quiet: int = 14
    rotting_churn: float = 1.5
    emergent_age: int = 30
    max_commits: int = 500
    coupling: float = 0.3
    coupling_mates: int = 3
    # Structure and confidence.
    bridges: int = 5
    exact_betweenness: int = 100
    betweenness_samples: int = 100
    api_ratio: float = 0.5
    internal_ratio: float = 0.8
    gini_high: float = 0.60
    gini_diffuse: float = 0.35
    entropy_high: float = 3.5
    orphan_share: float = 0.15
    bimodality: float = 2.5

    def with_overrides(self, **changes: object) -> Config:
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})


DEFAULT = Config()
