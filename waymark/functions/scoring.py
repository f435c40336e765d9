"""Scores and labels: history factors, boosts, phases, surfaces, intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config


def elapsed_days(now: Column, ts: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000)).cast("bigint")


def recency_factor(age: Column, config: Config = DEFAULT) -> Column:
    """X01."""
    return F.when(age <= 0, config.recency_max).otherwise(1 + (config.recency_max - 1) * F.exp(-age / config.recency_days))


def churn_factor(commits: Column, config: Config = DEFAULT) -> Column:
    """X02."""
    over = F.greatest(commits - config.churn_threshold, F.lit(0))
    return F.when(commits <= config.churn_threshold, 1.0).otherwise(F.least(1 + F.log1p(over) * (config.churn_max - 1) / 5, F.lit(config.churn_max)))


def scaled(factor: Column, scale: Column | float) -> Column:
    """X03."""
    return 1 + (factor - 1) * (scale if isinstance(scale, Column) else F.lit(float(scale)))


def git_weight(age: Column, commits: Column, recency: float | Column = 1.0, churn: float | Column = 1.0, own: Column | None = None, config: Config = DEFAULT) -> Column:
    """No history counts as 1."""
    out = scaled(recency_factor(age, config), recency) * scaled(churn_factor(commits, config), churn)
    if own is not None:
        out = out * F.when(own, config.author_boost).otherwise(1.0)
    return F.coalesce(out, F.lit(1.0))


def badges(age: Column, commits: Column, config: Config = DEFAULT) -> Column:
    """X15."""
    return F.array_compact(F.array(F.when(age <= config.badge_recent_days, "recent"), F.when(commits >= config.badge_churn, "high-churn")))


def phase(age: Column, quiet: Column, commits: Column, median: Column, config: Config = DEFAULT) -> Column:
    """The first that fits."""
    return (
        F.when((age >= config.crystal_age) & (quiet >= config.crystal_quiet), "crystal")
        .when((age >= config.rotting_age) & (quiet <= config.rotting_quiet) & (commits > config.rotting_churn * median), "rotting")
        .when(age <= config.emergent_age, "emergent")
        .otherwise("evolving")
    )


def surface_label(external: Column, internal: Column, config: Config = DEFAULT) -> Column:
    """X13."""
    total = external + internal
    share = external / F.nullif(total, F.lit(0))
    return F.when(total == 0, "unknown").when(share > config.api_ratio, "api").when(1 - share > config.internal_ratio, "internal").otherwise("unknown")


# Word groups of each intent, in order of precedence.
INTENTS = (
    ("debug", (r"\b(error|bug|fix|crash|fail|exception|stacktrace|trace|debug)\b", r"\b(why|broken|not working|issue)\b")),
    ("extend", (r"\b(add|new|implement|feature|create|build)\b", r"\b(extend|enhance|support)\b")),
    ("refactor", (r"\b(refactor|clean|reorganize|simplify|restructure)\b", r"\b(improve|optimize|consolidate)\b")),
    ("explore", (r"\b(what is|how does|explain|understand|explore)\b", r"\b(show|find|list|search)\b")),
)
# Recency, churn and reverse-edge weights of each intent.
RECIPES = {"debug": (1.5, 0.8, 2.0), "explore": (1.0, 1.0, 1.0), "extend": (1.2, 0.5, 0.7), "refactor": (0.8, 2.0, 1.0)}


def intent(text: Column) -> Column:
    """Most word groups met; ties go to the earlier intent, none to ``explore``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = {name: reduce(lambda a, b: a + b, (low.rlike(p).cast("int") for p in groups)) for name, groups in INTENTS}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "explore")
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def recipe(name: Column) -> Column:
    """``struct<recency, churn, reverse>``."""
    make = lambda r: F.struct(F.lit(r[0]).alias("recency"), F.lit(r[1]).alias("churn"), F.lit(r[2]).alias("reverse"))
    out = F.when(name == "debug", make(RECIPES["debug"]))
    for key in ("extend", "refactor"):
        out = out.when(name == key, make(RECIPES[key]))
    return out.otherwise(make(RECIPES["explore"]))


def contextual_boost(ident: Column, mentioned_file: Column, focus: Column, mate: Column, config: Config = DEFAULT) -> Column:
    """The product of what applies."""
    times = lambda when, by: F.when(F.coalesce(when, F.lit(False)), by).otherwise(1.0)
    return times(ident, config.boost_ident) * times(mentioned_file, config.boost_file) * times(focus, config.boost_focus) * times(mate, config.boost_mate)


def config_score(tags: Column, detail: Column, config: Config = DEFAULT) -> Column:
    """X10."""
    return tags * config.coverage_weight + detail * config.detail_weight


def detail_bucket(place: Column, total: Column, focus: Column) -> Column:
    """By ``1 - place / total`` (place from 0); focus files in full."""
    share = 1 - place / total
    return F.when(focus, 3).when(share >= 0.8, 3).when(share >= 0.4, 2).otherwise(1)


def use_clusters(level: Column, patterns: Column) -> Column:
    """X20."""
    return (level == "low") | F.arrays_overlap(patterns, F.array(F.lit("fragmented"), F.lit("sparse"), F.lit("diffuse")))


def effective_budget(budget: int, window: int | None, focused: bool, config: Config = DEFAULT) -> int:
    """X11."""
    return budget if focused or not window else max(0, min(budget * config.no_focus_multiplier, window - config.window_padding))
