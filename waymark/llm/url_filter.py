"""URL filters: path rules first, else gradient-boosted trees on lexical features.

Everything that touches rows is a column expression: parsing, rules, features
and the trees, which are compiled to ``CASE`` expressions.  Suffixes are counted
over all labelled urls; one that less than a thousandth of them have shares its
odds with all such.  Trees are fitted on the driver from a bounded sample of
different labelled urls (``SAMPLE`` of each label, the first by a hash of the
url), weighed by how often they occur.  Labels are an argument: any table of urls
with a ``label``; ``labelled`` makes one of a list of host labels.

A null url, or one without ``://``, has an empty host and an empty path; no rule
fits it and the trees judge its (empty) features.  With labels of one kind only
the verdict is that label's.  Repeated rows are judged alike, very long urls as a
whole; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import durable

#: Bound of the labelled urls of each label that fitting reads.
SAMPLE = 2_000
#: What stands for suffixes that less than one in SUFFIXES labelled urls has; so at most as many have odds of their own.
RARE, SUFFIXES = "*", 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rules by verdict; a rule is a host and a path prefix.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
# Host labels that mark a url as unwanted, the source of url labels.
UNWANTED = ("spam-farm", "adult-x", "casino-win", "free-bets", "cheap-pills", "ads-track")


def parse(df: DataFrame, url_col: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url_col}`, ''), instr(coalesce(`{url_col}`, ''), '://') + 3)")).otherwise("")
    name = F.regexp_extract(F.col("__rest"), r"^[^/?#]*", 0)
    out = df.withColumn("__rest", rest).withColumn("__name", name)
    tail = F.expr("substring(__rest, length(__name) + 1)")
    return out.withColumn(host, F.translate("__name", _UPPER, _LOWER)).withColumn(path, F.regexp_extract(tail, r"^[^?#]*", 0)).drop("__rest", "__name")


def rule_for(host: str = "host", path: str = "path", rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is outermost
        site, slash, below = rule.partition("/")
        fits = ((F.col(host) == site) | F.col(host).endswith("." + site)) & F.col(path).startswith(slash + below)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "hyphen_in_name", "longest_label", "name_length", "vowel_ratio", "suffix_odds")


def featured(df: DataFrame, suffixes: dict[str, float], url_col: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``__f_*`` columns for FEATURES."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = lambda c: F.length(c).cast("double")
    without = lambda c, chars: size(c) - size(F.translate(c, chars, ""))
    labels = F.split(F.col(host), r"\.")
    n = F.greatest(size(F.col(host)), F.lit(1.0))
    entropy = F.lit(0.0)
    for c in _LOWER + "0123456789-.":
        share = without(F.col(host), c) / n
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    suffix = F.element_at(labels, -1)
    odds = F.lit(suffixes.get(RARE, 0.0))
    for name, value in suffixes.items():
        odds = F.when(suffix == name, value).otherwise(odds)
    name = F.when(F.size(labels) >= 3, F.get(labels, F.size(labels) - 3)).otherwise(F.get(labels, F.lit(0)))
    name = F.coalesce(name, F.lit(""))
    columns = {
        "url_length": size(url), "host_length": size(F.col(host)), "path_length": size(F.col(path)), "depth": without(F.col(path), "/"), "host_labels": F.size(labels).cast("double"),
        "digit_ratio": without(url, "0123456789") / F.greatest(size(url), F.lit(1.0)), "entropy": entropy, "parameters": F.when(F.instr(url, "?") > 0, without(url, "&") + 1).otherwise(0.0),
        "hyphens": without(F.col(host), "-"), "hyphen_in_name": without(name, "-"), "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"), "name_length": size(name),
        "vowel_ratio": without(name, "aeiou") / F.greatest(size(name), F.lit(1.0)), "suffix_odds": odds,
    }
    return df.select("*", *(columns[f].alias(f"__f_{f}") for f in FEATURES))


@dataclass(frozen=True)
class Tree:
    """A leaf (``feature`` below 0), or a question: is the feature at most ``cut``?"""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def column(self) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(F.col(f"__f_{FEATURES[self.feature]}") <= self.cut, self.low.column()).otherwise(self.high.column())

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.apply(x), self.high.apply(x))


@dataclass(frozen=True)
class UrlModel:
    base: float
    trees: tuple[Tree, ...]
    suffixes: tuple[tuple[str, float], ...]

    def probability(self) -> Column:
        """That the url is unwanted, from ``__f_*`` columns."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float, least: float = 1.0, ridge: float = 1.0) -> Tree:
    """A regression tree on second-order statistics; every midpoint between two values of a feature is tried."""
    g, h = gradient.sum(), hessian.sum()
    leaf = Tree(value=float(rate * g / (h + ridge)))
    if depth == 0 or len(x) < 2:
        return leaf
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        gl, hl = np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        gain[(v[1:] <= v[:-1]) | (hl < least) | (h - hl < least)] = -1
        if len(gain) and gain.max() > best[0]:
            i = int(gain.argmax())
            best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    _, f, cut = best
    if f < 0:
        return leaf
    left = x[:, f] <= cut
    return Tree(0.0, f, cut, _grow(x[left], gradient[left], hessian[left], depth - 1, rate, least, ridge), _grow(x[~left], gradient[~left], hessian[~left], depth - 1, rate, least, ridge))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3) -> tuple[float, tuple[Tree, ...]]:
    """Gradient boosting for the logistic loss."""
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    total, out = np.full(len(y), base), []
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, weight * (y - p), weight * p * (1 - p), depth, rate, least=0.5)
        out.append(tree)
        total = total + tree.apply(x)
    return base, tuple(out)


def labelled(urls: DataFrame, unwanted=UNWANTED, host: str = "host") -> DataFrame:
    """Urls with ``label``: 1 if one of the host's labels is listed as unwanted."""
    return urls.withColumn("label", F.arrays_overlap(F.split(F.col(host), r"\."), F.array(*map(F.lit, unwanted))).cast("int"))


def fit(known: DataFrame, *, url_col: str = "url", sample: int = SAMPLE) -> UrlModel:
    """Fit from parsed urls with ``label`` (0 or 1; nulls are left out)."""
    known = known.where(F.col("label").isin(0, 1))
    distinct = durable(known.groupBy(url_col, "host", "path", "label").agg(F.count(F.lit(1)).alias("__n")))
    total = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.sum("__n").alias("n")).collect()}
    if not total:
        return UrlModel(-20.0, (), ())
    n_bad, n_all = total.get(1, 0), sum(total.values())
    suffix = F.element_at(F.split("host", r"\."), -1)
    counted = distinct.groupBy(suffix.alias("s")).agg(F.sum(F.col("label") * F.col("__n")).alias("bad"), F.sum("__n").alias("n"))
    own = F.col("n") * SUFFIXES >= n_all
    counted = counted.groupBy(F.when(own, F.col("s")).otherwise(RARE).alias("s")).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).orderBy("s").collect()
    suffixes = tuple((r["s"], float(np.log((r["bad"] + 0.5) / (n_bad + 1)) - np.log((r["n"] - r["bad"] + 0.5) / (n_all - n_bad + 1)))) for r in counted)
    first = lambda y: distinct.where(F.col("label") == y).orderBy(F.xxhash64(url_col), url_col).limit(sample)
    rows = featured(first(1).unionByName(first(0)), dict(suffixes), url_col).select("label", "__n", *(f"__f_{f}" for f in FEATURES)).collect()
    x, y = np.array([[r[f"__f_{f}"] for f in FEATURES] for r in rows], "f8"), np.array([r["label"] for r in rows], "f8")
    weight = np.array([r["__n"] for r in rows], "f8")
    weight *= np.where(y == 1, n_bad / max(1.0, (weight * y).sum()), (n_all - n_bad) / max(1.0, (weight * (1 - y)).sum()))
    base, trees = boost(x, y, weight * len(y) / weight.sum())
    return UrlModel(base, trees, suffixes)


def judge(urls: DataFrame, model: UrlModel, *, url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Parsed urls with ``rule``, ``verdict`` and ``unwanted`` (the model's probability)."""
    rule, verdict = rule_for(rules=rules)
    out = featured(urls, dict(model.suffixes), url_col).withColumn("unwanted", model.probability()).withColumn("rule", rule)
    out = out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("unwanted") >= threshold, "block").otherwise("allow")))
    return out.drop(*(f"__f_{f}" for f in FEATURES))
