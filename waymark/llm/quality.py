"""Quality rules as weak supervision.

Rules vote *bad*, *good* or abstain on each text.  Votes are counted by pattern
over the whole table (there are at most ``3 ** rules`` patterns, whatever the
table's size), expectation-maximisation estimates how each rule votes on good
and on bad texts, and the posterior probability of *good* decides.  That
replaces a filter in which every rule has to pass.

Null and empty texts have no words, fail the base rule and are not kept.
Repeated rows are judged alike.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import WHITE, as_bytes

_SYMBOLS = b"#*$%&|<>"
_TRAIL = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_shouts")
BAD, ABSTAIN, GOOD = -1, 0, 1
#: How often a rule may vote *bad* on good texts.
FALSE_ALARM = 0.01


def measure(text: bytes) -> tuple[int, ...]:
    """The counts named in FEATURES for one text (UTF-8)."""
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            many = Counter(windows)
            covered = 0  # words before this place are counted
            for i, window in enumerate(windows):
                if many[window] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    count = lambda chars: len(text) - len(text.translate(None, chars))
    return (n, len(text.translate(None, WHITE + _TRAIL)), count(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), count(_UPPER), count(_LOWER), text.count(b"!"))


def features(df: DataFrame, *, text_col: str = "text", prefix: str = "", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep`` and the counts of FEATURES, each named ``prefix`` + its name.  A text that is kept goes to Python once."""
    held = keep.index(text_col) if text_col in keep else len(keep)
    source = df.select(*keep, *([as_bytes(text_col).alias("__bytes")] if held == len(keep) else []))
    names = [prefix + f for f in FEATURES]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]), *(f"{n} bigint" for n in names)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(held).cast(pa.binary()).to_pylist()
                rows = np.array([measure(t or b"") for t in texts], "i8").reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(FEATURES)))], [*keep, *names])

    return source.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeated > 50 * words)


def rules(prefix: str = "") -> dict[str, Column]:
    """Each rule's vote: -1 bad, 0 abstains, 1 good."""
    c = lambda name: F.col(prefix + name).cast("double")
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    letters = c("n_upper") + c("n_lower")
    bad = lambda when: F.when(when, BAD).otherwise(ABSTAIN)
    symbols, shouts = per(c("n_symbols"), c("n_words")), per(c("n_shouts"), c("n_words"))
    repeats, copies = per(c("n_repeat_words"), c("n_words")), per(c("n_dup_lines"), c("n_lines"))
    length, variety = per(c("word_chars"), c("n_words")), per(c("n_distinct"), F.least(c("n_words"), F.lit(200.0)))
    prose = (symbols < 0.02) & (shouts < 0.02) & (c("n_upper") < 0.2 * letters) & length.between(3, 11)
    return {
        "symbols": bad(symbols > 0.1),
        "shouting": bad(shouts > 0.2),
        "capitals": bad(c("n_upper") > 0.5 * letters),
        "repeats": bad(repeats > 0.3),
        "copied_lines": bad(copies > 0.5),
        "word_length": bad((length < 2.5) | (length > 14)),
        "variety": bad(variety < 0.2),
        "prose": F.when(prose, GOOD).otherwise(ABSTAIN),
        "fresh": F.when((repeats < 0.05) & (copies < 0.2), GOOD).otherwise(ABSTAIN),
    }


@dataclass(frozen=True)
class VoteModel:
    """Log-odds of *good*: before any vote, and added by each vote of each rule."""

    prior: float
    weights: dict[str, tuple[float, float, float]]  # for -1, 0, 1

    def probability(self, prefix: str = "") -> Column:
        total = F.lit(self.prior)
        for name, vote in rules(prefix).items():
            bad, none, good = self.weights[name]
            total = total + F.when(vote == BAD, bad).when(vote == GOOD, good).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200) -> VoteModel:
    """EM over counted vote patterns for two classes.

    Rules are held to be better than chance, which also tells the classes
    apart: a good text gets a *bad* vote from a rule in at most ``FALSE_ALARM``
    of cases, and a vote never speaks for the other class.  A class keeps at
    least a thousandth of the texts and a vote keeps a smoothed count of one,
    so no table (empty, or all alike) leads to infinite weights.
    """
    m = len(names)
    votes = np.array([p for p, _ in patterns], "i8").reshape(-1, m) + 1
    counts = np.array([n for _, n in patterns], "f8")
    hot = np.zeros((len(votes), m, 3))
    np.put_along_axis(hot, votes[:, :, None], 1.0, axis=2)
    prior = 0.85
    chance = np.empty((2, m, 3))  # class (bad, good), rule, vote
    for k, (bad, good) in enumerate(((0.3, 0.15), (FALSE_ALARM, 0.6))):
        chance[k, :, 0] = np.where(hot[:, :, 0].any(axis=0), bad, 1e-4)  # a vote that a rule never casts tells nothing
        chance[k, :, 2] = np.where(hot[:, :, 2].any(axis=0), good, 1e-4)
    chance[:, :, 1] = 1 - chance[:, :, 0] - chance[:, :, 2]
    for _ in range(rounds if len(votes) else 0):
        log = np.einsum("pmv,cmv->pc", hot, np.log(chance)) + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        for k, share in ((0, 1 - good), (1, good)):
            weight = np.einsum("p,pmv->mv", counts * share, hot) + 1.0 * chance[k]
            chance[k] = np.clip(weight / weight.sum(axis=1, keepdims=True), 1e-4, 1)
        chance[1, :, 0] = np.minimum(chance[1, :, 0], FALSE_ALARM)
        chance[0, :, 0] = np.maximum(chance[0, :, 0], chance[1, :, 0])
        chance[0, :, 2] = np.minimum(chance[0, :, 2], chance[1, :, 2])
        chance[:, :, 1] = np.clip(1 - chance[:, :, 0] - chance[:, :, 2], 1e-4, 1)
        after = float(np.clip((counts * good).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        if abs(after - prior) < 1e-9:
            break
        prior = after
    log = np.log(chance[1]) - np.log(chance[0])
    return VoteModel(math.log(prior / (1 - prior)), {n: tuple(float(x) for x in log[i]) for i, n in enumerate(names)})


def fit(measured: DataFrame, prefix: str = "") -> VoteModel:
    """Count vote patterns over every row that passes the base rule, then estimate."""
    votes = rules(prefix)
    names = list(votes)
    found = measured.where(~base_failed(prefix)).select(*(v.alias(n) for n, v in votes.items())).groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).collect()
    return estimate(sorted((tuple(r[n] for n in names), r["__n"]) for r in found), names)


def judge(measured: DataFrame, model: VoteModel, prefix: str = "", threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (posterior probability) and ``kept``, each with the prefix."""
    failed = base_failed(prefix)
    quality = model.probability(prefix)
    return measured.withColumn(prefix + "base_failed", failed).withColumn(prefix + "quality", quality).withColumn(prefix + "kept", ~failed & (quality >= threshold))
