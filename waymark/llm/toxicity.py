"""Toxicity from a learned lexicon, misspellings included, weighed by context.

The lexicon (whole terms and stems) comes from labelled rows.  Its terms form a
trie; the Levenshtein automaton of one edit is intersected with that trie, and
the product is made deterministic step by step, so that a word is looked up in
one pass over its letters whatever the lexicon's size.  Every whole term of four
letters or more may be misspelled; what a misspelled hit counts is learned from
how often labelled texts have it, so that words of ordinary texts that are one
edit from a term count little or nothing.  Each hit is weighed by a window of words around it: quotation marks and words of reporting lower it,
words of address raise it.  A logistic model, fitted on labelled rows, turns
the weighed hits of a text into a score.

Fitting uses a bounded sample: at most ``SAMPLE`` labelled rows of each label,
the first by a hash of their id; class weights restore the true ratio.  Scores
use the text alone.

Null and empty texts have no hits and get the model's base score; long texts are
read whole.  Labels that are null, or whose document is missing, are not learned
from; of unlike labels of one document the toxic one counts.  With no labels
of one kind the score is the constant share of label 1 (0.0 for none).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows of each label that fitting reads.
SAMPLE = 5_000
#: Bound of the lexicon.
TERMS = 2_000
WINDOW = 6
#: Tokens that a worker remembers, and the longest it remembers.
MEMO, LONGEST = 300_000, 64

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»‘’]")
# Words that report speech, and words that address someone.
_REPORTS = frozenset("said says quote quoted called wrote reported dijo dice dit disait sagte schrieb zitat cita citation".split())
_ADDRESS = frozenset("you your youre u ur tu eres usted vous toi du dich ihr sie".split())


class Matcher:
    """The lexicon's trie intersected with a one-edit Levenshtein automaton, determinised lazily.

    Terms are ``(letters, stem, fuzzy)``.  A state is a set of (trie node, edits
    so far).  Fuzzy whole terms may be missed by one edit (a swap of two
    neighbours counts as one); stems have to be met exactly and may be followed
    by anything.
    """

    def __init__(self, terms: list[tuple[str, bool, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.fuzzy = [False]
        self.near = {i for i, (_, stem, fuzzy) in enumerate(terms) if fuzzy and not stem}
        for number, (term, stem, fuzzy) in enumerate(terms):
            node, path = 0, [0]
            for c in term:
                following = self.child[node].get(c)
                if following is None:
                    following = len(self.child)
                    self.child[node][c] = following
                    self.child.append({})
                    self.fuzzy.append(False)
                node = following
                path.append(node)
            (self.stem if stem else self.whole)[node] = number
            if fuzzy and not stem:
                for n in path:
                    self.fuzzy[n] = True
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._close({(0, 0, "")}))
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _close(self, states: set) -> frozenset:
        """Adds what one letter left out of the word reaches (an edit)."""
        return frozenset(states | {(t, 1, "") for n, e, swap in states if not e and not swap for t in self.child[n].values() if self.fuzzy[t]})

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
        return self.ids[states]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for n, e, swap in self.sets[state]:
            if swap:  # the letters came in the wrong order: the earlier one of the term is due now
                if c == swap:
                    out.add((n, 1, ""))
                continue
            if c in self.child[n]:
                out.add((self.child[n][c], e, ""))
            if not e:
                if self.fuzzy[n]:
                    out.add((n, 1, ""))  # a letter too many
                for d, t in self.child[n].items():
                    if self.fuzzy[t]:
                        out.add((t, 1, ""))  # another letter
                        if c in self.child[t] and self.fuzzy[self.child[t][c]]:
                            out.add((self.child[t][c], 1, d))
        following = self._state(self._close(out))
        self.steps[state][c] = following
        return following

    def look_up(self, word: str) -> tuple[int, int] | None:
        """``(term, edits)`` of the nearest term: an exact one, then a stem, then one edit away."""
        state, stem = self.start, None
        for c in word:
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if not self.sets[state]:
                break
            for n, e, swap in self.sets[state]:
                if not e and not swap and n in self.stem:
                    stem = self.stem[n]
        else:
            ends = sorted((e, self.whole[n]) for n, e, swap in self.sets[state] if not swap and n in self.whole and (not e or self.whole[n] in self.near))
            if ends and not ends[0][0]:
                return ends[0][1], 0
            if stem is None and ends:
                return ends[0][1], 1
        return None if stem is None else (stem, 0)

    def token(self, raw: str) -> tuple[int, int] | None:
        """The best hit among the words of one blank-separated token."""
        if raw in self.memo:
            return self.memo[raw]
        if len(self.memo) > MEMO:
            self.memo.clear()
        found = [h for w in _WORD.findall(raw) if (h := self.look_up(w))]
        best = min(found, key=lambda h: h[1]) if found else None
        if len(raw) <= LONGEST:
            self.memo[raw] = best
        return best


#: What a misspelling counts that no ordinary text has shown, against the term itself.
UNSEEN = 0.7
#: What a text's hits come to; see ``describe``.
INPUTS = ("hits", "kinds", "share", "quoted", "addressed", "misspelled")


def describe(text: str, matcher: Matcher, strength: list[float], near_strength: list[float]) -> tuple[float, ...]:
    """The numbers named in INPUTS for one text."""
    words = text.lower().split()
    memo, token = matcher.memo, matcher.token
    hits = [(i, h) for i, w in enumerate(words) if (h := memo[w] if w in memo else token(w)) and (not h[1] or near_strength[h[0]] > 0)]
    exact = misspelled = quoted = addressed = 0.0
    for i, (term, edits) in hits:
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        weight = near_strength[term] if edits else strength[term]
        before = " ".join(words[max(0, i - WINDOW) : i])
        cited = len(_QUOTES.findall(before)) % 2 == 1 or bool(_QUOTES.match(words[i])) or any(w.strip(".,:;") in _REPORTS for w in near)
        if cited:
            quoted += weight
        elif edits:
            misspelled += weight
        else:
            exact += weight
        if not cited and any(w.strip(".,:;!?") in _ADDRESS for w in near):
            addressed += weight
    share = len(hits) / len(words) if words else 0.0
    kinds = len({t for _, (t, _) in hits})
    return (float(np.log1p(exact + misspelled)), float(np.log1p(kinds)), float(np.sqrt(share)), float(np.log1p(quoted)), float(np.log1p(addressed)), float(np.log1p(misspelled)))


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[tuple[str, bool, bool], ...] = ()
    strength: tuple[float, ...] = ()
    near_strength: tuple[float, ...] = ()  # of a misspelled hit
    weights: tuple[float, ...] = (0.0,) * (len(INPUTS) - 1)  # misspelled hits are part of hits
    bias: float = 0.0
    constant: float | None = field(default=None)


@lru_cache(maxsize=2)
def _matcher(terms: tuple[tuple[str, bool, bool], ...]) -> Matcher:
    return Matcher(list(terms))


def _described(df: DataFrame, model: ToxicityModel, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    source = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"__{n} double" for n in INPUTS)])
    terms, strength, near_strength = model.terms, list(model.strength), list(model.near_strength)

    def run(batches):
        matcher = _matcher(terms)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = np.array([describe(t, matcher, strength, near_strength) for t in part.column(len(keep)).to_pylist()], "f8").reshape(-1, len(INPUTS))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(INPUTS)))], [*keep, *(f"__{n}" for n in INPUTS)])

    return source.mapInArrow(run, schema)


def _mined(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``term, stem, hot, cold``: in how many texts of each label a word or a word's beginning occurs."""
    source = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                counts: dict[tuple[str, bool], list[int]] = {}
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = set(_WORD.findall(text.lower()))
                    terms = {(w, False) for w in words if 3 <= len(w) <= 24}
                    terms |= {(w[:k], True) for w in words for k in range(4, min(len(w), 9))}
                    for term in terms:
                        counts.setdefault(term, [0, 0])[label] += 1
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64())], ["term", "stem", "hot", "cold"])

    return source.mapInArrow(run, "term string, stem boolean, hot bigint, cold bigint").groupBy("term", "stem").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))


def choose_terms(mined: list[tuple[str, bool, int, int]], n_hot: float, n_cold: float, limit: int = TERMS) -> tuple[list[tuple[str, bool]], list[float]]:
    """Terms by how much likelier they are under label 1.

    A stem is taken only where no single word makes up most of it, and a term
    that a chosen stem covers is left out.
    """
    scored, words = [], {}
    for term, stem, hot, _ in mined:
        for k in range(4, len(term)) if not stem else ():
            words[term[:k]] = max(words.get(term[:k], 0), hot)
    for term, stem, hot, cold in mined:
        if stem and words.get(term, 0) >= 0.6 * hot:
            continue
        odds = float(np.log((hot + 0.1) / n_hot) - np.log((cold + 0.5) / n_cold))
        scored.append((odds * np.log1p(hot), odds, term, stem))
    scored.sort(key=lambda s: (-s[0], s[2], s[3]))
    terms, strength, stems = [], [], set()
    for _, odds, term, stem in scored:
        if any(term[:k] in stems for k in range(4, len(term) + 1)):
            continue
        terms.append((term, stem))
        strength.append(odds)
        if stem:
            stems.add(term)
        if len(terms) == limit:
            break
    return terms, strength


def _near_misses(labelled: DataFrame, terms: tuple, text_col: str, label_col: str) -> DataFrame:
    """``term int, hot, cold``: in how many texts of each label each term is met misspelled."""

    def run(batches):
        matcher = _matcher(terms)
        for batch in batches:
            counts: dict[int, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {h for w in set(text.lower().split()) if (h := matcher.token(w))}
                for term in {t for t, e in found if e}:
                    counts.setdefault(term, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), *(pa.array([c[y] for c in counts.values()], pa.int64()) for y in (1, 0))], ["term", "hot", "cold"])

    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y"))
    return rows.mapInArrow(run, "term int, hot bigint, cold bigint").groupBy("term").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, min_hot: int = 4, min_odds: float = 2.5) -> ToxicityModel:
    """Learn lexicon and weights from ``labels`` (``id_col, label_col``), of which at most ``sample`` per label are read."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.max("__y").alias("__y"))
    total = {r["__y"]: r["n"] for r in marked.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return ToxicityModel(constant=1.0 if 1 in total else 0.0)
    first = lambda y: marked.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = first(1).unionByName(first(0))
    # at most 2 * sample ids: a proven bound for the broadcast
    rows = documents.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col(text_col).alias("__text"), "__y")
    from waymark.llm.common import durable

    rows = durable(rows)
    seen = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return ToxicityModel(constant=total.get(1, 0) / sum(total.values()))
    odds = F.log((F.col("hot") + 0.1) / F.lit(float(seen[1]))) - F.log((F.col("cold") + 0.5) / F.lit(float(seen[0])))
    mined = _mined(rows, "__text", "__y").where(F.col("hot") >= min_hot).withColumn("odds", odds).where(F.col("odds") >= min_odds)
    top = mined.orderBy((F.col("odds") * F.log1p("hot")).desc(), "term", "stem").limit(4 * TERMS).collect()
    terms, strength = choose_terms([(r["term"], r["stem"], r["hot"], r["cold"]) for r in top], seen[1], seen[0])
    lexicon = tuple((t, stem, not stem and len(t) >= 4) for t, stem in terms)
    # smoothed as an unseen misspelling is: a little below the term itself
    near = {r["term"]: (r["hot"], r["cold"]) for r in _near_misses(rows, lexicon, "__text", "__y").collect()}
    met = lambda i: float(np.log((near[i][0] + 0.1) / seen[1]) - np.log((near[i][1] + 0.5) / seen[0]))
    near_strength = tuple(max(0.0, min(s, met(i) if near.get(i, (0, 0))[1] else UNSEEN * s)) for i, s in enumerate(strength))
    model = ToxicityModel(lexicon, tuple(strength), near_strength)
    got = _described(rows, model, "__text", ("__y",)).collect()
    x = np.array([[r[f"__{n}"] for n in INPUTS[:-1]] for r in got])
    y = np.array([r["__y"] for r in got], "f8")
    weight = np.where(y == 1, total[1] / seen[1], total[0] / seen[0])
    weight *= len(y) / weight.sum()
    beta = _logistic(x, y, weight)
    return ToxicityModel(lexicon, model.strength, near_strength, tuple(float(b) for b in beta[:-1]), float(beta[-1]))


def score(df: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep, score`` (0 to 1, higher: likelier toxic) and the weighed ``hits``, of which ``misspelled``, ``quoted`` (left out of hits) and ``addressed``."""
    if model.constant is not None:
        return df.select(*keep, F.lit(float(model.constant)).alias("score"), *(F.lit(0.0).alias(n) for n in ("hits", "misspelled", "quoted", "addressed")))
    total = F.lit(model.bias)
    for name, weight in zip(INPUTS, model.weights):
        total = total + F.lit(weight) * F.col(f"__{name}")
    rows = _described(df, model, text_col, keep)
    return rows.select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("score"), *(F.expm1(f"__{n}").alias(n) for n in ("hits", "misspelled", "quoted", "addressed")))
