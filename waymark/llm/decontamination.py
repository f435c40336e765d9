"""Benchmark decontamination by spaced-seed hashing.

A mask is a span of token positions of which some count and the rest are
ignored.  Hashes of the counted tokens at every position of the test items are
looked up at every position of the documents; a substituted token at an ignored
position does not hide a match, and three masks differ in what they ignore.
Hits on one diagonal (document place minus item place) are evidence for one
overlap.  It is verified by comparing all tokens of the item with those of the
document along the diagonal; the run of places that scores best (``GAIN`` for an
equal token, less one for each place) is the overlap.  It has to match ``share``
of the item and be dense enough, so that a token that happens to be equal far
away neither adds to a run nor spoils it.

Where no diagonal of a document and item does, passages are looked for: the best
run over bands of neighbouring diagonals that have hits, so that words put in or
left out do not part them.  A passage needs ``passage`` equal tokens (or
``share`` of a short item) and the same density.

Lookup happens inside each document's row, against the set of test hashes as a
constant, so documents are neither exploded nor shuffled; only hits leave a
row.  That holds for up to ``INLINE`` test hashes, which are counted first.
More of them are joined by a shuffle on the hash instead.

Tokens are runs of letters and digits, lower-cased.  Null and empty texts have
no tokens.  Items of fewer than ``LEAST`` tokens are too short to be evidence and
match nothing; one of ``LEAST`` tokens is found with any one of them substituted.
Repeated rows and ids are reported once per id, each row compared by itself; rows
with a null id are reported under null.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import durable, small

# Counted positions of each mask.
MASKS = ((0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 4, 6))
SPAN = 7
#: The fewest tokens of an item that counts; one of them may be substituted.
LEAST = 8
#: Test hashes that may go into the plan as a constant.
INLINE = 120_000
SHARE, DENSITY = 0.5, 0.6
#: What an equal token adds to a run's score; each place takes one away.
GAIN = 3
#: Equal tokens that make a passage, however long its item is.
PASSAGE = 16
# Fixed value: how many diagonals are read together.
# Bands of diagonals overlap by half, so any two that differ by BAND // 2 at most meet in one.
BAND = 16


def hashed_tokens(text: str) -> Column:
    """An array of token hashes; splitting may leave an empty token at the end."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"^[^\p{L}\p{N}]+", "")
    return F.transform(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))


def _hash_sql(mask: int, array: str, i: str) -> str:
    return f"xxhash64({mask}, " + ", ".join(f"get({array}, {i} + {o})" if o else f"get({array}, {i})" for o in MASKS[mask]) + ")"


def _places(array: str) -> str:
    return f"if(size({array}) >= {SPAN}, sequence(0, size({array}) - {SPAN}), cast(array() as array<int>))"


def _items(tests: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, t``: token hashes of items that are long enough."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return tests.select(F.col(item_col).alias("item"), F.transform(tokens, lambda w: F.xxhash64(w)).alias("t")).where(F.size("t") >= LEAST)


def postings(items: DataFrame) -> DataFrame:
    """``hash, mask, item, at`` for each mask and place of each item."""
    parts = [items.select("item", "t", F.explode(F.expr(_places("t"))).alias("at")).select(F.expr(_hash_sql(m, "t", "at")).alias("hash"), F.lit(m).alias("mask"), "item", "at") for m in range(len(MASKS))]
    return reduce(DataFrame.unionByName, parts)


def _hits(rows: DataFrame, known: DataFrame, inline: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, h`` that have hits, and ``row, pos, hash, mask`` of places whose hash is that of some test item."""
    each = known.select("mask", "hash").distinct()
    if each.limit(inline + 1).count() <= inline:
        by_mask: dict[int, list[int]] = {m: [] for m in range(len(MASKS))}
        for mask, value in each.collect():
            by_mask[mask].append(value)
        listed = {m: ",".join(f"{v}L" if v != -(2**63) else "(-9223372036854775807L - 1L)" for v in sorted(values)) or "null" for m, values in by_mask.items()}
        marked = rows.select("*", *(F.expr(f"filter({_places('h')}, i -> {_hash_sql(m, 'h', 'i')} in ({values}))").alias(f"p{m}") for m, values in listed.items()))
        found = durable(marked.where(" or ".join(f"size(p{m}) > 0" for m in listed)))
        pairs = ", ".join(f"transform(p{m}, i -> struct(i as pos, {_hash_sql(m, 'h', 'i')} as hash, {m} as mask))" for m in listed)
        return found.select("row", "h"), found.select("row", F.explode(F.expr(f"concat({pairs})")).alias("x")).select("row", "x.*")
    parts = [rows.select("row", "h", F.explode(F.expr(_places("h"))).alias("pos")).select("row", "pos", F.expr(_hash_sql(m, "h", "pos")).alias("hash"), F.lit(m).alias("mask")) for m in range(len(MASKS))]
    hits = durable(reduce(DataFrame.unionByName, parts).join(each, ["hash", "mask"], "left_semi"))
    return rows.join(hits.select("row").distinct(), "row", "left_semi").select("row", "h"), hits


def _best_run(places: Column) -> Column:
    """``struct<score, first, last, m>`` of the run with the best score in a sorted array of places; of equals the one that ends first, then the shortest."""
    state = "struct<s:int, f:int, m:int, last:int, score:int, first:int, stop:int, n:int>"

    def step(a: Column, p: Column) -> Column:
        kept = a["s"] - (p - a["last"] - 1)
        on = kept > 0
        s, f, m = F.when(on, kept + GAIN - 1).otherwise(GAIN - 1), F.when(on, a["f"]).otherwise(p), F.when(on, a["m"] + 1).otherwise(1)
        better = s > a["score"]
        pick = lambda x, y: F.when(better, x).otherwise(y)
        return F.struct(s.alias("s"), f.alias("f"), m.alias("m"), p.alias("last"), pick(s, a["score"]).alias("score"), pick(f, a["first"]).alias("first"), pick(p, a["stop"]).alias("stop"), pick(m, a["n"]).alias("n")).cast(state)

    return F.aggregate(places, F.struct(*(F.lit(v) for v in (0, 0, 0, -1, 0, 0, 0, 0))).cast(state), step)


def overlaps(docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, density: float = DENSITY, passage: int = PASSAGE, inline: int = INLINE) -> DataFrame:
    """``id_col, item_col, n_matched, n_item, start, length``: one row for each document and item with a verified overlap.

    ``n_matched`` counts equal tokens, ``start`` and ``length`` are in tokens of the document.
    """
    items = durable(_items(tests, item_col, item_text_col))
    known = postings(items)
    # a column that Spark takes for non-deterministic is computed once per row; else filters on what follows would be
    # pushed below it and repeat the split at every array access
    once = F.when(F.monotonically_increasing_id() >= 0, hashed_tokens(text_col))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("row"), once.alias("h"))
    held, hits = _hits(rows, known, inline)
    met = hits.join(known, ["hash", "mask"]).select("row", "item", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    equal = F.expr("filter(sequence(0, size(t) - 1), i -> get(h, i + diagonal) = t[i])")
    lined = met.join(held.dropDuplicates(["row"]), "row").join(items, "item").select("row", "item", F.size("t").alias("n"), "diagonal", equal.alias("at"))
    # each diagonal by itself (half null), and bands of diagonals; one pass, so that documents are read once
    ways = [F.struct(F.lit(None).cast("int").alias("half"), F.col("diagonal").cast("bigint").alias("band"))]
    ways += [F.struct(F.lit(h).alias("half"), F.floor((F.col("diagonal") + h * BAND // 2) / BAND).alias("band")) for h in (0, 1)]
    pairs = F.transform("at", lambda i: F.struct((i + F.col("diagonal")).alias("pos"), i.alias("at")))
    ways = lined.select("row", "item", "n", pairs.alias("pairs"), F.explode(F.array(*ways)).alias("w")).groupBy("row", "item", "n", "w").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
    # exploded, so that it is computed once and not at every use
    runs = ways.select("row", "item", "n", F.col("w.half").isNull().alias("whole"), "pairs", F.explode(F.array(_best_run(F.array_sort(F.array_distinct("pairs.pos"))))).alias("r"))
    inside = F.size(F.array_distinct(F.expr("transform(filter(pairs, x -> x.pos between r.first and r.stop), x -> x.at)")))
    lines = runs.select("row", "item", "n", "whole", F.least("r.n", inside).alias("n_matched"), F.col("r.first").alias("start"), (F.col("r.stop") - F.col("r.first") + 1).alias("length"))
    part = F.ceil(F.lit(share) * F.col("n"))
    least = F.greatest(F.lit(LEAST - 1), F.when(F.col("whole"), part).otherwise(F.least(part, F.lit(passage))))
    good = lines.where((F.col("n_matched") >= least) & (F.col("n_matched") >= F.lit(density) * F.col("length")))
    best = good.groupBy(F.col("row.id").alias("id"), "item").agg(F.max(F.struct("whole", "n_matched", (-F.col("start")).alias("back"), "length", "n")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.n_matched").cast("bigint").alias("n_matched"), F.col("b.n").cast("bigint").alias("n_item"), (-F.col("b.back")).cast("bigint").alias("start"), F.col("b.length").cast("bigint").alias("length"))


def clean(docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of contaminated ids; all columns stay, and rows with a null id go only if null is contaminated.

    The contaminated ids are written first, so that Spark knows their size when it joins them.
    """
    found = durable(overlaps(docs, tests, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("__bad")).distinct())
    return docs.join(small(found), F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
