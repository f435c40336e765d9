"""Substring dedup: removes the words of passages that occurred before, by repeated-phrase automata.

A window is ``width`` consecutive words of one document.  Each word covered by a
window whose word sequence also starts earlier (smaller id, or the same id and an
earlier start) is removed; windows are judged on the input.

1. Confirm recurring passages.  In each window the phrase of ``gram`` words with
   the least hash (the first of equals) is its anchor, so equal windows have
   equal anchors, and neighbouring windows mostly share theirs: about one anchor
   for eight windows leaves a document, with a hash of the span of words that its
   windows cover.  An anchor that occurs once has no recurring
   window.  One that recurs in equal spans only has windows that recur together,
   and first where it occurs first.  Of the others, at the edges of passages, each
   different span is looked at once, where it occurs first, and its windows are
   counted one by one.
2. Compile automata.  The recurring spans go back to the shards that hold them,
   with the first places of their windows; those that adjoin make up a passage.
   Passages are compiled into Aho-Corasick automata of bounded size; words are
   coded as a few symbols from a small alphabet for each place.
3. Stream all documents of a shard through its automata, which locate every
   occurrence; windows that are not the first of their kind mark their words.

Anchors are counted within blocks of documents before they are shuffled, so one
that a third of all documents hold gives one row a block (with the numbers of
its shards, four bytes each), and spans go back to a shard once.  Counting is by
window functions over sorted rows, which spill.  Anchors are made where texts
are read; then texts go through one shuffle, to shards bounded by rows and bytes,
for spans and for occurrences.  Equality across shards is that of 128 bits of
hashes, within a shard that of the coded words.

Null and empty texts have no words.  Ids are integers; a null id counts as the
largest.  Rows that share an id have places of their own in it: of two equal
windows at the same id and start neither is earlier, so repeated rows stay as
they are.  Texts with fewer than ``width`` words lose nothing.  Texts are read
whole, at any length; a shard is as large as its largest text.  Rows that repeat
both id and text share a shard.  An empty table gives no rows.  Columns other
than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from waymark.llm.common import WHITE, as_bytes, shared_path

WIDTH = 20
#: Rows and bytes of text of a shard, in the mean.
SHARD_ROWS, SHARD_BYTES = 128, 1 << 20
#: Windows of a pattern and words of an automaton, at most (but for its last pattern).
PIECE, WORDS = 1_000, 400_000
#: Rows and bytes of text whose anchors are counted before they are shuffled.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
LAST_ID = 2**63 - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_WHITE = [bytes([w]) for w in WHITE]
_SPACE = re.compile(b"[" + re.escape(WHITE) + b"]")


_RANDOM = np.random.default_rng(12)
_LETTER = _RANDOM.integers(0, 2**64, 256, "u8")
#: Bytes of text that are hashed in one go, and of words that are hashed by themselves beyond it.
PART, LONGEST = 1 << 18, 1024
_POWER = np.cumprod(np.full(LONGEST + 1, 0x9E3779B97F4A7C17, "u8"))
_IS_WORD = np.array([b not in WHITE for b in range(256)], "u1")


def _part_hashes(text: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a part of a text, which cuts no word."""
    letters = np.frombuffer(text, "u1", high - low, low)
    word = _IS_WORD[letters]
    turns = np.flatnonzero(np.diff(word, prepend=0, append=0))
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    if not len(starts):
        return np.empty(0, "u8"), starts
    before = np.cumsum(sizes) - sizes
    inside = letters[word.view("?")]
    place = np.minimum(np.arange(len(inside)) - np.repeat(before, sizes), LONGEST)
    sums = np.add.reduceat(_LETTER[inside] * _POWER[place], before) ^ sizes.astype("u8")
    sums *= _ODD
    sums ^= sums >> np.uint64(32)
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        at = low + int(starts[i])
        sums[i] = xxh64_intdigest(memoryview(text)[at : at + int(sizes[i])], 42)
    return sums, starts + low


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a text, and the byte where it starts."""
    parts, low = [(np.empty(0, "u8"), np.empty(0, "i8"))], 0
    while low < len(text):
        high = min(low + PART, len(text))
        if high < len(text):
            # back to white space; a word that fills the part is taken as long as it is
            cut = max(text.rfind(w, low, high) for w in _WHITE)
            end = None if cut >= 0 else _SPACE.search(text, high)
            high = cut + 1 if cut >= 0 else end.start() if end else len(text)
        if high - low > PART:
            parts.append((np.array([xxh64_intdigest(memoryview(text)[low:high], 42)], "u8"), np.array([low])))
        else:
            parts.append(_part_hashes(text, low, high))
        low = high
    hashes, starts = map(np.concatenate, zip(*parts))
    return hashes, starts


def chained(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each ``k`` consecutive hashes, in order."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, seed, "u8")
    for i in range(k):
        out ^= hashes[i : i + n]
        out *= _ODD
        out ^= out >> _SHIFT
    return out


class Shard:
    """The hashes of the words of some documents, one after another, and the anchors of their windows."""

    def __init__(self, ids: list, texts: list[bytes], width: int, gram: int):
        self.width, self.gram, self.ids = width, gram, ids
        self.hashes, starts = word_hashes(b"\n".join(texts))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.sizes = np.diff(np.searchsorted(starts, begins))
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = len(self.hashes)
        self.doc_of = np.repeat(np.arange(len(ids)), self.sizes)
        ends = np.repeat(self.starts + self.sizes, self.sizes)
        #: Where windows start, as places in the shard.
        self.windows = np.flatnonzero(ends - np.arange(total) >= width)
        self.numbers = np.array([LAST_ID if i is None else i for i in ids], "i8")

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and start within the document of places in the shard."""
        doc = self.doc_of[at]
        return self.numbers[doc], at - self.starts[doc]

    def hashed(self, at: np.ndarray, seed: int) -> np.ndarray:
        """Hashes of the windows that start at those places."""
        return chained(self.hashes, self.width, seed)[at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``key, span, first, last`` of each anchor: hashes of the phrase and of the words its windows cover, and its first and last window."""
        if not len(self.windows):
            return (np.empty(0, "u8"),) * 2 + (np.empty(0, "i8"),) * 2
        phrases = chained(self.hashes, self.gram, 1)
        n = len(self.hashes) - self.width + 1
        least, at = phrases[:n].copy(), np.zeros(n, "i8")
        for i in range(1, self.width - self.gram + 1):
            other = phrases[i : i + n]
            less = other < least
            np.copyto(least, other, where=less)
            at[less] = i
        place = self.windows + at[self.windows]
        cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = self.windows[np.concatenate(([0], cuts))], self.windows[np.concatenate((cuts - 1, [len(place) - 1]))]
        window = chained(self.hashes, self.width, 2)
        span = (window[first] * _ODD) ^ (window[last] + (last - first).astype("u8"))
        return phrases[place[np.concatenate(([0], cuts))]], span * _ODD, first, last


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded rows and bytes (but for a longer text)."""
    sizes = pc.binary_length(batch.column("bytes")).to_pylist()
    start = size = 0
    for at, n in enumerate(sizes):
        if at > start and (at - start == BLOCK_ROWS or size + n > BLOCK_BYTES):
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += n
    if len(sizes) > start:
        yield batch.slice(start)


def _shard(table: pa.Table, width: int, gram: int) -> Shard:
    return Shard(table.column("id").to_pylist(), table.column("bytes").to_pylist(), width, gram)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view("i8"))


def _anchored(shard: Shard, of: np.ndarray) -> pa.RecordBatch:
    """A row for each different anchor of a block of documents: how often it occurs, where first, and in which shards (``of`` each document)."""
    one, two, first, _ = shard.anchors()
    doc, start = shard.place(first)
    number = of[shard.doc_of[first]]
    order = np.lexsort((start, doc, two, one))
    one, two, number = one[order], two[order], number[order]
    changes = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    new = np.flatnonzero(np.concatenate(([len(one) > 0], changes)))
    group = np.cumsum(np.concatenate(([0], changes))) if len(one) else np.empty(0, "i8")
    # each shard once
    by = np.lexsort((number, group))
    group, number = group[by], number[by]
    once = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (number[1:] != number[:-1])))) if len(one) else new
    ends = np.searchsorted(group[once], np.arange(len(new) + 1)).astype("i4")
    shards = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[once]))
    columns = [_signed(one[new]), _signed(two[new]), pa.array(np.diff(np.append(new, len(one)))), pa.array(doc[order][new]), pa.array(start[order][new].astype("i4")), shards]
    return pa.RecordBatch.from_arrays(columns, ["one", "two", "n", "doc", "start", "shards"])


def _coded(hashes: np.ndarray) -> tuple[str, int]:
    """Words as symbols, each place of a word with an alphabet of its own, so that words match at words only; and symbols of a word."""
    known, codes = np.unique(hashes, return_inverse=True)
    digits, base = 3, 64
    while base**digits < len(known):
        base *= 2
    out = np.empty((len(codes), digits), "<u4")
    for i in range(digits):
        out[:, i] = codes // base ** (digits - 1 - i) % base + i * base + 1
    return out.tobytes().decode("utf-32-le"), digits


@dataclass
class Recurring:
    """Of each window of a shard: whether it recurs, and the first place (id and start) of its words."""

    known: np.ndarray
    doc: np.ndarray
    start: np.ndarray


def _matched(key: np.ndarray, span: np.ndarray, found: pa.Table) -> np.ndarray:
    """The row of ``found`` that has each key and span, -1 where none has."""
    one, two = (found.column(c).to_numpy().view("u8") for c in ("one", "two"))
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    at, end, out = np.searchsorted(one, key), np.searchsorted(one, key, "right"), np.full(len(key), -1)
    open_ = np.flatnonzero(at < end)
    while len(open_):
        hit = two[at[open_]] == span[open_]
        out[open_[hit]] = order[at[open_[hit]]]
        open_ = open_[~hit]
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    return out


def _recurring(shard: Shard, found: pa.Table) -> tuple[Recurring, np.ndarray, np.ndarray]:
    """The recurring windows, and where passages of them begin and end (as windows): runs of recurring anchors."""
    n = len(shard.hashes)
    out = Recurring(np.zeros(n, "?"), np.zeros(n, "i8"), np.zeros(n, "i8"))
    key, span, first, last = shard.anchors()
    row = _matched(key, span, found)
    mine = np.flatnonzero(row >= 0)
    row, first, last = row[mine], first[mine], last[mine]
    windows = found.column("windows").combine_chunks()
    each = ~windows.is_valid().to_numpy(zero_copy_only=False)[row]
    sizes = last[each] - first[each] + 1
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(first[each], sizes) + offset
    out.known[at] = True
    out.doc[at] = np.repeat(found.column("doc").to_numpy()[row[each]], sizes)
    out.start[at] = np.repeat(found.column("start").to_numpy()[row[each]], sizes) + offset
    for i, a in zip(row[~each].tolist(), first[~each].tolist()):
        for w in windows[i].as_py():
            out.known[a + w["offset"]], out.doc[a + w["offset"]], out.start[a + w["offset"]] = True, w["doc"], w["start"]
    cut = np.flatnonzero((first[1:] != last[:-1] + 1) | (shard.doc_of[first[1:]] != shard.doc_of[first[:-1]])) + 1
    return out, first[np.concatenate(([0], cut))] if len(first) else first, last[np.concatenate((cut - 1, [len(last) - 1]))] + 1 if len(last) else last


def covered(shard: Shard, recurring: Recurring, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words of a shard to remove: the passages are compiled, and each occurrence marks its windows that are not the first of their kind."""
    import ahocorasick

    text, digits = _coded(shard.hashes)
    late = np.zeros(len(shard.hashes) + 1, "i8")
    # long passages in pieces, which together have all windows
    pieces = [(a, min(a + PIECE, b)) for a, b in zip(begin.tolist(), end.tolist()) for a in range(a, b, PIECE)]
    while pieces:
        machine, size, here = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0, []
        while pieces and size < WORDS:
            a, b = pieces.pop()
            machine.add_word(text[digits * a : digits * (b + shard.width - 1)], len(here))
            here.append((a, b))
            size += b - a + shard.width - 1
        machine.make_automaton()
        for number, a, size in zip(shard.numbers.tolist(), shard.starts.tolist(), shard.sizes.tolist()):
            if size < shard.width:
                continue
            for stop, which in machine.iter(text, digits * a, digits * (a + size)):
                low, high = here[which]
                at = (stop + 1) // digits - (high - low) - shard.width + 1
                known, doc, start = (x[low:high] for x in (recurring.known, recurring.doc, recurring.start))
                late[at : at + high - low] |= known & ((doc != number) | (start != np.arange(at - a, at - a + high - low)))
    # a word goes if one of the windows that reach it does
    reached = np.cumsum(late[:-1])
    reached[shard.width :] -= np.cumsum(late[:-1])[: -shard.width]
    return reached > 0


def _ranges(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view("i1"), [0]))))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def deduplicated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int | None = None) -> DataFrame:
    """``id_col, n_words, n_removed, removed array<struct<start, end>>, kept``: a row for each row.

    ``removed`` are ranges of words, ``kept`` the other words joined by single
    spaces.  ``gram`` is the length of anchors, three tenths of the width
    unless given; it changes the work, not the result.
    """
    gram = gram or max(1, width * 3 // 10)
    if not 1 <= gram <= width:
        raise ValueError("anchors are phrases of a window")
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    shards = 1 + max(size["n"] // SHARD_ROWS, size["bytes"] // SHARD_BYTES)
    source = df.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("bytes"), F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)).cast("int").alias("shard"))
    by_shard = source.groupBy("shard")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in _blocks(batch):
                yield _anchored(_shard(table, width, gram), table.column("shard").to_numpy())

    key, span = Window.partitionBy("one"), Window.partitionBy("one", "two")
    anchors = source.mapInArrow(anchored, "one bigint, two bigint, n bigint, doc bigint, start int, shards array<int>")
    anchors = anchors.withColumns({"total": F.sum("n").over(key), "low": F.min("two").over(key), "high": F.max("two").over(key), "first": F.min(F.struct("doc", "start")).over(span), "rows": F.sum("n").over(span)}).where("total > 1")
    path = shared_path(df.sparkSession, "anchors")
    anchors.select(F.explode("shards").alias("shard"), "one", "two", (F.col("low") != F.col("high")).alias("mixed"), "first.doc", "first.start", "rows").write.parquet(path)
    found = df.sparkSession.read.parquet(path)

    def windowed(table: pa.Table, found: pa.Table) -> pa.Table:
        mixed = found.filter(found.column("mixed"))
        if not mixed.num_rows or not table.num_rows:
            table = table.slice(0, 0)
        shard = _shard(table, width, gram)
        key, span, first, last = shard.anchors()
        doc, start = shard.place(first)
        row = _matched(key, span, mixed)
        mine = np.flatnonzero(row >= 0)
        mine = mine[(mixed.column("doc").to_numpy()[row[mine]] == doc[mine]) & (mixed.column("start").to_numpy()[row[mine]] == start[mine])]
        row, where = np.unique(row[mine], return_index=True)
        mine = mine[where]
        sizes = last[mine] - first[mine] + 1
        each = np.repeat(np.arange(len(mine)), sizes)
        offset = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = first[mine][each] + offset
        doc, start = shard.place(at)
        rows = mixed.column("rows").to_numpy()[row][each] if len(row) else np.empty(0, "i8")
        columns = [_signed(key[mine][each]), _signed(span[mine][each]), pa.array(offset, pa.int32()), _signed(shard.hashed(at, 2)), _signed(shard.hashed(at, 3)), pa.array(rows, pa.int64()), pa.array(doc), pa.array(start, pa.int32())]
        return pa.Table.from_arrays(columns, ["one", "two", "offset", "w1", "w2", "rows", "doc", "start"])

    of = Window.partitionBy("w1", "w2")
    windows = by_shard.cogroup(found.groupBy("shard")).applyInArrow(windowed, "one bigint, two bigint, offset int, w1 bigint, w2 bigint, rows bigint, doc bigint, start int")
    windows = windows.withColumns({"total": F.sum("rows").over(of), "first": F.min(F.struct("doc", "start")).over(of)}).where("total > 1")
    # a span has width - gram + 1 windows at most
    windows = windows.groupBy("one", "two").agg(F.collect_list(F.struct("offset", "first.doc", "first.start")).alias("windows"))
    mixed = found.where("mixed").join(windows, ["one", "two"]).select("shard", "one", "two", "doc", "start", "windows")
    spans = found.where("not mixed").select("shard", "one", "two", "doc", "start", F.lit(None).cast(windows.schema["windows"].dataType).alias("windows"))

    kind = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])

    def located(table: pa.Table, found: pa.Table) -> pa.Table:
        shard = _shard(table, width, gram)
        gone = covered(shard, *_recurring(shard, found)) if found.num_rows and len(shard.hashes) else np.zeros(len(shard.hashes), "?")
        rows: dict[str, list] = {name: [] for name in kind.names[1:]}
        for text, a, n in zip(table.column("bytes").to_pylist(), shard.starts.tolist(), shard.sizes.tolist()):
            words, part = text.split(), gone[a : a + n]
            lost = int(part.sum())
            rows["n_words"].append(n)
            rows["n_removed"].append(lost)
            rows["removed"].append(_ranges(part) if lost else [])
            rows["kept"].append(b" ".join(compress(words, (~part).tolist()) if lost else words))
        return pa.Table.from_arrays([table.column("id").cast(pa.int64()), *(pa.array(rows[f.name], f.type) for f in kind if f.name != "id")], schema=kind)

    schema = "id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept binary"
    out = by_shard.cogroup(spans.unionByName(mixed).groupBy("shard")).applyInArrow(located, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "removed", F.col("kept").cast("string").alias("kept"))
