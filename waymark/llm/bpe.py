"""Byte-level BPE encoding and decoding.

Encoding runs over Arrow batches.  ``tiktoken`` encodes texts as they are, long
ones in parts: a text may be cut before every space that follows a non-space,
for no match of the splitting pattern crosses such a place and none looks behind
it.  On a million white-space characters in a row ``tiktoken`` overflows its
stack, so texts with long gaps, and all texts under other patterns, go to the
``tokenizers`` library.  Its byte-level model works on characters that stand for
bytes; merges are rebuilt from a rank file.  It gets texts cut at the places
above and around every line feed between non-spaces (whole under other
patterns), and keeps the ids of pieces it has seen in a bounded cache.

Null text: no ids.  Empty text: no ids.  Texts of any length are encoded whole.
Columns other than the id, the text and those named in ``keep`` are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a worker keeps, at some 200 bytes each; the cache is emptied when it is full.
CACHE_PIECES = 500_000
# Fixed value: the splitting pattern of which no match crosses a cut; texts are encoded whole for any other.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S)(?= )")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
# Of 512 white-space characters in a row at least 8 are among every 64th character of the text.
_STEP, _LONG_GAP = 64, re.compile(r"\s{8}")
#: Characters that are encoded at once; the ids of a part are Python integers for a while.
PART = 1 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every way to make a token of two tokens, by the rank of the result."""
    found = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found.append((rank, left, right, token[:cut], token[cut:]))
    return [(left, right) for *_, left, right in sorted(found)]


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, alphabet = read_ranks(path), byte_alphabet()
    spell = lambda token: "".join(alphabet[b] for b in token)
    model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)], ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id, by way of the characters that stand for them."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    ranks, alphabet = read_ranks(path), byte_alphabet()
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = bytes(back[c] for c in (alphabet[b] for b in token))
    return out


class PieceEncoder:
    """Encodes texts to little-endian int32 ids, piece by piece."""

    def __init__(self, path: str, pattern: str, limit: int = CACHE_PIECES):
        self.library, self.limit = tokenizer(path, pattern), limit
        self.cuts = pattern == CUT_PATTERN
        self.sizes = np.array([len(t) for t in byte_table(path)], "i8")
        self.spaced: dict[str, bytes] = {}  # by the piece without its leading space, or from its leading line feed on
        self.plain: dict[str, bytes] = {}

    def _learn(self, cache: dict[str, bytes], pieces: set[str], lead: str) -> None:
        """Encode pieces that are new.

        Pieces with a leading space that end in no space can be put one after
        another: each starts a match of its own.  So the library encodes many at
        once, and the ids are told apart by the bytes they stand for.
        """
        new = pieces.difference(cache)
        alone = [p for p in new if not lead or not p or p[-1].isspace()]
        joined = list(new.difference(alone)) if alone else list(new)
        for start in range(0, len(alone), 20_000):
            part = alone[start : start + 20_000]
            for piece, got in zip(part, self.library.encode_batch_fast([lead + p for p in part], add_special_tokens=False)):
                cache[piece] = np.array(got.ids, dtype="<i4").tobytes()
        runs = [joined[at : at + 500] for at in range(0, len(joined), 500)]
        for run, got in zip(runs, self.library.encode_batch_fast([lead + lead.join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<i4")
            whole = np.frombuffer((lead + lead.join(run)).encode(), "u1")
            ends = np.append(np.flatnonzero(whole == 0x20)[1:], len(whole))
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 4).tolist()
            raw = ids.tobytes()
            cache.update(zip(run, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [np.array(got.ids, dtype="<i4").tobytes() for got in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.spaced) + len(self.plain) > self.limit:
            self.spaced.clear()
            self.plain.clear()
        out, firsts, waiting, spaced, plain = [], [], [], set(), {"\n"}
        for text in texts:
            if any(pair in text for pair in _PAIRS) or _OTHER_SPACE.search(text):
                first, words, cache, new = None, _CUT.split(text), self.plain, plain
            else:
                first, *words = text.replace("\n", " \n").split(" ")
                plain.add(first)
                cache, new = self.spaced, spaced
            got = list(map(cache.get, words))
            out.append(got)
            firsts.append(first)
            missed = [at for at, ids in enumerate(got) if ids is None]
            new.update([words[at] for at in missed])
            waiting.append((got, missed, words, cache))
        broken = {w for w in spaced if w[:1] == "\n"}
        self._learn(self.spaced, spaced - broken, " ")
        plain.update(w[1:] for w in broken)
        self._learn(self.plain, plain, "")
        for w in broken:
            self.spaced[w] = self.plain["\n"] + self.plain[w[1:]]
        for got, missed, words, cache in waiting:
            for at in missed:
                got[at] = cache[words[at]]
        return [b"".join(got) if first is None else self.plain[first] + b"".join(got) for first, got in zip(firsts, out)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, limit: int = CACHE_PIECES) -> PieceEncoder:
    return PieceEncoder(path, pattern, limit)


@lru_cache(maxsize=4)
def coding(path: str, pattern: str):
    """``tiktoken``'s encoding for a rank file."""
    from tiktoken import Encoding

    return Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def parts(text: str) -> Iterator[str]:
    """The text, cut where its ids fall apart once ``PART`` characters are passed."""
    at = 0
    while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def text_ids(texts: list[str], path: str, pattern: str, cached: int = CACHE_PIECES) -> list[bytes]:
    """Little-endian int32 ids of each text."""
    if pattern != CUT_PATTERN:
        return encoder(path, pattern, cached).encode(texts)
    ids = coding(path, pattern).encode_ordinary
    gaps = [at for at, text in enumerate(texts) if _LONG_GAP.search(text[::_STEP])]
    found = dict(zip(gaps, encoder(path, pattern, cached).encode([texts[at] for at in gaps]))) if gaps else {}
    return [found[at] if at in found else b"".join(np.array(ids(part), "<i4").tobytes() for part in parts(text)) for at, text in enumerate(texts)]


def char_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point spans of tokens of so many bytes each; a token that holds part of a character spans it whole."""
    if not len(lengths):
        return np.empty(0, "i4"), np.empty(0, "i4")
    char = np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)
    ends = np.cumsum(lengths)
    return (char[ends - lengths] - 1).astype("i4"), char[ends - 1].astype("i4")


def coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, names: list[str], offsets: bool = False, cached: int = CACHE_PIECES) -> Iterator[pa.RecordBatch]:
    """Batches with the texts (no nulls) as last column, encoded: ``ids`` and, with ``offsets``, ``starts`` and ``ends`` instead of them."""
    sizes = np.array([len(t) for t in byte_table(path)], "i8") if offsets else None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            *kept, last = part.columns
            texts = last.to_pylist()
            found = text_ids(texts, path, pattern, cached)
            ends = np.zeros(len(found) + 1, "i4")
            np.cumsum([len(c) // 4 for c in found], out=ends[1:])
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))  # noqa: E731, B023
            arrays = [lists(np.frombuffer(b"".join(found), "<i4"))]
            if offsets:
                spans = [char_spans(t.encode(), sizes[np.frombuffer(c, "<i4")]) for t, c in zip(texts, found)]
                arrays += [lists(np.concatenate([s[i] for s in spans]) if spans else np.empty(0, "i4")) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names)


def encode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, keep: tuple[str, ...] = (), cached: int = CACHE_PIECES) -> DataFrame:
    """``id_col, *keep, ids array<int>`` and, with ``offsets``, ``starts`` and ``ends`` (code points).

    One row out for each row in, repeated rows included.  ``cached``: pieces
    whose ids a worker keeps of texts with long gaps.
    """
    kept = [id_col, *keep]
    names = [*kept, "ids", *(["starts", "ends"] if offsets else [])]
    source = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"{n} array<int>" for n in names[len(kept) :])])

    return source.mapInArrow(lambda batches: coded(batches, path, pattern, names, offsets, cached), schema)


def joined(lists: pa.ListArray, table: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of each list's ids as one value; an id without bytes takes the last, empty entry of the table.

    Arrow takes all entries at once.  Their bytes then lie one after another, so
    a list's value only needs the place of its first and last entry.
    """
    places = lists.offsets.to_numpy()
    ids = lists.values.slice(places[0], places[-1] - places[0]).fill_null(-1).to_numpy()
    none = len(table) - 1
    taken = table.take(pa.array(np.where((ids < 0) | (ids > none), none, ids)))
    starts = np.frombuffer(taken.buffers()[1], "<i4", len(taken) + 1) if len(taken) else np.zeros(1, "i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(starts[places - places[0]]), taken.buffers()[2]])


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep, decoded binary``: the bytes of each id, joined.

    Ids may split a character; the bytes join up again, and ``decoded`` cast to
    string is the text.  Null ids: empty.  An id that is null or outside the
    vocabulary adds no bytes.
    """
    source = df.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*byte_table(path), b""], pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), joined(part.column(len(keep)), table)], [*keep, "decoded"])

    return source.mapInArrow(run, schema)
