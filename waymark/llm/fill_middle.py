"""Fill-in-middle examples by big-integer bit-parallelism.

A text is one big integer with a bit for each UTF-8 byte, the first byte's bit
highest.  ``bytes.translate`` turns the text into the binary digits of a class
mask (first bytes of code points, word bytes, line feeds); shifted boolean
operations on masks mark where units start and where a sentinel stands;
``int.bit_count`` gives the number of units; and the byte at which the k-th unit
starts is found by recursive halving: the half whose bit count covers k is kept,
so that the work over all halvings is that of one pass.

``transform`` cuts each text at two of its unit boundaries into prefix, middle
and suffix and writes them in one of three forms; ``restore`` rebuilds the text
from output and form.  The cuts and the form come from the SHA-256 of
``<seed>:<id>``, so a retried task, another partitioning or another run gives
the same rows.

One row out for each row in, and no shuffle; repeated rows and rows that share
an id are cut by the same numbers.  Null and empty texts, and texts that hold a
sentinel, stay plain.  A null id is hashed as if it were empty.  Texts are read
whole, at any length, in linear time; bytes that are no UTF-8 are kept, and
continuation bytes without a first byte belong to the unit before.  Columns
other than the id, the text and those named in ``keep`` are ignored; names in
``keep`` must not be names of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import WHITE, as_bytes

#: Texts that are cut in one go, and the bytes of text after which results leave the worker.
ROWS, BYTES = 256, 8 << 20


def _digits(members: Callable[[int], bool]) -> bytes:
    """A translation of bytes to the digits of a mask."""
    return bytes(0x31 if members(b) else 0x30 for b in range(256))


_FIRST = _digits(lambda b: b & 0xC0 != 0x80)
_WORD = _digits(lambda b: b not in WHITE)
_FEED = _digits(lambda b: b == 0x0A)


def mask(text: bytes, digits: bytes) -> int:
    """The class mask of a text: a bit for each byte, the first byte's highest."""
    return int(text.translate(digits), 2) if text else 0


def code_points(text: bytes) -> int:
    """Unit starts: first bytes of code points, and the first byte of the text."""
    return mask(text, _FIRST) | (1 << len(text) >> 1)


def words(text: bytes) -> int:
    """Unit starts: word bytes after white space, and the first byte of the text."""
    word = mask(text, _WORD)
    return word & ~(word >> 1) | (1 << len(text) >> 1)


def lines(text: bytes) -> int:
    """Unit starts: bytes after a line feed, and the first byte of the text."""
    return mask(text, _FEED) >> 1 | (1 << len(text) >> 1)


UNITS: dict[str, Callable[[bytes], int]] = {"code point": code_points, "word": words, "line": lines}


def select(bits: int, length: int, ranks: list[int]) -> list[int]:
    """Positions, from the highest of ``length`` bits, of the set bits of the given ranks (from 0, rising), by halving.

    A rank that there is no bit for gives ``length``.
    """
    out: list[int] = []

    def halve(part: int, at: int, size: int, wanted: list[int]) -> None:
        while wanted:
            if size == 1:
                out.extend([at] * len(wanted))
                return
            low = size // 2
            high = part >> low
            n = high.bit_count()
            left = [r for r in wanted if r < n]
            right = [r - n for r in wanted[len(left) :]]
            rest = part & ((1 << low) - 1)
            if left and right:
                halve(high, at, size - low, left)
                part, at, size, wanted = rest, at + size - low, low, right
            elif left:
                part, size = high, size - low
            else:
                part, at, size, wanted = rest, at + size - low, low, right

    n = bits.bit_count()
    halve(bits, 0, length, [r for r in ranks if r < n])
    return out + [length] * (len(ranks) - len(out))


@lru_cache(maxsize=256)
def _only(byte: int) -> bytes:
    return _digits(lambda b: b == byte)


def marks(text: bytes, mark: bytes) -> int:
    """Where a mark stands in a text: the mask of each of its bytes, shifted to the place of the first, all of them and-ed."""
    found = -1
    for at, byte in enumerate(mark):
        found &= mask(text, _only(byte)) << at
        if not found:
            break
    return found


@dataclass(frozen=True)
class Sentinels:
    """The marks before prefix, suffix and middle.

    None of them may hold another's first character but at its start, so that
    marks and pieces of text can't make up another mark where they meet.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        out = (self.prefix, self.suffix, self.middle)
        starts = {m[:1] for m in out}
        if "" in starts or len(set(out)) < 3 or any(s in m[1:] for s in starts for m in out) or any(a.startswith(b) for a in out for b in out if a is not b):
            raise ValueError("sentinels have to differ, and to hold their first characters at the start only")
        return tuple(m.encode() for m in out)


def _holds(text: bytes, sentinels: tuple[bytes, ...]) -> bool:
    # masks cost more than a search, so texts without the first byte are told at once
    return any(s[:1] in text and marks(text, s) for s in sentinels)


def cut(text: bytes, numbers: tuple[int, int, int, int], starts: Callable[[bytes], int], sentinels: tuple[bytes, bytes, bytes], fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, units of prefix and middle (plain: none), and the output."""
    if not text:
        return 0, "plain", None, None, text
    bits = starts(text)
    n = bits.bit_count()
    one, two, three, four = numbers
    if three % 100 >= fim_percent or _holds(text, sentinels):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = select(bits, len(text), [low, high])
    p, s, m = sentinels
    if four % 100 < spm_percent:
        return n, "spm", low, high - low, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", low, high - low, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def rebuilt(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """The text of an output: its pieces lie between the marks, each of which stands there once."""
    if form == "plain":
        return output
    order = sentinels if form == "psm" else (sentinels[1], sentinels[0], sentinels[2])
    at = [len(output) - marks(output, m).bit_length() for m in order]
    parts = [output[a + len(m) : b] for a, m, b in zip(at, order, [*at[1:], None])]
    prefix, suffix, middle = parts if form == "psm" else (parts[1], parts[0], parts[2])
    return prefix + middle + suffix


def numbers(id_col: str, seed: int) -> Column:
    """A row's random numbers as one string: the hex SHA-256 of ``<seed>:<id>``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)


def _mapped(source: DataFrame, kept: int, names: list[str], schema: str, f: Callable[[list[list]], list[list]], kinds: list[pa.DataType]) -> DataFrame:
    """Applies ``f`` to the columns after the first ``kept``, which pass through; results leave in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop, size = start, 0
                while stop < batch.num_rows and stop - start < ROWS and (stop == start or size + sizes[stop] <= BYTES):
                    size += sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                out = f([part.column(i).to_pylist() for i in range(kept, batch.num_columns)])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(kept)), *(pa.array(c, k) for c, k in zip(out, kinds))], names)
                start = stop

    return source.mapInArrow(run, schema)


def _kept(source: DataFrame, n: int) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:n])


def transform(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "code point", sentinels: Sentinels = Sentinels(), fim_percent: int = 90, spm_percent: int = 20, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *keep, n, form, prefix_units, middle_units, output binary``.

    ``n`` units make up the text; ``prefix_units`` and ``middle_units`` are null
    for plain rows.  Of texts without sentinels ``fim_percent`` are cut, of those
    ``spm_percent`` are written suffix first.
    """
    marks_, starts, kept = sentinels.encoded(), UNITS[unit], [id_col, *keep]
    names = [*kept, "n", "form", "prefix_units", "middle_units", "output"]
    if len(set(names)) < len(names):
        raise ValueError(f"names of the result in keep: {keep}")
    source = df.select(*kept, numbers(id_col, seed).alias("__h"), as_bytes(text_col).alias("__bytes"))

    def run(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for digest, text in zip(*columns):
            four = tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
            for column, value in zip(out, cut(text, four, starts, marks_, fim_percent, spm_percent)):
                column.append(value)
        return out

    schema = _kept(source, len(kept)) + "n bigint, form string, prefix_units bigint, middle_units bigint, output binary"
    return _mapped(source, len(kept), names, schema, run, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()])


def restore(df: DataFrame, *, sentinels: Sentinels = Sentinels(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep, restored binary`` of rows with ``form`` and ``output``; a null output is empty, a null form plain."""
    marks_ = sentinels.encoded()
    if "restored" in keep:
        raise ValueError("names of the result in keep: restored")
    source = df.select(*keep, F.coalesce("form", F.lit("plain")).alias("__form"), as_bytes("output").alias("__bytes"))

    def run(columns: list[list]) -> list[list]:
        return [[rebuilt(output, form, marks_) for form, output in zip(*columns)]]

    return _mapped(source, len(keep), [*keep, "restored"], _kept(source, len(keep)) + "restored binary", run, [pa.binary()])
