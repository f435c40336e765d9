"""Packing token ids into rows of fixed length.

Best-fit decreasing: within a shard of documents, pieces are placed longest
first into the row with the least room that still holds them.  A segment tree
over room sizes finds that row in ``log(row length)`` steps.  A document longer
than a row is split losslessly into pieces; each piece notes its document and
its place there, so the documents can be put together again.

Shards are runs of documents within a task, bounded by ``shard_tokens``; no
shuffle takes place, so which documents share a row depends on the partitions.
Only the last shard of a task can be small, and only a shard's last rows are
part-filled.  Each row gives its ids as a little-endian matrix row, the
cumulative segment lengths, and the places where positions start again at 0.

Files hold a binary record per row: five int64 (shard, row, tokens, segments,
row length), the matrix row, cumulative lengths and resets (int32), documents
(int64) and their offsets (int32).  Every record follows from its head, so files
can be read by any program; Spark's text writer puts a line feed after each.

Null ids of a document or an empty document: only the end token (no row at all
if ``end_id`` is null).  An id that is null or does not fit ``width`` bytes is an
error, never another id.  Document ids are integers; null ones stay null (the
least int64 in files).  Repeated documents are packed as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RoomTree:
    """Which room sizes have an open row: a bit per size, OR-ed up a binary tree."""

    def __init__(self, largest: int):
        self.size = 1 << (largest + 1).bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(largest + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(room, row)`` with the least room of at least ``need``."""
        i = need + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while i and not (i < self.size and (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = 0
                i >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], row_length: int) -> list[list[int]]:
    """Rows of piece numbers; lengths are 1 to ``row_length``."""
    tree, rows = RoomTree(row_length), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[piece]
        found = tree.take(n)
        if found is None:
            rows.append([])
            found = (row_length, len(rows) - 1)
        room, row = found
        rows[row].append(piece)
        if room > n:
            tree.add(room - n, row)
    return rows


NAMES = ["shard", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]
SCHEMA = "shard bigint, row bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_offsets array<int>"
_KIND = {2: "<u2", 4: "<u4"}
_NO_ID = -(2**63)


def narrow(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids of so many bytes; ValueError if one does not fit."""
    if ids.dtype.kind == "f" or (len(ids) and (ids.min() < 0 or ids.max() >> (8 * width))):
        raise ValueError(f"a token id is null or does not fit {width} bytes")
    return ids.astype(_KIND[width])


def _rows(batches: Iterator[pa.RecordBatch], row_length: int, end_id: int | None, pad_id: int, width: int, shard_tokens: int) -> Iterator[tuple]:
    """``shard, row, matrix row, cumulative lengths, documents, offsets`` of each packed row."""
    context = TaskContext.get()
    shard, held, total = (context.partitionId() if context else 0) << 32, [], 0
    tail = np.array([] if end_id is None else [end_id], _KIND[width])

    def packed():
        pieces = [(doc, at, ids[at : at + row_length]) for doc, ids in held for at in range(0, len(ids), row_length)]
        for number, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], row_length)):
            segments = [pieces[i] for i in members]
            ends = np.cumsum([0, *(len(s[2]) for s in segments)], dtype="<i4")
            matrix = np.full(row_length, pad_id, _KIND[width])
            matrix[: ends[-1]] = np.concatenate([s[2] for s in segments])
            yield shard, number, matrix, ends, [s[0] for s in segments], [s[1] for s in segments]

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            # a copy: what is held must not keep the batch alive
            whole = np.concatenate((narrow(ids.values.to_numpy(zero_copy_only=False), width), tail))
            held.append((doc, whole))
            total += len(whole)
            if total >= shard_tokens:
                yield from packed()
                shard, held, total = shard + 1, [], 0
    yield from packed()


def _source(df: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of ``shard, row, matrix row, ends, documents, offsets``."""
    shard, number, matrix, ends, docs, offsets = zip(*rows)

    def lists(parts, kind):
        at = np.cumsum([0, *map(len, parts)], dtype="i4")
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts), kind) if at[-1] else pa.array([], kind))

    known = [np.array([_NO_ID if d is None else d for d in part], "i8") for part in docs]
    ids = lists(known, pa.int64())
    if any((k == _NO_ID).any() for k in known):
        ids = pa.array([[None if d == _NO_ID else d for d in k.tolist()] for k in known], pa.list_(pa.int64()))
    arrays = [pa.array(shard, pa.int64()), pa.array(number, pa.int64()), pa.array([int(e[-1]) for e in ends], pa.int32()), pa.array([m.tobytes() for m in matrix], pa.binary())]
    arrays += [lists(ends, pa.int32()), lists([e[:-1] for e in ends], pa.int32()), ids, lists([np.asarray(o, "i4") for o in offsets], pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 256)):
        yield _batch(part)


def pack(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", row_length: int = 2048, end_id: int | None = None, pad_id: int = 0, width: int = 2, shard_tokens: int = 2_000_000) -> DataFrame:
    """Packed rows of an ``id_col bigint, ids_col array<int>`` table.

    ``shard, row, n_tokens, ids binary`` (``row_length`` ids of ``width`` bytes,
    padded), ``cu_seqlens array<int>`` (0 and the end of each segment),
    ``position_resets array<int>`` (where positions start at 0), ``doc_ids
    array<bigint>`` and ``doc_offsets array<int>`` (each segment's document and
    its place in it).
    """

    def run(batches):
        yield from _batches(_rows(batches, row_length, end_id, pad_id, width, shard_tokens))

    return _source(df, id_col, ids_col).mapInArrow(run, SCHEMA)


def write(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids", row_length: int = 2048, end_id: int | None = None, pad_id: int = 0, width: int = 2, shard_tokens: int = 2_000_000, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> None:
    """Pack as ``pack`` does and write files of binary records, in any store that Spark can write.

    With ``encode``, ``ids_col`` holds texts (null: empty) and ``encode`` makes their
    ids from batches of both columns, in the worker that packs them.
    """

    def record(shard, number, matrix, ends, docs, offsets) -> bytes:
        head = np.array([shard, number, ends[-1], len(docs), len(matrix)], "<i8")
        known = np.array([_NO_ID if d is None else d for d in docs], "<i8")
        return b"".join(part.tobytes() for part in (head, matrix, ends, ends[:-1], known, np.array(offsets, "<i4")))

    def run(batches):
        rows = _rows(encode(batches) if encode else batches, row_length, end_id, pad_id, width, shard_tokens)
        while part := list(islice(rows, 256)):
            yield pa.RecordBatch.from_arrays([pa.array([record(*r) for r in part], pa.binary())], ["record"])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(ids_col, F.lit("")).alias("text")) if encode else _source(df, id_col, ids_col)
    records = source.mapInArrow(run, "record binary")
    # a file holds 16,384 records at most, which bounds its size by the row length
    records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", 16_384).text(path)


def read(spark: SparkSession, path: str, *, width: int = 2) -> DataFrame:
    """The packed rows, as ``pack`` gives them, of the files below ``path``."""

    def rows(data: memoryview):
        at = 0
        while at < len(data):
            shard, number, tokens, n, row_length = np.frombuffer(data, "<i8", 5, at).tolist()
            at += 40
            matrix = np.frombuffer(data, _KIND[width], row_length, at)
            at += row_length * width
            ends, resets = np.frombuffer(data, "<i4", n + 1, at), np.frombuffer(data, "<i4", n, at + 4 * n + 4)
            if ends[-1] != tokens or (ends[:-1] != resets).any():
                raise ValueError("a packed record is damaged")
            at += 8 * n + 4
            docs, offsets = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<i4", n, at + 8 * n)
            at += 12 * n + 1
            yield shard, number, matrix, ends, docs.tolist(), offsets

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(rows(memoryview(content.as_buffer())))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id, doc_offset, ids binary``: the segments of packed rows, for putting documents together again."""
    i = F.explode(F.sequence(F.lit(1), F.size("doc_ids"))).alias("i")
    start, end = "cu_seqlens[i - 1]", "cu_seqlens[i]"
    return packed.where("size(doc_ids) > 0").select("*", i).select(F.expr("doc_ids[i - 1]").alias("doc_id"), F.expr("doc_offsets[i - 1]").alias("doc_offset"), F.expr(f"substring(ids, {start} * {width} + 1, ({end} - {start}) * {width})").alias("ids"))
