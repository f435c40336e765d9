"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most ``k`` bits are cut into
``k // 2 + 1`` segments, so that one segment differs by at most one bit.  Each
fingerprint is indexed by that segment whole and by the segment with one bit
left out, for each bit.  Equal keys meet, and the whole fingerprints are
compared.  Only distinct fingerprints take part, so copies of a text cost
nothing beyond one aggregation.

A key's fingerprints are compared where they lie (streamed, in sorted runs),
and what leaves a key is a spanning forest of its links, never all pairs.  A
key with more than ``LIMIT`` fingerprints is not compared but cut again: its
members agree on that segment, so the same argument holds for the remaining
bits, until at most ``2 ** 11`` fingerprints can share a key.

Components come from rounds of large-star and small-star contraction over
checkpointed edges.  Nothing that grows with the corpus goes to the driver.

Null and empty texts have no shingles and the fingerprint zero, linked like any
other.  Fewer words than ``width`` make one shingle of all words.  Repeated ids
are separate rows; their component is that of their fingerprint.  Rows with a
null id keep a null id and join the component of their fingerprint.  Ids are
integers.  Texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import as_bytes, durable, join_spread

BITS, LIMIT = 64, 2048


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (unsigned, 64 bits) have each bit set."""
    return np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: the bits that over half of them have."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """The SimHash of one text (UTF-8), unsigned."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)
    line, counts, n = b" ".join(words), np.zeros(BITS, "i8"), len(words) - width + 1
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], "<u8")
        counts += bit_counts(h)
    return majority(counts, n)


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col, fp bigint`` (the fingerprint's bits, signed)."""
    source = df.select(id_col, as_bytes(text_col).alias("__bytes"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, fp bigint"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint_of(t, width) for t in part.column(1).to_pylist()], "u8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view("i8"))], [id_col, "fp"])

    return source.mapInArrow(run, schema)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fps: np.ndarray, roots: np.ndarray, split: int, k: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one key.  split: the bit left out, of which both values must occur (-1: none)."""
    n = len(fps)
    if split >= 0:
        side = (fps >> np.uint64(split)) & np.uint64(1)
        if not side.any() or side.all():
            return [], []
        order = np.argsort(side, kind="stable")
        fps, roots, cut = fps[order], roots[order], int((side == 0).sum())
    parent = np.arange(n)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for i in range(n if split < 0 else cut):
        others = np.arange(i + 1 if split < 0 else cut, n)
        for j in others[_popcount(fps[others] ^ fps[i]) <= k]:
            x, y = top(i), top(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(int(roots[i]))
                b.append(int(roots[j]))
    return a, b


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """Adds a level's keys to ``path, lo, fp, root``: ``key``, the bit left out and where the next level's bits start."""
    size = 32 >> level  # bits of a segment; the level cuts 2 * size bits from lo on
    i = F.col("__i")
    segment = (i / F.lit(size + 1)).cast("int")
    bit = i % F.lit(size + 1)
    low = F.col("lo") + segment * size
    part = F.expr(f"shiftrightunsigned(fp, {'lo + cast(__i / ' + str(size + 1) + ' as int) * ' + str(size)})").bitwiseAND(F.lit((1 << size) - 1))
    masked = F.when(bit < size, part.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, cast(__i % {size + 1} as int))")))).otherwise(part)
    tag = F.expr("shiftleft(cast(__i as bigint), 33)").bitwiseOR(masked)
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(2 * size + 1)))).select(
        (tag if level == 0 else F.xxhash64("path", tag)).alias("key"), F.when(bit < size, low + bit).otherwise(-1).cast("int").alias("split"), (F.col("lo") + (1 - segment) * size).cast("int").alias("rest"), "fp", "root"
    )


def _compare(keyed: DataFrame, k: int, limit: int, last: bool) -> DataFrame:
    """Streams sorted runs of equal keys: links ``a, b`` (roots), or the members of keys beyond the limit (``a`` null)."""
    schema = "a bigint, b bigint, path bigint, lo int, fp bigint, root bigint"

    def run(batches):
        names = ["a", "b", "path", "lo", "fp", "root"]
        links: tuple[list[int], list[int]] = ([], [])

        def out(a=(), b=(), cols=None):
            n = len(a) if cols is None else len(cols[0])
            none = lambda t: pa.nulls(n, t)
            if cols is None:
                arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64())]
            else:
                arrays = [none(pa.int64()), none(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64())))]
            return pa.RecordBatch.from_arrays(arrays, names)

        held = None  # columns of the run that may go on in the next batch
        over = None  # the key that is beyond the limit

        def close(cols):
            key, split, _, fp, root = cols
            if len(key) > 1:
                a, b = _forest(fp.view("u8"), root, int(split[0]), k)
                links[0].extend(a)
                links[1].extend(b)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
                held = None
            if not len(cols[0]):
                continue
            key = cols[0]
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
            for s, e in zip(starts[:-1], ends[:-1]):
                if e - s > 1 or key[s] == over:
                    if key[s] == over or (e - s > limit and not last):
                        yield out(cols=[c[s:e] for c in (cols[0], cols[2], cols[3], cols[4])])
                    else:
                        close([c[s:e] for c in cols])
            s = starts[-1]
            tail = [c[s:] for c in cols]
            if key[s] == over or (len(tail[0]) > limit and not last):
                over = key[s]
                yield out(cols=[tail[0], tail[2], tail[3], tail[4]])
            else:
                held = tail
            if len(links[0]) > 20_000:
                yield out(*links)
                links = ([], [])
        if held is not None:
            close(held)
        yield out(*links)

    return keyed.mapInArrow(run, schema)


def links(distinct: DataFrame, k: int = 3, limit: int = LIMIT) -> DataFrame:
    """``a, b``: links between roots that connect all fingerprints of ``fp, root`` at ``k`` or fewer differing bits."""
    if k // 2 + 1 != 2:
        raise ValueError("k of 2 or 3: two segments, one of which differs by at most one bit")
    rows = distinct.select(F.lit(0).cast("bigint").alias("path"), F.lit(0).alias("lo"), "fp", "root")
    found = None
    for level in range(3):
        keyed = _variants(rows, level)
        sorted_runs = keyed.repartition("key").sortWithinPartitions("key")
        out = durable(_compare(sorted_runs, k, limit, level == 2))
        part = out.where("a is not null").select("a", "b")
        found = part if found is None else found.unionByName(part)
        rows = out.where("a is null").select("path", "lo", "fp", "root")
        if rows.isEmpty():
            break
    return found


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for each node that has an edge."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        pairs = both(edges)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = pairs.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = durable(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, k: int = 3, limit: int = LIMIT) -> DataFrame:
    """``id_col, fp, component_id``: one row for each row, with the smallest id reachable over links."""
    marked = durable(fingerprints(df, id_col=id_col, text_col=text_col, width=width))
    distinct = durable(marked.groupBy("fp").agg(F.min(id_col).alias("root"), F.count(F.lit(1)).alias("n")))
    label = components(links(distinct.where("root is not null").select("fp", "root"), k, limit))
    final = distinct.join(label, F.col("root") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "root").alias("component_id"))
    return join_spread(marked, durable(final), "fp", "n", marked.count()).select(id_col, "fp", "component_id")


def hex_fingerprint(column: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
