"""Conversation prefix trie by partition refinement.

All conversations start in one class, the root.  A round splits the active
classes by their next turn: classes by equal role and text are the nodes of the
next depth, named by their smallest member.  A class of one conversation is
retired: the rest of it is a chain of nodes with one child each, which are
emitted as they are, without further rounds.  The rounds end when no class of
several conversations goes on, so there are as many as the longest prefix that
two conversations share has turns, and a round reads one depth of the turns.
Then counts are folded back from the deepest level to the root: children, leaves
and the words that a prefix shared by several conversations would save.

Turns are rows from begin to end.  Places within a conversation come from a range
partitioning with offsets, so a conversation of any length spreads over tasks;
classes are counted before they meet their members, and the members of large
classes are joined by broadcast (``join_spread``), so no task holds a class.
Only ``ends_digest`` reads the members of a node in one task, as SHA-256 has to
take them in order: as a stream of chunks, each of many ids.

Turns go by number, null first, ties by the hash of role and text; repeated rows
are turns of their own.  Null roles and texts are empty.  Ids are integers; rows
without an id belong to no conversation and are left out.  A conversation without
turns (see ``shared_openings``) is a member of the root only.  No conversations:
no nodes, not even a root.  Columns other than the four named are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import drop_path, durable, join_spread, shared_path

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of ids that are digested in one go.
CHUNK = 16_384


def numbered(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, at, key, words``: a row for each turn, with its place from 0, the hash of role and text, and the text's words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = df.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")).where("conv is not null")
    # equal rows are told apart, so that they can go to several partitions
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    cells = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    cells = durable(cells.select("conv", "key", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("cell")))
    parts = cells.groupBy("conv", "part").agg(F.min("cell").alias("low"), F.count(F.lit(1)).alias("n"))
    # a conversation has as many rows here as it has range partitions
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return cells.join(parts, ["conv", "part"]).select("conv", (F.col("before") + F.col("cell") - F.col("low")).alias("at"), "key", "words")


def shared_openings(turns: DataFrame, base: Column, share: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """``conv, length`` and ``conv, d, key, words``: each conversation with its first turns replaced by those of another.

    The first ``share`` turns (a column of ``conv``, ``most`` at most) are those
    of conversation ``base``, all if it has fewer and none if it does not exist;
    the conversation's own turns follow from ``share`` on.
    """
    turns = durable(turns)
    sizes = turns.groupBy("conv").agg((F.max("at") + 1).alias("n"))
    pairs = sizes.select("conv", "n", base.alias("base"), share.cast("bigint").alias("share"))
    pairs = pairs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("others")), "base", "left")
    taken = F.least("share", F.coalesce("others", F.lit(0).cast("bigint")))
    pairs = durable(pairs.select("conv", "base", "share", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("share"), F.lit(0))).alias("length")))
    opening = turns.where(F.col("at") < most).select(F.col("conv").alias("base"), "at", "key", "words").join(pairs.select("conv", "base", "share"), "base").where("at < share")
    own = turns.join(pairs.select("conv", "share", "taken"), "conv").where("at >= share")
    rows = opening.select("conv", (F.col("at") + 1).alias("d"), "key", "words").unionByName(own.select("conv", (F.col("taken") + F.col("at") - F.col("share") + 1).alias("d"), "key", "words"))
    return pairs.select("conv", "length"), rows


@dataclass(frozen=True)
class Trie:
    """``nodes``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends``, a node named
    by its smallest member and its depth.  ``ends``: ``conv_id, depth, member`` for conversations that end in a node of
    several members; in a node of one only that one can end.
    """

    nodes: DataFrame
    ends: DataFrame


def trie(convs: DataFrame, turns: DataFrame) -> Trie:
    """The trie of ``convs(conv, length)`` and their ``turns(conv, d, key, words)``, ``d`` from 1 to the length."""
    spark = convs.sparkSession
    convs = durable(convs)
    path = shared_path(spark, "turns")
    # files and row groups hold few depths each, so that a round reads its own
    turns.repartitionByRange("d", "conv").sortWithinPartitions("d").write.parquet(path)
    turns = spark.read.parquet(path)
    whole = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low"), F.max("length").alias("length"), F.count_if(F.col("length") == 0).alias("ends")).first()
    total = whole["n"]
    kind = "cls bigint, n bigint, conv_id bigint, words bigint, length bigint, ends bigint"
    levels = [spark.createDataFrame([(None, total, whole["low"], 0, whole["length"], whole["ends"])] if total else [], kind)]
    active = convs.where("length > 0").select("conv", "length", F.lit(whole["low"]).cast("bigint").alias("cls"))
    ended = [convs.where("length = 0").select(F.lit(whole["low"]).cast("bigint").alias("conv_id"), F.lit(0).alias("depth"), F.col("conv").alias("member"))]
    while total > 1:
        depth = len(levels)
        split = durable(active.join(turns.where(F.col("d") == depth), "conv").select("conv", "length", "cls", F.concat_ws(":", "cls", "key").alias("branch"), "words"))
        level = durable(split.groupBy("branch").agg(F.min("cls").alias("cls"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv_id"), F.min("words").alias("words"), F.max("length").alias("length"), F.count_if(F.col("length") == depth).alias("ends")))
        if level.isEmpty():
            break
        levels.append(level.drop("branch"))
        several = level.where("n > 1").select("branch", "n", "conv_id")
        members = durable(join_spread(split.select("conv", "length", "branch"), several, "branch", "n", total).where("conv_id is not null"))
        ended.append(members.where(F.col("length") == depth).select("conv_id", F.lit(depth).alias("depth"), F.col("conv").alias("member")))
        active = members.where(F.col("length") > depth).select("conv", "length", F.col("conv_id").alias("cls"))

    # a class of one: its own turns from the next depth on, none of which another conversation shares
    retired = [level.where((F.col("n") == 1) & (F.col("length") > depth)).select(F.col("conv_id").alias("conv"), F.lit(depth).alias("depth"), "length") for depth, level in enumerate(levels)]
    alone = retired[0]
    for more in retired[1:]:
        alone = alone.unionByName(more)
    tails = turns.select("conv", "d").join(alone, "conv").where("d > depth")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    chain = tails.select(F.col("conv").alias("conv_id"), F.col("d").cast("int").alias("depth"), F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("d") < F.col("length")).cast("bigint").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), (F.col("d") == F.col("length")).cast("bigint").alias("n_ends"))

    nodes, below = chain, None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if below is None:
            level = level.withColumns({"children": F.lit(None).cast("bigint"), "leaves": F.lit(None).cast("bigint"), "saved": F.lit(None).cast("bigint")})
        else:
            level = level.join(below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")), "conv_id", "left")
        own = (F.col("n") - 1) * F.col("words")
        below = durable(
            level.select(
                "conv_id", F.lit(depth).alias("depth"), F.col("cls").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("children", ((F.col("n") == 1) & (F.col("length") > depth)).cast("bigint")).alias("n_children"),
                F.coalesce("leaves", one).alias("n_leaves"), (own + F.coalesce("saved", zero)).alias("saved_tokens"), F.col("ends").alias("n_ends"),
            )
        )
        nodes = nodes.unionByName(below)
    ends = ended[0]
    for more in ended[1:]:
        ends = ends.unionByName(more)
    nodes = durable(nodes)
    drop_path(spark, path)
    return Trie(nodes, ends)


def ends_digest(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: the SHA-256 of each node's members in ``ends``, ascending and joined by commas.

    Members are joined to chunks of ``CHUNK`` bytes where they lie in order, and
    the chunks of a node stream through one task.
    """
    order = ["depth", "conv_id", "member"]
    kind = pa.schema([("depth", pa.int32()), ("conv_id", pa.int64()), ("member", pa.int64()), ("chunk", pa.string())])

    def chunks(batches):
        node, first, held, size = None, None, [], 0

        def out():
            return pa.RecordBatch.from_pylist([{"depth": node[0], "conv_id": node[1], "member": first, "chunk": ",".join(held)}], schema=kind)

        for batch in batches:
            for depth, conv, member in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (node != (depth, conv) or size >= CHUNK):
                    yield out()
                    held, size = [], 0
                if not held:
                    node, first = (depth, conv), member
                held.append(str(member))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def digests(batches):
        node, state = None, None
        done: list[tuple] = []

        def out():
            return pa.RecordBatch.from_pylist([{"conv_id": n[1], "depth": n[0], "ends_sha256": s} for n, s in done], schema=pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string())]))

        for batch in batches:
            for depth, conv, chunk in zip(*(batch.column(n).to_pylist() for n in ("depth", "conv_id", "chunk"))):
                if node == (depth, conv):
                    state.update(b"," + chunk.encode())
                    continue
                if node:
                    done.append((node, state.hexdigest()))
                node, state = (depth, conv), hashlib.sha256(chunk.encode())
            if len(done) > 10_000:
                yield out()
                done = []
        if node:
            done.append((node, state.hexdigest()))
        yield out()

    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth int, conv_id bigint, member bigint, chunk string")
    return joined.repartition("depth", "conv_id").sortWithinPartitions(*order).mapInArrow(digests, "conv_id bigint, depth int, ends_sha256 string")


def with_digest(found: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``; that of nothing where no conversation ends."""
    empty = F.lit(hashlib.sha256().hexdigest())
    own = F.when(F.col("n_ends") > 0, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty)
    alone = found.nodes.where("n_convs = 1").withColumn("ends_sha256", own)
    several = found.nodes.where("n_convs > 1").join(ends_digest(found.ends), ["conv_id", "depth"], "left")
    return alone.unionByName(several.withColumn("ends_sha256", F.coalesce("ends_sha256", empty)))
