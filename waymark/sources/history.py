"""History logs as the version-control tool prints them, parsed with column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.ordering import top_per_group
from waymark.operators.scan import carried


def _carried(lines: DataFrame, is_head: F.Column) -> DataFrame:
    """Adds to each line (``log, seq, line``) the head line of its commit and where that stands."""
    heads = F.when(is_head, F.struct(F.col("line").alias("line"), F.col("seq").alias("seq")))
    return carried(lines, "log", "seq", heads, "found").select("*", F.col("found.line").alias("head"), F.col("found.seq").alias("head_seq"), is_head.alias("is_head"))


def parse_stats_log(lines: DataFrame) -> DataFrame:
    """``ISO time|author`` heads followed by paths: ``log, ts, author, file``.

    ``lines(log, seq, line)``; a long log is spread over tasks like many short ones.
    """
    head = F.col("line").rlike(r"^\d{4}-\d\d-\d\dT[^|]*\|")
    rows = _carried(lines, head).where(~F.col("is_head") & (F.trim("line") != "") & F.col("head").isNotNull())
    parts = F.split("head", r"\|", 2)
    return rows.select("log", F.to_timestamp(parts[0]).alias("ts"), parts[1].alias("author"), F.trim("line").alias("file"))


def parse_touch_log(lines: DataFrame) -> DataFrame:
    """Heads of 40 hex digits followed by paths: ``commit_id, file``."""
    head = F.col("line").rlike("^[0-9a-f]{40}$")
    rows = _carried(lines, head).where(~F.col("is_head") & (F.trim("line") != "") & F.col("head").isNotNull())
    return rows.select(F.col("head").alias("commit_id"), F.trim("line").alias("file"))


def parse_story_log(lines: DataFrame) -> DataFrame:
    """Four lines a commit (id, author, time, subject): ``symbol, commit_id, author, ts, subject``.

    ``lines(symbol, seq, line)``.
    """
    rows = lines.where(F.trim("line") != "").select(F.col("symbol").alias("log"), "seq", "line")
    rows = _carried(rows, F.col("line").rlike("^[0-9a-f]{40}$")).where(F.col("head").isNotNull())
    # a commit's first lines, however many follow
    first = top_per_group(rows, ["log", "head_seq"], 4, F.col("seq"))
    got = first.groupBy("log", "head_seq", "head").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("l")).where("size(l) >= 4")
    return got.select(F.col("log").alias("symbol"), F.col("head").alias("commit_id"), F.col("l")[1].alias("author"), F.to_timestamp(F.col("l")[2]).alias("ts"), F.col("l")[3].alias("subject"))
