"""File sources: trees, listings, exclusions, project hints, concatenation."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import paths, text
from waymark.operators.languages import BY_SUFFIX


def tree(spark: SparkSession, *roots: str, pattern: str | None = None) -> DataFrame:
    """``path, modified, length, content`` of the files below the roots.

    Spark's listing leaves out files of no bytes and names that start with a dot
    or an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(list(roots)).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


def listed(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that a version-control listing (``path``) names, without markdown."""
    return files.join(listing.select("path"), "path", "left_semi").where(~paths.is_markdown(F.col("path")))


def walked(files: DataFrame, root: str) -> DataFrame:
    """Files without hidden and generated folders, hidden files and markdown."""
    below = paths.relative(F.col("path"), root)
    return files.where(~paths.is_hidden(below) & ~paths.is_markdown(F.col("path")))


def with_text(files: DataFrame, root: str = "") -> DataFrame:
    """``path, rel, modified, text``."""
    rel = paths.relative(F.col("path"), root) if root else F.col("path")
    return files.select("path", rel.alias("rel"), "modified", text.valid_text(F.col("content")).alias("text"))


def with_extensions(files: DataFrame, extensions: str, column: str = "path") -> DataFrame:
    """``py,js`` or ``.py,.js``."""
    wanted = ["." + e.strip().lower().lstrip(".") for e in extensions.split(",") if e.strip()]
    return files.where(paths.extension(F.col(column)).isin(wanted)) if wanted else files


def tracked(requested: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested paths that exist, and the others with a reason."""
    found = files.select("path")
    return requested.join(found, "path", "left_semi"), requested.join(found, "path", "left_anti").withColumn("reason", F.lit("[EXCLUDED] File not found"))


def source_dirs(pyproject: str) -> list[str]:
    """Source folders that a project file names; none if it can't be read as such."""
    try:
        tool = tomllib.loads(pyproject).get("tool", {})
        found = list(tool.get("ty", {}).get("src", {}).get("include", []))
        setup = tool.get("setuptools", {})
        packages = setup.get("packages", [])
        if isinstance(packages, list):
            found += [p.split(".")[0] for p in packages]
        found += [f"{m}.py" for m in setup.get("py-modules", [])]
        top = setup.get("package-dir", {}).get("")
        found += [top] if top else []
        return list(dict.fromkeys(map(str, found)))
    except (tomllib.TOMLDecodeError, AttributeError, TypeError):
        return []


def working_set(*signals: DataFrame) -> DataFrame:
    """The union of path signals."""
    return reduce(lambda a, b: a.unionByName(b), (s.select("path") for s in signals)).distinct()


def status_paths(lines: DataFrame) -> DataFrame:
    """``path`` of each ``line`` of a short status listing; of a rename the new one."""
    moved = F.substring_index(F.substring("line", 4, 1 << 20), " -> ", -1)
    return lines.where(F.length("line") > 3).select(F.trim(moved).alias("path")).where("path <> ''").distinct()


def recent_paths(history: DataFrame, commits: int = 3, author: str | None = None) -> DataFrame:
    """``path`` of the files of the latest commits, those of an author if one is given and has any."""
    own = history if author is None else history.where(F.col("author") == author)
    own = history if author is not None and own.isEmpty() else own
    last = own.groupBy("commit_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "commit_id").limit(commits)
    return own.join(F.broadcast(last.select("commit_id")), "commit_id", "left_semi").select(F.col("file").alias("path")).distinct()  # a few commits


def concatenated(files: DataFrame) -> DataFrame:
    """``seq, block``: each text under its path, by path; rows without text drop out."""
    rule = "=" * 80
    rows = files.where("text is not null").select("path", F.concat(F.lit(rule + "\n"), F.col("path"), F.lit("\n" + rule + "\n"), F.col("text"), F.lit("\n")).alias("block"))
    return rows.orderBy("path")


#: Bytes of joined text beyond which a reader is warned.
LARGE = 200 * 1024


def concatenation_size(files: DataFrame) -> DataFrame:
    """One row ``files, bytes, large`` of what ``concatenated`` gives."""
    blocks = concatenated(files)
    return blocks.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("block")), F.lit(0)).alias("bytes")).withColumn("large", F.col("bytes") > LARGE)


# Languages with extraction rules, by file suffix.
LANGUAGES = {".py": "python", ".pyi": "python", ".md": "markdown", ".markdown": "markdown", ".mdown": "markdown", ".mkd": "markdown"} | {suffix: found.name for suffix, found in BY_SUFFIX.items()}


def language(column: str = "path") -> F.Column:
    """The language of a path, null where there are no rules."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), paths.extension(F.col(column)))


def without_chat(found: DataFrame, chat: DataFrame) -> DataFrame:
    """The other files: those of ``found`` whose path is none of ``chat(path)``."""
    return found.join(chat.select("path").distinct(), "path", "left_anti")
