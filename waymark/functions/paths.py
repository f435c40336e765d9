"""Path expressions: depth, vendor and extension predicates, keys of directories and clusters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config


def relative(path: Column, root: str) -> Column:
    """below ``root`` without it, elsewhere unchanged."""
    lead = root.rstrip("/") + "/"
    return F.when(path.startswith(lead), F.substring(path, len(lead) + 1, 1 << 20)).otherwise(path)


def is_markdown(path: Column) -> Column:
    """F03."""
    return F.lower(path).rlike(r"\.(md|markdown|mdown|mkd)$")


def extension(path: Column) -> Column:
    """the lower-cased suffix with its dot, empty if none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def is_vendor(path: Column, config: Config = DEFAULT) -> Column:
    """a substring test on purpose."""
    return path.rlike("|".join(map(re.escape, config.vendor_patterns)))


def depth(path: Column) -> Column:
    """The number of separators."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def depth_weight(path: Column, config: Config = DEFAULT) -> Column:
    """F06."""
    return F.when(is_vendor(path, config), config.weight_vendor).when(depth(path) <= config.depth_shallow, config.weight_shallow).when(depth(path) <= config.depth_moderate, config.weight_moderate).otherwise(config.weight_deep)


def is_hidden(path: Column) -> Column:
    """Files and folders that a plain walk leaves out."""
    return path.rlike(r"(^|/)(\.[^/]*|node_modules|__pycache__|venv|env)(/|$)") & ~path.rlike(r"(^|/)(node_modules|__pycache__|venv|env)$")


# Names that mark a file as important.
IMPORTANT = (
    "README.md", "README.txt", "readme.md", "README.rst", "README",
    "requirements.txt", "Pipfile", "pyproject.toml", "setup.py", "setup.cfg",
    "package.json", "yarn.lock", "package-lock.json", "npm-shrinkwrap.json",
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    ".gitignore", ".gitattributes", ".dockerignore",
    "Makefile", "makefile", "CMakeLists.txt",
    "LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING",
    "CHANGELOG.md", "CHANGELOG.txt", "HISTORY.md",
    "CONTRIBUTING.md", "CODE_OF_CONDUCT.md",
    ".env", ".env.example", ".env.local",
    "tox.ini", "pytest.ini", ".pytest.ini",
    ".flake8", ".pylintrc", "mypy.ini",
    "go.mod", "go.sum", "Cargo.toml", "Cargo.lock",
    "pom.xml", "build.gradle", "build.gradle.kts",
    "composer.json", "composer.lock",
    "Gemfile", "Gemfile.lock",
)


def is_important(path: Column) -> Column:
    """well-known names anywhere; workflows, project files and documents right in their folder at the root."""
    base = F.substring_index(path, "/", -1)
    in_folder = path.rlike(r"^(\.github/workflows/[^/]*\.ya?ml|\.github/[^/]*\.(md|ya?ml)|docs/[^/]*\.(md|rst|txt))$")
    return base.isin(*IMPORTANT) | in_folder


def looks_like_path(text: Column) -> Column:
    """F18."""
    return text.rlike(r"\.(py|js|ts|jsx|tsx|java|go|rs|md)$")


def parent_dir(path: Column) -> Column:
    """The folder, ``root`` for none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]+$", "")).otherwise("root")


def cluster_key(path: Column, anchors: tuple[str, ...] = ("src", "lib", "tests", "app")) -> Column:
    """Two folders from the first anchor on, else of the last three components; ``(root)`` for none."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    found = F.array_min(F.filter(F.array(*(F.array_position(folders, a) for a in anchors)), lambda p: p > 0))
    after = F.slice(folders, F.coalesce(found, F.lit(1)).cast("int") + 1, 2)
    last = F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), 2)
    key = F.array_join(F.when(found.isNotNull() & (F.size(after) > 0), after).otherwise(last), "/")
    return F.when(F.size(folders) == 0, "(root)").when(key == "", "(root)").otherwise(key)


def prefixes(path: Column) -> Column:
    """Every folder above a file, the top one (``.``) included."""
    parts = F.split(path, "/")
    below = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.concat(F.array(F.lit(".")), below)
