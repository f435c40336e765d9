"""Text expressions: name parts, search positions, markdown clean-up, rendering of signatures and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.config import HIGH, LOW


def name_parts(name: Column) -> Column:
    """X23."""
    return F.split(F.lower(name), r"[_\s]+")


def letter_runs(name: Column) -> Column:
    """Letter runs of the lower-cased name without underscores; case never splits it."""
    return F.regexp_extract_all(F.replace(F.lower(name), F.lit("_"), F.lit("")), F.lit("[a-z]+"), 0)


def matches_query(name: Column, query: Column) -> Column:
    """F08; an empty query matches nothing."""
    low, q, parts = F.lower(name), F.lower(query), name_parts(query)
    return (F.trim(query) != "") & (low.contains(q) | (F.size(F.array_except(parts, name_parts(name))) == 0) | F.arrays_overlap(parts, letter_runs(name)))


def position(name: Column, query: str) -> Column:
    """The place of the match from 0, -1 for none."""
    return F.instr(F.lower(name), query.lower()) - 1


def valid_text(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 is dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def lines_of_code(text: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: F.trim(line) != ""))


def line_of(text: Column, offset: Column) -> Column:
    """The line number of a character offset (from 0)."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def without_fences(text: Column) -> Column:
    """Markdown without fenced blocks, an unclosed fence kept."""
    return F.regexp_replace(text, r"(?ms)^(`{3,}|~{3,}).*?^\1[^\n]*", "")


def headers(text: Column) -> Column:
    """Header lines outside of fenced blocks, as matched."""
    return F.regexp_extract_all(without_fences(text), F.lit(r"(?m)^#{1,6}[ \t]+[^\n]+$"), 0)


def header_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^(#{1,6})", 1))


def header_title(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+?)(?:\s*#*)?$", 1))


def snippet(text: Column) -> Column:
    """Prose of a section on one line."""
    out = F.regexp_replace(without_fences(text), r"`([^`]*)`", "$1")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(\*\*|__|\*|_)(\S(?:.*?\S)?)\1", "$2")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def head_tail(text: Column, most: int = 80) -> Column:
    """Beyond ``most`` characters, whole words of the first 60 % and of the rest around ``[...]``."""
    head = int(most * 0.6)
    first = F.regexp_replace(F.substring(text, 1, head), r"\s+\S*$", "")
    last = F.regexp_replace(F.substring(text, -(most - head), most), r"^\S*\s+", "")
    strip = lambda c: F.regexp_replace(c, r"^[\s.,;:!?-]+|[\s.,;:!?-]+$", "")
    return F.when(F.length(text) > most, F.concat_ws(" ", strip(first), F.lit("[...]"), strip(last))).otherwise(text)


def simple_type(kind: Column) -> Column:
    """X30."""
    return F.substring_index(kind, "[", 1)


def ellipsis(text: Column, most: int = 20) -> Column:
    """X31."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def basename(path: Column) -> Column:
    """X32."""
    return F.substring_index(path, "/", -1)


def node_id(file: Column, symbol: Column) -> Column:
    """X35."""
    return F.concat_ws(":", file, symbol)


def render_signature(signature: Column, detail: Column, fresh: Column | None = None) -> Column:
    """``...``, names, or names with types and the result type; raw text stands in where there is no structure.

    ``fresh``, an array of booleans, tells of which parameters the type is shown
    in full detail; null or none: of all.
    """
    names = F.array_join(F.transform(signature["parameters"], lambda p: p["name"]), ", ")
    shown = lambda p, i: p["type"].isNotNull() & (F.lit(True) if fresh is None else F.coalesce(F.get(fresh, i), F.lit(True)))
    typed = F.array_join(F.transform(signature["parameters"], lambda p, i: F.when(shown(p, i), F.concat(p["name"], F.lit(": "), p["type"])).otherwise(p["name"])), ", ")
    result = F.when(signature["return_type"].isNull(), "").otherwise(F.concat(F.lit(" -> "), signature["return_type"]))
    shape = F.when(detail == LOW, F.lit("...")).when(detail == HIGH, F.concat(F.lit("("), typed, F.lit(")"), result)).otherwise(F.concat(F.lit("("), names, F.lit(")")))
    return F.when(signature["raw"].isNotNull(), F.concat(F.lit('— "'), signature["raw"], F.lit('"'))).otherwise(shape)


def render_field(field: Column, detail: Column) -> Column:
    """X37."""
    kind = field["type_annotation"]
    return F.when((detail == LOW) | kind.isNull(), field["name"]).when(detail == HIGH, F.concat(field["name"], F.lit(": "), kind)).otherwise(F.concat(field["name"], F.lit(": "), simple_type(kind)))


def class_preview(name: Column, fields: Column, detail: Column, most: int = 5) -> Column:
    """The class and its first fields, ``+k`` for the rest."""
    shown = F.array_join(F.transform(F.slice(fields, 1, most), lambda f: render_field(f, detail)), ", ")
    more = F.when(F.size(fields) > most, F.concat(F.lit(", +"), (F.size(fields) - most).cast("string"))).otherwise("")
    return F.when(F.coalesce(F.size(fields), F.lit(0)) <= 0, name).otherwise(F.concat(name, F.lit("("), shown, more, F.lit(")")))


def story_card(name: Column, created: Column, by: Column, commits: Column, authors: Column) -> Column:
    """X39; parts that are null are left out."""
    return F.concat(
        name, F.lit(": "), F.concat_ws(" ", F.concat(F.lit("created "), F.date_format(created, "yyyy-MM-dd")), F.concat(F.lit("by "), by), F.concat(commits.cast("string"), F.lit(" commits")), F.concat(authors.cast("string"), F.lit(" authors")))
    )


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up; a counter with a vocabulary can be passed to the engine instead."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def sampled_tokens(text: Column, all_below: int = 200, lines: int = 100) -> Column:
    """Long texts are counted on every n-th line and scaled by characters."""
    rows = F.split(text, "\n")
    step = F.greatest(F.lit(1), (F.size(rows) / lines).cast("int"))
    picked = F.array_join(F.filter(rows, lambda _, i: i % step == 0), "\n")
    scaled = (F.length(text) * token_estimate(picked) / F.greatest(F.length(picked), F.lit(1))).cast("bigint")
    return F.when(F.length(text) < all_below, token_estimate(text)).otherwise(scaled)
