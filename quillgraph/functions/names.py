"""Qualified names, container chains, spelling and shape predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(name: Column) -> Column:
    """A name without underscores and hyphens, in lower case."""
    return F.lower(F.regexp_replace(name, "[_-]", ""))


def near_kind(asked: Column, name: Column) -> Column:
    """0 spelling, 1 substring, null neither or equal. Edit distance has no part in it."""
    a, b = F.lower(asked), F.lower(name)
    return F.when(asked == name, None).when(folded(asked) == folded(name), 0).when((F.length(asked) > 0) & (F.contains(a, b) | F.contains(b, a)), 1)


def split_qualified(raw: Column) -> tuple[Column, Column]:
    """(chain, last part) of a name divided by "." or "#"; empty parts don't count."""
    parts = F.filter(F.split(raw, "[.#]"), lambda p: p != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def chain_is_tail(written: Column, actual: Column) -> Column:
    return F.slice(F.reverse(actual), 1, F.size(written)) == F.reverse(written)


def chain_is_head(written: Column, actual: Column) -> Column:
    return F.slice(actual, 1, F.size(written)) == written


def is_identifier(raw: Column) -> Column:
    """At most 128 bytes of letters, digits, "_", "." and "#", beginning with a letter or "_"."""
    return (F.octet_length(raw) <= 128) & raw.rlike(r"\A[\p{L}_][\p{L}\p{N}_.#]*\z")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)\z", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_camel(raw: Column) -> Column:
    return raw.rlike(r"\A[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\z")


def is_path_like(raw: Column) -> Column:
    return raw.rlike(r"\A[\w.*@-]+(?:/[\w.*@-]+)+/?\z")


def without_line(raw: Column) -> Column:
    """A path without a trailing :line or :line:column."""
    return F.regexp_replace(raw, r"(?::\d+){1,2}\z", "")


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}\s_-]", ""), r"\s+", "-")


def cypher_quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
